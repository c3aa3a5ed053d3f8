"""Drill-down facets: texts by the children of a chosen path in each of many dimensions, in one scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def below(paths: Column, path: str | None) -> Column:
    """The distinct children of a path (the first parts, if it is null) that some dotted paths are in: ``a.b`` and ``a.c.d`` are in the children ``a.b`` and ``a.c`` of ``a``."""
    if path is None:
        return F.array_distinct(F.transform(F.filter(paths, lambda p: p.isNotNull()), lambda p: F.substring_index(p, ".", 1)))
    depth = path.count(".") + 2
    return F.array_distinct(F.transform(F.filter(paths, lambda p: p.startswith(f"{path}.")), lambda p: F.substring_index(p, ".", depth)))


def at(paths: Column, path: str) -> Column:
    """Whether one of some paths is the path or below it."""
    return F.coalesce(F.exists(paths, lambda p: (p == path) | p.startswith(f"{path}.")), F.lit(False))


def drill_down(docs: DataFrame, id_col: str, dims: Mapping[str, Column], chosen: Mapping[str, str] | None = None, top: int | None = 20, by_value: bool = False) -> DataFrame:
    """(dim, path, n) of the texts that are at every chosen path: how many different ids each child of it has, or each first part in a dimension without a choice.

    ``dims`` are arrays of dotted paths; a text counts once for a child, whatever its number of paths there, and rows that repeat an id count as one text (all rows without an id too). ``top`` children a dimension are kept,
    by count, then path, or with ``by_value`` by path. Null arrays and paths are in no child. The texts are read once: each gives a row for each dimension and child it is in.
    """
    chosen = chosen or {}
    for name, path in chosen.items():
        docs = docs.filter(at(dims[name], path))
    entry = lambda name, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.struct(F.lit(name).alias("dim"), p.alias("path")))
    each = docs.select(F.struct(id_col).alias("text"), F.explode(F.concat(*[entry(name, below(c, chosen.get(name))) for name, c in dims.items()])).alias("f"))
    count = each.groupBy("f.dim", "f.path").agg(F.countDistinct("text").alias("n"))
    if top is None:
        return count
    order = ["path"] if by_value else [F.desc("n"), "path"]
    return count.withColumn("_place", F.row_number().over(Window.partitionBy("dim").orderBy(*order))).filter(F.col("_place") <= top).drop("_place")
