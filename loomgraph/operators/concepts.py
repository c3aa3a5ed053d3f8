"""Concepts assembled from atoms, definitions, semantic types and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import is_cui

# The identifier columns by which a concept may be looked up.
NAMESPACES = ("cui", "lui", "sui", "aui", "scui", "sdui")


def is_preferred():
    return (F.col("stt") == "PF") & (F.col("ispref") == "Y") & (F.col("ts") == "P")


def without_sources(rows: DataFrame, blacklist: list[str], column: str = "sab") -> DataFrame:
    return rows.filter(~F.coalesce(F.col(column).isin(*blacklist), F.lit(False))) if blacklist else rows


def assemble(atoms: DataFrame, definitions: DataFrame, types: DataFrame, relations: DataFrame, seq: str = "seq") -> DataFrame:
    """cui, name, source, synonyms, semantic_types, definitions, relations of each concept with a preferred atom; of several the last counts.

    Each side is grouped before it is joined, so no side multiplies another.
    """
    preferred = atoms.filter(is_preferred()).groupBy("cui").agg(F.max_by(F.struct("str", "sab", "scui"), seq).alias("p"))
    others = atoms.filter(~F.coalesce(is_preferred(), F.lit(False))).groupBy("cui").agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), "str", "sab"))).alias("s"))
    defs = definitions.groupBy("cui").agg(F.sort_array(F.collect_list(F.struct("def", "sab"))).alias("definitions"))
    kinds = types.groupBy("cui").agg(F.sort_array(F.collect_set(F.struct("tui", "sty"))).alias("semantic_types"))
    rels = relations.groupBy(F.col("cui1").alias("cui")).agg(F.sort_array(F.collect_list(F.struct("rui", "rel", "rela", F.col("cui2").alias("cui"), "sab"))).alias("relations"))
    out = preferred.join(others, "cui", "left").join(defs, "cui", "left").join(kinds, "cui", "left").join(rels, "cui", "left")
    return out.select("cui", F.col("p.str").alias("name"), F.struct(F.col("p.sab").alias("name"), F.col("p.scui").alias("ui")).alias("source"), F.transform("s", lambda x: F.struct(x["str"].alias("name"), x["sab"].alias("source"))).alias("synonyms"), "definitions", "semantic_types", "relations")


def find(queries: DataFrame, atoms: DataFrame, top: int, skip: int = 0) -> DataFrame:
    """(term, cui, score) of query terms: a concept id by itself, else exact strings (score null), else words of strings by share of the string, best first."""
    term = F.col("term")
    by_id = queries.filter(is_cui(term)).select("term", F.upper("term").alias("cui"), F.lit(None).cast("double").alias("score"))
    by_name = queries.filter(~is_cui(term)).join(atoms.select(F.col("str").alias("term"), "cui").distinct(), "term").select("term", "cui", F.lit(None).cast("double").alias("score"))
    rest = queries.filter(~is_cui(term)).join(by_name.select("term"), "term", "left_anti")
    asked = rest.select("term", F.explode(F.array_distinct(F.split(F.lower("term"), r"\W+"))).alias("word")).filter("word != ''")
    held = atoms.select("cui", "str", F.explode(F.array_distinct(F.split(F.lower("str"), r"\W+"))).alias("word")).filter("word != ''")
    scored = asked.join(held, "word").groupBy("term", "cui", "str").agg((F.count("*") / F.length("str")).alias("score")).groupBy("term", "cui").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "cui"))
    best = scored.withColumn("_place", place).filter(F.col("_place").between(skip + 1, skip + top)).drop("_place")
    return by_id.unionByName(by_name).unionByName(best)


def by_namespace(atoms: DataFrame, namespace: str, value: str) -> DataFrame:
    if namespace not in NAMESPACES:
        raise ValueError(f"unknown namespace {namespace}")
    return atoms.filter(F.col(namespace) == value).select("cui").distinct().orderBy("cui").limit(1)


def expand_relations(concepts: DataFrame, relations: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(src, dst, type = rui, scope = label) of the relations of concepts that aren't obsolete, one for each rui."""
    live = relations.filter("coalesce(suppress, 'N') != 'O'")
    if labels:
        live = live.filter(F.upper(F.coalesce("rela", "rel")).isin(*[x.upper() for x in labels]))
    found = concepts.select(F.col("cui").alias("cui1")).join(live, "cui1").dropDuplicates(["rui"])
    return found.select(F.col("cui1").alias("src"), F.col("cui2").alias("dst"), F.col("rui").alias("type"), F.coalesce("rela", "rel").alias("scope"))


def data_sources(sources: DataFrame) -> DataFrame:
    """name -> its versions and descriptions, by name."""
    return sources.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("version", "description"))).alias("versions")).orderBy("name")


def relations_to(relations: Column, cui: str) -> Column:
    """The relations of a concept whose other end is the concept cui."""
    return F.filter(relations, lambda r: r["cui"] == cui)


def ordered_distinct(values: Column) -> Column:
    """Values without repeats, in the order in which they first occur."""
    return F.array_distinct(values)


def promoted(rows: DataFrame) -> DataFrame:
    """(id, key, values) from rows (id, key, value, seq) of records: a key that is repeated in a record has all its values, in their order."""
    return rows.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("v")).select("id", "key", F.transform("v", lambda x: x["value"]).alias("values"))


def load_counts(rows: DataFrame, file: str, updated: str, kind: str) -> DataFrame:
    """For each file how many rows it gave, of how many kinds, and when it was last loaded."""
    return rows.groupBy(file).agg(F.count("*").alias("n"), F.countDistinct(kind).alias("kinds"), F.max(updated).alias("updated"))
