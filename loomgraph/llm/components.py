"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.store import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node hangs its larger (or all its smaller) neighbours on the smallest node that it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(low, "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the smallest node that it can reach.

    Nulls and loops are left out; without edges the result is empty. Each round is written to the shared folder, so lineage stays short
    and no part of the graph passes through the driver; only a count of the edges and a checksum do, to see that nothing changes.
    """
    now = saved(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a != b").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark == before:
            break
        before = mark
        now = saved(_stars(_stars(now, True), False), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select("root").distinct().select(F.col("root").alias("node"), "root"))
