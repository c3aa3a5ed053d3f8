"""A graph as tables of the warehouse, laid out so that what meets at a node needs no shuffle: nodes by id and edge ends by node in the same buckets, in parts by graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of a stored graph and the column whose hash is their bucket.
PARTS = {"nodes": "id", "ends": "node"}
#: Columns whose values hardly repeat within a file, so a dictionary of them would be built and thrown away.
PLAIN = {"nodes": ("id", "uri", "seq"), "ends": ("id", "node", "other")}
#: Edge ends of a bucket, about: a task sorts them in some 220 MB; the nodes of parts and suppliers that go with them took 400.
BUCKET_ROWS = 2_000_000


def buckets_for(edges: DataFrame) -> int:
    """How many buckets the tables of these edges get: by their ends, at least one a core. The session's number of shuffle partitions doesn't count, as every bucket is a file in every graph. The edges are counted."""
    return max(edges.sparkSession.sparkContext.defaultParallelism, -(-2 * edges.count() // BUCKET_ROWS))


def edge_ends(edges: DataFrame) -> DataFrame:
    """(kgraph_id, node, other, type, id, away): every edge at both of its ends, away from its source and not at its target."""
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("away")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("away"))))
    return edges.select("kgraph_id", "type", "id", both.alias("e")).select("e.node", "e.other", "e.away", "type", "id", "kgraph_id")


def _parts(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    return {"nodes": nodes.select(*[c for c in nodes.columns if c != "kgraph_id"], "kgraph_id"), "ends": edge_ends(edges)}


def create(nodes: DataFrame, edges: DataFrame, name: str, buckets: int) -> None:
    """Writes the tables ``<name>_nodes`` and ``<name>_ends``. Rows are dealt to their buckets before they are written, so a graph has one file a bucket. Files aren't sorted by id: a bucket is a file for each graph, so no join could use it."""
    for part, rows in _parts(nodes, edges).items():
        plain = {f"parquet.enable.dictionary#{c}": "false" for c in PLAIN[part]}
        rows.repartition(buckets, PARTS[part]).write.options(**plain).partitionBy("kgraph_id").bucketBy(buckets, PARTS[part]).format("parquet").saveAsTable(f"{name}_{part}")


def replace_graphs(nodes: DataFrame, edges: DataFrame, name: str, buckets: int) -> None:
    """Writes the graphs of these rows in place of those with their numbers; the others stay as they are, and are not read."""
    spark = nodes.sparkSession
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for part, rows in _parts(nodes, edges).items():
            rows.repartition(buckets, PARTS[part]).select(spark.table(f"{name}_{part}").columns).write.mode("overwrite").insertInto(f"{name}_{part}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def remove_graph(spark: SparkSession, name: str, kgraph_id: int) -> None:
    """Drops a graph's parts: no row is read. An edge belongs to its graph, so none of another one goes."""
    for part in PARTS:
        spark.sql(f"alter table {name}_{part} drop if exists partition (kgraph_id = {int(kgraph_id)})")


def drop(spark: SparkSession, name: str) -> None:
    for part in PARTS:
        spark.sql(f"drop table if exists {name}_{part}")


def stored_degrees(spark: SparkSession, name: str) -> DataFrame:
    """id, in_degree, out_degree, degree of every node, counted within its bucket."""
    ends = spark.table(f"{name}_ends").groupBy("node").agg(F.count(F.when(~F.col("away"), 1)).alias("i"), F.count(F.when(F.col("away"), 1)).alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return spark.table(f"{name}_nodes").select("id").join(ends, F.col("id") == F.col("node"), "left").select("id", zero(F.col("i")).alias("in_degree"), zero(F.col("o")).alias("out_degree"), zero(F.col("i") + F.col("o")).alias("degree"))


def stored_neighbors(spark: SparkSession, name: str, tag: str) -> DataFrame:
    """(node, other) of the edges whose ``node`` has a tag; nodes meet their edge ends in their bucket."""
    tagged = spark.table(f"{name}_nodes").filter(F.array_contains("tags", tag)).select(F.col("id").alias("tagged"))
    return spark.table(f"{name}_ends").join(tagged, F.col("node") == F.col("tagged"), "left_semi").select("node", "other")
