"""Loads of files into a table, each file once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.files import file_registry

MANIFEST = "load string, path string, sha1 string, rows long, at timestamp"


def _plain(path: Column) -> Column:
    """One form of the paths that different readers give."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^(\w+):/+", "$1:/")


class Loads:
    """A table in a folder, in parts by load, and a manifest of the files that are in it.

    A load counts once its manifest is written, which is one file and comes last; what a load that broke off has left is not read, and is written over by the next try. A file is known by the sha1 of its bytes, whatever its
    name, so running a load again, or with copies of its files, loads nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def manifest(self) -> DataFrame:
        """(load, path, sha1, rows, at) of every file that is loaded; rows is 0 for a file without any."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/*") if self._exists("manifest") else self.spark.createDataFrame([], MANIFEST)

    def rows(self, schema: str) -> DataFrame:
        """The table: what all counted loads have brought, with the file of each row in ``source_file``."""
        done = [r[0] for r in self.manifest().select("load").distinct().collect()]
        schema = f"{schema}, source_file string"
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/rows/{load}" for load in done]) if done else self.spark.createDataFrame([], schema)

    def load(self, path: str, read: Callable[[list[str]], DataFrame], **measures: Column) -> dict:
        """Loads the files below a path that are in no load yet: ``read`` makes rows of a list of files, without a shuffle. Returns ``load`` (null if there was nothing to do), ``files``, ``rows`` and the measures,
        aggregates that are observed while the rows are written, so that they aren't read for them.

        Of files with the same bytes the first by path counts; files without bytes are left out. The driver holds the list of new files, as Spark does.
        """
        new = file_registry(self.spark, path).groupBy("sha1").agg(F.min("path").alias("path")).join(self.manifest().select("sha1").distinct(), "sha1", "left_anti")
        files = sorted((r["sha1"], r["path"]) for r in new.collect())
        if not files:
            return {"load": None, "files": 0, "rows": 0}
        load, seen = hashlib.sha1("".join(sha1 for sha1, _ in files).encode()).hexdigest(), Observation()
        rows = read([p for _, p in files]).withColumn("source_file", _plain(F.input_file_name()))
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in measures.items()]).write.mode("overwrite").parquet(f"{self.folder}/rows/{load}")
        count = self.spark.read.parquet(f"{self.folder}/rows/{load}").groupBy("source_file").agg(F.count("*").alias("n"))
        listed = self.spark.createDataFrame(files, "sha1 string, path string").withColumn("source_file", _plain(F.col("path"))).join(count, "source_file", "left")
        entry = listed.select(F.lit(load).alias("load"), "path", "sha1", F.coalesce("n", F.lit(0)).cast("long").alias("rows"), F.current_timestamp().alias("at"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{load}")
        return {"load": load, "files": len(files), **seen.get}

    def last_update(self):
        """When the last load was counted; null before the first."""
        return self.manifest().agg(F.max("at")).first()[0]
