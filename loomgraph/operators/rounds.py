"""Tables written between the rounds of an iterative job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own where that is unset and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="rounds-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that no other job has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that one task sorts or groups at a time, about.
TASK_ROWS = 500_000


def parts_for(rows: DataFrame, copies: int = 1) -> int:
    """How many parts the rows (``copies`` of each) are dealt to, so that what one task holds doesn't grow with them; at least the session's number. Rows are counted, which a scan does without reading columns."""
    least = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return max(least, -(-rows.count() * copies // TASK_ROWS))


def written(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, so lineage stays short and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, read again: for what is read more than once, by some of its columns."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
