"""Tables that a job writes for itself, and blobs of numpy records that travel by bucket."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of records that one bucket should hold; the number of buckets follows the input.
BUCKET_BYTES = 8 << 20
BLOB = "bucket int, data binary"
_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own if all run on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="loom-"))
    return base.rstrip("/")


def drop(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Deletes the tables written since so many were, all but the one that ``keep`` reads: for a caller that needs none of them any more."""
    held = set(keep.inputFiles()) if keep is not None else set()
    for path in _written[since:]:
        if not any(path.split(":", 1)[-1].lstrip("/") in f for f in held):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written[since:]


def written() -> int:
    """How many tables have been written so far."""
    return len(_written)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/loom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_buckets(df: DataFrame, name: str, key: str) -> tuple[DataFrame, int]:
    """df as `saved` has it, in buckets by a key, and their number: what is dealt alike meets it without a shuffle of df. At least twice as many buckets as df has tasks."""
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())
    path = f"{shared_dir(spark)}/loom/{own}"
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).format("parquet").saveAsTable(own)
    _written.append(path)
    return spark.table(own), n


def buckets_for(n_bytes: float, least: int = 16) -> int:
    """A power of two, so that the top bits of a hash are the bucket."""
    n = least
    while n * BUCKET_BYTES < n_bytes:
        n *= 2
    return n


def top_bits(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash, in the order of the hashes."""
    return (h >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64) if n > 1 else np.zeros(len(h), np.int64)


def blobs(bucket: np.ndarray, records: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Records split by bucket; they must already be in the order of their buckets."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cut.tolist(), len(records)]
    ids, data = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            ids.append(int(bucket[a]))
            data.append(records[a:b].tobytes())
    return ids, data


def blob_batch(bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    ids, data = blobs(bucket, records)
    return pa.record_batch([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def unblob(table: pa.Table | pa.RecordBatch, dtype: np.dtype, column: str = "data") -> np.ndarray:
    """All records of a group of blobs."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in table.column(column) if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _give_back() -> None:
    """Returns what a worker has freed to the system, so that idle workers stay small beside busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library has it
        trim(0)


def mapped(df: DataFrame, fn, schema, **args) -> DataFrame:
    """fn(batches, **args) -> batches, for every partition of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches, **args)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def per_bucket(df: DataFrame, fn, schema: str, **args) -> DataFrame:
    """fn(table of one bucket, **args) -> table, for every bucket."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table, **args)
        finally:
            _give_back()

    return df.groupBy("bucket").applyInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Small parts of batches, before they become Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


#: Bits of the filters that are broadcast, at most: 4 MB.
FILTER_BITS = 1 << 25


def hash_filter(wanted: DataFrame, *hashes: Column) -> np.ndarray:
    """A filter with the low bits of some hashes of each row, in at most FILTER_BITS bits; with more rows than that it is fuller and keeps more."""
    bits, n = 1 << 12, wanted.count()
    while bits < 16 * n and bits < FILTER_BITS:
        bits *= 2
    words = wanted.select(F.explode(F.array(*[h.bitwiseAND(F.lit(bits - 1).cast("long")) for h in hashes])).alias("bit")).groupBy((F.col("bit") / 32).cast("int").alias("word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("mask")).toPandas()
    mask = np.zeros(bits // 32, np.uint32)
    mask[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).astype(np.uint32)
    return mask


def maybe_held(mask: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each row's hashes; a single 64-bit hash counts with its low and its high half."""
    keep = np.ones(len(hashes[0]), bool)
    for x in hashes if len(hashes) > 1 else (hashes[0], hashes[0] >> np.uint64(32)):
        at = (x & np.uint64(32 * len(mask) - 1)).astype(np.int64)
        keep &= (mask[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
    return keep


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key may be one of wanted's, and no other row that a filter of bounded size can tell apart.

    It keeps texts out of a shuffle before a join on the key; the join decides.
    """
    own = F.xxhash64(F.col(key).cast("long"))
    shared = rows.sparkSession.sparkContext.broadcast(hash_filter(wanted, own, F.shiftrightunsigned(own, 32)))
    inner = unused(rows.columns, "key_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != inner]
            yield batch.filter(pa.array(maybe_held(shared.value, batch.column(inner).to_numpy().view(np.uint64)))).select(names)

    return mapped(rows.withColumn(inner, own), run, rows.schema)


def unused(columns: list[str], name: str) -> str:
    """A column name that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
