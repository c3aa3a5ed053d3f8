"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed part (1/SHARE) of the hash space, for documents of every length alike: a longer document has a longer sketch, and two
sketches can be merged or compared over the same hashes, however unequal the documents are. A set of shingles of which none is below the limit is kept as one hash of the
whole set, so equal texts have equal and non-empty sketches. A fingerprint is the sketch in base64, the upper BYTES bytes of each hash, ascending; that of a text without shingles is empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.store import mapped

#: One of so many shingle hashes is kept.
SHARE = 2
LIMIT = np.uint64((1 << 64) // SHARE)
#: Bytes of a hash that are kept; two shingles of one text or pair have the same with a chance of one in 2 ** 40.
BYTES = 5
K = 5
#: Ranges of doc_id, at most; they grow beyond.
RANGES = 1 << 14


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes -> those that are kept, their upper bytes as numbers."""
    kept = hashes[: int(np.searchsorted(hashes, LIMIT))]
    if len(hashes) and not len(kept):
        kept = tx.set_ids(hashes, np.array([0, len(hashes)])).view(np.uint64) % LIMIT
    return np.unique(kept >> np.uint64(64 - 8 * BYTES))


def compare(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimated Jaccard similarity, and the part of a that b contains; 0 where either sketch is empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both), both / max(1, len(a))


def likeness(a: str, b: str) -> tuple[float, float]:
    """The same of two fingerprints; 1 for equal ones, those of two texts without shingles too."""
    return compare(decode(a), decode(b)) if a != b else (1.0, 1.0)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two documents."""
    return np.union1d(a, b)


def encode(hashes: np.ndarray) -> str:
    """The fingerprint of a text with these sorted distinct shingle hashes."""
    return base64.b64encode(sketch(hashes).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(base64.b64decode(fingerprint or ""), np.uint8).reshape(-1, BYTES)
    return np.pad(packed, ((0, 0), (8 - BYTES, 0))).copy().view(">u8").ravel().astype(np.uint64)


def prints(texts: pa.Array) -> list[str]:
    """Fingerprints of the texts of a large_string array without nulls."""
    out = []
    for a, b in tx.slices(texts):
        w = tx.words(texts.slice(a, b - a))
        h, at = tx.sets(*tx.shingles(w.hash, w.first, K))
        out += [encode(h[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(prints(tx.strings(batch.column(1))), pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row (null text: empty); no shuffle."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(mapped, _fingerprints, "doc_id long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double"


def _edits(batches: Iterator[pa.RecordBatch], slice_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, ghost, doc_id, text) in order; each waits for the one after it, which is in its bucket, or the bucket's ghost."""
    last = None  # (doc_id, text, ghost, fingerprint) of the row that waits
    for batch in batches:
        texts = tx.strings(batch.column("text"))
        for a, b in tx.slices(texts, slice_bytes):
            own = texts.slice(a, b - a)
            new = list(zip(batch.column("doc_id").slice(a, b - a).to_pylist(), own.to_pylist(), batch.column("ghost").slice(a, b - a).to_pylist(), prints(own), strict=True))
            rows = [*([last] if last else []), *new]
            last = rows[-1]
            pairs = [(x, y) for x, y in zip(rows[:-1], rows[1:], strict=True) if not x[2]]
            if pairs:
                yield _edited(pairs)
    if last and not last[2]:
        raise RuntimeError("a bucket has no row after its last one")


def _edited(pairs: list[tuple]) -> pa.RecordBatch:
    edited = []
    for (_, text, *_), (_, after, *_) in pairs:
        cut = len(text) // 3
        edited.append(text[: len(text) - cut] + after[:cut])
    made = prints(pa.array(edited, pa.large_string()))
    near = [likeness(x[3], m) for (x, _), m in zip(pairs, made, strict=True)]
    columns = [
        pa.array([x[0] for x, _ in pairs], pa.int64()), pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([x[3] for x, _ in pairs], pa.string()), pa.array(made, pa.string()),
        pa.array([n[0] for n in near], pa.float64()), pa.array([likeness(x[3], y[3])[0] for x, y in pairs], pa.float64()), pa.array([n[1] for n in near], pa.float64()),
    ]
    return pa.record_batch(columns, [c.split()[0] for c in EDITED.split(", ")])


class Ranges:
    """Ranges of rows in the order of descending doc_id; rows without an id come last, in the order of a hash of their texts (``tie``)."""

    def __init__(self, cuts: np.ndarray, nulls: int):
        self.cuts, self.nulls = np.sort(cuts), nulls  # ids above a cut are in an earlier range

    def of(self, doc: pa.Array, tie: np.ndarray) -> np.ndarray:
        known = doc.is_valid().to_numpy(zero_copy_only=False)
        place = len(self.cuts) - np.searchsorted(self.cuts, doc.fill_null(0).to_numpy(), "left")
        unknown = len(self.cuts) + 1 + ((tie.astype(np.float64) / 2**64 + 0.5) * self.nulls).astype(np.int64).clip(0, self.nulls - 1)
        return np.where(known, place, unknown)


def _heads(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """The first key of each range: the highest id, or for rows without one the lowest tie, as -1 - tie."""
    for batch in batches:
        doc, tie = batch.column("doc_id"), batch.column("tie").to_numpy()
        key = np.where(doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), -1 - tie)
        bucket = ranges.of(doc, tie)
        order = np.lexsort((-1 - key, bucket))
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        yield pa.record_batch([pa.array(bucket[order][first].astype(np.int32)), pa.array(key[order][first])], ["bucket", "head"])


def _dealt(batches: Iterator[pa.RecordBatch], ranges: Ranges, heads: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row with its range, and the first of each range once more, as a ghost at the end of the range before."""
    for batch in batches:
        doc, tie = batch.column("doc_id"), batch.column("tie").to_numpy()
        bucket = ranges.of(doc, tie)
        key = np.where(doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), -1 - tie)
        first = np.flatnonzero(key == heads[bucket])
        for where, rows, ghost in ((bucket, batch, False), (before[bucket[first]], batch.take(pa.array(first)), True)):
            columns = [pa.array(where.astype(np.int32)), pa.array([ghost] * rows.num_rows, pa.bool_()), *(rows.column(c) for c in ("doc_id", "tie", "text"))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "ghost", "doc_id", "tie", "text"])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """Fingerprint of each whole text and of its edited text, with their likeness.

    The edited text has its last floor(n/3) code points replaced by the first as many (or all) of the next row's text, in the order of
    descending doc_id (equal ids by text; null ids last, in the order of a hash of their texts); after the last row comes the first. Rows are dealt by ranges of
    doc_id, and each range also gets the first row of the next one, so no task needs more than one range and texts are shuffled once. The cuts between ranges, one for
    ``bucket_bytes`` of text and RANGES at most, are what the driver holds. Returns one row per
    row of docs; null and empty texts have an empty fingerprint. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("tie"), "text")
    size = F.octet_length("text").cast("long")
    total, lost, n = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), size)), F.lit(0)), F.count("doc_id")).first()
    parts = max(8, -(-total // bucket_bytes))
    few = min(RANGES, 4 * parts)  # some ranges for each task, so that tasks are even
    cuts = rows.agg(F.percentile_approx("doc_id", [i / few for i in range(1, few)], 4 * few)).first()[0] if n else []
    ranges = Ranges(np.unique(np.array(cuts or [], np.int64)), min(RANGES, max(1, int(few * lost / max(1, total)))))
    found = rows.transform(mapped, _heads, "bucket int, head long", ranges=ranges)
    known = len(ranges.cuts) + 1
    top = found.groupBy("bucket").agg(F.max("head").alias("head")).collect()  # one key a range
    order = sorted(r["bucket"] for r in top)
    heads, before = np.full(known + ranges.nulls, -1, np.int64), np.zeros(known + ranges.nulls, np.int64)
    heads[[r["bucket"] for r in top]] = [r["head"] for r in top]
    before[order] = np.roll(order, 1) if order else order
    dealt = rows.transform(mapped, _dealt, "bucket int, ghost boolean, doc_id long, tie long, text string", ranges=ranges, heads=heads, before=before)
    dealt = dealt.repartition(int(parts), "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return dealt.select("bucket", "ghost", "doc_id", "text").transform(mapped, _edits, EDITED)
