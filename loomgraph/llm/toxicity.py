"""Toxicity: a factorization machine over hashed terms.

Terms are the words without the ASCII punctuation around them, and the first 4 to 7 bytes of longer words, so inflected forms of a stem share a
term. Each term is a bucket of 2**18. Counts of all buckets in the fitted texts, by label, choose the ``TERMS`` buckets that
tell most of the label; the machine then learns a weight for each and a vector of ``RANK`` factors, whose products score pairs of terms.

Training is distributed: each task takes Adagrad steps over its own labelled texts, and the tasks' models are averaged round by round. Only
the model (TERMS * (RANK + 1) numbers) passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.store import mapped, per_bucket, saved

BUCKETS = 1 << 18
TERMS = 2048
RANK = 8
ROUNDS = 10
#: Labelled texts to fit on, at most about so many.
FIT_ROWS = 40_000
PREFIXES = (4, 5, 6, 7)
MARK = np.zeros(256, bool)
MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
PARTS = 64


def terms(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct term buckets of each text of a large_string array without nulls, where each text's begin, and how many words it has.

    ``wanted`` marks the buckets of interest; others are left out before anything is sorted.
    """
    w = tx.words(column)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        start += MARK[w.data[start]] & (end - start > 1) if len(start) else 0
        end -= MARK[w.data[end - 1]] & (end - start > 1) if len(end) else 0
    text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    keys = []

    def add(h: np.ndarray, owner: np.ndarray) -> None:
        bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
        if wanted is not None:
            keep = wanted[bucket]
            bucket, owner = bucket[keep], owner[keep]
        keys.append(owner << 18 | bucket)

    add(tx.word_hashes(w.data, start, end), text_of)
    for p in PREFIXES:
        long = end - start > p
        add(tx.mix(tx.word_hashes(w.data, start[long], start[long] + p) + np.uint64(p)), text_of[long])
    key = np.unique(np.concatenate(keys))
    at = np.searchsorted(key, np.arange(len(w.first)) << 18)
    return key & (BUCKETS - 1), at, np.diff(w.first)


def marked(*machines: Machine) -> np.ndarray:
    """The buckets that some machines look at."""
    out = np.zeros(BUCKETS, bool)
    for m in machines:
        out[m.buckets] = True
    return out


def _term_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("terms")]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=at[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)).astype(np.int64), at


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold each bucket, one blob for each part of the buckets."""
    count = np.zeros((2, BUCKETS), np.int64)
    size = np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        t, at = _term_sets(batch)
        count += np.bincount(np.repeat(label, np.diff(at)) * BUCKETS + t, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        size += np.bincount(label, minlength=2)
    if size.any():
        width = BUCKETS // PARTS
        data = [np.concatenate([size, count[:, i * width : (i + 1) * width].ravel()]).tobytes() for i in range(PARTS)]
        yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def _best_terms(table: pa.Table, most: int) -> pa.Table:
    """The terms of a part with the highest chi-square, taken for positive and negative association alike."""
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("data"))
    size, count = total[:2].astype(float), total[2:].reshape(2, -1).astype(float)
    held, n = count.sum(axis=0), size.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = count[1] * (size[0] - count[0]) - count[0] * (size[1] - count[1])
        score = np.nan_to_num(n * gap**2 / (size[0] * size[1] * held * (n - held)))
    best = np.argsort(-score, kind="stable")[:most]
    best = best[(score[best] > 12) & (held[best] >= 3)]
    part = table.column("bucket")[0].as_py()
    return pa.table({"term": best + part * (BUCKETS // PARTS), "score": score[best]})


def chosen_terms(labelled: DataFrame, most: int = TERMS) -> np.ndarray:
    """Sorted buckets with the highest chi-square over all rows (label, terms); a chi-square of 12 and three texts are needed."""
    counts = labelled.transform(mapped, _bucket_counts, "bucket int, data binary")
    best = per_bucket(counts, _best_terms, "term long, score double", most=most).orderBy(F.desc("score"), "term").limit(most)
    return np.array(sorted(r["term"] for r in best.collect()), np.int64)


class Machine:
    """score = sigmoid(bias + sum w_i + sum of products of the vectors of each two terms that a text holds)."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray | None = None):
        self.buckets = buckets
        m = len(buckets)
        if weights is None:
            weights = np.zeros((m + 1, RANK + 1), np.float32)
            weights[:m, 1:] = np.random.default_rng(7).normal(0, 0.02, (m, RANK))
        self.weights = weights  # float32; the last row has the bias

    def lookup(self, t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the chosen terms among a text's terms."""
        where = np.searchsorted(self.buckets, t)
        ok = where < len(self.buckets)
        ok[ok] = self.buckets[where[ok]] == t[ok]
        edge = np.zeros(len(t) + 1, np.int64)
        np.cumsum(ok, out=edge[1:])
        return where[ok], edge[at]

    def margin(self, i: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.weights[i]
        run = np.zeros((len(i) + 1, RANK + 1))
        np.cumsum(rows, axis=0, out=run[1:])
        total = run[at[1:]] - run[at[:-1]]
        own = np.zeros(len(i) + 1)
        np.cumsum((rows[:, 1:] ** 2).sum(axis=1), out=own[1:])
        return self.weights[-1, 0] + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - (own[at[1:]] - own[at[:-1]])), total[:, 1:]

    def scores(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(i, at)[0], -30, 30)))

    def step(self, i: np.ndarray, at: np.ndarray, label: np.ndarray, seen: np.ndarray, rate: float, decay: float) -> None:
        """An Adagrad step over a few texts, as products of matrices: texts by terms, with a last column of ones for the bias."""
        held = np.zeros((len(label), len(self.weights)), np.float32)
        held[np.repeat(np.arange(len(label)), np.diff(at)), i] = 1
        held[:, -1] = 1
        w = self.weights
        total = held @ w
        own = held @ (w[:, 1:] ** 2).sum(axis=1)
        margin = total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - own)
        slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / len(label)).astype(np.float32)
        each = slope[:, None] * total
        each[:, 0] = slope
        g = held.T @ each
        g[:, 1:] -= g[:, :1] * w[:, 1:]
        g[-1, 1:] = 0  # the bias has no factors
        g[:-1] += decay * w[:-1]
        seen += g**2
        w -= rate * g / np.sqrt(seen + 1e-8)


def _terms_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` and the terms of each text."""
    for batch in batches:
        texts = tx.strings(batch.column("text"))
        for a, b in tx.slices(texts):
            t, at, _ = terms(texts.slice(a, b - a))
            data = [t[s:e].astype(np.int32).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(a, b - a) for n in names], pa.array(data, pa.binary())], [*names, "terms"])


def _round(batches: Iterator[pa.RecordBatch], buckets: np.ndarray, weights: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
    """Some passes over a task's labelled texts from the common model; gives its model and how many texts it is from."""
    label, data = [], []
    machine, seen = Machine(buckets, weights.copy()), np.full(weights.shape, 1e-4, np.float32)
    for batch in batches:
        label += batch.column("label").to_pylist()
        i, at = machine.lookup(*_term_sets(batch))
        data += np.split(i, at[1:-1])
    if not label:
        return
    y = np.array(label, float)
    order = np.random.default_rng(turn)
    for _ in range(3):
        for some in np.array_split(order.permutation(len(y)), max(1, len(y) // 64)):
            at = np.zeros(len(some) + 1, np.int64)
            np.cumsum([len(data[x]) for x in some], out=at[1:])
            machine.step(np.concatenate([data[x] for x in some]), at, y[some], seen, 0.1, 1e-5)
    yield pa.record_batch([pa.array([len(y)], pa.int64()), pa.array([machine.weights.tobytes()], pa.binary())], ["n", "model"])


def fit(labelled: DataFrame, terms_most: int = TERMS, rounds: int = ROUNDS) -> Machine:
    """A machine from rows (label 0 or 1, terms); rows with other labels are left out. Without both labels it scores every text alike."""
    labelled = labelled.select(F.col("label").cast("int").alias("label"), "terms").filter("label in (0, 1)")
    size = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        machine = Machine(np.zeros(0, np.int64))
        machine.weights[-1, 0] = 3.0 if 1 in size else -3.0
        return machine
    buckets = chosen_terms(labelled, terms_most)
    machine = Machine(buckets)
    machine.weights[-1, 0] = np.log(size[1] / size[0])
    for turn in range(rounds):
        models = labelled.transform(mapped, _round, "n long, model binary", buckets=buckets, weights=machine.weights, turn=turn).collect()
        n = sum(m["n"] for m in models)
        machine = Machine(buckets, sum(np.frombuffer(m["model"], np.float32).reshape(machine.weights.shape) * np.float32(m["n"] / n) for m in models))
    return machine


def _score(batches: Iterator[pa.RecordBatch], buckets: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The last column of each batch is the text; it becomes the score."""
    machine = Machine(buckets, weights)
    wanted = marked(machine)
    for batch in batches:
        texts = tx.strings(batch.columns[-1])
        score = np.empty(batch.num_rows)
        for a, b in tx.slices(texts):
            t, at, _ = terms(texts.slice(a, b - a), wanted)
            score[a:b] = machine.scores(*machine.lookup(t, at))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], batch.schema.names)


def score(docs: DataFrame, machine: Machine, keep: list[str], text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """The columns ``keep`` of every row of docs and their score, from 0 to 1, in a column ``name`` that isn't one of them; a null or empty text has the score of no terms. No shuffle."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(name))
    return rows.transform(mapped, _score, docs.select(*keep).schema.add(name, "double"), buckets=machine.buckets, weights=machine.weights)


def labelled_terms(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic, quality, terms) of labelled documents, without those that are held out (crc32 of doc_id's text divisible by 5).

    At most about fit_rows of them, those with the lowest hashes of doc_id: that bounds what is broadcast to find their texts, which stay where
    they are read. Of a doc_id's labels the highest toxic and the lowest quality count; rows with a null doc_id are left out.
    """
    own = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), F.min("quality").cast("int").alias("quality"))
    own = own.filter(~is_held_out("doc_id", 0))
    share = min(1.0, fit_rows / max(1, own.count()))
    own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id")
    names = ["doc_id", "toxic", "quality"]
    found = texts.transform(mapped, _terms_of, "doc_id long, toxic int, quality int, terms binary", names=names)
    return saved(found.repartition(8, "doc_id"), "terms")


def toxic_machine(rows: DataFrame) -> Machine:
    return fit(rows.select(F.col("toxic").alias("label"), "terms"))


def is_held_out(column: str, remainder: int):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) of every row of docs; labels, lang, source and doc_id are no inputs of a score."""
    machine = toxic_machine(labelled_terms(docs, labels))
    out = score(docs.select("doc_id", "text"), machine, ["doc_id"])
    return out.select("doc_id", is_held_out("doc_id", 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
