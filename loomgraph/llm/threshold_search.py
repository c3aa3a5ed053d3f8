"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are indexed in shards: for each dimension a list of the shard's vectors in the order of that component. A query reads every list from the end that
its own component's sign prefers, deeper round by round, and scores each vector it meets in full. No vector that it hasn't met can score more than
the sum of its components times those now read; once this bound is below the kth score so far (not equal: an equal score
with a smaller id would win), the rest of the shard is left unread. Shards of a task follow one another, so the kth score of the ones before counts too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.store import mapped


SHARD = 8192
#: Queries that one pass over the candidates takes along, at most; larger query sets take several passes.
QUERIES = 100_000
FOUND = "query_id long, query long, own long, vec_id long, score long"


class Shard:
    """Sorted lists of the components of some vectors, which come in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rising = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)
        self.dense = self.vectors.astype(np.float64)
        self.most = np.abs(self.dense).max(axis=0, initial=0.0)

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of (ids, scores) and this shard's vectors."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        small = float(np.abs(query.astype(np.float64)) @ self.most) < 1 << 52  # every sum of products is then exact as a float
        vectors, q = (self.dense, query.astype(np.float64)) if small else (self.vectors, query)
        seen = np.zeros(n, bool)
        falls = query[dims] > 0
        down, up = dims[falls], dims[~falls]
        depth, step = 0, 256
        while depth < n:
            to = min(n, depth + step)
            new = np.zeros(n, bool)
            if len(dims):
                new[self.rising[down, n - to : n - depth]] = True
                new[self.rising[up, depth:to]] = True
            else:
                new[:], to = True, n
            met = np.flatnonzero(new & ~seen)
            seen |= new
            ids, scores = np.concatenate([ids, self.ids[met]]), np.concatenate([scores, (vectors[met] @ q).astype(np.int64)])
            if len(scores) > 64:  # only what can be among the best is sorted
                least = np.partition(scores, -k)[-k]
                ids, scores = ids[scores >= least], scores[scores >= least]
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if to < n and len(ids) == k:
                last = np.where(falls, self.rising[dims, n - to], self.rising[dims, to - 1])
                if int((self.vectors[last, dims] * query[dims]).sum()) < scores[-1]:
                    break
            if seen.all():
                break
            depth, step = to, step * 2
        return ids, scores


def _arrays(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, shorter ones filled up with zeros."""
    column = batch.column("v")
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), dims), np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), at] = column.flatten().to_numpy()
    return batch.column("vec_id").to_numpy(), out


def threshold_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with every row but its own, ties to the smaller vec_id.

    Components become floor(scale * x). Rows with a null id, or a vector that is null or holds null or non-finite components, take no part; shorter
    vectors count as filled up with zeros. Rows that repeat an id and vector are candidates each, also of one another, and one query; rows that share an id only are queries of
    their own. Scores are exact while they fit 64 bits. Other columns are not read. Queries go in blocks of a bounded size
    to every task; candidates stay where they are read.
    """

    def clean(rows: DataFrame) -> DataFrame:
        finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        rows = rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(finite)
        return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))

    spark = vectors.sparkSession
    candidates, asked = clean(vectors), clean(queries).dropDuplicates(["vec_id", "v"])
    dims = candidates.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    blocks = max(1, -(-asked.count() // QUERIES))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)) == block).toArrow()
        own = [_arrays(b, max(dims, 1)) for b in rows.to_batches() if b.num_rows]
        queries_ = spark.sparkContext.broadcast((np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])) if own else (np.zeros(0, np.int64), np.zeros((0, max(dims, 1)), np.int64)))

        def run(batches: Iterator[pa.RecordBatch], shared=queries_, first=block * QUERIES * 64) -> Iterator[pa.RecordBatch]:
            query_ids, query_vectors = shared.value
            query_numbers = np.arange(len(query_ids)) + first
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)
            ids, vecs, held = [], [], 0

            def search() -> None:
                shard = Shard(np.concatenate(ids), np.concatenate(vecs))
                for i, query in enumerate(query_vectors):
                    best[i] = shard.top(query, k + 1, *best[i])  # the query's own row is among them, or worse than these

            for batch in batches:
                for a in range(0, batch.num_rows, SHARD):
                    i, v = _arrays(batch.slice(a, SHARD), max(dims, 1))
                    ids.append(i)
                    vecs.append(v)
                    held += len(i)
                    if held >= SHARD:
                        search()
                        ids, vecs, held = [], [], 0
            if held:
                search()
            count = [len(i) for i, _ in best]
            if sum(count):
                own = (query_vectors * query_vectors).sum(axis=1)
                columns = [*(np.repeat(c, count) for c in (query_ids, query_numbers, own)), np.concatenate([i for i, _ in best]), np.concatenate([s for _, s in best])]
                yield pa.record_batch([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

        found = candidates.transform(mapped, run, FOUND)
        out = found if out is None else out.unionByName(found)
    best = lambda *by: F.row_number().over(Window.partitionBy("query", *by).orderBy(F.desc("score"), "vec_id"))
    is_own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    other = out.repartition("query").withColumn("is_own", is_own).withColumn("copy", best("is_own")).filter("not (is_own and copy = 1)")
    return other.withColumn("rank", best()).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
