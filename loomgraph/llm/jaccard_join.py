"""Exact Jaccard self-join in metric space.

Jaccard distance is a metric on sets, so regions around pivots can be joined on their own once they hold the documents of their boundary.
Equal sets are one point from the start. Then:

1. *Outlying points leave.* A point links only if at most a fifth of its shingles are missing from its partner. A fixed part of the hash
   space (``SHARE``) is counted over all documents, and a point with more singletons there than that can have no link.
2. *Root regions.* Each shingle s is a pivot {s}: a point of n shingles lies at 1 - 1/n from the pivots it holds and at 1 from the others. It
   goes to its rarest pivots, as many as a linked point could miss and one more, so two linked points meet in a region. Regions that
   share points are one region; what is left in it is a family of near copies.
3. *Voronoi regions.* In a region over the cap some documents become pivots. A point belongs to its nearest pivot and is copied into each region
   whose pivot is at most 2 * (1 - threshold) farther, which the triangle inequality shows to be enough for any partner. A pair
   counts in the lower of its two home regions only. Regions that pivots no longer divide are cut into blocks, and blocks are joined in pairs.
4. Inside a task a region is divided in the same way down to leaves, where intersections are counted exactly.

Documents with null ids take no part in links and come back with a null class; null, empty and wordless texts have no shingles and link
with nothing; repeated rows are copies of one point. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.components import components
from loomgraph.llm.store import BLOB, blob_batch, blobs, buckets_for, mapped, maybe_in, per_bucket, saved, top_bits, unblob

#: Sixteenths of the hash space in which singletons are counted.
SHARE = 5
POINT = np.dtype([("h", "<u8"), ("d", "<i8")])
SIZED = np.dtype([("h", "<u8"), ("d", "<i8"), ("n", "<i4"), ("df", "<i4")])
COUNT = np.dtype([("d", "<i8"), ("c", "<i4")])
KINDS = "bucket int, kind int, data binary"
LEAF = 512
PIVOTS = 12


def in_share(h: np.ndarray) -> np.ndarray:
    """A part of the hash space that is spread evenly over the buckets."""
    return (h & np.uint64(15)) < np.uint64(SHARE)


def point_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingle hashes, where each text's begin, and each text's point id."""
    w = tx.words(column)
    h, at = tx.sets(*tx.shingles(w.hash, w.first, k))
    return h, at, tx.set_ids(h, at)


def _meta(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tx.strings(batch.column(1))
        for a, b in tx.slices(texts):
            h, at, ids = point_sets(texts.slice(a, b - a), k)
            inside = tx.sums(in_share(h).astype(np.int64), at)
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(inside), pa.array(ids)], ["doc_id", "n", "inside", "node"])


def _share_points(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Shingles of the shared part, by bucket (kind 0). Those that two points of a slice hold are counted for these points here (kind 1), and only one record without
    a point travels for them, so a shingle of very many documents sends one record a slice."""
    for batch in batches:
        texts = tx.strings(batch.column(1))
        for a, b in tx.slices(texts, 4 << 20):
            h, at, ids = point_sets(texts.slice(a, b - a), k)
            once = np.zeros(len(ids), bool)
            once[np.unique(ids, return_index=True)[1]] = True  # copies in a slice travel once
            keep = in_share(h) & np.repeat(once, np.diff(at))
            out = np.empty(int(keep.sum()), POINT)
            out["h"], out["d"] = h[keep], np.repeat(ids, np.diff(at))[keep]
            out = out[np.argsort(out["h"], kind="stable")]
            new = np.concatenate(([True], out["h"][1:] != out["h"][:-1])) if len(out) else np.zeros(0, bool)
            alone = new & np.append(new[1:], True)
            shared_by, count = np.unique(out["d"][~alone], return_counts=True)
            out["d"][new & ~alone] = 0  # the id of no point
            out = out[new]
            ids0, data0 = blobs(top_bits(out["h"], buckets), out)
            ids1, data1 = _count_blobs(shared_by, count, buckets)
            yield pa.record_batch([pa.array(ids0 + ids1, pa.int32()), pa.array([0] * len(ids0) + [1] * len(ids1), pa.int32()), pa.array(data0 + data1, pa.binary())], ["bucket", "kind", "data"])


def _count_blobs(node: np.ndarray, count: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    out = np.empty(len(node), COUNT)
    out["d"], out["c"] = node, count
    where = top_bits(tx.mix(np.ascontiguousarray(node).view(np.uint64)), buckets)
    order = np.argsort(where, kind="stable")
    return blobs(where[order], out[order])


def _runs(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by (h, d) without repeats, and the number of points of each record's shingle."""
    rec = rec[np.lexsort((rec["d"], rec["h"]))]
    if len(rec):
        rec = rec[np.concatenate(([True], (rec["h"][1:] != rec["h"][:-1]) | (rec["d"][1:] != rec["d"][:-1])))]
    edge = np.flatnonzero(np.concatenate(([True], rec["h"][1:] != rec["h"][:-1], [True]))) if len(rec) else np.zeros(1, np.int64)
    size = np.diff(edge)
    return rec, np.repeat(size, size)


def _shared(table: pa.Table, buckets: int) -> pa.Table:
    """How many of a bucket's shingles each point shares with another one, and what was counted before, sent to the buckets of the points.

    A point whose copies lie in several slices can be counted more than once for a shingle; that only lets it stay.
    """
    kind = table.column("kind").to_numpy()
    rec, df = _runs(unblob(table.filter(pa.array(kind == 0)), POINT))
    node, count = np.unique(rec["d"][(df > 1) & (rec["d"] != 0)], return_counts=True)
    known = unblob(table.filter(pa.array(kind == 1)), COUNT)
    ids, data = _count_blobs(np.concatenate([node, known["d"]]), np.concatenate([count, known["c"]]), buckets)
    return pa.table({"bucket": pa.array(ids, pa.int32()), "data": pa.array(data, pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    rec = unblob(table, COUNT)
    node, back = np.unique(rec["d"], return_inverse=True)
    return pa.table({"node": node, "shared": np.bincount(back, rec["c"], len(node)).astype(np.int64)})


def _survivor_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tx.strings(batch.column("text"))
        want, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
        for a, b in tx.slices(texts):
            h, at, ids = point_sets(texts.slice(a, b - a), k)
            own = np.flatnonzero(ids == want[a:b])  # rows with a repeated id can hold another text
            data = [h[at[i] : at[i + 1]].tobytes() for i in own]
            yield pa.record_batch([pa.array(ids[own]), pa.array(np.diff(at)[own].astype(np.int32)), pa.array(copies[a:b][own]), pa.array(data, pa.binary())], ["node", "n", "copies", "hashes"])


def _scatter_sets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n").to_numpy()
        at = 0
        while at < len(n):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(n[at:]), 1 << 19, "right")))
            h = unblob(batch.slice(at, to - at), np.dtype("<u8"), "hashes")
            out = np.zeros(len(h), SIZED)
            out["h"], out["d"], out["n"] = h, np.repeat(batch.column("node").to_numpy()[at:to], n[at:to]), np.repeat(n[at:to], n[at:to])
            out = out[np.argsort(out["h"], kind="stable")]
            yield blob_batch(top_bits(out["h"], buckets), out)
            at = to


def _frequencies(table: pa.Table, buckets: int) -> pa.Table:
    """Postings of shingles that two points share, sent to the buckets of their points."""
    rec, df = _runs(unblob(table, SIZED))
    rec = rec[df > 1]
    rec["df"] = df[df > 1]
    where = top_bits(tx.mix(rec["d"].view(np.uint64)), buckets)
    order = np.argsort(where, kind="stable")
    return pa.Table.from_batches([blob_batch(where[order], rec[order])])


def _rarest(table: pa.Table, buckets: int) -> pa.Table:
    """The pivots {s} of each point: of its floor(n/5)+1 rarest shingles those that another point holds too."""
    rec = unblob(table, SIZED)
    rec = rec[np.lexsort((rec["h"], rec["df"], rec["d"]))]
    edge = np.flatnonzero(np.concatenate(([True], rec["d"][1:] != rec["d"][:-1], [True]))) if len(rec) else np.zeros(1, np.int64)
    size = np.diff(edge)
    n = rec["n"][edge[:-1]]
    need = n // 5 + 1 - (n - size)  # shingles of one point come first
    rank = np.arange(len(rec)) - np.repeat(edge[:-1], size)
    out = rec[rank < np.repeat(need, size)]
    out = out[np.argsort(out["h"], kind="stable")]
    return pa.Table.from_batches([blob_batch(top_bits(out["h"], buckets), out)])


def _region_edges(table: pa.Table) -> pa.Table:
    """A star for each root region."""
    rec, df = _runs(unblob(table, SIZED))
    first = np.concatenate(([True], rec["h"][1:] != rec["h"][:-1])) if len(rec) else np.zeros(0, bool)
    lead = rec["d"][np.maximum.accumulate(np.where(first, np.arange(len(rec)), 0))] if len(rec) else rec["d"]
    pairs = np.unique(np.stack([lead[~first], rec["d"][~first]]), axis=1) if len(rec) else np.zeros((2, 0), np.int64)
    return pa.table({"a": pairs[0], "b": pairs[1]})


# --- inside a task -------------------------------------------------------------------------------------------------------------------


class Region:
    """Points of a region: ``flat`` shingle numbers by point, ``at`` where each begins, ``n`` sizes."""

    def __init__(self, hashes: list[np.ndarray]):
        self.n = np.array([len(h) for h in hashes], np.int64)
        self.at = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(self.n, out=self.at[1:])
        self.flat = np.unique(np.concatenate(hashes), return_inverse=True)[1].astype(np.int64) if hashes else np.zeros(0, np.int64)

    def part(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[members]
        at = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=at[1:])
        where = np.arange(at[-1]) + np.repeat(self.at[members] - at[:-1], n)
        return self.flat[where], at

    def distances(self, members: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        flat, at = self.part(members)
        top = int(self.flat.max()) + 1
        out = np.empty((len(members), len(pivots)))
        for j, p in enumerate(pivots):
            own = np.zeros(top, bool)
            own[self.flat[self.at[p] : self.at[p + 1]]] = True
            both = tx.sums(own[flat].astype(np.int64), at)
            out[:, j] = 1 - both / (self.n[members] + self.n[p] - both)
        return out

    def common(self, members: np.ndarray) -> np.ndarray:
        """Sizes of all intersections of the members."""
        flat, at = self.part(members)
        m = len(members)
        doc = np.repeat(np.arange(m), np.diff(at))
        order = np.argsort(flat, kind="stable")
        token, doc_of = flat[order], doc[order]
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        df = np.diff(edge)
        out = np.zeros((m, m), np.float32)
        frequent = np.flatnonzero(df > max(8, m // 4))
        width = max(1, (2 << 20) // m)
        for a in range(0, len(frequent), width):  # frequent shingles: a dense product
            some = frequent[a : a + width]
            dense = np.zeros((m, len(some)), np.float32)
            for j, t in enumerate(some):
                dense[doc_of[edge[t] : edge[t + 1]], j] = 1
            out += dense @ dense.T
        rare = np.flatnonzero((df > 1) & (df <= max(8, m // 4)))
        count = df[rare]
        start = np.cumsum(count) - count
        docs = doc_of[np.repeat(edge[rare] - start, count) + np.arange(count.sum())] if len(rare) else np.zeros(0, np.int64)
        block = np.repeat(np.arange(len(rare)), count)
        by_doc = np.argsort(docs, kind="stable")
        cut = np.searchsorted(docs[by_doc], np.arange(m + 1))
        for i in range(m):  # the others: the postings of each point
            mine = block[by_doc[cut[i] : cut[i + 1]]]
            if len(mine):
                c = count[mine]
                end = np.cumsum(c)
                out[i] += np.bincount(docs[np.repeat(start[mine] - (end - c), c) + np.arange(end[-1])], minlength=m)
        return out

    def links(self, members: np.ndarray, percent: int) -> np.ndarray:
        """Packed pairs (smaller member first) of linked members."""
        m = len(members)
        if m < 2:
            return np.zeros(0, np.int64)
        if m > LEAF:
            radius = 2 * (1 - percent / 100)
            pivots = [members[0]]
            dist = self.distances(members, np.array(pivots))
            for _ in range(PIVOTS - 1):  # farthest first
                pivots.append(members[int(dist.min(axis=1).argmax())])
                dist = np.hstack([dist, self.distances(members, np.array(pivots[-1:]))])
            near = dist.min(axis=1)
            home = dist.argmin(axis=1)
            regions = [np.flatnonzero(dist[:, j] <= near + radius + 1e-9) for j in range(len(pivots)) if (home == j).any()]
            if sum(len(r) ** 2 for r in regions) < 0.7 * m * m:
                return np.unique(np.concatenate([self.links(members[r], percent) for r in regions]))
        common, n, found = self.common(members), self.n[members], []
        for s in range(0, m, 256):  # some rows at a time, so that only the sizes of the intersections stand in memory whole
            both = common[s : s + 256, s + 1 :].astype(np.int64)
            i, j = np.nonzero(100 * both >= percent * (n[s : s + 256, None] + n[None, s + 1 :] - both))
            above = j >= i
            a, b = members[s + i[above]], members[s + 1 + j[above]]
            found.append(np.minimum(a, b) << 32 | np.maximum(a, b))
        return np.sort(np.concatenate(found))


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of m points."""
    root = np.arange(m)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def join_regions(table: pa.Table, percent: int) -> pa.Table:
    """Links of some whole regions: for each of their points its root there and how many documents it links with.

    Columns: region, node, copies, hashes, home (-1, or the Voronoi region at home), own (this region's number) and side (-1, or 0 and 1
    for two blocks of which only pairs across are meant).
    """
    region = table.column("region").to_numpy()
    order = np.lexsort((table.column("node").to_numpy(), region))
    table = table.take(pa.array(order))
    region, node, copies = (table.column(c).to_numpy() for c in ("region", "node", "copies"))
    home, own, side = (table.column(c).to_numpy() for c in ("home", "own", "side"))
    hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("hashes")]
    out = {"node": [], "root": [], "links": []}
    edge = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True]))) if len(region) else []
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        pairs = Region(hashes[s:e]).links(np.arange(e - s), percent)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        h, w, d = home[s:e], own[s:e], side[s:e]
        keep = ((h[a] < 0) | (np.minimum(h[a], h[b]) == w[a])) & ((d[a] < 0) | (d[a] != d[b]))
        a, b = a[keep], b[keep]
        links = np.bincount(a, copies[s:e][b], e - s) + np.bincount(b, copies[s:e][a], e - s)
        out["node"].append(node[s:e])
        out["root"].append(node[s:e][_roots(e - s, a, b)])
        out["links"].append(links.astype(np.int64))
    return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})


REGION = "region long, node long, n int, copies long, hashes binary, home int, own int, side int"


def _voronoi(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each point of an oversized region: into the region of its nearest pivot, and into those it is near the boundary of."""
    for batch in batches:
        rows = {k: [] for k in ("region", "node", "n", "copies", "hashes", "home", "own", "side")}
        for r in batch.to_pylist():
            mine = np.frombuffer(r["hashes"], "<u8")
            dist = []
            for p in r["pivots"]:
                both = np.isin(mine, np.frombuffer(p["hashes"], "<u8"), assume_unique=True).sum()
                dist.append(1 - both / (len(mine) + len(p["hashes"]) // 8 - both))
            home = int(np.argmin(dist))
            for j in np.flatnonzero(np.array(dist) <= min(dist) + 2 * (1 - percent / 100) + 1e-9).tolist():
                key = tx.mix(np.array([r["region"]]).view(np.uint64) + np.uint64(j + 1)).view(np.int64)[0]
                for k, v in (("region", key), ("node", r["node"]), ("n", r["n"]), ("copies", r["copies"]), ("hashes", r["hashes"]), ("home", home), ("own", j), ("side", -1)):
                    rows[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))


def _by_size(points: DataFrame, cap: int, cap_shingles: int) -> tuple[DataFrame, DataFrame, int]:
    """Points of regions that one task can join, points of the others, and how many regions the others are."""
    size = saved(points.groupBy("region").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("t")).filter((F.col("m") > cap) | (F.col("t") > cap_shingles)), "oversized")
    n = size.count()
    return points.join(size, "region", "left_anti"), points.join(size, "region"), n


def _divide(points: DataFrame, percent: int) -> DataFrame:
    tries = [F.min(F.struct(F.xxhash64("node", F.lit(j)), "node")).getField("node").alias(f"p{j}") for j in range(PIVOTS)]
    chosen = points.groupBy("region").agg(*tries).select("region", F.explode(F.array_distinct(F.array(*[f"p{j}" for j in range(PIVOTS)]))).alias("node"))
    pivots = chosen.join(points.select("region", "node", "hashes"), ["region", "node"]).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("node", "hashes"))).alias("pivots"))
    return points.select("region", "node", "n", "copies", "hashes").join(pivots, "region").transform(mapped, _voronoi, REGION, percent=percent)


def _blocks(points: DataFrame, cap: int, cap_shingles: int) -> DataFrame:
    """Every pair of blocks of an oversized region as a region of its own."""
    n = F.ceil(F.greatest(F.col("m") / F.lit(cap / 2), F.col("t") / F.lit(cap_shingles / 2))).cast("int")
    cut = points.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    pair = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return pair.select(
        F.xxhash64("region", low, high).alias("region"), "node", "n", "copies", "hashes", "home", "own",
        F.when(F.col("block") == F.col("other"), -1).when(F.col("block") == low, 0).otherwise(1).cast("int").alias("side"),
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, cap: int = 4096, cap_shingles: int = 4 << 20) -> DataFrame:
    """Links every two documents whose sets of word k-shingles have a Jaccard similarity of at least percent/100.

    Returns one row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included; null for a null
    id) and n_links (other documents it links with, copies included; 0 without shingles). ``percent`` must be at least 80. No link is lost
    at any size of a group: ``cap`` points and ``cap_shingles`` only say when a region is divided further.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    meta = saved(rows.transform(mapped, _meta, "doc_id long, n long, inside long, node long", k=k), "points")
    nodes = meta.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("inside").alias("inside"))

    total = meta.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    b = buckets_for(total * SHARE / 16 * POINT.itemsize)
    postings = rows.filter("doc_id is not null").transform(mapped, _share_points, KINDS, k=k, buckets=b)
    shared = per_bucket(per_bucket(postings, _shared, BLOB, buckets=b), _summed, "node long, shared long")
    near = saved(nodes.join(shared, "node", "left").filter("inside - coalesce(shared, 0) <= n div 5"), "near")

    wanted = near.select(F.col("rep").alias("doc_id"), "node", "copies")
    found = wanted.join(maybe_in(rows, wanted), "doc_id").select("node", "copies", "text")
    sets = saved(found.transform(mapped, _survivor_sets, "node long, n int, copies long, hashes binary", k=k).dropDuplicates(["node"]), "sets")
    left = sets.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()[0]
    b = buckets_for(left * SIZED.itemsize)
    by_shingle = sets.transform(mapped, _scatter_sets, BLOB, buckets=b)
    by_point = per_bucket(by_shingle, _frequencies, BLOB, buckets=b)
    by_pivot = per_bucket(by_point, _rarest, BLOB, buckets=b)
    edges = per_bucket(by_pivot, _region_edges, "a long, b long")
    family = components(edges)
    points = sets.join(family, "node").select(F.col("root").alias("region"), "node", "n", "copies", "hashes", *(F.lit(-1).alias(c) for c in ("home", "own", "side")))
    small, big, oversized = _by_size(points, cap, cap_shingles)
    if oversized:
        small2, big2, still = _by_size(saved(_divide(big, percent), "regions"), cap, cap_shingles)
        small = small.unionByName(small2)
        if still:
            small = small.unionByName(_blocks(big2, cap, cap_shingles))
    tasks = max(1, buckets_for(left * 8, 1) * 2)
    joined = saved(per_bucket(small.withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(tasks))), join_regions, "node long, root long, links long", percent=percent), "links")
    if oversized:
        links = joined.groupBy("node").agg(F.sum("links").alias("links"))
        ends = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))
        joined = links.join(ends, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "links")
    reps = joined.join(near.select("node", "rep", "copies"), "node")
    lowest = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = nodes.select("node", "rep", "copies").join(reps.join(lowest, "root").select("node", "component_id", "links"), "node", "left")
    classes = classes.select("node", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = meta.join(classes, "node", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull() | alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("doc_id").isNull() | alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
    )
