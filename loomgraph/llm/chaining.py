"""Substring dedup by collinear chaining.

Seeds are word 5-mers: every one whose hash is in a fixed quarter of the hash space, so that a 5-mer that two documents share is a seed of both
whatever stands around it, and the smallest of each 16 in a row that hold no such one, so that 20 equal words always have a seed.
Each occurrence of a seed is matched with the first one (by doc_id, then place) and with the one just before it, so a passage in
a million documents gives two million matches and not the square. Occurrences in the same slice of a task are matched there, and only the first of
them travels. The matches of a document with one source are chained: the best chain of matches in the order of both texts, with a cost
for each word of gap. Matches that all rise in both texts are chained by a scan; for others a Fenwick tree of prefix maxima gives the best chain.
Chains are then aligned with the words of both texts, along the diagonals of their matches, and grown at both ends over substituted, inserted and
left out words. What is at least ``min_words`` long and agrees in 80 % of its words is a repeat.

Two partners a seed do not settle which document holds a whole passage: the seeds of a passage can have different firsts. So places that some
earlier text matches and no repeat covers are looked at again: every run of ``min_words`` words around them is joined with its first occurrence in all texts
(one row a run, whatever the number of copies). So each word of a passage of min_words or more that an earlier document, or an earlier
place, holds word for word is in a repeat, whatever the partners of its seeds and the partitions of the input. For edited passages the seeds
decide, and the partitions of the input can move the ends of such a repeat by some words.

A document without an id, or with fewer words than min_words (null and empty texts too), has no repeats and is no source. Rows that repeat a doc_id
count as one document, with all their texts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.store import blobs, buckets_for, hash_filter, mapped, maybe_held, maybe_in, per_bucket, pieces, saved, top_bits, unblob, unused

K = 5
#: Any so many 5-mers in a row have a seed among them; a 5-mer is one anyway if its hash is 0 modulo SHARE.
WINDOW = 16
SHARE = 4
MIN_WORDS = 50
#: Words that the seeds of a chain span at least.
LEAST = 10
#: Cost of a word of gap, in words of seed; and the longest gap inside a chain.
GAP_COST = 0.08
GAP = 25
REACH = 40
BLOCK = 64
AGREE = 0.8
SEED = np.dtype([("h", "<u8"), ("d", "<i8"), ("p", "<i4")])
MATCH = np.dtype([("d", "<i8"), ("s", "<i8"), ("p", "<i4"), ("q", "<i4")])
KINDS = "bucket int, kind int, data binary"


def seeds(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the seeds of texts with the k-mer hashes h, each text's from ``at`` on."""
    taken = h % np.uint64(SHARE) == 0
    n = len(h) - WINDOW + 1
    if n > 0:
        count = np.concatenate([[0], np.cumsum(taken)])
        inside = np.zeros(len(h) + 1, np.int64)
        whole = np.diff(at) >= WINDOW
        np.add.at(inside, at[:-1][whole], 1)
        np.add.at(inside, (at[1:] - WINDOW + 1)[whole], -1)
        bare = np.flatnonzero((count[WINDOW:] == count[:-WINDOW]) & (np.cumsum(inside)[:n] > 0))
        for a in range(0, len(bare), 1 << 16):
            some = bare[a : a + (1 << 16)]
            taken[some + h[some[:, None] + np.arange(WINDOW)].argmin(axis=1)] = True
    return np.flatnonzero(taken)


def _matches(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds sorted by (h, d, p) -> first of each hash, and the matches of the others with the first and with the one before."""
    if not len(rec):
        return rec, np.zeros(0, MATCH)
    new = np.concatenate(([True], rec["h"][1:] != rec["h"][:-1]))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(rec)), 0))
    i = np.flatnonzero(~new)
    source = np.concatenate([lead[i], (i - 1)[i - 1 != lead[i]]])
    own = np.concatenate([i, i[i - 1 != lead[i]]])
    out = np.empty(len(own), MATCH)
    out["d"], out["p"], out["s"], out["q"] = rec["d"][own], rec["p"][own], rec["d"][source], rec["p"][source]
    return rec[new], out[(out["d"] != out["s"]) | (out["p"] != out["q"])]


def _by_doc(match: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    where = top_bits(tx.mix(np.ascontiguousarray(match["d"]).view(np.uint64)), buckets)
    order = np.argsort(where, kind="stable")
    return where[order], match[order]


def _seeds_of(texts: pa.Array, docs: np.ndarray, min_words: int) -> np.ndarray:
    w = tx.words(texts)
    h, at = tx.shingles(w.hash, w.first, K)
    place = seeds(h, at)
    own = np.searchsorted(at, place, "right") - 1
    long = np.diff(w.first)[own] >= min_words
    place, own = place[long], own[long]
    rec = np.empty(len(place), SEED)
    rec["h"], rec["d"], rec["p"] = h[place], docs[own], place - at[own]
    return rec


def _seeds(batches: Iterator[pa.RecordBatch], buckets: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, docs = tx.strings(batch.column("text")), batch.column("doc_id").to_numpy()
        for a, b in tx.slices(texts):
            rec = _seeds_of(texts.slice(a, b - a), docs[a:b], min_words)
            first, match = _matches(rec[np.lexsort((rec["p"], rec["d"], rec["h"]))])
            ids, data = blobs(top_bits(first["h"], buckets), first)
            ids2, data2 = blobs(*_by_doc(match, buckets))
            kinds = [0] * len(ids) + [1] * len(ids2)
            yield pa.record_batch([pa.array(ids + ids2, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data + data2, pa.binary())], ["bucket", "kind", "data"])


def _join_seeds(table: pa.Table, buckets: int) -> pa.Table:
    """Matches of the seeds of a bucket, and those matched before, to the buckets of their documents."""
    kind = table.column("kind").to_numpy()
    rec = unblob(table.filter(pa.array(kind == 0)), SEED)
    _, match = _matches(rec[np.lexsort((rec["p"], rec["d"], rec["h"]))])
    ids, data = blobs(*_by_doc(np.concatenate([match, unblob(table.filter(pa.array(kind == 1)), MATCH)]), buckets))
    return pa.table({"bucket": pa.array(ids, pa.int32()), "data": pa.array(data, pa.binary())})


def chain(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Best chains of the matches (p, q) of two texts, sorted by p: each match is in one chain at most, p and q rise along a chain."""
    n = len(p)
    rank = np.unique(q, return_inverse=True)[1] + 1
    size = int(rank.max())
    tree = [(-1e18, -1)] * (size + 1)  # prefix maxima of score + cost of what is passed
    score, back = [0.0] * n, [-1] * n
    ps, qs, rs = p.tolist(), q.tolist(), rank.tolist()
    waiting: list[int] = []
    for i in range(n):
        if waiting and ps[waiting[0]] < ps[i]:  # matches at the same p don't follow one another
            for j in waiting:
                entry = (score[j] + GAP_COST * (ps[j] + qs[j]), j)
                r = rs[j]
                while r <= size:
                    if tree[r] < entry:
                        tree[r] = entry
                    r += r & -r
            waiting = []
        best, r = (-1e18, -1), rs[i] - 1
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - GAP_COST * (ps[i] + qs[i])
        score[i] = K + max(0.0, gain)
        if gain > 0:
            back[i] = best[1]
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = back[i]
        run = np.array(links[::-1])
        if len(run):
            breaks = np.flatnonzero((np.diff(p[run]) > GAP + K) | (np.diff(q[run]) > GAP + K)) + 1
            out += np.split(run, breaks)
    return out


CHAINS = "doc_id long, source_id long, p_from int, p_to int, q_from int, q_to int, anchors binary"


def _scan(p: np.ndarray, q: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Where chains begin among matches that rise in p and in q from each ``new`` one on: the best chain of such matches goes through all of them, but for gaps that cost
    more than what stands before them gains, or that are too long."""
    dp, dq = np.diff(p, prepend=0), np.diff(q, prepend=0)
    cost = round(100 * GAP_COST)
    link = np.where(new, 0, 100 * K - cost * (dp + dq))  # what the match before gains, less the gap, in hundredths of a word
    total = np.cumsum(link)
    level = (np.cumsum(new) - 1) * (int(np.abs(link).sum()) + 1)  # sets each group below the one before
    low = np.minimum.accumulate(total - level) + level
    return new | (dp > GAP + K) | (dq > GAP + K) | (low >= total)


def _run_rows(rec: np.ndarray, least: int) -> list[tuple]:
    """Runs of the matched places (d, p) of each document, whatever their sources, that are as wide as those of a whole exact passage must be."""
    at = np.unique(rec[["d", "p"]])
    edge = np.flatnonzero(np.concatenate(([True], (at["d"][1:] != at["d"][:-1]) | (np.diff(at["p"]) > GAP + K), [True])))
    wide = (np.diff(edge) >= 2) & (at["p"][edge[1:] - 1] - at["p"][edge[:-1]] + K >= least)
    return [(at["d"][s], None, at["p"][s], at["p"][e - 1] + K, None, None, at["p"][s:e].astype("<i4").tobytes()) for s, e in zip(edge[:-1][wide], edge[1:][wide], strict=True)]


def _chains(table: pa.Table, min_words: int) -> pa.Table:
    """Chains of the matches of a bucket's documents, and, with no source, the runs of their matched places."""
    rec = unblob(table, MATCH)
    rec = rec[np.lexsort((rec["q"], rec["p"], rec["s"], rec["d"]))]
    out: list[tuple] = []
    if len(rec):
        rec = rec[np.concatenate(([True], np.any([rec[f][1:] != rec[f][:-1] for f in rec.dtype.names], axis=0)))]
        out += _run_rows(rec, min_words - 2 * (WINDOW - 1))
        p, q = rec["p"].astype(np.int64), rec["q"].astype(np.int64)
        new = np.concatenate(([True], (rec["d"][1:] != rec["d"][:-1]) | (rec["s"][1:] != rec["s"][:-1])))
        rises = np.concatenate(([True], (np.diff(p) > 0) & (np.diff(q) > 0))) | new
        edge = np.append(np.flatnonzero(new), len(rec))
        plain = np.add.reduceat(~rises, edge[:-1]) == 0  # groups whose matches all rise
        begin = _scan(p, q, new)
        own = np.repeat(plain, np.diff(edge))
        cut = np.flatnonzero(np.concatenate((begin | new, [True])))
        wide = own[cut[:-1]] & (np.diff(cut) >= 2) & (p[cut[1:] - 1] - p[cut[:-1]] + K >= LEAST)
        found = [slice(s, e) for s, e in zip(cut[:-1][wide], cut[1:][wide], strict=True)]
        wide = ~plain & (np.diff(edge) >= 2) & (p[edge[1:] - 1] - p[edge[:-1]] + K >= LEAST)
        for s, e in zip(edge[:-1][wide], edge[1:][wide], strict=True):
            found += [s + run for run in chain(p[s:e], q[s:e]) if p[s:e][run[-1]] - p[s:e][run[0]] + K >= LEAST and len(run) >= 2]
        for run in found:
            x, y, first = p[run], q[run], run.start if isinstance(run, slice) else run[0]
            out.append((rec["d"][first], rec["s"][first], x[0], x[-1] + K, y[0], y[-1] + K, np.stack([x, y]).astype("<i4").tobytes()))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = [c.split()[0] for c in CHAINS.split(", ")]
    return pa.table({n: pa.array(v, t) for n, v, t in zip(names, zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)})


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the wanted blocks of each document."""
    for batch in batches:
        texts, wanted, docs = tx.strings(batch.column("text")), batch.column("blocks"), batch.column("doc_id")
        ids, block, data = [], [], []
        for a, b in tx.slices(texts):
            w = tx.words(texts.slice(a, b - a))
            for i in range(b - a):
                own = (w.hash[w.first[i] : w.first[i + 1]] >> np.uint64(32)).astype(np.uint32)  # half a hash is enough to compare words
                for x in wanted[a + i].as_py():
                    ids.append(docs[a + i].as_py())
                    block.append(x)
                    data.append(own[x * BLOCK : (x + 1) * BLOCK].tobytes())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], ["doc", "block", "words"])


def _grow(same: np.ndarray) -> int:
    """How far words agree on: up to the best sum of 1 for a pair that agrees and -2 for one that doesn't."""
    if not len(same):
        return 0
    total = np.cumsum(np.where(same, 1, -2))
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


def _gain(same: np.ndarray) -> int:
    """The best such sum."""
    return int(np.cumsum(np.where(same, 1, -2)).max())


#: Words of both texts that may be passed over where their diagonal shifts.
SHIFTS = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))


def _outward(a: np.ndarray, b: np.ndarray) -> tuple[int, int, list[tuple[int, int]]]:
    """How far the two texts go on together from their beginnings (in words of each), and where their diagonal shifts on the way."""
    i, j, turns = 0, 0, []
    while True:
        n = min(len(a) - i, len(b) - j)
        n = _grow(a[i : i + n] == b[j : j + n])
        i, j = i + n, j + n
        best, to = 2, None
        for x, y in SHIFTS:
            n = min(len(a) - i - x, len(b) - j - y)
            if n > best + 2:
                gain = _gain(a[i + x : i + x + n] == b[j + y : j + y + n]) - 2
                if gain > best:
                    best, to = gain, (x, y)
        if to is None:
            return i, j, turns
        i, j = i + to[0], j + to[1]
        turns.append((i, j))


def align(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[int, int, int, int, float]:
    """Aligned spans of the texts a and b around a chain of seed matches (p, q), and the part of a's words there that agree."""
    x, y, turns = _outward(a[max(0, p[0] - REACH) : p[0]][::-1], b[max(0, q[0] - REACH) : q[0]][::-1])
    u, v, more = _outward(a[p[-1] + K : p[-1] + K + REACH], b[q[-1] + K : q[-1] + K + REACH])
    start, end = p[0] - x, p[-1] + K + u
    if turns or more:
        p, q = (np.concatenate([[c[0] - t[k] - 1 for t in turns[::-1]], c, [c[-1] + K + t[k] for t in more]]).astype(np.int64) for k, c in enumerate((p, q)))
    first, last = q[0] - p[0] + start, q[-1] - p[-1] + end
    agree = _agree(a, b, p, q, start, end)
    bare = np.flatnonzero(np.diff(p) > K)
    left = np.concatenate([[0], np.cumsum(~agree)])
    bare = bare[left[p[bare + 1] - start] - left[p[bare] - start] > 3]
    if len(bare):  # the diagonal shifts more than once between two matches
        more = [(p[i] + x, q[i] + y) for i in bare for x, y in _outward(a[p[i] : p[i + 1]], b[q[i] : q[i + 1]])[2]]
        if more:
            p, q = (np.concatenate([c, [m[k] for m in more]]) for k, c in enumerate((p, q)))
            order = np.argsort(p, kind="stable")
            agree |= _agree(a, b, p[order], q[order], start, end)
    return int(start), int(end), int(first), int(last), float(agree.mean())


def _agree(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, start: int, end: int) -> np.ndarray:
    """Which words of a from start to end agree with b's on the diagonal of the match before or after them."""
    place = np.arange(start, end)
    before = np.clip(np.searchsorted(p, place, "right") - 1, 0, len(p) - 1)
    after = np.clip(np.searchsorted(p, place, "left"), 0, len(p) - 1)
    top = len(b) - 1
    return (a[place] == b[np.clip(place + (q - p)[before], 0, top)]) | (a[place] == b[np.clip(place + (q - p)[after], 0, top)])


REPEATS = "doc_id long, source_id long, start_word int, end_word int, source_start int, source_end int, agreement double"


def _aligned(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPEATS.split(", ")]
    for batch in pieces(batches):
        out = []
        for r in batch.to_pylist():
            sides = []
            for side in (0, 1):
                parts = sorted((x["block"], x["words"]) for x in r["words"] if x["side"] == side)
                sides.append((parts[0][0] * BLOCK, np.frombuffer(b"".join(w for _, w in parts), "<u4")) if parts else (0, np.zeros(0, "<u4")))
            p, q = np.frombuffer(r["anchors"], "<i4").reshape(2, -1).astype(np.int64)
            (pa_, a), (qb, b) = sides
            p, q = p - pa_, q - qb
            if p[-1] + K > len(a) or q[-1] + K > len(b):
                continue  # rows of one id with texts of different lengths
            s, e, t, u, agree = align(a, b, p, q)
            if e - s >= min_words and agree >= AGREE:
                out.append((r["doc_id"], r["source_id"], s + pa_, e + pa_, t + qb, u + qb, agree))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)


def _align_chains(rows: DataFrame, chains: DataFrame, min_words: int) -> DataFrame:
    """The repeats among chains, by the words of both texts."""
    near = lambda x, by: F.greatest((F.col(x) + by) / BLOCK, F.lit(0)).cast("int")
    side = lambda n, doc, a, b: chains.select("chain", F.lit(n).alias("side"), F.col(doc).alias("doc"), F.explode(F.sequence(near(a, -REACH), near(b, REACH))).alias("block"))
    asked = side(0, "doc_id", "p_from", "p_to").unionByName(side(1, "source_id", "q_from", "q_to"))
    wanted = asked.select("doc", "block").distinct().groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    words = wanted.join(maybe_in(rows, wanted), "doc_id").transform(mapped, _word_blocks, "doc long, block int, words binary").dropDuplicates(["doc", "block"])
    found = asked.join(words, ["doc", "block"]).groupBy("chain").agg(F.collect_list(F.struct("side", "block", "words")).alias("words"))
    both = chains.dropDuplicates(["chain"]).join(found, "chain").select("doc_id", "source_id", "anchors", "words")
    return both.transform(mapped, _aligned, REPEATS, min_words=min_words)


STARTS = "doc_id long, starts array<int>, stops array<int>"


def _open_places(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Where runs of min_words words begin (from start to before stop) that hold a matched place no repeat covers."""
    for batch in pieces(batches):
        out = []
        for r in batch.to_pylist():
            p = np.frombuffer(r["anchors"], "<i4").astype(np.int64)
            covered = np.zeros(p[-1] + K + 1, np.int64)
            for s in r["spans"] or ():
                covered[min(s["start_word"], len(covered) - 1)] += 1
                covered[min(s["end_word"], len(covered) - 1)] -= 1
            cover = np.cumsum(covered)
            left = p[(cover[p] == 0) | (cover[p + K - 1] == 0)]
            low = np.maximum(left - min_words + K, max(0, p[0] - WINDOW + 1))
            high = np.minimum(left, p[-1] + K + WINDOW - 1 - min_words)
            low, high = low[low <= high], high[low <= high]
            if len(low):
                cut = np.flatnonzero(low[1:] > high[:-1] + 1)
                out.append((r["doc_id"], low[np.concatenate(([0], cut + 1))].tolist(), (high[np.append(cut, len(high) - 1)] + 1).tolist()))
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)], ["doc_id", "starts", "stops"])


def passages(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, which text each is in, and the word that it begins with there."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    own = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = first[own] + place
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * tx.powers(tx.BASE, len(h))[: len(h)], out=run[1:])
    return tx.mix((run[at + n] - run[at]) * tx.powers(tx.INVERSE, len(h))[at]), own, place


def _passages(batches: Iterator[pa.RecordBatch], min_words: int, mask: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(h, d, p) of the runs of min_words words: those from the columns starts to stops, or those that ``mask`` may hold."""
    for batch in batches:
        texts, docs = tx.strings(batch.column("text")), batch.column("doc_id").to_numpy()
        for a, b in tx.slices(texts):
            w = tx.words(texts.slice(a, b - a))
            h, own, place = passages(w.hash, w.first, min_words)
            if mask is None:
                keep = np.zeros(len(h) + 1, np.int64)
                begin = np.searchsorted(own, np.arange(b - a))
                size = np.bincount(own, minlength=b - a)
                for i in range(b - a):
                    for c, sign in (("starts", 1), ("stops", -1)):
                        where = np.minimum(np.array(batch.column(c)[a + i].as_py(), np.int64), size[i])
                        np.add.at(keep, begin[i] + where, sign)
                keep = np.cumsum(keep)[:-1] > 0
            else:
                keep = maybe_held(mask, h)
            yield pa.record_batch([pa.array(h[keep].view(np.int64)), pa.array(docs[a:b][own[keep]]), pa.array(place[keep].astype(np.int32))], ["h", "d", "p"])


def _exact_rest(rows: DataFrame, runs: DataFrame, spans: DataFrame, min_words: int) -> DataFrame | None:
    """Repeats of min_words words and more that agree word for word, at matched places that ``spans`` leave open; no such place: None.

    Each run of words is grouped to its first occurrence before it meets the open ones, so a passage costs one row a copy.
    """
    held = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    left = runs.select("doc_id", "anchors").join(held, "doc_id", "left").transform(mapped, _open_places, STARTS, min_words=min_words)
    left = saved(left.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops")), "open")
    if left.isEmpty():
        return None
    runs_of = lambda texts, mask: texts.transform(mapped, _passages, "h long, d long, p int", min_words=min_words, mask=mask)
    own = saved(runs_of(left.join(maybe_in(rows, left), "doc_id"), None), "asked")
    first = runs_of(rows, hash_filter(own.select("h").distinct(), F.col("h"), F.shiftrightunsigned("h", 32))).groupBy("h").agg(F.min(F.struct(F.col("d").alias("s"), F.col("p").alias("q"))).alias("m"))
    met = own.join(first, "h").select("d", "p", "m.s", "m.q").filter("s < d or s = d and q < p").distinct()
    line = Window.partitionBy("d", "s", F.col("p") - F.col("q")).orderBy("p")
    island = met.withColumn("gap", F.col("p") - F.lag("p").over(line)).withColumn("island", F.sum(F.when(F.col("gap") <= min_words, 0).otherwise(1)).over(line))
    return island.groupBy("d", "s", (F.col("p") - F.col("q")).alias("shift"), "island").agg(F.min("p").alias("p_from"), F.max("p").alias("p_to")).select(
        F.col("d").alias("doc_id"), F.col("s").alias("source_id"), F.col("p_from").cast("int").alias("start_word"), (F.col("p_to") + min_words).cast("int").alias("end_word"),
        (F.col("p_from") - F.col("shift")).cast("int").alias("source_start"), (F.col("p_to") - F.col("shift") + min_words).cast("int").alias("source_end"), F.lit(1.0).alias("agreement"),
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least min_words words that a document repeats from an earlier one (by doc_id), or from an earlier place of its own.

    One row for each passage and source: doc_id, source_id, start_word and end_word (in doc_id's words), source_start and source_end, agreement
    (part of the words that agree). Passages with different sources can overlap. A passage has rows for the sources that its seeds' first and
    preceding occurrences are in; where these leave words open, for the first source of each run of min_words words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = buckets_for(size)

    found = rows.transform(mapped, _seeds, KINDS, buckets=buckets, min_words=min_words)
    matches = per_bucket(found, _join_seeds, "bucket int, data binary", buckets=buckets)
    chains = per_bucket(matches, _chains, CHAINS, min_words=min_words).withColumn("chain", F.xxhash64("doc_id", "source_id", "p_from", "p_to", "q_from", "q_to"))
    chains = saved(chains, "chains")
    aligned = saved(_align_chains(rows, chains.filter("source_id is not null"), min_words), "aligned")
    rest = _exact_rest(rows, chains.filter("source_id is null"), aligned, min_words)
    return aligned if rest is None else aligned.unionByName(rest)


def _cut(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """The last column of each batch has the spans to cut out."""
    for batch in batches:
        texts, spans = tx.strings(batch.column(text_col)), batch.columns[-1].to_pylist()
        kept = batch.column(text_col).to_pylist()
        for a, b in tx.slices(texts):
            w = tx.words(texts.slice(a, b - a))
            _, off = tx.raw(texts.slice(a, b - a))
            for i in range(b - a):
                if spans[a + i]:
                    body = texts[a + i].as_py().encode()
                    start = w.start[w.first[i] : w.first[i + 1]] - off[i]
                    parts, at = [], 0
                    for s in sorted((x["start_word"], x["end_word"]) for x in spans[a + i]):
                        begin, end = (int(start[min(x, len(start) - 1)]) if x < len(start) else len(body) for x in s)
                        if begin > at:
                            parts.append(body[at:begin])
                        at = max(at, end)
                    kept[a + i] = b"".join([*parts, body[at:]]).decode()
        columns = [pa.array(kept, batch.schema.field(n).type) if n == text_col else batch.column(n) for n in batch.schema.names[:-1]]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeats cut out of their texts, the first occurrence of each passage excepted; a text that is all repeats becomes empty. Other columns stay as they are."""
    doc, spans = unused(docs.columns, "spans_of"), unused(docs.columns, "spans")
    cut = found.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans))
    return docs.join(cut, F.col(id_col) == F.col(doc), "left").select(*docs.columns, spans).transform(mapped, _cut, docs.schema, text_col=text_col)
