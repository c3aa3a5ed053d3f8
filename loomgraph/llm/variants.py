"""Grouping of spelling variants: words at an edit distance of one, by dynamic programming over a sorted list.

The vocabulary is sorted once forwards and once backwards, and cut into ranges. A word is looked up in the forward list among the words that share the first half of it, and in the
backward list among those that share the rest, so one edit is found in one of the two. A scan of a range walks the sorted words with the rows of a banded edit matrix: what a word shares with the one before
(their LCP) keeps its rows, and where a row has no cell of at most one edit, all words that share the prefix so far are skipped. All words that are looked up in a range step together
(numpy), each with a place in the list and rows of its own. Ranges whose shared prefix is already more than one edit from a word don't get the word at all.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.store import mapped, saved

#: Words in a range, roughly, and ranges at most (then they grow); the driver and each task hold two strings of at most CUT characters a range.
RANGE_WORDS = 50_000
RANGES = 1 << 14
CUT = 256
FAR = 9
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = (CRC >> np.uint32(1)) ^ np.where(CRC & 1, np.uint32(0xEDB88320), np.uint32(0))


def _crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, few: int = 64) -> np.ndarray:
    """Unsigned crc32 of each run of bytes, going on from a crc32 each; byte by byte for all runs at once, and one by one for runs of over ``few`` bytes."""
    size, out = end - start, ~state
    order = np.flatnonzero(size <= few)
    order = order[np.argsort(-size[order], kind="stable")]
    counts = size[order]
    for k in range(int(counts[0]) if len(counts) else 0):
        some = order[: np.searchsorted(-counts, -k, "left")]
        c = out[some]
        out[some] = CRC[(c ^ low[start[some] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out = ~out
    for i in np.flatnonzero(size > few).tolist():
        out[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(state[i]))
    return out


def typo_runs(texts: pa.Array, docs: list[int | None], least: int = 7, every: int = 31) -> pa.Array:
    """The runs of A-Z, a-z and U+00C0 to U+00FF of each text, A-Z lower-cased, of at least ``least`` characters, after planting typos.

    A run loses the character at h % length if ``every`` divides h, the unsigned crc32 of ``<doc_id>:<run>`` (nothing before the colon for a row without an id). Texts are a large_string array without nulls.
    """
    body, off = tx.raw(texts)
    low, n = tx.LOWER[body], len(body)
    if not n:
        return pa.array([], pa.large_string())
    lead = low == 0xC3  # the lead byte of U+00C0 to U+00FF
    letter = (low >= 97) & (low <= 122) | lead
    letter[1:] |= lead[:-1]
    head = np.zeros(n + 1, bool)
    head[off] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | head[1:n]
    ends[:-1] &= ~letter[1:] | head[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    chars = np.flatnonzero((low & 0xC0) != 0x80)  # where characters begin
    before = np.searchsorted(chars, start)
    size = np.searchsorted(chars, end) - before
    long = size >= least
    start, end, before, size = start[long], end[long], before[long], size[long]
    own = np.array([zlib.crc32(b"%d:" % d if d is not None else b":") for d in docs], np.uint32)
    h = _crcs(low, start, end, own[np.searchsorted(off, start, "right") - 1]).astype(np.int64)
    lost = np.flatnonzero(h % every == 0)
    at = chars[before[lost] + h[lost] % size[lost]]
    width = 1 + (low[at] == 0xC3)
    bytes_ = end - start
    edge = np.cumsum(bytes_)
    where = np.repeat(start - (edge - bytes_), bytes_) + np.arange(edge[-1] if len(edge) else 0)
    keep = np.ones(len(where), bool)
    gone = edge[lost] - bytes_[lost] + at - start[lost]
    keep[gone] = False
    keep[gone[width == 2] + 1] = False
    bytes_[lost] -= width
    size[lost] -= 1
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(bytes_, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[where[keep]])])
    return words.filter(pa.array(size >= least)) if (size < least).any() else words


def _counts(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tx.strings(batch.column(1))
        for a, b in tx.slices(texts, 4 << 20):
            found = pc.value_counts(typo_runs(texts.slice(a, b - a), batch.column(0).slice(a, b - a).to_pylist(), least, every))
            yield pa.record_batch([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])


def typo_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31, twice: int = 2) -> DataFrame:
    """word and n (occurrences in all texts) of the words of ``typo_runs`` that occur ``twice`` at least. Counts of a slice of text are summed before the shuffle. Null texts have no words; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(mapped, partial(_counts, least=least, every=every), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= twice)


class SortedList:
    """Sorted strings as code points, with what each shares with the one before, and for each the next that shares less."""

    def __init__(self, words: list[str]):
        self.words = words
        self.flat, self.off = _codes(words)
        self.size = np.diff(self.off)
        n = len(words)
        lcp = np.zeros(n + 1, np.int64)
        some, k = np.arange(1, n), 0
        while len(some):  # all neighbours at once, as long as they agree
            some = some[(self.size[some] > k) & (self.size[some - 1] > k)]
            some = some[self.flat[self.off[some] + k] == self.flat[self.off[some - 1] + k]]
            k += 1
            lcp[some] = k
        lcp[n] = -1
        after, stack = [n] * (n + 1), []
        for i, x in enumerate(lcp.tolist()):
            while stack and lcp[stack[-1]] > x:
                after[stack.pop()] = i
            stack.append(i)
        self.lcp, self.after = lcp, np.array(after)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=off[1:])
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), off


def scan(listed: SortedList, queries: list[str], exact: np.ndarray, first: np.ndarray, last: np.ndarray, prefixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, place in the list) of the words from place ``first`` to before ``last`` at exactly one edit; of prefixes, those within one edit of a prefix of the query.

    Word and query share their first ``exact`` characters, of which there is one at least; ``first`` must share them, or share what a prefix has of them.
    """
    flat, off = _codes(queries)
    size = np.diff(off)
    deep = int((size - exact).max(initial=0)) + 3
    rows = np.full((len(queries), deep + 1, 3), FAR, np.int8)  # the cells j = d - 1, d, d + 1 at depth d, from depth exact on
    rows[:, 0] = 1, 0, 1
    rows[exact == size, 0, 2] = FAR
    q = np.flatnonzero(first < last)
    i, d = first[q].astype(np.int64), exact[q].astype(np.int64)
    found_q, found_i = [], []
    code = lambda q, j: np.where((j >= 0) & (j < size[q]), flat[np.minimum(off[q] + np.maximum(j, 0), max(len(flat) - 1, 0))], 0xFFFFFFFF)
    while len(q):
        over = d >= listed.size[i]  # the word ends here (a prefix may end before)
        if over.any():
            oq, oi = q[over], i[over]
            depth = listed.size[oi]
            row = rows[oq, np.maximum(depth - exact[oq], 0)]
            if prefixes:
                hit = np.ones(len(oq), bool)  # what has come so far is within one edit
            else:
                gap = size[oq] - depth
                hit = (np.abs(gap) <= 1) & (row[np.arange(len(oq)), np.clip(gap + 1, 0, 2)] == 1)
            found_q.append(oq[hit])
            found_i.append(oi[hit])
        go = ~over
        gq, gd = q[go], d[go]
        c = listed.flat[listed.off[i[go]] + gd]
        row = rows[gq, gd - exact[gq]]
        left = np.minimum(row[:, 1] + 1, row[:, 0] + (c != code(gq, gd - 1)))
        middle = np.minimum(np.minimum(row[:, 1] + (c != code(gq, gd)), left + 1), row[:, 2] + 1)
        right = np.minimum(row[:, 2] + (c != code(gq, gd + 1)), middle + 1)
        left[gd > size[gq]] = FAR
        middle[gd + 1 > size[gq]] = FAR
        right[gd + 2 > size[gq]] = FAR
        alive = np.minimum(np.minimum(left, middle), right) <= 1
        aq = gq[alive]
        rows[aq, gd[alive] + 1 - exact[aq]] = np.stack([left, middle, right], 1)[alive]
        leave = over.copy()
        leave[go] = ~alive
        d[go] += alive
        # the next word that doesn't share what has been read of this one, and its rows
        lq, ld = q[leave], d[leave]
        j = i[leave] + 1
        while (far := listed.lcp[j] > ld).any():
            j[far] = listed.after[j[far]]
        i[leave] = j
        d[leave] = np.maximum(listed.lcp[j], exact[lq]) if prefixes else listed.lcp[j]
        done = np.zeros(len(q), bool)
        done[leave] = (j >= last[lq]) | ((listed.lcp[j] < exact[lq]) & (not prefixes))
        q, i, d = q[~done], i[~done], d[~done]
    return (np.concatenate(found_q), np.concatenate(found_i)) if found_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def shared_length(key: str) -> int:
    """Characters of a list key (its mark included) that words within one edit share, if this list finds them: the first half of the word forwards, the rest backwards."""
    size = len(key) - 1
    half = (size - 1) // 2
    return 1 + (half if key[0] == "f" else size - half)


class Ranges:
    """Where the ranges of a sorted list begin and end, cut to CUT characters."""

    def __init__(self, bounds: list[tuple[int, str, str]]):
        bounds = sorted(bounds, key=lambda b: b[1:])
        self.parts = np.array([b[0] for b in bounds], np.int64)
        self.low, self.high = [b[1] for b in bounds], [b[2] for b in bounds]
        self.shared = SortedList([low[: next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))] for low, high in zip(self.low, self.high, strict=True)])

    def of(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(key, part) of the ranges that may hold a word that this list has to find for a key."""
        exact = np.array([shared_length(k) for k in keys], np.int64)
        starts = [k[: min(e, CUT)] for k, e in zip(keys, exact.tolist(), strict=True)]
        first = np.array([bisect_left(self.high, s) for s in starts], np.int64)
        last = np.array([bisect_right(self.low, s + "\U0010ffff") for s in starts], np.int64)
        one = np.flatnonzero(last - first == 1)
        key, place = [one], [first[one]]
        for some in chunks(keys, exact, np.flatnonzero(last - first > 1)):
            q, at = scan(self.shared, [keys[i] for i in some.tolist()], exact[some], first[some], last[some], prefixes=True)
            key.append(some[q])
            place.append(at)
        return np.concatenate(key), self.parts[np.concatenate(place)]


def chunks(keys: list[str], exact: np.ndarray, some: np.ndarray, cells: int = 1 << 22) -> Iterator[np.ndarray]:
    """Parts of some keys whose matrices have so many rows together, or one key; short ones first."""
    size = np.array([len(keys[i]) for i in some.tolist()], np.int64) - exact[some] + 4
    order, a = np.argsort(size, kind="stable"), 0
    some, size = some[order], size[order]
    while a < len(some):
        b = a + max(1, int(np.searchsorted(size[a:] * np.arange(1, len(some) - a + 1), cells)))
        yield some[a:b]
        a = b


def _routed(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, part = ranges.of(batch.column("key").to_pylist())
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(np.ones(len(key), np.int32)), batch.column("key").take(pa.array(key)), pa.nulls(len(key), pa.int64())], ["part", "asked", "key", "n"])


NEAR = "word string, n_near long, form_n long, form string"


def _found(listed: SortedList, counts: list[int], keys: list[str]) -> pa.RecordBatch:
    """Of each key that has near words in this range, their number, the largest count and its word (of equals the smallest)."""
    plain = lambda k: k[1:] if k[0] == "f" else k[:0:-1]
    exact = np.array([shared_length(k) for k in keys], np.int64)
    first = np.array([bisect_left(listed.words, k[:e]) for k, e in zip(keys, exact.tolist(), strict=True)], np.int64)
    last = np.full(len(keys), len(listed.words), np.int64)
    best: dict[int, tuple[int, int, str]] = {}
    for some in chunks(keys, exact, np.arange(len(keys))):
        q, at = scan(listed, [keys[i] for i in some.tolist()], exact[some], first[some], last[some])
        for k, i in zip(some[q].tolist(), at.tolist(), strict=True):
            key, other = keys[k], listed.words[i]
            near = plain(other)
            if key[0] == "b":
                half = (len(key) - 2) // 2
                if near.startswith(plain(key)[:half]):
                    continue  # the forward list finds it
            n, least, form = best.get(k, (0, 0, ""))
            best[k] = (n + 1, *min((least, form), (-counts[i], near))) if n else (1, -counts[i], near)
    rows = [(plain(keys[k]), n, -least, form) for k, (n, least, form) in best.items()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], [c.split()[0] for c in NEAR.split(", ")])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of part, asked, key: the words of a range, and then those that are looked up in it."""
    part, words, counts, listed = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column("part").to_numpy().astype(np.int64) * 2 + batch.column("asked").to_numpy()
        cut = np.flatnonzero(np.diff(kind)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            own, asked = divmod(int(kind[a]), 2)
            keys = batch.column("key").slice(a, b - a).to_pylist()
            if own != part:
                part, words, counts, listed = own, [], [], None
            if not asked:
                words += keys
                counts += batch.column("n").slice(a, b - a).to_pylist()
                continue
            listed = listed or SortedList(words)
            yield _found(listed, counts, keys)


def near_words(words: DataFrame) -> DataFrame:
    """Of each word that has words at exactly one edit: word, n_near (how many), and the n and the word of the one with the largest n (of equals the smallest). ``words`` has distinct, non-empty words and their n.

    Each word is listed and looked up twice, and shuffled once more for each range that may hold a near one, mostly one. No pairs are made: a task counts for each word it is asked for.
    """
    listed = words.select(F.explode(F.array(F.concat(F.lit("f"), "word"), F.concat(F.lit("b"), F.reverse("word")))).alias("key"), "n")
    spark = words.sparkSession
    parts = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * words.count() // RANGE_WORDS))
    ranged = saved(listed.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()), "listed")
    start = F.substring("key", 1, CUT)
    bounds = [tuple(r) for r in ranged.groupBy("part").agg(F.min(start), F.max(start)).collect()]  # two strings a range
    asked = ranged.select("key").transform(mapped, partial(_routed, ranges=Ranges(bounds)), "part int, asked int, key string, n long")
    both = ranged.select("part", F.lit(0).alias("asked"), "key", "n").unionByName(asked)
    found = both.repartition(parts, "part").sortWithinPartitions("part", "asked", "key").transform(mapped, _scanned, NEAR)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (distinct words and their n).

    form is the near word (exactly one code point inserted, deleted or replaced) of the largest n, of equals the smallest, if its n is at least ``times`` the word's; root follows forms to the last. A word without
    near ones has n_near 0; form and form_n are null where no near word is so frequent, and root is the word. An empty table gives an empty one; null words are left out; other columns are not read.
    """
    words = saved(words.filter(F.col("word").isNotNull() & (F.length("word") > 0)).select("word", "n"), "words")
    known = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("form_n") >= times * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")])
    known = saved(known, "forms")
    most = known.agg(F.max("form_n")).first()[0] or 1
    roots, deep = saved(known.filter("form is not null").select("word", F.col("form").alias("root")), "roots"), 1
    while times**deep <= most:  # n grows so many times a step, so chains are short; the steps double
        roots = saved(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        deep *= 2
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
