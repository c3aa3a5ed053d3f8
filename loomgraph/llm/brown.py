"""Class-based bigram language model with classes from the exchange algorithm.

P(text) is the product over its tokens of P(class | class before) * P(token | class). The exchange begins with *units*: each token whose
count is at least 1/5000 of all training tokens is one (so there are at most 5000), and the rarer ones share 512 units by the hash of
their last two bytes. So every token, seen or not, has a class to start from, and the units' model stays small however large the vocabulary gets. Then every training
token moves by itself, however rare it is, by its own neighbours; a token that no training text holds is in the class that most of its unit's tokens have moved to.

The corpus is encoded once: each row of the encoded table holds some texts as numbers of its own dictionary. Dictionaries travel by ranges of
the token hash to be counted over the corpus, and the counts come back in the same order. An exchange round runs over the table of unit pairs:
each task sums the counts between units and classes, and each unit gets the class that gains most while the others stay; half of the units move in
a round. The driver holds class totals and one class a unit. In a round of single tokens, texts tell the ranges of the hash the classes before and after each of their tokens, a byte
for each, and get one class back for each word of their dictionary that moves; a token moves once. Encoded texts lie in buckets by their number, so what comes back meets them without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.store import blob_batch, buckets_for, mapped, per_bucket, saved, saved_buckets, top_bits, unblob

END = np.uint64(0x2545F4914F6CDD1D)
CLASSES = 48
HEADS = 5000
SHAPES = 512
ROUNDS = 14
#: Rounds in which every training token moves by itself, each token in one of them: 1/64 of the tokens in the first, and from then on as many as have moved before. Were many to move at once, all would go where few are.
SINGLES = 7
#: Stands for the class of a token that no training text holds.
UNSEEN = 255
#: Strength of the class frequencies in the transitions.
PRIOR = 4.0
ENCODED = "gid long, doc_id array<long>, held array<boolean>, tokens array<int>, ids binary, dict binary, shape binary, train binary, n_train long"
ASK = "bucket int, gid long, hashes binary, shapes binary, counts binary"
TOLD = "bucket int, gid long, hashes binary, shapes binary, own binary, counts binary, before binary, after binary"
MOVED = "gid long, turn int, bucket int, classes binary"
PAIR = np.dtype([("u", "<u4"), ("v", "<u4"), ("n", "<i8")])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gid = TaskContext.get().partitionId() << 32
    names = [c.split()[0] for c in ENCODED.split(", ")]
    for batch in batches:
        texts = tx.strings(batch.column("text"))
        for a, b in tx.slices(texts, 4 << 20):
            w = tx.words(texts.slice(a, b - a))
            held = batch.column("held").slice(a, b - a)
            at = w.first[1:]
            h = np.insert(w.hash, at, END)
            tail = w.data[w.end - 1].astype(np.uint32) * 256 + w.data[np.maximum(w.end - 2, w.start)] if len(w.end) else np.zeros(0, np.uint32)
            shape = np.insert(tail * np.uint32(2654435761) >> np.uint32(23), at, 0).astype(np.uint16)
            words, first, ids = np.unique(h, return_index=True, return_inverse=True)
            tokens = np.diff(w.first) + 1
            trains = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), tokens)
            count = np.bincount(ids[trains], minlength=len(words)).astype(np.uint32)
            columns = [
                [gid], [batch.column("doc_id").slice(a, b - a).to_pylist()], [held.to_pylist()], [tokens.tolist()], [ids.astype(np.uint32).tobytes()],
                [words.tobytes()], [shape[first].tobytes()], [count.tobytes()], [int(trains.sum())],
            ]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            gid += 1


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each row's dictionary, cut by ranges of the hash."""
    for batch in batches:
        out = {k: [] for k in ("bucket", "gid", "hashes", "shapes", "counts")}
        for row in range(batch.num_rows):
            words, shape, count = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("dict", "<u8"), ("shape", "<u2"), ("train", "<u4")))
            where = top_bits(words, buckets)
            edges = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(words)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                for k, v in (("bucket", int(where[s])), ("gid", batch.column("gid")[row].as_py()), ("hashes", words[s:e].tobytes()), ("shapes", shape[s:e].tobytes()), ("counts", count[s:e].tobytes())):
                    out[k].append(v)
        yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], list(out))


def _answer(table: pa.Table, least: int) -> pa.Table:
    """Corpus counts of a bucket's tokens for every row that asked; and, with gid -1, its frequent tokens and how many rarer ones have each shape."""
    words = unblob(table, np.dtype("<u8"), "hashes")
    shape, count = unblob(table, np.dtype("<u2"), "shapes"), unblob(table, np.dtype("<u4"), "counts")
    unique, first, back = np.unique(words, return_index=True, return_inverse=True)
    total = np.bincount(back, count, len(unique)).astype(np.uint32)
    each = total[back]
    sizes = [len(x.as_buffer()) // 8 for x in table.column("hashes")]
    edges = np.cumsum([0, *sizes])
    head = total >= least
    kinds = np.bincount(shape[first][(total > 0) & ~head], minlength=SHAPES)
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "gid": pa.array([*table.column("gid").to_pylist(), -1], pa.int64()),
            "bucket": pa.array([bucket] * (len(sizes) + 1), pa.int32()),
            "counts": pa.array([*[each[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)], kinds.astype("<i8").tobytes()], pa.binary()),
            "heads": pa.array([*[None] * len(sizes), unique[head].tobytes() + total[head].astype("<u8").tobytes()], pa.binary()),
        }
    )


def units(words: np.ndarray, shape: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Unit of each dictionary entry: frequent tokens first, then the shapes."""
    where = np.searchsorted(heads, words)
    ok = where < len(heads)
    ok[ok] = heads[where[ok]] == words[ok]
    return np.where(ok, where, len(heads) + shape.astype(np.int64))


def _previous(unit: np.ndarray, tokens: np.ndarray, end: int) -> np.ndarray:
    """The unit before each token; the end of a text before its first."""
    out = np.empty_like(unit)
    out[1:] = unit[:-1]
    out[np.cumsum(tokens) - tokens] = end
    return out


def _pairs(batches: Iterator[pa.RecordBatch], heads: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring units in the training texts of a task."""
    size = len(heads) + SHAPES
    end = int(np.searchsorted(heads, END)) if END in heads else len(heads)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            words, shape = np.frombuffer(batch.column("dict")[row].as_buffer(), "<u8"), np.frombuffer(batch.column("shape")[row].as_buffer(), "<u2")
            ids = np.frombuffer(batch.column("ids")[row].as_buffer(), "<u4")
            tokens, held = np.array(batch.column("tokens")[row].as_py(), np.int64), np.array(batch.column("held")[row].as_py(), bool)
            unit = units(words, shape, heads)[ids]
            key = (_previous(unit, tokens, end) * size + unit)[np.repeat(~held, tokens)]
            k, n = np.unique(key, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
    where = top_bits(tx.mix(keys.astype(np.uint64)), buckets)
    order = np.argsort(where, kind="stable")
    out = np.empty(len(keys), PAIR)
    out["u"], out["v"], out["n"] = keys[order] // size, keys[order] % size, counts[order]
    yield blob_batch(where[order], out)


def _sum_pairs(table: pa.Table) -> pa.Table:
    rec = unblob(table, PAIR)
    key, back = np.unique(rec["u"].astype(np.int64) << 32 | rec["v"], return_inverse=True)
    return pa.table({"u": (key >> 32).astype(np.int32), "v": (key & 0xFFFFFFFF).astype(np.int32), "n": np.bincount(back, rec["n"], len(key)).astype(np.int64)})


def _class_pairs(batches: Iterator[pa.RecordBatch], classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        u, v, n = (batch.column(c).to_numpy() for c in ("u", "v", "n"))
        total += np.bincount(classes[u] * CLASSES + classes[v], n, CLASSES * CLASSES).astype(np.int64)
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])


def _beside(batches: Iterator[pa.RecordBatch], classes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of each unit before and after each class, and next to itself, in blobs by unit."""
    size = len(classes)
    after, before, own = np.zeros(size * CLASSES), np.zeros(size * CLASSES), np.zeros(size)
    for batch in batches:
        u, v, n = (batch.column(c).to_numpy() for c in ("u", "v", "n"))
        after += np.bincount(u.astype(np.int64) * CLASSES + classes[v], n, size * CLASSES)
        before += np.bincount(v.astype(np.int64) * CLASSES + classes[u], n, size * CLASSES)
        own += np.bincount(u[u == v], n[u == v], size)
    rows = np.hstack([after.reshape(size, -1), before.reshape(size, -1), own[:, None]])
    for a in range(0, size, -(-size // buckets)):
        yield pa.record_batch([pa.array([a], pa.int32()), pa.array([rows[a : a + -(-size // buckets)].tobytes()], pa.binary())], ["bucket", "data"])


def _moves(table: pa.Table, classes: np.ndarray, between: np.ndarray) -> pa.Table:
    """The class that each unit would gain most by moving to."""
    rows = sum(np.frombuffer(x.as_buffer(), float) for x in table.column("data")).reshape(-1, 2 * CLASSES + 1)
    first = table.column("bucket")[0].as_py()
    g = lambda x: x * np.log(np.maximum(x, 1))
    best = []
    for i, row in enumerate(rows):
        a, own = classes[first + i], row[-1]
        after, before = row[:CLASSES].copy(), row[CLASSES:-1].copy()
        size = after.sum()
        if not size and not before.sum():
            best.append(int(a))
            continue
        n = between.copy()  # without this unit
        n[a] -= after
        n[:, a] -= before
        n[a, a] += own
        after[a] -= own
        before[a] -= own
        total = n.sum(axis=1)
        gain = (g(n + after) - g(n)).sum(axis=1) + (g(n.T + before) - g(n.T)).sum(axis=1)
        d = np.diag(n)
        gain += g(d + after + before + own) - g(d + after) - g(d + before) + g(d)
        gain -= 2 * (g(total + size) - g(total))
        best.append(int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else int(a))
    return pa.table({"unit": pa.array(range(first, first + len(best)), pa.int32()), "best": pa.array(best, pa.int32())})


def exchange(pairs: DataFrame, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units of a table (u, v, n) of neighbours, and the counts between classes."""
    classes = np.arange(size) % CLASSES
    order = np.random.default_rng(11)

    def between() -> np.ndarray:
        found = pairs.transform(mapped, _class_pairs, "total binary", classes=classes).collect()
        return sum((np.frombuffer(r["total"], np.int64) for r in found), np.zeros(CLASSES * CLASSES, np.int64)).reshape(CLASSES, CLASSES).astype(float)

    now = between()
    for _ in range(rounds):
        blobs = pairs.transform(mapped, _beside, "bucket int, data binary", classes=classes, buckets=16)
        found = per_bucket(blobs, _moves, "unit int, best int", classes=classes, between=now).collect()  # one class a unit
        best = classes.copy()
        best[[r["unit"] for r in found]] = [r["best"] for r in found]
        turn = order.random(size) < 0.5
        if (best == classes).all():
            break
        classes = np.where(turn, best, classes)
        now = between()
    return classes, now


def _movers(words: np.ndarray, turn: int) -> np.ndarray:
    """Which tokens move in a round of single ones, by the low bits of their hash."""
    low = (words & np.uint64((1 << (SINGLES - 1)) - 1)).astype(np.int64)
    return (low >= 1 << turn >> 1) & (low < 1 << turn)


def _own(batch: pa.RecordBatch, row: int, heads: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary of a row and the class of each of its tokens after the rounds so far."""
    words, shape = np.frombuffer(batch.column("dict")[row].as_buffer(), "<u8"), np.frombuffer(batch.column("shape")[row].as_buffer(), "<u2")
    own = classes[units(words, shape, heads)].astype(np.uint8)
    moved = sorted((p["turn"], p["bucket"], p["classes"]) for p in batch.column("moved")[row].as_py() or [])
    for turn in sorted({t for t, _, _ in moved}):
        at = np.flatnonzero(_movers(words, turn))
        new = np.frombuffer(b"".join(c for t, _, c in moved if t == turn), np.uint8)
        own[at[new != UNSEEN]] = new[new != UNSEEN]
    return words, own


def _neighbours(batch: pa.RecordBatch, row: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the dictionary of the training tokens before and of those after them."""
    ids = np.frombuffer(batch.column("ids")[row].as_buffer(), "<u4")
    tokens, held = np.array(batch.column("tokens")[row].as_py(), np.int64), np.array(batch.column("held")[row].as_py(), bool)
    trains = np.repeat(~held, tokens)
    return _previous(ids, tokens, int(np.searchsorted(words, END)))[trains], ids[trains]


def _tell(batches: Iterator[pa.RecordBatch], heads: np.ndarray, classes: np.ndarray, turn: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For the tokens that move in a round, by ranges of the hash: their class, how often they are trained on, and the class before and the class after them each time."""
    names = [c.split()[0] for c in TOLD.split(", ")]
    for batch in batches:
        for row in range(batch.num_rows):
            words, own = _own(batch, row, heads, classes)
            left, right = _neighbours(batch, row, words)
            mine = _movers(words, turn)
            count = np.frombuffer(batch.column("train")[row].as_buffer(), "<u4")[mine]
            before, after = (b[k][np.argsort(t[k], kind="stable")] for b, t, k in ((own[left], right, mine[right]), (own[right], left, mine[left])))
            hashes, shape = words[mine], np.frombuffer(batch.column("shape")[row].as_buffer(), "<u2")[mine]
            where, at = top_bits(hashes, buckets), np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            edges = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(hashes)] if len(hashes) else [0]
            cuts = list(zip(edges[:-1], edges[1:], strict=True))
            gid = batch.column("gid")[row].as_py()
            columns = [
                [int(where[a]) for a, _ in cuts], [gid] * len(cuts), [hashes[a:b].tobytes() for a, b in cuts], [shape[a:b].tobytes() for a, b in cuts], [own[mine][a:b].tobytes() for a, b in cuts], [count[a:b].tobytes() for a, b in cuts],
                [before[at[a] : at[b]].tobytes() for a, b in cuts], [after[at[a] : at[b]].tobytes() for a, b in cuts],
            ]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 6), strict=True)], names)


def transitions(between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class frequencies, and how often classes are followed by each: counts with PRIOR shares of the frequencies."""
    inside = between.sum(axis=0)
    share = (inside + 0.5) / (inside + 0.5).sum()
    return share, (between + PRIOR * share) / (between.sum(axis=1, keepdims=True) + PRIOR)


def best_classes(own: np.ndarray, before: np.ndarray, after: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The class in which each token's places in the training texts are likeliest by the model of all others (own: its class now; before, after: counts (token, class)).

    Many tokens move at once, so the counts of a class that few are in can't be taken at their word, as in `_moves`: all that stand alone would gain most in the same empty class."""
    t, size = np.arange(len(own)), after.sum(axis=1)
    share, step = transitions(between)
    row, inside = between.sum(axis=1), between.sum(axis=0)
    found = after @ np.log(step).T + before @ np.log(step) - size[:, None] * np.log(np.maximum(inside + size[:, None], 1))
    less = lambda n, x: np.maximum(n - x, 0)  # noqa: E731  (without the token)
    follows = np.log((less(between[own], after) + PRIOR * share) / (less(row[own], size) + PRIOR)[:, None])
    leads = np.log((less(between[:, own].T, before) + PRIOR * share[own][:, None]) / (row + PRIOR))
    found[t, own] = (after * follows + before * leads).sum(axis=1) - size * np.log(np.maximum(np.maximum(inside[own], size), 1))
    best = found.argmax(axis=1)
    return np.where(found[t, best] > found[t, own] + 1e-9, best, own)


def _single_moves(table: pa.Table, between: np.ndarray, turn: int) -> pa.Table:
    """The class that each token of a bucket gains most by moving to, for every row that told of it; and, with gid -1, how many tokens of each shape are in each class then."""
    words, shape, own, count = (unblob(table, np.dtype(t), c) for c, t in (("hashes", "<u8"), ("shapes", "<u2"), ("own", "u1"), ("counts", "<u4")))
    unique, first, back = np.unique(words, return_index=True, return_inverse=True)
    size, now = np.bincount(back, count, len(unique)), own[first].astype(np.int64)
    each = np.repeat(back, count)
    sides = [unblob(table, np.dtype("u1"), c) for c in ("before", "after")]
    sparse = [np.unique(each << 6 | x, return_counts=True) for x in sides]
    best = np.full(len(unique), UNSEEN, np.uint8)
    for a in range(0, len(unique), 1024):
        b = min(a + 1024, len(unique))
        dense = []
        for key, n in sparse:
            lo, hi = np.searchsorted(key, [a << 6, b << 6])
            dense.append(np.zeros((b - a, CLASSES)))
            dense[-1][(key[lo:hi] >> 6) - a, key[lo:hi] & 63] = n[lo:hi]
        best[a:b] = np.where(size[a:b] > 0, best_classes(now[a:b], *dense, between), UNSEEN)
    seen = size > 0
    kinds = np.bincount(shape[first][seen].astype(np.int64) * CLASSES + best[seen], minlength=SHAPES * CLASSES)
    found = best[back]
    edges = np.cumsum([0, *[len(x.as_buffer()) for x in table.column("own")]])
    bucket = table.column("bucket")[0].as_py()
    data = [*[found[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)], kinds.astype("<i8").tobytes()]
    return pa.table({"gid": pa.array([*table.column("gid").to_pylist(), -1], pa.int64()), "turn": pa.array([turn] * len(data), pa.int32()), "bucket": pa.array([bucket] * len(data), pa.int32()), "classes": pa.array(data, pa.binary())})


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each shape in each class, over the buckets of a task."""
    total = np.zeros(SHAPES * CLASSES, np.int64)
    for batch in batches:
        for x in batch.column("classes"):
            total += np.frombuffer(x.as_buffer(), "<i8")
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])


def _between(batches: Iterator[pa.RecordBatch], heads: np.ndarray, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring classes in the training texts of a task."""
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            words, own = _own(batch, row, heads, classes)
            left, right = _neighbours(batch, row, words)
            total += np.bincount(own[left].astype(np.int64) * CLASSES + own[right], minlength=CLASSES * CLASSES)
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])


def _score(batches: Iterator[pa.RecordBatch], heads: np.ndarray, classes: np.ndarray, step: np.ndarray, room: np.ndarray, total: int, kinds: int) -> Iterator[pa.RecordBatch]:
    """step: log10 of the transitions; room: log10 of what the counts of a class are divided by."""
    spread = np.log10(total + 0.5 * (kinds + 1))
    for batch in batches:
        for row in range(batch.num_rows):
            words, own = _own(batch, row, heads, classes)
            ids, tokens = np.frombuffer(batch.column("ids")[row].as_buffer(), "<u4"), np.array(batch.column("tokens")[row].as_py(), np.int64)
            parts = sorted((p["bucket"], p["counts"]) for p in batch.column("answers")[row].as_py())
            count = np.frombuffer(b"".join(p for _, p in parts), "<u4")
            mine = np.log10(count + 0.5)
            cls = own[ids]
            before = own[_previous(ids, tokens, int(np.searchsorted(words, END)))]
            at = np.concatenate([[0], np.cumsum(tokens)])
            base = tx.sums(mine[ids], at) - tokens * spread
            score = tx.sums(mine[ids] - room[cls] + step[before, cls], at)
            n = len(tokens)
            columns = [
                pa.array(batch.column("doc_id")[row].as_py(), pa.int64()), pa.array(batch.column("held")[row].as_py(), pa.bool_()), pa.array(tokens),
                pa.array(tx.sums((count[ids] > 0).astype(np.int64), at)), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score),
            ]
            yield pa.record_batch(columns, [c.split()[0] for c in SCORES.split(", ")])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def brown_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Scores every row's whole text by a class bigram model of the rows for which the column ``held_out`` isn't true.

    Tokens are words (A-Z lower-cased) and one end for each text. Returns doc_id, held_out, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (log10 of the smoothed unigram probability), score (log10 of the model's) and perplexity (of a token). Null and empty texts are
    an end alone; rows with a null id count as training texts unless held out; repeated rows count each. Without training texts every
    token is unseen, and scores are still finite. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    encoded, deals = saved_buckets(rows.transform(mapped, _encode, ENCODED), "encoded", "gid")
    total, size = encoded.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum(F.octet_length("dict").cast("long")), F.lit(0))).first()
    asked = encoded.select("gid", "dict", "shape", "train").transform(mapped, _ask, ASK, buckets=buckets_for(size * 2))
    answers = saved(per_bucket(asked, _answer, "gid long, bucket int, counts binary, heads binary", least=max(1, -(-total // HEADS))), "answers")
    stats = answers.filter("gid = -1").select("counts", "heads").collect()  # at most HEADS tokens in all
    kinds = sum((np.frombuffer(r["counts"], "<i8") for r in stats), np.zeros(SHAPES, np.int64))
    found = [np.frombuffer(r["heads"], "<u8").reshape(2, -1) for r in stats]
    heads = np.sort(np.concatenate([f[0] for f in found])) if found else np.zeros(0, np.uint64)
    types = np.concatenate([np.ones(len(heads), np.int64), kinds])

    buckets = buckets_for(total / 8 * PAIR.itemsize, 8)
    blobs = encoded.select("held", "tokens", "ids", "dict", "shape").transform(mapped, _pairs, "bucket int, data binary", heads=heads, buckets=buckets)
    pairs = saved(per_bucket(blobs, _sum_pairs, "u int, v int, n long"), "pairs")
    classes, between = exchange(pairs, len(types), rounds)

    added = lambda df, n: sum((np.frombuffer(r["total"], np.int64) for r in df.collect()), np.zeros(n * CLASSES, np.int64)).reshape(n, CLASSES)
    in_class = np.zeros((SHAPES, CLASSES), np.int64)
    by_row = lambda df, name, *columns: df.filter("gid >= 0").repartition(deals, "gid").groupBy("gid").agg(F.collect_list(F.struct(*columns)).alias(name)).hint("shuffle_hash")
    moved = None
    beside = lambda df: df.withColumn("moved", F.lit(None).cast("array<struct<turn:int,bucket:int,classes:binary>>")) if moved is None else df.join(by_row(moved, "moved", "turn", "bucket", "classes"), "gid", "left")
    texts = encoded.select("gid", "held", "tokens", "ids", "dict", "shape", "train")
    for turn in range(SINGLES):
        told = beside(texts).transform(mapped, _tell, TOLD, heads=heads, classes=classes, turn=turn, buckets=buckets_for(total + size))
        one = saved(per_bucket(told, _single_moves, MOVED, between=between, turn=turn), "moved")
        in_class += added(one.filter("gid = -1").select("classes").transform(mapped, _kinds, "total binary"), SHAPES)
        moved = one if moved is None else moved.unionByName(one)
        between = added(beside(texts).transform(mapped, _between, "total binary", heads=heads, classes=classes), CLASSES).astype(float)
    if moved is not None:
        types_in = in_class.sum(axis=0)
        classes = np.concatenate([classes[: len(heads)], np.where(in_class.any(axis=1), in_class.argmax(axis=1), classes[len(heads) :])])
    else:
        types_in = np.bincount(classes, types, CLASSES)
    step = np.log10(transitions(between)[1])
    room = np.log10(between.sum(axis=0) + 0.5 * (types_in + 1))

    both = beside(encoded.select("gid", "doc_id", "held", "tokens", "ids", "dict", "shape")).join(by_row(answers, "answers", "bucket", "counts"), "gid")
    run = partial(_score, heads=heads, classes=classes, step=step, room=room, total=total, kinds=int(types.sum()))
    return both.transform(mapped, run, SCORES).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
