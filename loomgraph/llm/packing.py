"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps at most ``windows`` open sequences. A document's whole sequences are cut off its front; the rest goes to the open window it
fits best. When it fits none and no more windows may be opened, the fullest window is emitted, filled up with the front of the
rest if its gap is over ``most_pad``, and the rest of that is placed again. At the end of a partition the open windows are merged; what remains
below a whole sequence is cut into sequences of powers of two, which need no padding. Memory is a few windows, and there is no shuffle.

Encoding is the costly part: texts are cut before single spaces between two non-spaces, where the tokenizer's pattern always begins a new token,
and each distinct chunk is encoded once and looked up afterwards.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.store import mapped

U = np.uint64
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _safe_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that, before and after a space, are surely no part of white space: visible ASCII, and the lead byte 0xC3 of Latin letters."""
    ascii_ = np.zeros(256, bool)
    ascii_[33:127] = True
    after = ascii_.copy()
    after[0xC3] = True
    return ascii_, after


def byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file without its special tokens: the bytes of each token, and its id, which is also its rank.

    Such files write each byte as one visible character: itself if it is visible Latin-1, else the next of the characters from U+0100.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["id"] for t in file["added_tokens"]}
    return {bytes(code[c] for c in token): i for token, i in file["model"]["vocab"].items() if i not in special}


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that the file's library cuts out of a text before anything else, and their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class ChunkEncoder:
    """Token ids of texts, by a lookup of chunks that have been encoded before; the lookup starts anew beyond ``most`` chunks.

    The tokenizer file's own ranks drive the faster of two public encoders; the tests compare its ids with the file's library.
    With ``added`` the file's added tokens have their own ids in a text, as in the library's own call; else they are text like any other.
    """

    def __init__(self, path: str, most: int = 700_000, added: bool = False):
        import public_tokenizers
        import tiktoken

        ranks = byte_ranks(path)
        self.tokenizer = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.most = most
        self.added = added_tokens(path) if added else {}
        self.pattern = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.before, self.after = _safe_bytes()
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, U)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _learn(self, keys: np.ndarray, body: np.ndarray, start: np.ndarray, end: np.ndarray, inner: np.ndarray) -> None:
        """Encodes chunks; those that may follow one another in a text are encoded as one."""
        order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
        middle = int(inner.sum())
        ids, size = [], np.zeros(len(keys), np.int32)
        for a in range(0, middle, 1 << 14):
            some = order[a : min(a + (1 << 14), middle)]
            n = end[some] - start[some]
            edge = np.cumsum(n)
            text = body[np.arange(edge[-1]) + np.repeat(start[some] - (edge - n), n)].tobytes().decode()
            got = self.tokenizer.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
            begin = np.cumsum(self.lengths[got]) - self.lengths[got]
            size[some] = np.bincount(np.searchsorted(edge, begin, "right"), minlength=len(some))
            ids.append(got)
        for x in order[middle:].tolist():
            got = np.array(self.tokenizer.encode_ordinary(body[start[x] : end[x]].tobytes().decode()), np.uint16)
            size[x] = len(got)
            ids.append(got)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint16)])
        at = np.empty(len(keys), np.int64)
        ordered = size[order]
        at[order] = self.used + np.cumsum(ordered) - ordered
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a large_string array without nulls, and where each text's begin."""
        if not self.pattern or not pc.any(pc.match_substring_regex(column, self.pattern)).as_py():
            return self._encode(column)
        parts, texts = [], np.zeros(len(column) + 1, np.int64)
        for i, text in enumerate(column.to_pylist()):
            parts += re.split(f"({self.pattern})", text)  # every second part is an added token
            texts[i + 1] = len(parts)
        own = np.array([self.added[t] if (i - a) % 2 else -1 for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True) for i, t in enumerate(parts[a:b], a)], np.int64)
        ids, at = self._encode(pa.array(["" if o >= 0 else t for t, o in zip(parts, own.tolist(), strict=True)], pa.large_string()))
        at, token = at + np.concatenate([[0], np.cumsum(own >= 0)]), own >= 0
        out = np.empty(at[-1], np.uint16)
        out[at[:-1][token]] = own[token]
        rest = np.ones(len(out), bool)
        rest[at[:-1][token]] = False
        out[rest] = ids
        return out, at[texts]

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        body, off = tx.raw(column)
        n = len(body)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(off), np.int64)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            tail = self.before[body]  # the byte before a space ends a visible character
            tail[1:] |= (body[:-1] == 0xC3) & (body[1:] >= 0x80)
            cut[1 : n - 1] = (body[1:-1] == 32) & tail[:-2] & self.after[body[2:]]
            lone = off[(off > 0) & (off < n)]
            cut[lone] = False
            cut[lone - 1] = False  # a space at the end of a text
        inner_start = cut.copy()
        cut[off] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        inner = inner_start[start] & np.append(inner_start[start[1:]], False)
        key = tx.word_hashes(body, start, end) ^ np.where(inner, U(0), U(0x9E3779B97F4A7C15))
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.forget()
        where = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        hit = where < len(self.keys)
        new[hit] = self.keys[where[hit]] != unique[hit]
        if new.any():
            f = first[new]
            self._learn(unique[new], body, start[f], end[f], inner[f])
            where = np.searchsorted(self.keys, unique)
        size = self.size[where][back].astype(np.int64)
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.repeat(self.at[where][back] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, off)]


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, windows: int, most_pad: int, first_id: int):
        self.length, self.windows, self.most_pad, self.next_id = length, windows, most_pad, first_id
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:
            self.emit([(doc, at, ids[at : at + self.length], total)])
            at += self.length
        while at < total:
            need = total - at
            fits = [(self.length - used, i) for i, (used, _) in enumerate(self.open) if self.length - used >= need]
            if fits:
                _, i = min(fits)
                used, pieces = self.open[i]
                pieces.append((doc, at, ids[at:], total))
                self.open[i] = (used + need, pieces)
                if used + need == self.length:
                    self.emit(self.open.pop(i)[1])
                return
            if len(self.open) < self.windows:
                self.open.append((need, [(doc, at, ids[at:], total)]))
                return
            used, i = max((used, -i) for i, (used, _) in enumerate(self.open))
            used, pieces = self.open.pop(-i)
            gap = self.length - used
            if gap > self.most_pad:
                pieces.append((doc, at, ids[at : at + gap], total))
                at += gap
            self.emit(pieces)

    def finish(self) -> None:
        """Merges the open windows; the end of the last is cut at powers of two."""
        pieces = [p for _, window in sorted(self.open, key=lambda w: -w[0]) for p in window]
        left = sum(len(p[2]) for p in pieces)
        self.open = []
        while left:
            room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, total = pieces.pop(0)
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self.emit(window)

    def take(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(kinds)
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
        self.rows = []
        return out


_encoders: dict[str, ChunkEncoder] = {}


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, windows: int, most_pad: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoders.get(path) or _encoders.setdefault(path, ChunkEncoder(path, added=True))
    packer = Packer(length, windows, most_pad, TaskContext.get().partitionId() << 32)
    for batch in batches:
        texts = tx.strings(batch.column(1))
        for a, b in tx.slices(texts):
            ids, at = encoder.encode(texts.slice(a, b - a))
            for doc, s, e in zip(batch.column(0).slice(a, b - a).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.empty(e - s + 1, "<u4")
                own[:-1], own[-1] = ids[s:e], end_id
                packer.add(doc, own)
            yield packer.take()
    packer.finish()
    yield packer.take()


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, windows: int = 16, most_pad: int = 0) -> DataFrame:
    """Packs every row's token ids, each followed by end_id, into sequences of at most ``length`` tokens.

    Ids are those of the tokenizer file's library without special tokens added: a text's own ``<|endoftext|>`` is one token.
    Returns the pieces: doc_id, start (the row's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens (with the end),
    sequence_id, offset (in the sequence, gapless from 0). A null or empty text is its end alone; null ids stay null; repeated rows are packed
    each. Every id is in exactly one piece, and every sequence has ``length`` tokens less at most ``most_pad``, or a power of two. Other columns are
    not read. ``tokenizer_path`` must be readable where the tasks run; ids must be below 65536.
    """
    run = partial(_pack, path=tokenizer_path, end_id=end_id, length=length, windows=windows, most_pad=most_pad)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(mapped, run, PIECES)
