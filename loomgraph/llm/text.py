"""Vectorised word and shingle hashing over Arrow string columns.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes, with A-Z lower-cased. UTF-8 never uses these bytes inside a
multi-byte character, so working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer word makes the tables of powers grow.
BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(BLOCK + 1, n + 1)
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(NamedTuple):
    """The words of some texts: ``data`` bytes, ``start`` and ``end`` of each word, ``first`` word of each text (one more at the end), 64-bit ``hash``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return body, off - off[0]


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    _, off = raw(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(column: pa.Array) -> Words:
    """The words of each text of a large_string array without nulls."""
    body, off = raw(column)
    low = LOWER[body]
    n = len(low)
    solid = ~SPACE[low]
    head = np.zeros(n + 1, bool)
    head[off] = True
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1] | head[1:n]
        ends[:-1] &= ~solid[1:] | head[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    return Words(low, start, end, first, word_hashes(low, start, end))


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
        s, e = start[at], end[to - 1]
        up, down = powers(BASE, e - s), powers(INVERSE, e - s)
        run = np.zeros(e - s + 1, U)
        np.cumsum((low[s:e].astype(U) + U(1)) * up[: e - s], out=run[1:])
        out[at:to] = (run[end[at:to] - s] - run[start[at:to] - s]) * down[start[at:to] - s]
        at = to
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the index of the first of each text; a text of 1 to k-1 words gives its whole sequence as one.

    Runs come in the order of the text, so shingle i of a text starts at its word i.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    if not at[-1]:
        return np.zeros(0, U), at
    mult = powers(0xD1342543DE82EF95, k)
    if len(h) >= k:
        full = np.full(len(h) - k + 1, U(k))
        for j in range(k):
            full += h[j : len(full) + j] * mult[k - j]
        full = mix(full)
    else:
        full = np.zeros(0, U)
    where = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], count)
    long = np.repeat(n >= k, count)
    out = np.empty(at[-1], U)
    out[long] = full[where[long]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = h[first[i] : first[i + 1]]
        out[at[i]] = mix((own * mult[k : k - n[i] : -1]).sum(keepdims=True) + U(n[i]))[0]
    return out, at


def sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run, and where each begins."""
    parts = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    size = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=size[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), size


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run of values, 0 where a run is empty."""
    run = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=run[1:])
    return run[at[1:]] - run[at[:-1]]


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; equal sets have equal ids, and an empty set has 0."""
    a = sums(mix(h ^ U(0x5851F42D4C957F2D)), at)
    return np.where(np.diff(at) > 0, mix(a + np.diff(at).astype(U)), U(0)).view(np.int64)
