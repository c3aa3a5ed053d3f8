"""Token counts of a unigram vocabulary, without tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic programming carries the best score and how many tokens it takes. Ties are settled like in
the public unigram tokenizers: of equally good pieces that end at a place the one that starts first stays (they try starts in order and only take
what is strictly better). A character that no piece of its own covers may be an unknown one, at 10 below the lowest score; with byte fallback it counts as its
UTF-8 bytes, else a run of unknown characters is one token.

Pieces hold a space mark only at their beginning, so the best path of a text is that of its chunks (spaces and the word after them), and each distinct chunk is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.store import mapped

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def sentencepiece_vocabulary(path: str) -> tuple[dict[str, float], bool]:
    """Surface pieces and scores of a model file, and whether it has byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in plain}, any(model.is_byte(i) for i in range(model.get_piece_size()))


class Counter:
    """Counts chunks; the counts of up to ``most`` chunks are remembered."""

    def __init__(self, vocabulary: Mapping[str, float], byte_fallback: bool, most: int = 2_000_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary if len(p) == 1}
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback, self.most = byte_fallback, most
        self.whole = any(MARK in p.lstrip(MARK) for p in vocabulary) or MARK not in self.single
        self.forget()

    def forget(self) -> None:
        self.keys, self.count, self.score = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)

    def best(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path of a text (space marks included)."""
        n = len(text)
        if not n:
            return 0, 0.0
        ends: list[list] = [[] for _ in range(n)] if len(self.automaton) else []
        if len(self.automaton):
            for end, match in self.automaton.iter(text):
                ends[end].append(match)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(n):
            best = None
            options = sorted(ends[i], reverse=True) if ends else []  # earliest start first
            if text[i] not in self.single:
                options.append((1, None))
            for length, value in options:
                at = i + 1 - length
                total = score[at] + (self.unknown if value is None else value)
                if best is None or total > best:
                    best = total
                    if value is not None:
                        count[i + 1], unknown[i + 1] = count[at] + 1, False
                    elif self.byte_fallback:
                        count[i + 1], unknown[i + 1] = count[at] + len(text[i].encode()), True
                    else:
                        count[i + 1], unknown[i + 1] = count[at] + (not unknown[at]), True
            score[i + 1] = best
        return count[n], score[n]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and score of each text of a large_string array without nulls; each text but an empty one begins with a space mark."""
        if self.whole:
            found = [self.best(MARK + t.replace(" ", MARK)) if t else (0, 0.0) for t in column.to_pylist()]
            return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], float)
        body, off = tx.raw(column)
        n = len(body)
        if not n:
            return np.zeros(len(column), np.int64), np.zeros(len(column))
        cut = np.zeros(n + 1, bool)
        cut[1:n] = (body[1:] == 32) & (body[:-1] != 32)
        head = np.zeros(n + 1, bool)
        head[off] = True
        cut = (cut | head)[:n]
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        first = head[start]
        key = tx.word_hashes(body, start, end) ^ np.where(first, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        unique, place, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.forget()
        where = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        hit = where < len(self.keys)
        new[hit] = self.keys[where[hit]] != unique[hit]
        if new.any():
            at = place[new]
            found = [self.best((MARK if f else "") + body[s:e].tobytes().decode().replace(" ", MARK)) for s, e, f in zip(start[at].tolist(), end[at].tolist(), first[at].tolist(), strict=True)]
            where = np.searchsorted(self.keys, unique[new])
            self.keys = np.insert(self.keys, where, unique[new])
            self.count, self.score = np.insert(self.count, where, [f[0] for f in found]), np.insert(self.score, where, [f[1] for f in found])
            where = np.searchsorted(self.keys, unique)
        edge = np.searchsorted(start, off)
        return tx.sums(self.count[where][back], edge), tx.sums(self.score[where][back], edge)


_counters: dict[str, Counter] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counters.get(path) or _counters.setdefault(path, Counter(*sentencepiece_vocabulary(path)))
    for batch in batches:
        texts = tx.strings(batch.column(1))
        for a, b in tx.slices(texts):
            count, score = counter.texts(texts.slice(a, b - a))
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(count), pa.array(score)], ["doc_id", "n_tokens", "best_score"])


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and best_score of every row (null and empty texts: 0); repeated rows and null ids are kept, other columns are not read.

    ``vocabulary_path`` (a sentencepiece model whose scores are taken as those of a unigram vocabulary) must be readable where the tasks run. No shuffle.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(mapped, _count, "doc_id long, n_tokens long, best_score double", path=vocabulary_path)
