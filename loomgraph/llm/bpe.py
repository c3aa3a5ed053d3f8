"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

**Sufficient lookahead.** A merge of two neighbours is decided by what stands to its right only through merges of higher priority that take (the end
of) its right part first, and those in turn only through merges of still higher priority. So with the rules in the order of their ranks,
``wait[u v] = max(wait[v], best[v])``, where ``best[v]`` is the largest ``len(w) + wait[v w]`` of the rules with left part v and a higher priority, tells how many bytes beyond its end decide
whether the merge happens; one pass over the merge list finds them. A finished token is stable when it has ``reach`` bytes after it, the same over all rules with that left part.
BPE of what follows a token doesn't depend on the token, so stable tokens are emitted and their bytes forgotten: memory is a constant of the merge list.

**Pre-tokens** (contractions, letters, numbers, other characters, each with a leading space, and white space) come from a state machine over runs of one class
of characters. What it holds back is one white space, the start of a contraction, or the start of an added token.

**Decoding** turns ids into bytes and bytes into text with a state machine that keeps an unfinished character at most.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as tx
from loomgraph.llm.packing import ChunkEncoder, _safe_bytes, added_tokens
from loomgraph.llm.store import mapped

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Ids that are decoded at once.
BLOCK = 1 << 16


class Rules:
    """Merge list and vocabulary of a byte-level BPE file.

    Every part of a rule must be a byte or the result of an earlier rule, as in any trained list; else no lookahead is known and ValueError is raised.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # fixed: how such files write bytes as characters
        code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = file["model"]["vocab"]
        self.added = added_tokens(path)
        self.bytes: dict[int, bytes] = {i: bytes(code[c] for c in t) for t, i in vocab.items() if t not in self.added} | {i: t.encode() for t, i in self.added.items()}
        self.of_byte = [vocab[c] for c, _ in sorted(code.items(), key=lambda x: x[1])]
        self.size = max(self.bytes) + 1
        #: (left, right) -> (rank, merged)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        wait = dict.fromkeys(self.of_byte, 0)  # of each token that a rule so far makes
        best: dict[int, int] = {}  # of the rules so far, by left part
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, merged = vocab[a], vocab[b], vocab[a + b]
            if left not in wait or right not in wait:
                raise ValueError(f"rule {rank} uses a token that no rule before it makes")
            self.merges[left, right] = rank, merged
            own = max(wait[right], best.get(right, 0))
            wait[merged] = max(own, wait.get(merged, 0))
            best[left] = max(best.get(left, 0), len(self.bytes[right]) + own)
        self.reach = {t: max(w, best.get(t, 0)) for t, w in wait.items()}
        #: Bytes after a token's end that always make it stable.
        self.lookahead = max(self.reach.values())
        self.longest = max(len(self.bytes[t]) for t in wait)

    def merge(self, data: bytes) -> list[int]:
        """BPE of a whole pre-token: the merge of the highest priority first, the leftmost of equals."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rules = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rules.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, merged = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two is gone
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := rules.get((merged, ids[k])):
                    heappush(heap, (r[0], i, merged, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := rules.get((ids[h], merged))):
                heappush(heap, (r[0], h, ids[h], merged, r[1]))
        return [t for t in ids if t >= 0]


def _runs():
    import regex

    return regex.compile(r"(\p{L}+)|(\p{N}+)|(\p{White_Space}+)|([^\p{White_Space}\p{L}\p{N}]+)")


class Transducer:
    """Text in blocks of any size -> token ids, each as soon as no later text can change it."""

    def __init__(self, rules: Rules, added: bool = True, window: int | None = None):
        self.rules, self.added = rules, rules.added if added else {}
        #: Bytes of an unfinished pre-token that are kept at most before stable tokens leave.
        self.window = window or max(512, 4 * (rules.lookahead + rules.longest))
        self.runs = _runs()
        self.out: list[int] = []
        self.known: dict[bytes, list[int]] = {}
        self._reset()
        self.tail = ""  # perhaps the start of an added token

    def _reset(self) -> None:
        self.piece = bytearray()  # of the pre-token that is being read, without what has been emitted
        self.kind = -1  # its class
        self.space = ""  # the last white space, held back
        self.quote = ""  # "'", or that and one more letter: perhaps a contraction

    def feed(self, text: str) -> list[int]:
        if self.added:
            text, self.tail = self.tail + text, ""
            while found := min(((at, -len(t), t) for t in self.added if (at := text.find(t)) >= 0), default=None):
                self._text(text[: found[0]])
                self._end_text()
                self.out.append(self.added[found[2]])
                text = text[found[0] + len(found[2]) :]
            keep = max((n for t in self.added for n in range(1, min(len(t), len(text) + 1)) if text.endswith(t[:n])), default=0)
            text, self.tail = text[: len(text) - keep], text[len(text) - keep :]
        self._text(text)
        return self._take()

    def finish(self) -> list[int]:
        self._text(self.tail)
        self.tail = ""
        self._end_text()
        return self._take()

    def held(self) -> int:
        """Bytes that wait for more text."""
        return len(self.piece) + len((self.space + self.quote + self.tail).encode())

    def _take(self) -> list[int]:
        out, self.out = self.out, []
        return out

    def _end_text(self) -> None:
        """The text is over: what is held is as it is."""
        if self.quote:
            self._open_quote()
        self.piece += self.space.encode()  # white space up to the end is one pre-token
        self._end_piece()
        self._reset()

    def _end_piece(self) -> None:
        if self.piece:
            data = bytes(self.piece)
            got = self.known.get(data)
            if got is None:
                got = self.rules.merge(data)
                if len(data) <= 32:
                    if len(self.known) >= 1 << 16:
                        self.known.clear()
                    self.known[data] = got
            self.out += got
            self.piece.clear()
        self.kind = -1

    def _grow(self, text: str) -> None:
        """More of the pre-token that is being read; a long one is merged window by window."""
        data = text.encode()
        for at in range(0, len(data), self.window):
            self.piece += data[at : at + self.window]
            while len(self.piece) >= self.window:
                size, used = len(self.piece), 0
                for t in self.rules.merge(bytes(self.piece)):
                    end = used + len(self.rules.bytes[t])
                    if end + self.rules.reach[t] > size:
                        break
                    self.out.append(t)
                    used = end
                del self.piece[:used]

    def _open_quote(self) -> None:
        """The held quote is no contraction: the quote begins other characters, and a letter held after it begins letters."""
        letter, self.quote = self.quote[1:], ""
        self.kind = OTHER
        self.piece += b"'"
        if letter:
            self._run(LETTER, letter)

    def _text(self, text: str) -> None:
        for found in self.runs.finditer(text):
            self._run(found.lastindex - 1, found[0])

    def _run(self, kind: int, run: str) -> None:
        """A run of characters of one class."""
        if self.quote and kind == LETTER:
            held = self.quote[1:] + run
            if len(held) == 1 and held in "rvl":
                self.quote += run
                return
            size = 1 if held[0] in "stmd" else 2 if held[:2] in ("re", "ve", "ll") else 0
            if size:
                self.quote = ""
                self.piece += ("'" + held[:size]).encode()
                self._end_piece()
                run = held[size:]
                if not run:
                    return
        if self.quote:
            self._open_quote()
        if kind == SPACE:
            if self.kind != SPACE:
                self._end_piece()
                self.kind = SPACE
            self._grow(self.space + run[:-1])
            self.space = run[-1]
            return
        if self.kind == SPACE:
            held, self.space = self.space, ""
            self._end_piece()  # white space but for the last one
            if held == " ":
                self.piece += b" "
                self.kind = kind
            elif held:
                self.piece += held.encode()
                self._end_piece()
        if self.kind != kind:
            self._end_piece()
            if run[0] == "'" and len(run) == 1:
                self.quote = run
                return
            self.kind = kind
        self._grow(run)


class Detokenizer:
    """Ids in blocks of any size -> text; holds the bytes of an unfinished character at most. Bytes that are no UTF-8 become U+FFFD as in the file's library."""

    def __init__(self, rules: Rules):
        size = np.zeros(rules.size, np.int64)
        size[list(rules.bytes)] = [len(b) for b in rules.bytes.values()]
        self.size, self.at = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(rules.bytes.get(i, b"") for i in range(rules.size)), np.uint8)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        n = self.size[ids]
        edge = np.cumsum(n)
        return self.state.decode(self.data[np.repeat(self.at[ids] - edge + n, n) + np.arange(edge[-1] if len(edge) else 0)].tobytes())

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


class ChunkTransducer(ChunkEncoder):
    """Each distinct chunk of text runs through the transducer once and is looked up afterwards; the lookup starts anew beyond ``most`` chunks."""

    def __init__(self, path: str, most: int = 500_000):
        self.rules = Rules(path)
        if self.rules.size > 1 << 16:
            raise ValueError("ids must be below 65536")
        self.tokenizer, self.machine = self, Transducer(self.rules, added=False)
        self.lengths = np.zeros(self.rules.size, np.int64)
        self.lengths[list(self.rules.bytes)] = [len(b) for b in self.rules.bytes.values()]
        self.most, self.added = most, self.rules.added
        self.pattern = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.before, self.after = _safe_bytes()
        self.forget()

    def encode_ordinary(self, text: str) -> list[int]:
        return self.machine.feed(text) + self.machine.finish()

    def encode_to_numpy(self, text: str, disallowed_special=()) -> np.ndarray:
        return np.array(self.encode_ordinary(text), np.uint32)


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_known: dict[str, tuple[ChunkTransducer, Detokenizer, list[bytes]]] = {}


def _round_trips(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _known:
        encoder = ChunkTransducer(path)
        _known[path] = encoder, Detokenizer(encoder.rules), [b"%d," % i for i in range(encoder.rules.size)]
    encoder, decoder, names = _known[path]
    for batch in batches:
        texts = tx.strings(batch.column(1))
        for a, b in tx.slices(texts):
            ids, at = encoder.encode(texts.slice(a, b - a))
            rows = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                listed, decoded = hashlib.sha256(), hashlib.sha256()
                for x in range(s, e, BLOCK):
                    block = ids[x : min(x + BLOCK, e)]
                    joined = b"".join([names[i] for i in block.tolist()])
                    listed.update(joined if x + BLOCK < e else joined[:-1])
                    decoded.update(decoder.feed(block).encode())
                decoded.update(decoder.finish().encode())
                rows.append((e - s, listed.hexdigest(), decoded.hexdigest()))
            n, listed, decoded = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], [c.split()[0] for c in ROUND_TRIP.split(", ")])


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes its ids again: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text).

    Ids are those of the tokenizer file's library with add_special_tokens=False; a text's own ``<|endoftext|>`` is one token. A null or empty text has no ids; null ids of
    documents stay null; repeated rows give a row each, an empty table none. Other columns are not read. No shuffle; ``tokenizer_path`` must be readable where the tasks run.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(mapped, partial(_round_trips, path=tokenizer_path), ROUND_TRIP)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = ChunkTransducer(path)
    for batch in batches:
        texts = tx.strings(batch.column(1))
        for a, b in tx.slices(texts):
            ids, at = encoder.encode(texts.slice(a, b - a))
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; nulls and repeats as in ``bpe_round_trip``."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(mapped, partial(_encoded, path=tokenizer_path), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decoder = Detokenizer(Rules(path))
    for batch in batches:
        texts = []
        for ids in batch.column(1):
            own = np.array(ids.values if ids.is_valid else [], np.int64)
            texts.append("".join([decoder.feed(own[x : x + BLOCK]) for x in range(0, len(own), BLOCK)]) + decoder.finish())
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids, special tokens included; null or empty ids give an empty text. An id that the vocabulary doesn't have is an error if it lies beyond it, else empty."""
    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).transform(mapped, partial(_decoded, path=tokenizer_path), "doc_id long, text string")
