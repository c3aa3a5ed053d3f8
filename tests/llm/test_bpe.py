import hashlib
import itertools
import json
import random

import public_tokenizers
import pytest
from loomgraph.llm import bpe
from loomgraph.llm.queries import QUERIES
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "'", "'s", "'re", "'r", "'l", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "​", "é", "日本語", "abc", "hello", "ing", "12", "½", "²", "—", "...", "<|endoftext|>", "<|endof", "|>", "<", "x" * 40,
    "=" * 90, " " * 70, "\n" * 9, "a", "th", "\U0001f600", "́", "ª", "_",
]


@pytest.fixture(scope="module")
def rules():
    return bpe.Rules(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def streamed(rules, text, step, window):
    machine, got, most = bpe.Transducer(rules, window=window), [], 0
    for at in range(0, len(text), step):
        got += machine.feed(text[at : at + step])
        most = max(most, machine.held())
    return got + machine.finish(), most


def test_blocks_of_any_size_give_the_ids_of_the_library(rules, library):
    random.seed(3)
    for _ in range(1500):
        text = "".join(random.choice(ODD) for _ in range(random.randint(0, 30)))
        ids, _ = streamed(rules, text, random.randint(1, 20), rules.lookahead + rules.longest + 1)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        decoder, out = bpe.Detokenizer(rules), ""
        for i in ids:
            out += decoder.feed(bpe.np.array([i]))
        assert out + decoder.finish() == text == library.decode(ids, skip_special_tokens=False)


def test_memory_is_constant_in_a_long_pre_token(rules, library):
    random.seed(4)
    words = [t.decode() for t in rules.bytes.values() if t.isalpha() and t.isascii()]
    window = rules.lookahead + rules.longest + 1
    for text in ["".join(random.choice(words) for _ in range(400)) for _ in range(40)] + [c * 5000 for c in "aenxz = "] + ["".join(random.choice("ab") for _ in range(5000))]:
        ids, most = streamed(rules, text, 37, window)
        assert ids == library.encode(text, add_special_tokens=False).ids and most < window + 37 * 4


def test_lookahead_is_sufficient_on_small_merge_lists(tmp_path):
    """Every token with ``reach`` bytes after it is stable: no text of the alphabet changes it."""
    random.seed(5)
    for trial in range(25):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(random.randint(1, 7)):
            x, y = random.choice(tokens), random.choice(tokens)
            if x + y not in tokens:
                tokens.append(x + y)
                merges.append([x, y])
        shown = [chr(b) for b in range(33, 127)] + [chr(b) for b in (*range(161, 173), *range(174, 256))] + [chr(256 + i) for i in range(68)]
        vocab = {t: i for i, t in enumerate(dict.fromkeys([*tokens, *shown]))}
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}, "added_tokens": []}))
        rules = bpe.Rules(str(path))
        first = {}
        for n in range(1, 8):
            for text in map(bytes, itertools.product(b"abc", repeat=n)):
                first[text] = rules.merge(text)[0]
        for text, t in first.items():
            if len(text) < 7 and len(rules.bytes[t]) + rules.reach[t] <= len(text):
                assert all(first[text + more] == t for more in (b"a", b"b", b"c"))
    path.write_text(json.dumps({"model": {"vocab": vocab | {"abab": 900, "ab": 901}, "merges": [["ab", "ab"], ["a", "b"]]}, "added_tokens": []}))
    with pytest.raises(ValueError):
        bpe.Rules(str(path))


def test_query_and_round_trip(spark, library, odd_docs):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tables = [spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd_docs.unionByName(odd_docs.limit(1).selectExpr("14L doc_id", "'a<|endoftext|>b <|endo ' text", "lang", "source", "n_chars", "node", "bucket", "data"))]
    for docs in tables:
        want = []
        for r in docs.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        assert sorted(map(repr, map(tuple, bpe.bpe_round_trip(docs, PATH).collect()))) == sorted(map(repr, want))
        back = bpe.decode(bpe.encode(docs, PATH), PATH)
        assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((r["doc_id"], r["text"] or "")) for r in docs.collect())
    empty = tables[0].limit(0)
    assert bpe.bpe_round_trip(empty, PATH).collect() == [] and bpe.encode(empty, PATH).collect() == []
    assert QUERIES["op13_bpe_round_trip"](spark, "/root/testdata/sf0.001").count() == tables[0].count()


def test_decoding_of_broken_bytes_equals_the_library(spark, library):
    random.seed(6)
    rows = [(i, [random.randrange(256) if random.random() < 0.7 else random.randrange(50257) for _ in range(random.randint(0, 12))]) for i in range(400)]
    got = bpe.decode(spark.createDataFrame([*rows, (-1, None)], "doc_id long, ids array<int>"), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: library.decode(ids, skip_special_tokens=False) for i, ids in rows} | {-1: ""}
