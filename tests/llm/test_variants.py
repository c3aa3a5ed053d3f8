import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from loomgraph.llm import variants
from loomgraph.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(rows, every=31):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edits(word):
    """Deletions, each with its place: two words are near if one is a deletion of the other, or if both have the same at one place."""
    return [(i, word[:i] + word[i + 1 :]) for i in range(len(word))]


def forms_by_hand(n, times=10):
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i, d in edits(w):
            holes[i, d].add(w)
            if d in n:
                near[w].add(d)
                near[d].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    root = {}
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        root[w] = r
    return sorted((w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_typo_runs_of_odd_texts():
    random.seed(1)
    texts = ["", "ABCDEFGHIJ abcdefg", "Éàçüö×÷ÿÀé Straße", "日本語abcdefgh日本語", "x" * 300 + " " + "é" * 200, "aĀbcdefghi", "¿abcdefghÀ"] + ["".join(random.choice("abcÉé ×Z-") for _ in range(400)) for _ in range(60)]
    for every in (1, 2, 31):
        have, want = variants.typo_runs(pa.array(texts, pa.large_string()), [*range(len(texts) - 1), None], every=every).to_pylist(), []
        for doc, text in zip([*range(len(texts) - 1), None], texts, strict=True):
            for run in RUN.findall(text):
                run = run.translate(LOWER)
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want += [run] * (len(run) >= 7)
        assert have == want


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_near_words_of_dense_vocabularies(spark, monkeypatch, parts):
    """Few letters and many neighbours, a hot prefix over many ranges, very long words, repeated letters, letters beyond the first plane."""
    random.seed(parts)
    letters = "abé\U0001f600"
    vocabulary = {"".join(random.choice(letters) for _ in range(random.randint(7, 9))) for _ in range(1500)}
    vocabulary |= {"commonprefix" + "".join(random.choice("abc") for _ in range(random.randint(1, 5))) for _ in range(250)}
    vocabulary |= {"a" * n for n in range(7, 20)} | {"z" * 700 + x for x in ("", "a", "b", "ab")} | {"y" + "z" * 700, "z" * 350 + "q" + "z" * 350, "q" * 3000, "q" * 2999}
    n = {w: random.choice([2, 3, 5, 20, 50, 300, 5000]) for w in vocabulary}
    monkeypatch.setattr(variants, "RANGE_WORDS", max(1, 2 * len(n) // parts))
    monkeypatch.setattr(variants, "CUT", 16)
    words = spark.createDataFrame([*n.items()], "word string, n long")
    assert got(variants.spelling_variants(words)) == forms_by_hand(n)


def test_routing_leaves_out_ranges(spark):
    """A hot prefix over many ranges: a word goes to those within one edit, not to all."""
    words = sorted("f" + "prefixes" + a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")
    ranges = variants.Ranges([(i, words[i * 8], words[i * 8 + 7]) for i in range(64)])
    key, part = ranges.of(words)
    asked = defaultdict(set)
    for k, p in zip(key.tolist(), part.tolist(), strict=True):
        asked[k].add(p)
    assert all(i // 8 in asked[i] for i in range(len(words))) and max(map(len, asked.values())) < 30


def test_query_odd_and_empty_tables(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = words_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")) == forms_by_hand(n)
    n = words_by_hand([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert n and got(variants.spelling_variants(variants.typo_words(odd_docs))) == forms_by_hand(n)
    assert got(variants.spelling_variants(variants.typo_words(odd_docs.limit(0)))) == []


def test_ties_and_chains(spark):
    n = {"abcdefg": 2, "abcdefgh": 30, "abcdefgi": 30, "abcdefghi": 400, "abcdefghij": 5000, "zzzzzzz": 9}
    rows = got(variants.spelling_variants(spark.createDataFrame([*n.items(), (None, 7), ("", 8)], "word string, n long")))
    assert rows == forms_by_hand(n) and rows[0] == ("abcdefg", "abcdefgh", "abcdefghij", 2, 2, 30)
