import collections
import math
import random
import re

import pytest
from loomgraph.operators import annotate as A
from loomgraph.operators import postings as X

WORDS = re.compile(r"[^\W_]+")
SCHEMA = "id long, text string"


def words(text):
    return WORDS.findall((text or "").lower())


def by_hand(docs, query, top):
    """BM25 of every text for one query text, by the definition."""
    texts = [(i, words(t)) for i, t in docs]
    n, sizes = sum(t is not None for _, t in docs), [len(w) for (_, w), (_, t) in zip(texts, docs, strict=True) if t is not None]
    mean = sum(sizes) / max(1, n)
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    df = collections.Counter(w for _, t in texts for w in set(t))
    scores = collections.defaultdict(float)

    def add(tf, weight):
        for i, f in enumerate(tf):
            if f:
                scores[i] += weight * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(texts[i][1]) / mean))

    query = query.strip().lower()
    if query.startswith('"'):
        p = words(query[1:].split('"')[0])
        add([sum(t[k : k + len(p)] == p for k in range(len(t) - len(p) + 1)) if p else 0 for _, t in texts], sum(idf(df[w]) for w in p))
    else:
        for w in re.findall(r"[^\W_]+\*?", query):
            tf = [sum(x.startswith(w[:-1]) if w[-1] == "*" else x == w for x in t) for _, t in texts]
            add(tf, idf(sum(f > 0 for f in tf)))
    best = sorted(((round(s, 9), texts[i][0]) for i, s in scores.items()), key=lambda x: (-x[0], x[1] is None, x[1]))
    return [(i, s) for s, i in best[:top]]


@pytest.fixture(scope="module")
def docs(spark):
    """Common and rare words, repeated and null ids, ties, nulls."""
    random.seed(2)
    pick = lambda: random.choice(["the"] * 12 + ["of"] * 6 + ["red", "dog", "cat", "rare", "redder", "red_dog", "x1", "é"])
    rows = [(random.choice([*range(40), None]), " ".join(pick() for _ in range(random.randint(0, 25)))) for _ in range(150)]
    return [*rows, *rows[:9], (None, None), (3, None), (4, ""), (50, "the cat the dog the cat the cat")]


QUERIES = ["the rare of", "the of", "red", '"the cat the"', '"the the" ignored', '"the cat the dog the cat the cat"', "re* the", "the the the dog", '"nothing here"', "missing", "", None, "*", '""', "é x1 red* of", "red_dog", "THE Rare"]


@pytest.mark.parametrize("prune", [True, False])
def test_search_equals_all_scores(spark, docs, prune):
    asked = [(i, q) for i, q in enumerate(QUERIES)]
    got = collections.defaultdict(list)
    for r in X.search(spark.createDataFrame(docs, SCHEMA), "id", "text", spark.createDataFrame(asked, "q long, t string"), "q", "t", 4, prune).collect():
        got[r["query"]].append((r["place"], r["id"], r["score"]))
    for i, q in asked:
        want = by_hand(docs, q or "", 4)
        have = sorted(got[i])
        assert [h[0] for h in have] == list(range(1, len(want) + 1))
        assert [h[2] for h in have] == pytest.approx([s for _, s in want], abs=2e-9) and [h[1] for h in have] == [w[0] for w in want], q


def test_pruned_search_reads_fewer_postings(spark, docs):
    """The postings of a frequent word are left alone where a rare one decides."""
    texts = spark.createDataFrame([(i, "the of " * 5 + ("rare rare" if i % 50 == 0 else "")) for i in range(400)], SCHEMA)
    clauses = X.parsed(spark.createDataFrame([(1, "the rare")], "q long, t string"), "q", "t")
    parts = X.clause_postings(X.positional_index(texts, "id", "text"), X.corpus_size(texts, "text"), clauses).cache()
    assert parts.filter("clause = 'the'").count() == 400
    plans = X.best_texts(clauses, parts, 3)
    assert plans.count() == 3 and {r["id"] for r in plans.collect()} == {0, 50, 100}


def test_empty_tables_and_links(spark):
    none, q = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "red")], "q long, t string")
    assert X.search(none, "id", "text", q, "q", "t", 3).collect() == [] == X.search(spark.createDataFrame([(1, "red")], SCHEMA), "id", "text", q.limit(0), "q", "t", 3).collect()
    hits = spark.createDataFrame([(1, "t2", 2.0), (1, "t1", 2.0), (1, "t3", 5.0), (2, "t9", 1.0), (2, "t3", 1.0)], "query long, id string, score double")
    up = spark.createDataFrame([("t1", "D1"), ("t2", "D1"), ("t3", "D2"), ("t9", None)], "ui string, descriptor string")
    have = spark.createDataFrame([(2, "D2"), (2, "D2")], "item long, descriptor string")
    assert sorted(map(tuple, X.new_links(hits, up, have).collect())) == [(1, "D1", "t1", 2.0), (1, "D2", "t3", 5.0)]


def leftmost_longest(t, phrases):
    out, i = [], 0
    while i < len(t):
        best = max((len(p) for p in phrases if t[i : i + len(p)] == list(p)), default=0)
        if best:
            out.append((i, i + best, " ".join(t[i : i + best])))
        i += max(1, best)
    return out


@pytest.mark.parametrize("trie_bytes", [A.TRIE_BYTES, 0])
def test_annotations(spark, docs, trie_bytes):
    """Small and large dictionaries; overlaps, nulls, repeated rows and ids, phrases of several concepts."""
    names = [(1, "The cat"), (2, "cat THE dog"), (3, "the"), (4, "of"), (5, "red dog"), (6, "dog the cat"), (7, "the cat the dog"), (1, "the  cat!"), (8, "of"), (9, None), (9, " - "), (10, "absent"), (11, "the cat the dog the bird")]
    concepts = spark.createDataFrame([(c, n, [f"t{c % 3}"] if c % 4 else None, ["s", f"s{i}"]) for i, (c, n) in enumerate(names)], "concept long, name string, semtypes array<string>, sources array<string>")
    table = spark.createDataFrame(docs, SCHEMA)
    phrases = {tuple(words(n)) for _, n in names if words(n)}
    want = collections.Counter((i, a, b, p, c) for i, t in docs for a, b, p in leftmost_longest(words(t), phrases) for c in {c for c, n in names if " ".join(words(n)) == p})
    found = A.annotations(table, ["id"], "text", concepts, trie_bytes)
    rows = found.collect()
    assert collections.Counter((r["id"], r["start"], r["end"], r["phrase"], r["concept"]) for r in rows) == want
    assert {tuple(r["sources"]) for r in rows if r["concept"] == 1} == {("s", "s0", "s7")} and {tuple(r["semtypes"]) for r in rows if r["concept"] == 4} == {()}
    assert A.annotations(table.limit(0), ["id"], "text", concepts, trie_bytes).collect() == [] == A.annotations(table, ["id"], "text", concepts.limit(0), trie_bytes).collect()
    facets = {(r["dim"], r["value"]): r["n"] for r in A.annotation_facets(found, "id").collect()}
    assert facets["concept", "3"] == len({r["id"] for r in rows if r["concept"] == 3 and r["id"] is not None})


@pytest.mark.parametrize("trie_bytes", [A.TRIE_BYTES, 0])
def test_mentions_of_repeated_and_null_ids(spark, trie_bytes):
    rows = [(1, "red dog here"), (1, "red dog here"), (None, "a red dog, red dog"), (None, None), (2, "red red red"), (3, "")]
    phrases = spark.createDataFrame([(1, "Red  Dog"), (2, "red"), (3, "red red"), (4, "red dog"), (5, None)], "k long, p string")
    got = A.mentions(spark.createDataFrame(rows, SCHEMA), "id", "text", phrases, "k", "p", trie_bytes)
    want = [(1, 1, 1), (1, 2, 1), (1, 4, 1)] * 2 + [(None, 1, 2), (None, 2, 2), (None, 4, 2), (2, 2, 3), (2, 3, 2)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_plain_queries_hand_on_only_what_may_be_best(spark, docs, monkeypatch):
    """Every text shares words with every query: a task hands on few of the pairs, and blocks of any size or a join in their place give the same rows."""
    texts = spark.createDataFrame([(i, f"the of {'red ' * (i % 7)} dog w{i % 40}") for i in range(2000)], SCHEMA).coalesce(1)
    asked = spark.createDataFrame([(i, f"the of red dog* w{i} w{i}") for i in range(30)], "q long, t string")
    clauses = X.parsed(asked, "q", "t")
    handed = []
    monkeypatch.setattr(X, "_ranked", lambda scores, top, ranked=X._ranked: handed.append(scores.count()) or ranked(scores, top))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(X.plain_search(texts, "id", "text", clauses, 3))
    assert len(want) == 90 and handed[0] < 2000 * 30 / 10
    monkeypatch.setattr(X, "CELLS", 100)
    assert rows(X.plain_search(texts, "id", "text", clauses, 3)) == want
    monkeypatch.setattr(X, "HELD", 5)
    assert rows(X.search(texts, "id", "text", asked, "q", "t", 3)) == want
