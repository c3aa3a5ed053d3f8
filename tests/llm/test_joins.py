import collections

import numpy as np
import pytest

from loomgraph.llm.chaining import align, chain, repeats, without_repeats
from loomgraph.llm.components import components
from loomgraph.llm.jaccard_join import Region, jaccard_join
from loomgraph.llm.threshold_search import threshold_search

from .conftest import words

SF = "/root/testdata/sf0.001"


def brute_links(rows, percent=80):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root, links = {d: d for d in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), links[d]) for d in sets}


@pytest.mark.parametrize("cap", [4096, 2])
def test_jaccard_join_is_exact(spark, cap):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join(docs, cap=cap).collect()}
    assert got == brute_links([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_jaccard_join_edges(spark, odd_docs):
    rows = jaccard_join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 and by[11]["component_id"] == 1 and by[7]["component_id"] == 6
    assert all(by[d]["n_shingles"] == 0 and by[d]["component_id"] == d and by[d]["n_links"] == 0 for d in (3, 4, 5))
    assert by[None]["component_id"] is None
    assert jaccard_join(odd_docs.limit(0)).count() == 0


def test_region_divides_like_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 120).astype(np.uint64)
    sets = []
    for _ in range(700):  # over a leaf, so pivots divide it
        s = base.copy()
        s[rng.random(120) < rng.random() * 0.25] = rng.integers(0, 1 << 40)
        sets.append(np.unique(s))
    pairs = Region(sets).links(np.arange(700), 80)
    want = [i << 32 | j for i in range(700) for j in range(i + 1, 700) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    assert sorted(pairs.tolist()) == sorted(want)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 1), (9, 10), (10, 11), (11, 12), (12, 13)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), *((n, 9) for n in range(9, 14))}
    assert components(edges.limit(0)).count() == 0


def test_chain_follows_both_orders():
    p, q = np.array([0, 5, 10, 12, 20]), np.array([3, 8, 13, 2, 23])
    best = max(chain(p, q), key=len)
    assert best.tolist() == [0, 1, 2, 4]


def test_align_grows_and_counts():
    a, b = np.arange(100, dtype=np.uint64), np.arange(100, dtype=np.uint64)
    b[50] = 999
    assert align(a, b, np.array([30, 60]), np.array([30, 60])) == (0, 100, 0, 100, 0.99)


def test_repeats_cover_shared_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = repeats(docs)
    cover = collections.defaultdict(set)
    for r in found.collect():
        assert r["source_id"] <= r["doc_id"] and r["end_word"] - r["start_word"] >= 50 and r["agreement"] >= 0.8
        cover[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    seen, missed, need = {}, 0, 0
    for d, t in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        w = words(t)
        for i in range(len(w) - 54):
            g = tuple(w[i : i + 55])
            if g in seen:
                need += 1
                missed += not any(x in cover[d] for x in range(i + 10, i + 45))
            else:
                seen[g] = d
    assert need and not missed


def test_repeats_whose_seeds_have_other_partners(spark):
    rng = np.random.default_rng(5)
    fill = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    one, two = fill(30), fill(30)
    beside = lambda *parts: " ".join([fill(40), *parts, fill(40)])
    rows = [(1, beside(one)), (2, beside(two)), (3, beside(one, two)), (4, beside(one)), (5, beside(two)), (6, beside(one, two))]
    for parts in (1, 4):  # all in one slice, and apart
        got = repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")).collect()
        assert [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"]) for r in got] == [(6, 3, 40, 100)]


def test_cut_repeats(spark, odd_docs):
    found = repeats(odd_docs)
    kept = {(r["doc_id"], r["text"]) for r in without_repeats(odd_docs, found).collect()}
    texts = dict(kept)
    assert without_repeats(odd_docs, found).columns == odd_docs.columns
    assert texts[1].startswith("alpha beta") and len(texts[2].split()) < 10 and texts[3] is None and texts[12].split() == [f"tok{i}" for i in range(300)]
    assert texts[13].split() == [f"tok{i}" for i in range(300, 340)]
    assert repeats(odd_docs.limit(0)).count() == 0


def test_threshold_search_is_exact(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e = e.unionByName(e.limit(40).withColumn("vec_id", e["vec_id"] + 100_000))  # equal vectors
    got = {tuple(r) for r in threshold_search(e, e.filter("vec_id % 50 = 0"), 5).collect()}
    pdf = e.toPandas()
    v, ids = np.floor(256 * np.stack(pdf["embedding"]).astype(float)).astype(int), pdf["vec_id"].to_numpy()
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = v @ v[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:5]
        want |= {(int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)}
    assert got == want


def test_threshold_search_edges(spark):
    rows = [(0, [0.0, 0.0], 1), (1, [1.0, None], 1), (2, None, 1), (3, [float("nan"), 0.0], 1), (4, [0.5], 1), (None, [1.0, 1.0], 1), (50, [1.0, 1.0], 1), (7, [], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in threshold_search(e, e.filter("vec_id % 50 = 0"), 5).collect()}
    assert got == {(0, 1, 4, 0), (0, 2, 7, 0), (0, 3, 50, 0), (50, 1, 4, 128 * 256), (50, 2, 0, 0), (50, 3, 7, 0)}
    assert threshold_search(e.limit(0), e.limit(0), 5).count() == 0


def test_threshold_search_repeated_ids_and_large_components(spark):
    big, odd = float(2**33) / 256, float(2**21) / 256
    rows = [(0, [big, 1 / 256]), (1, [odd, 0.0]), (2, [odd, 1 / 256]), (50, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in threshold_search(e, e.filter("vec_id % 50 = 0"), 20).collect()]
    v = [[int(x * 256) for x in r[1]] for r in rows]
    want = []
    for i, (q, _) in enumerate(rows):
        if q % 50 == 0:
            order = sorted((-(v[i][0] * v[j][0] + v[i][1] * v[j][1]), rows[j][0]) for j in range(len(rows)) if j != i)
            want += [(q, n + 1, d, -s) for n, (s, d) in enumerate(order)]
    assert sorted(got) == sorted(want)
    assert (0, 1, 2, 2**54 + 1) in got and (0, 2, 1, 2**54) in got
