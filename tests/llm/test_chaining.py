import collections

import numpy as np
import pytest

from loomgraph.llm.chaining import _scan, align, chain, passages, repeats, seeds

from .conftest import words


def test_windows_have_seeds():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    at = np.array([0, 10, 2000, 2016, 5000])
    got = set(seeds(h, at).tolist())
    assert all(any(i + t in got for t in range(16)) for a, b in zip(at[:-1], at[1:], strict=True) for i in range(a, b - 15))
    assert {i for i in range(5000) if h[i] % np.uint64(4) == 0} <= got


def test_scan_equals_tree_chain():
    rng = np.random.default_rng(1)
    for _ in range(50):
        p = np.cumsum(rng.choice([1, 3, 8, 20, 40], 30))
        q = np.cumsum(rng.choice([1, 3, 8, 20, 40], 30))
        begin = np.flatnonzero(_scan(p, q, np.arange(30) == 0))
        scan = {tuple(x.tolist()) for x in np.split(np.arange(30), begin[1:])}
        tree = [x.tolist() for x in chain(p, q)]
        assert all(any(set(t) <= set(s) for s in scan) for t in tree)  # the tree's chains may end at their best score


def test_align_goes_on_behind_left_out_and_inserted_words():
    a = np.arange(200, dtype=np.uint64)
    b = np.concatenate([np.arange(40), [900], np.arange(40, 90), np.arange(92, 130), [901], np.arange(131, 200)]).astype(np.uint64)
    start, end, s, e, agree = align(a, b, np.array([60, 75]), np.array([61, 76]))
    assert start <= 21 and end >= 119 and (s, e) == (start, end - 1) and agree > 0.95


def test_passage_hashes_are_equal_for_equal_runs():
    h = np.array([5, 6, 7, 8, 9, 6, 7, 8, 1], np.uint64)
    got, own, place = passages(h, np.array([0, 5, 5, 9]), 3)
    assert own.tolist() == [0, 0, 0, 2, 2] and place.tolist() == [0, 1, 2, 0, 1]
    assert got[1] == got[3] and len(set(got.tolist())) == 4


def fill(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def edited(rng, passage, every):
    """Every so many words one is replaced, left out, or gets another one beside it."""
    out = []
    for i, w in enumerate(passage):
        if i % every == every - 1:
            out += [[], fill(rng, 1), [w, *fill(rng, 1)]][rng.integers(3)]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize(("every", "least"), [(10, 0.95), (8, 0.9)])
def test_edited_passages_are_found(spark, every, least):
    rng = np.random.default_rng(every)
    rows, planted = [], {}
    for i in range(200):
        passage = fill(rng, 70)
        rows.append((i, " ".join([*fill(rng, 60), *passage, *fill(rng, 60)])))
        rows.append((1000 + i, " ".join([*fill(rng, 60), *edited(rng, passage, every), *fill(rng, 60)])))
        planted[1000 + i] = i
    got = {(r["doc_id"], r["source_id"]) for r in repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= set(planted.items()) and len(got) >= least * len(planted)


def brute_cover(rows, n):
    """Words of each document in a run of n words that an earlier document, or an earlier place, holds."""
    seen, cover = set(), collections.defaultdict(set)
    for d, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                cover[d].update(range(i, i + n))
            seen.add(g)
    return cover


@pytest.mark.parametrize("parts", [1, 5])
def test_exact_passages_of_many_pieces_are_covered(spark, parts):
    """Passages out of a few sentences, in all orders, so their seeds have other first and preceding holders than the whole."""
    rng = np.random.default_rng(3)
    sentence = [fill(rng, n) for n in (18, 22, 25, 30, 12, 50)]
    rows = []
    for d in range(120):
        text = fill(rng, int(rng.integers(0, 30)))
        for s in rng.permutation(6)[: rng.integers(1, 5)]:
            text += sentence[s]
        rows.append((d, " ".join(text + fill(rng, 5))))
    rows += [(200, " ".join("a b " * 60)), (201, " ".join(["x"] * 49)), (202, " ".join(fill(rng, 50)))]
    rows.append((203, rows[-1][1]))
    found = repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    got = collections.defaultdict(set)
    for r in found:
        assert r["end_word"] - r["start_word"] >= 50 and r["agreement"] >= 0.8
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    want = brute_cover(rows, 50)
    assert all(got[d] >= w for d, w in want.items())
    assert 201 not in got and got[203] == set(range(50))
