import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fingerprint as fp
from loomgraph.llm import text as tx
from loomgraph.llm.brown import brown_scores
from loomgraph.llm.mixing import mix
from loomgraph.llm.packing import ChunkEncoder, pack
from loomgraph.llm.token_counts import Counter, sentencepiece_vocabulary, token_counts
from loomgraph.llm.toxicity import RANK, Machine, is_held_out, toxicity
from loomgraph.llm.url_filter import Automaton, Rule, filter_urls, site_rule

from .conftest import words

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b\n c  d é f × g  ", "", " ", " x", "it's <|endoftext|> don't\t\t x \r\n y", "日本語 テキスト　 x ünï cödé à la  carte", "x" * 3000, " a b c" * 500, "É é  é é", "a\u00a0 b \u2003c \u0085 d", "'s 't've ll 12 345.6 !!! ?"]


def test_words_and_shingles():
    texts = ["The  quick\tBrown fox", "", " a b", "ÄB ab", "x " * 7]
    w = tx.words(pa.array(texts, pa.large_string()))
    got = [[bytes(w.data[s:e]) for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [words(t) for t in texts]
    h, at = tx.sets(*tx.shingles(w.hash, w.first, 5))
    assert np.diff(at).tolist() == [1, 0, 1, 1, 1]


def test_long_words_are_hashed_alike():
    long = "q" * (tx.BLOCK + 5)
    w = tx.words(pa.array([f"{long} a {long}", long], pa.large_string()))
    assert w.hash[0] == w.hash[2] == w.hash[3] != w.hash[1]


def test_chunk_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    encoder = ChunkEncoder(BPE)
    for texts in (ODD, ODD[::-1], [" ".join(ODD)]):
        ids, at = encoder.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pack(spark, odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    docs = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = pack(docs, BPE, windows=3).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for r in docs.collect():
        got = []
        for p in sorted(by[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == len(got)
            got += np.frombuffer(p["ids"], "<u4").tolist()
        assert got == [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] and len(got) == by[r["doc_id"]][0]["doc_tokens"]
    for s in sequences.values():
        n = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == n
            n += p["length"]
        assert n <= 1024 and n & (n - 1) == 0
    assert pack(odd_docs.limit(0), BPE).count() == 0
    assert pack(odd_docs, BPE).filter("start = 0").count() == odd_docs.count()


def test_pack_knows_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    texts = [*ODD, "<|endoftext|>", "a <|endoftext|><|endoftext|>b", " <|endoftext|> ", "<|endoftext"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), BPE, length=1 << 16).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert [got[i] for i in range(len(texts))] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def test_edited_fingerprints(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(docs, bucket_bytes=20_000).collect()}
    for i, (d, text) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[d]["n_chars"] == len(text) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert fp.prints(pa.array([text], pa.large_string()))[0] == got[d]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.4 > np.mean([r["near_next"] for r in got.values()])
    odd = fp.edited_fingerprints(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r["fingerprint"] for r in odd if r["doc_id"] in (3, 4, 5)} == {""}
    assert fp.edited_fingerprints(odd_docs.limit(0)).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 64, 40_000, np.uint64))
    b = np.unique(np.concatenate([a[::2], rng.integers(0, 1 << 64, 2000, np.uint64)]))
    jaccard, inside = fp.compare(fp.sketch(b), fp.sketch(a))
    both = len(np.intersect1d(a, b))
    assert abs(inside - both / len(b)) < 0.06 and abs(jaccard - both / len(np.union1d(a, b))) < 0.06
    assert (fp.merge(fp.sketch(a), fp.sketch(b)) == fp.sketch(np.union1d(a, b))).all()
    assert (fp.decode(fp.encode(a)) == fp.sketch(a)).all()


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, fallback = sentencepiece_vocabulary(path)
    low = min(vocabulary.values())
    library = Tokenizer(models.Unigram([("<unk>", low), *vocabulary.items(), *[(f"<0x{i:02X}>", low) for i in range(256)]], 0, True))
    counter = Counter(vocabulary, fallback)
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ["  two  spaces ", "日本\U0001f600\U0001f600x", "tab\there\n"]
    count, _ = counter.texts(pa.array(docs, pa.large_string()))
    assert count.tolist() == [len(library.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) for t in docs]


def test_token_count_ties_and_unknowns():
    c = Counter({"▁": -1.0, "a": -1.0, "aa": -2.0, "b": -1.0}, False)
    assert c.texts(pa.array(["aa", "ab", "", "zz a", None], pa.large_string()).fill_null(""))[0].tolist() == [2, 3, 0, 4, 0]


def test_token_counts_of_an_empty_table(spark, odd_docs):
    got = token_counts(odd_docs.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert {"doc_id", "n_tokens"} <= set(got.columns) and got.collect() == []


def test_token_counts_query(spark, odd_docs):
    assert token_counts(odd_docs, public_tokenizers.path("piece_bpe_32k.model")).filter("doc_id in (3, 4)").agg({"n_tokens": "sum"}).first()[0] == 0


def test_brown_scores(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = brown_scores(docs, is_held_out("doc_id", 1), rounds=4).collect()
    tokens = {r["doc_id"]: [*words(r["text"]), None] for r in docs.collect()}
    count = collections.Counter(w for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    total, kinds = sum(count.values()), len(count)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    odd = brown_scores(odd_docs, is_held_out("doc_id", 1), rounds=1).collect()
    assert len(odd) == odd_docs.count() and all(np.isfinite(r["score"]) for r in odd)
    assert brown_scores(odd_docs.limit(0), is_held_out("doc_id", 1), rounds=1).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got["score"].between(0, 1).all()
    rank, bad = got["score"].rank(), got["toxic"] == 1
    n = bad.sum()
    assert (rank[bad].sum() - n * (n + 1) / 2) / (n * (len(got) - n)) > 0.85
    assert ((got["predicted"] == 1) & ~bad).sum() <= 5


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(4)
    machine = Machine(np.arange(0, 60, 2), rng.normal(0, 1, (31, RANK + 1)).astype(np.float32))
    texts = [sorted(rng.choice(60, n, replace=False).tolist()) for n in (0, 1, 2, 9, 40)]
    i, at = machine.lookup(np.array(sum(texts, []), np.int64), np.cumsum([0, *map(len, texts)]))
    got = machine.margin(i, at)[0]
    w = machine.weights.astype(float)
    for t, margin in zip(texts, got, strict=True):
        own = [x // 2 for x in t if x % 2 == 0]  # odd terms aren't among those of the machine
        pairs = sum(w[a, 1:] @ w[b, 1:] for n, a in enumerate(own) for b in own[:n])
        assert margin == pytest.approx(w[-1, 0] + sum(w[a, 0] for a in own) + pairs, abs=1e-3)


def test_machine_learns_pairs_that_weights_alone_cannot():
    """Texts with exactly one of an insult and a group mention are toxic, so neither term tells anything alone. With both among its terms the machine learns the pair; without factors it can't."""
    rng = np.random.default_rng(5)
    held = rng.random((4000, 12)) < 0.5
    label = (held[:, 0] ^ held[:, 1]).astype(float)
    i, at = np.nonzero(held)[1], np.concatenate([[0], np.cumsum(held.sum(axis=1))])

    def right(factors: bool) -> float:
        machine = Machine(np.arange(12))
        machine.weights[:, 1:] *= 10 * factors
        seen = np.full(machine.weights.shape, 1e-4, np.float32)
        for turn in range(10):
            for some in np.array_split(np.random.default_rng(turn).permutation(3000), 47):
                own = np.concatenate([[0], np.cumsum(np.diff(at)[some])])
                machine.step(np.concatenate([i[at[x] : at[x + 1]] for x in some]), own, label[some], seen, 0.1, 1e-5)
        return float(((machine.scores(i[at[3000] :], at[3000:] - at[3000]) >= 0.5) == label[3000:]).mean())

    assert right(True) > 0.95 and right(False) < 0.6


def test_toxicity_and_mixing_edges(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 1), (12, 0, 0), (None, 1, 1), (13, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity(odd_docs, labels.limit(0)).filter("score between 0 and 1").count() == odd_docs.count()
    mixed = mix(odd_docs, labels, {"high": 0.5, "low": 0.4, "toxic": 0.1}, least=1.0).collect()
    assert len(mixed) == odd_docs.count() and all(r["copies"] >= 1 for r in mixed)
    assert mix(odd_docs.limit(0), labels, {"high": 0.5, "low": 0.4, "toxic": 0.1}).count() == 0


def test_mixing_reaches_targets(spark):
    from loomgraph.llm.mixing import DOMAINS, _posteriors, domain_machines
    from loomgraph.llm.queries import TARGETS
    from loomgraph.llm.store import mapped

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machines = domain_machines(docs, labels)
    rows = docs.select("doc_id", "text").transform(mapped, _posteriors, "doc_id long, n_tokens long, p_high double, p_low double, p_toxic double", toxic=machines[0], quality=machines[1])
    start = rows.toPandas()
    now = np.array([(start["n_tokens"] * start[f"p_{d}"]).sum() for d in DOMAINS])
    goal = now / now.sum() * np.array([0.95, 1.2, 1.0])
    got = mix(docs, labels, dict(zip(DOMAINS, goal, strict=True))).toPandas()
    reached = np.array([(got["rate"] * got["n_tokens"] * got[f"p_{d}"]).sum() for d in DOMAINS])
    goal = goal / goal.sum()
    assert (got["rate"] >= 0).all() and np.abs(reached / reached.sum() - goal).max() < 2e-3 and got["missed"].max() < 1e-3
    assert mix(docs, labels, TARGETS, machines=machines).toPandas()["missed"].max() < 1e-3  # the query's own


def test_mixing_equals_least_squares_by_hand(spark, monkeypatch):
    """Targets in and out of reach, on a few documents, against many small plain steps; and the guard."""
    from loomgraph.llm import mixing

    rng = np.random.default_rng(8)
    n, p = rng.integers(1, 60, 40), rng.dirichlet([0.6, 0.6, 0.6], 40)
    p[:, 2] *= 0.02  # so little of the third domain that rates meet their bound
    p /= p.sum(1, keepdims=True)
    columns = [(i, int(n[i]), *p[i].tolist()) for i in range(40)]
    table = spark.createDataFrame(columns, "doc_id long, n_tokens long, p_high double, p_low double, p_toxic double")
    real = mixing.mapped
    monkeypatch.setattr(mixing, "mapped", lambda df, fn, schema, **how: table if fn is mixing._posteriors else real(df, fn, schema, **how))
    q = (p * n[:, None]).T @ p
    for weights, least in (((0.5, 0.45, 0.05), 0.0), ((0.1, 0.1, 0.8), 0.0), ((0.98, 0.01, 0.01), 0.0), ((0.3, 0.3, 0.4), 1.0), ((0.6, 0.0, 0.4), 0.5)):
        got = mixing.mix(table.select("doc_id", F.lit("").alias("text")), None, dict(zip(mixing.DOMAINS, weights, strict=True)), least=least, machines=(None, None), iterations=400).toPandas().sort_values("doc_id")
        reached = (got["rate"].to_numpy() * n) @ p
        start = max(1.0, least) * (n @ p)
        goal = np.array(weights) * start.sum() * (max(1.0, *(least * start[i] / start.sum() / w for i, w in enumerate(weights) if w)) if least else 1.0)
        rate = np.full(40, max(1.0, least))
        for _ in range(60_000):
            rate = np.maximum(rate - p @ np.linalg.solve(q, (rate * n) @ p - goal), least)
        best = (rate * n) @ p
        assert np.abs(reached - best).max() < 4e-3 * goal.sum() and got["rate"].min() >= least - 1e-9
        assert got["missed"].iloc[0] == pytest.approx(np.abs(reached - goal).max() / goal.sum(), abs=1e-6)
    short = mixing.mix(table.select("doc_id", F.lit("").alias("text")), None, {"high": 0.1, "low": 0.1, "toxic": 0.8}, machines=(None, None), iterations=2).toPandas()
    assert short["missed"].min() > 1e-3  # the rows say so


def test_mixing_has_no_upper_bound(spark):
    from loomgraph.llm.mixing import DOMAINS
    from loomgraph.llm.toxicity import Machine

    def machine(bias, *weights):  # of the words "bad" and "low"
        m = Machine(MARKS)
        m.weights[:] = 0
        m.weights[:-1, 0], m.weights[-1, 0] = [weights[k] for k in np.argsort(UNSORTED)], bias
        return m

    from loomgraph.llm.toxicity import terms

    UNSORTED = np.concatenate([terms(pa.array([x], pa.large_string()))[0] for x in ("bad", "low")])
    MARKS = np.sort(UNSORTED)
    docs = spark.createDataFrame([(i, "bad x" if i < 10 else "low x" if i < 20 else "good x") for i in range(1000)], "doc_id long, text string")
    machines = machine(-30.0, 60.0, 0.0), machine(30.0, 0.0, -60.0)
    for least in (0.0, 1.0):
        got = mix(docs, None, dict(zip(DOMAINS, (0.6, 0.35, 0.05), strict=True)), least=least, machines=machines).toPandas()
        reached = np.array([(got["rate"] * got["n_tokens"] * got[f"p_{d}"]).sum() for d in DOMAINS])
        assert reached / reached.sum() == pytest.approx([0.6, 0.35, 0.05], abs=0.01) and got["rate"].min() >= least


def test_globs():
    a = Automaton([Rule("1", "x", "*.a?c/**"), Rule("22", "y", "**q*"), Rule("333", "z", "." + "k" * 150 + "/**")])
    urls = [".www.abc/d", ".a/c/d", "..abc/", ".x.abcc/", ".zq", ".zq/r", "." + "k" * 150 + "/t", ".a.abc", ""]
    body = np.frombuffer("".join(urls).encode(), np.uint8)
    off = np.cumsum([0, *map(len, urls)])
    assert [a.rules[i].text if i >= 0 else None for i in a.first_match(body, off)] == ["1", None, "1", None, "22", None, "333", None, None]


def test_urls_alone_and_in_batches_are_judged_alike():
    rng = np.random.default_rng(3)
    globs = ["*.a?b/**", "**ba*", "*a**/b", ".a/**", "?b/*", "*", "." + "ab" * 70 + "**", "**"]
    a = Automaton([Rule(str(i) * (9 - i), "x", g) for i, g in enumerate(globs)])
    forms = [(r.text, re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", r.glob)))) for r in a.rules]
    urls = ["".join(rng.choice(list(".ab/"), int(n))) for n in rng.integers(0, 12, 400)] + ["", "." + "ab" * 70 + "/", "." + "ab" * 69]
    want = [next((t for t, f in forms if f.fullmatch(u)), None) for u in urls]
    for size in (1, 7, 403):
        got = []
        for i in range(0, len(urls), size):
            part = urls[i : i + size]
            found = a.first_match(np.frombuffer("".join(part).encode(), np.uint8), np.cumsum([0, *map(len, part)]))
            got += [a.rules[k].text if k >= 0 else None for k in found]
        assert got == want


def test_filter_urls_empty_table_and_very_long_urls(spark):
    rules = [site_rule("org/", "allow"), site_rule("org/b/", "block"), site_rule("com/de/", "block")]
    n = 3_000_000
    rows = [(1, "http://x.org/" + "y" * n), (2, "http://" + "y" * n + ".org/b/z"), (3, "http://" + "a." * (n // 2) + "com/de/"), (4, "http://" + "z" * n), (5, "http://x.org/b/" + "/b" * (n // 2))]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    began = time.monotonic()
    assert sorted((r.page_id, r.rule, r.verdict) for r in filter_urls(frame, rules).select("page_id", "rule", "verdict").collect()) == [
        (1, "org/", "allow"), (2, "org/b/", "block"), (3, "com/de/", "block"), (4, None, "allow"), (5, "org/b/", "block"),
    ]
    assert time.monotonic() - began < 60
    assert filter_urls(frame.limit(0), rules).collect() == []


def test_filter_urls_edges(spark):
    rules = [site_rule("org/", "allow"), site_rule("example.org/es/", "block")]
    rows = [(1, None, "x"), (2, "", "x"), (3, "no scheme.org/", "x"), (4, "http://Www.Example.ORG/es/a?b", "x"), (5, "http://example.org", "x"), (6, "http://a.com/x.org/", "x"), (7, "HTTP://org/#f", "x"), (8, "http://xorg/\n", "x"), (None, "a://b.org/y", "x")]
    got = [tuple(r) for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, canonical string"), rules).collect()]
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.org", "/es/a", "example.org/es/", "block"), (5, "example.org", "", None, "allow"),
        (6, "a.com", "/x.org/", None, "allow"), (7, "org", "/", "org/", "allow"), (8, "xorg", "/\n", None, "allow"), (None, "b.org", "/y", "org/", "allow"),
    ]


def test_op2_says_what_the_contract_says(spark, tmp_path):
    """Each rule's word, and the longest rule where several fit."""
    from loomgraph.llm.queries import op2_url_filters

    want = {"a.org/": ("org/", "allow"), "example.org/es/x": ("example.org/es/", "block"), "www.example.org/en/12": ("example.org/en/1", "block"), "example.org/en/2": ("org/", "allow"), "b.com/fr/": ("com/fr/", "allow"), "com/de/x": ("com/de/", "block"), "b.com/": (None, "allow")}
    rows = [(i, f"http://{url}", None) for i, url in enumerate(want)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op2_url_filters(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_fingerprints_keep_one_fraction(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (1, 4, 5, 30, 2000)]
    for text, got in zip(texts, fp.prints(pa.array(texts, pa.large_string())), strict=True):
        w = tx.words(pa.array([text], pa.large_string()))
        h, _ = tx.sets(*tx.shingles(w.hash, w.first, 5))
        kept = sorted({x >> 24 for x in h.tolist() if x < (1 << 64) // fp.SHARE})
        assert fp.decode(got).tolist() == kept or not kept and len(fp.decode(got)) == 1
    assert fp.likeness("", "") == (1.0, 1.0) and fp.likeness("", got) == (0.0, 0.0)


def test_likeness_is_that_of_the_sets(spark):
    """near_edited and near_next of every row against whole shingle sets; equal short texts are alike, and their fingerprints say so."""
    def shingles(text):
        w = tx.words(pa.array([text], pa.large_string()))
        return set(tx.sets(*tx.shingles(w.hash, w.first, 5))[0].tolist())

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [*map(tuple, docs), *[(-i, t) for i, t in enumerate(["hi", "hi", "ab", "ab", "ab", "", "", None, "w x", "w y", *[f"lone{i}" for i in range(40)] * 2], 1)]]
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    for i, (d, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, new, following = shingles(text), shingles(edited), shingles(after)
        for name, other, near in (("near_edited", new, like(own, new)), ("near_next", following, like(own, following))):
            assert abs(got[d][name] - near) <= (0 if own == other else 4 / max(1, len(own | other)) ** 0.5), (text, edited)
        assert (got[d]["fingerprint"] == "") == (not own)
    by_text = collections.defaultdict(set)
    for d, t in ordered:
        by_text[t].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len({x for t in by_text if t.startswith("lone") for x in by_text[t]}) == 40


def test_edited_fingerprints_of_many_ranges(spark):
    """Repeated, negative and many null ids over small ranges, against a loop."""
    import hashlib

    rng = np.random.default_rng(4)
    rows = [(int(i), f"text {i} " * int(rng.integers(0, 9))) for i in rng.integers(-40, 40, 300)] + [(None, f"none {i % 30}") for i in range(60)]
    got = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), bucket_bytes=200).collect()
    assert len(got) == len(rows)
    known = sorted([r for r in rows if r[0] is not None], key=lambda r: (-r[0], r[1]))
    last = {r["edited_sha256"] for r in got if r["doc_id"] is None}
    want = []
    for (d, t), (_, after) in zip(known[:-1], known[1:], strict=True):
        cut = len(t) // 3
        want.append((d, hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    have = collections.Counter((r["doc_id"], r["edited_sha256"]) for r in got if r["doc_id"] is not None)
    assert sum((have - collections.Counter(want)).values()) == 1 and len(last) > 1  # the lowest id is followed by a row without one


def test_single_tokens_move_where_they_are_likeliest():
    """Each token's class is the likeliest one for its places by the counts of all others, by a loop over classes and neighbours."""
    from loomgraph.llm import brown

    rng = np.random.default_rng(3)
    n = 60
    classes = rng.integers(0, brown.CLASSES, n)
    pairs = rng.integers(0, 5, (n, n)) * (rng.random((n, n)) < 0.2)
    np.fill_diagonal(pairs, 0)
    to = np.eye(brown.CLASSES)[classes]
    after, before, between = pairs @ to, pairs.T @ to, to.T @ pairs @ to
    share = (between.sum(axis=0) + 0.5) / (between.sum(axis=0) + 0.5).sum()
    row, inside, want = between.sum(axis=1), between.sum(axis=0), []
    for i, own in enumerate(classes):
        size, score = after[i].sum(), []
        for c in range(brown.CLASSES):
            mine = c == own
            x = -size * math.log(max(inside[c] + (0 if mine else size), size, 1))
            for k in range(brown.CLASSES):
                x += after[i, k] * math.log((max(between[c, k] - mine * after[i, k], 0) + brown.PRIOR * share[k]) / (max(row[c] - mine * size, 0) + brown.PRIOR))
                x += before[i, k] * math.log((max(between[k, c] - mine * before[i, k], 0) + brown.PRIOR * share[c]) / (row[k] + brown.PRIOR))
            score.append(x)
        want.append(int(np.argmax(score)))
    got = brown.best_classes(classes, before, after, between)
    assert got.tolist() == want and want != classes.tolist()


def test_rare_tokens_have_classes_of_their_own(spark, monkeypatch):
    """Rare words with the same last two bytes, one half always after ``u``, the other always after ``v``, as frequent words are: as one group they have one class, by themselves they have two, and their texts are likelier."""
    from loomgraph.llm import brown

    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'uv'[x % 2]} " + (f"word{x:05}zz" if x >= 20 else f"often{x:02}") for x in np.where(rng.random(40) < 0.2, rng.integers(0, 20, 40), rng.integers(20, 5000, 40))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for singles in (0, 7):
        monkeypatch.setattr(brown, "SINGLES", singles)
        rows = brown_scores(docs, is_held_out("doc_id", 1)).collect()
        got[singles] = [sum(r["score"] for r in rows if r["held_out"] == h) for h in (True, False)]
        assert all(np.isfinite(r["score"]) for r in rows) and len(rows) == 600
    assert got[7][0] > got[0][0] + 100 and got[7][1] > got[0][1] + 1000, got
