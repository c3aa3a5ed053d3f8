import hashlib
import zlib
from collections import defaultdict

import pytest
from loomgraph.llm import merkle
from pyspark.sql import functions as F

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(row, **other):
    values = [other.get(f, row[f]) for f in FIELDS]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """Root, and for each leaf its path of (left, right) siblings, by the definition."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            first = at[i] - at[i] % fanout
            path.append(("".join(nodes[first : at[i]]), "".join(nodes[at[i] + 1 : first + fanout])))
            at[i] //= fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def by_hand(rows, fanout=3):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in ordered[s]], fanout) for s in sources}
    root, upper = tree([trees[s][0] for s in sources], fanout)
    out = []
    for s, above in zip(sources, upper, strict=True):
        for r, path in zip(ordered[s], trees[s][1], strict=True):
            proof = path + above
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf(r, text=r["text"].replace("\n", "")) if hit else leaf(r)
            for left, right in proof:
                node = H(left, node, right)
            out.append((r["doc_id"], leaf(r), trees[s][0], root, H(*[x + y for x, y in proof]), node, node == root))
    return sorted(map(repr, out))


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def checked(docs, **how):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(docs, seen={"text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}, **how)
    return sorted(repr(tuple(r)) for r in merkle.verified(rows).select(*COLUMNS).collect())


def table(spark, sizes):
    rows, n = [], 0
    for source, count in sizes:
        for _ in range(count):
            n += 1
            rows.append((n * 7919 % 10_007, f"text {n}\nline" if n % 3 else None, "en", source, n))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("height", [0, 1, 2])
def test_rounds_of_blocks_equal_the_definition(spark, height):
    """Hot and lone sources, ragged last groups of one block, more levels than blocks, more than one round over the sources."""
    docs = table(spark, [("hot", 85), (None, 28), ("", 1), ("é", 10), ("z", 3), ("Z", 9), ("a", 82), ("b", 1), ("c", 2), ("d", 27), ("e", 4)])
    assert checked(docs, height=height) == by_hand(docs.collect())


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 55)], [("a", 1), ("b", 1)], [(None, 28), ("a", 1), ("b", 1), ("c", 1)]])
def test_small_tables(spark, sizes):
    docs = table(spark, sizes)
    assert checked(docs, height=1) == by_hand(docs.collect())


def test_wider_trees(spark):
    docs = table(spark, [("a", 70), ("b", 5), ("c", 1), ("d", 16), ("e", 17)])
    assert checked(docs, height=1, fanout=4) == by_hand(docs.collect(), 4)


def test_odd_rows_and_an_empty_table(spark, odd_docs):
    docs = odd_docs.withColumns({"key": F.lit("k"), "at": F.lit(1), "n": F.lit(2), "seen": F.lit("s"), "path": F.lit("p")})
    docs = docs.unionByName(docs.limit(5).withColumn("source", F.lit(None).cast("string"))).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")))
    assert checked(docs) == by_hand(docs.collect()) == checked(docs, height=1)
    assert merkle.tampered_manifest(docs.limit(0)).collect() == []


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = merkle.tampered_manifest(docs)
    assert sorted(repr(tuple(r)) for r in got.select(*COLUMNS).collect()) == by_hand(docs.collect())
    assert {r["verified"] for r in got.collect()} == {True, False}
