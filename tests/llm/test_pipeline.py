import collections

import corpus_pipeline
from loomgraph.llm.queries import ORACLE_SQL, QUERIES
from loomgraph.llm.store import saved

from .conftest import words

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), "stage")
        out.append((name, before.collect(), docs.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic, near, cut, mixed, packed = out
    kept = {r["doc_id"] for r in toxic[2]}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(kept) > 0.8 * len(toxic[1]) and sum(labels.get(r["doc_id"]) == 0 for r in toxic[1] if r["doc_id"] not in kept) <= 2

    ids = {r["doc_id"] for r in near[2]}
    shingles = {}
    for r in near[1]:
        w = words(r["text"])
        shingles[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    linked = lambda a, b: bool(shingles[a]) and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])
    assert all(any(linked(d, e) for e in shingles if e < d) for d in shingles if d not in ids)
    assert not any(linked(a, b) for a in ids for b in ids if a < b)

    text = {r["doc_id"]: r["text"] for r in cut[1]}
    assert all(len(r["text"]) <= len(text[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in cut[2])
    assert collections.Counter(r["doc_id"] for r in mixed[2]).keys() == {r["doc_id"] for r in mixed[1]}
    total = collections.Counter()
    for p in packed[2]:
        total[p["doc_id"]] += p["length"]
    assert total.keys() == {r["doc_id"] for r in packed[1]} and all(n >= 1 for n in total.values())


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and ORACLE_SQL.keys() <= QUERIES.keys()
    assert len(corpus_pipeline.STAGES) == 5


def test_sql_of_the_queries(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        want = con.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_stages_on_odd_tables(spark, odd_docs):
    """Clashing columns, null ids and texts, repeated rows and empty tables."""
    from pyspark.sql import functions as F

    docs = odd_docs.drop("bucket", "node", "data").withColumns({c: F.lit("keep") for c in ("toxic_score", "_text", "blank", "copies", "At", "spans", "key_hash", "bucket", "node", "h")})
    kept = " and ".join(f"{c} = 'keep'" for c in docs.columns[5:])
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, SF), "odd")
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {*range(1, 14), None}
            continue
        rows = out.collect()
        assert out.columns == docs.columns and out.filter(kept).count() == len(rows)
        by = collections.Counter(r["doc_id"] for r in rows)
        assert {3, 4, 5, None} <= by.keys()  # no text, or no id
        if name == "near_copies":
            assert by.keys() == {1, 3, 4, 5, 6, 8, 9, 10, 12, 13, None} and by[1] == 1
        if name == "mixing":
            assert by.keys() == {*range(1, 14), None}


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, SF), "none")
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)
