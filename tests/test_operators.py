import collections
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.model import EDGES, NODES
from loomgraph.operators import annotate as A
from loomgraph.operators import concepts as C
from loomgraph.operators import expand as E
from loomgraph.operators import graph as G
from loomgraph.operators import ontology as O
from loomgraph.operators import predications as P
from loomgraph.operators import search as T
from loomgraph.operators import rounds
from loomgraph.operators import trials as R
from loomgraph.streaming import feed


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, i, "concept", n, u, 0, tags, syn, {"_h": "x", "k": n}, i) for i, (n, u, tags, syn) in enumerate([("a", "u/a", ["t"], ["s1"]), ("b", "u/b", ["t", "v"], ["s1", "s2"]), ("c", "u/c", [], ["s2"]), ("d", "u/d", ["v"], []), ("e", "u/e", [], []), ("f", None, [], [])])]
    return spark.createDataFrame(rows, NODES)


@pytest.fixture(scope="module")
def edges(spark):
    pairs = [(0, 1, "x"), (0, 1, "x"), (1, 1, "loop"), (1, 0, "y"), (2, 3, "x"), (3, 2, "x"), (1, 2, "x")]  # a parallel edge, a loop, a reversed one, an isolated node
    return spark.createDataFrame([(1, i, a, b, t, False, {"n": str(i)}, i) for i, (a, b, t) in enumerate(pairs)], EDGES)


def test_degrees_sum_to_twice_the_edges(nodes, edges):
    got = {r["id"]: r["degree"] for r in G.degrees(nodes, edges).collect()}
    assert sum(got.values()) == 2 * edges.count() and got[4] == 0


def test_upserts(spark, nodes, edges):
    again = G.upsert_nodes(nodes, nodes, "uri")
    assert again.count() == nodes.count() + 1  # the node without the key
    assert G.upsert_nodes(again.filter("uri is not null"), nodes.filter("uri is not null"), "uri").count() == 5
    assert G.upsert_edges(edges.limit(0), edges).count() == 5
    assert G.upsert_edges(edges, edges).count() == edges.count()


def test_merge_edges(spark):
    schema = "kgraph_id long, id long, src long, dst long, type string, directed boolean, props map<string,string>, seq long"
    make = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], schema)
    have = make((1, 10, 20, "t", False, {"x": "0"}, 1), (2, 10, 20, "t", False, {"key": "q", "x": "1"}, 2), (3, 30, 40, "t", False, None, 3))
    new = make(
        (11, 10, 20, "t", False, {"key": "k", "a": "1"}, 1), (12, 20, 10, "t", False, {"key": "k", "b": "2"}, 2), (13, 10, 20, "t", False, {"key": "q", "a": "9"}, 3), (14, 40, 30, "t", False, {"c": "3"}, 4),
        (15, 50, 60, "t", True, {"c": "4"}, 5), (16, 60, 50, "t", False, {"key": "z", "c": "5"}, 6), (17, 50, 60, "u", False, {}, 7),
    )
    got = {(r["id"], r["src"], r["dst"], r["type"], r["directed"]): r["props"] for r in G.merge_edges(have, new, "key").collect()}
    assert got == {
        (1, 10, 20, "t", False): {"x": "0", "key": "k", "a": "1", "b": "2"}, (2, 10, 20, "t", False): {"key": "q", "x": "1", "a": "9"}, (3, 30, 40, "t", False): {"c": "3"},
        (15, 50, 60, "t", True): {"c": "5", "key": "z"}, (17, 50, 60, "u", False): {},
    }
    assert G.merge_edges(have.limit(0), new.limit(0), "key").count() == 0


def test_merged_edges_are_shuffled_once(spark):
    """Old and new edges meet in one exchange, the result in two; edges with null ends meet none."""
    schema = "kgraph_id long, id long, src long, dst long, type string, directed boolean, props map<string,string>, seq long"
    have = spark.createDataFrame([(1, 1, 10, 20, "t", False, {"key": "q"}, 1), (1, 2, None, None, "t", False, {"key": "q"}, 2), (2, 1, 10, 20, "t", False, None, 1)], schema)
    rows = [(1, 100 + i, 10 + i % 2 * 10, 20 - i % 2 * 10, "t", False, {"key": "q" if i % 3 else f"k{i % 2}", f"p{i % 5}": str(i)}, 500 - i) for i in range(200)]
    new = spark.createDataFrame([*rows, (1, 11, None, None, "t", False, {"key": "q"}, 1), (1, 12, None, None, "t", False, {"a": "b"}, 1), (2, 13, 20, 10, "t", None, None, 9), (3, 14, 1, 2, "t", None, None, 9)], schema)
    found = G.merge_edges(have, new, "key")
    got = {(r["kgraph_id"], r["id"]): (r["src"], r["dst"], r["directed"], r["props"]) for r in found.collect()}
    last = sorted(rows, key=lambda r: (r[-1], r[1]))
    want = {"key": last[-1][6]["key"], **{k: v for r in last for k, v in r[6].items() if k != "key"}}
    assert got == {(1, 1): (10, 20, False, want), (1, 2): (None, None, False, {"key": "q"}), (2, 1): (10, 20, False, {}), (1, 11): (None, None, False, {}), (1, 12): (None, None, False, {}), (3, 14): (1, 2, None, {})}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert G.merge_edges(have, new, "key")._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_terms_of_dealt_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i % 50 or None, f"a{i % 7} b a{i % 7} {'' if i % 3 else 'long words'}") for i in range(300)] + [(1, None), (2, "")], "id int, text string")  # ids occur again
    dealt = T.dealt_texts(docs, "id", "text", 200)
    index = T.inverted_index(dealt, "id", "text")
    assert dealt.rdd.getNumPartitions() > 10 and index._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(repr, index.collect())) == sorted(map(repr, T.inverted_index(docs, "id", "text").collect())) and T.dealt_texts(docs.limit(0), "id", "text").count() == 0


def test_neighbours_and_stitching(nodes, edges):
    assert sorted(r["other"] for r in G.neighbors(edges, nodes, of=nodes.filter("id = 1")).collect()) == [0, 0, 0, 1, 2]
    assert {r["id"] for r in G.has_neighbors(nodes, edges).collect()} == {0, 1, 2, 3}
    assert {(r["src"], r["dst"], r["value"]) for r in G.stitch(nodes).collect()} == {(1, 0, "s1"), (2, 1, "s2")}


def test_graph_counts_and_removal(nodes, edges):
    assert tuple(G.graph_counts(nodes, edges).first()) == (1, 6, 7)
    assert tuple(G.graph_counts(nodes, edges, True).first()) == (1, 6, 13)
    n, e = G.remove_graph(nodes, edges, 1)
    assert n.count() == e.count() == 0
    made = G.create_graph(n, 2, "asthma", "query", {"term": "asthma"}, 5).first()
    assert made["kgraph_id"] == 2 and made["tags"] == ["KQuery"]
    assert '"_h"' not in G.entity_json(nodes).first()["json"] and '"edges"' in G.graph_json(nodes, edges).first()["json"]


def test_graph_forms(spark, nodes, edges):
    whole = json.loads(G.graph_json(nodes, edges, most=13).first()["json"])
    assert [n["id"] for n in whole["nodes"]] == [0, 1, 2, 3, 4, 5] and len(whole["edges"]) == 7
    two = nodes.unionByName(nodes.filter("id < 2").withColumn("kgraph_id", F.lit(2).cast("long")))
    got = {r["kgraph_id"]: json.loads(r["json"]) for r in G.graph_json(two, edges, most=12).collect()}
    assert got == {1: {"kgraph_id": 1, "node_count": 6, "edge_count": 7}, 2: {"kgraph_id": 2, "node_count": 2, "edge_count": 0, "nodes": [{"id": 0, "type": "concept", "name": "a"}, {"id": 1, "type": "concept", "name": "b"}]}}
    lines = G.graph_lines(two, edges.unionByName(edges)).collect()
    assert collections.Counter((r["kgraph_id"], r["part"]) for r in lines) == {(1, "graph"): 1, (2, "graph"): 1, (1, "node"): 6, (2, "node"): 2, (1, "edge"): 14}
    assert json.loads(next(r["json"] for r in lines if r["part"] == "edge" and r["id"] == 2)) == {"src": 1, "dst": 1, "type": "loop"}
    for rows in (G.graph_json(nodes.limit(0), edges.limit(0)), G.graph_lines(nodes.limit(0), edges.limit(0))):
        assert rows.count() == 0


def test_firsts_of_hot_keys_are_limited_before_the_shuffle(spark, nodes):
    plan = G.first_per_key(nodes, ["kgraph_id", "type"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan
    assert [r["id"] for r in G.first_per_key(nodes.unionByName(nodes), ["kgraph_id", "type"], "seq").collect()] == [0]


def test_edges_need_types(edges):
    assert G.valid_edges(edges).count() == 7
    with pytest.raises(Exception, match="an edge needs"):
        G.valid_edges(edges.withColumn("type", F.lit(None).cast("string"))).collect()


def test_graph_files(spark, nodes, edges, tmp_path):
    G.write_graph(nodes, edges, str(tmp_path))
    n, e = G.read_graph(spark, str(tmp_path))
    assert n.count() == 6 and e.count() == 7


def test_predications(spark):
    rows = spark.createDataFrame([("C1|C2", "t1", "TREATS", "C3", "t2", 10, 1), ("C1|C2", "t1", "TREATS", "C3", "t2", 11, 2), ("C3", "bad", "ISA", "C3", "t2", 12, 3)], "subject string, subtype string, predicate string, object string, objtype string, pmid long, sentence_id long")
    text = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "sentence_id long, sentence string")
    found = P.nested_evidence(P.with_evidence(P.predication_count(rows, 1), rows, text)).first()
    assert found["subject"] == "C1" and [e["pmid"] for e in found["evidence"]] == [10, 11]
    assert P.without_blacklisted(rows, ["bad"]).count() == 2 and P.around(rows, "C3").count() == 4
    assert {(r["kind"], r["value"]): r["n"] for r in P.summary(rows, "C3").collect()}[("pmids", "distinct")] == 3


def test_concepts(spark):
    atoms = spark.createDataFrame([("C1", "old", "A", "1", "PF", "Y", "P", 1), ("C1", "new", "A", "1", "PF", "Y", "P", 2), ("C1", "syn one", "A", "2", "VO", "N", "S", 3), ("C2", "none", "A", "3", "VO", "N", "S", 4)], "cui string, str string, sab string, scui string, stt string, ispref string, ts string, seq long")
    none = spark.createDataFrame([], "cui string, def string, sab string")
    kinds = spark.createDataFrame([("C1", "T1", "Drug")], "cui string, tui string, sty string")
    rels = spark.createDataFrame([("C1", "C2", "R1", "RO", "treats", "A", "N"), ("C1", "C2", "R2", "RO", "x", "A", "O")], "cui1 string, cui2 string, rui string, rel string, rela string, sab string, suppress string")
    got = C.assemble(atoms, none, kinds, rels).collect()
    assert len(got) == 1 and got[0]["name"] == "new" and [s["name"] for s in got[0]["synonyms"]] == ["syn one"] and len(got[0]["relations"]) == 2
    asked = spark.createDataFrame([("c1",), ("none",), ("one",)], "term string")
    assert {(r["term"], r["cui"], r["score"] is None) for r in C.find(asked, atoms, 3).collect()} == {("c1", "C1", True), ("none", "C2", True), ("one", "C1", False)}
    assert [r["type"] for r in C.expand_relations(spark.createDataFrame([("C1",)], "cui string"), rels).collect()] == ["R1"]


def test_ontology(spark):
    entries = spark.createDataFrame([("c", ["A.1.2", "B.1"]), ("p", ["A.1"]), ("t", ["A", "B"])], "ui string, tree_numbers array<string>")
    assert {tuple(r) for r in O.parent_links(entries).collect()} == {("c", "p", "A.1"), ("p", "t", "A"), ("c", "t", "B")}
    assert {tuple(r) for r in O.ancestor_links(entries).collect()} == {("c", "p", "A.1"), ("c", "t", "A"), ("p", "t", "A"), ("c", "t", "B")}
    terms = spark.createDataFrame([("HP:1", [], ["HP:9"]), ("HP:2", ["HP:9 ! old"], [])], "id string, is_a array<string>, alt_id array<string>")
    links = O.is_a_links(terms)
    assert [tuple(r) for r in links.collect()] == [("HP:2", "HP:1")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "child long, parent long")
    assert O.closure(chain).count() == 45


def test_trials(spark):
    rows = spark.createDataFrame([("d", f"e{i}", i, 1.0, 1.0) for i in range(4)], "drug string, name string, case_count int, ror double, prr double")
    assert [r["name"] for r in R.adverse_events(rows, ["drug"]).orderBy("rank").collect()] == ["e3", "e2", "e1"]
    trial = spark.createDataFrame([("n1", "u1"), ("n2", "u2")], "nct_id string, unii string")
    umls = spark.createDataFrame([("u1", "C1")], "unii string, cui string")
    near = spark.createDataFrame([("C1", "C5")], "cui string, other string")
    mesh = spark.createDataFrame([("M1", "C5", []), ("M2", "C9", ["u2"])], "ui string, cui string, regno array<string>")
    assert {tuple(r) for r in R.intervention_concepts(trial, umls, near, mesh).collect()} == {("n1", "M1"), ("n2", "M2")}


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "a red dog"), (3, "blue")], "id long, text string")
    index = T.inverted_index(docs, "id", "text")
    top = T.bm25(index, ["RED"], 3, 7 / 3, 5).collect()
    assert [r["id"] for r in top] == [1, 2]
    again = T.bm25(index, ["RED"], *T.corpus_size(docs, "text"), 5).collect()
    assert [(r["id"], r["score"]) for r in again] == [(r["id"], pytest.approx(r["score"])) for r in top]
    assert T.bm25(T.inverted_index(docs.limit(0), "id", "text"), ["RED"], *T.corpus_size(docs.limit(0), "text"), 5).count() == 0
    phrases = spark.createDataFrame([(7, "Red Dog")], "k long, p string")
    assert [tuple(r) for r in A.mentions(docs, "id", "text", phrases, "k", "p").collect()] == [(2, 7, 1)]
    texts = spark.createDataFrame([(1, "a b c d x y"), (2, "z A b, c d e f! a b c d e f"), (3, None), (4, "f f f")], "id long, text string")
    phrases = spark.createDataFrame([(1, "a b c d e f"), (2, "f"), (3, ""), (4, "b c"), (5, None), (6, "f f")], "k long, p string")
    assert {tuple(r) for r in A.mentions(texts, "id", "text", phrases, "k", "p").collect()} == {(2, 1, 2), (2, 2, 2), (4, 2, 3), (1, 4, 1), (2, 4, 2), (4, 6, 2)}


def test_expand_is_idempotent(nodes, edges, spark):
    links = spark.createDataFrame([("u/a", "target", "u/z", "z", "AGONIST"), ("u/z", "disease", "u/y", "y", None), ("u/a", "target", "u/z", "z", "AGONIST")], "uri string, kind string, ref string, name string, action string")
    n, e = E.expand(nodes, edges.limit(0), {"links": links}, ["links"], rounds=5)
    assert n.count() == 8 and {r["type"] for r in e.collect()} == {"agonist", "assertion"}
    n2, e2 = E.expand(n, e, {"links": links}, ["links"])
    assert n2.count() == 8 and e2.count() == 2


def test_every_expander(nodes, edges, spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "links": make([("u/a", "target", "l1", "n", None)], "uri string, kind string, ref string, name string, action string"),
        "relations": make([("u/a", "R1", "treats", "C9", "n")], "uri string, rui string, label string, cui string, name string"),
        "predications": make([("u/a", "ISA", "C8", "n", 5)], "uri string, predicate string, object string, name string, pmid long"),
        "outcomes": make([("A", "pain", 3, 2.0, 1.0), ("A", "none", 0, 2.0, 1.0)], "drug string, name string, case_count int, ror double, prr double"),
        "headings": make([("u/b", "D1", "Asthma")], "uri string, ui string, name string"),
        "drugs": make([("u/a", [("Swiss-Prot", "P", "Q1", ["binder", "x"]), ("TrEMBL", "N", "Q2", ["x"]), ("Swiss-Prot", "N", "Q3", None)])], "uri string, targets array<struct<source:string,name:string,uniprot:string,actions:array<string>>>"),
        "mechanisms": make([("u/b", '"Kinase X inhibitor"', "T1", '"INHIBITOR"')], "uri string, mechanism_of_action string, target_id string, action_type string"),
        "publications": make([("7", "t1", "n")], "pmid string, ref string, name string"),
        "interactions": make([("u/none", 1, "d1", "n", "x")], "uri string, turn int, ref string, name string, description string"),
        "keywords": make([("c", "K1", "n", ["x", "y"])], "keyword string, clique string, name string, categories array<string>"),
    }
    n, e = E.expand(nodes, edges.limit(0), tables, sorted(name for name, f in E.REGISTRY.items() if f.__module__ == E.__name__))
    assert n.count() == 14 and e.count() == 8 and n.filter("type = 'x;y'").count() == 1
    assert {(r["name"], r["uri"]) for r in n.filter("type = 'protein'").collect()} == {("P", "drugbank/Q1"), ("Kinase X", "target/T1")} and {"binder", "INHIBITOR"} <= {r["type"] for r in e.collect()}


def test_rules_by_type(spark, nodes, edges):
    given = E.dispatched(nodes, {"none of these": ["links"]}, ["keywords"])
    assert given["links"].count() == 0 and given["keywords"].count() == nodes.filter("name is not null").count()
    links = spark.createDataFrame([("u/a", "target", "u/z", "z", "AGONIST")], "uri string, kind string, ref string, name string, action string")
    kind = nodes.filter("uri = 'u/a'").first()["type"]
    grown, _ = E.expand(nodes, edges.limit(0), {"links": links}, [], rules={kind: ["links"]})
    same, _ = E.expand(nodes, edges.limit(0), {"links": links}, [], rules={"none of these": ["links"]})
    assert grown.count() == nodes.count() + 1 and same.count() == nodes.count()


def test_feed(spark, nodes, tmp_path):
    after = nodes.filter("id != 0").withColumn("name", F.when(F.col("id") == 1, "B").otherwise(F.col("name")))
    events = feed.changes(nodes, after, "knode")
    assert {(r["oper"], r["entity_id"]) for r in events.collect()} == {("DELETE", 0), ("UPDATE", 1)}
    assert feed.changes(nodes.limit(0), nodes.limit(0), "knode").count() == 0
    turned = nodes.withColumn("props", F.map_from_entries(F.reverse(F.map_entries("props"))))
    assert feed.changes(nodes, turned, "knode").count() == 0
    moved = feed.changes(nodes.filter("id = 5").withColumn("name", F.lit("f")).withColumn("uri", F.lit(None)), nodes.filter("id = 5").withColumn("name", F.lit(None)).withColumn("uri", F.lit("f")), "knode")
    assert [tuple(r) for r in moved.collect()] == [(1, "knode", "UPDATE", 5)]
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    feed.publish(stream, str(tmp_path / "out"), str(tmp_path / "c1"), "knode").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    seen = []
    feed.subscribe(stream, str(tmp_path / "c2"), lambda batch, _: seen.append(batch.count()), "kedge").awaitTermination()
    assert sum(seen) == 0


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = feed.windowed_counts(stream, "ts", ["event_type"], "1 hour", late="100 days").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("windows").collect()) == sorted(feed.windowed_counts(rows, "ts", ["event_type"], "1 hour").collect())
    once = feed.deduplicated(stream, ["event_id"], "ts").writeStream.format("memory").queryName("once").start()
    once.processAllAvailable()
    once.stop()
    assert spark.table("once").count() <= rows.count()


def test_tasks_hold_no_more_for_more_rows(spark, monkeypatch):
    """Summaries and trials deal their rows by number: more rows are more parts, with the same result."""
    rows = spark.createDataFrame([(str(i % 5), "t", "p" + str(i % 2), f"C{i % 3}", "u", str(i % 7)) for i in range(200)], "subject string, subtype string, predicate string, object string, objtype string, pmid string")
    trial, one = rows.select("pmid", "subject").toDF("nct_id", "unii"), lambda a, b, c: spark.createDataFrame(b, f"{a} string, {c} string")
    umls, near, mesh = one("unii", [("1", "c1"), ("2", "c2")], "cui"), one("cui", [("c1", "c3")], "other"), spark.createDataFrame([("M1", "c3", ["4"])], "ui string, cui string, regno array<string>")
    ask = lambda: (P.summary(rows), R.intervention_concepts(trial, umls, near, mesh))
    want = [sorted(map(tuple, df.collect())) for df in ask()]
    monkeypatch.setattr(rounds, "TASK_ROWS", 5)
    found = ask()
    assert [sorted(map(tuple, df.collect())) for df in found] == want and all(want)
    assert ", 40)" in found[1]._jdf.queryExecution().executedPlan().toString() and ", 80)" in found[0]._jdf.queryExecution().executedPlan().toString()
