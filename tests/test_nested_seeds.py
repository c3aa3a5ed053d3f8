from pyspark.sql import functions as F

from loomgraph.model import EDGES, NODES
from loomgraph.operators import expand as E
from loomgraph.operators import nested as N
from loomgraph.operators import seeds as S


def test_nested_entries(spark):
    nodes = spark.createDataFrame([("D1", "d", "Descriptor"), ("M1", "m", "Concept"), ("M2", "k", "Concept"), ("T1", "t", "Term"), ("T2", "u", "Term"), ("S1", "s", "SupplementalDescriptor"), ("A1", "a", None)], "ui string, name string, kind string")
    edges = spark.createDataFrame([
        ("D1", "M1", "concept", True, None, None), ("D1", "M2", "concept", False, None, None), ("M2", "M1", "concept", None, "NRW", None), ("M1", "T2", "term", True, None, None), ("T1", "M1", "term", None, None, None), ("S1", "D1", "mapped", None, None, ["q"]),
        ("S1", "D1", "indexed", None, None, None), ("A1", "S1", "substance", None, None, None)], "src string, dst string, type string, preferred boolean, scope string, qualifiers array<string>")
    records, rest = N.nested_entries(nodes, edges)
    rows = {r["ui"]: r for r in records.collect()}
    assert len(rows) == 7 and rest.count() == 0
    d = rows["D1"]["concepts"]
    assert [(c["ui"], c["preferred"], [tuple(x) for x in c["relations"]], [tuple(x) for x in c["terms"]]) for c in d] == [("M1", True, [("M2", "k", "NRW")], [("T1", "t", None), ("T2", "u", True)]), ("M2", False, [], [])]
    assert [tuple(x) for x in rows["S1"]["mapped"]] == [tuple(x) for x in rows["S1"]["indexed"]] == [("D1", "d")] and [tuple(x) for x in rows["S1"]["actions"]] == [("A1", "a")] and rows["T1"]["concepts"] == []
    assert [tuple(x) for x in rows["A1"]["substances"]] == [("S1", "s")]

    records, rest = N.nested_entries(nodes, edges, most=1)
    assert {(r["ui"], r["part"], r["other"]) for r in rest.collect()} == {("D1", "concept", "M1"), ("D1", "concept", "M2"), ("M1", "term", "T1"), ("M1", "term", "T2")}
    assert {r["ui"]: r["concepts"] for r in records.collect()}["D1"] is None
    assert [r["ui"] for r in N.by_label(records).collect()] == ["D1", "S1", "M1", "M2", "T1", "T2", "A1"] and N.entry(records, "S1").count() == 1
    assert all(df.count() == 0 for df in N.nested_entries(nodes.limit(0), edges.limit(0)))


def test_nested_predications(spark):
    rows = spark.createDataFrame([
        (1, 10, "C1|9", "aa", "TREATS", "C2", "bb", 7), (1, 10, "C1|9", "aa", "TREATS", "C2", "bb", 5), (1, 10, "C1", "aa", "TREATS", "C2", "bb", 5), (1, 11, "C3", "no", "X", "C2", "bb", 5), (1, 12, "C9", "aa", "X", "C2", None, 5),
        (2, 13, "C1", None, "Y", "C2", None, 6), (3, 14, "C1", "aa", "Y", "C2", "bb", 6), (1, 15, "C1", "aa", "Y", "C2", "bb", 99), (None, 16, "C1", "aa", "Y", "C2", "bb", 5)],
        "pmid long, predication long, subject string, subtype string, predicate string, object string, objtype string, sentence_id long")
    sentences = spark.createDataFrame([(5, 2, "second"), (7, 1, "first"), (6, 1, None)], "sentence_id long, number int, sentence string")
    pmids = spark.createDataFrame([(1,), (2,), (1,), (None,)], "pmid long")
    found, many = N.nested_predications(rows, sentences, pmids, ["no"], ["C9"])
    got = {r["predication"]: [(e["number"], e["sentence"]) for e in r["evidence"]] for r in found.collect()}
    assert got == {10: [(1, "first"), (2, "second")], 13: [(1, None)]} and many.count() == 0
    found, many = N.nested_predications(rows, sentences, pmids, ["no"], ["C9"], most=1)
    assert {r["predication"]: r["evidence"] is None for r in found.collect()} == {10: True, 13: False} and many.count() == 2


def node(i, name="n", synonyms=(), props=None, uri=None):
    return (1, i, "drug", name, uri or f"u{i}", 0, ["t"], list(synonyms), props or {}, i)


def test_updates_in_order(spark):
    nodes = spark.createDataFrame([node(1, props={"a": "0", "b": "old"}), node(2), node(3, props=None)], NODES)
    first = spark.createDataFrame([(1, 1, "a", "x", "add", 2), (1, 1, "a", "w", "add", 1), (1, 1, "b", "p", "put", 5), (1, 2, "c", "1", "add", 1), (1, 2, "c", "1", "add", 1), (1, 9, "a", "gone", "put", 1), (1, 3, None, "v", "put", 1), (1, 3, "k", None, "put", 1)], S.UPDATES)
    second = spark.createDataFrame([(1, 1, "b", "q", "put", 1), (1, 1, "b", "tail", "add", 2), (1, 1, "a", "y", "add", 0), (1, 2, "c", "2", "add", 0)], S.UPDATES)
    got = {r["id"]: r["props"] for r in S.update_nodes(nodes, [first, second]).collect()}
    assert got == {1: {"a": "0,w,x,y", "b": "q,tail"}, 2: {"c": "1,2"}, 3: {}}
    assert S.update_nodes(nodes.limit(0), [first]).collect() == [] and {r["id"]: r["props"] for r in S.update_nodes(nodes, [first.limit(0)]).collect()}[1] == {"a": "0", "b": "old"}


def test_drug_expanders(spark):
    nodes = spark.createDataFrame([node(1, "Asp", ["ns:CHEMBL1", "x"]), node(2, "Ibu"), node(3, None), node(4, "none")], NODES)
    edges = spark.createDataFrame([], EDGES)
    tables = {
        "forms": spark.createDataFrame([("CHEMBL1", "CHEMBL7"), ("CHEMBL1", "CHEMBL8"), ("CHEMBL5", "CHEMBL7")], "molecule string, form string"),
        "molecules": spark.createDataFrame([("CHEMBL7", "salt", None), ("CHEMBL8", None, None), ("CHEMBL9", "other", ["IBU", "ibu", None]), ("CHEMBL3", None, ["ibu"]), ("CHEMBL4", "asp", [])], "molecule string, name string, synonyms array<string>"),
        "actions": spark.createDataFrame([("CHEMBL1", 2, '"COX inhibitor"', '"T2"', '"INHIBITOR"'), ("CHEMBL1", 1, "PGE agonist", "T1", "AGONIST")], "molecule string, seq long, mechanism string, target string, action string"),
        "targets": spark.createDataFrame([("CHEMBL1", "T2", "COX"), ("CHEMBL1", "T3", None)], "molecule string, target string, name string"),
    }
    names = ["drug_forms", "drug_actions", "drug_targets_of", "drug_search"]
    n, e = S.expand_with_updates(nodes, edges, tables, names)
    rows = {r["uri"]: r for r in n.collect()}
    assert rows.keys() == {"u1", "u2", "u3", "u4", "molecule/CHEMBL7", "target/T1", "target/T2", "molecule/CHEMBL9", "molecule/CHEMBL3"}
    assert rows["u1"]["props"] == {"mechanism": "PGE agonist,COX inhibitor"} and rows["u2"]["props"] == {"found": "CHEMBL3"} and rows["u4"]["props"] == {}
    assert rows["target/T2"]["name"] == "COX" and rows["molecule/CHEMBL3"]["name"] == "CHEMBL3" and rows["molecule/CHEMBL7"]["synonyms"] == ["CHEMBL7"]
    ids = {r["id"]: u for u, r in rows.items()}
    assert {(ids[r["src"]], ids[r["dst"]], r["type"]) for r in e.collect()} == {
        ("u1", "molecule/CHEMBL7", "is equivalent to"), ("u1", "target/T1", "AGONIST"), ("u1", "target/T2", "INHIBITOR"), ("u1", "target/T2", "target of"), ("u2", "molecule/CHEMBL9", "is equivalent to"), ("u2", "molecule/CHEMBL3", "is equivalent to")}
    other, _ = E.expand(nodes, edges, tables, names)  # the same by the general rounds
    assert {r["uri"]: r["props"] for r in other.collect()} == {u: r["props"] for u, r in rows.items()}
    again = S.expand_with_updates(n, e, tables, ["drug_forms", "drug_search"])
    assert again[0].count() == n.count() and again[1].count() == e.count()


def test_predications_in_a_graph(spark):
    nodes, edges = spark.createDataFrame([node(1), node(2)], NODES), spark.createDataFrame([], EDGES)
    articles = spark.createDataFrame([(1, 1, 100), (1, 2, 200)], "kgraph_id long, id long, pmid long")
    rows = spark.createDataFrame([
        (100, 1, "C1|4", "aa", "TREATS", "C2", "bb", "s1"), (100, 2, "C1", "aa", "TREATS", "C2", "bb", "s2"), (100, 3, "C1", "aa", "X", "C8", "bb", "s"), (100, 4, "C7", "aa", "X", "C2", "bb", "s"), (200, 5, "C1", "no", "X", "C2", "bb", "s"),
        (200, 6, "C2", "aa", "X", "C2", None, None), (None, 7, "C1", "aa", "X", "C2", "bb", "s")], "pmid long, predication long, subject string, subtype string, predicate string, object string, objtype string, sentence string")
    concepts = spark.createDataFrame([("C1", "one"), ("C1", "uno"), ("C2", "two"), ("C7", "seven")], "cui string, name string")
    n, e = S.add_predications(nodes, edges, articles, rows, concepts, ["no"], ["C7"])
    uri = {r["id"]: r["uri"] for r in n.collect()}
    assert sorted(uri.values()) == ["C1", "C2", "u1", "u2"] and {r["name"] for r in n.collect()} == {"n", "one", "two"}
    assert sorted((uri[r["src"]], uri[r["dst"]], r["type"], r["props"].get("context")) for r in e.collect() if r["directed"]) == [("C1", "C2", "TREATS", "s1"), ("C1", "C2", "TREATS", "s2"), ("C2", "C2", "X", None)]
    assert sorted((uri[r["src"]], r["type"]) for r in e.collect() if not r["directed"]) == [("u1", "C1"), ("u1", "C2"), ("u2", "C2")]
    again = S.add_predications(n, e, articles, rows, concepts, ["no"], ["C7"])
    assert again[0].count() == n.count() and again[1].count() == e.count()


def test_molecules_that_many_nodes_ask_for_are_made_once(spark):
    nodes = spark.createDataFrame([node(i, "Asp") for i in range(20)] + [node(30, "none"), node(31, None)], NODES)
    molecules = spark.createDataFrame([(f"CHEMBL{i}", "asp", ["ASP"]) for i in range(5)], "molecule string, name string, synonyms array<string>")
    found, edges, changes = S.drug_search(nodes, {"molecules": molecules})
    assert found.count() == 5 and edges.count() == 100 and {(r["id"], r["value"]) for r in changes.collect()} == {(i, "CHEMBL0") for i in range(20)}
    more, joined, updates = S.grown(nodes, spark.createDataFrame([], EDGES), {"molecules": molecules}, ["drug_search"])
    assert more.count() == 27 and joined.count() == 100 and len(updates) == 1


def test_gathered_counts_and_holds_in_one_pass(spark):
    """Groups are neither counted apart nor joined with their counts, a null key is a group, and dealt rows are not shuffled again."""
    rows = spark.createDataFrame([(k, v) for k in (1, 2, None) for v in range(k or 2)] + [(3, v) for v in range(50)], "k long, v long").repartition(7, "k")
    lists, many = N.gathered(rows, ["k"], F.struct("v"), "vs", most=2)
    got = {r["k"]: (r["n"], r["vs"] and [x["v"] for x in r["vs"]]) for r in lists.collect()}
    assert got == {1: (1, [0]), 2: (2, [0, 1]), None: (2, [0, 1]), 3: (50, None)}
    assert sorted(map(tuple, many.collect())) == [(3, v) for v in range(50)]
    plans = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for df in (lists, many)]
    assert all(p.count("Exchange hashpartitioning") == 1 and "Join" not in p for p in plans)


def test_drug_expanders_broadcast_nothing(spark):
    """Few columns of large tables look small: neither nodes nor what they meet go through the driver, and a target of many rows is one new node."""
    nodes = spark.createDataFrame([node(i, f"n{i}", [f"CHEMBL{i % 5}"] if i % 2 else []) for i in range(40)], NODES)
    tables = {
        "forms": spark.createDataFrame([(f"CHEMBL{i}", "CHEMBL7") for i in range(5)], "molecule string, form string"),
        "molecules": spark.createDataFrame([("CHEMBL7", "salt", None), ("CHEMBL9", "n8", ["N8"])], "molecule string, name string, synonyms array<string>"),
        "actions": spark.createDataFrame([(f"CHEMBL{i % 5}", i, '"COX inhibitor"', '"T2"', "INHIBITOR") for i in range(20)], "molecule string, seq long, mechanism string, target string, action string"),
        "targets": spark.createDataFrame([(f"CHEMBL{i}", "T3", "PGE") for i in range(5)], "molecule string, target string, name string"),
    }
    assert S.drug_actions(nodes, tables)[0].count() == 1 and S.drug_targets_of(nodes, tables)[0].count() == 1 and S.drug_forms(nodes, tables)[0].count() == 1
    for df, n in zip(S.expand_with_updates(nodes, spark.createDataFrame([], EDGES), tables, ["drug_forms", "drug_actions", "drug_targets_of", "drug_search"]), (44, 61), strict=True):
        assert len(df.collect()) == n and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_search_pairs_are_made_last(spark, monkeypatch):
    """Edges of the search by name that no other edge can equal are made of blocks of seeds and molecules, and no shuffle follows; the graph is the one that the upsert of all edges gives: with edges that are there, seeds that are molecules, seeds twice, and seeds without a graph."""
    from loomgraph.model import entity_id
    from loomgraph.operators.graph import upsert_edges

    monkeypatch.setattr(S, "SEEDS", 3)
    monkeypatch.setattr(S, "OFFERS", 2)
    ids = {i: spark.range(1).select(entity_id(F.lit(1).cast("long"), F.lit(f"molecule/CHEMBL{i}"))).first()[0] for i in (1, 2, 3)}
    nodes = spark.createDataFrame([node(i, "Asp") for i in range(10)] + [node(3, "ibu"), node(4, "Asp"), node(20, "ibu", ["CHEMBL1"]), node(ids[1], "asp"), node(ids[2], "ASP"), node(ids[3], "ibu"), node(None, "asp"), (None, *node(31, "asp")[1:])], NODES)
    tables = {
        "molecules": spark.createDataFrame([(f"CHEMBL{i}", "asp", ["ASP", "ibu"] if i % 2 else None) for i in range(5)] * 2, "molecule string, name string, synonyms array<string>"),
        "forms": spark.createDataFrame([("CHEMBL1", "CHEMBL3")], "molecule string, form string"),
    }
    names = ["drug_forms", "drug_search"]
    none = spark.createDataFrame([], EDGES)
    made = [E.REGISTRY[n](nodes, tables)[1].select(none.columns) for n in names]
    have = made[1].filter("src in (1, 2)").limit(3)
    have = spark.createDataFrame([(r["kgraph_id"], 99, r["dst"], r["src"], r["type"], False, {}, 0) for r in have.collect()] + [(1, 98, 7, 8, S.EQUIVALENT, False, {}, 0)], EDGES)
    want = upsert_edges(have, made[0].unionByName(made[1]))
    rows = lambda df: sorted(map(repr, df.select("kgraph_id", "id", "src", "dst", "type", "directed", "props").collect()))
    more, joined, _ = S.grown(nodes, have, tables, names)
    assert rows(joined) == rows(want) and len(rows(want)) > 60
    links = S.grown_links(nodes, have, tables, names)
    uris = more.select("kgraph_id", F.col("id").alias("dst"), "uri")
    assert sorted(map(repr, links.collect())) == sorted(map(repr, want.join(uris, ["kgraph_id", "dst"]).select("kgraph_id", "src", "dst", "uri", "type").collect()))
    seeds, offers = (spark.createDataFrame(r, t) for r, t in (([(1, "a", i, [1, 3] if i == 5 else None) for i in range(20)], "kgraph_id long, asked string, id long, without array<long>"), ([(1, "a", i) for i in range(6)], "kgraph_id long, asked string, dst long")))
    pairs = S._met(seeds, offers)
    assert sorted((r["id"], r["dst"]) for r in pairs.collect()) == [(i, j) for i in range(20) for j in range(6) if i != j and (i, j) not in ((5, 1), (5, 3))]
    assert pairs._jdf.queryExecution().executedPlan().toString().split("Exchange")[0].count("Generate explode") == 2  # above the last shuffle
