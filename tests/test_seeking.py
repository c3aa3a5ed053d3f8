from loomgraph.model import EDGES, NODES
from loomgraph.operators import seeking as K
from loomgraph.operators.expand import REGISTRY

PROPS = "array<struct<label:string,term:string,href:string>>"


def node(i, type_, name, uri=None, props=None, tags=("t",)):
    return (1, i, type_, name, uri or f"u{i}", 0, list(tags), [], props or {}, i)


def shown(result):
    nodes, edges = result[0].collect(), result[1].collect()
    uri = {r["id"]: r["uri"] for r in nodes}
    return {(r["uri"], r["type"], r["name"]) for r in nodes}, {(r["src"], uri[r["dst"]], r["type"]) for r in edges}


def entries(spark):
    rows = [("target", f"t{i:02}", f"Kinase alpha {i}", "Tclin") for i in range(25)] + [("target", "x", "kinase alpha", "Tdark"), ("ligand", "l1", "Kinase Alpha blocker", None), ("ligand", "l2", "alpha kinase", None), ("disease", "d1", "lung", None), ("disease", "d1", "lung", None)]
    return spark.createDataFrame(rows, "kind string, ref string, name string, level string")


def test_entry_search(spark):
    nodes = spark.createDataFrame([node(1, "query", "ignored", props={"term": 'kinase "alpha'}), node(2, "drug", "LUNG"), node(3, "query", "no term"), node(4, "drug", None)], NODES)
    n, e = shown(REGISTRY["entry_search"](nodes, {"entries": entries(spark)}))
    assert {x for x in e if x[0] == 2} == {(2, "d1", "resolve")} and ("d1", "disease", "lung") in n
    mine = {u for s, u, _ in e if s == 1}
    assert "l1" in mine and not mine & {"x", "l2"} and len([u for u in mine if u[0] == "t"]) == 20 and not any(s in (3, 4) for s, _, _ in e)


def test_links_by_their_properties(spark):
    p = lambda *pairs: [(label, term, "h" if label == K.ACTION else None) for label, term in pairs]
    links = [("t", i, "ligand", f"l{i}", p((K.ACTION, "INHIBITOR"), ("IDG Ligand", "Lig"))) for i in range(1)]
    links += [("t", 1, "ligand", "bare", []), ("t", 2, "ligand", "null", None), ("t", 3, "ligand", "other", p(("x", "y"))), ("t", 4, "disease", "ind", p((K.SOURCE, K.INDICATION), ("IDG Disease", "Dis"))), ("t", 5, "disease", "no", p((K.SOURCE, "y"))), ("t", 6, "target", "never", [])]
    links += [("d", i, "target", f"z{i:02}", p((K.LEVEL, "Tclin"))) for i in range(30)] + [("d", 99, "target", "dark", p((K.LEVEL, "Tdark"), (K.ACTION, None)))] + [("d", i, "ligand", f"y{i:02}", []) for i in range(15)]
    table = spark.createDataFrame(links, f"uri string, turn int, kind string, ref string, properties {PROPS}")
    known = spark.createDataFrame([("target", "z00", "Zero", None), ("ligand", "bare", "Bare", None), ("target", "t", "T", None), ("disease", "d", "D", None), ("ligand", "same", "Lone", None), ("ligand", "twin", "Lone", None), ("target", "not", "Lone", None)], "kind string, ref string, name string, level string")
    nodes = spark.createDataFrame([node(1, "protein", "T", "t"), node(2, "disease", "D", "d"), node(3, "drug", "Lone"), node(4, None, "Lone")], NODES)
    n, e = shown(REGISTRY["kind_links"](nodes, {"kind_links": table, "entries": known}))
    assert {x for x in e if x[0] == 1} == {(1, "l0", "inhibitor"), (1, "bare", "assertion"), (1, "null", "assertion"), (1, "ind", "indication")}
    mine = [u for s, u, _ in e if s == 2]
    assert len([u for u in mine if u[0] == "z"]) == 30 and len([u for u in mine if u[0] == "y"]) == 10 and "dark" not in mine
    assert {x for x in e if x[0] in (3, 4)} == {(3, "same", "resolve"), (3, "twin", "resolve")}
    assert {("l0", "drug", "Lig"), ("ind", "disease", "Dis"), ("z00", "protein", "Zero"), ("bare", "drug", "Bare"), ("same", "drug", "Lone")} <= n
    hrefs = {r["props"].get("href") for r in REGISTRY["kind_links"](nodes, {"kind_links": table, "entries": known})[1].collect()}
    assert hrefs == {"h", None}


def test_partners_and_texts(spark):
    nodes = spark.createDataFrame([node(1, "protein", "T", "t")], NODES)
    rows = [("t", r, i, f"{r}p{i:02}", [] if i else [(K.ACTION, "Binds", None)]) for r in ("a", "b") for i in range(12)]
    tables = {"partners": spark.createDataFrame(rows, f"uri string, record string, turn int, ref string, properties {PROPS}"), "entries": entries(spark)}
    _, e = shown(REGISTRY["partners"](nodes, tables))
    assert len(e) == 20 and {t for _, _, t in e} == {"ppi", "binds"} and (1, "ap00", "binds") in e and not any(u.endswith(("p10", "p11")) for _, u, _ in e)
    tables = {"texts": spark.createDataFrame([("t", i, 100 + i) for i in range(15)], "uri string, turn int, pmid long"), "articles": spark.createDataFrame([(100 + i, f"title {i}") for i in range(0, 15, 2)], "pmid long, title string")}
    n, e = shown(REGISTRY["gene_texts"](nodes, tables))
    assert e == {(1, f"article/{100 + i}", f"article/{100 + i}") for i in range(0, 10, 2)} and ("article/104", "article", "title 4") in n


def test_concepts_and_articles(spark):
    nodes = spark.createDataFrame([node(1, "query", None, props={"term": "Heart Attack"}), node(2, "concept", "nothing"), node(3, "drug", None)], NODES)
    tables = {
        "concept_names": spark.createDataFrame([("heart attack", "C1"), ("HEART attack", "C1"), ("heart", "C2"), (None, "C3"), ("Heart Attack", "C9")], "name string, cui string"),
        "concepts": spark.createDataFrame([("C1", "MI", ["Disease", "Acute"]), ("C2", "x", None)], "cui string, name string, semantic_types array<string>"),
        "labels": spark.createDataFrame([("Heart Attack", "D1", "Infarct"), ("heart attack", "D2", "no")], "label string, ui string, name string"),
        "articles": spark.createDataFrame([(7, "seven", "attack of the heart"), (8, "eight", "lung"), (7, "seven b", "heart heart"), (9, None, None)], "pmid long, title string, text string"),
        "article_genes": spark.createDataFrame([(7, 55, "G"), (7, 55, "G"), (8, 56, "H")], "pmid long, gene long, symbol string"),
    }
    result = REGISTRY["name_concepts"](nodes, tables)
    n, e = shown(result)
    assert n == {("C1", "concept", "MI")} and e == {(1, "C1", "resolve")}
    assert result[0].first()["tags"] == ["Acute", "Disease"] and result[1].first()["props"] == {"name": "HEART attack"}
    n, e = shown(REGISTRY["article_search"](nodes, tables))
    assert e == {(1, "D1", "D1"), (1, "article/7", "resolve"), (1, "gene/55", "resolve")} and ("article/7", "article", "seven") in n


def test_anchored_drugs(spark):
    from loomgraph.model import entity_id
    from loomgraph.operators.graph import upsert_edges, upsert_nodes
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([node(1, "drug", "Aspirin"), node(2, "drug", "none"), node(3, "protein", "aspirin")], NODES)
    edges = spark.createDataFrame([], EDGES)
    tables = {"uniis": spark.createDataFrame([("U1", "ASPIRIN", "Asp"), ("U2", None, "x")], "unii string, preferred_term string, name string"), "outcomes": spark.createDataFrame([("U1", f"o{i:02}", i, 1.0, 1.0) for i in range(14)] + [("U2", "p", 5, 1.0, 1.0)], "unii string, name string, case_count int, ror double, prr double")}
    n, e = K.anchored_drugs(nodes, edges, tables)
    assert {r["uri"] for r in n.collect()} == {"unii/U1", *(f"adverse/o{i:02}" for i in range(4, 14))} and e.count() == 11
    anchor = spark.range(1).select(entity_id(F.lit(1).cast("long"), F.lit("unii/U1")).alias("i")).first()["i"]
    assert {r["src"] for r in e.filter("type = 'assertion'").collect()} == {anchor}
    grown, joined = upsert_nodes(nodes, n.dropDuplicates(["kgraph_id", "id"]), "id"), upsert_edges(edges, e)
    n2, _ = K.anchored_drugs(grown.filter("type = 'drug' or type = 'adverse'"), joined, tables)
    assert {r["uri"] for r in n2.collect()} == {"unii/U1"}  # its section is there already
    assert all(x.count() == 0 for x in K.anchored_drugs(nodes.limit(0), edges, tables))
