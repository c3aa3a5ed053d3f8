"""Record and article graphs on small tables: nulls, repeated rows, empty tables and the order of rules."""

from loomgraph.operators import records as M

RECORD = (
    "ui string, name string, kind string, concepts array<struct<ui:string,name:string,preferred:boolean,relations:array<struct<ui:string,name:string>>,terms:array<struct<ui:string,name:string,preferred:boolean>>>>, "
    "mapped array<struct<ui:string,qualifiers:array<string>>>, indexed array<struct<ui:string,qualifiers:array<string>>>"
)
ACTION = "ui string, name string, substances array<struct<ui:string,name:string>>"
ENTRY = "ui string, name string, kind string"
ARTICLE = "pmid long, title string, date date, headings array<struct<descriptor:string,major:boolean,qualifiers:array<string>>>, chemicals array<string>"


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_record_graph(spark):
    records = [
        ("D1", "fever", "Descriptor", [("C1", "fever c", True, [("C2", "NRW")], [("T1", "t", True), ("T2", "u", None)])], None, None),
        ("S1", "drug", "SupplementalDescriptor", [("C2", "drug c", None, None, None)], [("D1", ["therapy"]), ("D7", [])], None),
        ("D1", "fever", "Descriptor", [("C1", "fever c", True, None, [("T2", "u", None)])], None, None),
        (None, "lost", "Descriptor", None, None, None),
    ]
    nodes, edges = M.record_graph(spark.createDataFrame(records, RECORD), spark.createDataFrame([("D1", "other name", [("S1", None), (None, "x")])], ACTION))
    assert rows(nodes, "ui", "name", "kind") == {("D1", "fever", "Descriptor"), ("S1", "drug", "SupplementalDescriptor"), ("D7", None, None), ("C1", "fever c", "Concept"), ("C2", "drug c", "Concept"), ("T1", "t", "Term"), ("T2", "u", "Term")}
    assert rows(edges, "src", "dst", "type", "scope") == {("D1", "C1", "concept", None), ("S1", "C2", "concept", None), ("C2", "C1", "concept", "NRW"), ("C1", "T1", "term", None), ("T2", "C1", "term", None), ("S1", "D1", "mapped", None), ("S1", "D7", "mapped", None), ("D1", "S1", "substance", None)}
    assert edges.count() == 8 and edges.filter("type = 'mapped' and qualifiers = array('therapy')").count() == 1
    parts = rows(M.entry_parts(nodes, edges), "ui", "part", "other", "name")
    assert parts == {("D1", "concept", "C1", "fever c"), ("S1", "concept", "C2", "drug c"), ("C1", "relation", "C2", "drug c"), ("C1", "term", "T1", "t"), ("C1", "term", "T2", "u"), ("S1", "mapped", "D1", "fever"), ("S1", "mapped", "D7", None), ("D1", "substance", "S1", "drug"), ("S1", "action", "D1", "fever")}


def test_empty_tables(spark):
    nodes, edges = M.record_graph(spark.createDataFrame([], RECORD), spark.createDataFrame([], ACTION))
    assert nodes.count() == edges.count() == M.entry_parts(nodes, edges).count() == 0
    articles, links = M.add_articles(spark.createDataFrame([], "pmid long"), spark.createDataFrame([], ARTICLE), spark.createDataFrame([], ENTRY))
    assert articles.count() == links.count() == 0


def test_add_articles(spark):
    entries = spark.createDataFrame([("D1", "fever", "Descriptor"), ("S1", "drug", "SupplementalDescriptor"), ("Q1", "therapy", "Qualifier"), ("Q2", "genetics", "Qualifier")], ENTRY)
    heads = [("X0", True, ["Q1"]), ("*D1", True, ["Q2", "Q1", "Q9"]), ("X1", False, ["Q2"]), ("D1", False, None)]
    given = [(1, "b", None, heads, ["S1", "S9", "S1"]), (1, "c", None, None, None), (2, "known", None, heads, None), (3, None, None, None, None), (None, "x", None, heads, None)]
    articles, links = M.add_articles(spark.createDataFrame([(2,), (2,), (None,)], "pmid long"), spark.createDataFrame(given, ARTICLE), entries)
    assert rows(articles, "pmid", "title", "created") == {(1, "b", True), (2, "known", False), (3, None, True)} and articles.count() == 3
    assert {(r["pmid"], r["ui"], r["type"], r["major"], tuple(r["qualifiers"] or ())) for r in links.collect()} == {(1, "D1", "Descriptor", True, ("genetics", "therapy", "genetics")), (1, "S1", "SupplementalDescriptor", None, ())}


def test_article_headings_graph(spark):
    entries = spark.createDataFrame([("D1", "fever", ["A.1.2"]), ("D2", "heat", ["A.1"]), ("D3", "none", [])], "ui string, name string, tree_numbers array<string>")
    graph = spark.createDataFrame([(1, "D0", ["A"]), (2, "D9", ["A"])], "kgraph_id long, uri string, tree_numbers array<string>")
    given = [(1, "a", "t", [("D1", ["therapy", "genetics"]), ("D2", None), ("D3", None), ("D7", None)]), (1, "b", "u", [("D3", None)]), (1, "c", None, None)]
    articles = spark.createDataFrame(given, "kgraph_id long, uri string, title string, headings array<struct<descriptor:string,qualifiers:array<string>>>")
    nodes, edges = M.article_headings_graph(articles, entries, graph)
    assert rows(nodes, "uri", "type", "name") == {("a", "article", "t"), ("D1", "mesh", "fever"), ("D2", "mesh", "heat")}
    # D1 and D2 of the article; D1 to D2 and to the graph's D0, D2 to D0; nothing of the other graph
    assert sorted((r["type"], tuple(r["qualifiers"] or ())) for r in edges.collect()) == [("A", ()), ("A", ()), ("A.1", ()), ("D1", ("therapy",)), ("D2", ())]
