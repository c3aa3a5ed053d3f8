"""Queries of the record, article and expander graphs over the test tables: orders are records and articles, customers concepts, parts and nations entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import expand as E
from loomgraph.operators import records as M
from loomgraph.operators.rounds import new_folder, stored
from loomgraph.plans.catalog import nation_entries, part_nodes, query, supplier_nodes, table
from loomgraph.plans.texts import both
from loomgraph.sources import records as N

RECORDS = """with r as (select 'O' || o_orderkey as ui, 'order ' || o_orderkey as name, case o_orderstatus when 'F' then 'Descriptor' when 'O' then 'SupplementalDescriptor' else 'Qualifier' end as kind,
        'C' || o_custkey as concept, 'C' || (o_custkey + 1) as near, o_orderpriority as term, o_orderstatus = 'F' as best, case o_orderstatus when 'F' then true when 'O' then false end as told, 'O' || o_custkey as other, 'O' || (o_custkey + 2) as other2 from orders),
    t as (select concept, term, bool_or(told) as told from r group by 1, 2),
    named as (select ui, 1 as place, name, kind from r union all select concept, 2, 'customer ' || substr(concept, 2), 'Concept' from r union all select term, 3, term, 'Term' from r union all select near, 6, null, null from r
        union all select unnest([other, other2]), 6, null, null from r where kind = 'SupplementalDescriptor' union all select 'O' || n_nationkey, 4, n_name, null from nation union all select 'O' || n_regionkey, 5, 'x', null from nation),
    n as (select ui, name, kind from (select *, row_number() over (partition by ui order by place) as first from named) a where first = 1),
    e as (select ui as src, concept as dst, 'concept' as type, bool_or(best) as preferred, cast(null as varchar) as scope, cast(null as varchar) as qualifiers from r group by 1, 2
        union all select near, concept, 'concept', null, kind, null from r group by near, concept, kind
        union all select case when told is null then term else concept end, case when told is null then concept else term end, 'term', told, null, null from t
        union all select ui, other, 'mapped', null, null, max(term) from r where kind = 'SupplementalDescriptor' group by 1, 2
        union all select ui, other2, 'indexed', null, null, max(term || ',' || kind) from r where kind = 'SupplementalDescriptor' group by 1, 2
        union all select distinct 'O' || n_nationkey, 'O' || n_regionkey, 'substance', cast(null as boolean), null, null from nation) """


def _records(spark, d):
    o = table(spark, d, "orders")
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "Descriptor").when(status == "O", "SupplementalDescriptor").otherwise("Qualifier")
    near = F.array(F.struct(both("C", (F.col("o_custkey") + 1).cast("string")).alias("ui"), kind.alias("name")))
    term = F.array(F.struct(F.col("o_orderpriority").alias("ui"), F.col("o_orderpriority").alias("name"), F.when(status == "F", True).when(status == "O", False).alias("preferred")))
    concept = F.struct(both("C", F.col("o_custkey").cast("string")).alias("ui"), both("customer ", F.col("o_custkey").cast("string")).alias("name"), (status == "F").alias("preferred"), near.alias("relations"), term.alias("terms"))
    mapped = F.array(F.struct(both("O", F.col("o_custkey").cast("string")).alias("ui"), F.array("o_orderpriority").alias("qualifiers")))
    indexed = F.array(F.struct(both("O", (F.col("o_custkey") + 2).cast("string")).alias("ui"), F.array(F.col("o_orderpriority"), kind).alias("qualifiers")))
    key = F.col("o_orderkey").cast("string")
    records = o.select(both("O", key).alias("ui"), both("order ", key).alias("name"), kind.alias("kind"), F.array(concept).alias("concepts"), F.when(status == "O", mapped).alias("mapped"), F.when(status == "O", indexed).alias("indexed"))
    substance = F.array(F.struct(both("O", F.col("n_regionkey").cast("string")).alias("ui"), F.lit("x").alias("name")))
    actions = table(spark, d, "nation").select(both("O", F.col("n_nationkey").cast("string")).alias("ui"), F.col("n_name").alias("name"), substance.alias("substances"))
    return records, actions


@query(RECORDS + "select ui, name, kind from n")
def record_nodes(spark, d):
    return M.record_graph(*_records(spark, d))[0]


@query(RECORDS + "select * from e")
def record_edges(spark, d):
    return M.record_graph(*_records(spark, d))[1].withColumn("qualifiers", F.array_join("qualifiers", ","))


def _in_xml(spark, d, columns):
    """The records as files of all kinds in one folder, and those of actions, read again; of the records some columns."""
    element = lambda tag, c: both(f"<{tag}>", c, f"</{tag}>")
    yes = lambda name, c: F.when(c, f' {name}="Y"').when(~c, f' {name}="N"').otherwise("")
    every = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ""), F.lit(""))
    records, actions = _records(spark, d)
    relation = lambda c: lambda r: both('<ConceptRelation RelationName="', r["name"], '">', element("Concept1UI", c["ui"]), element("Concept2UI", r["ui"]), "</ConceptRelation>")
    term = lambda t: both("<Term", yes("ConceptPreferredTermYN", t["preferred"]), ">", element("TermUI", t["ui"]), element("String", t["name"]), "</Term>")
    concept = lambda c: both(
        "<Concept", yes("PreferredConceptYN", c["preferred"]), ">", element("ConceptUI", c["ui"]), element("ConceptName", element("String", c["name"])), element("ConceptRelationList", every(c["relations"], relation(c))),
        element("TermList", every(c["terms"], term)), "</Concept>",
    )
    qualifier = lambda q: element("QualifierReferredTo", element("QualifierName", element("String", q)))
    heading = lambda tag: lambda m: element(tag, both(element("DescriptorReferredTo", element("DescriptorUI", both("*", m["ui"]))), every(m["qualifiers"], qualifier)))
    mapped, indexed = every("mapped", heading("HeadingMappedTo")), every("indexed", heading("IndexingInformation"))
    tag = F.when(F.col("kind") == "SupplementalDescriptor", "Supplemental").otherwise(F.col("kind"))
    field = F.when(tag == "Supplemental", "SupplementalRecord").otherwise(tag)
    start = F.when(F.col("kind") == "Descriptor", both("<", tag, 'Record DescriptorClass="1">')).otherwise(both("<", tag, "Record>"))  # with and without attributes
    body = both("\n<", field, "UI>", F.col("ui"), "</", field, "UI><", field, "Name><String>", F.col("name"), "</String></", field, "Name>", element("HeadingMappedToList", mapped), element("IndexingInformationList", indexed), element("ConceptList", every("concepts", concept)))
    folder = new_folder(spark, "xml")
    records.select(both(start, body, "\n</", tag, "Record>").alias("value")).write.text(f"{folder}/records")
    substance = lambda s: element("Substance", both(element("RecordUI", s["ui"]), element("RecordName", element("String", s["name"]))))
    action = both(element("DescriptorReferredTo", both(element("DescriptorUI", F.col("ui")), element("DescriptorName", element("String", F.col("name"))))), element("PharmacologicalActionSubstanceList", every("substances", substance)))
    actions.select(element("PharmacologicalAction", action).alias("value")).write.text(f"{folder}/actions")
    return stored(N.heading_records(spark, f"{folder}/records", columns)), N.action_records(spark, f"{folder}/actions")  # the graph reads records for each kind of edge


@query(RECORDS + "select ui, name, kind from n")
def xml_record_nodes(spark, d):
    return M.record_nodes(*_in_xml(spark, d, N.NODES))


@query(RECORDS + "select * from e")
def xml_record_edges(spark, d):
    return M.record_edges(*_in_xml(spark, d, N.EDGES)).withColumn("qualifiers", F.array_join("qualifiers", ","))


@query("""select o_orderkey as pmid, o_orderpriority as title,
    'AIM: ' || o_orderstatus || '|' || o_orderpriority as abstract, cast(o_orderdate as date) as date, '10.1/' || o_orderkey as doi, 'D' || o_custkey as heading, o_orderstatus = 'F' as major from orders""")
def articles_in_columns(spark, d):
    """Articles held as XML in a column."""
    o, text = table(spark, d, "orders"), lambda c: F.col(c).cast("string")
    date = both("<Year>", F.year("o_orderdate").cast("string"), "</Year><Month>", F.date_format("o_orderdate", "MMM"), "</Month><Day>", F.dayofmonth("o_orderdate").cast("string"), "</Day>")
    major = F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N")
    xml = both(
        '<PubmedArticle><MedlineCitation><PMID Version="1">', text("o_orderkey"), "</PMID><Article><ArticleTitle>", F.col("o_orderpriority"), '</ArticleTitle><Abstract><AbstractText Label="AIM">', F.col("o_orderstatus"), "</AbstractText><AbstractText>", F.col("o_orderpriority"),
        "</AbstractText></Abstract><Journal><JournalIssue><PubDate>", date, '</PubDate></JournalIssue></Journal></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D', text("o_custkey"), '" MajorTopicYN="', major, '">x</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>',
        '<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/', text("o_orderkey"), "</ArticleId></ArticleIdList></PubmedData></PubmedArticle>",
    )
    found = N.articles_of(o.select(xml.alias("x")), "x")
    return found.select("pmid", "title", F.array_join("abstract", "|").alias("abstract"), "date", "doi", F.get("headings", F.lit(0))["descriptor"].alias("heading"), F.get("headings", F.lit(0))["major"].alias("major"))


@query("select o_orderkey as id, o_custkey as customer, o_orderpriority as label, 2 as n from orders")
def resolved_answers(spark, d):
    """Answers of a service: XML that stands escaped in a page."""
    o = table(spark, d, "orders")
    page = both("<!DOCTYPE a b><pre>&lt;r c='", F.col("o_custkey").cast("string"), "'&gt;&lt;l&gt;", F.col("o_orderpriority"), "&lt;/l&gt;&lt;i&gt;1&lt;/i&gt;&lt;i&gt;2&lt;/i&gt;&lt;/r&gt;</pre>")
    found = N.resolved_xml(o.select(F.col("o_orderkey").alias("id"), page.alias("x")), "x", "_c BIGINT, l STRING, i ARRAY<INT>")
    return found.select("id", F.col("_c").alias("customer"), F.col("l").alias("label"), F.size("i").alias("n"))


@query(RECORDS + """select e.src as ui, a.kind, 'concept' as part, e.dst as other, b.name, e.preferred, e.scope from e join n a on a.ui = e.src join n b on b.ui = e.dst where e.type = 'concept' and e.scope is null
    union all select e.dst, a.kind, 'relation', e.src, b.name, e.preferred, e.scope from e join n a on a.ui = e.dst join n b on b.ui = e.src where e.type = 'concept' and e.scope is not null and b.kind = 'Concept'
    union all select t.concept, 'Concept', 'term', t.term, t.term, t.told, null from t
    union all select e.src, a.kind, e.type, e.dst, b.name, null, null from e join n a on a.ui = e.src join n b on b.ui = e.dst where e.type in ('mapped', 'indexed')
    union all select e.src, a.kind, 'substance', e.dst, b.name, null, null from e join n a on a.ui = e.src join n b on b.ui = e.dst where e.type = 'substance'
    union all select e.dst, a.kind, 'action', e.src, b.name, null, null from e join n a on a.ui = e.dst join n b on b.ui = e.src where e.type = 'substance' and a.kind in ('Descriptor', 'SupplementalDescriptor', 'Qualifier')""")
def entry_parts(spark, d):
    return M.entry_parts(*M.record_graph(*_records(spark, d)))


ARTICLES = """with entry as (select 'P' || p_partkey as ui, p_name as name, case when p_size > 25 then 'Descriptor' else 'SupplementalDescriptor' end as kind from part union all select 'Q' || n_nationkey, n_name, 'Qualifier' from nation),
    o as (select o_orderkey as pmid, 'P' || (o_custkey * 3) as a, 'P' || (o_orderkey % 3001) as b, 'P' || (o_orderkey % 7) as c, 'Q' || (o_orderkey % 30) as q0, 'Q' || (o_custkey % 25) as q1 from orders where o_orderstatus <> 'F'),
    k as (select o.*, ea.kind as ka, eb.kind as kb, ec.kind as kc, concat_ws(',', n0.name, n1.name) as two, n3.name as three
        from o left join entry ea on ea.ui = a left join entry eb on eb.ui = b left join entry ec on ec.ui = c left join entry n0 on n0.ui = q0 left join entry n1 on n1.ui = q1 left join entry n3 on n3.ui = 'Q3'),
    e as (select pmid, 0 as place, c as ui, kc as type, cast(null as boolean) as major, cast(null as varchar) as qualifiers from k where kc is not null
        union all select pmid, 1, a, ka, true, concat_ws(',', two, case when kb is null then three end) from k where ka is not null union all select pmid, 2, b, kb, false, three from k where kb is not null) """


def _articles(spark, d):
    o = table(spark, d, "orders")
    name = lambda prefix, c: both(prefix, c.cast("string"))
    heading = lambda ui, major, quals: F.struct(ui.alias("descriptor"), F.lit(major).alias("major"), F.array(*quals).alias("qualifiers"))
    quals = [name("Q", F.col("o_orderkey") % 30), name("Q", F.col("o_custkey") % 25)]
    headings = F.array(heading(name("*P", F.col("o_custkey") * 3), True, quals), heading(name("P", F.col("o_orderkey") % 3001), False, [F.lit("Q3")]))
    articles = o.select(F.col("o_orderkey").alias("pmid"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("date"), headings.alias("headings"), F.array(name("P", F.col("o_orderkey") % 7)).alias("chemicals"))
    kind = F.when(F.col("p_size") > 25, "Descriptor").otherwise("SupplementalDescriptor")
    entries = table(spark, d, "part").select(name("P", F.col("p_partkey")).alias("ui"), F.col("p_name").alias("name"), kind.alias("kind"))
    entries = entries.unionByName(table(spark, d, "nation").select(name("Q", F.col("n_nationkey")).alias("ui"), F.col("n_name").alias("name"), F.lit("Qualifier").alias("kind")))
    return M.add_articles(o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pmid")), articles, entries)


@query("select o_orderkey as pmid, cast(year(o_orderdate) as integer) as year, o_orderstatus <> 'F' as created from orders")
def added_articles(spark, d):
    return _articles(spark, d)[0].select("pmid", "year", "created")


@query(ARTICLES + "select pmid, ui, type, major, nullif(qualifiers, '') as qualifiers from (select *, row_number() over (partition by pmid, ui, type order by place) as first from e) x where first = 1")
def article_heading_edges(spark, d):
    return _articles(spark, d)[1].withColumn("qualifiers", F.array_join("qualifiers", ","))


@query("""with a as (select 'A' || o_orderkey as src, n_nationkey, n_regionkey, o_orderpriority as q from orders join nation on n_nationkey = o_custkey % 30 where o_orderstatus = 'F')
    select src, 'N' || n_nationkey as dst, 'N' || n_nationkey as type, q as qualifiers from a
    union all select distinct 'N' || n_nationkey, 'R' || n_regionkey, cast(n_regionkey as varchar), null from a""")
def article_graph(spark, d):
    """Edges of finished orders as articles: to their headings (nations), and from these to the headings above (regions) that the graph has."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    heading = F.struct(both("N", (F.col("o_custkey") % 30).cast("string")).alias("descriptor"), F.array("o_orderpriority", "o_orderstatus").alias("qualifiers"))
    one = F.lit(1).cast("long").alias("kgraph_id")
    articles = o.select(one, both("A", F.col("o_orderkey").cast("string")).alias("uri"), F.col("o_orderpriority").alias("title"), F.array(heading).alias("headings"))
    entries = nation_entries(spark, d)
    graph = entries.filter("ui like 'R%'").select(one, F.col("ui").alias("uri"), "tree_numbers")
    nodes, edges = M.article_headings_graph(articles, entries, graph)
    ids = nodes.select("id", "uri").unionByName(graph.select(M.entity_id(F.col("kgraph_id"), F.col("uri")).alias("id"), "uri")).distinct()
    found = edges.join(ids.select(F.col("id").alias("src"), F.col("uri").alias("_s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("uri").alias("_d")), "dst")
    return found.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "type", F.array_join("qualifiers", ",").alias("qualifiers"))


@query("""select 'relations' as expander, p_partkey as id from part union all select 'links', p_partkey from part union all select 'links', -1 - s_suppkey from supplier where s_nationkey <> 3
    union all select 'keywords', -1 - s_suppkey from supplier where s_nationkey <> 3""")
def dispatched_nodes(spark, d):
    """Parts are concepts; suppliers, those of nation 3 without a name, are of no type that the rules name."""
    unnamed = F.when(F.col("props")["nation"] != "3", F.col("name"))
    nodes = part_nodes(spark, d).unionByName(supplier_nodes(spark, d).withColumn("name", unnamed))
    given = E.dispatched(nodes, {"concept": ["relations", "links"]}, ["links", "keywords"])
    out = None
    for name, mine in given.items():
        rows = mine.select(F.lit(name).alias("expander"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def _ends(found):
    nodes, edges = found
    return edges.join(nodes.select("kgraph_id", F.col("id").alias("dst"), "uri").distinct(), ["kgraph_id", "dst"]).select(F.col("src").alias("id"), "uri", "type", "props")


@query("select id, uri from (select *, row_number() over (partition by id order by uri) as place from (select distinct p_partkey as id, 'T' || l_suppkey as uri from part join lineitem on l_orderkey = p_partkey) a) b where place <= 20")
def article_targets(spark, d):
    """Parts are articles, their number the pmid; the line items of the order of that number are the targets."""
    nodes = part_nodes(spark, d).withColumn("props", F.create_map(F.lit("pmid"), F.col("id").cast("string")))
    published = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), both("T", F.col("l_suppkey").cast("string")).alias("ref"), F.lit("t").alias("name"))
    return _ends(E.REGISTRY["article_targets"](nodes, {"publications": published})).select("id", "uri")


@query("""select id, ref as uri, type as description from (select *, row_number() over (partition by id order by turn, ref) as place from (select distinct p_partkey as id, 'D' || o_custkey as ref, o_orderkey as turn, o_orderstatus as type
    from orders join part on p_partkey = o_custkey % 97) a) b where place <= 10""")
def drug_interactions(spark, d):
    """Customers are the drugs that a part (drug) interacts with, in the order of their orders."""
    rows = table(spark, d, "orders").select(both("part/", (F.col("o_custkey") % 97).cast("string")).alias("uri"), F.col("o_orderkey").alias("turn"), both("D", F.col("o_custkey").cast("string")).alias("ref"), F.lit("d").alias("name"), F.col("o_orderstatus").alias("description"))
    return _ends(E.REGISTRY["interactions"](part_nodes(spark, d), {"interactions": rows})).select("id", "uri", F.col("props")["description"].alias("description"))
