"""Queries of the file readers, over files that are written out of the test tables first, and of small operators that had none."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import ontology as O
from loomgraph.operators import predications as P
from loomgraph.operators import search as T
from loomgraph.operators import trials as R
from loomgraph.operators.rounds import new_folder
from loomgraph.plans.catalog import item_edges, nation_entries, part_nodes, predication_rows, query, supplier_nodes, table
from loomgraph.plans.texts import both
from loomgraph.sources import files as S


def lines(spark, text, rows, header=None):
    """The path of a folder of text files with a line for each row, after a header in each of them."""
    folder = f"{new_folder(spark, 'files')}/f"
    rows = rows.select(text.alias("value"))
    if header is None:
        rows.write.text(folder)
    else:
        parts = F.split("value", "\t")
        names = header.split("\t")
        rows.select(*[parts[i].alias(n) for i, n in enumerate(names)]).write.option("sep", "\t").option("header", True).csv(folder)
    return folder


def _within(batches):
    """A start tag before the lines of a file, and an end tag after them."""
    yield pa.record_batch([pa.array(["<set>"])], ["value"])
    yield from batches
    yield pa.record_batch([pa.array(["</set>"])], ["value"])


def xml_lines(spark, text, rows):
    """The path of a folder of XML files with a record for each row."""
    return lines(spark, F.col("value"), rows.select(text.alias("value")).mapInArrow(_within, "value string"))


def text(c):
    return F.col(c).cast("string")


@query("""select 'R' || r_regionkey as ui, '"' || r_name || '"' as name, cast(r_regionkey as varchar) as tree_number from region union all select 'N' || n_nationkey, '"' || n_name || '"', n_regionkey || '.' || n_nationkey from nation""")
def heading_tree_rows(spark, d):
    trees = F.array_join(F.transform("tree_numbers", lambda t: both("<TreeNumber>", t, "</TreeNumber>")), "")
    xml = both("<DescriptorRecord><DescriptorUI>", F.col("ui"), "</DescriptorUI><DescriptorName><String>", F.col("name"), "</String></DescriptorName><TreeNumberList>", trees, "</TreeNumberList></DescriptorRecord>")
    return S.tree_rows(S.descriptors(spark, xml_lines(spark, xml, nation_entries(spark, d))))


@query("""select o_orderkey as pmid, 'N' || n_nationkey as ui, n_name as name, o_orderstatus = 'F' as major, 'Q' || o_custkey % 3 as qualifiers from orders join nation on n_nationkey = o_orderkey % 40""")
def article_file_headings(spark, d):
    """Headings of articles in files that are known."""
    major = F.when(F.col("o_orderstatus") == "F", "Y").otherwise("N")
    xml = both(
        '<PubmedArticle><MedlineCitation><PMID Version="1">', text("o_orderkey"), "</PMID><Article><ArticleTitle>", F.col("o_orderpriority"), '</ArticleTitle></Article><MeshHeadingList><MeshHeading><DescriptorName UI="N', (F.col("o_orderkey") % 40).cast("string"), '" MajorTopicYN="', major,
        '">x</DescriptorName><QualifierName UI="Q', (F.col("o_custkey") % 3).cast("string"), '" MajorTopicYN="N">y</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>',
    )
    articles = S.articles(spark, xml_lines(spark, xml, table(spark, d, "orders")))
    return O.known_headings(articles, nation_entries(spark, d)).withColumn("qualifiers", F.array_join("qualifiers", ","))


@query("""select 'HP:' || n_nationkey as id, n_name as name, 'syn ' || n_name || '|of ' || n_name as synonyms, 'HP:R' || n_regionkey as is_a, 'UMLS:C' || n_nationkey as xref from nation union all select 'HP:R' || r_regionkey, r_name, '', '', '' from region""")
def ontology_file(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    stanza = both("[Term]\nid: HP:", text("n_nationkey"), "\nname: ", F.col("n_name"), '\nsynonym: "syn ', F.col("n_name"), '" EXACT []\nsynonym: "of ', F.col("n_name"), '" RELATED []\nis_a: HP:R', text("n_regionkey"), " ! above\nxref: UMLS:C", text("n_nationkey"), "\n")
    above = both("[Term]\nid: HP:R", text("r_regionkey"), "\nname: ", F.col("r_name"), "\n")
    terms = S.obo_terms(spark, lines(spark, F.col("s"), nation.select(stanza.alias("s")).unionByName(region.select(above.alias("s"))).repartition(1)))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return terms.select("id", "name", joined("synonyms"), joined("is_a"), joined("xref"))


@query("""select 'HP:' || l_suppkey % 25 as phenotype, 'OMIM:' || p_partkey as disease, p_type as type from part join (select distinct l_partkey, l_suppkey from lineitem) l on l_partkey = p_partkey group by all""")
def annotation_file(spark, d):
    """Phenotypes of diseases, from a tab file."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    line = both("OMIM\t", text("p_partkey"), "\t", F.col("p_name"), "\tx\tHP:", (F.col("l_suppkey") % 25).cast("string"), "\tref\t", F.col("p_type"), "\tmore")
    terms = table(spark, d, "nation").select(both("HP:", text("n_nationkey")).alias("id"))
    return O.phenotype_diseases(S.annotations(spark, lines(spark, line, rows)), terms)


@query("""select 'HP:' || p_size % 25 as phenotype, p_brand as gene from part where p_size % 25 < 20 and not (p_size % 25 = 3) group by all""")
def gene_file(spark, d):
    """Genes of known phenotypes that no edge joins yet, from a tab file with a header."""
    line = both("HP:", (F.col("p_size") % 25).cast("string"), "\tname\tid\t", F.col("p_brand"))
    rows = S.phenotype_genes(spark, lines(spark, line, table(spark, d, "part"), "a\tb\tc\td"))
    terms = table(spark, d, "nation").filter("n_nationkey < 20").select(both("HP:", text("n_nationkey")).alias("id"))
    return O.phenotype_genes(rows, terms, table(spark, d, "part").filter("p_size % 25 = 3").select(F.lit("HP:3").alias("phenotype"), F.col("p_brand").alias("gene")))


@query("""select 'a' || n_nationkey as abbr, 'T' || n_regionkey as id, n_name as name from nation where n_nationkey % 3 != 0""")
def semantic_type_file(spark, d):
    """A pipe-delimited file in which some lines have another number of fields."""
    line = both("a", text("n_nationkey"), "|T", text("n_regionkey"), "|", F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "|more").otherwise(""))
    return S.semantic_types(spark, lines(spark, line, table(spark, d, "nation")))


@query("""select 'NCT' || o_orderkey as nct_id, o_orderpriority as title, o_orderstatus as status, o_custkey::varchar || '|' || o_orderstatus as condition, o_custkey as enrollment, o_orderkey % 2 != 0 as created from orders where o_orderstatus != 'P'""")
def study_files(spark, d):
    """Studies in files, those that aren't known yet marked."""
    kind = F.when(F.col("o_orderstatus") == "P", "Observational").otherwise("Interventional")
    xml = both("<study><nct_id>NCT", text("o_orderkey"), "</nct_id><title>", F.col("o_orderpriority"), "</title><status>", F.col("o_orderstatus"), "</status><condition>", text("o_custkey"), "</condition><condition>", F.col("o_orderstatus"), "</condition><enrollment>", text("o_custkey"), "</enrollment><study_types>", kind, "</study_types></study>")
    orders = table(spark, d, "orders")
    found = R.add_studies(orders.filter("o_orderkey % 2 = 0").select(both("NCT", text("o_orderkey")).alias("nct_id")), S.studies(spark, xml_lines(spark, xml, orders)))
    return found.select("nct_id", "title", "status", F.array_join("condition", "|").alias("condition"), F.col("enrollment").cast("long").alias("enrollment"), "created")


@query("""select distinct 'NCT' || l_orderkey as nct_id, 'U' || l_suppkey as unii from lineitem join orders on o_orderkey = l_orderkey and o_orderstatus = 'F' where l_returnflag != 'R'""")
def trial_interventions(spark, d):
    """Interventions of known trials, from a tab file with placebos."""
    unii = F.when(F.col("l_returnflag") == "R", "FAKE_FOR_PLACEBO").otherwise(both("U", text("l_suppkey")))
    rows = S.interventions(spark, lines(spark, both("NCT", text("l_orderkey"), "\tn\t", unii, "\tx\ty"), table(spark, d, "lineitem"), "nct\tname\tunii\ta\tb"))
    return R.with_interventions(table(spark, d, "orders").filter("o_orderstatus = 'F'").select(both("NCT", text("o_orderkey")).alias("nct_id")), rows)


@query("select p_name || ' ' || p_partkey as name, p_partkey * 1000 + p_size as count from part")
def condition_anchors(spark, d):
    page = both('<p>[<a href="x?q=1">', F.col("p_name"), " ", text("p_partkey"), '</a>, "', F.format_number(F.col("p_partkey") * 1000 + F.col("p_size"), 0), ' studies"]')
    return S.html_conditions(table(spark, d, "part").select(page.alias("page")), "page").select("name", F.col("count").cast("long").alias("count"))


@query("select o_orderkey as pmid from orders where o_orderstatus != 'P'")
def pmid_file(spark, d):
    line = F.when(F.col("o_orderstatus") == "P", both("x", text("o_orderkey"))).otherwise(both(" ", text("o_orderkey")))
    return S.pmid_list(spark, lines(spark, line, table(spark, d, "orders")))


@query("select 'nodes' as part, p_size % 5 as kgraph_id, count(*) as n from part where p_size % 5 in (1, 3) group by 2 union all select 'edges', p_size % 5, count(*) from lineitem join part on p_partkey = l_partkey where p_size % 5 in (1, 3) group by 2")
def written_graphs(spark, d):
    """Nodes and edges of two of five graphs that are stored by graph."""
    own = F.pmod(F.col("props")["_size"].cast("long"), F.lit(5))
    nodes = part_nodes(spark, d).withColumn("kgraph_id", own)
    edges = item_edges(spark, d).drop("kgraph_id").join(nodes.select(F.col("id").alias("src"), "kgraph_id"), "src").select(item_edges(spark, d).columns)
    folder = new_folder(spark, "graphs")
    G.write_graph(nodes, edges, folder)
    stored = zip(("nodes", "edges"), G.read_graph(spark, folder), strict=True)
    n, e = (G.nodes_where(rows, None, F.col("kgraph_id").isin(1, 3)).groupBy(F.lit(part).alias("part"), F.col("kgraph_id").cast("long").alias("kgraph_id")).agg(F.count("*").alias("n")) for part, rows in stored)
    return n.unionByName(e)


@query("select kgraph_id, name, tags, n from (select cast(1 as bigint) as kgraph_id, 'parts' as name, p_type || ',' || p_brand as tags, count(*) as n from part group by 3 union all select 9, 'new', 'KQuery', 1) t")
def created_graph(spark, d):
    """The parts of one graph, and the seed of a new one."""
    grown = G.create_graph(part_nodes(spark, d), 9, "new", "query", {"uri": "x"}, 0)
    return grown.groupBy("kgraph_id", F.when(F.col("kgraph_id") == 9, F.col("name")).otherwise("parts").alias("name"), F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))


@query("select l_partkey as src, -1 - l_suppkey as dst, l_returnflag as type, count(*) as n from lineitem group by all")
def checked_edges(spark, d):
    return G.valid_edges(item_edges(spark, d)).groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


@query("select p_partkey as id, p_name as name from part where p_partkey in (3, 17)")
def nodes_by_id(spark, d):
    nodes = part_nodes(spark, d)
    return G.find_nodes(nodes, "id", 3).unionByName(G.find_nodes(nodes, "id", 17)).unionByName(G.find_nodes(nodes, "id", -5)).select("id", "name")


@query("select count(distinct g) as graphs from (select p_size % 7 as g from part union all select s_nationkey from supplier) t")
def graph_count(spark, d):
    nodes = part_nodes(spark, d).withColumn("kgraph_id", F.pmod(F.col("props")["_size"].cast("long"), F.lit(7))).unionByName(supplier_nodes(spark, d).withColumn("kgraph_id", F.col("props")["nation"].cast("long")))
    return G.count_graphs(nodes)


@query("""with h as (select doc_id as id, (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 * cast(1 as double) / length(text) as score from documents where contains(lower(text), 'the') order by score desc, doc_id limit 50)
    select id, round(score, 9) as score from h join documents on doc_id = id where source in ('src0', 'src3')""")
def labelled_top_hits(spark, d):
    """Of the best 50 texts those with one of two labels."""
    docs = table(spark, d, "documents")
    hits = T.substring_topk(docs, "doc_id", "text", "the", 50).withColumnRenamed("doc_id", "id")
    return T.labelled_hits(hits, docs.select(F.col("doc_id").alias("id"), F.array("source").alias("tags")), ["src0", "src3"]).select("id", F.round("score", 9).alias("score"))


@query("select c_custkey as ui, case when c_nationkey > 12 then 'second' when c_nationkey > 6 then 'first' end as preferred from customer")
def preferred_concepts(spark, d):
    n = F.col("c_nationkey")
    concepts = F.array(F.struct(F.lit("first").alias("name"), ((n > 6) & (n <= 12)).alias("preferred")), F.struct(F.lit("second").alias("name"), (n > 6).alias("preferred")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("ui"), S.preferred_concept(concepts)["name"].alias("preferred"))


@query("select distinct l_suppkey as parent from lineitem where l_partkey = 7")
def parents_of_part(spark, d):
    return O.parents(table(spark, d, "lineitem").select(F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent")), 7)


@query("select p_partkey as ui, p_size as size from part where p_size % 4 = 1 order by ui")
def qualified_entries(spark, d):
    entries = table(spark, d, "part").select(F.col("p_partkey").alias("ui"), F.col("p_size").alias("size"), F.array(both("q", (F.col("p_size") % 4).cast("string")), F.lit("q9")).alias("qualifiers"))
    return O.qualified_by(entries, "q1").select("ui", "size")


@query("select l_returnflag as type, count(*) as n from lineitem where l_returnflag in ('A', 'R') group by 1")
def typed_neighbours(spark, d):
    return O.typed_neighbours(item_edges(spark, d), ["A", "R"]).groupBy("type").agg(F.count("*").alias("n"))


@query("select l_partkey as subject, l_returnflag as predicate, l_suppkey as object, count(*) as cnt from lineitem group by all order by cnt desc, 1, 2, 3 limit 25")
def most_frequent_predications(spark, d):
    return P.most_frequent(P.predication_count(predication_rows(spark, d)), 25).select("subject", "predicate", "object", "cnt")


@query("select s_suppkey, s_name, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey < 20 group by 1, 2 order by n desc, s_suppkey limit 15")
def related_by_key(spark, d):
    return P.related(predication_rows(spark, d), table(spark, d, "supplier").filter("s_nationkey < 20").select("s_suppkey", "s_name"), "s_suppkey", "s_name", 15, by_key=True)
