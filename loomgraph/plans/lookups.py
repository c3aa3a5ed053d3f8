"""More of the engine's queries over the test tables: crosswalks, nested values, dates, sets and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import concepts as C
from loomgraph.operators import expand as E
from loomgraph.operators import graph as G
from loomgraph.operators import ontology as O
from loomgraph.operators import trials as R
from loomgraph.plans.catalog import atom_rows, item_edges, part_nodes, predication_rows, query, supplier_nodes, table
from loomgraph.sources import files


def _crosswalk(spark, d):
    item, part = table(spark, d, "lineitem"), table(spark, d, "part")
    pair = item.join(part, F.col("p_partkey") == F.col("l_partkey"))
    rels = pair.select(F.col("p_brand").alias("cui1"), F.concat(F.lit("Brand#"), F.col("l_suppkey").cast("string")).alias("cui2"), F.col("l_returnflag").alias("rel"))
    return item.select(F.col("l_partkey").cast("string").alias("ui")), R.crosswalk(item.filter("l_linestatus = 'O'").select(F.col("l_partkey").cast("string").alias("ui")), atom_rows(spark, d), rels)


@query("select 'P' || l_partkey as src, p_brand as dst, p_type as value, count(*) as n from lineitem join part on p_partkey = l_partkey where l_partkey in (select l_partkey from lineitem where l_linestatus = 'O') group by 1, 2, 3")
def crosswalk_links(spark, d):
    entries, (links, _) = _crosswalk(spark, d)
    n = entries.groupBy(F.col("ui").alias("src")).agg(F.count("*").alias("n"))
    return links.join(n, "src").select(F.concat(F.lit("P"), "src").alias("src"), "dst", "value", "n")


@query("""with b as (select distinct p_brand from lineitem join part on p_partkey = l_partkey where l_linestatus = 'O')
    select p_brand as cui1, 'Brand#' || l_suppkey as cui2, l_returnflag as rel, count(*) as n from lineitem join part on p_partkey = l_partkey where p_brand in (select * from b) and 'Brand#' || l_suppkey in (select * from b) group by 1, 2, 3""")
def crosswalk_relations(spark, d):
    _, (_, between) = _crosswalk(spark, d)
    return between.groupBy("cui1", "cui2", "rel").agg(F.count("*").alias("n"))


@query("select o_custkey as item, o_orderpriority as descriptor, max(o_totalprice) as score, min(o_orderkey) as entry from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) t where place <= 5 group by 1, 2")
def best_entries(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("ui"), F.col("o_orderpriority").alias("descriptor"), F.col("o_totalprice").alias("score"))
    return R.best_entries(rows, 5)


@query("select c_custkey as item, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) filter (o_orderstatus = 'F'), '') as mesh, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) filter (o_orderstatus = 'O'), '') as umls from customer left join orders on o_custkey = c_custkey group by 1")
def condition_entries(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "mesh").when(F.col("o_orderstatus") == "O", "umls")
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), kind.alias("kind"), F.col("o_orderkey").alias("ui"), F.col("o_orderpriority").alias("name"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["ui"].cast("string")), ",").alias(c)
    return R.condition_entries(table(spark, d, "customer").select(F.col("c_custkey").alias("item")), edges).select("item", text("mesh"), text("umls"))


@query("select 'Brand#' || l_suppkey as src, cast(l_partkey as varchar) as dst, l_returnflag as scope, count(*) as n from lineitem where l_returnflag = 'R' and 'Brand#' || l_suppkey in (select p_brand from part) group by 1, 2, 3")
def expand_relations(spark, d):
    li = table(spark, d, "lineitem").withColumn("rui", F.monotonically_increasing_id())
    rels = li.select(F.concat(F.lit("Brand#"), F.col("l_suppkey").cast("string")).alias("cui1"), F.col("l_partkey").cast("string").alias("cui2"), "rui", F.lit("RO").alias("rel"), F.col("l_returnflag").alias("rela"), F.lit("N").alias("suppress"))
    concepts = table(spark, d, "part").select(F.col("p_brand").alias("cui")).distinct()
    return C.expand_relations(concepts, rels, ["r"]).groupBy("src", "dst", "scope").agg(F.count("*").alias("n"))


@query("select distinct p_brand as phenotype, 'D' || l_suppkey as disease, l_returnflag as type from lineitem join part on p_partkey = l_partkey where p_size > 25")
def phenotype_diseases(spark, d):
    part = table(spark, d, "part")
    rows = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).filter("p_size > 25").select(F.col("p_brand").alias("phenotype"), F.concat(F.lit("D"), F.col("l_suppkey").cast("string")).alias("disease"), F.col("l_returnflag").alias("type"))
    return O.phenotype_diseases(rows, part.select(F.col("p_brand").alias("id")))


@query("select distinct p_type as phenotype, p_name as gene from part where p_size > 10 except select distinct p_type, p_name from part where p_size > 48")
def phenotype_genes(spark, d):
    part = table(spark, d, "part")
    pair = [F.col("p_type").alias("phenotype"), F.col("p_name").alias("gene")]
    return O.phenotype_genes(part.filter("p_size > 10").select(*pair), part.select(F.col("p_type").alias("id")).distinct(), part.filter("p_size > 48").select(*pair).distinct())


@query("select l_orderkey as id, l_suppkey as link, count(*) as n from lineitem where l_returnflag = 'N' group by 1, 2")
def link_sets(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("linkname")).agg(F.collect_list("l_suppkey").alias("links"))
    sets = rows.select("id", F.array(F.struct("linkname", "links")).alias("linksets"))
    return O.link_sets(sets, "N").groupBy("id", "link").agg(F.count("*").alias("n"))


@query("select p_partkey, case when p_brand like 'Brand#1%' and p_name not like 'x%' then p_brand else '' end as ids from part")
def bridge_ids(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", F.array_join(E.bridge_ids(F.array(F.concat(F.lit("ns:"), "p_brand")), F.array("p_brand"), "Brand#1"), ",").alias("ids"))


@query("select event_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events")
def json_rows(spark, d):
    return E.from_json(table(spark, d, "events"), "props", "k long").select("event_id", "event_type", "k")


@query("select event_id, 'k' as key, regexp_extract(props, '([0-9]+)', 1) as value from events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(S.json_props(F.col("props"))))


@query("select o_orderkey, cast(make_date(year(o_orderdate), month(o_orderdate), 1) as varchar) as first_day, cast(month(o_orderdate) - 1 as integer) as month0 from orders")
def publication_dates(spark, d):
    o = table(spark, d, "orders")
    month = S.parse_month(F.date_format("o_orderdate", "MMM"))
    return o.select("o_orderkey", S.publication_date(F.year("o_orderdate"), month, F.lit(None).cast("int")).cast("string").alias("first_day"), month.alias("month0"))


@query("select p_brand, string_agg(distinct p_type, ',' order by p_type) as new_tags from part where p_type not in ('PROMO', 'ECONOMY') group by p_brand")
def tag_difference(spark, d):
    tags = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("t"))
    left = F.array_except("t", F.array(F.lit("PROMO"), F.lit("ECONOMY")))
    return tags.select("p_brand", F.array_join(F.array_sort(left), ",").alias("new_tags")).filter("new_tags != ''")


@query("select l_suppkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as actions from lineitem group by 1")
def joined_actions(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(S.join_values(F.array_sort(F.collect_set("l_returnflag")), ",").alias("actions"))


@query("select l_suppkey as object, count(*) as n_links, sum(case when l_suppkey = l_partkey then 1 else 0 end)::bigint as loops from lineitem group by 1")
def self_loops(spark, d):
    return predication_rows(spark, d).groupBy("object").agg(F.count("*").alias("n_links"), F.count_if(F.col("subject") == F.col("object")).alias("loops"))


@query("""select cast(1 as bigint) as kgraph_id, '{"kgraph_id":1,"node_count":' || ((select count(*) from part) + (select count(*) from supplier)) || ',"edge_count":' || (select count(*) from lineitem) || '}' as json""")
def compact_graph_json(spark, d):
    return G.graph_json(part_nodes(spark, d).unionByName(supplier_nodes(spark, d)), item_edges(spark, d), full=False)


@query("select distinct -1 - l.l_suppkey as id from lineitem l join part p on p.p_partkey = l.l_partkey where p.p_brand = 'Brand#13'")
def neighbours_of_tagged(spark, d):
    nodes, edges = part_nodes(spark, d).unionByName(supplier_nodes(spark, d)), item_edges(spark, d)
    return G.neighbors(edges, nodes, of=G.has_tag(nodes, "Brand#13")).select(F.col("other").alias("id")).distinct()


@query("select count(*) as n from (select distinct l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_type = 'PROMO')) t")
def set_membership(spark, d):
    promo = table(spark, d, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(promo, "l_partkey", "left_semi").select("l_suppkey").distinct().agg(F.count("*").alias("n"))


@query("select page_id, cast(len(regexp_extract_all(html, '<a [^>]*>')) as bigint) as anchors from pages")
def html_anchors(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(<a [^>]*>)"), 1)).cast("long").alias("anchors"))


@query("select conv_id, role, string_agg(text, ' ' order by turn) as text from conversations group by 1, 2")
def grouped_texts(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", "role", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


@query("select p_type as abbr, min(p_brand) as id from part where lower(p_type) = 'promo' or lower(p_brand) = 'promo' group by 1")
def semantic_type_lookup(spark, d):
    types = table(spark, d, "part").select(F.col("p_type").alias("abbr"), F.col("p_brand").alias("id"), F.col("p_name").alias("name"))
    return files.find_semantic_type(types, "promo").select("abbr", "id")


@query("select 'Q' || n_nationkey as ui, 'Qualifier' as kind from nation where n_regionkey = 1 order by 1 limit 3 offset 1")
def entry_context(spark, d):
    nation = table(spark, d, "nation")
    none = F.array().cast("array<string>")
    entries = nation.select(F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("ui"), F.lit("Qualifier").alias("kind"), none.alias("qualifiers")).unionByName(
        table(spark, d, "region").select(F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("ui"), F.lit("Concept").alias("kind"), none.alias("qualifiers")))
    links = nation.select(F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("parent"))
    return O.context(entries, links, "C1", 1, 3)
