"""The engine's queries over the test tables, which stand in for its own inputs, and their SQL.

Line items are predications (part = subject, return flag = predicate, supplier = object, order = article), parts and suppliers are nodes, regions and nations a hierarchy,
orders articles and trials, events the change feed, documents the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import annotate as A
from loomgraph.operators import concepts as C
from loomgraph.operators import expand as E
from loomgraph.operators import graph as G
from loomgraph.operators import ontology as O
from loomgraph.operators import predications as P
from loomgraph.operators import search as T
from loomgraph.operators import trials as R
from loomgraph.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views -----------------------------------------------------------------------------------------------------------------------------


def predication_rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_partkey").alias("subject"), F.col("l_linestatus").alias("subtype"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").alias("object"),
        F.col("l_linestatus").alias("objtype"), F.col("l_orderkey").alias("pmid"), F.col("l_orderkey").alias("sentence_id"),
    )


def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sentence_id"), F.col("o_orderpriority").alias("sentence"))


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.lit(1).cast("long").alias("kgraph_id"), F.col("p_partkey").alias("id"), F.lit("concept").alias("type"), F.col("p_name").alias("name"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uri"),
        F.lit(0).cast("long").alias("created"), F.array("p_type", "p_brand").alias("tags"), F.array("p_name").alias("synonyms"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("_size"), F.col("p_size").cast("string")).alias("props"), F.col("p_partkey").alias("seq"),
    )


def supplier_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Ids of suppliers are below 0, so they differ from those of parts."""
    return table(spark, d, "supplier").select(
        F.lit(1).cast("long").alias("kgraph_id"), (-1 - F.col("s_suppkey")).alias("id"), F.lit("target").alias("type"), F.col("s_name").alias("name"), F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("uri"),
        F.lit(0).cast("long").alias("created"), F.array(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"))).alias("tags"), F.array("s_name").alias("synonyms"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("props"), (F.col("s_suppkey") + 1_000_000_000).alias("seq"),
    )


def item_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.lit(1).cast("long").alias("kgraph_id"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"),
        F.col("l_returnflag").alias("type"), F.lit(False).alias("directed"), F.create_map(F.lit("order"), F.col("l_orderkey").cast("string")).alias("props"), F.col("l_orderkey").alias("seq"),
    )


def nation_entries(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations with tree numbers ``region`` and ``region.nation``."""
    region = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("ui"), F.col("r_name").alias("name"), F.array(F.col("r_regionkey").cast("string")).alias("tree_numbers"))
    nation = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ui"), F.col("n_name").alias("name"), F.array(F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))).alias("tree_numbers"))
    return region.unionByName(nation)


# --- graph -----------------------------------------------------------------------------------------------------------------------------


@query("select c_mktsegment as type, count(*) as n from customer group by c_mktsegment")
def node_count_by_type(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("type")).agg(F.count("*").alias("n"))


@query("select cast(1 as bigint) as kgraph_id, (select count(*) from part) + (select count(*) from supplier) as node_count, (select count(*) from lineitem) as edge_count")
def graph_counts(spark, d):
    return G.graph_counts(part_nodes(spark, d).unionByName(supplier_nodes(spark, d)), item_edges(spark, d))


@query("select tag, count(*) as n from (select p_type as tag from part union all select p_brand from part) t group by tag")
def counts_by_tag(spark, d):
    return G.counts_by_tag(part_nodes(spark, d))


@query("""select id, cast(coalesce(i, 0) as bigint) as in_degree, cast(coalesce(o, 0) as bigint) as out_degree, cast(coalesce(i, 0) + coalesce(o, 0) as bigint) as degree
    from (select p_partkey as id from part union all select -1 - s_suppkey from supplier) n
    left join (select l_partkey as k, count(*) as o from lineitem group by 1) a on a.k = n.id left join (select -1 - l_suppkey as k, count(*) as i from lineitem group by 1) b on b.k = n.id""")
def degree_in_out(spark, d):
    return G.degrees(part_nodes(spark, d).unionByName(supplier_nodes(spark, d)), item_edges(spark, d))


@query("select -1 - l.l_suppkey as node, l.l_partkey as other from lineitem l join part p on p.p_partkey = l.l_partkey where p.p_type in ('PROMO', 'LARGE')")
def neighbors_by_tag(spark, d):
    return G.neighbors(item_edges(spark, d), part_nodes(spark, d), tags=["PROMO", "LARGE"]).select("node", "other")


@query("select s_suppkey, s_name from supplier s where exists (select 1 from lineitem l join part p on p.p_partkey = l.l_partkey where l.l_suppkey = s.s_suppkey and p.p_brand = 'Brand#13')")
def has_neighbors(spark, d):
    nodes = part_nodes(spark, d)
    found = G.has_neighbors(supplier_nodes(spark, d), _tagged(item_edges(spark, d), nodes))
    return found.select((-1 - F.col("id")).alias("s_suppkey"), F.col("name").alias("s_name"))


def _tagged(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(G.has_tag(nodes, "Brand#13").select(F.col("id").alias("src")), "src", "left_semi")


@query("select p_partkey as id, p_name as name from part where p_type = 'ECONOMY' and p_size > 10")
def nodes_where(spark, d):
    return G.nodes_where(part_nodes(spark, d), 1, F.array_contains("tags", "ECONOMY") & (F.col("props")["_size"].cast("int") > 10)).select("id", "name")


@query("select l_partkey as src, -1 - l_suppkey as dst, count(*) as n from lineitem where l_returnflag = 'R' group by 1, 2")
def edges_where(spark, d):
    return G.edges_where(item_edges(spark, d), 1, F.col("type") == "R").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("select p_partkey as id from part where p_name = 'red bolt'")
def find_nodes(spark, d):
    nodes = part_nodes(spark, d)
    return G.find_nodes(nodes, "synonyms", "red bolt").select("id")


@query("""with n as (select *, p_name || '|' || p_brand as k from part)
    select k, p_partkey from n where p_size > 25 union all select k, arg_min(p_partkey, p_partkey) from n where p_size <= 25 and k not in (select k from n where p_size > 25) group by k""")
def node_upsert_first_wins(spark, d):
    nodes = part_nodes(spark, d).withColumn("name", F.concat_ws("|", "name", F.col("props")["brand"]))
    large = F.col("props")["_size"].cast("int") > 25
    return G.upsert_nodes(nodes.filter(large), nodes.filter(~large), "name").select(F.col("name").alias("k"), F.col("id").alias("p_partkey"))


def _half_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges of line items with status F, and of the others."""
    f = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id")
    closed = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(f).distinct()
    edges = item_edges(spark, d)
    return edges.join(closed, "id", "left_semi"), edges.join(closed, "id", "left_anti")


@query("""with f as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_linestatus = 'F'), l as (select l.*, f.l_orderkey is not null as closed from lineitem l left join f using (l_orderkey, l_linenumber, l_partkey, l_suppkey))
    select l_partkey as a, l_suppkey as b, l_returnflag as type from l where closed union all
    (select l_partkey, l_suppkey, l_returnflag from l where not closed except select l_partkey, l_suppkey, l_returnflag from l where closed)""")
def edge_upsert_undirected(spark, d):
    return G.upsert_edges(*_half_edges(spark, d)).select(F.col("src").alias("a"), (-1 - F.col("dst")).alias("b"), "type")


@query("select b.p_partkey as src, a.p_partkey as dst, a.p_name as value from part a join part b on a.p_name = b.p_name and b.p_partkey > a.p_partkey and b.p_brand = a.p_brand")
def stitch_synonyms(spark, d):
    nodes = part_nodes(spark, d).withColumn("synonyms", F.array(F.concat_ws("|", "name", F.col("props")["brand"])))
    return G.stitch(nodes).select("src", "dst", F.substring_index("value", "|", 1).alias("value"))


@query("""select l_orderkey, count(*) as items, max(l_suppkey) as last_supplier, cast(count(*) filter (l_returnflag = 'R') > 0 as boolean) as returned, o_orderstatus = 'F' as known
    from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey, o_orderstatus""")
def edge_merge_last_wins(spark, d):
    """Edges of closed orders exist; each line item upserts its order's edge, by its key or by type and ends."""
    order, item = table(spark, d, "orders").filter("o_orderstatus = 'F'"), table(spark, d, "lineitem")
    edge = lambda key, seq, *props: (
        F.lit(1).cast("long").alias("kgraph_id"), F.xxhash64(F.col(key), F.lit(seq)).alias("id"), F.col(key).alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit("order").alias("type"), F.lit(False).alias("directed"),
        F.create_map(*props).alias("props"), F.col(seq).cast("long").alias("seq"),
    )
    have = order.select(*edge("o_orderkey", "o_orderkey", F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("known"), F.lit("true")))
    flag = F.when(F.col("l_returnflag") == "R", F.lit("returned")).otherwise(F.lit("kept"))
    key = F.when(F.col("l_linenumber") > 1, F.lit("key")).otherwise(F.lit("line"))
    new = item.select(*edge("l_orderkey", "l_suppkey", key, F.col("l_orderkey").cast("string"), F.lit("supplier"), F.col("l_suppkey").cast("string"), flag, F.lit("true")))
    count = item.groupBy(F.col("l_orderkey").alias("src")).agg(F.count("*").alias("items"))
    has = lambda k: F.coalesce(F.map_contains_key("props", F.lit(k)), F.lit(False)).alias(k)
    return G.merge_edges(have, new, "key").join(count, "src").select(F.col("src").alias("l_orderkey"), "items", F.col("props")["supplier"].cast("long").alias("last_supplier"), has("returned"), has("known"))


@query("select count(*) as edges_left, (select count(*) from part where p_type != 'PROMO') as nodes_left from lineitem l join part p on p.p_partkey = l.l_partkey where p.p_type != 'PROMO'")
def remove_graph(spark, d):
    promo = F.when(F.array_contains("tags", "PROMO"), 2).otherwise(1).cast("long")
    nodes, edges = G.remove_graph(part_nodes(spark, d).withColumn("kgraph_id", promo), item_edges(spark, d), 2)
    return edges.agg(F.count("*").alias("edges_left")).crossJoin(nodes.agg(F.count("*").alias("nodes_left")))


@query("select p_partkey as id, p_brand as brand from part")
def visible_props(spark, d):
    return part_nodes(spark, d).select("id", S.visible(F.col("props")).alias("p")).select("id", F.array_join(F.map_values("p"), ",").alias("brand"))


@query("""select p_partkey as id, '{"@id":' || p_partkey || ',"@type":"concept","name":"' || p_name || '","created":0,"uri":"part/' || p_partkey || '","tags":["' || p_type || '","' || p_brand || '"],"props":{"brand":"' || p_brand || '"}}' as json from part""")
def entity_json(spark, d):
    return G.entity_json(part_nodes(spark, d)).select("id", "json")


# --- predications ------------------------------------------------------------------------------------------------------------------------


@query("select l_partkey as subject, min(l_linestatus) as subtype, l_returnflag as predicate, l_suppkey as object, count(*) as cnt from lineitem group by l_partkey, l_returnflag, l_suppkey having count(*) > 1")
def predication_count(spark, d):
    return P.predication_count(predication_rows(spark, d), 1).select("subject", "subtype", "predicate", "object", "cnt")


@query("""select cast(g.s as varchar) as subject, g.p as predicate, cast(g.o as varchar) as object, g.cnt, e.l_orderkey as pmid, d.o_orderpriority as sentence
    from (select l_partkey as s, l_returnflag as p, l_suppkey as o, count(*) as cnt from lineitem group by 1, 2, 3 having count(*) > 1) g
    join lineitem e on e.l_partkey = g.s and e.l_returnflag = g.p and e.l_suppkey = g.o join orders d on d.o_orderkey = e.l_orderkey""")
def predication_evidence(spark, d):
    rows = predication_rows(spark, d)
    return P.with_evidence(P.predication_count(rows, 1).select("subject", "predicate", "object", "cnt"), rows, sentence_rows(spark, d)).select("subject", "predicate", "object", "cnt", "pmid", "sentence")


@query("""select cast(l_partkey as varchar) as subject, l_returnflag as predicate, cast(l_suppkey as varchar) as object, string_agg(cast(l_orderkey as varchar), ',' order by l_orderkey) as pmids
    from lineitem join orders on o_orderkey = l_orderkey group by 1, 2, 3 having count(*) > 1""")
def nested_evidence(spark, d):
    rows = predication_rows(spark, d)
    found = P.with_evidence(P.predication_count(rows, 1).select("subject", "predicate", "object", "cnt"), rows, sentence_rows(spark, d))
    return P.nested_evidence(found).select("subject", "predicate", "object", F.array_join(F.transform("evidence", lambda e: e["pmid"].cast("string")), ",").alias("pmids"))


@query("""with i as (select cast(l_partkey as varchar) as s, l_returnflag as p, 'C' || l_suppkey as o, l_linestatus as t, l_orderkey as d from lineitem),
    g as (select s, p, o, min(t) as t from i group by 1, 2, 3), r as (select s as concept, * from g union all select o, * from g)
    select concept, 'predicate' as kind, p as value, count(*) as n from r group by 1, 3 union all select concept, 'concept', o, count(*) from r group by 1, 3
    union all select concept, 'semtype', t, 2 * count(*) from r group by 1, 3 union all select concept, 'pmids', 'distinct', count(distinct d) from (select s as concept, d from i union all select o, d from i) u group by 1""")
def predicate_summary(spark, d):
    rows = predication_rows(spark, d)
    return P.summary(rows.withColumns({"subject": F.col("subject").cast("string"), "object": F.concat(F.lit("C"), F.col("object").cast("string"))}))


@query("select s.s_name, t.n from (select l_suppkey, count(*) as n from lineitem group by l_suppkey) t join supplier s on s.s_suppkey = t.l_suppkey order by t.n desc, s.s_name asc limit 20")
def related_concepts_ranked(spark, d):
    names = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return P.related(predication_rows(spark, d), names, "s_suppkey", "s_name", 20)


@query("select l.l_orderkey as pmid, l.l_partkey as subject, l.l_suppkey as object, l.l_returnflag as predicate, o.o_orderpriority as sentence from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderpriority = '1-URGENT'")
def predications_by_pmid(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("pmid"))
    return P.by_pmid(predication_rows(spark, d), sentence_rows(spark, d), urgent).select("pmid", "subject", "object", "predicate", "sentence")


@query("select l_partkey as subject, l_suppkey as object, count(*) as n from lineitem where l_returnflag = 'A' group by 1, 2")
def predications_by_predicate(spark, d):
    return P.with_predicate(predication_rows(spark, d), "A").groupBy("subject", "object").agg(F.count("*").alias("n"))


@query("select l_returnflag as predicate, count(*) as n from lineitem where l_linestatus = 'O' group by 1")
def predications_by_semtype(spark, d):
    return P.with_semtype(predication_rows(spark, d), "O").groupBy("predicate").agg(F.count("*").alias("n"))


@query("select l_partkey as subject, count(*) as n from lineitem where l_suppkey = 7 group by 1")
def predications_by_object(spark, d):
    return P.with_object(predication_rows(spark, d), "7").groupBy("subject").agg(F.count("*").alias("n"))


@query("select l_returnflag as predicate, count(*) as n from lineitem where l_linestatus not in ('F') and l_suppkey not in (1, 2, 3) and l_partkey not in (1, 2, 3) group by 1")
def blacklisted_predications(spark, d):
    return P.without_blacklisted(predication_rows(spark, d).withColumns({c: F.col(c).cast("string") for c in ("subject", "object")}), ["F"], ["1", "2", "3"]).groupBy("predicate").agg(F.count("*").alias("n"))


@query("select count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_type = 'PROMO') and l_suppkey in (select p_partkey from part where p_type = 'PROMO')")
def resolved_predications(spark, d):
    known = table(spark, d, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("cui"))
    return P.resolved(predication_rows(spark, d), known).agg(F.count("*").alias("n"))


# --- concepts ----------------------------------------------------------------------------------------------------------------------------


def atom_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as atoms of their brands: the preferred ones have size over 25."""
    return table(spark, d, "part").select(
        F.col("p_brand").alias("cui"), F.col("p_name").alias("str"), F.col("p_type").alias("sab"), F.col("p_partkey").cast("string").alias("scui"), F.lit("PF").alias("stt"),
        F.when(F.col("p_size") > 25, "Y").otherwise("N").alias("ispref"), F.lit("P").alias("ts"), F.col("p_partkey").alias("seq"),
    )


@query("""select p_brand as cui, arg_max(p_name, p_partkey) filter (p_size > 25) as name, cast(count(*) filter (p_size <= 25) as bigint) as n_synonyms, cast(count(*) filter (p_type = 'PROMO') as bigint) as n_definitions, (select count(*) from lineitem where 'Brand#' || l_suppkey = p_brand) as n_relations from part group by p_brand having count(*) filter (p_size > 25) > 0""")
def concept_assembly(spark, d):
    part = table(spark, d, "part")
    defs = part.filter("p_type = 'PROMO'").select(F.col("p_brand").alias("cui"), F.col("p_name").alias("def"), F.col("p_type").alias("sab"))
    kinds = part.select(F.col("p_brand").alias("cui"), F.col("p_type").alias("tui"), F.col("p_type").alias("sty")).distinct()
    rels = table(spark, d, "lineitem").select(F.concat(F.lit("Brand#"), F.col("l_suppkey").cast("string")).alias("cui1"), F.col("l_partkey").cast("string").alias("cui2"), F.col("l_orderkey").cast("string").alias("rui"), F.col("l_returnflag").alias("rel"), F.col("l_linestatus").alias("rela"), F.lit("x").alias("sab"))
    found = C.assemble(atom_rows(spark, d), defs, kinds, rels)
    return found.select("cui", "name", F.coalesce(F.size("synonyms"), F.lit(0)).cast("long").alias("n_synonyms"), F.coalesce(F.size("definitions"), F.lit(0)).cast("long").alias("n_definitions"), F.coalesce(F.size("relations"), F.lit(0)).cast("long").alias("n_relations"))


@query("""with q as (select distinct p_name as term from part union select distinct substr(p_name, strpos(p_name, ' ') + 1) from part), e as (select distinct term, p_brand as cui from q join part on p_name = term),
    w as (select distinct p_brand as cui, p_name as str, unnest(list_distinct(string_split(lower(p_name), ' '))) as word from part),
    a as (select term, unnest(list_distinct(string_split(lower(term), ' '))) as word from q where term not in (select term from e)),
    m as (select term, cui, max(sc) as score from (select term, cui, str, count(*)::double / length(str) as sc from a join w using (word) group by 1, 2, 3) x group by 1, 2)
    select term, cui, cast(null as double) as score from e union all select term, cui, round(score, 6) from (select *, row_number() over (partition by term order by score desc, cui) as place from m) y where place <= 5""")
def find_concepts_exact(spark, d):
    """Whole names, found exactly, and their second words alone, found by share."""
    name = table(spark, d, "part").select(F.col("p_name").alias("term"))
    terms = name.unionByName(name.select(F.expr("substr(term, instr(term, ' ') + 1)").alias("term"))).distinct()
    return C.find(terms, atom_rows(spark, d).dropDuplicates(["cui", "str"]), 5).select("term", "cui", F.round("score", 6).alias("score"))


@query("select count(*) as n from part where p_type not in ('PROMO', 'SMALL')")
def source_blacklist(spark, d):
    return C.without_sources(atom_rows(spark, d), ["PROMO", "SMALL"]).agg(F.count("*").alias("n"))


@query("select p_brand as cui from part where p_partkey = 42")
def concept_by_namespace(spark, d):
    return C.by_namespace(atom_rows(spark, d), "scui", "42")


@query("select p_type as name, string_agg(p_brand, ',' order by p_brand) as versions from (select distinct p_type, p_brand from part) t group by p_type")
def data_sources(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("version"), F.lit("").alias("description")).distinct()
    return C.data_sources(rows).select("name", F.array_join(F.transform("versions", lambda v: v["version"]), ",").alias("versions"))


# --- hierarchies -------------------------------------------------------------------------------------------------------------------------


@query("select 'N' || n_nationkey as child, 'R' || n_regionkey as parent, cast(n_regionkey as varchar) as type from nation")
def parent_links(spark, d):
    return O.parent_links(nation_entries(spark, d))


@query("select 'N' || n_nationkey as ui, 'R' || n_regionkey as ancestor, cast(n_regionkey as varchar) as type from nation")
def ancestor_prefixes(spark, d):
    return O.ancestor_links(nation_entries(spark, d))


@query("""with recursive h(child, ancestor, depth) as (select c_custkey, c_custkey // 2, 1 from customer where c_custkey > 1 union all select child, ancestor // 2, depth + 1 from h where ancestor > 1)
    select child, ancestor, depth from h""")
def hierarchy_closure(spark, d):
    links = table(spark, d, "customer").filter("c_custkey > 1").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 2).cast("long").alias("parent"))
    return O.closure(links)


@query("select p_brand, case when p_brand like 'Brand#13%' then true when p_brand like 'Brand#1%' then false else true end as keep, count(*) as n from part group by p_brand")
def prefix_white_over_black(spark, d):
    return table(spark, d, "part").groupBy("p_brand", O.prefix_rule(F.col("p_brand"), ["Brand#13"], ["Brand#1"]).alias("keep")).agg(F.count("*").alias("n"))


@query("select l_orderkey as pmid, p_brand as ui, count(*) as n from lineitem join part on p_partkey = l_partkey where p_size > 10 group by 1, 2")
def known_headings(spark, d):
    entries = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("ui"), F.col("p_brand").alias("name"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.array(F.struct(F.concat(F.lit("*"), F.col("l_partkey").cast("string")).alias("descriptor"), F.lit(True).alias("major"), F.array().cast("array<string>").alias("qualifiers"))).alias("headings"))
    return O.known_headings(rows, entries).groupBy("pmid", F.col("name").alias("ui")).agg(F.count("*").alias("n"))


@query("select r_name as ui, string_agg(cast(n_nationkey as varchar), ',' order by cast(n_nationkey as varchar)) as tree_numbers from nation join region on r_regionkey = n_regionkey group by r_name")
def descriptor_trees(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("ui"), F.col("r_name").alias("name"), F.col("n_nationkey").cast("string").alias("tree_number"))
    return O.descriptors_with_trees(rows).select("ui", F.array_join("tree_numbers", ",").alias("tree_numbers"))


@query("select 'T' || c_custkey as ui, 'R' || n_regionkey as descriptor from customer join nation on n_nationkey = c_nationkey union all select 'N' || n_nationkey, 'R' || n_regionkey from nation union all select 'R' || r_regionkey, 'R' || r_regionkey from region")
def climb_to_descriptor(spark, d):
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    ui = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    entries = customer.select(ui("T", "c_custkey").alias("ui"), F.lit("Term").alias("kind")).unionByName(nation.select(ui("N", "n_nationkey").alias("ui"), F.lit("Concept").alias("kind"))).unionByName(region.select(ui("R", "r_regionkey").alias("ui"), F.lit("Descriptor").alias("kind")))
    links = customer.select(ui("T", "c_custkey").alias("child"), ui("N", "c_nationkey").alias("parent")).unionByName(nation.select(ui("N", "n_nationkey").alias("child"), ui("R", "n_regionkey").alias("parent")))
    return O.climb(entries, links)


# --- trials ------------------------------------------------------------------------------------------------------------------------------


@query("select l_orderkey as nct_id, l_partkey as item from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#13' order by 1, 2 limit 20 offset 10")
def trials_for_concept(spark, d):
    trial = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nct_id"), F.col("l_partkey").alias("item"))
    concept = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("ui"), F.lit("mesh").alias("kind"))
    return R.studies_for_concept(trial, concept, "Brand#13", "mesh", 10, 20)


@query("""with t as (select distinct l_orderkey as nct_id, p_brand as cui from lineitem join part on p_partkey = l_partkey where p_size > 40)
    select nct_id, string_agg(distinct cui, ',' order by cui) as umls, string_agg(distinct cast(p_partkey as varchar), ',' order by cast(p_partkey as varchar)) as mesh from t join part on p_brand = cui group by 1""")
def condition_concepts(spark, d):
    trial = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nct_id"), F.col("l_partkey").alias("item"))
    part = table(spark, d, "part")
    score = F.when(F.col("p_size") <= 40, F.lit(1.0)).alias("score")
    concept = part.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("ui"), F.lit("umls").alias("kind"), score)
    found = R.condition_sets(trial, concept, atom_rows(spark, d).select("cui", "scui"))  # the texts of a set's concepts are made once for its trials
    return found.select("trials", F.array_join("umls", ",").alias("umls"), F.array_join("mesh", ",").alias("mesh")).select(F.explode("trials").alias("nct_id"), "umls", "mesh")


@query("select p_name as unii, arg_min(p_brand, p_partkey) as name from part group by p_name")
def first_name_per_key(spark, d):
    return R.first_names(table(spark, d, "part").select(F.col("p_name").alias("unii"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq")))


@query("""select p_brand, name, cc as case_count, round(ror, 6) as ror, rank from (select *, cast(row_number() over (partition by p_brand order by cc * ror desc, cc desc, name) as integer) as rank from
    (select p_brand, p_name as name, count(*) filter (l_returnflag = 'R') as cc, cast(count(*) filter (l_returnflag = 'R') as double) / count(*) as ror from lineitem join part on p_partkey = l_partkey group by 1, 2) a where cc > 0) b where rank <= 10""")
def adverse_topk(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", F.col("p_name").alias("name")).agg(F.count_if(F.col("l_returnflag") == "R").alias("case_count"), F.count("*").alias("m"))
    rated = rows.withColumn("ror", F.col("case_count").cast("double") / F.col("m")).withColumn("prr", F.col("ror"))
    return R.adverse_events(rated, ["p_brand"]).select("p_brand", "name", "case_count", F.round("ror", 6).alias("ror"), "rank")


@query("""with p as (select o_custkey as nct_id, c_name as name, o_orderpriority, o_orderstatus from orders join customer on c_custkey = o_custkey)
    select nct_id, name from p where o_orderstatus = 'F' except select nct_id, name from p where o_orderpriority = '1-URGENT'""")
def link_conditions(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    trials = both.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("nct_id"), F.array("c_name").alias("conditions"))
    return R.link_conditions(trials, both.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("nct_id"), F.col("c_name").alias("name")))


@query("select count(*) as n from orders where lower(o_orderpriority) = lower('1-urgent')")
def case_insensitive_filter(spark, d):
    return table(spark, d, "orders").filter(S.same_fold(F.col("o_orderpriority"), F.lit("1-urgent"))).agg(F.count("*").alias("n"))


# --- search ------------------------------------------------------------------------------------------------------------------------------


@query("select 'lang' as dim, lang as value, count(*) as n from documents group by lang union all select 'source', source, count(*) from documents group by source")
def facet_counts(spark, d):
    return T.facets(table(spark, d, "documents"), ["lang", "source"])


@query("select dim, value, n from (select *, row_number() over (partition by dim order by n desc, value) as place from (select 'source' as dim, source as value, count(*) as n from documents group by source) a) b where place <= 5")
def facet_top_children(spark, d):
    return T.facets(table(spark, d, "documents"), ["source"], 5)


@query("select path, n from (select cast(n_regionkey as varchar) as path, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1 union all select n_regionkey || '.' || n_nationkey, count(*) from customer join nation on n_nationkey = c_nationkey group by 1) t")
def facet_hierarchy(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return T.path_facets(rows, "c_custkey", F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")))


@query("select doc_id, round((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3.0 / length(text), 9) as score from documents where contains(lower(text), 'the') order by (length(lower(text)) - length(replace(lower(text), 'the', ''))) / cast(3 as double) / length(text) desc, doc_id limit 10")
def fulltext_topk(spark, d):
    return T.substring_topk(table(spark, d, "documents"), "doc_id", "text", "the", 10).select("doc_id", F.round("score", 9).alias("score"))


TOKENS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x != '')"


@query(f"select term, id, count(*) as tf, size from (select doc_id as id, len(t) as size, unnest(t) as term from (select doc_id, {TOKENS_SQL} as t from documents) a) b group by term, id, size")
def inverted_index(spark, d):
    docs = T.dealt_texts(table(spark, d, "documents"), "doc_id", "text")
    return T.inverted_index(docs, "doc_id", "text").select("term", "id", "tf", F.col("size").cast("long").alias("size"))


@query(f"""with t as (select doc_id as id, {TOKENS_SQL} as t from documents), i as (select term, id, size, count(*) as tf from (select id, len(t) as size, unnest(t) as term from t) a where term in ('ation', 'the', 'loser') group by 1, 2, 3),
    g as (select count(*) as n, cast(avg(len(t)) as double) as m from t), f as (select term, count(*) as df from i group by term)
    select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 6) as score from i join f using (term) cross join g group by id order by score desc, id limit 10""")
def bm25_topk(spark, d):
    docs = table(spark, d, "documents")
    return T.bm25(T.inverted_index(docs, "doc_id", "text"), ["ation", "the", "loser"], *T.corpus_size(docs, "text"), 10).select("id", F.round("score", 6).alias("score"))


@query(f"""with b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x != '') as p from benchmark), w as (select doc_id as id, {TOKENS_SQL} as t from documents)
    select id, item_id, cast(len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 1] = p)) as bigint) as n
    from w join b on len(p) > 0 and contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')""")
def phrase_mentions(spark, d):
    return A.mentions(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


@query("select d.source, count(*) as n from documents d where d.lang not in ('fr', 'es') group by d.source")
def blacklist_anti(spark, d):
    return table(spark, d, "documents").filter(~F.col("lang").isin("fr", "es")).groupBy("source").agg(F.count("*").alias("n"))


@query("select count(*) as n from documents d left join labels l on l.doc_id = d.doc_id where l.doc_id is null")
def unresolved_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("n"))


@query("select text as k, min(doc_id) as first_id, max(doc_id) as last_id, count(*) as n from documents group by text having count(*) > 1")
def dedupe_by_key(spark, d):
    return table(spark, d, "documents").groupBy(F.col("text").alias("k")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1")


@query("select c_custkey, c_name from customer order by c_custkey limit 10 offset 20")
def pagination(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(20).limit(10)


@query("select conv_id, string_agg(role, ',' order by turn) as roles, count(*) as n from conversations group by conv_id")
def ordered_nested_rows(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count("*").alias("n"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"), "n")


# --- scalar functions --------------------------------------------------------------------------------------------------------------------


@query("select p_partkey, split_part(p_brand, '#', 2) as tail, split_part(p_brand, '#', 1) as head from part")
def pipe_strip(spark, d):
    return table(spark, d, "part").select("p_partkey", S.last_token(F.col("p_brand"), "#").alias("tail"), S.strip_pipe(F.translate("p_brand", "#", "|")).alias("head"))


@query("select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events")
def json_long(spark, d):
    return table(spark, d, "events").select("event_id", S.json_long(F.col("props"), "$.k").alias("k"))


@query("select doc_id, sha1(text) as sha from documents")
def sha1_registry(spark, d):
    return table(spark, d, "documents").select("doc_id", S.sha1_hex(F.col("text")).alias("sha"))


@query("select o_orderkey, cast(year(o_orderdate) as integer) as y, strftime(o_orderdate, '%Y.%m.%d') as day, cast(epoch_ms(o_orderdate) as bigint) as ms from orders")
def date_parts(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.year_of(F.col("o_orderdate")).alias("y"), S.dotted_date(F.col("o_orderdate")).alias("day"), S.to_epoch_ms(F.col("o_orderdate").cast("timestamp")).alias("ms"))


@query("select doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) as ascii_chars from documents")
def ascii_kept(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace("text", r"[^\x00-\x7F]", "")).cast("long").alias("ascii_chars"))


@query()
def to_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", S.to_ascii(F.col("text")).alias("ascii"))


@query("select p_partkey, p_brand || ';' || p_type as categories, 'https://x/' || p_partkey as uri, cast(floor(p_size / 10) + 1 as integer) as page from part")
def joined_and_templated(spark, d):
    return table(spark, d, "part").select("p_partkey", S.join_values(F.array("p_brand", "p_type")).alias("categories"), S.uri("https://x/%d", F.col("p_partkey")).alias("uri"), S.page_number(F.col("p_size"), F.lit(10)).alias("page"))


@query("select p_partkey, case p_type when 'PROMO' then 'drug' else p_type end as kind, case when p_partkey % 2 = 0 then p_name else p_brand end as other from part")
def mapped_types(spark, d):
    part = table(spark, d, "part")
    group = F.when(F.col("p_type") == "PROMO", "CHEM").otherwise(F.col("p_type"))
    return part.select("p_partkey", S.node_type(group).alias("kind"), S.other_side(F.col("p_partkey") % 2, F.col("p_name"), F.lit(0)).alias("x"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("other")).drop("x")


# --- expansion and events ----------------------------------------------------------------------------------------------------------------


@query("select distinct l_partkey as id, 'supplier/' || l_suppkey as uri, lower(l_returnflag) as type from lineitem join part on p_partkey = l_partkey where p_size > 40")
def expand_links(spark, d):
    """Edges of large parts after an expansion by all links of a graph that has those of open line items already."""
    nodes = part_nodes(spark, d).filter(F.col("props")["_size"].cast("int") > 40)
    links = table(spark, d, "lineitem").select("l_linestatus", F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("uri"), F.lit("target").alias("kind"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("ref"), F.lit("s").alias("name"), F.col("l_returnflag").alias("action"))
    none = item_edges(spark, d).filter("src < 0")  # line items start at parts, so a graph begins without edges
    have = E.expand(nodes, none, {"links": links.filter("l_linestatus = 'O'").drop("l_linestatus").distinct()}, ["links"])
    grown, edges = E.expand(*have, {"links": links.drop("l_linestatus").distinct()}, ["links"])
    return edges.join(grown.select(F.col("id").alias("dst"), "uri"), "dst").select(F.col("src").alias("id"), "uri", "type")


@query("select oper, count(*) as n from (select case when p_partkey % 3 = 0 then 'ADD' when p_partkey % 3 = 1 then 'DELETE' else 'UPDATE' end as oper from part) t group by oper")
def change_events(spark, d):
    nodes = part_nodes(spark, d)
    third = F.col("id") % 3
    after = nodes.filter(third != 1).withColumn("name", F.when(third == 2, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return feed.changes(nodes.filter(third != 0), after, "knode").groupBy("oper").agg(F.count("*").alias("n"))


@query("select cast(date_trunc('hour', ts) as timestamp) as window_start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feed.windowed_counts(rows, "ts", ["event_type"], "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""select user_id, count(*) as n_sessions, cast(sum(n) as bigint) as n_events from (select user_id, s, count(*) as n from (select user_id, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s
    from (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 1 day, true) as gap from events) a) b group by 1, 2) c group by user_id""")
def event_sessions(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feed.session_counts(rows, "ts", ["user_id"], "1 day").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def first_event_per_key(spark, d):
    return G.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) t where rn = 1")
def last_event_per_key(spark, d):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, d, "events").withColumn("rn", place).filter("rn = 1").select("user_id", "event_id", "value")
