"""Queries of the scalar functions and of small operators over the test tables; their texts are put together from columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import concepts as C
from loomgraph.operators import expand as E
from loomgraph.operators import graph as G
from loomgraph.operators import ontology as O
from loomgraph.operators import predications as P
from loomgraph.operators import search as T
from loomgraph.operators import trials as R
from loomgraph.operators.rounds import parts_for
from loomgraph.plans.catalog import item_edges, part_nodes, predication_rows, query, supplier_nodes, table


def both(*parts):
    """A text put together of columns and plain strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query(r"""select p_partkey as id, case when p_size > 25 then '"' || p_name || ' +x"' else regexp_replace(p_name || ' (' || p_brand || '):a+b*', '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') end as q from part""")
def escaped_queries(spark, d):
    text = F.when(F.col("p_size") > 25, both('"', F.col("p_name"), ' +x"')).otherwise(both(F.col("p_name"), " (", F.col("p_brand"), "):a+b*"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.escape_query(text).alias("q"))


@query("""select p_partkey as id, p_name || ' ' || p_brand || ' SYN' as bare, p_brand as quoted, p_name as holder, p_name as target, p_brand as ui, 'HP:' || p_partkey as parent from part""")
def trimmed_texts(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), S.unquote(both(F.col("p_name"), ' "', F.col("p_brand"), '" SYN')).alias("bare"), S.quoted(both(F.col("p_name"), ' "', F.col("p_brand"), '" "x"')).alias("quoted"), S.trim_holder(both(F.col("p_name"), ", LICENSE HOLDER UNSPECIFIED, ", F.col("p_brand"))).alias("holder"),
        S.before_last_space(both(F.col("p_name"), " inhibitor")).alias("target"), S.strip_star(both("*", F.col("p_brand"))).alias("ui"), S.strip_comment(both("HP:", F.col("p_partkey").cast("string"), " ! ", F.col("p_name"))).alias("parent"),
    )


@query("""select p_partkey as id, 'PMID' as namespace, cast(p_partkey as varchar) as value, p_partkey as number from part union all select p_partkey, 'HPO', p_type, cast(null as bigint) from part
    union all select p_partkey, 'ORCID', '0-' || p_size, cast(null as bigint) from part""")
def reference_ids(spark, d):
    found = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(S.extract_ids(both("see pmid:", F.col("p_partkey").cast("string"), ", HPO:", F.col("p_type"), " and orcid:0-", F.col("p_size").cast("string")))).alias("r"))
    return found.select("id", "r.*")


@query("""select p_partkey as id, case when p_size > 25 then 'PMID' else 'UMLS' end as namespace, cast(p_partkey as varchar) as value, case when p_size > 25 then p_partkey end as number from part""")
def cross_references(spark, d):
    name = F.when(F.col("p_size") > 25, "pmid:").otherwise("umls:")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.namespace_split(F.concat(name, F.col("p_partkey").cast("string"))).alias("r")).select("id", "r.*")


@query("""select p_partkey as id, replace(p_name, ' ', '+') as coded, p_name || '"' as plain from part""")
def percent_codes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.percent_encode(F.col("p_name")).alias("coded"), S.percent_decode(both(F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")), "%22")).alias("plain"))


@query("""select o_orderkey as id, case when o_orderstatus = 'F' then '' else o_orderstatus || ': ' end || o_orderpriority as text, '<a> ' || o_orderpriority as xml, o_orderstatus as key, o_orderpriority || ':x' as value, o_orderkey as n from orders""")
def article_texts(spark, d):
    label, text = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), F.col("o_orderpriority")
    field = S.field_split(both(F.col("o_orderstatus"), ":  ", text, ":x"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), S.labelled_text(label, text).alias("text"), S.xml_unescape(both("<!DOCTYPE a b><pre>&lt;a&gt; ", text, "</pre>")).alias("xml"), field["key"].alias("key"), field["value"].alias("value"),
        S.thousands_int(F.format_number("o_orderkey", 0)).cast("long").alias("n"),
    )


@query("select p_partkey as id, round(4.0 / length(p_name), 6) as score, cast(p_partkey // 20 + 1 as integer) as page, p_partkey as target, p_size > 25 as known from part")
def scored_pages(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.round(S.match_score(F.lit(4.0), F.col("p_name")), 6).alias("score"), S.page_number(F.col("p_partkey"), F.lit(20)).alias("page"), S.id_from_uri(both("http://h/targets(", F.col("p_partkey").cast("string"), ")"), "targets").alias("target"),
        S.is_cui(F.when(F.col("p_size") > 25, both("c", F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))).alias("known"),
    )


@query("""select p_partkey as id, p_name || ';' || p_type || ';' || p_name as flat, p_name || ';' || p_type as synonyms, p_name as first, p_name || ';' || p_type || ';' || p_name || ';' || p_brand as more,
    case when p_type = p_brand then p_type else p_type || ';' || p_brand end as tags from part""")
def nested_arrays(spark, d):
    flat = S.flat_compact(F.array(F.array(F.col("p_name"), F.lit(None)), F.array(F.col("p_type"), F.col("p_name"))))
    text = lambda c: S.join_values(c)
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), text(flat).alias("flat"), text(C.ordered_distinct(flat)).alias("synonyms"), S.first_of(flat).alias("first"), text(S.appended(flat, F.col("p_brand"))).alias("more"), text(S.add_tags(F.array("p_type"), F.array(F.col("p_brand"), F.col("p_type")))).alias("tags"),
    )


@query("""select p_partkey as id, p_name as put, p_brand as kept, p_type as added, p_name as over, 2 as n from part""")
def property_maps(spark, d):
    have, new = F.create_map(F.lit("a"), F.col("p_brand")), F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_type"))
    merged = S.put_all(have, new)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.put(have, "a", F.col("p_name"))["a"].alias("put"), S.put_if_absent(have, "a", F.col("p_name"))["a"].alias("kept"), S.put_if_absent(have, "b", F.col("p_type"))["b"].alias("added"), merged["a"].alias("over"), F.size(merged).alias("n"))


@query("select event_id, array_to_string(list_sort(json_keys(props)), ',') as keys, json_extract_string(props, '$.k') is not null as has_k, json_extract_string(props, '$.k') as k from events")
def json_keys(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(S.json_fields(F.col("props"))), ",").alias("keys"), S.json_has(F.col("props"), "$.k").alias("has_k"), S.json_props(F.col("props"))["k"].alias("k"))


@query("""select l_suppkey as other, l_returnflag as predicate, count(*) as n from lineitem where l_partkey = 7 group by 1, 2 union all select l_partkey, l_returnflag, count(*) from lineitem where l_suppkey = 7 group by 1, 2""")
def predications_around(spark, d):
    """The concept at the other end, from both sides; objects are told from subjects by what they are keys of."""
    rows = predication_rows(spark, d).withColumns({"subject": both("P", F.col("subject").cast("string")), "object": both("S", F.col("object").cast("string"))})
    own = P.around(rows, "P7").withColumn("concept", F.lit("P7")).unionByName(P.around(rows, "S7").withColumn("concept", F.lit("S7")))
    other = S.other_side(F.col("subject"), F.col("object"), F.col("concept"))
    return own.groupBy(other.alias("o"), "predicate").agg(F.count("*").alias("n"), F.first("concept").alias("c")).select(F.substring("o", 2, 20).cast("long").alias("other"), "predicate", "n")


@query("select -1 - l_suppkey as other, count(*) as n from lineitem where l_partkey = 7 group by 1 union all select l_partkey, count(*) from lineitem where l_suppkey = 6 group by 1")
def edge_other_ends(spark, d):
    edges = item_edges(spark, d)
    ends = edges.select(G.other_end(F.lit(7)).alias("other")).unionByName(edges.select(G.other_end(F.lit(-7)).alias("other")))
    return ends.filter("other is not null").groupBy("other").agg(F.count("*").alias("n"))


@query("select o_orderkey as id from orders where o_orderkey between 100 and 300 union all select o_orderkey from orders where o_orderkey = 7")
def indexed_ids(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return T.in_range(orders, "id", 100, 300).unionByName(T.in_range(orders, "id", 7, 7))


@query("select p_partkey as id from part where p_size > 25")
def nodes_with_property(spark, d):
    nodes = part_nodes(spark, d).withColumn("props", F.when(F.col("props")["_size"].cast("int") > 25, S.put(F.col("props"), "large", F.lit("yes"))).otherwise(F.col("props")))
    return G.with_property(nodes, "large").select("id")


@query("""select kind, ref, count(*) as n from (select o_orderstatus as kind, o_custkey as ref, o_orderpriority as label from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') or o_orderstatus = 'O') t group by 1, 2""")
def links_by_kind(spark, d):
    links = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("ref"), F.array(F.struct(F.lit("priority").alias("label"), F.col("o_orderpriority").alias("term"))).alias("properties"))
    return E.links_with(links, {"F": ("priority", ["1-URGENT", "2-HIGH"]), "O": None}).groupBy("kind", "ref").agg(F.count("*").alias("n"))


@query("select p_partkey as id, p_brand as uniprot, p_type as action from part where p_name like 'red%' and p_size > 25")
def drug_targets(spark, d):
    source = F.when(F.col("p_name").startswith("red"), "Swiss-Prot").otherwise("TrEMBL")
    target = F.struct(source.alias("source"), F.col("p_name").alias("name"), F.col("p_brand").alias("uniprot"), F.when(F.col("p_size") > 25, F.array(F.col("p_type"), F.lit("x"))).alias("actions"))
    return E.protein_targets(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(target).alias("targets")), "targets").select("id", "uniprot", "action")


@query("select cast(p_partkey as varchar) as cui, cast(count(l_partkey) as bigint) as n from part left join lineitem on l_partkey = p_partkey and l_suppkey = 7 group by 1")
def relations_to(spark, d):
    rels = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("cui"), F.col("l_returnflag").alias("rel"))).alias("relations"))
    concepts = table(spark, d, "part").join(rels, "p_partkey", "left")
    return concepts.select(F.col("p_partkey").cast("string").alias("cui"), F.size(F.coalesce(C.relations_to(F.col("relations"), "7"), F.array())).cast("long").alias("n"))


@query("select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#13')")
def unanchored_nodes(spark, d):
    nodes = supplier_nodes(spark, d)
    return G.without_tagged_neighbors(nodes, item_edges(spark, d), part_nodes(spark, d), "Brand#13").select((-1 - F.col("id")).alias("s_suppkey"))


@query("select o_custkey as id, o_orderstatus as key, count(*) > 1 as many, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as value from orders group by 1, 2")
def repeated_fields(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("seq"))
    return C.promoted(rows).select("id", "key", (F.size("values") > 1).alias("many"), S.join_values(F.col("values"), ",").alias("value"))


@query("select event_type as file, count(*) as n, count(distinct user_id) as users, max(ts) as updated from events group by 1")
def load_counts(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("file"), "user_id", "ts")
    return C.load_counts(rows, "file", "ts", "user_id").withColumnRenamed("kinds", "users")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) t where place <= 10")
def first_links(spark, d):
    return T.first_n(table(spark, d, "orders"), ["o_custkey"], 10, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("select n_nationkey as ui, n_name as name from nation where n_regionkey in (1, 2) and n_name in (select n_name from nation where n_nationkey > 5)")
def qualifiers_by_name(spark, d):
    nation = table(spark, d, "nation")
    kind = F.when(F.col("n_regionkey").isin(1, 2), "Qualifier").otherwise("Descriptor")
    names = nation.filter("n_nationkey > 5").select(F.col("n_name").alias("name"))
    return O.named_qualifiers(nation.select(F.col("n_nationkey").alias("ui"), F.col("n_name").alias("name"), kind.alias("kind")), names).select("ui", "name")


@query("select l_orderkey as nct_id, l_partkey as unii, p_name as name from lineitem left join (select * from part where p_size > 25) p on p_partkey = l_partkey")
def named_interventions(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nct_id"), F.col("l_partkey").alias("unii"))
    return R.named(links, table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("unii"), F.col("p_name").alias("name"))).select("nct_id", "unii", "name")


@query("select o_orderkey as nct_id from orders where lower(o_orderpriority) = '1-urgent'")
def interventional_trials(spark, d):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Interventional").otherwise("observational")
    return R.interventional(table(spark, d, "orders").select(F.col("o_orderkey").alias("nct_id"), kind.alias("study_types"))).select("nct_id")


@query("""with own as (select distinct l_orderkey as nct_id, l_partkey as unii, p_brand as cui from lineitem join part on p_partkey = l_partkey),
    near as (select nct_id, cui from own union select nct_id, 'Brand#' || s_nationkey from own join supplier on 'Brand#' || s_suppkey = cui),
    mesh as (select p_type as ui, p_brand as cui, p_partkey as regno from part where p_size > 40)
    select nct_id, ui from near join mesh using (cui) union select nct_id, ui from own join mesh on regno = unii""")
def trial_headings(spark, d):
    part = table(spark, d, "part")
    trial = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nct_id"), F.col("l_partkey").alias("unii"))
    near = table(spark, d, "supplier").select(both("Brand#", F.col("s_suppkey").cast("string")).alias("cui"), both("Brand#", F.col("s_nationkey").cast("string")).alias("other"))
    mesh = part.filter("p_size > 40").select(F.col("p_type").alias("ui"), F.col("p_brand").alias("cui"), F.array(F.col("p_partkey")).alias("regno"))
    parts = parts_for(trial)
    return R.intervention_concepts(trial.repartition(parts, "nct_id", "unii").distinct(), part.select(F.col("p_partkey").alias("unii"), F.col("p_brand").alias("cui")), near, mesh, parts)


@query("select n_nationkey as child, n_regionkey + 100 as parent from nation")
def is_a_parents(spark, d):
    ids = lambda c, n: both(f"{n}:", c.cast("string"))
    nation = table(spark, d, "nation").select(ids(F.col("n_nationkey"), "N").alias("id"), F.array(both(ids(F.col("n_regionkey"), "OLD"), " ! ", F.col("n_name"))).alias("is_a"), F.array().cast("array<string>").alias("alt_id"))
    region = table(spark, d, "region").select(ids(F.col("r_regionkey") + 100, "R").alias("id"), F.array().cast("array<string>").alias("is_a"), F.array(ids(F.col("r_regionkey"), "OLD")).alias("alt_id"))
    number = lambda c: F.substring_index(c, ":", -1).cast("int").alias(c)
    return O.is_a_links(nation.unionByName(region)).select(number("child"), number("parent"))


@query("""with r as (select l_orderkey, 'P' || l_partkey as s, l_returnflag as p, 'S' || l_suppkey as o from lineitem join orders on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT')
    select 'concept' as kind, count(*) as n from (select s from r union select o from r) t union all select 'predicate', count(*) from r
    union all select 'member', count(*) from (select l_orderkey, s from r union select l_orderkey, o from r) u""")
def article_predications(spark, d):
    """Concepts, typed edges (one a predication) and membership edges of urgent orders as articles."""
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.lit(1).cast("long").alias("kgraph_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pmid"))
    rows = predication_rows(spark, d).withColumns({"subject": both("P", F.col("subject").cast("string")), "object": both("S", F.col("object").cast("string"))}).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("pmid"), F.col("o_orderpriority").alias("sentence")), "pmid")
    concepts, typed, members = E.article_predications(urgent, rows)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(concepts, "concept").unionByName(count(typed, "predicate")).unionByName(count(members, "member"))
