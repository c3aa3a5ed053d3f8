"""Queries of expanders that search, and of links that their properties decide about: parts are proteins or what is asked for, suppliers what is found."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import seeking as K
from loomgraph.operators.expand import REGISTRY
from loomgraph.plans.catalog import item_edges, part_nodes, query, supplier_nodes, table
from loomgraph.plans.texts import both


def key(prefix, c):
    return both(prefix, F.col(c).cast("string"))


def named(result, *columns):
    """The new edges with the uri of the node that they lead to."""
    nodes, edges = result
    return edges.join(nodes.select(F.col("id").alias("dst"), "uri").distinct(), "dst").select("src", "uri", "type", *columns).distinct()


@query("""with e as (select case p_size % 3 when 0 then 'target' when 1 then 'ligand' else 'disease' end as kind, 'e' || p_partkey as ref, p_name || ' ' || p_type as name from part where p_size % 3 != 0 or p_size % 2 = 0),
    w as (select *, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x != '') as t from e), a as (select distinct p_type as q from part),
    m as (select kind, avg(len(t)) as m from w group by kind), f as (select q, kind, ref, len(t) as size, len(list_filter(t, lambda x: x = lower(q))) as tf from a join w on contains(' ' || array_to_string(t, ' ') || ' ', ' ' || lower(q) || ' ')),
    h as (select q, kind, ref, row_number() over (partition by q, kind order by round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m)), 9) desc, ref) as place from f join m using (kind))
    select q, kind, ref from h where place <= 20""")
def searched_entries(spark, d):
    """The best 20 entries of each kind for each type of part as a phrase; targets only at the clinical level."""
    part = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "target").when(F.col("p_size") % 3 == 1, "ligand").otherwise("disease")
    level = F.when((F.col("p_size") % 3 == 0) & (F.col("p_size") % 2 == 0), "Tclin").when(F.col("p_size") % 3 == 0, "Tdark")
    entries = part.select(kind.alias("kind"), key("e", "p_partkey").alias("ref"), both(F.col("p_name"), " ", F.col("p_type")).alias("name"), level.alias("level"))
    asks = part.select("p_type").distinct().select(
        F.lit(1).cast("long").alias("kgraph_id"), F.xxhash64("p_type").alias("id"), F.lit("query").alias("type"), F.lit(None).cast("string").alias("name"), F.col("p_type").alias("uri"), F.create_map(F.lit("term"), F.col("p_type")).alias("props")
    )
    nodes, edges = REGISTRY["entry_search"](asks, {"entries": entries})
    found = edges.join(nodes.select(F.col("id").alias("dst"), "uri", F.get("tags", F.lit(0)).alias("kind")).distinct(), "dst")
    return found.join(asks.select(F.col("id").alias("src"), F.col("uri").alias("q")), "src").select("q", "kind", F.col("uri").alias("ref"))


@query("""with l as (select l_partkey as src, l_orderkey as turn, case l_linenumber % 3 when 0 then 'ligand' when 1 then 'disease' else 'target' end as kind, l_suppkey as s, l_returnflag as f, lower(l_linestatus) as a from lineitem),
    r as (select *, kind || '/' || s as uri, row_number() over (partition by src, kind order by turn, kind || '/' || s) as place from l where kind != 'target')
    select distinct src, uri, case when kind = 'disease' then 'indication' when f = 'R' then a else 'assertion' end as type from r where place <= 20 and (kind = 'ligand' and f != 'A' or kind = 'disease' and f = 'A')""")
def linked_kinds(spark, d):
    """Ligands and diseases of parts, by what the links' properties tell."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "ligand").when(F.col("l_linenumber") % 3 == 1, "disease").otherwise("target")
    prop = lambda label, term: F.array(F.struct(F.lit(label).alias("label"), term.alias("term"), F.lit("h").alias("href")))
    props = F.when(F.col("l_returnflag") == "R", prop(K.ACTION, F.col("l_linestatus"))).when(F.col("l_returnflag") == "A", prop(K.SOURCE, F.lit(K.INDICATION))).otherwise(F.array().cast("array<struct<label:string,term:string,href:string>>"))
    links = table(spark, d, "lineitem").select(key("part/", "l_partkey").alias("uri"), F.col("l_orderkey").alias("turn"), kind.alias("kind"), F.concat_ws("/", kind, F.col("l_suppkey").cast("string")).alias("ref"), props.alias("properties"))
    entries = table(spark, d, "supplier").select(F.explode(F.array(F.lit("ligand"), F.lit("disease"))).alias("kind"), "s_suppkey", F.col("s_name").alias("name")).select("kind", F.concat_ws("/", "kind", F.col("s_suppkey").cast("string")).alias("ref"), "name", F.lit(None).cast("string").alias("level"))
    return named(REGISTRY["kind_links"](part_nodes(spark, d).withColumn("type", F.lit("protein")), {"kind_links": links, "entries": entries}))


@query("""with c as (select lower(p_name) as low, 'C' || n_nationkey as cui from nation join part on p_partkey = n_nationkey)
    select distinct p_partkey as src, cui as uri, 'resolve' as type, upper(p_name) as matched from part join c on low = lower(p_name)""")
def named_concepts(spark, d):
    """Concepts that have a part's name."""
    nation = table(spark, d, "nation").join(table(spark, d, "part").withColumnRenamed("p_partkey", "n_nationkey"), "n_nationkey")
    tables = {"concept_names": nation.select(F.upper("p_name").alias("name"), key("C", "n_nationkey").alias("cui")), "concepts": nation.select(key("C", "n_nationkey").alias("cui"), F.col("n_name").alias("name"), F.array("p_type").alias("semantic_types"))}
    return named(REGISTRY["name_concepts"](part_nodes(spark, d), tables), F.col("props")["name"].alias("matched"))


@query("""with o as (select l_suppkey as s, p_brand as name, count(*) as n, count(*) % 3 + 1 as ror from lineitem join part on p_partkey = l_partkey group by 1, 2),
    r as (select *, row_number() over (partition by s order by n * ror desc, n desc, name) as place from o)
    select 'supplier/' || s_suppkey as src, 'unii/U' || s_suppkey as dst, 'resolve' as type from supplier where s_nationkey < 20
    union all select 'unii/U' || s, 'adverse/' || name, 'assertion' from r join supplier on s_suppkey = s and s_nationkey < 20 where place <= 10""")
def anchored_drugs(spark, d):
    """Suppliers as drugs: their anchors, and the adverse events of these."""
    supplier, items = table(spark, d, "supplier"), table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    outcomes = items.groupBy(key("U", "l_suppkey").alias("unii"), F.col("p_brand").alias("name")).agg(F.count("*").alias("case_count")).withColumns({"ror": (F.col("case_count") % 3 + 1).cast("double"), "prr": F.lit(1.0)})
    tables = {"uniis": supplier.filter("s_nationkey < 20").select(key("U", "s_suppkey").alias("unii"), F.upper("s_name").alias("preferred_term"), F.col("s_name").alias("name")), "outcomes": outcomes}
    drugs = supplier_nodes(spark, d).withColumn("type", F.lit("drug"))
    nodes, edges = K.anchored_drugs(drugs, item_edges(spark, d).limit(0), tables)
    uris = drugs.select("id", "uri").unionByName(nodes.select("id", "uri")).distinct()
    return edges.join(uris.withColumnsRenamed({"id": "src", "uri": "from"}), "src").join(uris.withColumnsRenamed({"id": "dst", "uri": "to"}), "dst").select(F.col("from").alias("src"), F.col("to").alias("dst"), "type").distinct()
