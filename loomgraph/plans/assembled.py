"""Queries of facets, loads, nested records, and expanders that change the nodes they start from."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import facets as X
from loomgraph.operators import nested as N
from loomgraph.operators import records as M
from loomgraph.operators import search as T
from loomgraph.operators import seeds as S
from loomgraph.operators.rounds import new_folder, stored
from loomgraph.plans.catalog import part_nodes, query, table
from loomgraph.plans.records import RECORDS, _records
from loomgraph.plans.retrieval import WORDS
from loomgraph.plans.texts import both
from loomgraph.sources.loads import Loads

DIMS = f"""d as (select doc_id, lang || '.' || source as place, 'k' || n_chars // 1000 || '.h' || n_chars // 100 as size, list_distinct(list_transform({WORDS}, lambda x: x[1] || '.' || x[1:2])) as words from documents)"""


def _dims():
    number = lambda n: F.floor(F.col("n_chars") / n).cast("string")
    words = F.transform(T.tokens(F.col("text")), lambda t: F.concat_ws(".", F.substring(t, 1, 1), F.substring(t, 1, 2)))
    return {"place": F.array(F.concat_ws(".", "lang", "source")), "size": F.array(both("k", number(1000), ".h", number(100))), "words": words}


@query(f"""with {DIMS}, v as (select doc_id, 'place' as dim, split_part(place, '.', 1) as path from d union all select doc_id, 'size', split_part(size, '.', 1) from d union all select doc_id, 'words', split_part(unnest(words), '.', 1) from d),
    c as (select dim, path, count(distinct doc_id) as n from v group by 1, 2) select dim, path, n from (select *, row_number() over (partition by dim order by n desc, path) as place from c) x where place <= 20""")
def top_facets(spark, d):
    return X.drill_down(table(spark, d, "documents"), "doc_id", _dims())


@query(f"""with {DIMS}, s as (select * from d where (place = 'en' or starts_with(place, 'en.')) and len(list_filter(words, lambda x: x = 't' or starts_with(x, 't.'))) > 0),
    v as (select doc_id, 'place' as dim, place as path from s where starts_with(place, 'en.') union all select doc_id, 'size', split_part(size, '.', 1) from s union all select doc_id, 'words', w from (select doc_id, unnest(words) as w from s) a where starts_with(w, 't.')),
    c as (select dim, path, count(distinct doc_id) as n from v group by 1, 2) select dim, path, n from (select *, row_number() over (partition by dim order by n desc, path) as place from c) x where place <= 20""")
def drilled_facets(spark, d):
    """English texts with a word in t: their sources, sizes, and the two-letter starts below t."""
    return X.drill_down(table(spark, d, "documents"), "doc_id", _dims(), {"place": "en", "words": "t"})


@query("""select 'F' as name, count(*) as n from orders where o_orderstatus = 'F' union all select o_orderstatus, count(*) from orders where o_orderstatus != 'F' group by 1
    union all select 'run 1', count(*) from orders where o_orderstatus = 'F' union all select 'run 2', count(*) from orders where o_orderstatus != 'F' union all select 'run 3', 0""")
def load_runs(spark, d):
    """Orders in files by status, loaded in three runs: one status, all, all again."""
    folder, orders = new_folder(spark, "loads"), table(spark, d, "orders")
    for status in ("F", "O", "P"):
        orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus").coalesce(1).write.csv(f"{folder}/in/{status}")
    loads, schema = Loads(spark, f"{folder}/table"), "o_orderkey long, o_orderstatus string"
    read = lambda paths: spark.read.schema(schema).csv(paths)
    runs = [loads.load(f"{folder}/in/{p}", read, last=F.max("o_orderkey")) for p in ("F", "*", "*")]
    told = spark.createDataFrame([(f"run {i}", r["rows"]) for i, r in enumerate(runs, 1)], "name string, n long")
    return loads.rows(schema).groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n")).unionByName(told)


# Parts are drugs, those of a size over 10 with the id of a molecule; suppliers are molecules too, with a part's name as synonym.
MOLECULES = "s as (select 'CHEMBL9' || s_suppkey as molecule, s_name as name, lower(p_name) as other from supplier left join part on p_partkey = s_suppkey)"


def _drugs(spark, d, make=S.expand_with_updates):
    part, supplier, items = (table(spark, d, t) for t in ("part", "supplier", "lineitem"))
    key = lambda prefix, c: both(prefix, F.col(c).cast("string"))
    nodes = part_nodes(spark, d).withColumn("synonyms", F.when(F.col("props")["_size"].cast("int") > 10, F.array(key("ns:CHEMBL", "id"), F.col("name"))).otherwise(F.array("name")))
    named = supplier.join(part.select(F.col("p_partkey").alias("s_suppkey"), "p_name").hint("merge"), "s_suppkey", "left")
    tables = {
        "molecules": named.select(key("CHEMBL9", "s_suppkey").alias("molecule"), F.col("s_name").alias("name"), F.array("p_name").alias("synonyms")),
        "forms": part.select(key("CHEMBL", "p_partkey").alias("molecule"), key("CHEMBL9", "p_size").alias("form")),
        "actions": items.select(key("CHEMBL", "l_partkey").alias("molecule"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), both('"', F.col("l_returnflag"), " ", F.col("l_linestatus"), ' agent"').alias("mechanism"), key("T", "l_suppkey").alias("target"), F.col("l_returnflag").alias("action")),
        "targets": items.select(key("CHEMBL", "l_partkey").alias("molecule"), key("T", "l_suppkey").alias("target"), key("supplier ", "l_suppkey").alias("name")),
    }
    from loomgraph.plans.catalog import item_edges

    return make(nodes, item_edges(spark, d).limit(0), tables, ["drug_forms", "drug_actions", "drug_targets_of", "drug_search"])


@query(f"""with {MOLECULES}, m as (select id, string_agg(word, ',' order by seq, word) as mechanism from (select distinct l_partkey as id, l_orderkey * 10 + l_linenumber as seq, l_returnflag || ' ' || l_linestatus || ' agent' as word from lineitem join part on p_partkey = l_partkey where p_size > 10) a group by 1),
    f as (select p_partkey as id, min(molecule) as found from part join s on other = lower(p_name) or lower(name) = lower(p_name) where p_size <= 10 group by 1)
    select p_partkey as id, p_brand as brand, mechanism, found from part left join m on m.id = p_partkey left join f on f.id = p_partkey""")
def seed_properties(spark, d):
    """What the expanders have put on the parts: mechanisms in their order, and what the search by name found."""
    props = F.col("props")
    return _drugs(spark, d)[0].filter("uri like 'part/%'").select("id", props["brand"].alias("brand"), props["mechanism"].alias("mechanism"), props["found"].alias("found"))


@query(f"""with {MOLECULES} select p_partkey as id, 'molecule/CHEMBL9' || p_size as uri, 'is equivalent to' as type from part join supplier on s_suppkey = p_size where p_size > 10
    union all select distinct l_partkey, 'target/T' || l_suppkey, unnest([l_returnflag, 'target of']) from lineitem join part on p_partkey = l_partkey where p_size > 10
    union all select distinct p_partkey, 'molecule/' || molecule, 'is equivalent to' from part join s on other = lower(p_name) or lower(name) = lower(p_name) where p_size <= 10""")
def seed_links(spark, d):
    return _drugs(spark, d, S.grown_links).select(F.col("src").alias("id"), "uri", "type")  # links need no properties


NESTED = """rel as (select e.dst as concept, string_agg(e.src || ':' || e.scope, ',' order by e.src, e.scope) as rels from e join n on n.ui = e.src and n.kind = 'Concept' where e.type = 'concept' and e.scope is not null group by 1),
    trm as (select concept, string_agg(term, ',' order by term) as terms from t group by 1),
    con as (select e.src as ui, string_agg(e.dst || '(' || coalesce(rels, '') || '|' || coalesce(terms, '') || ')', ';' order by e.dst) as concepts from e left join rel on rel.concept = e.dst left join trm on trm.concept = e.dst where e.type = 'concept' and e.scope is null group by 1),
    map as (select src as ui, string_agg(dst, ',' order by dst) filter (type = 'mapped') as mapped, string_agg(dst, ',' order by dst) filter (type = 'indexed') as indexed, string_agg(dst, ',' order by dst) filter (type = 'substance') as substances from e where type in ('mapped', 'indexed', 'substance') group by 1),
    act as (select dst as ui, string_agg(src, ',' order by src) as actions from e join n on n.ui = e.dst and n.kind in ('Descriptor', 'SupplementalDescriptor', 'Qualifier') where type = 'substance' group by 1) """


@query(RECORDS.rstrip() + ", " + NESTED + """select n.ui, n.kind, coalesce(case when n.kind in ('Descriptor', 'SupplementalDescriptor', 'Qualifier') then concepts end, '') as concepts, coalesce(case when n.kind = 'SupplementalDescriptor' then mapped end, '') as mapped,
    coalesce(case when n.kind = 'SupplementalDescriptor' then indexed end, '') as indexed, coalesce(actions, '') as actions, coalesce(substances, '') as substances from n left join con using (ui) left join map using (ui) left join act using (ui)""")
def nested_entries(spark, d):
    records, _ = N.nested_entries(*map(stored, M.record_graph(*_records(spark, d))))
    joined = lambda c, f, sep=",": F.array_join(F.transform(c, f), sep)
    concept = lambda c: F.concat(c["ui"], F.lit("("), joined(c["relations"], lambda r: F.concat(r["ui"], F.lit(":"), r["scope"])), F.lit("|"), joined(c["terms"], lambda t: t["ui"]), F.lit(")"))
    return records.select("ui", "kind", joined("concepts", concept, ";").alias("concepts"), *[joined(c, lambda x: x["ui"]).alias(c) for c in ("mapped", "indexed", "actions", "substances")])


@query(RECORDS + """select t.concept as ui, 'term' as part, t.term as other from t join (select concept from t group by 1 having count(*) > 2) x using (concept)
    union all select e.dst, 'relation', e.src from e join n on n.ui = e.src and n.kind = 'Concept' join n c on c.ui = e.dst and c.kind = 'Concept' where e.type = 'concept' and e.scope is not null
        and e.dst in (select e2.dst from e e2 join n n2 on n2.ui = e2.src and n2.kind = 'Concept' where e2.type = 'concept' and e2.scope is not null group by 1 having count(*) > 2)
    union all select e.dst, 'action', e.src from e join n on n.ui = e.dst and n.kind in ('Descriptor', 'SupplementalDescriptor', 'Qualifier') where e.type = 'substance' and e.dst in (select dst from e where type = 'substance' group by 1 having count(*) > 2)""")
def nested_overflow(spark, d):
    """The parts of records that have more than two of a kind, as rows."""
    return N.nested_entries(*map(stored, M.record_graph(*_records(spark, d))), most=2)[1].select("ui", "part", "other")


SAID = """p as (select l_orderkey as pmid, l_linenumber as predication, l_partkey::varchar as subject, l_linestatus as subtype, l_returnflag as predicate, l_suppkey::varchar as object, unnest([l_orderkey, l_suppkey]) as sentence_id from lineitem where l_returnflag != 'N'),
    s as (select o_orderkey as sentence_id, cast(o_custkey % 5 as bigint) as number, o_orderpriority as sentence from orders)"""


@query(f"""with {SAID}, o as (select distinct pmid, predication, subject, subtype, predicate, object, number, sentence_id, sentence from p join s using (sentence_id) where pmid in (select o_orderkey from orders where o_orderstatus = 'F') and subject not in ('7', '8') and object not in ('7', '8'))
    select pmid, predication, subject, predicate, object, string_agg(number || ':' || sentence_id || ':' || sentence, ',' order by number, sentence_id) as evidence from o group by all""")
def nested_predications(spark, d):
    items, orders = table(spark, d, "lineitem").filter("l_returnflag != 'N'"), table(spark, d, "orders")
    rows = items.select(
        F.col("l_orderkey").alias("pmid"), F.col("l_linenumber").alias("predication"), both(F.col("l_partkey").cast("string"), "|x").alias("subject"), F.col("l_linestatus").alias("subtype"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").cast("string").alias("object"),
        F.col("l_linestatus").alias("objtype"), F.explode(F.array("l_orderkey", "l_suppkey")).alias("sentence_id"),
    )
    sentences = orders.select(F.col("o_orderkey").alias("sentence_id"), (F.col("o_custkey") % 5).alias("number"), F.col("o_orderpriority").alias("sentence"))
    found, _ = N.nested_predications(rows, sentences, orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pmid")), concepts=["7", "8"])
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["number"].cast("string"), e["sentence_id"].cast("string"), e["sentence"])), ",")
    return found.select("pmid", "predication", "subject", "predicate", "object", evidence.alias("evidence"))


@query("""with c as (select 'P' || p_partkey as cui from part where p_size > 10 union all select 'S' || s_suppkey from supplier where s_nationkey != 5),
    p as (select l_orderkey as pmid, 'P' || l_partkey as subject, l_returnflag as predicate, 'S' || l_suppkey as object from lineitem where l_linestatus != 'O' and 'P' || l_partkey in (select cui from c) and 'S' || l_suppkey in (select cui from c) and l_suppkey != 3)
    select subject as src, object as dst, predicate as type, pmid::varchar as article from p union all select distinct 'order/' || pmid, c, c, null from (select pmid, unnest([subject, object]) as c from p) x""")
def said_in_articles(spark, d):
    """What orders say: every predication as an edge, and edges from orders to the concepts."""
    items, part, supplier = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    key = lambda prefix, c: both(prefix, F.col(c).cast("string"))
    rows = items.select(F.col("l_orderkey").alias("pmid"), F.col("l_linenumber").alias("predication"), both(key("P", "l_partkey"), "|x").alias("subject"), F.col("l_linestatus").alias("subtype"), F.col("l_returnflag").alias("predicate"), key("S", "l_suppkey").alias("object"), F.lit("s").alias("objtype"), F.lit(None).cast("string").alias("sentence"))
    concepts = part.filter("p_size > 10").select(key("P", "p_partkey").alias("cui"), F.col("p_name").alias("name")).unionByName(supplier.filter("s_nationkey != 5").select(key("S", "s_suppkey").alias("cui"), F.col("s_name").alias("name")))
    orders = table(spark, d, "orders").select(
        F.lit(1).cast("long").alias("kgraph_id"), F.col("o_orderkey").alias("id"), F.lit("article").alias("type"), F.col("o_orderpriority").alias("name"), key("order/", "o_orderkey").alias("uri"), F.lit(0).cast("long").alias("created"),
        F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("synonyms"), F.create_map().cast("map<string,string>").alias("props"), F.col("o_orderkey").alias("seq"),
    )
    from loomgraph.plans.catalog import item_edges

    nodes, edges = S.add_predications(orders, item_edges(spark, d).limit(0), orders.select("kgraph_id", "id", F.col("id").alias("pmid")), rows, concepts, ["O"], ["S3"])
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("uri").alias(f"{end}_uri"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_uri").alias("src"), F.col("dst_uri").alias("dst"), "type", F.col("props")["article"].alias("article"))
