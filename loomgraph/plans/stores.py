"""Queries of feeds and stores: events as a graph's feed, parts and suppliers as stored nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import bucketed as B
from loomgraph.operators.growing import GrowingGraph, node_rows
from loomgraph.operators.rounds import new_folder
from loomgraph.plans.catalog import item_edges, part_nodes, query, supplier_nodes, table
from loomgraph.streaming import consoles

#: Seconds; half a day.
IDLE = 43_200
FEED = f"""feed as (select user_id % 50 as g, epoch_us(ts) as tm, event_id as seq, case event_type when 'signup' then 'console' when 'view' then 'knode' when 'error' then 'other' else 'kedge' end as kind,
        case when event_id % 11 = 0 then 'DELETE' else 'ADD' end as oper, event_id as entity, case when event_type not in ('signup', 'view', 'error') then user_id % 7 end as src, case when event_type not in ('signup', 'view', 'error') then event_id % 7 end as dst,
        case when event_type = 'signup' then event_id end as console from events),
    gaps as (select *, case when tm - lag(tm) over (partition by g order by tm, seq) > {IDLE} * 1000000::bigint then 1 else 0 end as gap from feed),
    sessions as (select *, sum(gap) over (partition by g order by tm, seq rows unbounded preceding) as s from gaps),
    held as (select *, last_value(console ignore nulls) over (partition by g, s order by tm, seq rows unbounded preceding) as held from sessions)
    select g as kgraph_id, seq, held as console, row_number() over (partition by g, s order by tm, seq) as number,
        '{{"oper":"ADD","kind":"' || kind || '","kgraph":' || g || ',"id":' || entity || case when src is not null then ',"src":' || src || ',"dst":' || dst else '' end || '}}' as message
    from held where kind in ('knode', 'kedge') and oper = 'ADD' and held is not null and (src is null or src != dst)"""


def event_feed(spark, d):
    edge = ~F.col("event_type").isin("signup", "view", "error")
    kind = F.when(F.col("event_type") == "signup", "console").when(F.col("event_type") == "view", "knode").when(F.col("event_type") == "error", "other").otherwise("kedge")
    return table(spark, d, "events").select(
        (F.col("user_id") % 50).alias("kgraph_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 11 == 0, "DELETE").otherwise("ADD").alias("oper"),
        F.col("event_id").alias("entity_id"), F.when(edge, F.col("user_id") % 7).alias("src"), F.when(edge, F.col("event_id") % 7).alias("dst"), F.when(F.col("event_type") == "signup", F.col("event_id")).alias("console"),
    )


@query(f"with {FEED}")
def console_feed(spark, d):
    return consoles.console_messages(event_feed(spark, d), IDLE).drop("at")


@query(f"with {FEED}")
def console_replay(spark, d):
    """The same through a stream of three micro-batches with state for each graph."""
    return consoles.replay(event_feed(spark, d), new_folder(spark, "feed"), IDLE).drop("at")


PARTS = "n as (select p_partkey as id, unnest(list_distinct([p_name || '/' || p_brand, p_brand || '/' || p_size || '/' || p_type])) as value from part)"


def _created(spark, d):
    """The parts as a stored graph, created in three batches."""
    parts = table(spark, d, "part").withColumns({"uri": F.concat(F.lit("part/"), F.col("p_partkey").cast("string")), "synonyms": F.array(F.concat_ws("/", "p_name", "p_brand"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), "p_type"))})
    nodes = node_rows(parts, 1, "concept", "uri", "p_name", "synonyms", "p_partkey")
    cuts = parts.agg(F.percentile_approx("p_partkey", [1 / 3, 2 / 3])).first()[0] or [0, 0]
    graph = GrowingGraph(spark, new_folder(spark, "graph"))
    for batch, rows in enumerate((nodes.filter(F.col("seq") <= cuts[0]), nodes.filter((F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1])), nodes.filter(F.col("seq") > cuts[1]))):
        graph.create_nodes(rows, batch)
    return graph


@query(f"with {PARTS} select 'part/' || a.id as src, 'part/' || b.id as dst, value from n a join n b using (value) where a.id > b.id")
def created_links(spark, d):
    return _created(spark, d).edges("uri").select(F.col("src_uri").alias("src"), F.col("dst_uri").alias("dst"), "value")


@query(f"with {PARTS} select cast(1 as bigint) as kgraph_id, 'knode' as kind, 'ADD' as oper, count(*) as n from part union all select 1, 'kedge', 'ADD', count(*) from n a join n b using (value) where a.id > b.id")
def created_events(spark, d):
    return _created(spark, d).event_counts()


def _by_nation(spark, d):
    """Suppliers and the parts they supply in a graph for each nation, stored in buckets. Returns the tables' name.

    Which nodes are in which graphs is dealt by node, in as many parts as buckets, and meets the nodes there: their rows, one for each graph that they are in, are written where they are made."""
    name, suppliers, items = f"loom_{uuid.uuid4().hex}", table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("dst"), F.col("s_nationkey").alias("nation")), item_edges(spark, d)
    edges, buckets = items.join(suppliers, "dst").withColumn("kgraph_id", F.col("nation")).select(items.columns), B.buckets_for(items)
    ids = edges.select(F.col("src").alias("id"), "kgraph_id").unionByName(suppliers.withColumnsRenamed({"dst": "id", "nation": "kgraph_id"})).repartition(buckets, "id").distinct()
    known = supplier_nodes(spark, d).unionByName(part_nodes(spark, d).withColumn("tags", F.array("type"))).drop("kgraph_id")
    nodes = known.join(ids, "id")
    B.create(nodes, edges, name, buckets)
    return name, nodes, edges, buckets


ENDS = "e as (select s_nationkey as g, l_partkey as p, -1 - l_suppkey as s from lineitem join supplier on s_suppkey = l_suppkey)"


@query(f"""with {ENDS}, n as (select s_nationkey as g, -1 - s_suppkey as id from supplier union all select distinct g, p from e), c as (select p as id, count(*) as o, 0 as i from e group by 1 union all select s, 0, count(*) from e group by 1)
    select id, cast(coalesce(i, 0) as bigint) as in_degree, cast(coalesce(o, 0) as bigint) as out_degree, cast(coalesce(i, 0) + coalesce(o, 0) as bigint) as degree from n left join c using (id)""")
def stored_degrees(spark, d):
    """Degrees of the nodes of all graphs; a part that is in several has its row in each."""
    return B.stored_degrees(spark, _by_nation(spark, d)[0])


@query(f"""with {ENDS} select s as node, p as other from e where g not in (3, 7) or (g = 7 and p % 2 = 0) union all select p, s from e where g not in (3, 7) or (g = 7 and p % 2 = 0)""")
def stored_graphs_changed(spark, d):
    """Edge ends after one nation's graph was dropped and another one's replaced by the half of its edges."""
    name, nodes, edges, buckets = _by_nation(spark, d)
    B.replace_graphs(nodes.filter("kgraph_id = 7"), edges.filter("kgraph_id = 7 and src % 2 = 0"), name, buckets)
    B.remove_graph(spark, name, 3)
    return spark.table(f"{name}_ends").select("node", "other")
