"""Queries of the forms that graphs, dates and JSON columns are given out in, and of what counts as a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import graph as G
from loomgraph.plans.catalog import item_edges, part_nodes, query, supplier_nodes, table
from loomgraph.streaming import feed

#: Near the middle of the sizes of suppliers' graphs, so both forms occur.
MOST = 1130
SUPPLIED = """n as (select distinct l_suppkey as g, p_partkey as id, p_name as name from lineitem join part on p_partkey = l_partkey),
    m as (select g, count(*) as nodes, string_agg('{"id":' || id || ',"type":"concept","name":"' || name || '"}', ',' order by id) as js from n group by 1),
    e as (select l_suppkey as g, count(*) as edges, string_agg('{"src":' || l_partkey || ',"dst":' || (-1 - l_suppkey) || ',"type":"' || l_returnflag || '"}', ',' order by l_partkey, l_returnflag) as js from lineitem group by 1)"""


def _supplied(spark, d):
    """A graph for each supplier: the parts that it supplies and the line items at them."""
    edges = item_edges(spark, d).withColumn("kgraph_id", -1 - F.col("dst"))
    nodes = part_nodes(spark, d).drop("kgraph_id").join(edges.select("kgraph_id", F.col("src").alias("id")).distinct(), "id")
    return nodes, edges


@query(f"""with {SUPPLIED} select g as kgraph_id, '{{"kgraph_id":' || g || ',"node_count":' || nodes || ',"edge_count":' || edges || case when nodes + edges <= {MOST} then ',"nodes":[' || m.js || '],"edges":[' || e.js || ']' else '' end || '}}' as json
    from m join e using (g)""")
def full_graph_json(spark, d):
    """Small graphs whole, larger ones by their counts."""
    return G.graph_json(*_supplied(spark, d), most=MOST)


@query("""select cast(1 as bigint) as kgraph_id, 'graph' as part, '{"kgraph_id":1,"node_count":' || ((select count(*) from part) + (select count(*) from supplier)) || ',"edge_count":' || (select count(*) from lineitem) || '}' as json
    union all select 1, 'node', '{"id":' || p_partkey || ',"type":"concept","name":"' || p_name || '"}' from part union all select 1, 'node', '{"id":' || (-1 - s_suppkey) || ',"type":"target","name":"' || s_name || '"}' from supplier
    union all select 1, 'edge', '{"src":' || l_partkey || ',"dst":' || (-1 - l_suppkey) || ',"type":"' || l_returnflag || '"}' from lineitem""")
def graph_json_lines(spark, d):
    return G.graph_lines(part_nodes(spark, d).unionByName(supplier_nodes(spark, d)), item_edges(spark, d)).drop("id")


@query("select cast(1 as bigint) as kgraph_id, 'knode' as kind, case p_partkey % 4 when 1 then 'UPDATE' when 2 then 'DELETE' else 'ADD' end as oper, p_partkey as entity_id from part where p_partkey % 4 != 0")
def changed_entities(spark, d):
    """A value that moved to another column is a change, another order of the properties is none."""
    nodes, fourth = part_nodes(spark, d), F.col("id") % 4
    before = nodes.filter(fourth != 3).withColumn("uri", F.when(fourth != 1, F.col("uri")))
    turned = F.map_from_entries(F.reverse(F.map_entries("props")))
    moved = {"name": F.when(fourth != 1, F.col("name")), "uri": F.when(fourth == 1, F.col("name")).otherwise(F.col("uri")), "props": F.when(fourth == 0, turned).otherwise(F.col("props"))}
    return feed.changes(before, nodes.filter(fourth != 2).withColumns(moved), "knode")


@query("select event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) as at, strftime(ts, '%b %-d, %Y') as day, json_extract_string(props, '$.k') as k from events")
def event_forms(spark, d):
    events = table(spark, d, "events")
    at = S.from_epoch_ms(S.to_epoch_ms(F.col("ts").cast("timestamp"))).cast("timestamp_ntz")
    return events.select("event_id", at.alias("at"), S.long_date(F.col("ts")).alias("day"), S.json_text(F.col("props"), "$.k").alias("k"))
