import random

import pytest
from loomgraph.model import EDGES, NODES
from loomgraph.operators import bucketed as B
from loomgraph.operators import graph as G
from loomgraph.operators.growing import GrowingGraph


def node_table(spark, rows):
    """(graph, id, uri, synonyms, seq)"""
    return spark.createDataFrame([(g, i, "t", f"n{i}", uri, 0, [f"t{i % 2}"], synonyms, {}, seq) for g, i, uri, synonyms, seq in rows], NODES)


def by_hand(rows):
    kept, seen = [], set()
    for g, i, uri, synonyms, seq in sorted(rows, key=lambda r: (r[4], r[1])):
        if uri is None or (g, uri) not in seen:
            seen.add((g, uri))
            kept.append((g, i, set(x for x in synonyms or [] if x is not None), seq))
    edges = {(a[0], a[1], b[1], v) for a in kept for b in kept if a[0] == b[0] and a[1] != b[1] and (a[3], a[1]) > (b[3], b[1]) for v in a[2] & b[2]}
    return {(g, i) for g, i, _, _ in kept}, edges


def test_any_division_into_batches_gives_the_same_graph(spark, tmp_path):
    random.seed(1)
    rows = [(random.choice([1, 2]), i, random.choice([f"u{i % 17}", f"u{i}", None]), random.choice([None, [], ["a"], ["a", "b", "a"], ["c", None], [f"s{i % 5}"]]), i // 2) for i in range(60)]
    want = by_hand(rows)
    for number, cuts in enumerate(([60], [10, 31, 60], [1, 2, 30, 59, 60])):
        graph, a = GrowingGraph(spark, str(tmp_path / str(number))), 0
        for batch, b in enumerate(cuts):
            part = node_table(spark, rows[a:b])
            graph.create_nodes(part, batch)
            graph.create_nodes(part, batch)  # sent again
            a = b
        assert graph.committed() == list(range(len(cuts)))
        nodes, edges, events = graph.read("nodes").collect(), graph.read("edges").collect(), graph.read("events").collect()
        assert ({(r["kgraph_id"], r["id"]) for r in nodes}, {(r["kgraph_id"], r["src"], r["dst"], r["value"]) for r in edges}) == want
        assert len(nodes) == len(want[0]) and len(edges) == len(want[1])
        assert len(events) == len(nodes) + len(edges) == len({(r["kgraph_id"], r["kind"], r["entity_id"]) for r in events}) == len({r["seq"] for r in events})


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    rows = [(1, i, f"u{i}", ["a"], i) for i in range(6)]
    graph = GrowingGraph(spark, str(tmp_path / "g"))
    assert graph.read("nodes").collect() == [] and graph.committed() == []
    graph.create_nodes(node_table(spark, rows[:3]), 0)
    graph._write(node_table(spark, rows[4:]), "nodes", 1)  # no commit
    assert graph.read("nodes").count() == 3
    graph.create_nodes(node_table(spark, rows[3:]), 1)
    graph.create_nodes(node_table(spark, []), 2)
    assert {(r["src"], r["dst"]) for r in graph.read("edges").collect()} == {(a, b) for a in range(6) for b in range(a)}


@pytest.fixture
def stored(spark):
    B.drop(spark, "loom_test")
    nodes = node_table(spark, [(1 + i % 3, i, f"u{i}", [], i) for i in range(30)])
    edges = spark.createDataFrame([(1 + k % 3, k, k % 30, k * 7 % 30, "x", False, {}, k) for k in range(90)] + [(1, 91, 3, 3, "loop", False, {}, 91)], EDGES)
    B.create(nodes, edges, "loom_test", 4)
    yield nodes, edges
    B.drop(spark, "loom_test")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_degrees_without_an_exchange(spark, stored):
    nodes, edges = stored
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = B.stored_degrees(spark, "loom_test")
        assert exchanges(got) == 0 and exchanges(B.stored_neighbors(spark, "loom_test", "t1")) == 0 < exchanges(G.degrees(nodes, edges))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, G.degrees(nodes, edges).collect()))
        near = [(r["node"], r["other"]) for r in B.stored_neighbors(spark, "loom_test", "t1").collect()]
        both = [(r["src"], r["dst"]) for r in edges.collect()]
        assert sorted(near) == sorted((a, b) for a, b in both + [(b, a) for a, b in both] if a % 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_graph_is_replaced_and_removed_alone(spark, stored):
    nodes, edges = stored
    B.replace_graphs(nodes.filter("kgraph_id = 2 and id < 9"), edges.filter("kgraph_id = 2 and src < 9"), "loom_test", 4)
    assert {r["id"] for r in spark.table("loom_test_nodes").filter("kgraph_id = 2").collect()} == {1, 4, 7} and spark.table("loom_test_nodes").count() == 23
    B.remove_graph(spark, "loom_test", 1)
    B.remove_graph(spark, "loom_test", 77)
    left = spark.table("loom_test_ends")
    assert {r["kgraph_id"] for r in left.select("kgraph_id").distinct().collect()} == {2, 3} and left.filter("kgraph_id = 3").count() == 2 * edges.filter("kgraph_id = 3").count()
    assert exchanges(B.stored_degrees(spark, "loom_test").hint("merge")) >= 0 and B.stored_degrees(spark, "loom_test").count() == 13


def test_pairs_in_blocks_equal_all_pairs(spark):
    """Keys with more rows than a block holds, nulls, equal orders."""
    import itertools

    rows = [(1, i, f"s{i % 2}", i // 2 if i < 500 else i) for i in range(1200)] + [(2, 5000, "s0", 1), (2, 5001, None, 2), (1, 5002, "s0", None)]
    nodes = node_table(spark, [(g, i, f"u{i}", [s], seq) for g, i, s, seq in rows])
    want = {(a[1], b[1], a[2]) for a, b in itertools.permutations(rows, 2) if a[0] == b[0] and a[2] is not None and a[2] == b[2] and a[3] is not None and b[3] is not None and a[3] > b[3]}
    got = [(r["src"], r["dst"], r["value"]) for r in G.stitch(nodes).collect()]
    assert len(got) == len(want) and set(got) == want
    # few bytes, many pairs: the tasks aren't put together
    assert G.pairs_of(nodes.select("kgraph_id", "id", "seq").filter("seq is not null"), ["kgraph_id"], ["seq", "id"], ["id"], 6).rdd.getNumPartitions() == 6


def test_links_are_not_stored_but_counted(spark, tmp_path):
    graph = GrowingGraph(spark, str(tmp_path / "g"))
    for batch in range(3):
        graph.create_nodes(node_table(spark, [(1 + i % 2, i, f"u{i}", ["a", f"b{i % 3}"], 200 - i) for i in range(batch * 40, batch * 40 + 40)]), batch)
    events = graph.read("events")
    assert sorted(map(tuple, graph.event_counts().collect())) == sorted(map(tuple, events.groupBy("kgraph_id", "kind", "oper").count().collect()))
    assert events.select("seq").distinct().count() == events.count() > 4000 and not (tmp_path / "g" / "edges").exists()
    ends = {(r["src"], r["src_uri"]) for r in graph.edges("uri").collect()}
    assert len(ends) > 100 and all(uri == f"u{i}" for i, uri in ends)


def test_buckets_follow_the_rows_and_nodes_are_dealt_before_they_are_made(spark, monkeypatch):
    """Files don't grow with the session's shuffle partitions, and the wide rows of nodes in many graphs meet no exchange."""
    from loomgraph.plans import stores

    made, create = [], B.create
    monkeypatch.setattr(B, "create", lambda *a: made.append(a) or create(*a))
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        name, nodes, edges, buckets = stores._by_nation(spark, "/root/testdata/sf0.001")
        files = {part: len(spark.table(f"{name}_{part}").inputFiles()) for part in B.PARTS}
        graphs = edges.select("kgraph_id").distinct().count()
        assert made[0][3] == buckets == spark.sparkContext.defaultParallelism < 64 and all(n <= graphs * buckets for n in files.values())
        for limit in ("-1", "10485760"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            plan = nodes.repartition(buckets, "id")._jdf.queryExecution().executedPlan().toString()
            assert plan.index("Join") < plan.index("Exchange")  # dealt below the join, and not again above it
        B.drop(spark, name)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    monkeypatch.setattr(B, "BUCKET_ROWS", 100)
    rows = spark.range(1001)
    assert B.buckets_for(rows) == 21 and B.buckets_for(rows.limit(1)) == spark.sparkContext.defaultParallelism
