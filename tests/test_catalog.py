"""Every query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from loomgraph.plans import assembled, catalog, files, forms, lookups, records, retrieval, sought, stores, texts  # noqa: F401

D = "/root/testdata/sf0.001"
#: Queries whose nodes and edges must not depend on which keys a table has; also on a larger one.
GRAPH = ["degree_in_out", "edge_merge_last_wins", "edge_upsert_undirected", "edges_where", "expand_links", "has_neighbors", "neighbors_by_tag", "neighbours_of_tagged", "node_upsert_first_wins", "predicate_summary"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(d):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return views(D)


def plain(v):
    return float(f"{v:.6g}") if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else v


def same(spark, con, name, d):
    df = catalog.QUERIES[name](spark, d)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, name, D)


@pytest.mark.parametrize("name", GRAPH)
def test_graph_query_equals_sql_on_more_rows(spark, name):
    same(spark, views("/root/testdata/sf0.01"), name, "/root/testdata/sf0.01")
