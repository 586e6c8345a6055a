"""Queries of the catalog held against their DuckDB SQL, and long paths."""

import time

import duckdb
import pytest

from framesift.operators import dag, search
from framesift.plans import catalog, catalog_builds  # noqa: F401  the second adds to the first

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("events", "conversations", "embeddings", "nation", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return "~" if value is None else repr(round(value, 4)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", ["appeared_events", "entity_states", "change_edges", "layer_state_edges", "moved_nodes", "track_islands", "scene_faults", "scene_forms", "node_store", "edge_store", "memory_store", "evidence_bundles", "replies", "entity_lifecycle", "query_parse"])
def test_query_is_its_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, SF)
    want = tables.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in got.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_a_long_chain_has_a_small_plan(spark):
    """200 nodes in a row, searched 100 deep: the plan is that of a shallow search."""
    edges = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(199)], "sample_id string, parent_id string, child_id string")
    seed = spark.createDataFrame([(1, "s", "n199")], "query_id int, sample_id string, node_id string")
    began = time.time()
    deep, shallow = search.closure(seed, edges, 100), search.closure(seed, edges, 6)
    size = lambda df: len(df._jdf.queryExecution().toString().splitlines())
    assert sorted((r["node_id"], r["depth"]) for r in deep.collect()) == sorted((f"n{199 - i}", i) for i in range(101))
    assert size(deep) == size(shallow) and time.time() - began < 120


def test_a_clock_goes_on(spark):
    rows = spark.createDataFrame([("s", 1, "a", "x"), ("s", 1, "b", "x"), ("s", 2, "c", "x")], "sample_id string, tau_frame int, rank string, content string").selectExpr("*", "'t' as node_type")
    first = dag.clocked(rows)
    more = dag.clocked(rows.filter("tau_frame = 1"), dag.next_seq(first))
    assert sorted(r["seq"] for r in more.collect()) == [2, 3] and more.select("node_id").intersect(first.select("node_id")).count() == 0
