"""Small graphs within a task against joins, and against plain searches."""

import random

import pytest

from framesift.operators import dag, small_graphs

SCHEMA = "sample_id string, parent_id string, child_id string"


def graphs(n, cyclic):
    rnd, rows = random.Random(n), set()
    for g in range(n):
        for _ in range(rnd.randrange(25)):
            a, b = rnd.randrange(9), rnd.randrange(9)
            if cyclic and g % 3 == 0:
                rows.add((f"g{g}", f"{g}:{a}", f"{g}:{b}"))
            elif a != b:
                rows.add((f"g{g}", f"{g}:{min(a, b)}", f"{g}:{max(a, b)}"))
    return sorted(rows)


def above(rows, sample, node):
    found, todo = set(), [node]
    while todo:
        at = todo.pop()
        new = {p for s, p, c in rows if s == sample and c == at} - found
        found |= new
        todo += new
    return found


@pytest.mark.parametrize("most", [20_000, 6])  # with 6, most graphs are climbed by joins
def test_reduction_of_small_and_large_graphs(spark, monkeypatch, most):
    monkeypatch.setattr(small_graphs, "MOST_EDGES", most)
    rows = graphs(30, True)
    want = sorted((s, p, c) for s, p, c in rows if not any(p in above(rows, s, q) for t, q, d in rows if (t, d) == (s, c) and len({x for u, x, y in rows if (u, y) == (s, c)}) > 1))
    got = sorted(tuple(r) for r in dag.reduced(spark.createDataFrame(rows, SCHEMA), ["sample_id"]).select("sample_id", "parent_id", "child_id").collect())
    assert got == want and len(want) < len(rows)


@pytest.mark.parametrize("most", [20_000, 6])
@pytest.mark.parametrize("depth", [0, 2, None])
def test_searches_of_small_and_large_graphs(spark, monkeypatch, most, depth):
    monkeypatch.setattr(small_graphs, "MOST_EDGES", most)
    rows = graphs(12, True)
    seeds = [(i % 2, s, c) for i, (s, _, c) in enumerate(rows) if i % 3 == 0] + [(7, "none", "n")]
    edges, start = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(seeds, "query_id int, sample_id string, node_id string")
    shown = lambda df: sorted(tuple(r) for r in df.select("query_id", "sample_id", "node_id", "depth").collect())
    got = shown(dag.ancestors(start, edges, depth, ["sample_id"]))
    assert got == shown(dag._climb(start, edges, depth, ["sample_id"], None)) and (7, "none", "n", 0) in got


def test_a_long_chain_takes_no_loop(spark, monkeypatch):
    """300 nodes in a row with edges over 35: neither the reduction nor the searches climb by joins."""
    def no(*a, **k):
        raise AssertionError("climbed by joins")

    monkeypatch.setattr(dag, "_climbed", no)
    monkeypatch.setattr(dag, "_climb", no)
    rows = [("s", f"n{i}", f"n{i + d}") for i in range(299) for d in (1, 35) if i + d < 300]
    edges = spark.createDataFrame(rows, SCHEMA)
    assert dag.reduced(edges, ["sample_id"]).count() == 299
    pairs = spark.createDataFrame([("s", "n0", "n299"), ("s", "n299", "n0")], "sample_id string, source string, target string")
    assert {r["source"]: r["found"] for r in dag.path_exists(edges, pairs, None, ["sample_id"]).collect()} == {"n0": True, "n299": False}
