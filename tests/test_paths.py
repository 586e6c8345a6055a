"""Paths of many steps."""

from pyspark.sql import functions as F

from framesift.operators import dag
from framesift.plans import catalog


def test_path_exists_in_a_long_conversation(spark, tmp_path):
    # from the last of 60 turns to the first are 30 steps of at most two turns
    turns = spark.range(60).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"))
    turns.union(spark.createDataFrame([(2, 0), (2, 1)], "conv_id long, turn int")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["source"], r["target"]): r["found"] for r in catalog.path_exists(spark, str(tmp_path)).collect()}
    assert got == {("1:0", "1:59"): True, ("2:0", "2:1"): True}


def test_depth_still_bounds_a_search(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "parent_id string, child_id string")
    seed = spark.createDataFrame([("6",)], "node_id string")
    for depth, n in ((0, 1), (2, 3), (3, 4), (5, 6), (None, 7)):
        got = {r["node_id"]: r["depth"] for r in dag.ancestors(seed, edges, depth).collect()}
        assert got == {str(6 - k): k for k in range(n)}
