"""The test tables as inputs of the scene-memory operators: views that stand in for frames, detections and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.sources.storage import count_unpacked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return count_unpacked(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for each user and day, from the day's last event: three samples, a frame a day, a box from value and k."""
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    last = e.groupBy("user_id", "day").agg(F.max_by(F.struct("event_type", "value", "k"), "event_id").alias("e"))
    v, k = F.col("e.value"), F.col("e.k")
    return last.select(
        (F.col("user_id") % 3).cast("string").alias("sample_id"), (F.col("day") - 1).cast("int").alias("frame_index"), F.col("user_id").cast("int").alias("ord"), F.col("user_id").alias("entity_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("tag"),
        F.col("e.event_type").alias("label"), F.array(v, k, v + 50, k + 50).alias("bbox"), F.lit(1.0).alias("score"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections() with the centre and the window of five frames.

    The boxes are 50 wide, so the centre lies 25 from the corner, and is reckoned so: half the sum of both corners is another double."""
    box = F.col("bbox")
    return detections(spark, sf_dir).withColumns({"center": F.struct((box[0] + 25).alias("x"), (box[1] + 25).alias("y")), "bucket": F.floor(F.col("frame_index") / 5).cast("int")})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as graph nodes: (sample_id, node_id, tau_frame, seq, node_type, content)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("sample_id"), F.concat_ws(":", "conv_id", "turn").alias("node_id"), F.col("turn").alias("tau_frame"), F.lit(0).alias("seq"), F.col("role").alias("node_type"), F.coalesce("text", F.lit("")).alias("content"), F.lit(False).alias("is_tombstone"))


def turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each turn to the next and the one after."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    steps = t.select("conv_id", "turn", F.explode(F.array(F.lit(1), F.lit(2))).alias("d")).select("conv_id", F.col("turn").alias("p"), (F.col("turn") + F.col("d")).alias("turn"))
    e = steps.join(t, ["conv_id", "turn"])
    return e.select(F.col("conv_id").cast("string").alias("sample_id"), F.concat_ws(":", "conv_id", "p").alias("parent_id"), F.concat_ws(":", "conv_id", "turn").alias("child_id"))


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return t.select(F.col("conv_id").alias("query_id"), F.col("conv_id").cast("string").alias("sample_id"), F.concat_ws(":", "conv_id", "turn").alias("node_id"))


def day_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sight for each user and day with the set of event types as relations."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), (F.dayofmonth("ts") - 1).alias("frame_index"), "event_type")
    days = e.groupBy("entity_id", "frame_index").agg(F.array_sort(F.collect_set(F.struct(F.col("event_type").alias("name"), F.lit("site").alias("object")))).alias("relations"))
    return days.select((F.col("entity_id") % 3).cast("string").alias("sample_id"), F.col("entity_id").cast("string").alias("entity_id"), "frame_index", "relations")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entities: (sample_id, entity_id, tag, label, first_frame, last_frame, total_displacement, state)."""
    d = detections(spark, sf_dir)
    rows = d.groupBy("sample_id", "entity_id", "tag").agg(F.max_by("label", "frame_index").alias("label"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.min_by("bbox", "frame_index").alias("first_bbox"), F.max_by("bbox", "frame_index").alias("last_bbox"))
    from framesift.functions.geometry import displacement

    return rows.withColumns({"entity_id": F.format_string("entity_%04d", "entity_id"), "total_displacement": displacement(F.col("first_bbox"), F.col("last_bbox")), "state": F.lit("active")})


def nation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detector frames: one for each region, with its nations as boxes (four labels by key), those with suppliers as a second layer."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    o = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("n"), (F.col("n_nationkey") % 4).cast("string")).alias("label")))).alias("o"))
    kids = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy("n_regionkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("n"), (F.col("n_nationkey") % 4).cast("string")))).alias("kids"))
    rows = o.join(kids, "n_regionkey", "left")
    names = F.transform("o", lambda x: x["label"])
    boxes = F.transform("o", lambda x: F.array(x["n_nationkey"].cast("double"), F.lit(0.0), x["n_nationkey"] + F.lit(10.0), F.lit(5.0)))
    rels = F.transform(F.sequence(F.lit(0), F.size("o") - 1), lambda i: F.struct(F.array(i, (i + 1) % F.size("o")).alias("idx"), F.lit("s").alias("subject_label"), F.lit("o").alias("object_label"), F.lit("beside").alias("predicate"), F.lit(0.5).alias("confidence")))
    return rows.select(
        F.col("n_regionkey").alias("frame"), F.concat(F.lit("f/"), F.col("n_regionkey").cast("string"), F.lit(".jpg")).alias("image_path"), F.struct(boxes.alias("boxes"), names.alias("labels"), F.transform("o", lambda x: x["n_nationkey"] / 100.0).alias("scores")).alias("objects"),
        F.struct(F.slice(names, 1, 1).alias("layer1_nodes"), F.map_from_arrays(F.slice(names, 1, 1), F.array(F.coalesce("kids", F.array().cast("array<string>")))).alias("layer2_mapping"), F.map_from_arrays(F.slice(names, 2, 1), F.array(F.slice(names, 3, 2))).alias("layer3_mapping")).alias("hierarchy"),
        F.map_from_arrays(F.array(F.lit("0"), F.lit("2")), F.array(F.lit("red"), F.lit("tall"))).alias("attributes"), rels.alias("relations"),
    )
