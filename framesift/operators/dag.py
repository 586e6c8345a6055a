"""The causal graph: node generators, logical clocks, parents, transitive reduction, traversal, export.

Nodes and edges are two tables. A node's creation rank (frame, phase, place,
step, item) orders all that a sample makes; clocks and ids follow from it, so a
rebuild gives the same graph. Parents are found by joins on tags and by windows
along event chains; only reachability needs a loop, over shrinking frontiers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesift.config import Config
from framesift.functions.geometry import center, compass, distance
from framesift.functions.text import normalize
from framesift.operators import small_graphs
from framesift.sources.storage import Growing, stored

RANK = "struct<frame:int,phase:int,place:int,step:int,item:int>"
#: What each generator gives: parents are candidates by kind: tags of entity states that stood before, and the key of an event chain.
DRAFT = ["sample_id", "node_type", "content", "tau_frame", "rank", "metadata", "tags", "state_tags", "chain", "chain_only"]


def rank(frame: Column, phase: int, place: Column, step: int, item: Column | None = None) -> Column:
    return F.struct(frame.cast("int").alias("frame"), F.lit(phase).alias("phase"), place.cast("int").alias("place"), F.lit(step).alias("step"), (F.lit(0) if item is None else item).cast("int").alias("item"))


def draft(rows: DataFrame, kind: str, content: Column, tau_frame: Column, order: Column, metadata: Column, tags: Column, state_tags: Column, chain: Column | None = None, chain_only: bool = False) -> DataFrame:
    """Node drafts. chain: key of the chain that the node joins; chain_only: once the chain has begun it is the only parent."""
    return rows.select(
        "sample_id", F.lit(kind).alias("node_type"), content.alias("content"), tau_frame.cast("int").alias("tau_frame"), order.cast(RANK).alias("rank"), F.to_json(metadata).alias("metadata"),
        tags.alias("tags"), state_tags.alias("state_tags"), (F.lit(None).cast("string") if chain is None else chain).alias("chain"), F.lit(chain_only).alias("chain_only"),
    )


def _s(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _at(box: Column) -> Column:
    p = center(box)
    return F.format_string("(%.1f, %.1f)", p["x"], p["y"])


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def state_drafts(observed: DataFrame) -> DataFrame:
    """One node for each normalised tag: its clock is that of the first sight, its content that of the last."""
    named = F.when(F.size("attributes") > 0, F.concat(F.lit(" with attributes ["), F.array_join("attributes", ", "), F.lit("]"))).otherwise("")
    pairs = F.transform("layer_mappings", lambda m: F.concat(F.col("tag"), F.lit("->"), m["child_tag"]))
    mapped = F.when(F.size("layer_mappings") > 0, F.concat(F.lit(" layer mapping: "), F.array_join(pairs, ", "))).otherwise("")
    text = F.concat(F.col("tag"), F.lit(" is a "), F.col("label"), named, F.lit(" at position "), _at(F.col("bbox")), mapped)
    new = F.col("status") == "new"
    order = F.when(new, rank(F.col("frame_index"), 2, F.col("arrival"), 1)).otherwise(rank(F.col("frame_index"), 1, F.col("arrival"), 9))
    rows = observed.select("sample_id", normalize(F.col("tag")).alias("key"), "tag", "label", "frame_index", "bbox", "attributes", "layer_id", "layer_mappings", text.alias("text"), order.alias("rank"))
    made = rows.groupBy("sample_id", "key").agg(F.min("rank").alias("rank"), F.min_by(F.struct("tag", "label", "layer_id", "layer_mappings", "frame_index"), "rank").alias("a"), F.max_by(F.struct("text", "bbox", "attributes"), "rank").alias("z"))
    meta = F.struct(F.col("a.tag").alias("entity_tag"), F.col("a.label").alias("label"), F.col("z.attributes").alias("attributes"), F.col("a.layer_id").alias("layer_id"), F.col("a.layer_mappings").alias("layer_mapping"), F.col("a.frame_index").alias("frame_start"), F.col("z.bbox").alias("latest_bbox"))
    return draft(made, "entity_state", F.col("z.text"), F.col("a.frame_index"), F.col("rank"), meta, F.array("a.tag"), _no_tags())


def appeared_drafts(observed: DataFrame, after_state: bool = False) -> DataFrame:
    """A node for each entity that is new, before its state unless after_state."""
    rows = observed.filter("status = 'new'")
    text = _s(F.col("tag"), " (", F.col("label"), ") appeared at frame ", F.col("frame_index"), ", position ", _at(F.col("bbox")))
    meta = F.struct(F.col("tag").alias("entity_tag"), "label", F.col("frame_index").alias("frame_start"), F.col("frame_index").alias("frame_end"), center(F.col("bbox")).alias("position"))
    return draft(rows, "entity_appeared", text, F.col("frame_index"), rank(F.col("frame_index"), 2, F.col("arrival"), 2 if after_state else 0), meta, F.array("tag"), _no_tags())


def movement_fold(rows: DataFrame, keys: list[str], order: list[str], threshold: float) -> DataFrame:
    """(keys, order, start, finish, displacement, direction): steps of at least threshold from the last recorded place.

    rows: (keys, order, center). The first place is recorded silently; each step that counts is recorded. A track is streamed in order
    through its partition and never held as a whole."""
    names = [*keys, *order]
    kinds = dict(rows.dtypes)
    ordered = rows.select(*names, F.col("center.x").cast("double").alias("_x"), F.col("center.y").cast("double").alias("_y")).repartition(*keys).sortWithinPartitions(*names)

    def go(batches):
        import pyarrow as pa

        track, at = None, None
        for batch in batches:
            x, y, out = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), []
            for i, now in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True)):
                if now != track:
                    track, at = now, None
                if at is None:
                    at = (x[i], y[i])
                elif math.sqrt((x[i] - at[0]) * (x[i] - at[0]) + (y[i] - at[1]) * (y[i] - at[1])) >= threshold:  # as distance() rounds
                    out.append((i, *at))
                    at = (x[i], y[i])
            picked = batch.take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.float64())], names=[*names, "_x", "_y", "_u", "_v"])

    made = ordered.mapInArrow(go, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", _x double, _y double, _u double, _v double")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    steps = made.select(*names, point("_u", "_v").alias("start"), point("_x", "_y").alias("finish"))
    return steps.withColumns({"displacement": distance(F.col("start"), F.col("finish")), "direction": compass(F.col("start"), F.col("finish"))})


def moved_drafts(seen: DataFrame, config: Config, every_sight: bool = False, place_of: Callable[[Column], Column] = center) -> DataFrame:
    """Movement nodes. The plain build looks only at sights that moved enough since the sight before; every_sight looks at all.

    place_of: the point of a box that is measured."""
    rows = seen if every_sight else seen.filter("status = 'matched'").filter(distance(place_of(F.col("prev_bbox")), place_of(F.col("bbox"))) >= config.matching.movement_event_threshold)
    tag = F.col("tag") if every_sight else F.col("prev_tag")
    steps = movement_fold(rows.select("sample_id", tag.alias("tag"), "frame_index", "arrival", place_of(F.col("bbox")).alias("center")), ["sample_id", "tag"], ["frame_index", "arrival"], config.dag.movement_threshold)
    place = lambda c: F.format_string("(%.1f, %.1f)", F.col(c)["x"], F.col(c)["y"])
    text = _s(F.col("tag"), " moved from ", place("start"), " to ", place("finish"), ", displacement=", F.format_string("%.1f", "displacement"), ", direction=", F.col("direction"))
    meta = F.struct(F.col("tag").alias("entity_tag"), F.col("frame_index").alias("frame_start"), F.col("frame_index").alias("frame_end"), F.col("start").alias("from_position"), F.col("finish").alias("to_position"), "displacement", "direction")
    return draft(steps, "entity_moved", text, F.col("frame_index"), rank(F.col("frame_index"), 1, F.col("arrival"), 1), meta, F.array("tag"), F.array("tag"), F.concat(F.lit("entity_moved:"), F.col("tag")), True)


def relation_calls(seen: DataFrame) -> DataFrame:
    """(sample_id, frame_index, phase, place, subject, predicate, object, item, key): a row for each relation of each sight, in order of calls."""
    new = F.col("status") == "new"
    subject = normalize(F.when(new, F.col("tag")).otherwise(F.col("prev_tag")))
    rows = seen.select("sample_id", "frame_index", F.when(new, 3).otherwise(1).alias("phase"), F.col("arrival").alias("place"), subject.alias("subject"), F.posexplode("relations").alias("item", "r"))
    rows = rows.select("sample_id", "frame_index", "phase", "place", "subject", "item", F.col("r.name").alias("predicate"), F.coalesce(F.nullif(normalize(F.col("r.object")), F.lit("")), F.lit("unknown")).alias("object")).filter("predicate <> ''")
    return rows.withColumn("key", F.concat_ws(":", "subject", F.replace(F.lower("predicate"), F.lit(" "), F.lit("_")), "object"))


def relation_islands(calls: DataFrame, scope: str = "call", debounce: int = 1) -> DataFrame:
    """Runs of calls that hold a relation. A call is a sight's list, or a whole frame, by scope; a run ends at the debounce-th call in a row that lacks it.

    (sample_id, key, island, start (the first row), start_frame, last_frame, ended (whether a later call lacks it), end_frame, end_phase, end_place)."""
    at = ["frame_index", "phase", "place"] if scope == "call" else ["frame_index"]
    turns = calls.select("sample_id", *at).distinct().withColumn("turn", F.row_number().over(W.partitionBy("sample_id").orderBy(*at)))
    rows = calls.join(turns, ["sample_id", *at])
    first = F.struct("frame_index", "phase", "place", "item", "subject", "predicate", "object")
    one = rows.groupBy("sample_id", "key", "turn").agg(F.min(first).alias("r"))
    by_key = W.partitionBy("sample_id", "key").orderBy("turn")
    one = one.withColumn("fresh", F.coalesce(F.col("turn") - F.lag("turn").over(by_key) > debounce, F.lit(True)))
    runs = one.withColumn("island", F.sum(F.col("fresh").cast("int")).over(by_key.rowsBetween(W.unboundedPreceding, 0))).groupBy("sample_id", "key", "island").agg(F.min("r").alias("start"), F.max("turn").alias("last_turn"), F.max("r.frame_index").alias("last_frame"))
    after = turns.select("sample_id", (F.col("turn") - debounce).alias("last_turn"), F.col("frame_index").alias("end_frame"), *([F.col("phase").alias("end_phase"), F.col("place").alias("end_place")] if scope == "call" else [F.lit(3).alias("end_phase"), F.lit(1 << 20).alias("end_place")]))
    return runs.join(after, ["sample_id", "last_turn"], "left").withColumn("ended", F.col("end_frame").isNotNull()).withColumn("start_frame", F.col("start.frame_index"))


def relation_drafts(islands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(start nodes, end nodes). An end node's parent is its start node: the chain key of both is the island's own."""
    c = F.col
    rows = islands.select("*", "start.subject", "start.predicate", "start.object")
    order = F.struct(c("start.frame_index").cast("int").alias("frame"), c("start.phase").cast("int").alias("phase"), c("start.place").cast("int").alias("place"), F.lit(4).alias("step"), c("start.item").cast("int").alias("item"))
    meta = lambda start, end, *more: F.struct(c("subject").alias("subject_tag"), c("object").alias("object_tag"), c("predicate"), start.alias("frame_start"), end.alias("frame_end"), *more)
    pair = F.concat(F.lit("relation_pair:"), F.least("subject", "object"), F.lit(":"), F.greatest("subject", "object"))
    starts = draft(rows, "relation", c("predicate"), c("start_frame"), order, meta(c("start_frame"), c("start_frame"), F.lit(True).alias("is_continuous_start"), c("key"), c("island")), F.array("subject", "object"), F.array("subject", "object"), pair)
    gone = rows.filter("ended and last_frame > start_frame").withColumn("item", F.row_number().over(W.partitionBy("sample_id", "end_frame", "end_phase", "end_place").orderBy("start", "key")))
    end_order = F.struct(c("end_frame").cast("int").alias("frame"), c("end_phase").cast("int").alias("phase"), c("end_place").cast("int").alias("place"), F.lit(5).alias("step"), c("item").cast("int").alias("item"))
    text = _s(c("predicate"), " (continuous from frame ", c("start_frame"), " to ", c("last_frame"), ")")
    ends = draft(gone, "relation", text, c("last_frame"), end_order, meta(c("start_frame"), c("last_frame"), F.lit(True).alias("is_continuous_end"), (c("last_frame") - c("start_frame") + 1).alias("duration_frames"), c("key"), c("island")), F.array("subject", "object"), _no_tags(), F.lit(None).cast("string"))
    return starts, ends


def attribute_drafts(rows: DataFrame, phase: int = 1) -> DataFrame:
    """Changes of an attribute's value. rows: (sample_id, tag, attribute, value, frame_index, arrival), one for each sight that has the attribute."""
    # the value that the sight before recorded; an attribute that it lacked gives no change
    sights = rows.select("sample_id", "tag", "frame_index").distinct().withColumn("no", F.row_number().over(W.partitionBy("sample_id", "tag").orderBy("frame_index")))
    now = rows.join(sights, ["sample_id", "tag", "frame_index"])
    order = W.partitionBy("sample_id", "tag", "attribute").orderBy("no")
    now = now.withColumns({"old_value": F.lag("value").over(order), "old_no": F.lag("no").over(order)}).filter("old_value is not null and old_no = no - 1 and old_value <> value")
    now = now.withColumn("item", F.row_number().over(W.partitionBy("sample_id", "tag", "frame_index").orderBy("attribute")))
    text = _s(F.col("tag"), "'s ", F.col("attribute"), " changed from '", F.col("old_value"), "' to '", F.col("value"), "'")
    meta = F.struct(F.col("tag").alias("entity_tag"), F.col("attribute").alias("attribute_name"), "old_value", F.col("value").alias("new_value"), F.col("frame_index").alias("frame_start"), F.col("frame_index").alias("frame_end"))
    return draft(now, "attribute_changed", text, F.col("frame_index"), rank(F.col("frame_index"), phase, F.col("arrival"), 2, F.col("item")), meta, F.array("tag"), F.array("tag"), F.concat_ws(":", F.lit("attribute_changed"), "tag", "attribute"), True)


def disappeared_drafts(associations: DataFrame, observed: DataFrame) -> DataFrame:
    last = observed.groupBy("sample_id", "entity_id").agg(F.max_by(F.struct("tag", "bbox"), "frame_index").alias("o")).select("sample_id", "entity_id", "o.*")
    rows = associations.filter("status = 'disappeared'").select("sample_id", "entity_id", "frame_index", "arrival").join(last, ["sample_id", "entity_id"])
    text = _s(F.col("tag"), " disappeared at frame ", F.col("frame_index"), ", last position ", _at(F.col("bbox")))
    meta = F.struct(F.col("tag").alias("entity_tag"), F.col("frame_index").alias("frame_start"), F.col("frame_index").alias("frame_end"), center(F.col("bbox")).alias("last_position"))
    return draft(rows, "entity_disappeared", text, F.col("frame_index"), rank(F.col("frame_index"), 6, F.col("arrival"), 0), meta, F.array("tag"), F.array("tag"))


def _pair_drafts(rows: DataFrame, kind: str, a: str, b: str, text: Column, meta: Column, chain: Column, place: Column, step: int) -> DataFrame:
    return draft(rows, kind, text, F.col("frame_end"), rank(F.col("frame_end"), 7, place, step), meta, _no_tags(), F.array(a, b), chain)


def interaction_drafts(rows: DataFrame) -> DataFrame:
    """rows: (sample_id, bucket, frame_start, frame_end, tag_a, tag_b, interaction_type)."""
    c = F.col
    text = _s(c("tag_a"), " and ", c("tag_b"), " ", c("interaction_type"), " (frames ", c("frame_start"), "-", c("frame_end"), ")")
    chain = F.concat(F.lit("interaction:"), F.least("tag_a", "tag_b"), F.lit(":"), F.greatest("tag_a", "tag_b"))
    meta = F.struct(c("tag_a").alias("entity1_tag"), c("tag_b").alias("entity2_tag"), "interaction_type", "frame_start", "frame_end")
    return _pair_drafts(rows, "interaction", "tag_a", "tag_b", text, meta, chain, F.dense_rank().over(W.partitionBy("sample_id").orderBy("bucket", "tag_a", "tag_b")), 0)


def occlusion_drafts(rows: DataFrame) -> DataFrame:
    """rows: (sample_id, frame_start, frame_end, occluder_tag, occluded_tag); the pair is ordered."""
    c = F.col
    text = _s(c("occluder_tag"), " occludes ", c("occluded_tag"), " (frames ", c("frame_start"), "-", c("frame_end"), ")")
    meta = F.struct("occluder_tag", "occluded_tag", "frame_start", "frame_end")
    return _pair_drafts(rows, "occlusion", "occluder_tag", "occluded_tag", text, meta, F.concat_ws(":", F.lit("occlusion"), "occluder_tag", "occluded_tag"), F.dense_rank().over(W.partitionBy("sample_id").orderBy("frame_end", "occluder_tag", "occluded_tag")), 1)


def description_drafts(rows: DataFrame, kind: str = "scene") -> DataFrame:
    """rows: windows.descriptions(). The last node of its window's end frame."""
    meta = F.struct(F.lit(kind).alias("description_type"), "frame_start", "frame_end", F.col("tags").alias("involved_entities"))
    return draft(rows, "periodic_description", F.concat(F.lit(f"[{kind}] "), F.col("description")), F.col("frame_end"), rank(F.col("frame_end"), 8, F.col("bucket"), 0), meta, F.col("tags"), F.col("tags"))


def layer_drafts(rows: DataFrame) -> DataFrame:
    """rows: (sample_id, parent_tag, child_tag, frame_index, arrival): one node for each row, '<parent> contains <child>'."""
    meta = F.struct("parent_tag", "child_tag", F.lit("contains").alias("predicate"), F.col("frame_index").alias("frame_start"), F.col("frame_index").alias("frame_end"))
    item = F.row_number().over(W.partitionBy("sample_id", "frame_index", "arrival").orderBy("parent_tag", "child_tag"))
    rows = rows.withColumn("item", item)
    return draft(rows, "layer_map", _s(F.col("parent_tag"), " contains ", F.col("child_tag")), F.col("frame_index"), rank(F.col("frame_index"), 2, F.col("arrival"), 2, F.col("item")), meta, _no_tags(), F.array("parent_tag", "child_tag"))


def clocked(drafts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Drafts with seq, the number within the clock's frame by order of making, and node_id. before: next_seq() of a graph that goes on."""
    seq = (F.row_number().over(W.partitionBy("sample_id", "tau_frame").orderBy("rank", "node_type", "content")) - 1).cast("int")
    rows = drafts.withColumn("seq", seq)
    if before is not None:
        rows = rows.join(before, ["sample_id", "tau_frame"], "left").withColumn("seq", (F.col("seq") + F.coalesce("next_seq", F.lit(0))).cast("int")).drop("next_seq")
    return rows.withColumn("node_id", F.concat_ws(":", "sample_id", "tau_frame", "seq"))


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(sample_id, parent_id, child_id, exported) before reduction. nodes: clocked drafts.

    exported is false for the edge from an appearance to its state, which traversal follows and the exported graph leaves out."""
    slim = nodes.select("sample_id", "node_id", "node_type", "rank", "tau_frame", "tags", "state_tags", "chain", "chain_only", F.get_json_object("metadata", "$.predicate").alias("predicate"), F.get_json_object("metadata", "$.key").alias("key"), F.get_json_object("metadata", "$.island").alias("island"), F.get_json_object("metadata", "$.is_continuous_end").alias("is_end"))
    states = slim.filter("node_type = 'entity_state'").select("sample_id", normalize(F.col("tags")[0]).alias("tag"), F.col("node_id").alias("parent_id"), F.col("rank").alias("state_rank"))
    by_chain = W.partitionBy("sample_id", "chain").orderBy("rank", "node_id")
    # the chain's node before, and whether it may be a parent
    linked = slim.filter("chain is not null").withColumns({"last_id": F.lag("node_id").over(by_chain), "last_frame": F.lag("tau_frame").over(by_chain), "last_predicate": F.lag("predicate").over(by_chain)})
    is_relation = F.col("node_type") == "relation"
    chained = linked.filter(F.col("last_id").isNotNull() & (~is_relation | (F.col("last_frame") < F.col("tau_frame")) & (F.col("last_predicate") != F.col("predicate"))))
    begun = linked.filter("chain_only and last_id is not null").select("sample_id", "node_id")
    wanted = slim.join(begun, ["sample_id", "node_id"], "left_anti").select("sample_id", "node_id", "rank", F.explode(F.array_distinct(F.transform("state_tags", normalize))).alias("tag"))
    # a tag is looked up as it is, then with spaces for underscores, then the other way round
    tries = wanted.select("*", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("tag").alias("t")), F.struct(F.lit(1).alias("o"), F.replace("tag", F.lit("_"), F.lit(" ")).alias("t")), F.struct(F.lit(2).alias("o"), F.replace("tag", F.lit(" "), F.lit("_")).alias("t")))).alias("try"))
    found = tries.join(states.withColumnRenamed("tag", "state_tag"), (tries["sample_id"] == states["sample_id"]) & (tries["try"]["t"] == F.col("state_tag")) & (F.col("state_rank") < F.col("rank"))).select(tries["sample_id"], "node_id", "tag", F.col("try.o").alias("o"), "parent_id")
    found = found.groupBy("sample_id", "node_id", "tag").agg(F.min_by("parent_id", "o").alias("parent_id"))
    ends = slim.filter("is_end = 'true'").join(slim.filter("is_end is null and island is not null").select("sample_id", "key", "island", F.col("node_id").alias("parent_id")), ["sample_id", "key", "island"])
    appeared = slim.filter("node_type = 'entity_appeared'").select("sample_id", "node_id", normalize(F.col("tags")[0]).alias("tag")).join(states, ["sample_id", "tag"])
    yes, no = F.lit(True).alias("exported"), F.lit(False).alias("exported")
    child = F.col("node_id").alias("child_id")
    parts = [
        found.select("sample_id", "parent_id", child, yes), chained.select("sample_id", F.col("last_id").alias("parent_id"), child, yes), ends.select("sample_id", "parent_id", child, yes),
        appeared.select("sample_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("child_id"), no),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def reduced(edges: DataFrame, keys: list[str] | None = None, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """edges without those whose parent also leads to another parent of the same child, on however long a path.

    Graphs are told apart by keys. One of few edges is looked at within a task; the others, or all without keys, are climbed by joins."""
    keys = keys or []
    e = edges.select(*keys, F.col(parent).alias("p"), F.col(child).alias("c"))
    if not keys:
        gone = _climbed(e, keys)
    else:
        found = stored(small_graphs.superfluous_edges(e, keys), "superfluous")
        gone, large = found.filter("not _big").drop("_big"), found.filter("_big").select(*keys).distinct()
        if not large.isEmpty():
            gone = gone.unionByName(_climbed(stored(e.join(large, keys, "left_semi"), "large"), keys))
    return edges.join(gone.withColumnsRenamed({"p": parent, "c": child}), [*keys, parent, child], "left_anti")


def _climbed(e: DataFrame, keys: list[str]) -> DataFrame:
    """The superfluous of the edges (keys, p, c), by joins.

    Only children with several parents are looked at. A frontier starts at each of their parents and climbs; a candidate that it
    meets is superfluous. Frontiers are sets of places, so they grow with nodes, not with paths; they climb until they are empty."""
    many = e.groupBy(*keys, "c").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    candidates = stored(e.join(many, [*keys, "c"], "left_semi"), "candidates")
    up = e.select(*keys, F.col("p").alias("to"), F.col("c").alias("at"))
    front, passed = candidates.select(*keys, "c", F.col("p").alias("at")), None
    while True:
        climbed = front.join(up, [*keys, "at"]).select(*keys, "c", F.col("to").alias("at")).distinct()
        # what a frontier has passed needn't be passed again; its start may be met by another's, so starts aren't passed yet
        if passed is None:
            passed = Growing(e.sparkSession, "passed")
            front = passed.add(climbed)
        else:
            front = passed.add(climbed.join(passed.table(), [*keys, "c", "at"], "left_anti"))
        if front.isEmpty():
            break
    return candidates.withColumnRenamed("p", "at").join(passed.table(), [*keys, "c", "at"], "left_semi").distinct().select(*keys, F.col("at").alias("p"), "c")


def ancestors(seeds: DataFrame, edges: DataFrame, depth: int | None, keys: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(seed's columns but node_id, node_id, depth): nodes that lead to the seeds in at most depth steps (None: any number), at their least depth; seeds are at 0.

    seeds: (keys..., node_id, any others, which tell searches apart); edges: (keys, parent_id, child_id). allowed: (..., node_id), parents that may be entered.
    Graphs are told apart by keys; one of few edges is searched within a task unless allowed is given, the others by joins."""
    if not keys or allowed is not None:
        return _climb(seeds, edges, depth, keys or [], allowed)
    found = stored(small_graphs.ancestors(seeds.distinct(), edges, depth, keys), "found")
    few, large = found.filter("not _big").drop("_big"), found.filter("_big").select(*keys).distinct()
    if large.isEmpty():
        return few
    own = [stored(df.join(large, keys, "left_semi"), "large") for df in (seeds, edges)]
    return few.unionByName(_climb(*own, depth, keys, None))


def _climb(seeds: DataFrame, edges: DataFrame, depth: int | None, keys: list[str], allowed: DataFrame | None) -> DataFrame:
    """ancestors() by joins. Every third step what was found is written to one growing table, so the plan has the same size at any depth."""
    marks = [c for c in seeds.columns if c != "node_id"]
    up = edges.select(*keys, F.col("child_id").alias("node_id"), "parent_id")
    found, recent = Growing(seeds.sparkSession, "found"), None
    front = found.add(seeds.distinct().withColumn("depth", F.lit(0))).drop("depth")
    for step in count(1) if depth is None else range(1, depth + 1):
        seen = found.table() if recent is None else found.table().unionByName(recent)
        front = front.join(up, [*keys, "node_id"]).select(*marks, F.col("parent_id").alias("node_id")).distinct()
        if allowed is not None:
            front = front.join(allowed, [c for c in allowed.columns if c in front.columns], "left_semi")
        front = front.join(seen.drop("depth"), [*marks, "node_id"], "left_anti")
        new = front.withColumn("depth", F.lit(step))
        recent = new if recent is None else recent.unionByName(new)
        if step % 3 == 0 or step == depth:
            front, recent = found.add(recent).filter(F.col("depth") == step).drop("depth"), None
            if front.isEmpty():
                break
    return found.table()


def path_exists(edges: DataFrame, pairs: DataFrame, depth: int | None = 100, keys: list[str] | None = None) -> DataFrame:
    """pairs (keys, source, target) with found: whether the source leads to the target; a node leads to itself."""
    own = [*(keys or []), "source", "target"]
    up = ancestors(pairs.select(*own, F.col("target").alias("node_id")), edges, depth, keys)
    hit = up.filter("node_id = source").select(*own).distinct().withColumn("found", F.lit(True))
    return pairs.join(hit, own, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def parents(edges: DataFrame, node_id: str | None = None) -> DataFrame:
    """(node_id, parent_id) of one node or all."""
    rows = edges.select(F.col("child_id").alias("node_id"), "parent_id").distinct()
    return rows if node_id is None else rows.filter(F.col("node_id") == node_id)


def children(edges: DataFrame, node_id: str | None = None) -> DataFrame:
    """(node_id, child_id) of one node or all."""
    rows = edges.select(F.col("parent_id").alias("node_id"), "child_id").distinct()
    return rows if node_id is None else rows.filter(F.col("node_id") == node_id)


def layer_edges(nodes: DataFrame, mappings: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(sample_id, parent_id, child_id): an edge from a parent tag's state to a child tag's, once however often it is mapped; not those that edges has.

    mappings: (sample_id, parent_tag, child_tag). Tags without a state give no edge."""
    states = nodes.filter("node_type = 'entity_state'").select("sample_id", normalize(F.col("tags")[0]).alias("tag"), "node_id")
    pairs = mappings.select("sample_id", normalize(F.col("parent_tag")).alias("p"), normalize(F.col("child_tag")).alias("c")).distinct()
    found = pairs.join(states.select("sample_id", F.col("tag").alias("p"), F.col("node_id").alias("parent_id")), ["sample_id", "p"]).join(states.select("sample_id", F.col("tag").alias("c"), F.col("node_id").alias("child_id")), ["sample_id", "c"])
    found = found.filter("parent_id <> child_id").select("sample_id", "parent_id", "child_id").distinct()
    return found if edges is None else found.join(edges, ["sample_id", "parent_id", "child_id"], "left_anti")


def next_seq(nodes: DataFrame) -> DataFrame:
    """(sample_id, tau_frame, next_seq): where each frame's clock stands."""
    return nodes.groupBy("sample_id", "tau_frame").agg((F.max("seq") + 1).alias("next_seq"))


def finished(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The node table: clocked drafts with the parents that the exported graph has."""
    own = edges.filter("exported").groupBy("sample_id", F.col("child_id").alias("node_id")).agg(F.array_sort(F.collect_set("parent_id")).alias("parent_ids"))
    start = F.coalesce(F.get_json_object("metadata", "$.frame_start").cast("int"), F.col("tau_frame"))
    end = F.coalesce(F.get_json_object("metadata", "$.frame_end").cast("int"), F.col("tau_frame"))
    rows = nodes.join(own, ["sample_id", "node_id"], "left")
    return rows.select("sample_id", "node_id", "node_type", "content", "tau_frame", "seq", start.alias("frame_start"), end.alias("frame_end"), "metadata", "tags", F.coalesce("parent_ids", F.array().cast("array<string>")).alias("parent_ids"), F.lit(False).alias("is_tombstone"))


def graph_nodes(registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """The export's nodes: entities, then graph nodes."""
    a = registry.select("sample_id", F.col("entity_id").alias("id"), F.lit("entity").alias("node_type"), "label", "tag", F.col("first_frame").alias("frame_start"), F.col("last_frame").alias("frame_end"), "state", F.round("total_displacement", 3).alias("total_displacement"))
    b = nodes.filter("not is_tombstone").select("sample_id", F.col("node_id").alias("id"), F.lit("dag_node").alias("node_type"), F.col("node_type").alias("dag_node_type"), "content", F.array("tau_frame", "seq").alias("tau"), "frame_start", "frame_end", "metadata")
    return a.unionByName(b, allowMissingColumns=True)


def graph_edges(registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """The export's edges: causes, and entity_context from each entity to the nodes that name its tag."""
    from framesift.operators.tracker import last_of_tag

    live = nodes.filter("not is_tombstone")
    causes = live.select("sample_id", F.explode("parent_ids").alias("source"), F.col("node_id").alias("target"), F.lit("causes").alias("relation"), F.lit(None).cast("string").alias("entity_tag"))
    named = live.select("sample_id", "node_id", F.explode(F.array_distinct("tags")).alias("tag")).join(last_of_tag(registry), ["sample_id", "tag"])
    context = named.groupBy("sample_id", F.col("entity_id").alias("source"), F.col("node_id").alias("target")).agg(F.min("tag").alias("entity_tag")).withColumn("relation", F.lit("entity_context"))
    return causes.distinct().unionByName(context)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy("sample_id").agg(F.count_if(F.col("node_type") == "entity").alias("num_entity_nodes"), F.count_if(F.col("node_type") == "dag_node").alias("num_dag_nodes"))
    return a.join(edges.groupBy("sample_id").agg(F.count("*").alias("num_edges")), "sample_id", "left").withColumn("num_edges", F.coalesce("num_edges", F.lit(0)))
