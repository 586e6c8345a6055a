"""Per-frame events from associations: appearance, movement, changed relations and attributes, disappearance, states.

An association row with its detection is a sight of an entity; all events are
windows and sets over sights. Nothing here keeps state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesift.config import Config
from framesift.functions.embedding import dot, embed
from framesift.functions.geometry import center, compact, displacement, distance
from framesift.functions.relations import pair_text

EVENT = ["sample_id", "event_type", "frame_start", "frame_end", "entities", "entity_tags", "entity_labels", "summary", "confidence", "source", "details", "rank", "dedupe_key"]
def _by():
    return W.partitionBy("sample_id", "entity_id").orderBy("frame_index")


def sights(observed: DataFrame) -> DataFrame:
    """Sights with what was seen of the entity before: prev_* columns, null at the first."""
    cols = ("frame_index", "tag", "label", "bbox", "attributes", "relations")
    return observed.withColumns({f"prev_{c}": F.lag(c).over(_by()) for c in cols})


def event(kind: str, start: Column, end: Column, entities: list, tags: list, labels: list, summary: Column, confidence: Column, details: Column, rank: list, source: str = "immediate") -> list[Column]:
    """The columns EVENT. rank orders the events of a sample: (frame, phase, place, step)."""
    basis = F.to_json(F.struct(F.lit(kind), start, end, F.array(*entities), summary, details))
    none = F.array().cast("array<string>")
    listed = lambda x: F.array(*x) if x else none
    return [
        F.col("sample_id"), F.lit(kind).alias("event_type"), start.cast("int").alias("frame_start"), end.cast("int").alias("frame_end"), listed(entities).alias("entities"), listed(tags).alias("entity_tags"), listed(labels).alias("entity_labels"),
        summary.alias("summary"), F.round(confidence, 4).alias("confidence"), F.lit(source).alias("source"), F.to_json(details).alias("details"),
        F.struct(*(x.cast("int").alias(n) for n, x in zip(("frame", "phase", "place", "step"), rank, strict=True))).alias("rank"), F.sha1(basis.cast("binary")).alias("dedupe_key"),
    ]


def _s(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _joined(items: Column, otherwise: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit(otherwise))


def initial_scene(observed: DataFrame) -> DataFrame:
    """One event for the first frame that has objects, with the count of each label."""
    first = observed.filter("first_frame")
    counts = first.groupBy("sample_id", "frame_index", "label").agg(F.count("*").alias("n"), F.collect_set("tag").alias("t"))
    rows = counts.groupBy("sample_id", "frame_index").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("tags"),
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["n"].cast("string"), F.lit(" "), p["label"])), ", ")
    f = F.col("frame_index")
    out = rows.select(*event("initial_scene", f, f, [], [], [], _s("Initial scene at frame ", f, " contains ", F.col("n"), " objects: ", text, "."), F.lit(1.0), F.struct(F.col("n").alias("object_count"), F.map_from_entries("parts").alias("composition")), [f, F.lit(0), F.lit(0), F.lit(0)]), "tags", F.transform("parts", lambda p: p["label"]).alias("labels"))
    return out.withColumns({"entity_tags": F.col("tags"), "entity_labels": F.col("labels")}).select(*EVENT)


def _one(name: str, kind: str, summary: Column, confidence: Column, details: Column, phase: int, step: int) -> list[Column]:
    f = F.col("frame_index")
    return event(kind, f, f, [F.col("entity_id")], [F.col(f"{name}tag")], [F.col(f"{name}label")], summary, confidence, details, [f, F.lit(phase), F.col("arrival"), F.lit(step)])


def appeared(observed: DataFrame) -> DataFrame:
    rows = observed.filter("status = 'new'")
    text = _s(F.col("entity_id"), " ", F.col("tag"), " (", F.col("label"), ") appeared at frame ", F.col("frame_index"), "; box=", compact(F.col("bbox")), "; attributes=", _joined(F.col("attributes"), "no obvious attributes"), ".")
    return rows.select(*_one("", "entity_appeared", text, F.col("detection_score"), F.struct("bbox", "attributes"), 2, 0))


def disappeared(associations: DataFrame, observed: DataFrame) -> DataFrame:
    """Entities at the frame that they are given up in, with their last sight."""
    gone = associations.filter("status = 'disappeared'").select("sample_id", "entity_id", "frame_index", "missed_frames", "arrival")
    last = observed.groupBy("sample_id", "entity_id").agg(F.max_by(F.struct("tag", "label", "bbox"), "frame_index").alias("o")).select("sample_id", "entity_id", "o.*")
    rows = gone.join(last, ["sample_id", "entity_id"])
    text = _s(F.col("entity_id"), " ", F.col("tag"), " (", F.col("label"), ") disappeared at frame ", F.col("frame_index"), "; last_box=", compact(F.col("bbox")), ".")
    details = F.struct(F.col("bbox").alias("last_bbox"), "missed_frames", F.col("frame_index").alias("disappeared_frame"))
    return rows.select(*_one("", "entity_disappeared", text, F.greatest(F.lit(0.5), 0.95 - 0.1 * F.col("missed_frames")), details, 3, 0))


def moved(seen: DataFrame, threshold: float, place: Callable[[Column], Column] = center) -> DataFrame:
    """Sights at least threshold from the one before. place: the point of a box that is measured."""
    d = distance(place(F.col("prev_bbox")), place(F.col("bbox")))
    rows = seen.filter("status = 'matched'").withColumn("displacement", d).filter(F.col("displacement") >= threshold)
    text = _s(F.col("entity_id"), " ", F.col("prev_tag"), " (", F.col("prev_label"), ") moved at frame ", F.col("frame_index"), " from ", compact(F.col("prev_bbox")), " to ", compact(F.col("bbox")), " with displacement ", F.format_string("%.1f", "displacement"), "px.")
    return rows.select(*_one("prev_", "entity_moved", text, F.least(F.lit(1.0), 0.6 + F.col("displacement") / 100.0), F.struct("prev_bbox", F.col("bbox").alias("curr_bbox"), "displacement"), 1, 0))


def changes(seen: DataFrame, column: str, text_of, threshold: float, debounce: int, config: Config, semantic: bool = True, compat: bool = True) -> DataFrame:
    """(sample_id, entity_id, frame_index, added, removed) of a set column, confirmed.

    An item is added when it is now and was not before, has no match in meaning before, and isn't confirmed yet; confirmed from
    the start are the items of the first sight. In compat mode a removal is counted only at the step at which the item goes, so
    with debounce of 2 or more none is ever confirmed; with 1, items come and go. Without compat, a removal is confirmed by
    debounce sights in a row without the item (or a match)."""
    key = ["sample_id", "entity_id"]
    rows = seen.select(*key, "frame_index", F.col(column).alias("now"), F.col(f"prev_{column}").alias("before"))
    steps = rows.filter("before is not null")
    plus = steps.select(*key, "frame_index", F.explode(F.array_except("now", "before")).alias("item"), F.col("before").alias("others"), F.lit(1).alias("sign"))
    minus = steps.select(*key, "frame_index", F.explode(F.array_except("before", "now")).alias("item"), F.col("now").alias("others"), F.lit(-1).alias("sign"))
    moves = plus.unionByName(minus)
    if semantic:
        texts = moves.select(text_of(F.col("item")).alias("t")).unionByName(moves.select(F.explode(F.transform("others", text_of)).alias("t"))).distinct()
        known = texts.withColumn("v", embed(F.col("t"), config.embedding))
        near = (
            moves.select(*key, "frame_index", "item", "sign", text_of(F.col("item")).alias("t"), F.explode(F.transform("others", text_of)).alias("u"))
            .join(known, "t").join(known.select(F.col("t").alias("u"), F.col("v").alias("w")), "u").filter(dot(F.col("v"), F.col("w")) >= threshold).select(*key, "frame_index", "item", "sign").distinct()
        )
        moves = moves.join(near, [*key, "frame_index", "item", "sign"], "left_anti")
    moves = moves.drop("others")
    first = rows.filter("before is null").select(*key, F.explode("now").alias("item")).withColumn("given", F.lit(True))
    moves = moves.join(first, [*key, "item"], "left")
    order = W.partitionBy(*key, "item").orderBy("frame_index")
    if compat and debounce >= 2:
        kept = moves.filter("sign = 1 and given is null").groupBy(*key, "item").agg(F.min("frame_index").alias("frame_index")).withColumn("sign", F.lit(1))
    elif compat:
        # confirmed flips with every move: an addition counts if the item isn't confirmed, a removal if it is
        before = F.coalesce(F.lag("sign").over(order) == 1, F.coalesce("given", F.lit(False)))
        kept = moves.withColumn("on", before).filter("(sign = 1 and not on) or (sign = -1 and on)")
    else:
        sight_no = rows.select(*key, "frame_index", F.row_number().over(W.partitionBy(*key).orderBy("frame_index")).alias("no"))
        total = sight_no.groupBy(*key).agg(F.max("no").alias("last"))
        runs = moves.join(sight_no, [*key, "frame_index"]).join(total, key).withColumn("until", F.coalesce(F.lead("no").over(order), F.col("last") + 1))
        off = runs.filter(f"sign = -1 and until - no >= {debounce}").withColumn("no", F.col("no") + debounce - 1).select(*key, "item", "no", "sign")
        on = runs.filter("sign = 1").select(*key, "item", "no", "sign")
        flips = off.unionByName(on).join(first, [*key, "item"], "left").withColumn("was", F.coalesce(F.lag("sign").over(W.partitionBy(*key, "item").orderBy("no")) == 1, F.coalesce("given", F.lit(False))))
        kept = flips.filter("(sign = 1 and not was) or (sign = -1 and was)").join(sight_no, [*key, "no"])
    gather = lambda s: F.array_sort(F.collect_set(F.when(F.col("sign") == s, F.col("item"))))
    return kept.groupBy(*key, "frame_index").agg(gather(1).alias("added"), gather(-1).alias("removed"))


def relation_changes(seen: DataFrame, config: Config, semantic: bool = True, compat: bool = True) -> DataFrame:
    m = config.matching
    return changes(seen, "relations", pair_text, m.relation_semantic_threshold, m.relation_removal_debounce, config, semantic, compat)


def attribute_changes(seen: DataFrame, config: Config, semantic: bool = True, compat: bool = True) -> DataFrame:
    m = config.matching
    return changes(seen, "attributes", lambda c: c, m.attribute_semantic_threshold, m.attribute_removal_debounce, config, semantic, compat)


def relation_changed(seen: DataFrame, told: DataFrame) -> DataFrame:
    rows = seen.filter("status = 'matched'").join(told, ["sample_id", "entity_id", "frame_index"])
    shown = lambda c: _joined(F.transform(c, lambda r: F.concat(r["name"], F.lit("->"), r["object"])), "none")
    text = _s(F.col("entity_id"), " ", F.col("prev_tag"), " (", F.col("prev_label"), ") relation changed at frame ", F.col("frame_index"), "; added=", shown(F.col("added")), "; removed=", shown(F.col("removed")), ".")
    return rows.select(*_one("prev_", "relation_changed", text, F.lit(0.82), F.struct(F.col("added").alias("added_relations"), F.col("removed").alias("removed_relations")), 1, 1))


def attribute_changed(seen: DataFrame, told: DataFrame) -> DataFrame:
    rows = seen.filter("status = 'matched'").join(told, ["sample_id", "entity_id", "frame_index"])
    text = _s(F.col("entity_id"), " ", F.col("prev_tag"), " (", F.col("prev_label"), ") attributes changed at frame ", F.col("frame_index"), "; from ", _joined(F.col("prev_attributes"), "none"), " to ", _joined(F.col("attributes"), "none"), ".")
    return rows.select(*_one("prev_", "attribute_changed", text, F.lit(0.78), F.struct("prev_attributes", F.col("attributes").alias("curr_attributes")), 1, 2))


def trajectory_events(rows: DataFrame) -> DataFrame:
    c = F.col
    text = _s(c("entity_id"), " ", c("tag"), " (", c("label"), ") moved ", c("mode"), " from frame ", c("frame_start"), " to ", c("frame_end"), "; total_displacement=", F.format_string("%.1f", "total_displacement"), "px; avg_speed=", F.format_string("%.2f", "avg_speed"), "px/frame.")
    details = F.struct("frame_start", "frame_end", "total_displacement", "avg_speed", "mode", "direction_changes", "num_observations")
    return rows.select(*event("trajectory_summary", c("frame_start"), c("frame_end"), [c("entity_id")], [c("tag")], [c("label")], text, c("confidence"), details, [c("frame_end"), F.lit(4), c("bucket"), F.lit(0)], "buffer"))


def interaction_events(rows: DataFrame) -> DataFrame:
    c = F.col
    text = _s(c("entity_a"), " and ", c("entity_b"), " had interaction ", c("interaction_type"), " from frame ", c("frame_start"), " to ", c("frame_end"), "; distance ", F.format_string("%.1f", "distance_start"), "px -> ", F.format_string("%.1f", "distance_end"), "px.")
    details = F.struct("tag_a", "tag_b", "label_a", "label_b", "frame_start", "frame_end", "distance_start", "distance_end", "interaction_type", "num_common_frames")
    return rows.select(*event("interaction", c("frame_start"), c("frame_end"), [c("entity_a"), c("entity_b")], [c("tag_a"), c("tag_b")], [c("label_a"), c("label_b")], text, c("confidence"), details, [c("frame_end"), F.lit(4), c("bucket"), F.lit(1)], "buffer"))


def entity_states(observed: DataFrame) -> DataFrame:
    """A memory for each sight, with a description of the entity as known by then."""
    first = F.first("bbox").over(_by().rowsBetween(W.unboundedPreceding, 0))
    start = F.min("frame_index").over(W.partitionBy("sample_id", "entity_id"))
    rows = observed.withColumns({"d": displacement(first, F.col("bbox")), "frame_start": start})
    top = lambda items: F.coalesce(F.nullif(F.array_join(F.slice(items, 1, 5), ", "), F.lit("")), F.lit("none"))
    rels = F.array_sort(F.transform("relations", lambda r: F.concat(r["name"], F.lit("->"), r["object"])))
    text = _s(F.col("entity_id"), ": ", F.col("tag"), " (", F.col("label"), "); frames ", F.col("frame_start"), "-", F.col("frame_index"), "; last_box=", compact(F.col("bbox")), "; total_displacement=", F.format_string("%.1f", "d"), "px; attributes=", top(F.col("attributes")), "; relations=", top(rels), "; state=active")
    key = F.sha1(F.to_json(F.struct("entity_id", "frame_index", "bbox", "attributes", "relations")).cast("binary"))
    return rows.select("sample_id", F.lit("entity_state").alias("memory_type"), "entity_id", "tag", "label", "frame_index", "frame_start", F.col("frame_index").alias("frame_end"), "bbox", "attributes", "relations", F.col("d").alias("total_displacement"), text.alias("description"), F.col("detection_score").alias("confidence"), F.lit("active").alias("status"), F.lit("immediate").alias("source"), F.struct(F.col("frame_index").alias("frame"), F.when(F.col("status") == "new", 2).otherwise(1).alias("phase"), F.col("arrival").alias("place"), F.lit(3).alias("step")).alias("rank"), key.alias("dedupe_key"))


def memories(events: DataFrame, states: DataFrame) -> DataFrame:
    """Both kinds in one table by (sample_id, key): the first of equal dedupe keys stays, ids count from 0 in order of making."""
    a = events.select("sample_id", F.lit("events").alias("key"), F.col("summary").alias("content"), "rank", "dedupe_key", F.to_json(F.struct(*[c for c in EVENT if c not in ("sample_id", "rank", "dedupe_key")])).alias("metadata"))
    b = states.select("sample_id", F.lit("entities").alias("key"), F.col("description").alias("content"), "rank", "dedupe_key", F.to_json(F.struct(*[c for c in states.columns if c not in ("sample_id", "rank", "dedupe_key")])).alias("metadata"))
    return numbered(deduplicated(a.unionByName(b)))


def deduplicated(rows: DataFrame) -> DataFrame:
    """The first row of each dedupe key by rank; blank keys are never equal."""
    first = F.row_number().over(W.partitionBy("sample_id", "key", "dedupe_key").orderBy("rank", "content"))
    return rows.withColumn("_n", first).filter("_n = 1 or dedupe_key is null or dedupe_key = ''").drop("_n")


def numbered(rows: DataFrame) -> DataFrame:
    no = F.row_number().over(W.partitionBy("sample_id", "key").orderBy("rank", "content")) - 1
    return rows.withColumn("memory_id", F.format_string("%s_%06d", F.col("key"), no))
