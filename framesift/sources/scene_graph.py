"""Scene-graph JSON to normalised detections. Fields may have any type, so they are read as VARIANT and checked.

Faults are rows of a quarantine table with the frame, the object and a message;
strict() raises the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesift.functions.relations import PAIRS
from framesift.functions.text import frame_number, normalize, or_none

LAYERS = "array<struct<parent_tag:string,child_tag:string>>"


class SceneGraphError(ValueError):
    """Scene-graph JSON that breaks the contract."""


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(source, payload): one JSON text for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("payload"))


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _fields(v: Column) -> Column:
    return _get(v, "map<string,variant>")


def _null(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _text(v: Column) -> Column:
    return F.when(~_null(v), _get(v, "string"))


def _first(m: Column, *names: str) -> Column:
    """The value of the first name that the object has, even if that is a JSON null."""
    out = F.lit(None).cast("variant")
    for name in reversed(names):
        out = F.when(F.map_contains_key(m, name), F.try_element_at(m, F.lit(name))).otherwise(out)
    return out


def _truthy(m: Column, *names: str) -> Column:
    """The text of the first name whose value is neither null nor empty."""
    return F.coalesce(*(F.nullif(_text(F.try_element_at(m, F.lit(n))), F.lit("")) for n in names))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are reckoned once a row: no filter or projection after a generator is merged with what it gives."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def frames_of(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, frame_index, image_path, frame, fault): the frames of each payload, either layout, with what is wrong with the payload or frame."""
    rows = _once(payloads.select(*keys, "payload"), p=F.try_parse_json("payload")).drop("payload")
    rows = _once(rows, top=_fields(F.col("p")))
    top = F.col("top")
    rows = _once(rows, f=_get(F.when(F.map_contains_key(top, "frames"), F.try_element_at(top, F.lit("frames"))).otherwise(F.col("p")), "array<variant>"))
    listed = F.col("f")
    bad = F.when(top.isNotNull() & ~F.map_contains_key(top, "frames") | top.isNull() & listed.isNull(), "scene graph JSON must be a list of frames or an object with 'frames'").when(listed.isNull(), "top-level 'frames' must be a list")
    rows = rows.select(*keys, bad.alias("fault"), "f")
    broken = rows.filter("fault is not null").select(*keys, F.lit(None).cast("int").alias("position"), F.lit(None).cast("int").alias("frame_index"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("variant").alias("frame"), "fault")
    each = _once(rows.filter("fault is null").select(*keys, F.posexplode("f").alias("position", "frame")), m=_fields(F.col("frame")))
    m = F.col("m")
    each = each.select(*keys, "position", frame_number(_text(F.try_element_at(m, F.lit("frame_index"))), F.coalesce(_text(F.try_element_at(m, F.lit("image_path"))), F.lit("")), F.col("position")).alias("frame_index"), _text(F.try_element_at(m, F.lit("image_path"))).alias("image_path"), "frame", m.isNull().alias("no_object"), F.try_element_at(m, F.lit("objects")).alias("objects"))
    each = each.withColumn("odd", ~_null(F.col("objects")) & _get(F.col("objects"), "array<variant>").isNull()).drop("objects")
    again = F.row_number().over(W.partitionBy(*keys, "frame_index").orderBy("position")) > 1
    fault = F.when(F.col("no_object"), "each frame must be a JSON object").when(again, F.concat(F.lit("duplicate frame_index "), F.col("frame_index"))).when(F.col("odd"), "field 'objects' must be a list")
    return each.withColumn("fault", fault).drop("no_object", "odd").unionByName(broken)


def relation(v: Column) -> Column:
    """struct<name, object> of a relation that is an object, a pair or a bare name."""
    m, pair = _fields(v), _get(v, "array<variant>")
    by_name = normalize(F.coalesce(F.when(~_null(_first(m, "name", "relation", "predicate")), _text(_first(m, "name", "relation", "predicate"))), F.when(_first(m, "name", "relation", "predicate").isNotNull(), "none"), F.lit("")))
    name = F.when(m.isNotNull(), by_name).when(F.size(pair) >= 2, or_none(_text(pair[0]))).otherwise(or_none(_text(v)))
    target = F.when(m.isNotNull(), or_none(_truthy(m, "object", "target", "object_tag", "object_id", "subject_tag", "source"))).when(F.size(pair) >= 2, or_none(_text(pair[1]))).otherwise(F.lit("unknown"))
    return F.struct(name.alias("name"), F.coalesce(F.nullif(target, F.lit("")), F.lit("unknown")).alias("object"))


def _side(m: Column, field: str, *targets: str) -> Column:
    items = _get(F.try_element_at(m, F.lit(field)), "array<variant>")

    def one(v: Column) -> Column:
        r = _fields(v)
        name, target = _first(r, "predicate", "name"), _first(r, *targets)
        return F.struct(F.when(name.isNull(), "").otherwise(or_none(_text(name))).alias("name"), F.when(target.isNull(), "unknown").otherwise(or_none(F.nullif(_text(target), F.lit("")))).alias("object"))

    return F.coalesce(F.transform(items, one), F.array().cast(PAIRS))


def relations(m: Column) -> Column:
    """The relations of an object: its own list, or both sides' lists if it has none; each once, in order."""
    own = F.try_element_at(m, F.lit("relations"))
    sides = F.concat(_side(m, "subject_relations", "object_tag", "object", "target"), _side(m, "object_relations", "subject_tag", "object", "source"))
    return F.array_distinct(F.when(_null(own), sides).otherwise(F.coalesce(F.transform(_get(own, "array<variant>"), relation), F.array().cast(PAIRS))))


def attribute_list(m: Column) -> Column:
    v = F.try_element_at(m, F.lit("attributes"))
    items = F.coalesce(F.transform(_get(v, "array<variant>"), lambda x: or_none(_text(x))), F.map_keys(_fields(v)), F.array(normalize(_text(v))))
    return F.when(_null(v), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.filter(F.transform(items, normalize), lambda x: x.isNotNull() & (x != "")))))


def layer_mappings(m: Column, tag: Column) -> Column:
    """{parent_tag, child_tag} of an object's layer mapping: {child: parent}, a list of objects or a list of names."""
    v = F.try_element_at(m, F.lit("layer_mapping"))
    pair = lambda parent, child: F.struct(parent.alias("parent_tag"), child.alias("child_tag"))
    as_map = F.transform(F.map_entries(_fields(v)), lambda e: pair(normalize(F.coalesce(F.when(F.schema_of_variant(e["value"]) == "STRING", F.nullif(F.trim(_text(e["value"])), F.lit(""))), tag)), normalize(e["key"])))

    def item(x: Column) -> Column:
        f = _fields(x)
        return pair(F.when(f.isNotNull(), normalize(F.coalesce(_truthy(f, "parent", "parent_tag"), tag))).otherwise(tag), F.when(f.isNotNull(), or_none(_truthy(f, "tag", "child", "object_tag", "target"))).otherwise(or_none(_text(x))))

    both = F.coalesce(as_map, F.transform(_get(v, "array<variant>"), item), F.array().cast(LAYERS))
    return F.array_distinct(F.filter(both, lambda p: (p["parent_tag"] != "") & (p["child_tag"] != "")))


def detections(frames: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(detections, faults) of frames_of(): a row for each object that is whole, and (keys, frame_index, ord, fault) for the rest."""
    m = _fields(F.col("frame"))
    rows = frames.filter("fault is null").select(*keys, "frame_index", "image_path", F.posexplode(_get(F.try_element_at(m, F.lit("objects")), "array<variant>")).alias("ord", "o"))
    rows = _once(rows, m=_fields(F.col("o")))
    o = F.col("m")
    raw_tag, raw_label, raw_box, raw_score = _first(o, "tag", "name"), _first(o, "label", "category"), _first(o, "bbox", "box"), F.try_element_at(o, F.lit("score"))
    rows = _once(rows, box_items=_get(raw_box, "array<variant>"), relations=relations(o))
    box = F.col("box_items")
    rows = _once(
        rows, tag=normalize(_text(raw_tag)), label=normalize(_text(raw_label)), bbox=F.transform(box, lambda x: F.coalesce(_get(x, "double"), _text(x).try_cast("double"))),
        score=F.when(raw_score.isNull(), F.lit(1.0)).otherwise(F.coalesce(_get(raw_score, "double"), _text(raw_score).try_cast("double"))), no_tag=_null(raw_tag), no_label=_null(raw_label), no_box=_null(raw_box),
    )
    own = F.try_element_at(o, F.lit("relations"))
    fault = (
        F.when(o.isNull(), "each object must be a JSON object").when(F.col("no_tag"), "missing required field 'tag'").when(F.col("no_label"), "missing required field 'label'")
        .when(F.col("no_box"), "missing required field 'bbox' or 'box'").when(F.col("tag") == "", "field 'tag' cannot be empty after normalization").when(F.col("label") == "", "field 'label' cannot be empty after normalization")
        .when(F.col("bbox").isNull() | (F.size("bbox") != 4), "field 'bbox' must be a list/tuple of length 4").when(F.exists("bbox", lambda x: x.isNull()), "field 'bbox' must be numeric")
        .when((F.col("bbox")[2] < F.col("bbox")[0]) | (F.col("bbox")[3] < F.col("bbox")[1]), "invalid bbox ordering; expected x2>=x1 and y2>=y1").when(F.col("score").isNull(), "field 'score' must be numeric if provided")
        .when(~_null(own) & _get(own, "array<variant>").isNull(), "field 'relations' must be a list if provided").when(F.exists("relations", lambda r: r["name"] == ""), "a relation is missing a valid relation name")
    )
    rows = _once(rows, fault=fault)
    good = rows.filter("fault is null").select(*keys, "frame_index", "ord", "tag", "label", "bbox", "score", attribute_list(o).alias("attributes"), "relations", layer_mappings(o, F.col("tag")).alias("layer_mappings"), _get(F.try_element_at(o, F.lit("layer_id")), "int").alias("layer_id"), F.to_json("o").alias("extra"))
    bad = frames.filter("fault is not null").select(*keys, "frame_index", F.lit(None).cast("int").alias("ord"), "fault")
    return good, bad.unionByName(rows.filter("fault is not null").select(*keys, "frame_index", "ord", "fault"))


def strict(faults: DataFrame) -> None:
    """Raise the first fault, with its place."""
    for r in faults.orderBy(F.col("frame_index").asc_nulls_first(), F.col("ord").asc_nulls_first()).limit(1).collect():
        at = "".join([f"frame[{r['frame_index']}]" if r["frame_index"] is not None else "", f" object[{r['ord']}]" if r["ord"] is not None else ""])
        raise SceneGraphError(f"{at}: {r['fault']}" if at else r["fault"])


def by_score(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.filter(F.col("score") >= threshold)
