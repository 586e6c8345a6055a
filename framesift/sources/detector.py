"""Raw detector frames to scene-graph frames, with DataFrame functions only.

A raw frame has parallel arrays of boxes, labels and scores, a hierarchy of
maps, attributes by object number and candidate relations by object numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW = """image_path string, objects struct<boxes: array<array<double>>, labels: array<string>, scores: array<double>>,
hierarchy struct<layer1_nodes: array<string>, layer2_mapping: map<string, array<string>>, layer3_mapping: map<string, array<string>>>,
attributes map<string, string>,
relations array<struct<idx: array<int>, subject_label: string, object_label: string, predicate: string, confidence: double>>"""


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(source, position, raw columns) of files that each hold a JSON list of raw frames, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.from_json("value", f"array<struct<{RAW_FIELDS}>>").alias("f"))
    return whole.select("source", F.posexplode("f").alias("position", "f")).select("source", "position", "f.*")


RAW_FIELDS = RAW.replace("\n", " ").replace("image_path string", "image_path: string").replace("objects struct", "objects: struct").replace("hierarchy struct", "hierarchy: struct").replace("attributes map", "attributes: map").replace("relations array", "relations: array")


def number_tags(rows: DataFrame, frame: list[str], label: str, order: str) -> DataFrame:
    """rows with tag: the label if it is alone in its frame, else the label and its number, from 1, by order."""
    in_label = W.partitionBy(*frame, label)
    rank, total = F.row_number().over(in_label.orderBy(order)), F.count("*").over(in_label)
    return rows.withColumn("tag", F.when(total == 1, F.col(label)).otherwise(F.concat(F.col(label), rank.cast("string"))))


def tag_to_idx(tagged: DataFrame, frame: list[str], idx: str = "idx") -> DataFrame:
    """(frame, tag, idx): of tags that clash the last number wins."""
    return tagged.groupBy(*frame, "tag").agg(F.max(idx).alias(idx))


def layer_id(tag: Column, layer1: Column, layer2: Column, layer3: Column) -> Column:
    """1, 2 or 3 by the first layer that names the tag; 1 if none does. layer2 and layer3 are maps of parents to children."""
    named = lambda m: F.coalesce(F.array_contains(F.flatten(F.map_values(m)), tag), F.lit(False))
    return F.when(F.coalesce(F.array_contains(layer1, tag), F.lit(False)), 1).when(named(layer2), 2).when(named(layer3), 3).otherwise(1)


def layer_children(tagged: DataFrame, maps: DataFrame, frame: list[str]) -> DataFrame:
    """(frame, parent, child, child_idx, layer, place): children that are in the frame, the second layer's first."""
    edges = None
    for layer in (2, 3):
        level = maps.select(*frame, F.explode(f"layer{layer}_mapping").alias("parent", "children")).select(*frame, "parent", F.lit(layer).alias("layer"), F.posexplode("children").alias("place", "child"))
        edges = level if edges is None else edges.unionByName(level)
    there = tag_to_idx(tagged, frame).withColumnRenamed("tag", "child").withColumnRenamed("idx", "child_idx")
    return edges.join(there, [*frame, "child"])


def split_tag(tag: Column) -> tuple[Column, Column]:
    """(label, number) of a tag with trailing digits; number 0 without any."""
    digits = F.regexp_extract(tag, r"(\d*)$", 1)
    return F.regexp_extract(tag, r"(?s)^(.*?)\d*$", 1), F.when(digits == "", 0).otherwise(digits.cast("int"))


def relation_sides(tagged: DataFrame, relations: DataFrame, frame: list[str]) -> tuple[DataFrame, DataFrame]:
    """(subject side, object side) of relations (frame, place, idx, subject_label, object_label, predicate, confidence).

    Each is (frame, idx, relations), the relations in order; the other end's tag falls back to its label."""
    pair = relations.filter(F.size("idx") == 2).select("*", F.col("idx")[0].alias("s"), F.col("idx")[1].alias("o")).drop("idx")
    tags = tagged.select(*frame, "idx", "tag")

    def side(own: str, other: str, label: str, name: str) -> DataFrame:
        named = pair.join(tags.withColumnsRenamed({"idx": other, "tag": "other_tag"}), [*frame, other], "left")
        here = named.join(tags.select(*frame, F.col("idx").alias(own)), [*frame, own], "left_semi")
        row = F.struct("place", F.col(other).alias("idx"), "predicate", F.coalesce("other_tag", label, F.lit("")).alias(name), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
        gathered = here.groupBy(*frame, F.col(own).alias("idx")).agg(F.array_sort(F.collect_list(row)).alias("r"))
        return gathered.select(*frame, "idx", F.transform("r", lambda r: r.dropFields("place")).alias("relations"))

    return side("s", "o", "object_label", "object_tag"), side("o", "s", "subject_label", "subject_tag")


def objects_of(raw: DataFrame, frame: list[str]) -> DataFrame:
    """(frame, idx, box, label, score, tag, attributes): an object for each box."""
    rows = raw.select(*frame, "attributes", "objects", F.posexplode("objects.boxes").alias("idx", "box"))
    label, score = F.get("objects.labels", F.col("idx")), F.get("objects.scores", F.col("idx"))
    labelled = rows.select(*frame, "idx", "box", label.alias("own"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(F.try_element_at("attributes", F.col("idx").cast("string")), F.lit("")).alias("attributes"))
    known = number_tags(labelled.filter("own is not null"), frame, "own", "idx")
    return known.unionByName(labelled.filter("own is null").withColumn("tag", F.lit("unknown"))).withColumn("label", F.coalesce("own", F.lit("unknown"))).drop("own")


def convert(raw: DataFrame, frame: list[str]) -> DataFrame:
    """(frame, image_path, objects): scene-graph frames; raw has the columns RAW and frame's, which tell frames apart."""
    objects = objects_of(raw, frame)
    maps = raw.select(*frame, F.col("hierarchy.layer1_nodes").alias("layer1"), "hierarchy.layer2_mapping", "hierarchy.layer3_mapping")
    children = layer_children(objects, maps, frame).groupBy(*frame, F.col("parent").alias("tag")).agg(F.array_sort(F.collect_list(F.struct("layer", "place", F.col("child_idx").alias("idx"), F.col("child").alias("tag")))).alias("c"))
    relations = raw.select(*frame, F.posexplode("relations").alias("place", "r")).select(*frame, "place", "r.*")
    subject, object_ = relation_sides(objects, relations, frame)
    rows = objects.join(maps, frame, "left").join(children, [*frame, "tag"], "left")
    rows = rows.join(subject.withColumnRenamed("relations", "subject_relations"), [*frame, "idx"], "left").join(object_.withColumnRenamed("relations", "object_relations"), [*frame, "idx"], "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    item = F.struct(
        "idx", "box", "score", "label", "tag", "attributes", layer_id(F.col("tag"), F.col("layer1"), F.col("layer2_mapping"), F.col("layer3_mapping")).alias("layer_id"),
        F.coalesce(F.transform("c", lambda x: x.dropFields("layer", "place")), F.array().cast("array<struct<idx:int,tag:string>>")).alias("layer_mapping"),
        none("subject_relations", "array<struct<idx:int,predicate:string,object_tag:string,confidence:double>>"),
        none("object_relations", "array<struct<idx:int,predicate:string,subject_tag:string,confidence:double>>"),
    )
    gathered = rows.groupBy(*frame).agg(F.array_sort(F.collect_list(item), lambda a, b: a["idx"] - b["idx"]).alias("objects"))
    return raw.select(*frame, F.coalesce("image_path", F.lit("")).alias("image_path")).join(gathered, frame, "left")


def write_frames(frames: DataFrame, path: str) -> None:
    """Scene-graph frames as JSON lines, null fields left out."""
    frames.write.mode("overwrite").json(path)
