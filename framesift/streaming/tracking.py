"""The build as a stream: keyed tracker state, late and repeated frames set aside, idempotent sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framesift.config import Config
from framesift.operators.tracker import ASSOCIATION, Tracker

#: A stream's rows: one for each frame, with its detections.
FRAMES = "sample_id string, frame_index int, detections array<struct<ord:int,tag:string,label:string,bbox:array<double>,score:double>>"


def associate_stream(frames: DataFrame, config: Config | None = None) -> DataFrame:
    """ASSOCIATION rows of a stream of FRAMES, as the batch tracker gives them.

    State is kept by sample: the last frame and the entities, those that disappeared by number alone. Within a trigger frames are
    put in order; a frame that is not after the last one gives a single row of status 'late' and changes nothing."""
    config = config or Config()
    columns = [x.split()[0] for x in ASSOCIATION.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = Tracker(config.matching, config.embedding), None
        if state.exists:
            last, tracker.made, tracker.living = json.loads(state.get[0])
        out, frames = [], sorted((row for b in batches for row in b[["frame_index", "detections"]].itertuples(index=False)), key=lambda r: r[0])
        for frame, found in frames:
            if last is not None and frame <= last:
                out.append((key[0], frame, None, None, "late", False, 0, None, None, None, False, 0))
                continue
            rows = [(d["ord"], d["tag"], d["label"], list(d["bbox"])) for d in (found if found is not None else []) if d["score"] >= config.matching.detection_score_threshold]
            out += [(key[0], *r) for r in tracker.frame(int(frame), sorted(rows, key=lambda r: r[0]))]
            last = int(frame)
        state.update((json.dumps([last, tracker.made, tracker.living]),))
        yield pd.DataFrame(out, columns=columns)

    return frames.groupBy("sample_id").applyInPandasWithState(step, ASSOCIATION, "state string", "append", GroupStateTimeout.NoTimeout)


def once(rows: DataFrame, time: str = "seen_at", delay: str = "1 hour", key: str = "dedupe_key") -> DataFrame:
    """A stream without rows whose key came within the watermark's delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_once(path: str, keys: list[str], by: str | None = None):
    """A foreachBatch function that appends what a table doesn't hold yet, so a batch that is run again adds nothing.

    by: a key that the table is laid out by; a batch then reads only the partitions that it has rows for."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        new = batch.dropDuplicates(keys)
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            held = spark.read.schema(batch.schema).parquet(path).select(*keys)
            if by is not None:
                held = held.join(F.broadcast(new.select(by).distinct()), by, "left_semi")
            new = new.join(held, keys, "left_anti")
        (new.write.mode("append") if by is None else new.write.mode("append").partitionBy(by)).parquet(path)

    return write


def frame_rows(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """FRAMES rows of batch tables, for replays and tests."""
    gathered = detections.groupBy("sample_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("ord", "tag", "label", "bbox", "score"))).alias("detections"))
    return frames.select("sample_id", "frame_index").join(gathered, ["sample_id", "frame_index"], "left")
