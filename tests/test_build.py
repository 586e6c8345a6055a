"""Hand-made scenes through ingest, tracking, events, graph, retrieval and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from framesift.config import Config, Dag, Matching
from framesift.operators import dag, events, evidence, search, tracker, windows
from framesift.plans import memory
from framesift.sources import detector, scene_graph, tables
from framesift.streaming import tracking


def thing(tag, label, x, y=0, size=20, **more):
    return {"tag": tag, "label": label, "bbox": [x, y, x + size, y + size]} | more


def scene(*frames, name="s"):
    return name, json.dumps([{"frame_index": i, "objects": list(f)} for i, f in enumerate(frames)])


def ingest(spark, *scenes):
    rows = scene_graph.frames_of(spark.createDataFrame(list(scenes), "sample_id string, payload string"), ["sample_id"])
    good, bad = scene_graph.detections(rows, ["sample_id"])
    return rows.filter("fault is null").select("sample_id", "frame_index"), good, bad


def sights_of(spark, *scenes, config=None):
    frames, good, _ = ingest(spark, *scenes)
    told, observed = memory.associated(frames, good, config or Config())
    return frames, told, observed, events.sights(observed)


def test_ingest_normalises_and_accepts_aliases(spark):
    payload = {"frames": [{"image_path": "v/img_004.jpg", "objects": [{"name": " Man1 ", "category": "MAN", "box": [0, 0, 1, "2"], "attributes": "Tall", "relations": [["Near", "Ball"], "runs", {"predicate": "holds"}, {"name": "near", "object": "ball"}]}]}, {"frame_index": 2, "objects": [{"tag": "b", "label": "c", "bbox": [0, 0, 0, 0], "score": 0.5, "subject_relations": [{"predicate": "on", "object_tag": "T"}], "object_relations": [{"predicate": "under", "subject_tag": "U"}], "layer_mapping": {"Shoe": "M2", "hat": None}}]}]}
    frames, good, bad = ingest(spark, ("s", json.dumps(payload)))
    got = {r["frame_index"]: r.asDict(recursive=True) for r in good.collect()}
    assert bad.count() == 0 and sorted(got) == [2, 4]
    a, b = got[4], got[2]
    assert (a["tag"], a["label"], a["bbox"], a["score"], a["attributes"]) == ("man1", "man", [0, 0, 1, 2], 1.0, ["tall"])
    assert [(r["name"], r["object"]) for r in a["relations"]] == [("near", "ball"), ("runs", "unknown"), ("holds", "none")]
    assert [(r["name"], r["object"]) for r in b["relations"]] == [("on", "t"), ("under", "u")] and b["score"] == 0.5
    assert sorted((m["parent_tag"], m["child_tag"]) for m in b["layer_mappings"]) == [("b", "hat"), ("m2", "shoe")]
    assert frames.count() == 2


@pytest.mark.parametrize(
    ("payload", "said"),
    [
        ([{"frame_index": 1}, {"frame_index": 1}], "frame[1]: duplicate frame_index 1"), ([{"objects": [{"tag": "a", "label": "b", "bbox": [5, 0, 1, 1]}]}], "frame[0] object[0]: invalid bbox ordering"), ([{"objects": [{"label": "b", "bbox": [0, 0, 1, 1]}]}], "missing required field 'tag'"),
        ([{"objects": [{"tag": None, "name": "x", "label": "b", "bbox": [0, 0, 1, 1]}]}], "missing required field 'tag'"), ([{"objects": [{"tag": "a", "label": "b", "bbox": [0, 0, 1]}]}], "length 4"), ([{"objects": [{"tag": "a", "label": "b", "bbox": [0, 0, 1, 1], "score": "high"}]}], "field 'score' must be numeric"),
        ({"no": 1}, "scene graph JSON"), ([{"objects": 5}], "field 'objects' must be a list"), ([{"objects": [{"tag": " ", "label": "b", "bbox": [0, 0, 1, 1]}]}], "cannot be empty"), ([{"objects": [{"tag": "a", "label": "b", "bbox": [0, 0, 1, 1], "relations": [{"name": ""}]}]}], "relation name"),
    ],
)
def test_faults_tell_their_place(spark, payload, said):
    _, _, bad = ingest(spark, ("s", json.dumps(payload)))
    with pytest.raises(scene_graph.SceneGraphError) as e:
        scene_graph.strict(bad)
    assert said in str(e.value)


def test_converter(spark):
    raw = {"image_path": "a.jpg", "objects": {"boxes": [[0, 0, 1, 1], [0, 0, 2, 2], [0, 0, 3, 3]], "labels": ["man", "ball", "man"], "scores": [0.9]}, "hierarchy": {"layer1_nodes": ["man1"], "layer2_mapping": {"man1": ["ball", "ghost"]}, "layer3_mapping": {"ball": ["man2"]}}, "attributes": {"1": "red"}, "relations": [{"idx": [0, 1], "predicate": "kicks", "confidence": 0.7}, {"idx": [1], "predicate": "bad"}, {"idx": [2, 9], "object_label": "far", "predicate": "sees"}]}
    df = spark.createDataFrame([(0, json.dumps(raw))], "frame int, j string").select("frame", F.from_json("j", f"struct<{detector.RAW_FIELDS}>").alias("r")).select("frame", "r.*")
    objects = [o.asDict(recursive=True) for o in detector.convert(df, ["frame"]).first()["objects"]]
    assert [o["tag"] for o in objects] == ["man1", "ball", "man2"] and [o["score"] for o in objects] == [0.9, 0.0, 0.0] and [o["layer_id"] for o in objects] == [1, 2, 3]
    assert objects[1]["attributes"] == "red" and objects[0]["layer_mapping"] == [{"idx": 1, "tag": "ball"}] and objects[1]["layer_mapping"] == [{"idx": 2, "tag": "man2"}]
    assert objects[0]["subject_relations"] == [{"idx": 1, "predicate": "kicks", "object_tag": "ball", "confidence": 0.7}] and objects[1]["object_relations"][0]["subject_tag"] == "man1" and objects[2]["subject_relations"][0]["object_tag"] == "far"


def test_tracking_over_frames(spark):
    _, told, observed, _ = sights_of(spark, scene([thing("man1", "man", 0), thing("ball", "ball", 100)], [thing("man1", "man", 4)], [thing("man1", "man", 8), thing("ball", "ball", 100)]))
    rows = [(r["frame_index"], r["entity_id"], r["status"]) for r in told.orderBy("frame_index", "entity_id").collect()]
    assert rows == [(0, "entity_0001", "new"), (0, "entity_0002", "new"), (1, "entity_0001", "matched"), (1, "entity_0002", "disappeared"), (2, "entity_0001", "matched"), (2, "entity_0003", "new")]
    gone = events.disappeared(told, observed).first()
    assert gone["confidence"] == 0.85 and gone["frame_start"] == 1
    reg = {r["entity_id"]: r for r in tracker.entities(told, ingest(spark, scene([thing("man1", "man", 0), thing("ball", "ball", 100)], [thing("man1", "man", 4)], [thing("man1", "man", 8), thing("ball", "ball", 100)]))[1]).collect()}
    assert reg["entity_0001"]["state"] == "active" and reg["entity_0002"]["disappeared_frame"] == 1 and reg["entity_0001"]["total_displacement"] == 8.0 and len(reg["entity_0001"]["trajectory"]) == 3


def test_miss_tolerance_keeps_an_entity(spark):
    c = Config(matching=Matching(miss_tolerance=1))
    _, told, _, _ = sights_of(spark, scene([thing("a", "cat", 0)], [], [thing("a", "cat", 3)]), config=c)
    assert [(r["status"], r["reactivated"]) for r in told.orderBy("frame_index").collect()] == [("new", False), ("inactive", False), ("matched", True)]


def test_movement_events_and_fold(spark):
    frames = [[thing("m", "man", x, size=100)] for x in (0, 15, 18, 40)]
    _, _, _, seen = sights_of(spark, scene(*frames))
    assert sorted(r["frame_start"] for r in events.moved(seen, 10.0).collect()) == [1, 3]
    nodes = dag.moved_drafts(seen, Config()).collect()
    assert [(r["tau_frame"], json.loads(r["metadata"])["displacement"]) for r in nodes] == [(3, 25.0)]


def rel(name, other="ball"):
    return {"name": name, "object": other}


def changed(spark, present, debounce, compat=True):
    c = Config(matching=Matching(relation_removal_debounce=debounce))
    frames = [[thing("m", "man", 0, relations=[rel("near")] if p else [])] for p in present]
    _, _, _, seen = sights_of(spark, scene(*frames), config=c)
    return sorted((r["frame_index"], len(r["added"]), len(r["removed"])) for r in events.relation_changes(seen, c, compat=compat).collect())


def test_relation_debounce(spark):
    assert changed(spark, [1, 0, 0, 0, 0, 0], 3) == []
    assert changed(spark, [1, 0, 0], 1) == [(1, 0, 1)]
    assert changed(spark, [0, 1, 0, 1], 3) == [(1, 1, 0)]
    assert changed(spark, [0, 1, 0, 1], 1) == [(1, 1, 0), (2, 0, 1), (3, 1, 0)]
    assert changed(spark, [1, 0, 0, 0, 0], 3, compat=False) == [(3, 0, 1)]
    assert changed(spark, [1, 0, 1, 0, 0], 3, compat=False) == []


def relation_nodes(spark, *frames):
    _, _, _, seen = sights_of(spark, scene(*frames))
    starts, ends = dag.relation_drafts(dag.relation_islands(dag.relation_calls(seen)))
    return sorted(r["tau_frame"] for r in starts.collect()), [(r["tau_frame"], json.loads(r["metadata"])["duration_frames"]) for r in ends.collect()]


def test_relation_continuity(spark):
    run = [[thing("m", "man", 0, relations=[rel(n)])] for n in ("near", "near", "near", "far")]
    assert relation_nodes(spark, *run) == ([0, 3], [(2, 3)])
    two = [[thing("m", "man", 0, relations=[rel("near")]), thing("d", "dog", 200, relations=[rel("sees")])]] * 2
    assert relation_nodes(spark, *two) == ([0, 0, 1, 1], [])


def test_window_analysis(spark):
    def summary(*centers):
        rows = [("s", 0, "e", i, (float(x), float(y)), "t", "l") for i, (x, y) in enumerate(centers)]
        df = spark.createDataFrame(rows, "sample_id string, bucket int, entity_id string, frame_index int, center struct<x:double,y:double>, tag string, label string")
        return [(r["mode"], r["total_displacement"], r["direction_changes"], r["avg_speed"]) for r in windows.trajectories(df).collect()]

    assert summary((0, 0), (20, 0), (40, 0)) == [("moving_right", 40.0, 0, 20.0)]
    assert summary((0, 0), (20, 0), (20, 0), (20, 20))[0][0] == "direction_change"
    assert summary((0, 0), (12, 0))[0][0] == "stationary" and summary((0, 100), (0, 60))[0][0] == "jumping_up" and summary((0, 0), (3, 0)) == []

    def pair(a, b):
        rows = [("s", 0, e, i, (float(p[0]), float(p[1])), e, "l") for e, path in (("a", a), ("b", b)) for i, p in enumerate(path)]
        df = spark.createDataFrame(rows, "sample_id string, bucket int, entity_id string, frame_index int, center struct<x:double,y:double>, tag string, label string")
        return [r["interaction_type"] for r in windows.interactions(df).collect()]

    still = [(0, 0), (0, 0)]
    assert pair(still, [(100, 0), (60, 0)]) == ["approaching_each_other"] and pair(still, [(100, 0), (150, 0)]) == ["departing_from_each_other"]
    assert pair([(0, 0), (9, 0)], [(100, 0), (109, 0)]) == ["moving_together"] and pair(still, [(50, 0), (50, 0)]) == ["moving_together"] and pair(still, [(4, 0), (40, 0)]) == []


def test_reduction_and_closure(spark):
    edges = lambda *e: spark.createDataFrame([("s", a, b) for a, b in e], "sample_id string, parent_id string, child_id string")
    pairs = lambda df: sorted((r["parent_id"], r["child_id"]) for r in df.collect())
    assert pairs(dag.reduced(edges("ab", "ac", "bc"), ["sample_id"])) == [("a", "b"), ("b", "c")]
    assert pairs(dag.reduced(edges("ab", "bc", "cd", "ad", "bd"), ["sample_id"])) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert pairs(dag.reduced(edges("ac", "bc"), ["sample_id"])) == [("a", "c"), ("b", "c")]
    seed = spark.createDataFrame([(1, "s", "c")], "query_id int, sample_id string, node_id string")
    reach = lambda d: sorted(r["node_id"] for r in search.closure(seed, edges("ab", "bc"), d).collect())
    assert reach(1) == ["b", "c"] and reach(2) == ["a", "b", "c"]


def test_char_budget(spark):
    nodes = spark.createDataFrame([("q", "x", i, 0, "x" * 10) for i in range(3)], "query_id string, node_type string, tau_frame int, seq int, content string")
    assert search.linear_text(nodes, ["query_id"], 5).first()["context"] == "\n".join(["x" * 10] * 2)


def test_replies():
    got = evidence.read_reply('Sure: {"answer":"x"}')
    assert got == {"answer": "x", "sufficient_evidence": False, "used_event_ids": [], "used_entity_ids": [], "short_rationale": ""}
    assert evidence.read_reply("plain")["answer"] == "plain"
    assert evidence.answer("q", {"events": [], "entities": []}, lambda s, u: 1 / 0)["sufficient_evidence"] is False


@pytest.fixture(scope="module")
def built(spark):
    near = [rel("near", "ball")]
    frames = [[thing("man1", "man", 12 * i, size=60, relations=near if i < 3 else [rel("kicks", "ball")]), thing("ball", "ball", 300 - 20 * i, size=60)] for i in range(6)]
    frames.append([thing("man1", "man", 90, size=60)])
    found, good, _ = ingest(spark, scene(*frames, name="v1"), scene([thing("cat", "cat", 0)], name="v2"))
    return memory.build(found, good), found, good


def test_whole_build(spark, built, tmp_path):
    m, _, _ = built
    stats = {r["sample_id"]: r for r in m.stats().collect()}
    assert stats["v1"]["num_frames"] == 7 and stats["v1"]["num_entities"] == 2 and stats["v2"]["num_dag_nodes"] == 3
    kinds = {r["event_type"] for r in m.events.filter("sample_id = 'v1'").collect()}
    assert {"initial_scene", "entity_appeared", "entity_moved", "relation_changed", "entity_disappeared", "trajectory_summary", "interaction"} <= kinds
    nodes = {r["node_id"]: r for r in m.dag_nodes.collect()}
    assert len(nodes) == m.dag_nodes.count() and {r["node_type"] for r in nodes.values()} == {"entity_state", "entity_appeared", "entity_moved", "relation", "entity_disappeared", "periodic_description"}
    for r in nodes.values():
        for p in r["parent_ids"]:
            a = nodes[p]
            assert (a["tau_frame"], a["seq"]) < (r["tau_frame"], r["seq"]) or a["tau_frame"] <= r["frame_end"]
    ids = [r["memory_id"] for r in m.memories.filter("sample_id = 'v1' and key = 'events'").orderBy("memory_id").collect()]
    assert ids == [f"events_{i:06d}" for i in range(len(ids))]
    m.save(str(tmp_path))
    again = tables.load(spark, str(tmp_path), "dag_nodes", "v1")
    assert again.count() == sum(r["sample_id"] == "v1" for r in nodes.values()) and tables.keys_of(tables.load(spark, str(tmp_path), "memories"), "v1").count() == 2
    tables.clear(spark, str(tmp_path), "v1")
    assert tables.load(spark, str(tmp_path), "dag_nodes").select("sample_id").distinct().collect()[0][0] == "v2"


def test_retrieval(spark, built):
    m, _, _ = built
    asked = spark.createDataFrame([(1, "v1", "What happened to man1?"), (2, "v2", "where is the cat")], "query_id int, sample_id string, query string")
    one, two = memory.bundle_of(m.retrieve(asked))
    assert one["query_hints"]["entity_tags"] == ["man1"] and one["query_hints"]["query_intents"] == ["general"] and 0 < len(one["events"]) <= 8 and one["closure_stats"]["closure_size"] >= one["closure_stats"]["num_seeds"]
    frames = [e["frame_start"] for e in one["events"]]
    assert frames[0] == min(frames) and "--- Event Evidence ---" in evidence.render(one)
    assert two["entities"][0]["entity_id"] == "entity_0001" and two["summary_stats"]["num_tracked_entities"] == 1
    said = evidence.answer("q", one, lambda s, u: '{"answer": "it ran", "sufficient_evidence": 1, "used_event_ids": [3]}')
    assert said["used_event_ids"] == ["3"] and said["sufficient_evidence"] is True


def test_stream_gives_what_the_batch_gives(spark, built, tmp_path):
    m, found, good = built
    rows = tracking.frame_rows(found, good)
    for lo, hi in ((0, 3), (3, 7)):
        rows.filter(f"frame_index >= {lo} and frame_index < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracking.associate_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["sample_id"], r["frame_index"], r["entity_id"], r["status"]) for r in df.filter("status <> 'late'").collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    late = got.filter("status = 'late'").count()
    assert late == 0 and key(got) == key(m.associations)


def test_append_once(spark, tmp_path):
    write = tracking.append_once(str(tmp_path / "t"), ["k"])
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    write(df, 0)
    write(df, 0)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_switches_and_inert_kinds(spark):
    frames, told, observed, seen = sights_of(spark, scene([thing("a", "cat", 0, attributes=["color: red"], layer_mapping=["hat"])], [thing("a", "cat", 30, attributes=["color: blue"])]))
    placed = observed.join(windows.frame_buckets(frames, 5), ["sample_id", "frame_index"]).withColumn("center", F.struct(F.col("bbox")[0].alias("x"), F.col("bbox")[1].alias("y")))
    kinds = lambda c: sorted({r["node_type"] for r in memory.graph(told, observed, seen, placed, windows.frame_buckets(frames, 5), c)[0].select("node_type").collect()})
    assert "attribute_changed" not in kinds(Config()) and "layer_map" not in kinds(Config())
    assert {"attribute_changed", "layer_map"} <= set(kinds(Config(dag=Dag(compat=False))))
    assert kinds(Config(dag=Dag(kinds=frozenset()))) == ["entity_state"]


def test_graph_of_tracked_entities(spark):
    kind = "sample_id string, frame_index int, tag string, label string, bbox array<double>, attributes map<string,string>, layer_mappings array<struct<parent_tag:string,child_tag:string>>"
    rows = [("s", i, "m", "man", [x, 0.0, x + 2, 2.0], {"color": "red" if i < 2 else "blue"}, []) for i, x in enumerate((0.0, 4.0, 12.0, 13.0, 40.0, 41.0, 42.0))] + [("s", 0, "b", "ball", [0.0, 0.0, 1.0, 1.0], {}, [("b", "m")])]
    near = [("s", i, "m", "b", "Is Near") for i in (0, 1, 3)]
    nodes, edges = memory.graph_of_entities(spark.createDataFrame(rows, kind), spark.createDataFrame(near, "sample_id string, frame_index int, subject string, object string, predicate string"))
    made = sorted((r["node_type"], r["tau_frame"]) for r in nodes.collect())
    assert made == [("attribute_changed", 2), ("entity_appeared", 0), ("entity_appeared", 0), ("entity_moved", 2), ("entity_moved", 4), ("entity_state", 0), ("entity_state", 0), ("layer_map", 0), ("relation", 0), ("relation", 3)]
    by = {(r["node_type"], r["tau_frame"]): r for r in nodes.collect()}
    assert by["relation", 3]["parent_ids"] == [by["relation", 0]["node_id"]] and by["entity_moved", 4]["parent_ids"] == [by["entity_moved", 2]["node_id"]] and len(by["relation", 0]["parent_ids"]) == 2
    assert edges.filter("not exported").count() == 2
