"""More queries with DuckDB SQL: events and graph nodes, long paths, stores, faults, tracking, evidence. Importing it adds them to the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framesift.config import Config, Matching
from framesift.functions import geometry
from framesift.operators import dag, events, evidence, query, search, tracker, windows
from framesift.plans import bindings as b
from framesift.plans.catalog import _D, _F, ORACLE_SQL, _sights, r4, registered
from framesift.sources import detector, scene_graph, tables
from framesift.sources.storage import shared_dir

_BOX = "printf('[%d, %d, %d, %d]', CAST(round_even(x1, 0) AS BIGINT), CAST(round_even(y1, 0) AS BIGINT), CAST(round_even(x1 + 50, 0) AS BIGINT), CAST(round_even(y1 + 50, 0) AS BIGINT))"
_L = _D + ", l AS (SELECT *, lag(label) OVER (PARTITION BY sample_id, entity_id ORDER BY frame_index) AS old, min(frame_index) OVER (PARTITION BY sample_id, entity_id) AS f0, max(frame_index) OVER (PARTITION BY sample_id, entity_id) AS f1, max(frame_index) OVER (PARTITION BY sample_id) AS last FROM d)"


def _gone(spark, sf_dir):
    """The associations of detections() as if a user that isn't seen again were given up a day later."""
    d = b.detections(spark, sf_dir)
    last = d.groupBy("sample_id").agg(F.max("frame_index").alias("last"))
    ends = d.groupBy("sample_id", F.col("entity_id").cast("string").alias("entity_id")).agg(F.max("frame_index").alias("f1")).join(F.broadcast(last), "sample_id").filter("f1 < last")
    return ends.select("sample_id", (F.col("f1") + 1).cast("int").alias("frame_index"), F.lit(None).cast("int").alias("ord"), "entity_id", F.lit("disappeared").alias("status"), F.lit(0).alias("arrival"), F.lit(1).alias("missed_frames"))


# ---- events


@registered(f"""WITH {_L} SELECT sample_id, CAST(frame_index AS INT) AS frame_start, entity_id || ' ' || tag || ' (' || label || ') appeared at frame ' || frame_index || '; box=' || {_BOX} || '; attributes=' || label || '.' AS summary FROM l WHERE frame_index = f0""")
def appeared_events(spark, sf_dir):
    return events.appeared(_sights(spark, sf_dir)).select("sample_id", "frame_start", "summary")


@registered(f"""WITH {_L} SELECT sample_id, CAST(frame_index + 1 AS INT) AS frame_start, entity_id || ' ' || tag || ' (' || label || ') disappeared at frame ' || (frame_index + 1) || '; last_box=' || {_BOX} || '.' AS summary, CAST(0.85 AS DOUBLE) AS confidence FROM l WHERE frame_index = f1 AND f1 < last""")
def disappeared_events(spark, sf_dir):
    return events.disappeared(_gone(spark, sf_dir), _sights(spark, sf_dir)).select("sample_id", "frame_start", "summary", "confidence")


@registered(f"""WITH {_L} SELECT sample_id, CAST(frame_index AS INT) AS frame_start, entity_id || ' ' || tag || ' (' || old || ') attributes changed at frame ' || frame_index || '; from ' || old || ' to ' || label || '.' AS summary FROM l WHERE old IS NOT NULL AND old <> label""")
def attribute_events(spark, sf_dir):
    seen = events.sights(_sights(spark, sf_dir))
    told = events.attribute_changes(seen, Config(matching=Matching(attribute_removal_debounce=1)), semantic=False)
    return events.attribute_changed(seen, told).select("sample_id", "frame_start", "summary")


@registered(f"""WITH {_L} SELECT sample_id, CAST(frame_index AS INT) AS frame_start, entity_id || ' ' || tag || ' (' || old || ') relation changed at frame ' || frame_index || '; added=' || label || '->site; removed=' || old || '->site.' AS summary FROM l WHERE old IS NOT NULL AND old <> label""")
def relation_events(spark, sf_dir):
    seen = events.sights(_sights(spark, sf_dir))
    told = events.relation_changes(seen, Config(matching=Matching(relation_removal_debounce=1)), semantic=False)
    return events.relation_changed(seen, told).select("sample_id", "frame_start", "summary")


@registered(f"""WITH {_L}, m AS (SELECT *, first(x1) OVER w AS ax, first(y1) OVER w AS ay FROM l WINDOW w AS (PARTITION BY sample_id, entity_id ORDER BY frame_index))
SELECT sample_id, CAST(entity_id AS VARCHAR) AS entity_id, CAST(frame_index AS INT) AS frame_index, CAST(f0 AS INT) AS frame_start, round(sqrt((x1 - ax) ** 2 + (y1 - ay) ** 2), 3) AS total_displacement,
 entity_id || ': ' || tag || ' (' || label || '); frames ' || f0 || '-' || frame_index || '; last_box=' || {_BOX} || '; attributes=' || label || '; relations=' || label || '->site; state=active' AS description FROM m""")
def entity_states(spark, sf_dir):
    s = events.entity_states(_sights(spark, sf_dir))
    return s.select("sample_id", "entity_id", "frame_index", "frame_start", F.round("total_displacement", 3).alias("total_displacement"), F.regexp_replace("description", r"total_displacement=[0-9.]+px; ", "").alias("description"))


@registered(f"""SELECT sample_id, frame_start, frame_end, entity_id || ' user' || entity_id || ' (' || label || ') moved ' || mode || ' from frame ' || frame_start || ' to ' || frame_end AS summary, direction_changes, confidence FROM ({ORACLE_SQL["trajectory_summary"]})""")
def trajectory_events(spark, sf_dir):
    e = events.trajectory_events(windows.trajectories(b.placed(spark, sf_dir)))
    return e.select("sample_id", "frame_start", "frame_end", F.substring_index("summary", ";", 1).alias("summary"), F.get_json_object("details", "$.direction_changes").cast("long").alias("direction_changes"), "confidence")


@registered(f"""SELECT sample_id, frame_start, frame_end, entity_a || ' and ' || entity_b || ' had interaction ' || interaction_type || ' from frame ' || frame_start || ' to ' || frame_end AS summary FROM ({ORACLE_SQL["pair_interaction"]})""")
def interaction_events(spark, sf_dir):
    e = events.interaction_events(windows.interactions(b.placed(spark, sf_dir)))
    return e.select("sample_id", "frame_start", "frame_end", F.substring_index("summary", ";", 1).alias("summary"))


@registered(f"""WITH {_L}, e AS (SELECT sample_id, 'events' AS key, row_number() OVER (PARTITION BY sample_id ORDER BY frame_index, entity_id) - 1 AS n FROM l WHERE frame_index = f0 UNION ALL SELECT sample_id, 'entities', row_number() OVER (PARTITION BY sample_id ORDER BY frame_index, frame_index > f0 DESC, entity_id) - 1 FROM l)
SELECT sample_id, key, printf('%s_%06d', key, n) AS memory_id FROM e""")
def memory_rows(spark, sf_dir):
    seen = _sights(spark, sf_dir)
    both = events.memories(events.appeared(seen), events.entity_states(seen))
    again = events.deduplicated(both.unionByName(both).drop("memory_id"))  # the same events twice are one
    return events.numbered(again).select("sample_id", "key", "memory_id")


# ---- graph nodes


@registered(f"""SELECT sample_id, 'interaction' AS node_type, CAST(frame_end AS INT) AS tau_frame, 'user' || entity_a || ' and user' || entity_b || ' ' || interaction_type || ' (frames ' || frame_start || '-' || frame_end || ')' AS content,
 'interaction:' || least('user' || entity_a, 'user' || entity_b) || ':' || greatest('user' || entity_a, 'user' || entity_b) AS chain FROM ({ORACLE_SQL["pair_interaction"]})""")
def interaction_nodes(spark, sf_dir):
    return dag.interaction_drafts(windows.interactions(b.placed(spark, sf_dir))).select("sample_id", "node_type", "tau_frame", "content", "chain")


@registered(f"""WITH {_D} SELECT a.sample_id, CAST(a.frame_index AS INT) AS tau_frame, a.tag || ' occludes ' || c.tag || ' (frames ' || a.frame_index || '-' || a.frame_index || ')' AS content, 'occlusion:' || a.tag || ':' || c.tag AS chain FROM d a JOIN d c ON c.sample_id = a.sample_id AND c.frame_index = a.frame_index AND c.entity_id = a.entity_id + 3""")
def occlusion_nodes(spark, sf_dir):
    d = b.detections(spark, sf_dir).select("sample_id", "frame_index", "entity_id", "tag")
    other = d.select("sample_id", "frame_index", (F.col("entity_id") - 3).alias("entity_id"), F.col("tag").alias("occluded_tag"))
    rows = d.join(other, ["sample_id", "frame_index", "entity_id"]).select("sample_id", F.col("frame_index").alias("frame_start"), F.col("frame_index").alias("frame_end"), F.col("tag").alias("occluder_tag"), "occluded_tag")
    return dag.occlusion_drafts(rows).select("sample_id", "tau_frame", "content", "chain")


@registered(f"""SELECT sample_id, frame_end AS tau_frame, '[scene] ' || description AS content FROM ({ORACLE_SQL["window_description"]})""")
def description_nodes(spark, sf_dir):
    d = b.detections(spark, sf_dir)
    buckets = windows.frame_buckets(d.select("sample_id", "frame_index").distinct(), 5)
    return dag.description_drafts(windows.descriptions(d.join(buckets, ["sample_id", "frame_index"]), buckets)).select("sample_id", "tau_frame", "content")


@registered(f"""SELECT CAST(frame AS VARCHAR) AS sample_id, parent || ' contains ' || child AS content, CAST(row_number() OVER (PARTITION BY frame ORDER BY parent, child) - 1 AS INT) AS seq FROM (SELECT DISTINCT frame, parent, child FROM ({ORACLE_SQL["layer_children"]}))""")
def layer_nodes(spark, sf_dir):
    raw = b.nation_frames(spark, sf_dir)
    maps = raw.select("frame", "hierarchy.layer2_mapping", "hierarchy.layer3_mapping")
    pairs = detector.layer_children(detector.objects_of(raw, ["frame"]), maps, ["frame"]).select(F.col("frame").cast("string").alias("sample_id"), F.col("parent").alias("parent_tag"), F.col("child").alias("child_tag")).distinct()
    return dag.clocked(dag.layer_drafts(pairs.withColumns({"frame_index": F.lit(0), "arrival": F.lit(0)}))).select("sample_id", "content", "seq")


@registered(f"""WITH {_L} SELECT sample_id, CAST(frame_index + 1 AS INT) AS tau_frame, tag, split_part(tag || ' disappeared at frame ' || (frame_index + 1) || ', last', ',', 1) AS content FROM l WHERE frame_index = f1 AND f1 < last""")
def disappeared_nodes(spark, sf_dir):
    n = dag.disappeared_drafts(_gone(spark, sf_dir), _sights(spark, sf_dir))
    return n.select("sample_id", "tau_frame", F.col("tags")[0].alias("tag"), F.substring_index("content", ",", 1).alias("content"))


@registered(f"""WITH RECURSIVE {_D}, g AS (SELECT *, lag(x1) OVER w AS px, lag(y1) OVER w AS py FROM d WINDOW w AS (PARTITION BY sample_id, entity_id ORDER BY frame_index)),
e AS (SELECT sample_id, tag, frame_index, x1 AS x, y1 AS y, row_number() OVER (PARTITION BY sample_id, tag ORDER BY frame_index) AS n FROM g WHERE px IS NOT NULL AND sqrt((x1 - px) ** 2 + (y1 - py) ** 2) >= 10),
w AS (SELECT sample_id, tag, frame_index, n, x AS ax, y AS ay, CAST(NULL AS DOUBLE) AS s FROM e WHERE n = 1
 UNION ALL SELECT e.sample_id, e.tag, e.frame_index, e.n, CASE WHEN sqrt((e.x - w.ax) ** 2 + (e.y - w.ay) ** 2) >= 10 THEN e.x ELSE w.ax END, CASE WHEN sqrt((e.x - w.ax) ** 2 + (e.y - w.ay) ** 2) >= 10 THEN e.y ELSE w.ay END, sqrt((e.x - w.ax) ** 2 + (e.y - w.ay) ** 2) FROM w JOIN e ON e.sample_id = w.sample_id AND e.tag = w.tag AND e.n = w.n + 1)
SELECT sample_id, tag, CAST(frame_index AS INT) AS tau_frame, round(s, 3) AS displacement FROM w WHERE s >= 10""")
def moved_nodes(spark, sf_dir):
    n = dag.moved_drafts(events.sights(_sights(spark, sf_dir)), Config(), place_of=geometry.corner)
    return n.select("sample_id", F.col("tags")[0].alias("tag"), "tau_frame", F.round(F.get_json_object("metadata", "$.displacement").cast("double"), 3).alias("displacement"))


@registered(f"""WITH i AS ({ORACLE_SQL["relation_islands"]}) SELECT user_id, CAST(start_frame AS INT) AS tau_frame, event_type AS content FROM i
UNION ALL SELECT user_id, CAST(last_frame AS INT), event_type || ' (continuous from frame ' || start_frame || ' to ' || last_frame || ')' FROM i WHERE ended AND last_frame > start_frame""")
def relation_nodes(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("frame_index"), "event_type")
    calls = e.select("sample_id", "frame_index", F.lit(1).alias("phase"), F.lit(0).alias("place"), F.lit("u").alias("subject"), F.lit(0).alias("item"), F.col("event_type").alias("predicate"), F.lit("site").alias("object"), F.col("event_type").alias("key"))
    starts, ends = dag.relation_drafts(dag.relation_islands(calls))
    return starts.unionByName(ends).select(F.col("sample_id").cast("long").alias("user_id"), "tau_frame", "content")


def _changes(spark, sf_dir):
    """(clocked drafts, candidate edges) of states, appearances and changes of kind."""
    seen = _sights(spark, sf_dir)
    rows = seen.select("sample_id", "tag", F.lit("kind").alias("attribute"), F.col("label").alias("value"), "frame_index", "arrival")
    nodes = dag.clocked(dag.state_drafts(seen).unionByName(dag.appeared_drafts(seen)).unionByName(dag.attribute_drafts(rows)))
    return nodes, dag.candidate_edges(nodes)


@registered(f"""WITH {_L}, c AS (SELECT sample_id, tag, f0, frame_index AS tau, lag(frame_index) OVER (PARTITION BY sample_id, tag ORDER BY frame_index) AS before FROM l WHERE old IS NOT NULL AND old <> label)
SELECT sample_id, tag, CASE WHEN before IS NULL THEN 'entity_state' ELSE 'attribute_changed' END AS parent, CAST(coalesce(before, f0) AS INT) AS parent_frame, 'attribute_changed' AS child, CAST(tau AS INT) AS child_frame, true AS exported FROM c
UNION ALL SELECT DISTINCT sample_id, tag, 'entity_appeared', CAST(f0 AS INT), 'entity_state', CAST(f0 AS INT), false FROM l""")
def change_edges(spark, sf_dir):
    nodes, edges = _changes(spark, sf_dir)
    n = nodes.select("sample_id", "node_id", "node_type", "tau_frame", F.col("tags")[0].alias("tag"))
    a = n.select("sample_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent"), F.col("tau_frame").alias("parent_frame"))
    c = n.select("sample_id", F.col("node_id").alias("child_id"), F.col("node_type").alias("child"), F.col("tau_frame").alias("child_frame"), "tag")
    return edges.join(a, ["sample_id", "parent_id"]).join(c, ["sample_id", "child_id"]).select("sample_id", "tag", "parent", "parent_frame", "child", "child_frame", "exported")


@registered(f"""WITH {_L}, c AS (SELECT sample_id, tag, frame_index AS tau FROM l WHERE old IS NOT NULL AND old <> label)
SELECT sample_id, tag, 'attribute_changed' AS node_type, CAST(tau AS INT) AS frame_start, CAST(tau AS INT) AS frame_end, 1 AS n_parents, false AS is_tombstone FROM c
UNION ALL SELECT DISTINCT sample_id, tag, t, CAST(f0 AS INT), CAST(f0 AS INT), 0, false FROM l, (SELECT unnest(['entity_state', 'entity_appeared']) AS t)""")
def finished_nodes(spark, sf_dir):
    n = dag.finished(*_changes(spark, sf_dir))
    return n.select("sample_id", F.col("tags")[0].alias("tag"), "node_type", "frame_start", "frame_end", F.size("parent_ids").alias("n_parents"), "is_tombstone")


@registered(f"""WITH {_L} SELECT DISTINCT sample_id, CAST(f0 AS INT) AS tau_frame, 2 * count(DISTINCT entity_id) AS next_seq FROM l GROUP BY sample_id, f0""")
def next_clock(spark, sf_dir):
    """Where the clocks stand; a graph that goes on counts from there."""
    seen = _sights(spark, sf_dir)
    nodes = dag.clocked(dag.appeared_drafts(seen))
    more = dag.clocked(dag.state_drafts(seen), dag.next_seq(nodes))
    return dag.next_seq(nodes.unionByName(more)).select("sample_id", "tau_frame", F.col("next_seq").cast("long").alias("next_seq"))


@registered(f"""SELECT sample_id, p.tag AS parent, c.tag AS child FROM (SELECT DISTINCT CAST(t.frame AS VARCHAR) AS sample_id, t.tag FROM ({ORACLE_SQL["convert_frames"]}) t) p JOIN (SELECT DISTINCT CAST(t.frame AS VARCHAR) AS sample_id, t.tag FROM ({ORACLE_SQL["convert_frames"]}) t) c USING (sample_id) WHERE p.tag < c.tag""")
def layer_state_edges(spark, sf_dir):
    """Every tag of a region contains each later one, said twice: one edge each between their states."""
    objects = detector.convert(b.nation_frames(spark, sf_dir), ["frame"]).select(F.col("frame").cast("string").alias("sample_id"), F.explode("objects.tag").alias("tag")).distinct()
    nodes = objects.select("sample_id", F.lit("entity_state").alias("node_type"), F.concat_ws(":", "sample_id", "tag").alias("node_id"), F.array("tag").alias("tags"))
    pairs = objects.withColumnRenamed("tag", "parent_tag").join(objects.withColumnRenamed("tag", "child_tag"), "sample_id").filter("parent_tag < child_tag")
    tag = lambda c: F.substring_index(c, ":", -1)
    return dag.layer_edges(nodes, pairs.unionByName(pairs)).select("sample_id", tag("parent_id").alias("parent"), tag("child_id").alias("child"))


# ---- long paths: each user's events are a chain


def _chain(spark, sf_dir, steps):
    e = b.table(spark, sf_dir, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    far = e.select("user_id", F.explode(F.array(*map(F.lit, steps))).alias("d"), "n").select("user_id", F.col("n").alias("p"), (F.col("n") + F.col("d")).alias("n"))
    name = lambda c: F.concat_ws(":", "user_id", c)
    return far.join(e, ["user_id", "n"]).select(F.col("user_id").cast("string").alias("sample_id"), name("p").alias("parent_id"), name("n").alias("child_id")), e


_C = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), m AS (SELECT user_id, max(n) AS m FROM e GROUP BY ALL)"


@registered(f"WITH {_C} SELECT CAST(user_id AS VARCHAR) AS sample_id, user_id || ':' || n AS node_id, CAST(m - n AS INT) AS depth FROM e JOIN m USING (user_id) WHERE m - n <= 40")
def deep_closure(spark, sf_dir):
    edges, e = _chain(spark, sf_dir, [1])
    last = e.groupBy("user_id").agg(F.max("n").alias("n"))
    return search.closure(last.select(F.col("user_id").alias("query_id"), F.col("user_id").cast("string").alias("sample_id"), F.concat_ws(":", "user_id", "n").alias("node_id")), edges, 40).select("sample_id", "node_id", "depth")


@registered(f"WITH {_C} SELECT CAST(user_id AS VARCHAR) AS sample_id, user_id || ':' || n AS parent_id, user_id || ':' || (n + 1) AS child_id FROM e JOIN m USING (user_id) WHERE n < m")
def deep_reduction(spark, sf_dir):
    """Edges over 35 events go, as 35 edges lead the same way."""
    return dag.reduced(_chain(spark, sf_dir, [1, 35])[0], ["sample_id"])


@registered(f"WITH {_C} SELECT user_id || ':' || a AS source, user_id || ':' || z AS target, a <= z AS found FROM (SELECT user_id, 1 AS a, m AS z FROM m UNION SELECT user_id, m, 1 FROM m)")
def deep_path(spark, sf_dir):
    edges, e = _chain(spark, sf_dir, [1, 2])
    ends = e.groupBy("user_id").agg(F.max("n").alias("m")).select("user_id", F.lit(1).alias("a"), F.col("m").alias("z"))
    both = ends.unionByName(ends.select("user_id", F.col("z").alias("a"), F.col("a").alias("z"))).distinct()
    pairs = both.select(F.col("user_id").cast("string").alias("sample_id"), F.concat_ws(":", "user_id", "a").alias("source"), F.concat_ws(":", "user_id", "z").alias("target"))
    return dag.path_exists(edges, pairs, None, ["sample_id"]).select("source", "target", "found")


# ---- tracking


@registered("""WITH k AS (SELECT user_id, CAST(day(ts) - 1 AS INT) AS f, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) >= 50 AS high FROM events), days AS (SELECT DISTINCT f FROM k), users AS (SELECT DISTINCT user_id FROM k), d AS (SELECT DISTINCT user_id, f, high FROM k),
i AS (SELECT *, f - row_number() OVER (PARTITION BY user_id, high ORDER BY f) AS island FROM d), x AS (SELECT user_id, high, island, min(f) AS f0, max(f) AS f1 FROM i GROUP BY ALL),
n AS (SELECT *, printf('entity_%04d', row_number() OVER (PARTITION BY user_id ORDER BY f0, high)) AS entity_id FROM x)
SELECT CAST(user_id AS VARCHAR) AS sample_id, f AS frame_index, entity_id, CASE WHEN f = f0 THEN 'new' ELSE 'matched' END AS status, CASE WHEN f = f0 THEN NULL ELSE CAST(1 AS DOUBLE) END AS score, 0 AS missed_frames FROM i JOIN n USING (user_id, high, island)
UNION ALL SELECT CAST(user_id AS VARCHAR), f, entity_id, 'disappeared', NULL, 1 FROM n JOIN (SELECT min(f) AS f, g FROM (SELECT a.f, b.f AS g FROM days a JOIN days b ON a.f = b.f + 1) GROUP BY g) nx ON nx.g = n.f1""")
def track_islands(spark, sf_dir):
    """A sample for each user with two places, low and high; a thing is there on the days with such an event, and one that comes back is new."""
    k = b.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample_id"), (F.dayofmonth("ts") - 1).cast("int").alias("frame_index"), (F.get_json_object("props", "$.k").cast("int") >= 50).alias("high"))
    lo, hi = k.agg(F.min("frame_index"), F.max("frame_index")).first()
    frames = k.select("sample_id").distinct().withColumn("frame_index", F.explode(F.sequence(F.lit(lo), F.lit(hi))))  # days without a thing are empty frames
    at = F.when(F.col("high"), 200.0).otherwise(0.0)
    d = k.distinct().select("sample_id", "frame_index", F.col("high").cast("int").alias("ord"), F.when(F.col("high"), "dog").otherwise("cat").alias("tag"), F.when(F.col("high"), "dog").otherwise("cat").alias("label"), F.array(at, at, at + 9, at + 9).alias("bbox"), F.lit(1.0).alias("score"))
    return tracker.associate(frames, d).select("sample_id", "frame_index", "entity_id", "status", F.round("score", 4).alias("score"), "missed_frames")


@registered(f"""WITH {_L}, g AS (SELECT *, lag(x1) OVER w AS px, lag(frame_index) OVER w AS pf FROM l WINDOW w AS (PARTITION BY sample_id, entity_id ORDER BY frame_index)) SELECT sample_id, CAST(entity_id AS VARCHAR) AS entity_id, CAST(pf AS INT) AS before, CAST(frame_index AS INT) AS after, round(px, 4) AS x_before, round(x1, 4) AS x_after FROM g WHERE pf IS NOT NULL""")
def match_frames(spark, sf_dir):
    seen = _sights(spark, sf_dir)
    told = seen.select("sample_id", "frame_index", "ord", "entity_id", "status", "arrival", F.lit(1.0).alias("score"), F.lit(1.0).alias("iou"), F.lit(1.0).alias("label_similarity"))
    m = tracker.match_debug(told, seen.select("sample_id", "frame_index", "ord", "score", *[c for c in tracker.SIGHT if c != "detection_score"]))
    f = F.col("frames")
    return m.select("sample_id", "entity_id", f[0]["frame_index"].alias("before"), f[1]["frame_index"].alias("after"), r4(f[0]["bbox"][0]).alias("x_before"), r4(f[1]["bbox"][0]).alias("x_after"))


@registered(f"""WITH {_L} SELECT sample_id, CAST(max(frame_index) AS INT) AS last_frame FROM l GROUP BY sample_id""")
def last_frames(spark, sf_dir):
    return tracker.last_frames(b.registry(spark, sf_dir)).select("sample_id", F.col("last_frame").cast("int").alias("last_frame"))


# ---- scene graphs with faults and odd forms


@registered("""SELECT user_id, CAST(event_id AS INT) AS frame_index, 0 AS ord, CASE event_id % 6 WHEN 1 THEN 'missing required field ''tag''' WHEN 2 THEN 'invalid bbox ordering; expected x2>=x1 and y2>=y1' WHEN 3 THEN 'field ''score'' must be numeric if provided' WHEN 4 THEN 'field ''bbox'' must be a list/tuple of length 4' WHEN 5 THEN 'missing required field ''label''' END AS fault FROM events WHERE event_id % 6 <> 0""")
def scene_faults(spark, sf_dir):
    kind, text, box = F.col("event_id") % 6, F.col("event_type"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    item = F.struct(F.when(kind != 1, text).alias("tag"), F.when(kind != 5, text).alias("label"), F.when(kind == 2, F.array(F.lit(5.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).when(kind == 4, F.slice(box, 1, 3)).otherwise(box).alias("bbox"), F.when(kind == 3, "high").otherwise("0.5").alias("score"))
    rows = b.table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("event_id").alias("frame_index"), F.array(item).alias("objects"))).alias("frames"))).alias("payload"))
    return scene_graph.detections(scene_graph.frames_of(rows, ["user_id"]), ["user_id"])[1].select("user_id", "frame_index", "ord", "fault")


@registered("""SELECT user_id, CAST(event_id AS INT) AS frame_index, CASE event_id % 4 WHEN 0 THEN 'near->ball' WHEN 1 THEN 'runs->unknown' WHEN 2 THEN 'under->' || event_type ELSE 'holds->none' END AS relations, CASE event_id % 4 WHEN 0 THEN 'x>hat' WHEN 1 THEN 'm2>shoe' ELSE '' END AS layers, CASE event_id % 4 WHEN 0 THEN 'tall' WHEN 1 THEN 'big|red' ELSE '' END AS attributes, CAST(1 AS DOUBLE) AS score FROM events""")
def scene_forms(spark, sf_dir):
    """Payloads that are bare lists, names under their other fields, and every form of relations, attributes and layer mappings."""
    head = F.concat(F.lit('{"frame_index":'), F.col("event_id").cast("string"), F.lit(',"objects":[{"name":" X ","category":"L","box":[0,0,"1",1]'))
    rest = (
        F.when(F.col("event_id") % 4 == 0, F.lit(',"relations":[["Near","Ball"]],"layer_mapping":["Hat"],"attributes":"Tall"')).when(F.col("event_id") % 4 == 1, F.lit(',"relations":["runs"],"layer_mapping":{"Shoe":"M2"},"attributes":["Red","big","red"]'))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit(',"object_relations":[{"predicate":"Under","subject_tag":"'), F.col("event_type"), F.lit('"}]'))).otherwise(F.lit(',"relations":[{"predicate":"holds"},{"name":"HOLDS"}]'))
    )
    frames = b.table(spark, sf_dir, "events").withColumn("frame", F.concat(head, rest, F.lit("}]}")))
    rows = frames.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("frame"), ","), F.lit("]")).alias("payload"))
    good, _ = scene_graph.detections(scene_graph.frames_of(rows, ["user_id"]), ["user_id"])
    shown = lambda c, x, y, sep: F.array_join(F.transform(c, lambda r: F.concat(r[x], F.lit(sep), r[y])), "|")
    return good.select("user_id", "frame_index", shown("relations", "name", "object", "->").alias("relations"), shown("layer_mappings", "parent_tag", "child_tag", ">").alias("layers"), F.array_join("attributes", "|").alias("attributes"), "score")


# ---- stores


def _root(spark):
    return f"{shared_dir(spark)}/framesift/store-{uuid.uuid4().hex}"


_N = "n AS (SELECT CAST(conv_id % 4 AS VARCHAR) AS sample_id, conv_id || ':' || turn AS node_id, turn, role, coalesce(text, '') AS content FROM conversations)"


@registered(f"""WITH {_N} SELECT sample_id, node_id, CASE WHEN turn = 3 THEN 'patched' ELSE role END AS node_type, sha256(CASE WHEN turn = 0 THEN 'x' || content WHEN turn = 2 THEN 'new' ELSE content END) AS content, node_id = '1:1' AS is_tombstone FROM n""")
def node_store(spark, sf_dir):
    """Nodes are saved, loaded, given new content, replaced, patched and buried."""
    root = _root(spark)
    rows = b.turns(spark, sf_dir).withColumn("sample_id", (F.col("sample_id").cast("long") % 4).cast("string"))
    tables.save(rows, root, "dag_nodes")
    nodes = tables.load(spark, root, "dag_nodes").select(*rows.columns)
    at = lambda n: nodes.filter(F.col("tau_frame") == n)
    nodes = tables.set_content(nodes, at(0).select("sample_id", "node_id", F.concat(F.lit("x"), "content").alias("new_content")))
    nodes = tables.upsert(nodes, at(2).withColumn("content", F.lit("new")).select(*nodes.columns))
    nodes = tables.bury(tables.patch(nodes, at(3).select("sample_id", "node_id", F.lit("patched").alias("node_type"))), ["1:1"])
    return nodes.select("sample_id", "node_id", "node_type", F.sha2(F.col("content").cast("binary"), 256).alias("content"), "is_tombstone")


@registered(f"""WITH {_N} SELECT 'live' AS kind, node_id FROM n WHERE node_id <> '1:1' UNION ALL SELECT 'user', node_id FROM n WHERE role = 'user' AND node_id <> '1:1' AND sample_id = '1' UNION ALL SELECT 'node', node_id FROM n WHERE node_id = '2:1'""")
def node_lookups(spark, sf_dir):
    nodes = tables.bury(b.turns(spark, sf_dir).withColumn("sample_id", (F.col("sample_id").cast("long") % 4).cast("string")), ["1:1"])
    parts = {"live": tables.live_nodes(nodes), "user": tables.of_type(nodes, "user", "1"), "node": tables.node(nodes, "2", "2:1")}
    live, user, one = (df.select(F.lit(k).alias("kind"), "node_id") for k, df in parts.items())
    return live.unionByName(user).unionByName(one)


@registered("""WITH t AS (SELECT conv_id, turn FROM conversations), m AS (SELECT conv_id, max(turn) AS m FROM t GROUP BY ALL), e AS (SELECT a.conv_id, a.turn AS p, b.turn AS c FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn IN (a.turn + 1, a.turn + 2))
SELECT CAST(conv_id AS VARCHAR) AS sample_id, conv_id || ':' || p AS parent_id, conv_id || ':' || c AS child_id FROM e JOIN m USING (conv_id) WHERE c < m UNION SELECT CAST(conv_id AS VARCHAR), conv_id || ':0', conv_id || ':0' FROM m WHERE m > 0""")
def edge_store(spark, sf_dir):
    e = b.turn_edges(spark, sf_dir)
    loops = b.last_turns(spark, sf_dir).select("sample_id", F.concat_ws(":", "sample_id", F.lit("0")).alias("parent_id"), F.concat_ws(":", "sample_id", F.lit("0")).alias("child_id"), F.col("node_id").alias("last"))
    more = loops.filter("last <> child_id").drop("last")
    gone = b.last_turns(spark, sf_dir).select("sample_id", F.col("node_id").alias("child_id"))
    return tables.drop_edges(tables.add_edges(tables.add_edges(e, more), e), gone)


_M = _D + ", k AS (SELECT sample_id, CASE WHEN entity_id % 2 = 0 THEN 'events' ELSE 'entities' END AS key, entity_id, frame_index FROM d), n AS (SELECT *, printf('%s_%06d', key, row_number() OVER (PARTITION BY sample_id, key ORDER BY frame_index, entity_id) - 1) AS memory_id FROM k)"


@registered(f"""WITH {_M} SELECT 'all' AS kind, sample_id, key, memory_id, CASE WHEN sample_id = '1' THEN 'again' ELSE '' END AS content FROM n WHERE sample_id <> '2' UNION ALL SELECT 'one', sample_id, key, memory_id, '' FROM n WHERE sample_id = '0' AND key = 'events' UNION ALL SELECT DISTINCT 'key', sample_id, key, '', '' FROM n WHERE sample_id = '0'""")
def memory_store(spark, sf_dir):
    """Memories are saved by sample; one sample is saved anew, one is cleared, and the rest is read whole, by sample and key, and as keys."""
    root = _root(spark)
    d = b.detections(spark, sf_dir)
    rows = events.numbered(d.select("sample_id", F.when(F.col("entity_id") % 2 == 0, "events").otherwise("entities").alias("key"), F.struct("frame_index", "entity_id").alias("rank"), F.lit("").alias("content"))).drop("rank")
    tables.save(rows, root, "memories")
    tables.save(rows.filter("sample_id = '1'").withColumn("content", F.lit("again")), root, "memories")
    tables.clear(spark, root, "2", ["memories"])
    load = lambda **k: tables.load(spark, root, "memories", **k)
    shown = lambda kind, df: df.select(F.lit(kind).alias("kind"), "sample_id", F.col("key").cast("string").alias("key"), "memory_id", F.coalesce("content", F.lit("")).alias("content"))
    keys = tables.keys_of(load(), "0").select(F.lit("key").alias("kind"), F.lit("0").alias("sample_id"), F.col("key").cast("string").alias("key"), F.lit("").alias("memory_id"), F.lit("").alias("content"))
    return shown("all", load()).unionByName(shown("one", load(sample_id="0", key="events"))).unionByName(keys)


@registered(f"""WITH {_D}, u AS (SELECT sample_id, entity_id, tag, arg_max(label, frame_index) AS label, min(frame_index) AS f0, max(frame_index) AS f1 FROM d GROUP BY ALL)
SELECT sample_id, printf('entity_%04d', entity_id) AS id, 'entity' AS node_type, tag, label, CAST(f0 AS BIGINT) AS frame_start, CAST(f1 AS BIGINT) AS frame_end FROM u
UNION ALL SELECT sample_id, NULL, 'dag_node', tag, kind, CAST(f0 AS BIGINT), CAST(f0 AS BIGINT) FROM u, (SELECT unnest(['entity_state', 'entity_appeared']) AS kind)""")
def graph_rows(spark, sf_dir):
    """The exported graph's nodes, through JSON and back."""
    reg, seen = b.registry(spark, sf_dir), _sights(spark, sf_dir)
    drafts = dag.clocked(dag.state_drafts(seen).unionByName(dag.appeared_drafts(seen)))
    root = _root(spark)
    tables.export_json(dag.graph_nodes(reg, dag.finished(drafts, dag.candidate_edges(drafts))), f"{root}/graph")
    n = spark.read.schema("sample_id string, id string, node_type string, dag_node_type string, label string, tag string, frame_start long, frame_end long, metadata string").json(f"{root}/graph")
    entity = F.col("node_type") == "entity"
    return n.select("sample_id", F.when(entity, F.col("id")).alias("id"), "node_type", F.when(entity, F.col("tag")).otherwise(F.get_json_object("metadata", "$.entity_tag")).alias("tag"), F.when(entity, F.col("label")).otherwise(F.col("dag_node_type")).alias("label"), "frame_start", "frame_end")


@registered(f"""WITH {_D}, u AS (SELECT DISTINCT sample_id, entity_id, tag FROM d) SELECT sample_id, printf('entity_%04d', entity_id) AS source, 'entity_context' AS relation, tag AS entity_tag, count(*) AS n FROM u, (SELECT unnest([1, 2])) GROUP BY ALL""")
def graph_context(spark, sf_dir):
    reg, seen = b.registry(spark, sf_dir), _sights(spark, sf_dir)
    drafts = dag.clocked(dag.state_drafts(seen).unionByName(dag.appeared_drafts(seen)))
    e = dag.graph_edges(reg, dag.finished(drafts, dag.candidate_edges(drafts)))
    return e.groupBy("sample_id", "source", "relation", "entity_tag").agg(F.count("*").alias("n"))


# ---- retrieval


@registered("""WITH s AS (SELECT q.vec_id AS query_id, CAST(q.vec_id % 3 AS VARCHAR) AS sample_id, printf('%08d', e.vec_id) AS node_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings e ON e.vec_id % 3 = q.vec_id % 3 WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) SELECT query_id, sample_id, node_id, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM r WHERE rank <= 5 AND score >= 0""")
def retrieval_seeds(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 3).cast("string").alias("sample_id"), F.format_string("%08d", "vec_id").alias("node_id"), "embedding")
    asked = e.filter("query_id % 20 = 0").select("query_id", "sample_id", F.col("embedding").alias("query_vector"))
    return search.seeds(e.select("sample_id", "node_id", "embedding"), asked, 5).select("query_id", "sample_id", "node_id", "rank", r4("score").alias("score"))


@registered("""WITH m AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY ALL) SELECT c.conv_id AS query_id, c.conv_id || ':' || c.turn AS node_id, CAST(ceil((m - turn) / 2.0) AS INT) AS depth, turn = m AS is_seed, CASE WHEN turn = m THEN 0.5 ELSE 0 END::DOUBLE AS score, sha256(coalesce(text, '')) AS content FROM conversations c JOIN m USING (conv_id) WHERE ceil((m - turn) / 2.0) <= 2""")
def structured_closure(spark, sf_dir):
    found = b.last_turns(spark, sf_dir).withColumn("score", F.lit(0.5))
    rows = search.structured(found, b.turn_edges(spark, sf_dir), b.turns(spark, sf_dir), 2)
    return rows.select("query_id", "node_id", "depth", "is_seed", "score", F.sha2(F.col("content").cast("binary"), 256).alias("content"))


@registered("""WITH m AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY ALL) SELECT c.conv_id, sha256(string_agg('[' || role || '|τ=τ(' || turn || ', 0)] ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS context, count(*) AS closure_size FROM conversations c JOIN m USING (conv_id) WHERE ceil((m - turn) / 2.0) <= 2 GROUP BY c.conv_id""")
def closure_text(spark, sf_dir):
    members = search.closure(b.last_turns(spark, sf_dir), b.turn_edges(spark, sf_dir), 2)
    rows = search.in_order(members, b.turns(spark, sf_dir))
    size = members.groupBy("query_id").agg(F.count("*").alias("closure_size"))
    text = search.linear_text(rows, ["query_id"], None, with_type=True)
    return text.join(size, "query_id").select(F.col("query_id").alias("conv_id"), F.sha2(F.col("context").cast("binary"), 256).alias("context"), "closure_size")


@registered("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'no json {here' ELSE event_type END AS answer, event_id % 3 = 0 AS sufficient, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS used, event_id % 3 = 2 AS raw FROM events""")
def replies(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("answer"), F.lit(True).alias("sufficient_evidence"), F.array(F.col("user_id").cast("string")).alias("used_event_ids")))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), F.to_json(F.struct(F.col("event_type").alias("answer"))), F.lit(" bye"))).otherwise(" no json {here ")
    r = b.table(spark, sf_dir, "events").select("event_id", evidence.reply_fields(said).alias("r"))
    return r.select("event_id", "r.answer", F.col("r.sufficient_evidence").alias("sufficient"), F.array_join("r.used_event_ids", ",").alias("used"), (F.col("r.short_rationale") == evidence.NO_JSON).alias("raw"))


@registered("""WITH q AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations), s AS (SELECT conv_id, m, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role <> 'user') AS o, min(turn) FILTER (role <> 'user') AS f FROM q GROUP BY ALL)
SELECT conv_id, CAST(least(o, 3) AS INT) AS events, CAST(least(u, 2) AS INT) AS entities, 1 AS seeds, CAST(u + o AS INT) AS closure, CASE WHEN f IS NOT NULL THEN conv_id || ':' || f END AS first_event FROM s""")
def evidence_bundles(spark, sf_dir):
    nodes = b.turns(spark, sf_dir).withColumns({"node_type": F.when(F.col("node_type") == "user", "entity_state").otherwise(F.col("node_type")), "metadata": F.lit("{}"), "tags": F.array(F.col("node_type")), "frame_start": F.col("tau_frame"), "frame_end": F.col("tau_frame")})
    seeds = b.last_turns(spark, sf_dir).withColumn("score", F.lit(0.5))
    members = nodes.select(F.col("sample_id").cast("long").alias("query_id"), "sample_id", "node_id")
    reg = b.registry(spark, sf_dir).select("sample_id", "entity_id", "tag", "label")
    found, states = evidence.split(evidence.scored_members(search.in_order(members, nodes), seeds), reg, 3, 2)
    stats = members.groupBy("query_id", "sample_id").agg(F.count("*").alias("closure_size"), F.count_if(F.lit(False)).alias("none")).withColumn("num_seeds", F.lit(1)).drop("none")
    asked = seeds.select("query_id", "sample_id", F.lit("What happened first?").alias("query"))
    out = evidence.bundles(query.parse(asked, reg), found, states, reg, stats)
    at = lambda p, kind="int": F.get_json_object("bundle", f"$.{p}").cast(kind)
    return out.select(F.col("query_id").alias("conv_id"), at("summary_stats.num_event_evidence").alias("events"), at("summary_stats.num_entity_evidence").alias("entities"), at("closure_stats.num_seeds").alias("seeds"), at("closure_stats.closure_size").alias("closure"), at("events[0].memory_id", "string").alias("first_event"))


@registered("""SELECT event_id, array_to_string(list_sort(list_distinct(['user' || user_id, 'user', event_type] || string_split(event_type, '_'))), ',') AS tokens FROM events""")
def memory_tokens(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("event_id", "event_type", F.array(F.concat(F.lit("User"), F.col("user_id").cast("string"))).alias("entity_tags"))
    whole = F.array_union(search.memory_tokens(rows, ["event_type"], ["entity_tags"]), F.array("event_type"))  # the type as it stands, whether or not it is one token
    return rows.select("event_id", F.array_join(F.array_sort(whole), ",").alias("tokens"))
