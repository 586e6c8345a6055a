"""The best of many vectors against sums in order, and what questions name against plain sets."""

import random

import pytest

from framesift.operators import query, search


@pytest.mark.parametrize("by", [[], ["sample_id"]])
def test_top_k_is_exact(spark, monkeypatch, by):
    """Copies, near ties, nulls, short vectors; queries in several blocks."""
    monkeypatch.setattr(search, "MOST_QUERIES", 10)
    monkeypatch.setattr(search, "_BLOCK", 3)
    rnd = random.Random(8)
    some = [[float(rnd.choice([0.1, 0.2, 0.3, -0.7])) for _ in range(5)] for _ in range(12)]
    rows = [(i, rnd.choice("ab"), rnd.choice([*some, *some, None, [1.0], [0.1, None, 0.2, 0.3, 0.4]])) for i in range(400)]
    asked = [(100 + i, rnd.choice("ab"), some[i % 12]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, sample_id string, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id long, sample_id string, query_vector array<double>")
    got = search.top_k(vectors if by else vectors.drop("sample_id"), queries if by else queries.drop("sample_id"), 8, "vec_id", by, 0.01)
    want = []
    for q, s, v in asked:
        scored = []
        for i, t, w in rows:
            if w and len(w) == 5 and None not in w and (not by or s == t):
                total = 0.0
                for x, y in zip(w, v, strict=True):
                    total += x * y
                scored.append((-total, i))
        want += [(q, i, n + 1, -t) for n, (t, i) in enumerate(sorted(scored)[:8]) if -t >= 0.01]
    assert sorted((r["query_id"], r["vec_id"], r["rank"], r["score"]) for r in got.collect()) == sorted(want)


def test_pairs_are_not_rows(spark):
    e = spark.range(50).selectExpr("id as vec_id", "array(1.0D, id * 1.0D) as embedding")
    found = search.top_k(e, e.selectExpr("vec_id as query_id", "embedding as query_vector"), 3, "vec_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 150


def test_questions_that_name_the_same_share_a_set(spark):
    tags = [("s", f"e{i}", t, lab) for i, (t, lab) in enumerate([("man1", "man"), ("man2", "man"), ("red_car1", "car"), ("car7", "red car"), ("dog", ""), ("man1", "old man"), ("x9", "y z")])] + [("t", "e0", "man1", "man")]
    said = ["man1 and man3", "man2", "the car", "red", "a dog, a car7 and x", "y and z", "nobody", "red car man2 dog"]
    asked = [(i, "s", t) for i, t in enumerate(said)] + [(20, "t", "man1?"), (21, "t", "car")]
    sizes = []
    got = query.parse(spark.createDataFrame(asked, "query_id int, sample_id string, query string"), spark.createDataFrame(tags, "sample_id string, entity_id string, tag string, label string"), lambda sets: sizes.append(sets.count()) or sets)
    toks = lambda x: {y for w in x.lower().replace("_", " ").replace("?", "").replace(",", "").split() for y in (w, w.rstrip("0123456789")) if y}
    want = {}
    for q, s, text in asked:
        mine = [(e, t, lab) for u, e, t, lab in tags if u == s and toks(t) & toks(text)]
        spoken = {lab for u, _, _, lab in tags if u == s and lab and toks(lab) <= toks(text)}
        want[q] = (sorted({e for e, _, _ in mine}), sorted({t for _, t, _ in mine}), sorted({lab for _, _, lab in mine if lab} | spoken))
    assert {r["query_id"]: (r["entity_ids"], r["entity_tags"], r["entity_labels"]) for r in got.collect()} == want
    assert sizes[0] < len([w for w in want.values() if w[0]])
