"""Column functions against hand-made values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framesift.config import Embedding
from framesift.functions import embedding, geometry, relations, text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict(recursive=True)


def box(*v):
    return F.array(*(F.lit(float(x)) for x in v))


def point(x, y):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))


def test_iou_and_area(spark):
    got = one(spark, half=geometry.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)), none=geometry.iou(box(1, 1, 1, 1), box(1, 1, 1, 1)), flat=geometry.area(box(5, 0, 1, 3)), same=geometry.iou(box(0, 0, 2, 2), box(0, 0, 2, 2)))
    assert got["half"] == pytest.approx(50 / 150) and got["none"] == 0.0 and got["flat"] == 0.0 and got["same"] == 1.0


def test_directions(spark):
    o = point(0, 0)
    ends = {"right": (5, 0), "up-right": (5, -5), "up": (0, -5), "up-left": (-5, -5), "left": (-5, 0), "down-left": (-5, 5), "down": (0, 5), "down-right": (5, 5), "stationary": (0.5, 0.5)}
    got = one(spark, **{n.replace("-", "_"): geometry.compass(o, point(*p)) for n, p in ends.items()})
    assert got == {n.replace("-", "_"): n for n in ends}
    got = one(spark, still=geometry.direction(o, o), turn=geometry.angle_difference(F.lit(350.0), F.lit(10.0)), box=geometry.compact(box(2.5, 3.5, 1.2, 9.9)))
    assert got == {"still": 0.0, "turn": 20.0, "box": "[2, 4, 1, 10]"}


@pytest.mark.parametrize(("dx", "dy", "turns", "mode"), [(12, 0, 0, "stationary"), (20, 20, 1, "direction_change"), (0, -40, 0, "jumping_up"), (0, -20, 0, "moving_up"), (40, 0, 0, "moving_right"), (-40, 3, 0, "moving_left"), (3, 40, 0, "moving_down")])
def test_modes(spark, dx, dy, turns, mode):
    assert one(spark, m=geometry.motion_mode(F.lit(float(dx)), F.lit(float(dy)), F.lit(turns)))["m"] == mode


def test_text(spark):
    got = one(
        spark, a=F.array_sort(text.concept_tokens(F.lit("Man3_left/arm"))), n=text.normalize(F.lit("  A \t b\n")), none=text.or_none(F.lit(None).cast("string")), d=text.decompose(F.lit("A and B? a")), e=text.decompose(F.lit("  ")), zh=text.decompose(F.lit("人和球")),
        cjk=text.tokens(F.lit("man1发生了什么")), j=text.json_object(F.lit('Sure: {"answer":"x"}')), nj=text.json_object(F.lit("no {json")), f=text.frame_number(F.lit(None), F.lit("a7/img_012.v2.jpg"), F.lit(3)), p=text.frame_number(F.lit(None), F.lit("a7/img.jpg"), F.lit(3)),
    )
    assert got == {"a": ["arm", "left", "man", "man3"], "n": "a b", "none": "none", "d": ["A", "B"], "e": [], "zh": ["人", "球"], "cjk": ["man1发生了什么"], "j": '{"answer":"x"}', "nj": None, "f": 12, "p": 3}


def test_relations(spark):
    pair = lambda n, o: F.struct(F.lit(n).alias("name"), F.lit(o).alias("object"))
    a, b = F.array(pair("Near", "Ball"), pair("", "x")), F.array(pair("holds", "cup"))
    got = one(spark, p=relations.pairs(a), plus=relations.added(relations.pairs(a), relations.pairs(b)), minus=relations.removed(relations.pairs(a), relations.pairs(b)), attrs=relations.attributes(F.array(F.lit(" Red"), F.lit("red"), F.lit(""))))
    assert got == {"p": [{"name": "near", "object": "ball"}], "plus": [{"name": "holds", "object": "cup"}], "minus": [{"name": "near", "object": "ball"}], "attrs": ["red"]}


def test_hash_embedding(spark):
    rows = spark.createDataFrame([(1, "a red ball"), (2, ""), (3, None), (4, "a red ball")], "i int, t string")
    got = {r["i"]: r["embedding"] for r in embedding.with_embeddings(rows, "t", Embedding(dim=32)).collect()}
    assert got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and not any(got[2]) and not any(got[3])
    assert embedding.hashed(["a"], 16, False).any() and (embedding.hashed(["Ball ball"], 16) == embedding.hashed(["ball"], 16)).all()


boxes = st.tuples(*[st.integers(0, 20)] * 4).map(lambda b: [float(b[0]), float(b[1]), float(b[0] + b[2]), float(b[1] + b[3])])


@settings(max_examples=60, deadline=None)
@given(st.lists(boxes, min_size=1, max_size=4), st.lists(boxes, min_size=1, max_size=4))
def test_iou_matrix_is_symmetric_and_bounded(a, b):
    import numpy as np

    from framesift.operators.tracker import iou_matrix

    m, t = iou_matrix(np.array(a), np.array(b)), iou_matrix(np.array(b), np.array(a))
    assert np.allclose(m, t.T) and (m >= 0).all() and (m <= 1).all()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_one_to_one_and_best(n, m, rnd):
    import itertools

    import numpy as np

    from framesift.operators.tracker import assign

    score = np.array([[rnd.choice([0.0, 0.25, 0.5, rnd.random()]) for _ in range(m)] for _ in range(n)])
    got = assign(score)
    assert len(got) == min(n, m) == len({r for r, _ in got}) == len({c for _, c in got})
    best = max(sum(score[r, c] for r, c in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
    assert sum(score[r, c] for r, c in got) == pytest.approx(best)
