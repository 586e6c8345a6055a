"""The quality classifier's model leaves nothing out: neither small chances nor characters past the frequent ones."""

import functools
import math
import random
from collections import Counter

import numpy as np
import pytest

from framesift.llm import kn_quality
from tests.llm.test_models import plain_kn


def test_small_chances_are_not_cut():
    # after a context that was seen a thousand million times with one symbol, another is less likely than 2**-30
    split = lambda g: tuple(g >> 6 * k & 63 for k in (3, 2, 1, 0))
    number = lambda *s: sum(x << 6 * k for k, x in enumerate(reversed(s)))
    grams = {number(4, 5, 6, 7): 10**9, number(8, 5, 6, 7): 3 * 10**6, number(9, 10, 11, 12): 2, number(9, 10, 11, 13): 1, number(5, 6, 7, 4): 1}
    keys = np.array(sorted(grams))
    bits = kn_quality.bits_table(keys, np.array([grams[k] for k in keys.tolist()]))
    p = plain_kn({split(g): c for g, c in grams.items()}, 4, 64)
    rare = [number(4, 5, 6, s) for s in (8, 20, 63)]
    for g in [*keys.tolist(), *rare, number(8, 5, 6, 20), number(30, 31, 32, 33)]:
        assert bits[g] / kn_quality.STEPS == pytest.approx(-math.log2(p(split(g))), abs=2 / kn_quality.STEPS)
    assert max(bits[g] / kn_quality.STEPS for g in rare) > 33


SCRIPTS = {"aa": "abcdefghijklmnopqrst", "bb": "абвгдежзийклмнопрстуфх", "cc": "αβγδεζηθικλμνξοπρστυφχψω", "dd": "日本語文字学校先生時間人国年大小中上下左右東西南北", "ee": "😀😁𠀀𠀁" + chr(0x30000) + chr(0x30001)}


def scripts(spark):
    """Rows of five scripts, 90 characters in all; labels of trusted ones; docs."""
    rnd = random.Random(12)
    words = {x: ["".join(rnd.choice(own) for _ in range(rnd.randint(2, 5))) for _ in range(8)] for x, own in SCRIPTS.items()}
    rows = []
    for lang, n in {"aa": 24, "bb": 8, "cc": 8, "dd": 8, "ee": 4}.items():
        rows += [(len(rows) + i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.choice([6, 14]))).capitalize() + " 7", lang) for i in range(n)]
    trusted = list(rows)
    mixed = [(100 + i, "".join(rnd.sample(rows[d][1], len(rows[d][1]))), rows[d][2]) for i, d in enumerate((30, 35, 43, 47, 50))]
    rows += [*mixed, (200, "ўџ " + rows[30][1], "bb"), (201, None, "aa"), (202, "", "bb"), (203, rows[50][1], None), (204, rows[50][1], "ee"), (205, "§" + chr(0x10FFFF), "aa")]
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in trusted], "doc_id long, quality int, toxic int")
    return rows, trusted, labels, spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("most", [None, 0])
def test_every_character_of_the_trusted_text_counts(spark, monkeypatch, most):
    if most is not None:  # the way by joins
        monkeypatch.setattr(kn_quality, "MOST_GRAMS", most, raising=False)
    rows, trusted, labels, docs = scripts(spark)
    known = {c for _, t, _ in trusted for c in t}
    size = 4 + sum(not c.isupper() and not c.isdigit() for c in known)
    assert size > 64
    spelled = lambda text: ["B"] * 3 + ["U" if c.isupper() else "D" if c.isdigit() else f"[{c}]" if c in known else "R" for c in text]
    grams = lambda text: [tuple(s[i : i + 4]) for s in [spelled(text)] for i in range(len(s) - 3)]
    p = functools.cache(plain_kn(Counter(g for _, t, _ in trusted for g in grams(t)), 4, size))
    got = {r["doc_id"]: r for r in kn_quality.digest(docs, labels).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        if not t:
            assert got[d]["n_symbols"] == 0 and got[d]["perplexity"] is None and not got[d]["kept"]
            continue
        assert got[d]["n_symbols"] == len(t)
        assert math.log2(got[d]["perplexity"]) == pytest.approx(sum(-math.log2(p(g)) for g in grams(t)) / len(t), abs=5e-4)
    for i, d in enumerate((30, 35, 43, 47, 50)):  # the same characters in another order
        assert got[100 + i]["perplexity"] > 1.5 * got[d]["perplexity"] and not got[100 + i]["kept"]


def test_joined_levels_give_what_arrays_give(spark, monkeypatch):
    rows, _, labels, docs = scripts(spark)
    few = docs.filter("lang = 'aa'")  # without far n-grams
    arrays, plain = kn_quality.learn(docs, labels), kn_quality.learn(few, labels)
    told = sorted(map(str, kn_quality.judged(docs, arrays).collect()))
    monkeypatch.setattr(kn_quality, "MOST_GRAMS", 0)
    tables, bare = kn_quality.learn(docs, labels), kn_quality.learn(few, labels)
    assert tables.joined and not arrays.joined and not bare.joined and plain.levels is None
    assert (arrays.bits == tables.bits).all() and (plain.bits == bare.bits).all() and arrays.limits == tables.limits
    assert sorted(map(str, kn_quality.judged(docs, tables).collect())) == told
