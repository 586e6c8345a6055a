"""Which documents the quality classifier learns from, and its thresholds."""

import random

from framesift.llm import kn_quality


def corpus(spark, sizes):
    rnd = random.Random(9)
    rows, words = [], {x: ["".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(30)] for x in sizes}
    for lang, n in sizes.items():
        rows += [(len(rows) + i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.choice([15, 120]))), lang) for i in range(n)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in rows], "doc_id long, quality int, toxic int")
    return words, rows, spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels


def test_all_trusted_documents_count(spark, monkeypatch):
    words, rows, docs, labels = corpus(spark, {"big": 600, "small": 40})
    whole = kn_quality.learn(docs, labels)
    monkeypatch.setattr(kn_quality, "MOST_TRUSTED", 100, raising=False)
    monkeypatch.setattr(kn_quality, "MOST_SENT", 100, raising=False)
    assert kn_quality.trusted_ids(labels).count() == len(rows)
    model = kn_quality.learn(docs, labels)
    assert model.limits == whole.limits and set(model.limits) == {"big", "small", None} and (model.bits == whole.bits).all()


def test_thresholds_are_quantiles_by_length(spark):
    # at most one in a hundred of a band's trusted documents is above its threshold, and one of them is at it: nothing is added
    words, rows, docs, labels = corpus(spark, {"aa": 700, "bb": 30})
    got = {}
    for r in kn_quality.digest(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").collect():
        got.setdefault((r["lang"], round(r["threshold"], 9)), []).append(r)
    assert len({t for lang, t in got if lang == "aa"}) == 2 and len({t for lang, t in got if lang == "bb"}) == 1
    for (_, t), rs in got.items():
        lost = sum(not r["kept"] for r in rs)
        assert lost <= len(rs) // 100 and sorted(r["perplexity"] for r in rs)[-1 - lost] > t * 0.9998
        assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in rs)


def test_bands_join_until_they_have_enough(monkeypatch):
    monkeypatch.setattr(kn_quality, "BAND", 10)
    assert kn_quality.banded([0, 3, 9, 10, 4, 0, 7, 5, 0]) == [0, 0, 0, 1, 2, 2, 2, 2, 2]
    assert kn_quality.banded([2, 0]) == [0, 0]
