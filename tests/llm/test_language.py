"""What language identification learns from."""

import random

from pyspark.sql import functions as F

from framesift.llm import lang_id


def test_training_text_is_from_all_over(spark):
    # each document opens with the same page head; what tells the languages apart comes after 1500 characters
    rnd = random.Random(2)
    head = " ".join(rnd.choice(["home", "login", "menu", "search"]) for _ in range(400))
    say = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    words = {"aa": ["der", "hund", "lief", "nach", "haus"], "bb": ["el", "perro", "corre", "casa"]}
    rows = [(i, f"{head} {say(words[x], 600)}", x) for i, x in enumerate(["aa", "bb"] * 100)]
    docs = spark.createDataFrame(rows + [(900, "", "aa"), (901, None, "bb")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, say(words["aa"], 30)), (2, say(words["bb"], 30))], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.predict(asked, lang_id.learn(docs)).collect()}
    assert got == {1: "aa", 2: "bb"}
    n = sum(-(-len(t) // lang_id.PIECE) for _, t, x in rows if x == "aa")
    drawn = lang_id.sample(docs.filter("lang = 'aa' and text is not null"), {"aa": n})
    assert 60 < len(drawn) < 150 and all(len(t) <= lang_id.PIECE for _, _, t in drawn)
    few = docs.filter(F.col("doc_id") < 4)
    whole = lang_id.sample(few, {"aa": 1, "bb": 1})
    assert sum(len(t) for _, _, t in whole) == sum(len(t) for i, t, _ in rows if i < 4)


def test_scripts_beyond_the_frequent_letters(spark):
    # Chinese, Japanese and Korean against much Latin text: each has letters of its own, whatever their share
    rnd = random.Random(5)
    signs = {"ja": range(0x3042, 0x3080), "ko": range(0xAC00, 0xAE00), "zh": range(0x4E00, 0x5000), "xg": range(0x30000, 0x30100), "el": range(0x3B1, 0x3C9), "ru": range(0x430, 0x450)}
    say = lambda x, n: " ".join("".join(rnd.choice(own) for _ in range(3)) for _ in range(n))
    own = [chr(c) for c in range(97, 123)]
    rows = [(i, say("en", 400), "en") for i in range(60)]
    asked = []
    for k, (lang, span) in enumerate(signs.items()):
        own = [chr(c) for c in span]
        rows += [(1000 + 10 * k + j, say(lang, 30), lang) for j in range(5)]
        asked.append((k, rows[-1][1][:60], lang))
    model = lang_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = lang_id.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model, keep=["lang"]).collect()
    assert len(got) == len(signs) and all(r["lang_pred"] == r["lang"] and r["score"] > 0.3 for r in got)
