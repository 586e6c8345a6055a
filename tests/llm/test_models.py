"""Class bigrams and Kneser-Ney against plain Python, and the pipeline's stages."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm import brown_lm, kn_quality, packing
from framesift.llm.common import doc_remainder, stored, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(ASCII)), None]


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    words = ["", "a", "b", "ab", "ba", "aaaaaaaa", "aaaaaaaab", "aaaaaaaaaaaaaaaa", "é", "\x00", "\x00\x00"]
    got = word_hashes(pa.array(words))
    assert len(set(got.tolist())) == len(words) and (got[3:6] == word_hashes(pa.array(words[3:6]))).all()


def corpus():
    rnd = random.Random(8)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    texts = [" ".join(rnd.choice(kinds[k % 3]) for k in range(rnd.randrange(0, 80))) for _ in range(60)]
    return list(enumerate(texts)) + [(100, None), (101, ""), (102, "New unseen WORDS x1"), (5, texts[5]), (None, "x1 y1"), (103, "x1 " * 3000)]


@pytest.mark.parametrize("most", [brown_lm.TOP, 9])
def test_class_scores(spark, documents, monkeypatch, most):
    """With few symbols of their own nearly all words get their classes from their contexts, in shards."""
    monkeypatch.setattr(brown_lm, "SHARD_BYTES", 2000)
    monkeypatch.setattr(brown_lm, "FAN", 2)
    rows = corpus()
    docs = documents(rows).repartition(5).select("doc_id", "text")
    out = doc_remainder(F.col("doc_id"), 7) == 2
    model, words = brown_lm.learn(docs, ~out, most)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in brown_lm.scored(docs, model, words, out).collect())
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    import pyarrow as pa

    given, taught = {}, Counter()
    for r in words.collect():
        given |= dict(zip(np.frombuffer(r["hashes"], np.uint64).tolist(), np.frombuffer(r["classes"], np.uint8).tolist(), strict=True))

    def start_of(t):
        if t is None:
            return model.of[brown_lm.END]
        w = pa.array([t])
        return model.of[brown_lm.symbols_of(word_hashes(w), brown_lm.suffix_of(w), model.top, model.number)[0]]

    def class_of(t):
        return start_of(None) if t is None else given.get(int(word_hashes(pa.array([t]))[0]), start_of(t))

    # every word that occurs twice and is no symbol of its own is where its contexts say
    left, right, pairs = defaultdict(Counter), defaultdict(Counter), Counter()
    for d, x in rows:
        if not held(d):
            own = [None, *tokens(x)]
            for a, b in zip(own, own[1:], strict=False):
                pairs[start_of(a), start_of(b)] += 1
                left[b][start_of(a)] += 1
                right[a][start_of(b)] += 1
    assert all(model.pairs[b, c] == n for (b, c), n in pairs.items()) and model.pairs.sum() == sum(pairs.values())
    log = lambda x: math.log(x + 0.5)
    row, col = model.pairs.sum(1) + 0.5 * brown_lm.CLASSES, model.pairs.sum(0) + 0.5 * brown_lm.CLASSES
    moved = 0
    for t, c in count.items():
        if t is None or c < 2 or int(word_hashes(pa.array([t]))[0]) in model.top.tolist():
            assert class_of(t) == start_of(t)
            continue
        old = start_of(t)

        def gain(k, t=t, c=c, old=old):
            if k != old:
                return sum(n * log(model.pairs[b, k]) for b, n in left[t].items()) + sum(n * log(model.pairs[k, b]) for b, n in right[t].items()) - c * (math.log(row[k]) + math.log(col[k]))
            without = lambda x, seen: np.maximum(x - np.array([seen[b] for b in range(brown_lm.CLASSES)]), 0) + 0.5
            into, out_ = without(model.pairs[:, k], left[t]), without(model.pairs[k], right[t])
            return sum(n * math.log(into[b]) for b, n in left[t].items()) + sum(n * math.log(out_[b]) for b, n in right[t].items()) - c * (math.log(into.sum()) + math.log(out_.sum()))

        best = max(gain(k) for k in range(brown_lm.CLASSES) if k != start_of(None))
        assert gain(class_of(t)) == pytest.approx(best, abs=1e-6)
        moved += class_of(t) != old
    assert most > 9 or moved > 20

    size, kinds = defaultdict(int), defaultdict(int)
    for t, c in count.items():
        size[class_of(t)] += c
        kinds[class_of(t)] += 1

    def score(text):
        total, before = 0.0, class_of(None)
        for t in tokens(text):
            c = class_of(t)
            total += model.moves[before, c]
            if size[c]:
                total += math.log10((count[t] - brown_lm.D if count[t] else brown_lm.D * kinds[c]) / size[c])
            before = c
        return total

    want = sorted((str(d), held(d), len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(x)), 6), round(score(x), 6)) for d, x in rows)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(g[6] == pytest.approx(w[6], abs=1e-4) for g, w in zip(got, want, strict=True))
    # a class's words and its unknown word make up the class; a class's followers too
    for c in {class_of(t) for t in count}:
        assert sum((k - brown_lm.D) / size[c] for t, k in count.items() if class_of(t) == c) + brown_lm.D * kinds[c] / size[c] == pytest.approx(1)
    assert np.allclose((10**model.moves).sum(axis=1), 1)
    assert all(model.size[c] == size[c] and model.kinds[c] == kinds[c] for c in range(brown_lm.CLASSES))
    # x, y and z words follow one another, so classes tell them apart and beat single words
    own = [g for g in got if g[2] > 20]
    assert sum(g[6] > g[5] for g in own) > 0.9 * len(own)


def test_exchange_raises_the_likelihood():
    rnd = np.random.default_rng(3)
    pairs = rnd.integers(0, 3, (40, 40)) * (np.add.outer(np.arange(40), np.arange(40)) % 4 == 1) * 5

    def likelihood(of):
        m = np.zeros((40, 6))
        m[np.arange(40), of] = 1
        t = m.T @ pairs @ m
        return brown_lm._f(t).sum() - brown_lm._f(t.sum(0)).sum() - brown_lm._f(t.sum(1)).sum()

    first = [likelihood(brown_lm.exchange(pairs, 6, r, fixed=0)) for r in (0, 1, 2, 6)]
    assert first == sorted(first) and first[-1] > first[0] and (brown_lm.exchange(pairs, 6, 6, fixed=0) == 0).sum() == 1


def test_class_scores_without_training(spark, documents):
    docs = documents([(1, "a b"), (2, None)]).select("doc_id", "text")
    got = brown_lm.digest(docs, F.lit(True)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)} and all(math.isfinite(r["score"]) for r in got)
    assert brown_lm.digest(docs.limit(0), F.lit(False)).count() == 0


# ---- Kneser-Ney


def plain_kn(grams, order, symbols):
    """p(symbol | context) of interpolated modified Kneser-Ney, straight from the definition."""
    counts = {order: Counter(grams)}
    for n in range(order - 1, 0, -1):
        longer = {g[-(n + 1) :] for g in grams}
        counts[n] = Counter(g[1:] for g in longer)
    cuts = {}
    for n, c in counts.items():
        of = Counter(c.values())
        k = [max(of[i], 0.5) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        cuts[n] = [0.0, *(min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.05), i - 0.02) for i in (1, 2, 3))]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / symbols
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total, d = sum(same.values()), cuts[n]
        c = counts[n][gram]
        return (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in same.values()) / total * p(gram[1:])

    return p


def test_kneser_ney_is_the_definition():
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcab ") for _ in range(400))
    table = np.full(0x30000, kn_quality.RARE, dtype=np.uint8)
    for i, c in enumerate("abc "):
        table[ord(c)] = kn_quality.FIRST + i
    code, off = kn_quality.codes_of([text, "", "ab"], table)
    assert off.tolist() == [0, 400, 400, 402]
    grams = Counter(code.tolist())
    keys = np.array(sorted(grams))
    bits = kn_quality.bits_table(keys, np.array([grams[k] for k in keys.tolist()]))
    split = lambda g: tuple(g >> 6 * k & 63 for k in (3, 2, 1, 0))
    p = plain_kn(Counter({split(g): c for g, c in grams.items()}), 4, 64)
    for g in [*rnd.sample(keys.tolist(), 30), *(rnd.randrange(64**4) for _ in range(30)), *(k ^ rnd.randrange(8) for k in keys[:30].tolist())]:
        assert bits[g] / kn_quality.STEPS == pytest.approx(-math.log2(p(split(g))), abs=2 / kn_quality.STEPS)
    row = 2.0 ** (-bits.reshape(-1, 64)[keys[::9] >> 6].astype(float) / kn_quality.STEPS)
    assert np.allclose(row.sum(axis=1), 1, atol=2e-2)


def test_quality_edges(spark, documents):
    rnd = random.Random(1)
    good = lambda n: " ".join(rnd.choice(["the", "cat", "sat", "on", "a", "mat", "and", "ran"]) for _ in range(n)).capitalize() + "."
    rows = [(i, good(60)) for i in range(40)] + [(100, "#$%& " * 60), (101, None), (102, ""), (103, good(4000)), (104, "QX!! ZK!! " * 50), (5, good(30)), (None, good(50))]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0), (7, 0, 0), (8, 1, 1), (9, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {}
    for r in kn_quality.digest(docs, labels).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(r["kept"] for d, rs in got.items() if d is None or d < 40 or d == 103 for r in rs)
    assert not any(got[d][0]["kept"] for d in (100, 101, 102, 104)) and got[101][0]["perplexity"] is None and got[103][0]["n_symbols"] == len(dict(rows)[103])
    left = kn_quality.good_documents(docs, labels)
    assert left.schema.names == docs.schema.names and left.count() == 43
    bare = kn_quality.good_documents(docs, labels.limit(0))
    assert bare.count() == len(rows) - 2 and kn_quality.good_documents(docs.limit(0), labels).count() == 0


# ---- pipeline


def test_stages(spark, sf):
    from tests.llm import test_dedup as brute  # noqa: PLC0415

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), "stage")
        seen.append((name, before, docs))
        assert name == "packing" or docs.columns == columns
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    _, start, kept = seen[0]
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    assert {d for d, _ in pairs(start)} & good <= {d for d, _ in pairs(kept)}
    _, a, b = seen[1]
    assert sorted(d for d, _ in pairs(b)) == sorted({c for _, c, _ in brute.brute_classes(pairs(a))})
    _, a, b = seen[2]
    cuts, left = brute.brute_cuts(pairs(a)), dict(pairs(b))
    for d, t in pairs(a):
        whole = cuts[d, t]
        if whole[1] == 0:
            assert left[d] == t
        elif d in left:
            assert 0 <= len(left[d].encode()) - (whole[0] - whole[1]) <= 6 * whole[2]
        else:
            assert whole[1] > whole[0] - 7
    assert all(r["n_chars"] == len(r["text"]) for r in b.collect())
    _, a, b = seen[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute.brute_hits(pairs(a), items) if r[5]}
    assert {str(d) for d, _ in pairs(b)} == {str(d) for d, _ in pairs(a)} - hit
    _, a, b = seen[4]
    assert {r["doc_id"]: r["n"] for r in b.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {r["doc_id"]: r["doc_tokens"] for r in b.collect()} and b.select("doc_id").distinct().count() == a.count()
    assert b.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter(f"n > {packing.WINDOW}").count() == 0


def test_run_gives_the_last_stage(spark, sf):
    assert set(corpus_pipeline.run(spark, sf).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
