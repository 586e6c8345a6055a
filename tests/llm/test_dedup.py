"""Near copies, repeated strings and benchmark passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from framesift.llm import decontaminate, jaccard_forest, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def edited(rnd, text, share):
    return " ".join("x" + w if rnd.random() < share else w for w in text.split())


# ---- n-gram Jaccard join


def shingles(text):
    w = WORDS.findall((text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, least[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def groups():
    rnd = random.Random(5)
    base = [sentence(rnd, n) for n in (200, 120, 60, 40)]
    texts = [edited(rnd, t, 0.01 if k % 2 else 0.03) for t in base for k in range(8)] + base[:2] * 3 + [sentence(rnd, 80) for _ in range(10)] + ["", None, " \n", "one two", "One  two", "a b c d e", "a b c d e f"]
    return list(enumerate(texts)) + [(3, texts[3]), (900, "ONE TWO")]


@pytest.mark.parametrize("block", [None, 4])
def test_classes_and_links(spark, documents, monkeypatch, block):
    if block:  # groups beyond a block are dealt out as pairs of blocks
        monkeypatch.setattr(jaccard_forest, "SET_BLOCK", block)
        monkeypatch.setattr(jaccard_forest, "NODE_BLOCK", block)
    rows = groups()
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_forest.digest(documents(rows)).collect())
    assert got == brute_classes(rows)


def test_one_document_of_each_group_stays(spark, documents):
    rows = groups()
    docs = documents(rows)
    kept = jaccard_forest.distinct_documents(docs)
    assert kept.schema == docs.schema
    want = sorted({c for _, c, _ in brute_classes(rows)})
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert jaccard_forest.distinct_documents(documents([])).count() == 0 and jaccard_forest.digest(documents([])).count() == 0


def test_recall_is_read_off_the_pairs_found():
    m = jaccard_forest.MINIMA
    found = np.zeros(m + 1)
    alone = [jaccard_forest.recall_of(found, d) for d in range(1, 6)]
    assert alone == sorted(alone, reverse=True) and alone[2] > 0.9999 > alone[3] and alone[4] == pytest.approx(1 - (1 - 0.8**5) ** 16)
    found[m] = 10**6  # copies but for a few words need no short prefixes
    assert jaccard_forest.recall_of(found, 5) > 0.9999
    found[64] = 10**6
    assert jaccard_forest.recall_of(found, 5) < 0.9999


def test_prefixes_shorten_only_as_far_as_needed(spark):
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**32, (300, jaccard_forest.MINIMA)).astype(">u4")
    close = [(i, r.tobytes()) for i, r in enumerate(base)] + [(1000 + i, np.where(rnd.random(len(r)) < 0.995, r, 7).astype(">u4").tobytes()) for i, r in enumerate(base)]
    far = close[:300] + [(1000 + i, np.where(rnd.random(len(r)) < 0.81, r, 7).astype(">u4").tobytes()) for i, r in enumerate(base)]
    links = lambda rows, target: jaccard_forest.candidate_links(spark.createDataFrame(rows, "class long, signature binary"), 0.8, target)
    assert links(close, 0.9999)[1] == 5
    deep, shallow = links(far, 0.9), links(far, 0.9999)
    assert deep[1] > shallow[1] and shallow[0].count() >= deep[0].count() and shallow[0].count() > 280


def test_agreement_of_few_is_that_of_many():
    rnd = np.random.default_rng(2)
    sign = rnd.integers(0, 2, (60, jaccard_forest.MINIMA)).astype(np.uint32)
    for depth in (1, 3, 5):
        many = jaccard_forest.agreement(sign, depth)
        assert all((a == b[:20, :20]).all() for a, b in zip(jaccard_forest.agreement(sign[:20], depth), many, strict=True))


def test_chains_beyond_a_block(spark, documents, monkeypatch):
    """A chain of texts of which only neighbours are near: one component, of which few blocks meet."""
    monkeypatch.setattr(jaccard_forest, "SET_BLOCK", 8)
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(60)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_forest.digest(documents(rows)).collect())
    assert got == brute_classes(rows) and {r[1] for r in got} == {0}


# ---- suffix-array dedup


def brute_cuts(rows):
    """(n_bytes, n_removed, n_spans, sha256) of each distinct row in order; rows that repeat are one document."""
    out, seen = {}, {}
    for doc, text in sorted({(-1 << 63 if d is None else d, t) for d, t in rows}, key=lambda r: (r[0], r[1] or "")):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - 99):
            if seen.setdefault(data[s : s + 100], (doc, text, s)) != (doc, text, s):
                gone[s : s + 100] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(data) else 0
        out[doc, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeats():
    rnd = random.Random(9)
    p = [sentence(rnd, 60, 10**6) for _ in range(4)]
    texts = [p[0], p[1] + p[0][30:250] + "é" + p[2], p[0][:99], p[0][:100], p[0][1:101], None, "", "ab" * 300, "x" * 99, "x" * 100, "x" * 250, p[3] + p[3], "é" * 120 + p[2][:150], p[2][7:140] + p[1][5:106] + p[1][6:107]]
    return list(enumerate(texts)) + [(2, p[0][:99]), (0, p[0]), (50, p[0]), (51, "q" + p[0] + "q"), (None, p[3][:130])]


@pytest.mark.parametrize("small", [False, True])
def test_repeated_strings(spark, documents, monkeypatch, small):
    if small:  # long texts in pieces, many batches and levels, many shards
        for name, value in (("PIECE", 150), ("BATCH", 3), ("SHARD_BYTES", 500), ("SLICE", 700)):
            monkeypatch.setattr(suffix_dedup, name, value)
    rows = repeats()
    want = brute_cuts(rows)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(documents(rows)).collect())
    assert got == sorted((str(d), *want[-1 << 63 if d is None else d, t]) for d, t in rows)


def test_removal_keeps_whole_characters(spark, documents):
    docs = documents(repeats())
    left = suffix_dedup.removed(docs)
    assert left.schema == docs.schema and left.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[50] == "" and texts[5] is None and suffix_dedup.removed(documents([])).count() == 0


def test_levels_find_what_came_before():
    rnd, levels, seen, at = np.random.default_rng(1), suffix_dedup.Levels(), {}, 0
    for _ in range(40):
        batch = rnd.integers(0, 500, 30).astype(np.uint64)
        want, first = [], []
        for i, x in enumerate(batch.tolist()):
            want.append(x in seen)
            first.append(seen.setdefault(x, at + i))
        before, earlier = levels.add(batch, np.arange(at, at + len(batch)))
        assert before.tolist() == want and earlier.tolist() == first
        at += len(batch)
    sizes = [len(x) for x, _ in levels.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def judged(rows, shards, hot=None):
    """{(id, tie): cuts} of rows (id, text), two slices, without Spark."""
    import pyarrow as pa

    by_shard, out = {}, {}
    rows = sorted(rows)
    for part in (rows[::2], rows[1::2]):
        ids, ties = np.array([r[0] for r in part]), np.zeros(len(part), np.int64)
        for shard, *row in suffix_dedup.index_slice(ids, ties, pa.array([r[1] for r in part], pa.string()), shards, hot):
            by_shard.setdefault(shard, []).append(row)
    for rows_ in by_shard.values():
        for x in suffix_dedup.judge_shard(rows_).tolist():
            out.setdefault(x[0], []).append(x[2:])
    return {d: suffix_dedup._cuts_of([np.array(x, dtype=np.int64).tobytes()]).tolist() for d, x in out.items()}, by_shard


def test_hot_anchors_spread_and_change_nothing(spark):
    """One line between different neighbours in every text: one shard has it all until its anchors are hot."""
    rnd = random.Random(3)
    line = "Licensed to whoever may read this, without any warranty at all."
    rows = [(i, f"{sentence(rnd, 30, 10**7)} {line} {sentence(rnd, 30, 10**7)}" + (" the same end of some texts, " * 4 if i % 7 == 0 else "")) for i in range(400)]
    plain, a = judged(rows, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t) for _, t in rows)
    old = suffix_dedup.SHARD_BYTES
    try:
        suffix_dedup.SHARD_BYTES = 6_000
        hot = suffix_dedup.hot_anchors(docs, total, 1)
    finally:
        suffix_dedup.SHARD_BYTES = old
    split, b = judged(rows, 100, hot)
    size = lambda x: [sum(r[5] + 24 * r[9] for r in rs) for rs in x.values()]
    want = brute_cuts(rows)
    assert 0 < len(hot) < 20 and split == plain and {d: sum(b - a for a, b in x) for d, x in split.items()} == {d: w[1] for (d, _), w in want.items() if w[1]}
    assert max(size(a)) > 1.5 * np.median(size(a)) and max(size(b)) < max(size(a)) and sum(sum(r[9] for r in rs) > 0 for rs in b.values()) > 90


def test_weak_fingerprints_change_nothing(monkeypatch):
    """Equal fingerprints of different strings: runs are compared by bytes, shards judged again."""
    rnd = random.Random(8)
    p = sentence(rnd, 60, 10**6)
    rows = [(i, sentence(rnd, 40, 10**6) + (p[: 150 + i] if i % 3 else p[40:260]) + sentence(rnd, 20, 10**6)) for i in range(30)]
    want = judged(rows, 4)[0]
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda h, at: h[32][at] % np.uint64(50))
    assert judged(rows, 4)[0] == want and {d: sum(b - a for a, b in x) for d, x in want.items()} == {d: w[1] for (d, _), w in brute_cuts(rows).items() if w[1]}


# ---- decontamination

KEY = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, n=10):
    grams = {}
    for item, text in items:
        w = KEY.findall((text or "").translate(ASCII))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w = KEY.findall((text or "").translate(ASCII))
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[tuple(w[i : i + k])]
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def contaminated():
    rnd = random.Random(3)
    items = [(i, sentence(rnd, n)) for i, n in enumerate((30, 12, 10, 9, 8, 5, 3, 1))] + [(1, "Über straße ÀÉ a b c d e f g h"), (20, None), (21, "--"), (22, "a a a a a a a a a a a a"), (None, "nul id w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    t = dict(items[:8])
    docs = ["", None, "...", t[0], f"zz {t[0]} zz", t[0].upper().replace(" ", " -\n"), " ".join(t[0].split()[5:16]), " ".join(t[0].split()[5:14]), t[1] + " " + t[2], t[3], "q " + t[4] + " q", t[5], t[6] + " mid " + t[6], "über strasse", "Über straße ÀÉ a b c d e f g h", "Über straße àé a b c d e f g h", "a " * 40, sentence(rnd, 3000) + " " + t[0] + " " + sentence(rnd, 50), items[-1][1]]
    return list(enumerate(docs)) + [(3, docs[3]), (3, "other words"), (None, t[0])], items


@pytest.mark.parametrize("most", [None, 0])
def test_hits(spark, documents, monkeypatch, most):
    if most is not None:  # nothing is broadcast
        monkeypatch.setattr(decontaminate, "MOST_WINDOWS", most)
    rows, items = contaminated()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.digest(decontaminate.scan(documents(rows), bench))
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got.collect()) == brute_hits(rows, items)
    none = decontaminate.scan(documents(rows), bench.limit(0))
    assert none.count() == len(rows) and none.filter("contaminated").count() == 0 and decontaminate.scan(documents([]), bench).count() == 0


def test_documents_and_spans_go(spark, documents):
    rows, items = contaminated()
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    docs = documents(rows)
    told = decontaminate.scan(docs, bench)
    left = decontaminate.remove_documents(docs, told)
    assert left.schema == docs.schema and left.count() == sum(not r[5] for r in brute_hits(rows, items))
    cut = decontaminate.remove_spans(docs, told)
    assert cut.schema == docs.schema and cut.count() == len(rows)
    again = [(r["doc_id"], r["text"]) for r in cut.collect()]
    before, after = {x[0]: x for x in brute_hits(rows[:19], items)}, {x[0]: x for x in brute_hits([r for r in again if r[0] is not None and r[0] != 3], items)}
    assert all(after[k][1] == before[k][1] - before[k][2] for k in after)
