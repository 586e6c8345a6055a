"""The quality classifier's perplexities, thresholds and verdicts against a version with dictionaries."""

import math
import random
from collections import Counter, defaultdict

from framesift.llm import kn_quality


def spelled(text, frequent):
    """A text's symbols as letters: B boundary, U upper case, D digit, R rare, or the character itself in brackets."""
    kinds = ["U" if c.isupper() else "D" if c.isdigit() else f"[{c}]" if c in frequent else "R" for c in text]
    return ["B", "B", "B", *kinds]


def brute(rows, labels, band, few):
    """{doc_id: (bits a symbol, limit)} by the definitions, with sums over dictionaries; None for a text without symbols."""
    judged = defaultdict(list)
    for d, q, t in labels:
        judged[d].append((q, t or 0))
    good = {d for d, seen in judged.items() if min(q for q, _ in seen) == 1 and max(t for _, t in seen) == 0}
    trusted = [r for r in rows if r[0] in good and r[1]]
    plain = Counter(c for _, text, _ in trusted for c in text if not c.isupper() and not c.isdigit())
    frequent = {c for c, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))[:60]}
    grams = lambda text: [tuple(s[i : i + 4]) for s in [spelled(text, frequent)] for i in range(len(s) - 3)]
    counts = {4: Counter(g for _, text, _ in trusted for g in grams(text))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total, given, discount = defaultdict(int), defaultdict(float), {}
    for n, seen in counts.items():
        of = Counter(seen.values())
        n1, n2, n3, n4 = (max(of[k], 0.5) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        discount[n] = [0.0, *(min(max(d, 0.05), k - 0.02) for k, d in enumerate(raw, 1))]
        for g, c in seen.items():
            total[n, g[:-1]] += c
            given[n, g[:-1]] += discount[n][min(c, 3)]

    def chance(g):
        n = len(g)
        if not n:
            return 1 / 64
        below, all_ = chance(g[1:]), total[n, g[:-1]]
        if not all_:
            return below
        c = counts[n].get(g, 0)
        return (c - discount[n][min(c, 3)]) / all_ + given[n, g[:-1]] / all_ * below

    rate = lambda text: sum(-math.log2(chance(g)) for g in grams(text)) / len(text)
    limits = {}
    for lang in {None, *(x for _, _, x in trusted)}:
        own = [text for _, text, x in trusted if lang is None or x == lang]
        if lang is not None and len(own) < few:
            continue
        groups, open_, left = [[]], [[]], len(own)
        for k in range(32):
            here = [text for text in own if len(bin(len(text))) - 2 == k]
            groups[-1] += here
            open_[-1].append(k)
            left -= len(here)
            if len(groups[-1]) >= band and left >= band:
                groups.append([])
                open_.append([])
        for texts, ks in zip(groups, open_, strict=True):
            ordered = sorted(math.ceil(rate(t) * 10_000) / 10_000 for t in texts)
            limits.update({(lang, k): ordered[math.ceil(0.99 * len(ordered)) - 1] for k in ks})
    known = {lang for lang, _ in limits}
    return {d: (rate(t), limits[x if x in known else None, len(bin(len(t))) - 2]) if t else None for d, t, x in rows}


def test_perplexities_thresholds_and_verdicts(spark, monkeypatch):
    monkeypatch.setattr(kn_quality, "BAND", 25)
    rnd = random.Random(31)
    letters = {"aa": "abcdefghij", "bb": "klmnopéüß", "cc": "абвгде"}
    words = {x: ["".join(rnd.choice(own) for _ in range(rnd.randint(2, 6))) for _ in range(25)] for x, own in letters.items()}

    def text(lang, n):
        said = [rnd.choice(words[lang]) for _ in range(n)]
        return " ".join(w.title() if rnd.random() < 0.1 else str(rnd.randint(0, 99)) if rnd.random() < 0.05 else w for w in said)

    rows = []
    for lang, n in {"aa": 110, "bb": 45, "cc": 8}.items():
        rows += [(len(rows) + i, text(lang, rnd.choice([2, 4, 12, 40])), lang) for i in range(n)]
    labels = [(d, 1, rnd.choice([0, 0, None])) for d, _, _ in rows]
    labels += [(3, 0, 0), (4, 1, 1), (5, 1, 0), (None, 1, 0), (9999, 1, 0)]  # a doubt, a toxic one, a repeat, and ids without a text
    junk = ["$$$ %%% ^^^ ~~~ @@@", "zzzzqqqq xxxx wwww vvvv", "A", "日本語 の 文", rows[0][1] + " #" * 50]
    rows += [(1000 + i, t, lang) for i, (t, lang) in enumerate((t, x) for t in junk for x in ("aa", "bb", "cc", "xx", None))]
    rows += [(2000, None, "aa"), (2001, "", "bb"), (2002, rows[7][1], None), (2003, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in kn_quality.digest(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = brute(rows, labels, 25, kn_quality.FEW)
    assert set(got) == set(want)
    told = 0
    for d, t, _ in rows:
        r = got[d]
        if want[d] is None:
            assert r["n_symbols"] == 0 and r["perplexity"] is None and not r["kept"]
            continue
        rate, limit = want[d]
        assert r["n_symbols"] == len(t)
        # the table holds 2048ths of a bit, a limit 10,000ths
        assert abs(math.log2(r["perplexity"]) - rate) < 5e-4 and abs(math.log2(r["threshold"]) - limit) < 7e-4
        if abs(rate - limit) > 1.5e-3:
            assert r["kept"] == (rate <= limit)
            told += 1
    assert told > 0.9 * len(rows) and sum(not r["kept"] for r in got.values()) > 10
