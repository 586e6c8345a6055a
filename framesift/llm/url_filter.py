"""URL filters: host rules first, then logistic regression on hashed character n-grams.

The model is fitted on a small labelled URL table; its size is a documented
bound (MOST_LABELLED rows, the smallest by hash), so training stays on the
driver. Weights are a fixed 2**BITS vector, which each task receives whole.

Defined results. A null url or one without '://' has an empty host and path;
no rule fits it and the model sees no n-gram but the marks, so its verdict is
the intercept's. Rows that repeat are judged alike; extra columns are ignored.
Of rules that fit, the one with the longest text wins, then the first in text
order; equal rules with different verdicts block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ascii_lower, mix64

BITS, LOW_N, HIGH_N = 16, 3, 5
MOST_LABELLED = 100_000
#: The five rules of the query: (host/path prefix, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: Words of the general language by what sites under such names offer. The hosts of the labelled table are made of them.
TOPICS_TO_BLOCK = "casino poker slots betting bets jackpot lottery roulette pills viagra pharmacy meds drugs porn adult sex xxx escort cams nude loans payday credit forex crypto bitcoin replica fake counterfeit warez crack torrent spam phishing malware followers clickbait ads adserver tracker banner popup".split()
LURES = "free cheap best win bonus hot buy fast easy online deals discount farm track store".split()
TOPICS_TO_ALLOW = "news library archive journal garden museum school recipes travel weather history science music kitchen forum wiki docs research theatre village college hospital council bakery cinema gallery orchestra railway harbour mountain river forest bridge market station football cycling gardening knitting pottery astronomy geology botany chemistry physics grammar poetry novel painting".split()
ONSETS, VOWELS, CODAS = "b c d f g h k l m n p r s t v w sh th st br".split(), "aeiou", ["", *"n r s t l nt st rd ck m".split()]


def _name(i: int) -> str:
    """The i-th name that means nothing, of two or three syllables by strides."""
    return "".join(ONSETS[(i * 7 + k * 3 + i // 20) % len(ONSETS)] + VOWELS[(i * 3 + k + i // 5) % 5] + CODAS[(i * 5 + 4 * k) % len(CODAS)] for k in range(2 + i % 2))


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled URL table, made by a rule (1 is to be blocked): topics alone and with a lure before or after them; topics to allow
    alone and in pairs; and names that mean nothing, which are no reason to block."""
    hosts = [(t, 1) for t in TOPICS_TO_BLOCK]
    hosts += [(f"{LURES[(i + k) % len(LURES)]}-{t}" if k % 2 else f"{t}-{LURES[(2 * i + k) % len(LURES)]}", 1) for i, t in enumerate(TOPICS_TO_BLOCK) for k in (1, 4)]
    hosts += [(t, 0) for t in TOPICS_TO_ALLOW] + [(f"{t}-{TOPICS_TO_ALLOW[(3 * i + 5) % len(TOPICS_TO_ALLOW)]}", 0) for i, t in enumerate(TOPICS_TO_ALLOW)]
    hosts += [(_name(i), 0) for i in range(400)]
    shapes = ("https://www.{}.example.org/en/{}", "http://{}.example.net/de/{}.html", "https://blog.{}.example.com/fr/{}/", "http://m.{}.example.com/es/{}?page=2")
    return [(s.format(h, 100 + 7 * i), label) for i, (h, label) in enumerate(dict(hosts).items()) for s in shapes]


def parts(url: str) -> tuple[str, str]:
    """(host, path) of a labelled url, as split_url() gives them."""
    host, _, path = url.partition("://")[2].partition("/")
    return host, "/" + path.partition("?")[0]


def host_word(url: str) -> str:
    """The word of a labelled url's host that tells of its kind."""
    return next(x for x in parts(url)[0].split(".") if x not in ("www", "blog", "m"))


def split_url(url):
    """(host, path) columns: host lower-cased from the first '://' to '/', '?', '#' or the end; then the path to '?', '#' or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of bytes, one list per text: (text number, bucket), a pair once for each place."""
    data = np.frombuffer(b"".join(x.encode() for x in texts) + bytes(HIGH_N), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(x.encode()) for x in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    docs, buckets = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(doc), dtype=np.uint64)
        for n in range(1, HIGH_N + 1):
            h = h * np.uint64(0x100000001B3) + data[n - 1 : n - 1 + len(doc)] + np.uint64(1)
            if n >= LOW_N:
                ok = left >= n
                docs.append(doc[ok])
                buckets.append((mix64(h[ok] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


def features(hosts, paths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): counts of n-grams, scaled to length 1 for each row. Digits of the path are one symbol."""
    from re import sub

    texts = [f"^{h}$ {sub('[0-9]+', '0', p)}$" for h, p in zip(hosts, paths, strict=True)]
    doc, bucket = _grams(texts)
    key, count = np.unique(doc << BITS | bucket, return_counts=True)
    doc, bucket = key >> BITS, key & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(doc, weights=count.astype(float) ** 2, minlength=len(texts)))
    return doc, bucket, count / norm[doc]


def fit(labelled: list[tuple[str, str, int]], steps: int = 600, rate: float = 8.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch gradient descent on (host, path, label); deterministic."""
    doc, bucket, value = features([x[0] for x in labelled], [x[1] for x in labelled])
    y = np.array([x[2] for x in labelled], dtype=float)
    w, b, n = np.zeros(1 << BITS), 0.0, len(labelled)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(doc, weights=w[bucket] * value, minlength=n) + b)))
        g = (p - y) / n
        w -= rate * (np.bincount(bucket, weights=g[doc] * value, minlength=1 << BITS) + ridge * w)
        b -= rate * g.sum()
    return w, b


def train(spark, labelled: DataFrame | None = None) -> tuple[np.ndarray, float]:
    """Fit on (url, label); of a larger table the MOST_LABELLED rows that are first by hash."""
    labelled = labelled if labelled is not None else spark.createDataFrame(labelled_urls(), "url string, label int")
    host, path = split_url(F.col("url"))
    rows = labelled.select(host.alias("h"), path.alias("p"), "label", F.xxhash64("url").alias("k")).filter("label is not null").orderBy("k", "h", "p", "label").limit(MOST_LABELLED).collect()
    return fit([(r["h"], r["p"], r["label"]) for r in rows]) if rows else (np.zeros(1 << BITS), 0.0)


def judge(pages: DataFrame, model, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); score is the model's probability that the url is to be blocked."""
    weights, intercept = np.asarray(model[0], dtype=np.float32), float(model[1])

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                doc, bucket, value = features(part.column(1).to_pylist(), part.column(2).to_pylist())
                z = np.bincount(doc, weights=weights[bucket] * value, minlength=part.num_rows) + intercept
                yield pa.record_batch([*part.columns, pa.array(1 / (1 + np.exp(-z)))], names=["page_id", "host", "path", "score"])

    host, path = split_url(F.col("url"))
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(scored, f"page_id {kind}, host string, path string, score double")
    verdicts = {}
    for text, verdict in rules:
        verdicts[text] = "block" if verdicts.get(text, verdict) != verdict else verdict
    rule = F.lit(None).cast("string")
    for text in sorted(verdicts, key=lambda t: (len(t), [-ord(c) for c in t])):
        h, _, p = text.partition("/")
        fits = (F.col("host") != "") & ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for text, v in verdicts.items():
        verdict = F.when(F.col("rule") == text, v).otherwise(verdict)
    return rows.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
