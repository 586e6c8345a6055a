"""Measures the join's recall: python -m framesift.llm.forest_recall SF_DIR prints the links that exist, those that were found, and the share.

The links between different texts are counted without hashes of minima: two sets of Jaccard similarity t share one of the first
n - ceil(t n) + 1 of their n grams in any fixed order, so every pair that can be linked meets in a list of rare grams and is verified."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import jaccard_forest
from framesift.llm.common import table


def exact_links(texts: list[str | None], threshold: float = jaccard_forest.THRESHOLD) -> list[int]:
    """The number of links of each text, copies included."""
    import pyarrow as pa

    sets = [tuple(s.tolist()) for s in jaccard_forest.gram_sets(pa.array(texts, pa.string()))]
    copies = Counter(s for s in sets if s)
    own = list(copies)
    seen = Counter(g for s in own for g in s)
    lists, links = defaultdict(list), [0] * len(own)
    whole = [frozenset(s) for s in own]
    for i, s in enumerate(own):
        met = set()
        for g in sorted(s, key=lambda g: (seen[g], g))[: len(s) - ceil(threshold * len(s) - 1e-9) + 1]:
            met.update(lists[g])
            lists[g].append(i)
        for j in met:
            both = len(whole[i] & whole[j])
            if both >= threshold * (len(whole[i]) + len(whole[j]) - both) - 1e-9:
                links[i] += copies[own[j]]
                links[j] += copies[s]
    of = {s: links[i] + copies[s] - 1 for i, s in enumerate(own)}
    return [of.get(s, 0) for s in sets]


def recall(docs: DataFrame) -> tuple[int, int]:
    """(links that exist, links that the join found), each counted from both ends; ids must be distinct."""
    rows = docs.select("doc_id", "text").collect()  # a measurement on small tables: all texts come to the driver
    want = sum(exact_links([r["text"] for r in rows]))
    return want, jaccard_forest.digest(docs).agg(F.sum("n_links")).first()[0] or 0


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    exist, found = recall(table(session, sys.argv[1], "documents"))
    print(f"links {exist}, found {found}, recall {found / exist:.6f}")
