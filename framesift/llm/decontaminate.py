"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark are few and broadcast as hash tables, after a
count. A document is cut into aligned blocks of half a window: every
occurrence of a window covers at least one whole block, so only a fifth as
many keys are probed as there are words. A block that hits is verified against
the exact windows around it. A benchmark of more windows than MOST_WINDOWS isn't
broadcast: then only document keys, block numbers and hashes are shuffled, and the
blocks around a hit are read from the text again.

Defined results. A null text or one without words has no windows and no hits.
Null item ids count as the empty id; items that repeat an id are one item.
Rows that repeat a doc_id are looked at one by one; equal rows give equal
results, each as often as it is there. An empty benchmark contaminates
nothing. Extra columns of either table are ignored. Nothing is cut: very long
texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ascii_lower, hidden, maybe_broadcast, stored

#: What separates words in text that isn't lower-cased yet.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to this many distinct windows are broadcast (some 100 bytes each); beyond it the joins shuffle.
MOST_WINDOWS = 500_000


def normalised(text):
    """Words of the text, not lower-cased yet, each with one space between."""
    return F.trim(F.regexp_replace(text, GAP, " "))


def windows_of(benchmark: DataFrame, n: int) -> DataFrame:
    """(words, n_words, items): each distinct window and the ids of the items that have it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.split(ascii_lower(normalised(F.col("text"))), " ").alias("w")).filter("w is not null and w[0] <> ''")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    rows = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(n)))).alias("g"))
    return rows.groupBy(F.array_join("g", " ").alias("window"), F.size("g").alias("len")).agg(F.collect_set("item").alias("items"))


def seeds_of(windows: DataFrame, block: int) -> DataFrame:
    """Hashes of all runs of block words in the windows that this block size serves."""
    w = windows.filter(F.expr(f"(len + 1) div 2 = {block}")).select(F.split("window", " ").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - block + 1), lambda s: F.xxhash64(F.lower(F.array_join(F.slice("w", s, F.lit(block)), " "))))
    return w.select(F.explode(grams).alias("seed")).distinct()


def _found_by_shuffle(blocks: DataFrame, seeds: DataFrame) -> DataFrame:
    """blocks (doc_id, text_key, b) with j and seed: a row for the first block, or a null j if there is none, and one for each block whose hash is a seed."""
    slim = blocks.select("doc_id", "text_key", F.posexplode("b").alias("j", "block")).select("doc_id", "text_key", "j", F.xxhash64(F.lower("block")).alias("probe"))
    found = slim.join(seeds.hint("merge"), F.col("probe") == F.col("seed")).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.collect_set("j").alias("js"))
    each = blocks.join(found, blocks["doc_id"].eqNullSafe(found["hit_id"]) & (blocks["text_key"] == found["hit_key"]), "left")
    each = each.select("doc_id", "text_key", "b", "js", F.explode(F.expr("if(size(b) = 0, array(cast(null as int)), array_union(array(0), coalesce(js, array())))")).alias("j"))
    return each.withColumn("seed", F.when(F.array_contains("js", F.col("j")), F.lit(0).cast("long"))).drop("js")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items, spans, contaminated), a row for each row of docs.

    spans are the [first, after) word numbers of the windows that occur, overlapping ones included."""
    windows = stored(windows_of(benchmark, n), "windows")
    sizes = sorted(((r["len"] + 1) // 2, r["len"], r["count"]) for r in windows.groupBy("len").count().collect())  # at most n rows
    total = sum(x[2] for x in sizes)
    few = total <= MOST_WINDOWS
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), normalised(F.col("text")).alias("norm"))
    parts = []
    for block in sorted({x[0] for x in sizes}) or [(n + 1) // 2]:
        lens = [x[1] for x in sizes if x[0] == block]
        blocks = base.select("doc_id", "text_key", F.regexp_extract_all("norm", F.lit(f"[^ ]+(?: [^ ]+){{0,{block - 1}}}"), F.lit(0)).alias("b"))
        if few:
            each = blocks.select("*", F.posexplode_outer("b").alias("j", "block")).withColumn("probe", F.xxhash64(F.lower("block")))
            seeds = F.broadcast(seeds_of(windows, block))  # block + 1 for each window at most
            hit = each.join(seeds, each["probe"] == seeds["seed"], "left").filter("seed is not null or j is null or j = 0")
        else:
            hit = _found_by_shuffle(blocks, seeds_of(windows, block))
        first = F.expr("j is null or j = 0")
        near = F.expr("split(concat_ws(' ', if(j > 0, b[j - 1], null), b[j], get(b, j + 1)), ' ')")
        last = F.expr(f"if(size(b) > 0, (size(b) - 1) * {block} + size(split(b[size(b) - 1], ' ')), 0)")
        hit = hit.select("doc_id", "text_key", first.alias("first"), F.when(first, last).cast("long").alias("n_words"), "j", F.when(F.col("seed").isNotNull(), F.transform(near, ascii_lower)).alias("near"))
        spot = "named_struct('p', cast({p} as bigint), 'len', {l}, 'window', {w})"
        around = [
            f"transform(filter(sequence(0, {block}), o -> o + {k} <= size(near) and o + {k} >= if(j > 0, {block}, 0) + {block} and o <= if(j > 0, {block}, 0)), "
            f"o -> {spot.format(p=f'(j - if(j > 0, 1, 0)) * {block} + o', l=k, w=f'''array_join(slice(near, o + 1, {k}), ' ')''')})"
            for k in lens
        ]
        own = spot.format(p="null", l="cast(null as int)", w="cast(null as string)")
        tries = F.expr(f"concat(if(first, array({own}), array()), if(near is null, array(), {'concat(' + ', '.join(around) + ')' if around else 'array()'}))")
        parts.append(hit.select("doc_id", "text_key", "first", "n_words", F.explode(tries).alias("t")).select("doc_id", "text_key", "n_words", "t.*"))
    if len(parts) > 1:  # the first part alone tells of each row
        parts = [parts[0], *(p.filter("p is not null") for p in parts[1:])]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    exact = windows.select(F.col("window").alias("own_window"), "items")
    if few:
        rows = rows.join(F.broadcast(exact), rows["window"] == exact["own_window"], "left").filter("p is null or items is not null")
    else:  # rows that only tell of their document have no window to join by
        own = rows.filter("p is null").withColumns({"own_window": F.lit(None).cast("string"), "items": F.lit(None).cast("array<string>")})
        rows = own.unionByName(rows.filter("p is not null").join(exact.hint("merge"), rows["window"] == exact["own_window"]))
    found = rows.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("p").isNull()).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("p").isNotNull(), F.struct(F.col("p").alias("first"), (F.col("p") + F.col("len")).alias("after"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.expr("aggregate(spans, named_struct('n', 0L, 'e', 0L), (a, x) -> named_struct('n', a.n + greatest(0L, x.after - greatest(x.first, a.e)), 'e', greatest(a.e, x.after))).n")
    found = found.select("doc_id", "text_key", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return found.withColumn("contaminated", F.expr("n_hit > 0")).drop("copy")


def remove_documents(docs: DataFrame, report: DataFrame, most_keys: int = 1_000_000) -> DataFrame:
    """docs without the contaminated rows; all columns stay as they are."""
    bad = stored(report.filter("contaminated").select(F.col("doc_id").alias("bad_id"), "text_key").distinct(), "contaminated")
    bad = maybe_broadcast(bad, bad.count(), most_keys)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"]), "left_anti")


def remove_spans(docs: DataFrame, report: DataFrame, most_keys: int = 1_000_000) -> DataFrame:
    """docs with the words of all hit windows cut out of the text, each with what stands before it."""
    bad = stored(report.filter("contaminated").select(F.col("doc_id").alias("bad_id"), "text_key", F.col("spans").alias("bad_spans")).dropDuplicates(["bad_id", "text_key"]), "spans")
    bad = maybe_broadcast(bad, bad.count(), most_keys)
    word, rest = GAP.rstrip("+"), GAP
    word = word.replace("[", "[^", 1)
    pieces = F.regexp_extract_all("text", F.lit(f"(?:{rest.rstrip('+')})*{word}+"), F.lit(0))
    kept = F.filter(pieces, lambda x, i: ~F.exists("bad_spans", lambda s: (i >= s["first"]) & (i < s["after"])))
    own, restored = hidden(docs, "doc_id", "text")
    joined = own.join(bad, own["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(own["text"]) == bad["text_key"]), "left")
    out = joined.withColumn("text", F.when(F.col("bad_spans").isNotNull(), F.concat(F.array_join(kept, ""), F.regexp_extract("text", rest + "$", 0))).otherwise(F.col("text")))
    return restored(out)


def digest(report: DataFrame) -> DataFrame:
    """The columns of the op7 query."""
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
