"""Quality classifier: interpolated modified Kneser-Ney over characters, learned from trusted text.

A symbol is the boundary, any upper-case letter, any digit, any character that
the trusted text lacks, or one of the other characters of the trusted text: each
of these is a symbol of its own, numbered from the most frequent. N-grams of the
first 64 symbols are plain, and there are 64**4 of them at most, whatever the
corpus: their bits are a table of as many numbers, which is broadcast, of 16 bits
each if the largest fits and of 32 otherwise. All
other n-grams are far. Counts are summed map-side and by shards of n-grams. Up to
MOST_GRAMS different ones the model is made from arrays, and the chances that far
n-grams need are broadcast too; beyond that the levels of the model are tables,
and the far n-grams of the documents are joined with them. Both ways give the
same. Each document's perplexity is held against a quantile of trusted documents
of its language and of like length: lengths are banded by powers of two, and
neighbouring bands are one until they have BAND documents.

Trusted are documents with a label of quality 1 and none of quality 0 or toxic.
All of them are counted, and the quantiles are over all of them; their ids are
broadcast up to MOST_SENT of them, and beyond that the join shuffles.

Defined results. A null or empty text has no perplexity and is not kept. A
language that is null or has fewer than FEW trusted documents gets the quantiles
over all languages; with no trusted text at all every text that isn't empty is
kept. Each row is judged by itself, so repeated rows get equal results; extra
columns pass through. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import hidden, slices, stored, trim

ORDER, SYMBOLS = 4, 64
BOUNDARY, UPPER, DIGIT, RARE, FIRST = 0, 1, 2, 3, 4
MOST_SENT, FEW = 2_000_000, 20
#: Different n-grams up to which the model is made by the driver and broadcast.
MOST_GRAMS = 2_000_000
PLACE = 21  # binary digits of a symbol within a context: no alphabet has 2**21 characters
LOW = (1 << PLACE) - 1
POINTS = 0x110000
#: A document is rejected if its bits a symbol exceed those at this quantile of the trusted documents of its band.
QUANTILE, BAND, BITS = 0.99, 100, 32  # BITS: a length's binary digits are fewer
STEPS = 2048  # the table's resolution: parts of a bit


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted_id): a row for each trusted document."""
    ids = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and coalesce(t, 0) = 0").select(F.col("doc_id").alias("trusted_id"))
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids  # MOST_SENT numbers at most


def _kinds() -> np.ndarray:
    """Each code point's fixed symbol, or FIRST for those that have their own if they are frequent."""
    out = np.full(POINTS, FIRST, dtype=np.uint8)
    for p in range(POINTS):
        c = chr(p)
        if c.isupper():
            out[p] = UPPER
        elif c.isdigit():
            out[p] = DIGIT
    return out


def points_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def windows_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(plain n-gram numbers, one for each character, first of each text as n + 1 offsets; places, contexts and symbols of far n-grams).

    Three boundaries stand before a text. The number of a far n-gram is 0, which no plain one has. A context has PLACE binary digits a symbol."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    off = np.concatenate(([0], np.cumsum(size)))
    s = table[points_of(texts)].astype(np.int32)
    code, far = s.copy(), s >= SYMBOLS
    any_far, before = far.any(), []
    place = np.arange(len(s)) - np.repeat(off[:-1], size)
    for k in range(1, ORDER):
        past = np.zeros(len(s), dtype=np.int32)
        past[k:] = s[:-k] if k < len(s) else past[k:]
        past[place < k] = BOUNDARY
        code |= past << (6 * k)
        if any_far:
            before.append(past)
            far |= past >= SYMBOLS
    at = np.flatnonzero(far)
    context = np.zeros(len(at), dtype=np.int64)
    for k, past in enumerate(before):
        context |= past[at].astype(np.int64) << (PLACE * k)
    code[at] = 0
    return code, off, at, context, s[at].astype(np.int64)


def codes_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two of windows_of."""
    return windows_of(texts, table)[:2]


def distinct(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
    """(different n-grams' contexts and symbols in order, which of them each row is, their counts)."""
    order = np.lexsort((symbol, context))
    c, s = context[order], symbol[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(first) - 1
    return c[first], s[first], which, np.bincount(which, minlength=first.sum())


def batches_of(kinds: dict, columns: list[np.ndarray], rows: int = 50_000):
    import pyarrow as pa

    for a in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + rows], k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


# ---- the model: for each n from 1 to ORDER, p(symbol | context) = rest of the context * p by one symbol less + share of the n-gram


def mask(n: int) -> int:
    """The last n - 1 symbols of a context."""
    return (1 << PLACE * (n - 1)) - 1


def _discounts(ones: list[int]) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney, by count (0 for 0), from how many n-grams have a count of 1, 2, 3 and 4."""
    n = [max(float(x), 0.5) for x in ones]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.02) for k in (1, 2, 3))]


def levels_of(context: np.ndarray, symbol: np.ndarray, c: np.ndarray) -> list[tuple]:
    """By n: (contexts in order, their rests; context, symbol and share of each n-gram in order), from the counts of different 4-grams."""
    out = []
    order = np.lexsort((symbol, context))
    context, symbol, c = context[order], symbol[order], c[order]
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # in how many contexts one symbol longer the n-gram was seen
            key, c = np.unique((context & mask(n)) << PLACE | symbol, return_counts=True)
            context, symbol = key >> PLACE, key & LOW
        d = _discounts([(c == k).sum() for k in (1, 2, 3, 4)])
        few = np.minimum(c, 3)
        contexts, of = np.unique(context, return_inverse=True)
        total = np.zeros(len(contexts), dtype=np.int64)
        np.add.at(total, of, c)
        ones = [np.bincount(of[few == k], minlength=len(contexts)) for k in (1, 2, 3)]
        rest = (d[1] * ones[0] + d[2] * ones[1] + d[3] * ones[2]) / total
        out.append((contexts, rest, context, symbol, (c - np.array(d)[few]) / total[of]))
    return out[::-1]


def level_tables(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """levels_of by tables: by n (context, rest) and (context, symbol, share)."""
    out = []
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            counts = stored(counts.groupBy(F.col("context").bitwiseAND(F.lit(mask(n)).cast("long")).alias("context"), "symbol").agg(F.count(F.lit(1)).alias("c")), "quality-counts")
        seen = {r["c"]: r["count"] for r in counts.filter("c <= 4").groupBy("c").count().collect()}  # four rows
        d = _discounts([seen.get(k, 0) for k in (1, 2, 3, 4)])
        ones = [F.count(F.when(F.least("c", F.lit(3)) == k, 1)) for k in (1, 2, 3)]
        rest = (F.lit(d[1]) * ones[0] + F.lit(d[2]) * ones[1] + F.lit(d[3]) * ones[2]) / F.sum("c")
        contexts = stored(counts.groupBy("context").agg(F.sum("c").alias("total"), rest.alias("rest")), "quality-contexts")
        less = F.when(F.col("c") == 1, d[1]).when(F.col("c") == 2, d[2]).otherwise(d[3])
        shares = stored(counts.join(contexts, "context").select("context", "symbol", ((F.col("c") - less) / F.col("total")).alias("share")), "quality-shares")
        out.append((contexts.select("context", "rest"), shares))
    return out[::-1]


def plain_part(contexts: DataFrame, shares: DataFrame) -> tuple:
    """The rows of a level that plain n-grams have, as levels_of gives them: 64**4 at most."""
    far = F.lit(sum((LOW ^ SYMBOLS - 1) << PLACE * k for k in range(ORDER - 1))).cast("long")
    plain = F.col("context").bitwiseAND(far) == 0
    own = contexts.filter(plain).toArrow()
    kept = shares.filter(plain & (F.col("symbol") < SYMBOLS)).select("context", F.col("symbol").cast("byte"), F.col("share").cast("float")).toArrow()
    return tuple(t.column(c).to_numpy() for t, c in ((own, "context"), (own, "rest"), (kept, "context"), (kept, "symbol"), (kept, "share")))


def _plain(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which contexts are plain, the plain ones' numbers)."""
    ok = (context & sum((LOW ^ SYMBOLS - 1) << PLACE * k for k in range(ORDER - 1))) == 0
    c = context[ok]
    return ok, (c & 63 | (c >> PLACE & 63) << 6 | (c >> 2 * PLACE & 63) << 12).astype(np.int32)


def plain_bits(levels: list[tuple], size: int) -> np.ndarray:
    """-log2 p(symbol | three before), in steps of 1 / STEPS, of every plain n-gram, in an alphabet of that size."""
    lower = np.full((1, SYMBOLS), 1 / size, dtype=np.float32)
    for n, (contexts, rest, context, symbol, share) in enumerate(levels, 1):
        span = SYMBOLS ** (n - 1)
        new = np.tile(lower, (span // len(lower), 1))
        ok, number = _plain(contexts)
        rests = np.ones(span, dtype=np.float32)
        rests[number] = rest[ok]
        new *= rests[:, None]
        ok, number = _plain(context)
        of = symbol[ok]
        new[number[of < SYMBOLS], of[of < SYMBOLS]] += share[ok][of < SYMBOLS].astype(np.float32)
        lower = new
    flat = lower.ravel()  # at least 0.05**4 / (characters * size**4), far from 0 as a float of 32 bits
    out = flat.view(np.int32)  # in place: the table is as large as any
    for a in range(0, len(flat), 1 << 20):
        out[a : a + (1 << 20)] = np.rint(-np.log2(flat[a : a + (1 << 20)]) * STEPS)
    return out.astype(np.uint16) if out.max() < 1 << 16 else out


def bits_table(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """plain_bits from the numbers and counts of plain n-grams alone."""
    codes = codes.astype(np.int64)
    context = codes >> 6 & 63 | (codes >> 12 & 63) << PLACE | (codes >> 18) << 2 * PLACE
    return plain_bits(levels_of(context, codes & 63, counts), SYMBOLS)


def searched(levels: list[tuple]) -> list[tuple]:
    """The levels as far_steps reads them: (contexts, rests, n-grams as number of the context and symbol, shares). Plain 4-grams have their table."""
    out = []
    for n, (contexts, rest, context, symbol, share) in enumerate(levels, 1):
        key = np.searchsorted(contexts, context) << PLACE | symbol
        if n == ORDER:
            far = ~_plain(context)[0] | (symbol >= SYMBOLS)
            key, share = key[far], share[far]
        out.append((contexts, rest, key, share))
    return out


def far_steps(levels: list[tuple], size: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The bits of far n-grams, in steps."""
    p = np.full(len(symbol), 1 / size)
    for n, (contexts, rest, keys, share) in enumerate(levels, 1):
        own = context & mask(n)
        i = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
        known = contexts[i] == own
        key = i << PLACE | symbol
        j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        p = np.where(known, rest[i] * p + np.where(keys[j] == key, share[j], 0.0), p)
    return np.rint(-np.log2(p) * STEPS).astype(np.int64)


def digits(n: Column) -> Column:
    """Binary digits of a length."""
    return F.length(F.bin(n))


def banded(sizes: list[int]) -> list[int]:
    """The group of each band: from the short to the long, bands join until they have BAND documents; what is left joins the last group."""
    groups, number, held = [], 0, 0
    left = sum(sizes)
    for n in sizes:
        groups.append(number)
        held, left = held + n, left - n
        if held >= BAND and left >= BAND:
            number, held = number + 1, 0
    return groups


def _by_language(values: dict, kind: str) -> Column:
    """The value of the row's language, or that of None."""
    own = [F.lit(x) for lang, v in values.items() if lang is not None for x in (lang, v)]
    rest = F.lit(values[None]).cast(kind)
    return F.coalesce(F.create_map(*own)[F.col("lang")].cast(kind), rest) if own else rest


class Model:
    """symbols: each code point's; size: the alphabet's; bits: each plain n-gram's; levels: arrays (searched) or tables for far
    n-grams, None if the alphabet has none; limits: bits a symbol by language (None: all) and by binary digits of the length."""

    def __init__(self, symbols, size, bits, levels, limits=None):
        self.symbols, self.size, self.bits, self.levels, self.limits = symbols, size, bits, levels, limits
        self._sent = None

    @property
    def joined(self) -> bool:
        return bool(self.levels) and isinstance(self.levels[0][0], DataFrame)

    def sent(self, spark):
        """(symbols, bits, levels unless they are joined), broadcast once: each broadcast is a file in every executor.

        64**4 numbers and, of far n-grams, MOST_GRAMS a level at most."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast((self.symbols, self.bits, None if self.joined else self.levels))
        return self._sent


def _summed(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_symbols and steps: the sum over the text, without far n-grams if those are joined."""
    size = model.size
    sent = model.sent(docs.sparkSession)

    def each(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        symbols, bits, levels = sent.value
        for part in slices(batches, 1 << 20):
            code, off, at, context, symbol = windows_of(pc.fill_null(part.column("text"), "").to_pylist(), symbols)
            own = bits[code]
            if len(at):
                own = own.astype(np.int64)
                own[at] = 0
            if len(at) and levels:
                context, symbol, which, _ = distinct(context, symbol)
                own[at] = far_steps(levels, size, context, symbol)[which]
            total = np.concatenate(([0], np.cumsum(own, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(off)), pa.array(np.diff(total[off]))], names=[*part.schema.names, "n_symbols", "steps"])

    return docs.mapInArrow(each, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes) + ", n_symbols long, steps long")


def _far_sums(docs: DataFrame, model: Model) -> DataFrame:
    """(_key, far): the steps of the far n-grams of each different text that has some, by joins with the levels."""
    import pyarrow as pa

    sent = model.sent(docs.sparkSession)
    kinds = {"_key": pa.string(), "context": pa.int64(), "symbol": pa.int32(), "times": pa.int64()}

    def each(batches):
        import pyarrow.compute as pc

        for part in slices(batches, 1 << 20):
            _, off, at, context, symbol = windows_of(pc.fill_null(part.column("text"), "").to_pylist(), sent.value[0])
            keys, cut = part.column("_key").to_pylist(), np.searchsorted(at, off)
            for t in np.flatnonzero(np.diff(cut)).tolist():
                c, s, _, times = distinct(context[cut[t] : cut[t + 1]], symbol[cut[t] : cut[t + 1]])
                yield from batches_of(kinds, [np.full(len(c), keys[t], dtype=object), c, s, times])

    grams = stored(docs.select("_key", "text").mapInArrow(each, "_key string, context long, symbol int, times long").dropDuplicates(), "quality-far")  # equal texts give equal rows
    told = grams.select("context", "symbol").distinct().withColumn("p", F.lit(1 / model.size))
    for n, (contexts, shares) in enumerate(model.levels, 1):
        if n <= 2:  # a row for each symbol at most
            contexts = F.broadcast(contexts)
        if n == 1:
            shares = F.broadcast(shares)
        told = told.withColumn("own", F.col("context").bitwiseAND(F.lit(mask(n)).cast("long")))
        told = told.join(contexts.withColumnRenamed("context", "own"), "own", "left").join(shares.withColumnRenamed("context", "own"), ["own", "symbol"], "left")
        told = stored(told.select("context", "symbol", (F.coalesce("rest", F.lit(1.0)) * F.col("p") + F.coalesce("share", F.lit(0.0))).alias("p")), "quality-told")
    told = told.select("context", "symbol", F.rint(-F.log2("p") * STEPS).cast("long").alias("steps"))
    return grams.join(told, ["context", "symbol"]).groupBy("_key").agg(F.sum(F.col("times") * F.col("steps")).alias("far"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_symbols and bits (the sum over the text)."""
    if not model.joined:
        return _summed(docs, model).withColumn("bits", F.col("steps") / STEPS).drop("steps")
    docs = docs.withColumn("_key", F.sha2(F.col("text").cast("binary"), 256))
    out = _summed(docs, model).join(_far_sums(docs, model), "_key", "left")
    return out.withColumn("bits", (F.col("steps") + F.coalesce("far", F.lit(0))) / STEPS).drop("_key", "steps", "far")


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the trusted documents, or None if they have no text."""
    ids = trusted_ids(labels)
    trusted = docs.select("doc_id", "text", "lang").join(ids, F.col("doc_id") == ids["trusted_id"], "left_semi").filter("text <> ''")
    spark = docs.sparkSession
    kinds = _kinds()

    def characters(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        seen = Counter()
        for part in slices(batches, 1 << 20):
            points, count = np.unique(points_of(pc.fill_null(part.column("text"), "").to_pylist()), return_counts=True)
            seen.update(dict(zip(points.tolist(), count.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["p", "c"])

    found = trusted.select("text").mapInArrow(characters, "p int, c long").groupBy("p").agg(F.sum("c").alias("c")).collect()  # a row per code point
    if not found:
        return None
    own = sorted((-r["c"], r["p"]) for r in found if kinds[r["p"]] == FIRST)
    size = max(SYMBOLS, FIRST + len(own))
    symbols = np.where(kinds == FIRST, RARE, kinds).astype(np.int32)
    for i, (_, p) in enumerate(own):
        symbols[p] = FIRST + i

    def grams(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = {"context": pa.int64(), "symbol": pa.int32(), "c": pa.int64()}
        seen = np.zeros(SYMBOLS**ORDER, dtype=np.uint32)
        for part in slices(batches, 1 << 20):
            code, _, at, context, symbol = windows_of(pc.fill_null(part.column("text"), "").to_pylist(), symbols)
            code, count = np.unique(code, return_counts=True)
            seen[code] += count.astype(np.uint32)
            if len(at):
                context, symbol, _, count = distinct(context, symbol)
                yield from batches_of(kinds, [context, symbol, count])
        seen[0] = 0  # far ones
        code = np.flatnonzero(seen)
        yield from batches_of(kinds, [code >> 6 & 63 | (code >> 12 & 63) << PLACE | (code >> 18) << 2 * PLACE, code & 63, seen[code].astype(np.int64)])

    counts = stored(trusted.select("text").mapInArrow(grams, "context long, symbol int, c long").groupBy("context", "symbol").agg(F.sum("c").alias("c")), "quality-grams")
    if counts.count() <= MOST_GRAMS:
        seen = counts.toArrow()
        parts = levels_of(*(np.asarray(seen.column(c), dtype=np.int64) for c in ("context", "symbol", "c")))
        levels = searched(parts) if size > SYMBOLS else None
    else:
        levels = level_tables(counts)
        parts = [plain_part(*level) for level in levels]
    model = Model(symbols, size, plain_bits(parts, size), levels if size > SYMBOLS else None)
    del parts
    sizes = trusted.groupBy("lang", digits(F.char_length("text")).alias("k")).count().collect()  # a row for each language and power of two
    groups, number = {}, 0
    for lang in [None, *sorted({r["lang"] for r in sizes} - {None})]:
        own = [0] * BITS
        for r in sizes:
            if lang is None or r["lang"] == lang:
                own[r["k"]] += r["count"]
        if lang is None or sum(own) >= FEW:
            groups[lang] = [number + g for g in banded(own)]
            number = groups[lang][-1] + 1
    # the least rate that QUANTILE of the group's documents don't exceed: exact, so the same in every run
    told = scored(trusted, model).select("lang", F.ceil(F.col("bits") / F.col("n_symbols") * 10_000).alias("rate"), digits(F.col("n_symbols")).alias("k"))
    of = F.array(F.get(_by_language(groups, "array<int>"), F.col("k")), F.get(F.lit(groups[None]), F.col("k")))
    told = told.select("rate", F.explode(F.array_distinct(of)).alias("g")).groupBy("g").agg(F.expr(f"percentile_disc({QUANTILE}) WITHIN GROUP (ORDER BY rate)").alias("limit"))
    found = {r["g"]: r["limit"] / 10_000 for r in told.collect()}  # a row for each group
    model.limits = {lang: [found[g] for g in own] for lang, own in groups.items()}
    trim()
    return model


def judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with n_symbols, perplexity, threshold and kept. Needs the columns text and lang."""
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"n_symbols": F.coalesce(F.char_length("text"), F.lit(0)).cast("long"), "perplexity": none, "threshold": none, "kept": F.coalesce(F.col("text") != "", F.lit(False))})
    rows = scored(docs, model)
    rate = F.when(F.col("n_symbols") > 0, F.col("bits") / F.col("n_symbols"))
    limit = F.get(_by_language(model.limits, "array<double>"), digits(F.col("n_symbols")))
    return rows.withColumns({"perplexity": F.pow(F.lit(2.0), rate), "threshold": F.pow(F.lit(2.0), limit), "kept": F.coalesce(rate <= limit, F.lit(False))}).drop("bits")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept; columns stay as they are."""
    own, restored = hidden(docs, "doc_id", "text", "lang")
    return restored(judged(own, learn(docs, labels)).filter("kept"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the op3 query."""
    return judged(docs.select("doc_id", "text", "lang"), learn(docs, labels)).select("doc_id", "n_symbols", "perplexity", "threshold", "kept")
