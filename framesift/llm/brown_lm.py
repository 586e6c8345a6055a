"""Language-model scores from Brown class bigrams.

Classes are found in two steps of the exchange algorithm, which moves words between
CLASSES classes as long as the likelihood of the class bigrams grows. On the
driver, the TOP most frequent words are symbols of their own and all others share
one of SUFFIXES symbols by their last bytes; the symbols are exchanged until none
moves. Then every other word that occurs at least twice leaves its suffix symbol:
its contexts, how often each class stands before and after it, are summed in
shards by word hash, and it moves to the class that gains most, each word against
the classes that the driver left. So the vocabulary is clustered whole, however large it
is; only the CLASSES x CLASSES table is sent to the shards. A word that is met once, or
never, has the class of its suffix symbol.

A text's probability is the product of smoothed class transitions and of each
word's share of its class, which takes the word's own count over all training text.
Counts and classes of the whole vocabulary live in shards and are never gathered
in one place. A slice of documents asks the shards once for each of its distinct
words but the TOP, which any hot word is among and which are known everywhere. What
is sent to the driver is bounded by TOP, SUFFIXES and CLASSES.

Words are known by 64-bit hashes. P(w|c) = (count - D) / N_c; what is
discounted goes to one unknown word for each class, as add-one smoothing has
one unknown word. P(c|b) = (N_bc + A P(c)) / (N_b + A).

Defined results. A null text is empty: it has the end token alone. A null
doc_id hashes as empty text, so it trains. Rows that repeat are counted and
scored as often as they are there; extra columns are ignored. With no training
rows all words are unknown. Texts are read whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import slices, stored, text_bytes, trim, word_hashes, words_of

TOP, SUFFIXES, CLASSES, ROUNDS = 1024, 511, 64, 6
SYMBOLS = TOP + SUFFIXES + 1
END = SYMBOLS - 1
D, A = 0.5, 4.0
SLICE, CONTEXT_SLICE, SHARD_BYTES, ROWS_OF_BLOCK, FAN = 2 << 20, 8 << 20, 16 << 20, 48, 64
WORDS_AT_ONCE = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def suffix_of(words) -> np.ndarray:
    """Each word's suffix symbol, 0 to SUFFIXES - 1, from its last three bytes."""
    data, off = text_bytes(words)
    data = np.concatenate((np.zeros(3, np.uint8), data)).astype(np.uint64)
    size, end = np.diff(off), off[1:] + 2
    x = np.zeros(len(size), dtype=np.uint64)
    for k in range(3):
        x = x * np.uint64(257) + np.where(size > k, data[np.maximum(end - k, 0)] + np.uint64(1), np.uint64(0))
    with np.errstate(over="ignore"):
        return ((x * _ODD) >> np.uint64(40)).astype(np.int64) % SUFFIXES


def _add(keys: list, counts: list, tails: list):
    """The sums of counts by key."""
    key, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return key, np.bincount(number, weights=np.concatenate(counts)).astype(np.int64), np.concatenate(tails)[first]


def _by_shard(key: np.ndarray, shards: int):
    """(shard, places of its keys), for each shard that has some."""
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], shard[order[1:]] != shard[order[:-1]]))) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(edge, [*edge[1:], len(order)], strict=False):
        yield int(shard[order[a]]), order[a:b]


def _batch(rows, names, kinds):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def vocabulary(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, hashes, counts, tails, n, total, top): a row for each shard; hashes are sorted, top holds its most frequent words."""

    def count(batches):
        import pyarrow as pa

        names, kinds = ["shard", "hashes", "counts", "tails"], [pa.int64(), *[pa.binary()] * 3]
        keys, counts, tails, held = [], [], [], 0

        def out():
            key, c, t = _add(keys, counts, tails)
            return _batch([(s, key[r].tobytes(), c[r].tobytes(), t[r].tobytes()) for s, r in _by_shard(key, shards)], names, kinds)

        for part in slices(batches, SLICE):
            words, code, _ = words_of(part.column(0), lower=True)
            keys.append(word_hashes(words))
            counts.append(np.bincount(code, minlength=len(words)))
            tails.append(suffix_of(words).astype(np.uint16))
            held += len(words)
            if held > 1_500_000:
                keys, counts, tails = ([x] for x in _add(keys, counts, tails))
                held = len(keys[0])
                if held > 750_000:
                    yield out()
                    keys, counts, tails, held = [], [], [], 0
        if held:
            yield out()

    def add(group):
        import pyarrow as pa

        col = lambda n, kind: [np.frombuffer(x, dtype=kind) for x in group.column(n).to_pylist()]
        key, c, t = _add(col("hashes", np.uint64), col("counts", np.int64), col("tails", np.uint16))
        most = np.lexsort((key, -c))[:TOP]
        top = [{"h": int(h), "c": int(n), "t": int(s)} for h, n, s in zip(key[most].view(np.int64), c[most], t[most], strict=True)]
        kinds = [pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("t", pa.int32())]))]
        row = (group.column("shard")[0].as_py(), key.tobytes(), c.tobytes(), t.tobytes(), len(key), int(c.sum()), top)
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["shard", "hashes", "counts", "tails", "n", "total", "top"])

    counted = texts.mapInArrow(count, "shard long, hashes binary, counts binary, tails binary")
    return stored(counted.groupBy("shard").applyInArrow(add, "shard long, hashes binary, counts binary, tails binary, n long, total long, top array<struct<h: long, c: long, t: int>>"), "vocabulary")


def symbols_of(hashes: np.ndarray, tails: np.ndarray, top: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Each word's symbol; top: sorted hashes of the most frequent words, number: their symbols."""
    out = TOP + tails
    if len(top):
        at = np.minimum(np.searchsorted(top, hashes), len(top) - 1)
        out = np.where(top[at] == hashes, number[at], out)
    return out


def with_ends(symbol: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with END after each text, offsets with the ends)."""
    return np.insert(symbol, off[1:], END), off + np.arange(len(off))


def bigrams(texts: DataFrame, top: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Counts of symbol pairs, [before, after]; a text starts after END."""
    blocks = -(-SYMBOLS // ROWS_OF_BLOCK)
    names = ["task", "block", "data"]

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seen = np.zeros(blocks * ROWS_OF_BLOCK * SYMBOLS, dtype=np.int64)
        for part in slices(batches, SLICE):
            words, code, off = words_of(part.column(0), lower=True)
            s, _ = with_ends(symbols_of(word_hashes(words), suffix_of(words), top, number)[code], off)
            seen += np.bincount(np.concatenate(([END], s[:-1])) * SYMBOLS + s, minlength=len(seen))
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        yield _batch([(TaskContext.get().partitionId(), b, pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for b, x in enumerate(seen.reshape(blocks, -1))], names, kinds)

    def add(group):
        import pyarrow as pa

        size = ROWS_OF_BLOCK * SYMBOLS * 8
        total = reduce(np.add, (np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), dtype=np.int64) for x in group.column("data").to_pylist()))
        return pa.table([group.column("task").slice(0, 1), group.column("block").slice(0, 1), pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=names)

    schema = "task long, block int, data binary"
    rows = stored(texts.mapInArrow(count, schema), "bigrams")
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while True:  # FAN tables at a time, so no task holds more
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "block").applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
        rows = stored(rows, "bigrams")
    import pyarrow as pa

    out = np.zeros((blocks, ROWS_OF_BLOCK * SYMBOLS), dtype=np.int64)
    for r in rows.collect():  # SYMBOLS ** 2 numbers, packed
        out[r["block"]] = np.frombuffer(pa.decompress(r["data"], ROWS_OF_BLOCK * SYMBOLS * 8, codec="zstd", asbytes=True), dtype=np.int64)
    return out.reshape(-1, SYMBOLS)[:SYMBOLS]


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS, fixed: int | None = END) -> np.ndarray:
    """Each symbol's class: symbols move to the class that gains most likelihood of class bigrams, until none moves.

    The symbol fixed is class 0 alone. Symbols start by rank of count, dealt over the other classes."""
    n = pairs.shape[0]
    pairs = pairs.astype(np.float64)
    weight = pairs.sum(0) + pairs.sum(1)
    order = [int(s) for s in np.lexsort((np.arange(n), -weight)) if s != fixed]
    base = int(fixed is not None)
    of = np.zeros(n, dtype=np.int64)
    for i, s in enumerate(order):
        of[s] = base + i % (classes - base)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    into, out = member.T @ pairs, pairs @ member  # class before, symbol; symbol, class after
    table = into @ member
    for _ in range(rounds):
        moved = 0
        for s in order:
            if not weight[s]:
                continue
            old, own = of[s], pairs[s, s]
            left, right = into[:, s].copy(), out[s].copy()
            left[old] -= own
            right[old] -= own
            # without s
            table[old, :] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows, cols = table.sum(1), table.sum(0)
            f = _f(table)
            gain = (_f(table + right[None, :]) - f).sum(1) + (_f(table + left[:, None]) - f).sum(0)
            d = np.arange(classes)
            gain -= _f(table[d, d] + right) + _f(table[d, d] + left) - 2 * f[d, d]
            gain += _f(table[d, d] + left + right + own) - f[d, d]
            gain -= _f(rows + right.sum() + own) - _f(rows) + _f(cols + left.sum() + own) - _f(cols)
            gain[:base] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new, :] += right
            table[:, new] += left
            table[new, new] += own
            if new != old:
                moved += 1
                of[s] = new
                into[old] -= pairs[s]
                into[new] += pairs[s]
                out[:, old] -= pairs[:, s]
                out[:, new] += pairs[:, s]
        if not moved:
            break
    return of


class Model:
    """top, number, count: sorted hashes of the most frequent words, their symbols and counts; of: classes of symbols; pairs: the driver's class
    bigrams; size, kinds: tokens and distinct words of each class; tokens, words: N and V; moves: log10 of class transitions."""

    def __init__(self, top, number, count, of, pairs, ends, tokens, words, shards):
        self.top, self.number, self.count, self.of, self.pairs, self.ends = top, number, count, of, pairs, ends
        self.tokens, self.words, self.shards = tokens, words, shards
        self.size = self.kinds = self.moves = None


def _zip(a: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unzip(data: bytes, kind, n: int) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


def contexts(texts: DataFrame, model: Model) -> DataFrame:
    """(shard, hashes, entries, n): for words that aren't among the most frequent, how often each class stands before (slots from 0) and after them (from CLASSES)."""
    m = model

    def count(batches):
        import pyarrow as pa

        for part in slices(batches, CONTEXT_SLICE):
            words, code, off = words_of(part.column(0), lower=True)
            hashes = word_hashes(words)
            symbol = symbols_of(hashes, suffix_of(words), m.top, m.number)
            s, at = with_ends(symbol[code], off)
            c = m.of[s].astype(np.int64)
            rare = np.flatnonzero(s >= TOP)
            rare = rare[s[rare] != END]
            place = np.full(len(s), -1)
            place[np.delete(np.arange(len(s)), at[1:] - 1)] = code
            word = place[rare]
            before = np.where(rare > 0, c[rare - 1], m.of[END])
            key, times = np.unique(np.concatenate((word * (2 * CLASSES) + before, word * (2 * CLASSES) + CLASSES + c[rare + 1])), return_counts=True)
            word, slot = key // (2 * CLASSES), key % (2 * CLASSES)
            rows = []
            for shard, r in _by_shard(hashes[word], m.shards):
                used, number = np.unique(word[r], return_inverse=True)
                order = np.argsort(number, kind="stable")
                parts = (np.bincount(number).astype(np.uint32), slot[r][order].astype(np.uint8), np.minimum(times[r][order], 2**32 - 1).astype(np.uint32))
                rows.append((shard, hashes[used].tobytes(), b"".join(_size(z := _zip(x)) + z for x in parts), len(r)))
            yield _batch(rows, ["shard", "hashes", "entries", "n"], [pa.int64(), pa.binary(), pa.binary(), pa.int64()])

    return texts.mapInArrow(count, "shard long, hashes binary, entries binary, n long")


def _size(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little")


def _entries(hashes: bytes, data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, slot, count) of each entry of a row of contexts()."""
    own, parts, at = np.frombuffer(hashes, dtype=np.uint64), [], 0
    for kind, k in ((np.uint32, len(own)), (np.uint8, n), (np.uint32, n)):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(_unzip(data[at + 8 : at + 8 + size], kind, k))
        at += 8 + size
    return np.repeat(own, parts[0]), parts[1], parts[2]


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, pairs: np.ndarray, fixed: int) -> np.ndarray:
    """The class that each word gains most likelihood in: left and right are its counts of classes before and after it, own is the class it is in.

    The gain of a word in a class is, to first order, the sum of log N_bc over its contexts less its count times the logs of the class's totals;
    in its own class the word itself is taken out first. The fixed class takes none."""
    table = pairs + 0.5
    rows, cols = np.log(table.sum(1)), np.log(table.sum(0))
    n = left.sum(1)
    gain = left @ np.log(table) + right @ np.log(table).T - n[:, None] * (rows + cols)[None, :]
    i = np.arange(len(own))
    lone_left, lone_right = np.maximum(pairs[:, own].T - left, 0) + 0.5, np.maximum(pairs[own] - right, 0) + 0.5
    gain[i, own] = (left * np.log(lone_left)).sum(1) + (right * np.log(lone_right)).sum(1) - n * (np.log(lone_left.sum(1)) + np.log(lone_right.sum(1)))
    gain[:, fixed] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[i, best] > gain[i, own] + 1e-9, best, own)


def with_classes(words: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    """The vocabulary's shards with the class of each word: (shard, hashes, counts, classes, by_class)."""
    m = model
    top_class = m.of[m.number] if len(m.top) else np.zeros(0, np.int64)

    def assign(group):
        import pyarrow as pa

        col = {x: group.column(x).to_pylist() for x in group.schema.names}
        base = col["kind"].index(0) if 0 in col["kind"] else -1
        if base < 0:
            return pa.table({"shard": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary()), "counts": pa.array([], pa.binary()), "classes": pa.array([], pa.binary()), "by_class": pa.array([], pa.list_(pa.struct([("c", pa.int32()), ("tokens", pa.int64()), ("kinds", pa.int64())])))})
        hashes, counts, tails = (np.frombuffer(col[x][base], dtype=k) for x, k in (("hashes", np.uint64), ("counts", np.int64), ("entries", np.uint16)))
        own = m.of[symbols_of(hashes, tails.astype(np.int64), m.top, m.number)].astype(np.int64)
        frequent = np.zeros(len(hashes), dtype=bool)
        if len(m.top):
            at = np.minimum(np.searchsorted(m.top, hashes), len(m.top) - 1)
            frequent = m.top[at] == hashes
            own = np.where(frequent, top_class[at], own)
        got = [_entries(h, e, n) for k, h, e, n in zip(col["kind"], col["hashes"], col["entries"], col["n"], strict=True) if k == 1]
        if got:
            key, slot, times = (np.concatenate(x) for x in zip(*got, strict=True))
            number = np.searchsorted(hashes, key)
            cell = number * (2 * CLASSES) + slot
            order = np.argsort(cell, kind="stable")
            cell, times = cell[order], times[order].astype(np.float64)
            for a in range(0, len(hashes), WORDS_AT_ONCE):
                b = min(len(hashes), a + WORDS_AT_ONCE)
                lo, hi = np.searchsorted(cell, [a * 2 * CLASSES, b * 2 * CLASSES])
                seen = np.bincount(cell[lo:hi] - a * 2 * CLASSES, weights=times[lo:hi], minlength=(b - a) * 2 * CLASSES).reshape(b - a, 2 * CLASSES)
                move = np.flatnonzero((counts[a:b] > 1) & ~frequent[a:b])
                own[a + move] = best_classes(seen[move, :CLASSES], seen[move, CLASSES:], own[a + move], m.pairs, int(m.of[END]))
        sums, kinds = np.bincount(own, weights=counts, minlength=CLASSES).astype(np.int64), np.bincount(own, minlength=CLASSES)
        by_class = [{"c": i, "tokens": int(t), "kinds": int(k)} for i, (t, k) in enumerate(zip(sums, kinds, strict=True))]
        trim()
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "hashes": pa.array([hashes.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "classes": pa.array([own.astype(np.uint8).tobytes()], pa.binary()), "by_class": pa.array([by_class], pa.list_(pa.struct([("c", pa.int32()), ("tokens", pa.int64()), ("kinds", pa.int64())])))})

    none = F.lit(None).cast("binary")
    rows = words.select("shard", F.lit(0).alias("kind"), "hashes", "counts", F.col("tails").alias("entries"), F.lit(0).cast("long").alias("n"))
    rows = rows.unionByName(told.select("shard", F.lit(1).alias("kind"), "hashes", none.alias("counts"), "entries", "n"))
    return stored(rows.groupBy("shard").applyInArrow(assign, "shard long, hashes binary, counts binary, classes binary, by_class array<struct<c: int, tokens: long, kinds: long>>"), "classes")


def learn(docs: DataFrame, training: Column, most: int = TOP) -> tuple[Model, DataFrame]:
    """The model of the texts that training selects, but for its transitions, and the sharded vocabulary with counts and classes. most: symbols of their own, TOP at most."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    texts = docs.filter(training).select("text")
    words = vocabulary(texts, shards)
    sums = words.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    frequent = words.select(F.explode("top").alias("w")).select("w.*").orderBy(F.desc("c"), "h").limit(most).collect()  # TOP rows
    hashes = np.array([r["h"] for r in frequent], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    top, number, count = hashes[order], order.astype(np.int64), np.array([r["c"] for r in frequent], dtype=np.int64)[order]
    pairs = bigrams(texts, top, number)
    of = exchange(pairs)
    member = np.zeros((SYMBOLS, CLASSES))
    member[np.arange(SYMBOLS), of] = 1
    ends = int(pairs[:, END].sum())
    model = Model(top, number, count, of, member.T @ pairs @ member, ends, (sums["total"] or 0) + ends, (sums["n"] or 0) + (ends > 0), shards)
    words = with_classes(words, contexts(texts, model), model)
    model.size, model.kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.select(F.explode("by_class").alias("x")).groupBy("x.c").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.kinds").alias("kinds")).collect():  # CLASSES rows
        model.size[r["c"]], model.kinds[r["c"]] = r["tokens"], r["kinds"]
    model.size[of[END]] += ends
    model.kinds[of[END]] += ends > 0
    return model, words


CODED = "held_out boolean, n_tokens long, n_known long, base_score double, own double, classes binary"


def coded(docs: DataFrame, model: Model, words: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, CODED), a row for each document: its classes, a byte for each token, and what doesn't depend on transitions: counts of known words,
    the base score, and the sum of its words' shares of their classes."""
    m = model
    kind = dict(docs.dtypes)["doc_id"]
    unknown = np.where(m.size > 0, np.log10(D * np.maximum(m.kinds, 1)) - np.log10(np.maximum(m.size, 1)), 0.0)
    size = np.log10(np.maximum(m.size, 1))
    add_one = float(np.log10(m.tokens + m.words + 1))
    ends, end_class = m.ends, int(m.of[END])
    end_own = float(np.log10(ends - D) - size[end_class]) if ends else 0.0
    names, kinds = ["shard", "part", "kind", "a", "b", "n", "k"], "shard long, part long, kind int, a binary, b binary, n long, k long"
    top_class = m.of[m.number].astype(np.int64) if len(m.top) else np.zeros(0, np.int64)

    def types():
        import pyarrow as pa

        return [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def ask(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part_no = TaskContext.get().partitionId() << 32
        for part in slices(batches, SLICE):
            part_no += 1
            words, code, off = words_of(part.column("text"), lower=True)
            hashes, tail = word_hashes(words), suffix_of(words)
            place = np.full(len(words), -1, dtype=np.int16)
            if len(m.top):
                at = np.minimum(np.searchsorted(m.top, hashes), len(m.top) - 1)
                place = np.where(m.top[at] == hashes, at, -1).astype(np.int16)
            ids = pa.BufferOutputStream()
            table = pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(off))], names=["doc_id", "held_out", "n_words"])
            with pa.ipc.new_stream(ids, table.schema) as w:
                w.write_batch(table)
            local = [_zip(code.astype(np.uint32)), _zip(place), _zip(m.of[TOP + tail].astype(np.uint8)), ids.getvalue().to_pybytes()]
            rows = [(part_no % m.shards, part_no, 0, b"".join(_size(x) + x for x in local), None, len(code), len(words))]
            rare = np.flatnonzero(place < 0)
            for shard, r in _by_shard(hashes[rare], m.shards):
                rows.append((shard, part_no, 1, hashes[rare[r]].tobytes(), _zip(rare[r].astype(np.uint32)), len(r), 0))
            yield _batch(rows, names, types())

    def look_up(group):
        import pyarrow as pa

        col = {x: group.column(x).to_pylist() for x in names}
        hashes, counts, classes, out = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), []
        for i, k in enumerate(col["kind"]):
            if k == 2:
                hashes = np.frombuffer(col["a"][i], dtype=np.uint64)
                counts, classes = np.frombuffer(col["b"][i], dtype=np.int64, count=len(hashes)), np.frombuffer(col["b"][i], dtype=np.uint8, offset=8 * len(hashes))
        for i, k in enumerate(col["kind"]):
            if k == 0:
                out.append((0, col["part"][i], 0, col["a"][i], None, col["n"][i], col["k"][i]))
            elif k == 1 and len(hashes):
                own = np.frombuffer(col["a"][i], dtype=np.uint64)
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                hit = hashes[at] == own
                number = _unzip(col["b"][i], np.uint32, len(own))[hit]
                told = [_zip(number), _zip(counts[at[hit]]), _zip(classes[at[hit]])]
                out.append((0, col["part"][i], 1, b"".join(_size(x) + x for x in told), None, len(number), 0))
        trim()
        return pa.Table.from_batches([_batch(out, names, types())])

    def cut(data: bytes) -> list[bytes]:
        out, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            out.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        return out

    def assemble(group):
        import pyarrow as pa

        col = {x: group.column(x).to_pylist() for x in names}
        i = col["kind"].index(0)
        parts, n, k = cut(col["a"][i]), col["n"][i], col["k"][i]
        code, place, cl = _unzip(parts[0], np.uint32, n).astype(np.int64), _unzip(parts[1], np.int16, k), _unzip(parts[2], np.uint8, k).astype(np.int64)
        docs = pa.ipc.open_stream(parts[3]).read_all()
        count = np.zeros(k, dtype=np.int64)
        if (top := place >= 0).any():
            count[top], cl[top] = m.count[place[top]], top_class[place[top]]
        for j, kind_ in enumerate(col["kind"]):
            if kind_ == 1:
                got, n_got = cut(col["a"][j]), col["n"][j]
                number = _unzip(got[0], np.uint32, n_got)
                count[number], cl[number] = _unzip(got[1], np.int64, n_got), _unzip(got[2], np.uint8, n_got)
        own = np.where(count > 0, np.log10(np.maximum(count - D, D)) - size[cl], unknown[cl])
        n_words = np.asarray(docs.column("n_words"), dtype=np.int64)
        off = np.concatenate(([0], np.cumsum(n_words)))
        total = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x[code])))[off])
        known, base, shares = total((count > 0).astype(np.float64)), total(np.log10(count + 1.0) - add_one), total(own)
        seq = np.insert(cl[code].astype(np.uint8), off[1:], end_class).tobytes()
        at = off + np.arange(len(off))
        blobs = [seq[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        known = np.rint(known).astype(np.int64) + (ends > 0)
        columns = [docs.column("doc_id"), docs.column("held_out"), pa.array(n_words + 1), pa.array(known), pa.array(base + np.log10(ends + 1) - add_one), pa.array(shares + end_own), pa.array(blobs, pa.binary())]
        return pa.table(columns, names=["doc_id", *(x.split()[0] for x in CODED.split(", "))])

    asked = docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(ask, kinds)
    known = words.select("shard", F.lit(0).cast("long").alias("part"), F.lit(2).alias("kind"), F.col("hashes").alias("a"), F.concat("counts", "classes").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    told = asked.unionByName(known).groupBy("shard").applyInArrow(look_up, kinds)
    return stored(told.groupBy("part").applyInArrow(assemble, f"doc_id {kind}, {CODED}"), "coded")


def class_bigrams(rows: DataFrame, end_class: int) -> np.ndarray:
    """Counts of class pairs [before, after] over the texts of coded() rows that aren't held out."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        seen = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for part in slices(batches, SLICE, "classes"):
            own = part.filter(pc.invert(part.column("held_out")))
            if own.num_rows:
                c = np.frombuffer(b"".join(own.column("classes").to_pylist()), dtype=np.uint8).astype(np.int64)
                seen += np.bincount(np.concatenate(([end_class], c[:-1])) * CLASSES + c, minlength=len(seen))  # a text starts after the end of one
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["pair", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for r in rows.select("held_out", "classes").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # CLASSES ** 2 rows
        out[r["pair"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), smoothed."""
    size = table.sum(0)
    prior = (size + 1) / (size.sum() + CLASSES)
    return np.log10((table + A * prior[None, :]) / (table.sum(1)[:, None] + A))


def scored(docs: DataFrame, model: Model, words: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Fills in the model's transitions, which come from the rows that aren't held out."""
    rows = coded(docs, model, words, held_out)
    end_class, tokens = int(model.of[END]), model.tokens
    moves = model.moves = transitions(class_bigrams(rows, end_class))

    def each(batches):
        import pyarrow as pa

        for part in slices(batches, SLICE, "classes"):
            blobs = part.column("classes").to_pylist()
            c = np.frombuffer(b"".join(blobs), dtype=np.uint8).astype(np.int64)
            off = np.concatenate(([0], np.cumsum([len(x) for x in blobs])))
            sums = np.concatenate(([0.0], np.cumsum(moves[np.concatenate(([end_class], c[:-1])), c])))
            score = np.asarray(part.column("own")) + np.diff(sums[off])
            columns = [part.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")] + [pa.array(np.full(len(blobs), tokens)), part.column("base_score"), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def digest(docs: DataFrame, held_out: Column) -> DataFrame:
    """The columns of the op2 query."""
    docs = docs.select("doc_id", "text")
    model, words = learn(docs, ~held_out)
    return scored(docs, model, words, held_out)
