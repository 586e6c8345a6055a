"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A document is parsed
against each automaton into longest matches; the language that needs the
fewest phrases for each symbol wins. All automata's edges are one hash table, and
all blocks of many documents step through it together. The phrases are those of
the whole text: blocks of BLOCK symbols are parsed as if each began a text, then
the parse of the block before goes on into each until a phrase of both begins at
the same symbol, from where on they are one.

Symbols are lower-cased letters, and every letter of the training text has its
own, in any script; any run of other characters is one separator.
The labelled text of a language is a bounded sample: about SAMPLE_PIECES pieces
of PIECE characters, drawn by a hash of text and place from all over the
different labelled texts, so that long documents and their ends teach as much as
heads and copies no more than one of them. Every piece that is drawn trains.

Defined results. A text that is null or has no letter is 'und' with score 0,
and so is every text when nothing was learned. Ties go to the first language in
text order, with score 0. Each row is judged by itself, so repeated rows get
equal results; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import slices

BLOCK = 256
SAMPLE_PIECES, PIECE = 100, 500
PAD, GAP, OTHER, FIRST = 0, 1, 2, 3
POINTS = 0x32400  # letters end before
SYMBOL_BITS = 18  # an edge's key is its state, then its symbol
EDGE = np.dtype([("key", np.int64), ("to", np.int32)], align=True)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def edges_of(text: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(state and symbol of each edge as one number, its target, count of states) of a symbol list's suffix automaton; state 0 is the start."""
    follow, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    n = sum(map(len, follow))
    key = np.fromiter((s << SYMBOL_BITS | c for s, edges in enumerate(follow) for c in edges), np.int64, n)
    return key, np.fromiter((t for edges in follow for t in edges.values()), np.int64, n), len(follow)


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * _ODD) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def hashed(key: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The edges in open addressing, key -1 for an empty slot; at most half are full."""
    table = np.zeros(1 << max(4, (2 * len(key)).bit_length()), dtype=EDGE)
    table["key"] = -1
    slot = _slots(key, len(table))
    while len(key):
        free = np.flatnonzero(table["key"][slot] < 0)
        _, first = np.unique(slot[free], return_index=True)
        free = free[first]
        table["key"][slot[free]], table["to"][slot[free]] = key[free], target[free]
        left = np.ones(len(key), dtype=bool)
        left[free] = False
        slot, key, target = (slot[left] + 1) & (len(table) - 1), key[left], target[left]
    return table


def automaton(text: list[int]) -> np.ndarray:
    """The hashed edges of a symbol list's suffix automaton."""
    key, target, _ = edges_of(text)
    return hashed(key, target)


def follow_edges(table: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Where each state goes by its symbol, 0 if nowhere: the start of the first automaton is nobody's target."""
    key = state << SYMBOL_BITS | symbol
    slot = _slots(key, len(table))
    edge = table[slot]
    hit = edge["key"] == key
    out = np.where(hit, edge["to"], 0).astype(np.int64)
    left = np.flatnonzero(~hit.ravel() & (edge["key"].ravel() >= 0))
    key, slot = key.ravel()[left], slot.ravel()[left]
    flat = out.reshape(-1)
    while len(left):
        slot = (slot + 1) & (len(table) - 1)
        edge = table[slot]
        hit = edge["key"] == key
        flat[left[hit]] = edge["to"][hit]
        more = ~hit & (edge["key"] >= 0)
        left, key, slot = left[more], key[more], slot[more]
    return out


@cache
def _lowered() -> np.ndarray:
    """Each code point's lower-case letter, -1 if it is no letter."""
    return np.fromiter((ord(c.lower()[:1]) if (c := chr(p)).isalpha() else -1 for p in range(POINTS)), np.int32, POINTS)


def symbol_table(texts: list[str]) -> np.ndarray:
    """Symbol of each code point: every letter of the texts has its own."""
    low = _lowered()
    points = np.unique(np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), POINTS - 1))
    letters = np.unique(low[points][low[points] >= 0])
    own = np.full(POINTS, OTHER, dtype=np.int32)
    own[letters] = FIRST + np.arange(len(letters))
    return np.where(low >= 0, own[low], GAP).astype(np.int32)


def symbols_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, number of the text) of all texts, runs of separators as one."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    symbols = table[np.minimum(points, len(table) - 1)]
    again = np.zeros(len(symbols), dtype=bool)
    again[1:] = (symbols[1:] == GAP) & (symbols[:-1] == GAP) & (doc[1:] == doc[:-1])
    return symbols[~again], doc[~again]


def phrases(symbols: np.ndarray, doc: np.ndarray, n: int, table: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Phrases of each text for each language: [language, text]. table: all languages' hashed edges; roots: their start states.

    A phrase begins at a symbol that doesn't prolong the one before, and after a symbol that was never seen."""
    if not len(symbols):
        return np.zeros((len(roots), n), dtype=np.int64)
    first = np.searchsorted(doc, np.arange(n))
    place = np.arange(len(doc)) - first[doc]
    size = np.bincount(doc, minlength=n)
    base = np.concatenate(([0], np.cumsum(-(-size // BLOCK))))
    block = base[doc] + place // BLOCK
    grid = np.full((BLOCK, base[-1]), PAD, dtype=np.int32)
    grid[place % BLOCK, block] = symbols
    start = roots[:, None].astype(np.int64)
    opens = follow_edges(table, start, np.arange(int(symbols.max()) + 1, dtype=np.int64)[None, :])  # from the start, by symbol
    opens = np.where(opens == 0, start, opens)
    length = np.bincount(block, minlength=base[-1])
    order = np.argsort(-length, kind="stable")  # long blocks first: those that have ended stay as they are
    alive = np.searchsorted(-length[order], -np.arange(BLOCK))
    grid = np.ascontiguousarray(grid[:, order])
    state = np.broadcast_to(start, (len(roots), base[-1])).copy()
    begins = np.zeros((BLOCK, len(roots), base[-1]), dtype=bool)
    for step in range(BLOCK):
        m = alive[step]
        if not m:
            break
        c, now = grid[step, :m], state[:, :m]
        go = follow_edges(table, now, c[None, :].astype(np.int64))
        begins[step, :, :m] = (go == 0) | (now == start)
        state[:, :m] = np.where(go == 0, opens[:, c], go)
    count = begins.sum(axis=0, dtype=np.int64)
    column = np.empty(base[-1], dtype=np.int64)
    column[order] = np.arange(base[-1])
    inner = np.ones(base[-1], dtype=bool)
    inner[base[:-1][size > 0]] = False
    after = np.flatnonzero(inner)  # blocks that go on with a text, by number
    lang, at = (x.ravel() for x in np.meshgrid(np.arange(len(roots)), after, indexing="ij"))
    last = np.ones(base[-1] + 1, dtype=bool)
    last[:-1] = ~inner
    spec = state[:, column]  # the state behind each block's own parse, by number
    came, own = spec.copy(), count[:, column]
    grid, begins = grid[:, column], begins[:, :, column]
    known, contents, again = {}, {}, False
    while len(at):  # again only for blocks that the parse now comes into in another state
        state = came[lang, at - 1]
        if not again:
            own[lang, at], out, met = _carry(table, grid, begins, length, opens, start[:, 0], lang, at, state)
        else:  # a periodic text goes through equal blocks in equal states over and over: each case is parsed once
            keys = [(g, s, contents.setdefault(grid[:, b].tobytes(), b)) for g, s, b in zip(lang.tolist(), state.tolist(), at.tolist(), strict=True)]
            if new := sorted({k for k in keys if k not in known}):
                g, s, b = (np.array(x) for x in zip(*new, strict=True))
                known.update(zip(new, zip(*(x.tolist() for x in _carry(table, grid, begins, length, opens, start[:, 0], g, b, s)), strict=True), strict=True))
            own[lang, at], out, met = (np.array(x) for x in zip(*(known[k] for k in keys), strict=True))
        again = True
        out = np.where(met, spec[lang, at], out)
        more = (out != came[lang, at]) & ~last[at + 1]
        came[lang, at] = out
        lang, at = lang[more], at[more] + 1
    owner = np.repeat(np.arange(n), np.diff(base))
    return np.stack([np.bincount(owner, weights=x, minlength=n) for x in own]).astype(np.int64)


def _carry(table, grid, begins, length, opens, start, lang, at, state):
    """(phrases that begin in each block (lang, at), the state behind it, whether its own parse was met) if the parse comes in with state."""
    n, total, met = len(at), np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
    state, live = state.copy(), np.arange(n)
    for step in range(grid.shape[0]):
        live = live[length[at[live]] > step]
        if not len(live):
            break
        g, b, now = lang[live], at[live], state[live]
        c = grid[step, b]
        go = follow_edges(table, now, c.astype(np.int64))
        new = (go == 0) | (now == start[g])
        same = new & begins[step, g, b]
        total[live] += new & ~same
        if same.any():
            hit = live[same]
            total[hit] += begins[step:, lang[hit], at[hit]].sum(axis=0)
            met[hit] = True
        state[live] = np.where(go == 0, opens[g, c], go)
        live = live[~same]
    return total, state, met


def sample(rows: DataFrame, counts: dict) -> list[tuple[str, int, str]]:
    """(lang, hash, piece) of about SAMPLE_PIECES pieces of each language; counts: how many it has."""
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, (SAMPLE_PIECES << 30) // max(n, 1)))).otherwise(share)
    places = F.sequence(F.lit(0), F.ceil(F.char_length("text") / PIECE).cast("int") - 1)

    def draw(i):
        return F.pmod(F.xxhash64(F.lit("sample"), "text", i), F.lit(1 << 30))

    drawn = rows.filter("text <> ''").withColumn("share", share).select("lang", "text", F.explode(F.filter(places, lambda i: draw(i) < F.col("share"))).alias("i"))
    return [(r["lang"], r["k"], r["t"]) for r in drawn.select("lang", draw(F.col("i")).alias("k"), F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("t")).distinct().collect()]


def learn(docs: DataFrame, training: Column | None = None):
    """(languages, hashed edges, start states, symbol table) from the rows of (doc_id, text, lang) that training selects and that have a lang."""
    rows = docs.filter("lang is not null and text is not null")
    rows = rows.filter(training) if training is not None else rows
    pieces = rows.select("lang", F.xxhash64("text"), F.ceil(F.char_length("text") / PIECE).alias("n")).distinct()
    counts = {r["lang"]: r["n"] for r in pieces.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    if not counts:
        return [], hashed(np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64), symbol_table([])
    got = sorted(sample(rows, counts))
    table = symbol_table([t for _, _, t in got])
    languages = sorted({x[0] for x in got})
    keys, targets, roots, at = [], [], [], 0
    for lang in languages:
        symbols, _ = symbols_of([t + " " for x, _, t in got if x == lang], table)
        key, target, states = edges_of(symbols.tolist())
        roots.append(at)
        keys.append(key + (at << SYMBOL_BITS))
        targets.append(target + at)
        at += states
    return languages, hashed(np.concatenate(keys), np.concatenate(targets)), np.array(roots), table


def predict(docs: DataFrame, model, keep=()) -> DataFrame:
    """(doc_id, keep..., lang_pred, score); score is how many phrases less than the second language the first needs, as a share."""
    languages, edges, roots, table = model
    sent = docs.sparkSession.sparkContext.broadcast((edges, roots, table))  # bounded: SAMPLE_PIECES for each language

    def each(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        edges, roots, table = sent.value
        for part in slices(batches, 2 << 20, "_text"):
            texts = pc.fill_null(part.column("_text"), "").to_pylist()
            n = len(texts)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if languages:
                symbols, doc = symbols_of(texts, table)
                rate = phrases(symbols, doc, n, edges, roots) / np.maximum(np.bincount(doc, minlength=n), 1)
                best = rate.argmin(axis=0)
                if len(languages) > 1:
                    low = np.sort(rate, axis=0)[:2]
                    score = np.where(low[1] > 0, (low[1] - low[0]) / np.maximum(low[1], 1e-9), 0)
                else:
                    score = np.ones(n)
            known = [bool(languages) and x for x in part.column("_lettered").to_pylist()]
            names = [languages[b] if k else "und" for b, k in zip(best.tolist(), known, strict=True)]
            rest = [part.column(i) for i in range(len(keep) + 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], names=["doc_id", *keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *keep)) + ", lang_pred string, score double"
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    return docs.select("doc_id", *keep, F.col("text").alias("_text"), lettered).mapInArrow(each, schema)
