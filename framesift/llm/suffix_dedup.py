"""Exact removal of repeated byte strings over a whole corpus.

A byte goes if a WINDOW-byte string that covers it also starts earlier: in a
smaller doc_id, or earlier in the same document; judged on the input.

Suffixes are dealt to shards by content: of every WINDOW-byte string the gram
of GRAM bytes with the least hash is its anchor, so equal strings have equal
anchors and meet in one shard. Neighbouring strings share anchors, so a run of
them travels once, as its bytes. A run that repeats within a task is judged
there, so a passage that millions of documents share is sent once a task, not
once a document.

A line that very many documents hold between different neighbours is the anchor of
as many different runs. Anchors whose runs would fill half a shard (or a
hundred-thousandth of the corpus, if that is more) are found on a sample of
documents; a sample is enough, as it changes only how windows are dealt out. Windows
of such anchors travel one by one, dealt by their own 128-bit fingerprints, so
they spread over all shards.

A shard is a logarithmic family of indexes. Batches come in document order;
each becomes a sorted array of its suffixes (cut at WINDOW bytes, ordered by a
64-bit fingerprint of these bytes), is merge-scanned against the levels there
are, and what was new becomes a level; levels of like size are merged, so each
suffix is merged a logarithmic number of times. Suffixes that the scan finds equal
are compared byte by byte with the earlier one; if a fingerprint ever told two
different strings equal, the shard is judged again by its bytes alone. Windows of
hot anchors are told apart by 128 bits: one error in 10**10 for 10**14 of them.

Defined results. A null text is empty: nothing is removed. Rows that repeat
both id and text are one document, reported as often as it is there; rows that
repeat an id with different texts are ordered by a hash of the text, and a null
id stands before all others. Extra columns are ignored. Texts of any length
are read in overlapping pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import hidden, maybe_broadcast, mix64, slices, stored, text_bytes, trim

WINDOW, GRAM = 100, 32
SLICE, PIECE, SHARD_BYTES, BATCH = 1 << 20, 1 << 20, 8 << 20, 10_000
SAMPLE, MOST_HOT = 32, 100_000  # every SAMPLE-th document by hash tells the hot anchors; at most some MOST_HOT are, a few times that by chance
MOST_CUTS = 20_000_000  # bytes of cuts that are broadcast; beyond it the join shuffles
_ODD = 0x9E3779B97F4A7C15
_LEAST = -(1 << 63)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_ODD, n, 1 << 64))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def gram_hashes(data: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of the strings of 1, 2, 4 ... longest bytes at each place; the last longest - 1 places hash what isn't there as zeros."""
    h = np.concatenate((_BYTES[data], np.zeros(longest, np.uint64)))
    out, n = {1: h}, 1
    while n < longest:
        h = h * _power(n)
        h[:-n] += out[n][n:]
        n *= 2
        out[n] = h
        if n not in (8, 64):  # only what joined() and the anchors need
            out.pop(n // 2, None) if n // 2 not in (4, 32) else None
    return out


def window_hashes(h: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Fingerprints of the WINDOW = 64 + 32 + 4 bytes from each place."""
    return mix64((h[64][at] * _power(32) + h[32][at + 64]) * _power(4) + h[4][at + 96])


def anchored_runs(h32: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of the runs of windows that share an anchor; windows end within their piece."""
    bits = np.uint64(max(n, 1).bit_length())
    place = np.arange(n, dtype=np.uint64)
    v = ((mix64(h32[:n]) >> bits) << bits) | place
    m, width = v, 1
    while width * 2 <= WINDOW - GRAM + 1:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = WINDOW - GRAM + 1 - width
    if rest:
        m = np.minimum(m[:-rest], m[rest:])
    valid = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3
    anchor = (m[valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return valid[first], np.diff(np.append(first, len(valid))), anchor[first]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs, one run after another."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    return np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])


class Levels:
    """The logarithmic index family of one shard: sorted arrays of fingerprints of suffixes that came before, with their places."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the batch's suffixes, given in order, came before; the place of the first of the same key); the others are indexed."""
        fresh, first, number = np.unique(keys, return_index=True, return_inverse=True)
        seen, where = np.zeros(len(fresh), dtype=bool), place[first]
        for level, there in self.levels:
            at = np.minimum(np.searchsorted(level, fresh), len(level) - 1)
            hit = level[at] == fresh
            seen |= hit
            where[hit] = there[at[hit]]
        before = np.ones(len(keys), dtype=bool)
        before[first[~seen]] = False
        new, there = fresh[~seen], where[~seen]
        while len(new) and self.levels and len(self.levels[-1][0]) < 2 * len(new):
            old, old_there = self.levels.pop()
            new, there = np.concatenate((old, new)), np.concatenate((old_there, there))
            order = np.argsort(new, kind="stable")
            new, there = new[order], there[order]
        if len(new):
            self.levels.append((new, there))
        return before, where[number]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the WINDOW bytes from each place of a are those from the place of b. Where both go on by one, only the last byte is new."""
    if not len(a):
        return True
    head = np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1)))
    if (data[a + (WINDOW - 1)] != data[b + (WINDOW - 1)]).any():
        return False
    a, b = a[head], b[head]
    return not any((data[a + k] != data[b + k]).any() for k in range(WINDOW - 1))


def second_hashes(context: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of the WINDOW bytes from each place, of another kind than window_hashes()."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(0, WINDOW, 4):
        four = context[at + k].astype(np.uint64) | context[at + k + 1].astype(np.uint64) << np.uint64(8) | context[at + k + 2].astype(np.uint64) << np.uint64(16) | context[at + k + 3].astype(np.uint64) << np.uint64(24)
        out = mix64(out ^ four) + np.uint64(_ODD)
    return out


def _pack(a: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind, n: int) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


ROWS = "shard long, docs binary, n_docs long, runs binary, n long, bytes binary, n_bytes long, before binary, n_before long, singles binary, n_singles long"
RUN = np.dtype([("doc", "<u4"), ("lo", "<u4"), ("n", "u1"), ("anchor", "u1")])
SINGLE = np.dtype([("key", "<u8"), ("second", "<u8"), ("doc", "<u4"), ("lo", "<u4")])
BEFORE = np.dtype([("id", "<i8"), ("tie", "<i8"), ("lo", "<i8"), ("hi", "<i8")])


def _told(ids, ties, lo, hi) -> np.ndarray:
    out = np.empty(len(lo), dtype=BEFORE)
    out["id"], out["tie"], out["lo"], out["hi"] = ids, ties, lo, hi
    return out


def index_slice(ids: np.ndarray, ties: np.ndarray, texts, shards: int, hot: np.ndarray | None = None):
    """Rows of ROWS for one slice of documents. hot: sorted hashes of hot anchors."""
    order = np.lexsort((ties, ids))
    ids, ties = ids[order], ties[order]
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    ids, ties = ids[keep], ties[keep]
    import pyarrow as pa

    data, off = text_bytes(texts.take(pa.array(order[keep])))
    # Pieces: texts, the long ones cut so that each window lies in one piece.
    docs, begin, base, size = [], [], [], []
    for d in range(len(ids)):
        n, at = int(off[d + 1] - off[d]), 0
        while at == 0 or at + WINDOW <= n:
            docs.append(d)
            begin.append(int(off[d]) + at)
            base.append(at)
            size.append(min(n - at, PIECE + WINDOW - 1))
            at += PIECE
    begin, size, docs, base = (np.array(x, dtype=np.int64) for x in (begin, size, docs, base))
    if len(docs) > len(ids):
        data = data[ranges(begin, size)]
    step = max(1, int(np.searchsorted(np.cumsum(size), 2 * SLICE)))
    for p in range(0, len(docs), step):  # one turn, but for long texts
        own = slice(p, p + step)
        at = np.concatenate(([0], np.cumsum(size[own])))
        start = int(size[:p].sum())
        yield from _index_pieces(data[start : start + at[-1]], at, docs[own], base[own], ids, ties, shards, hot)


def runs_of(data: np.ndarray, at: np.ndarray, n: int | None = None):
    """(hashes, first window, number of windows, anchor, number of the first run of the same content) of the runs in pieces at[:-1]:at[1:]."""
    h = gram_hashes(data, 64)
    lo, count, anchor = anchored_runs(h[32], np.repeat(at[1:], np.diff(at)), len(data))
    if not len(lo):
        return h, lo, count, anchor, lo
    mark = mix64(window_hashes(h, lo) * np.uint64(_ODD) + window_hashes(h, lo + count - 1) + (count * 128 + anchor - lo).astype(np.uint64))
    _, first, number = np.unique(mark, return_index=True, return_inverse=True)  # runs are in document order
    first = first[number]
    again = np.flatnonzero(first != np.arange(len(lo)))
    # a mark is trusted only where the bytes are the same
    alike = (count[again] == count[first[again]]) & (anchor[again] - lo[again] == anchor[first[again]] - lo[first[again]])
    size = np.where(alike, count[again] + WINDOW - 1, 0)
    other = data[ranges(lo[again], size)] != data[ranges(lo[first[again]], size)]
    wrong = ~alike
    wrong[np.repeat(np.arange(len(again)), size)[other]] = True
    first[again[wrong]] = again[wrong]
    return h, lo, count, anchor, first


def _index_pieces(data, at, docs, base, ids, ties, shards, hot):
    with np.errstate(over="ignore"):
        h, lo, count, anchor, first = runs_of(data, at)
        if not len(lo):
            return
        key = mix64(h[32][anchor] ^ np.uint64(_ODD))
        piece = np.searchsorted(at, lo, side="right") - 1
        doc, place = docs[piece], base[piece] + lo - at[piece]
        new = first == np.arange(len(lo))
        is_hot = np.zeros(len(lo), dtype=bool) if hot is None or not len(hot) else hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        old = ~new
        before = [_told(ids[doc[old]], ties[doc[old]], place[old], place[old] + count[old] - 1)]
        single, single_shard = np.zeros(0, SINGLE), np.zeros(0, np.int64)
        if (alone := new & is_hot).any():
            run = np.repeat(np.flatnonzero(alone), count[alone])
            window = ranges(lo[alone], count[alone])
            own = np.empty(len(run), dtype=SINGLE)
            own["key"], own["second"], own["doc"], own["lo"] = window_hashes(h, window), second_hashes(data, window), doc[run], place[run] + window - lo[run]
            order = np.lexsort((np.arange(len(own)), own["second"], own["key"]))
            own = own[order]
            again = np.concatenate(([False], (own["key"][1:] == own["key"][:-1]) & (own["second"][1:] == own["second"][:-1])))
            before.append(_told(ids[own["doc"][again]], ties[own["doc"][again]], own["lo"][again], own["lo"][again]))
            single = own[~again]
            single_shard = (mix64(single["key"] ^ single["second"]) % np.uint64(shards)).astype(np.int64)
            single_order = np.argsort(single_shard, kind="stable")
            single, single_shard = single[single_order], single_shard[single_order]
    del h
    before = np.concatenate(before)
    shard = (key % np.uint64(shards)).astype(np.int64)
    rows = np.flatnonzero(new & ~is_hot)
    rows = rows[np.argsort(shard[rows], kind="stable")]
    here = shard[rows]
    used_shards = np.union1d(here, single_shard)
    ends, single_ends = (np.searchsorted(x, used_shards, side="right") for x in (here, single_shard))
    if not len(used_shards):
        yield 0, b"", 0, _pack(np.zeros(0, RUN)), 0, _pack(data[:0]), 0, _pack(before), len(before), _pack(single), 0
    for i, number in enumerate(used_shards.tolist()):
        r = rows[ends[i - 1] if i else 0 : ends[i]]
        alone = single[single_ends[i - 1] if i else 0 : single_ends[i]].copy()
        used, index = np.unique(np.concatenate((doc[r], alone["doc"].astype(np.int64))), return_inverse=True)
        run = np.empty(len(r), dtype=RUN)
        run["doc"], run["lo"], run["n"], run["anchor"] = index[: len(r)], place[r], count[r], anchor[r] - lo[r]
        alone["doc"] = index[len(r) :]
        context = data[ranges(lo[r], count[r] + WINDOW - 1)]
        told = before if i == 0 else before[:0]
        yield number, np.stack((ids[used], ties[used])).tobytes(), len(used), _pack(run), len(r), _pack(context), len(context), _pack(told), len(told), _pack(alone), len(alone)


def judge_shard(rows) -> np.ndarray:
    """BEFORE records of a shard: runs of windows that came before. rows: tuples of ROWS without the shard."""
    ids, ties, lo, count, anchor, contexts, told, singles = [], [], [], [], [], [], [], []
    for docs, n_docs, runs, n, context, n_bytes, before, n_before, single, n_single in rows:
        pair = np.frombuffer(docs, dtype=np.int64).reshape(2, n_docs)
        run = _unpack(runs, RUN, n)
        ids.append(pair[0][run["doc"]])
        ties.append(pair[1][run["doc"]])
        lo.append(run["lo"].astype(np.int64))
        count.append(run["n"].astype(np.int64))
        anchor.append(run["anchor"].astype(np.int64))
        contexts.append(_unpack(context, np.uint8, n_bytes))
        if n_before:
            told.append(_unpack(before, BEFORE, n_before))
        if n_single:
            own = _unpack(single, SINGLE, n_single)
            singles.append((own["key"], own["second"], pair[0][own["doc"]], pair[1][own["doc"]], own["lo"].astype(np.int64)))
    if singles:
        told.append(_judge_singles(*(np.concatenate(x) for x in zip(*singles, strict=True))))
    ids, ties, lo, count, anchor = (np.concatenate(x) for x in (ids, ties, lo, count, anchor))
    data = np.concatenate(contexts)
    del contexts
    size = count + WINDOW - 1
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    with np.errstate(over="ignore"):
        key = np.zeros(len(begin), dtype=np.uint64)
        for i in range(GRAM):
            key = key * np.uint64(_ODD) + _BYTES[data[begin + anchor + i]]
        _, number, times = np.unique(key, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[number] > 1)  # an anchor that stands alone has no equal window
        some = some[np.lexsort((lo[some], ties[some], ids[some]))]
        if len(some):
            same = (ids[some][1:] == ids[some][:-1]) & (ties[some][1:] == ties[some][:-1]) & (lo[some][1:] == lo[some][:-1])
            some = some[np.concatenate(([True], ~same))]  # rows that repeat id and text are one document
        found = _judge_runs(data, begin[some], count[some], exact=False)
        if found is None:  # two strings with one fingerprint
            found = _judge_runs(data, begin[some], count[some], exact=True)
    for run, first, last in found:
        r = some[run]
        told.append(_told(ids[r], ties[r], lo[r] + first, lo[r] + last))
    return np.concatenate(told) if told else np.zeros(0, BEFORE)


def _judge_singles(key, second, ids, ties, lo) -> np.ndarray:
    """BEFORE records of windows that came before, of windows that were sent one by one."""
    order = np.lexsort((lo, ties, ids, second, key))
    key, second, ids, ties, lo = key[order], second[order], ids[order], ties[order], lo[order]
    again = np.concatenate(([False], (key[1:] == key[:-1]) & (second[1:] == second[:-1])))
    # the first of a document's row that came twice is its own copy, not a repeat
    first = np.maximum.accumulate(np.where(~again, np.arange(len(key)), 0))
    again &= (ids != ids[first]) | (ties != ties[first]) | (lo != lo[first])
    return _told(ids[again], ties[again], lo[again], lo[again])


def _judge_runs(data: np.ndarray, begin: np.ndarray, count: np.ndarray, exact: bool):
    """Arrays (run, first window, last window) of windows that came before, a batch of runs in document order at a time; None if a
    fingerprint told different strings equal. exact: by the strings themselves."""
    levels, seen, out = Levels(), set(), []
    for a in range(0, len(begin), BATCH):
        b, n = begin[a : a + BATCH], count[a : a + BATCH]
        place = ranges(b, n)
        if exact:
            before = np.zeros(len(place), dtype=bool)
            for i, p in enumerate(place.tolist()):
                window = data[p : p + WINDOW].tobytes()
                before[i] = window in seen
                seen.add(window)
        else:
            own = data[ranges(b, n + WINDOW - 1)]
            at = ranges(np.concatenate(([0], np.cumsum(n + WINDOW - 1)))[:-1], n)
            before, earlier = levels.add(window_hashes(gram_hashes(own, 64), at), place)
            if not same_bytes(data, place[before], earlier[before]):
                return None
        hit = np.flatnonzero(before)
        if len(hit):
            run, where = np.repeat(np.arange(a, a + len(b)), n), ranges(np.zeros(len(n), np.int64), n)
            edge = np.flatnonzero((np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])) + 1
            first, last = hit[np.concatenate(([0], edge))], hit[np.concatenate((edge - 1, [len(hit) - 1]))]
            out.append((run[first], where[first], where[last]))
    return out


def _cuts_of(pieces: list[bytes]) -> np.ndarray:
    """[first, after) of the maximal removed runs, from (lo, hi) pairs of window starts."""
    pairs = np.concatenate([np.frombuffer(p, dtype=np.int64).reshape(-1, 2) for p in pieces])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1] + WINDOW)
    new = np.concatenate(([True], pairs[1:, 0] > end[:-1]))
    return np.stack((pairs[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]), axis=1)


def hot_anchors(docs: DataFrame, total: int, sample: int | None = None) -> np.ndarray:
    """Sorted hashes of the anchors whose runs would take more than half a shard, or a MOST_HOT-th of the corpus; from one document in sample."""
    sample = sample or SAMPLE
    most = max(SHARD_BYTES // 2, total // MOST_HOT)

    def count(batches):
        import pyarrow as pa

        for part in slices(batches, SLICE):
            data, off = text_bytes(part.column("text"))
            with np.errstate(over="ignore"):
                h, lo, n, anchor, first = runs_of(data, off)
                new = first == np.arange(len(lo))
                key, number = np.unique(mix64(h[32][anchor[new]] ^ np.uint64(_ODD)), return_inverse=True)
            taken = np.bincount(number, weights=n[new] + WINDOW - 1, minlength=len(key)).astype(np.int64)
            some = taken > 2 * WINDOW  # one short run in a slice isn't on its way to half a shard
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(taken[some])], names=["key", "bytes"])

    rows = keyed(docs).filter(F.pmod(F.xxhash64(F.lit("hot"), "id", "tie"), F.lit(sample)) == 0)
    counted = rows.mapInArrow(count, "key long, bytes long").groupBy("key").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") * sample > most)
    return np.sort(np.array([r["key"] for r in counted.select("key").collect()], dtype=np.int64).view(np.uint64))  # some MOST_HOT numbers at most


def cuts(docs: DataFrame) -> DataFrame:
    """(id, tie, cuts): for each document that loses bytes the [first, after) pairs, as 64-bit numbers."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    hot = hot_anchors(docs, total) if shards > 1 else np.zeros(0, np.uint64)

    def index(batches):
        import pyarrow as pa

        kinds = [pa.int64(), *[pa.binary(), pa.int64()] * 5]
        names = [x.split()[0] for x in ROWS.split(", ")]
        for part in slices(batches, SLICE):
            got = list(index_slice(np.asarray(part.column("id"), dtype=np.int64), np.asarray(part.column("tie"), dtype=np.int64), part.column("text"), shards, hot))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], names=names)

    def judge(group):
        import pyarrow as pa

        columns = [group.column(i).to_pylist() for i in range(1, len(group.schema.names))]
        told = judge_shard(list(zip(*columns, strict=True)))
        order = np.lexsort((told["tie"], told["id"]))
        told = told[order]
        edge = np.flatnonzero(np.concatenate(([True], (told["id"][1:] != told["id"][:-1]) | (told["tie"][1:] != told["tie"][:-1])))) if len(told) else np.zeros(0, np.int64)
        pairs = np.stack((told["lo"], told["hi"]), axis=1)
        blobs = [pairs[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(told)], strict=False)]
        trim()
        return pa.table({"id": pa.array(told["id"][edge], pa.int64()), "tie": pa.array(told["tie"][edge], pa.int64()), "pairs": pa.array(blobs, pa.binary())})

    def join(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_cuts_of(p).tobytes() for p in batch.column(2).to_pylist()], pa.binary())], names=["id", "tie", "cuts"])

    indexed = keyed(docs).mapInArrow(index, ROWS)
    told = indexed.groupBy("shard").applyInArrow(judge, "id long, tie long, pairs binary")
    found = told.groupBy("id", "tie").agg(F.collect_list("pairs").alias("pairs")).mapInArrow(join, "id long, tie long, cuts binary")
    return stored(found, "cuts")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64("text").alias("tie"), "text", *more)


def with_cuts(docs: DataFrame) -> DataFrame:
    """docs with the column cuts, null where nothing goes."""
    found = cuts(docs)
    taken = found.agg(F.sum(F.octet_length("cuts") + 32)).first()[0] or 0
    found = maybe_broadcast(found, taken, MOST_CUTS)
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST)) == found["id"]) & (F.xxhash64(docs["text"]) == found["tie"])
    return docs.join(found, on, "left").drop("id", "tie")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the op6 query."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                data = (text or "").encode()
                gone = np.frombuffer(cut or b"", dtype=np.int64).reshape(-1, 2).tolist()
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate([pa.int64()] * 3 + [pa.string()]))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_cuts(docs.select("doc_id", "text"))
    return rows.mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame) -> DataFrame:
    """docs with the repeated strings gone from text; a character goes only as a whole. Columns stay as they are."""
    own, restored = hidden(docs, "doc_id", "text")

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, cut in enumerate(batch.column("cuts").to_pylist()):
                if cut is not None:
                    data, kept, at = texts[i].encode(), [], 0
                    for a, b in np.frombuffer(cut, dtype=np.int64).reshape(-1, 2).tolist():
                        while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                            b -= 1
                        kept.append(data[at:a])
                        at = b
                    texts[i] = b"".join([*kept, data[at:]]).decode()
            arrays = [pa.array(texts, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in batch.schema.names if n != "cuts"]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n in batch.schema.names if n != "cuts"])

    return restored(with_cuts(own).mapInArrow(each, own.schema))
