"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document is cut into
whole windows and a rest; the rest goes into the open window that it fits
best. When none fits, the fullest window is emitted: if its gap is more than
TOLERANCE, the rest is cut to fill it first. The windows left open are merged
over all partitions in rounds (best fit, longest piece first), at most
MERGED_AT_ONCE in a task, until one task holds them or a round brings them down by
less than a tenth; what is left then stays in the windows that it has.

Tokens come from a public byte-level BPE vocabulary, read as ranks: the ids are
those of its tokenizer file as it loads, which the tests hold them against: the
string of a special token is that token. A text is cut at single
spaces between other characters, where that vocabulary's pattern always starts
a new token, so equal chunks are tokenised once; texts with a space beside
other white space, or a special token's string, are tokenised as they stand.

Defined results. A null text is empty: its document is the end id alone. Rows
that repeat an id are packed as documents of their own. Extra columns are
ignored. Texts of any length are tokenised whole; memory is bounded by the
longest text, the open windows and the chunk cache.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import slices, stored

WINDOW, OPEN, TOLERANCE, END_ID = 2048, 64, 24, 1
CACHE_CHUNKS, MERGED_AT_ONCE = 150_000, 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECE}, sequence_id long, offset long"


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: The special tokens of the vocabulary's tokenizer file.
SPECIALS = {"<|endoftext|>": 50256}


class Chunks:
    """Ids of chunks of text, kept for a task up to a bound."""

    def __init__(self, ranks: str, specials: dict[str, int] | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=SPECIALS if specials is None else specials)
        self.specials = "".join(re.escape(x) + "|" for x in self.encoding.special_tokens_set)
        self.bytes_of = np.zeros(max(known.values()) + 1, np.int64)
        self.bytes_of[list(known.values())] = [len(token) for token in known]
        self.clear()

    def clear(self) -> None:
        self.known, self.ids, self.off, self.n = {}, np.zeros(1 << 20, np.uint16), np.zeros(CACHE_CHUNKS * 2 + 1, np.int64), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode(x, allowed_special="all") for x in texts]

    def encode_spaced(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each chunk has) of chunks that start with their space: one text, as the pattern cuts it at these spaces itself."""
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = self.encoding.encode_to_numpy("".join(chunks), disallowed_special=())
        ends = np.cumsum(np.asarray(pc.binary_length(pa.array(chunks, pa.large_string())), dtype=np.int64))
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1, prepend=0)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Each chunk's number in the cache."""
        if self.n > CACHE_CHUNKS:
            self.clear()
        known = self.known
        got = [known.get(c) for c in chunks]
        missing = [c for c, k in zip(chunks, got, strict=True) if k is None]
        if missing:
            missing = list(dict.fromkeys(missing))
            heads, spaced = [c for c in missing if c[:1] != " "], [c for c in missing if c[:1] == " "]
            missing, ids = heads + spaced, self.encode(heads)
            flat, size = np.fromiter((x for i in ids for x in i), np.uint16), np.fromiter(map(len, ids), np.int64, len(ids))
            if spaced:
                more, sizes = self.encode_spaced(spaced)
                flat, size = np.concatenate((flat, more.astype(np.uint16))), np.concatenate((size, sizes))
            first, end = self.n, int(self.off[self.n])
            while end + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            if first + len(size) + 1 > len(self.off):
                self.off = np.concatenate((self.off, np.zeros(max(len(self.off), len(size) + 1), np.int64)))
            self.ids[end : end + len(flat)] = flat
            self.off[first + 1 : first + 1 + len(size)] = end + np.cumsum(size)
            self.n += len(size)
            known.update(zip(missing, range(first, self.n), strict=True))
            got = [known[c] for c in chunks]
        return np.array(got, dtype=np.int64)


def token_ids(texts, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, n + 1 offsets) of an Arrow array of strings without nulls; no end ids."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(texts)
    odd = np.asarray(pc.match_substring_regex(texts, chunks.specials + "(?:[\\pZ\\s\x0b\x1c-\x1f\x85​⁠﻿]) | (?:[\\pZ\\s\x0b\x1c-\x1f\x85​⁠﻿])|^ | $"))
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts).cast(pa.large_string()), " ")
    off = np.asarray(lists.offsets, dtype=np.int64)
    off = off - off[0]
    coded = lists.flatten().dictionary_encode()
    code = np.asarray(coded.indices, dtype=np.int64)
    first = np.zeros(len(code), dtype=bool)
    first[off[:-1]] = True
    # Chunks after the first of a text start with their space.
    pairs, at = np.unique(code * 2 + first, return_inverse=True)
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # some ten times as fast as to_pylist
    number = chunks.numbers([words[p >> 1] if p & 1 else " " + words[p >> 1] for p in pairs.tolist()])
    beg, size = chunks.off[number], chunks.off[number + 1] - chunks.off[number]
    beg, size = beg[at], size[at]
    total = np.concatenate(([0], np.cumsum(size)))
    ids = chunks.ids[np.repeat(beg - total[:-1], size) + np.arange(total[-1])].astype(np.uint32)
    ends = total[off]
    if odd.any():
        whole = dict(zip(np.flatnonzero(odd).tolist(), chunks.encode(texts.filter(pa.array(odd)).to_pylist()), strict=True))
        parts = [np.array(whole[i], dtype=np.uint32) if i in whole else ids[ends[i] : ends[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return ids, ends


class Packer:
    """Open windows of one partition: pieces are (doc, start, length, crc, doc_tokens, ids or None)."""

    def __init__(self, window: int, most_open: int):
        self.window, self.most_open, self.full = window, most_open, []
        self.pieces: list[list] = []
        self.free: list[int] = []

    def best(self, length: int) -> int:
        """The open window with the least space that is enough, or -1."""
        at, least = -1, self.window + 1
        for i, f in enumerate(self.free):
            if length <= f < least:
                at, least = i, f
        return at

    def emit(self, at: int) -> None:
        self.full.append(self.pieces[at])
        self.pieces[at], self.free[at] = self.pieces[-1], self.free[-1]
        self.pieces.pop()
        self.free.pop()

    def put(self, at: int, piece) -> None:
        self.pieces[at].append(piece)
        self.free[at] -= piece[2]
        if not self.free[at]:
            self.emit(at)

    def add(self, doc, start: int, ids, doc_tokens: int) -> None:
        cut = lambda a, b: (doc, start + a, b - a, zlib.crc32(ids[a:b].tobytes()), doc_tokens)
        a, n = 0, len(ids)
        while n - a >= self.window:
            self.full.append([cut(a, a + self.window)])
            a += self.window
        while a < n:
            at = self.best(n - a)
            if at < 0 and len(self.free) < self.most_open:
                self.pieces.append([])
                self.free.append(self.window)
                at = len(self.free) - 1
            if at >= 0:
                self.put(at, cut(a, n))
                return
            at = int(np.argmin(self.free))
            if (gap := self.free[at]) > TOLERANCE:
                self.put(at, cut(a, a + gap))
                a += gap
            else:
                self.emit(at)


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, most_open: int = OPEN, specials: dict[str, int] | None = None) -> DataFrame:
    """The pieces of all documents with their places: PLACED. specials: strings that are one token (none: {}; those of the file: None)."""
    path = path or tokenizer_path()

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        chunks, packer, task, n = Chunks(path, specials), Packer(window, most_open), TaskContext.get().partitionId(), 0

        def rows(windows, left: bool):
            nonlocal n
            out = []
            for w in windows:
                at = 0
                for d, start, length, crc, total in w:
                    out.append((d, start, length, crc, total, (task << 32) | n, at, left))
                    at += length
                n += 1
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"])

        for part in slices(batches, 2 << 20):
            ids, ends = token_ids(pc.fill_null(part.column(1), ""), chunks)
            for i, doc in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(END_ID)).astype("<u4")
                packer.add(doc, 0, own, len(own))
            if packer.full:
                yield rows(packer.full, False)
                packer.full = []
        if packer.full or packer.pieces:
            yield rows(packer.full, False)
            yield rows(packer.pieces, True)

    first = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, f"{PLACED}, open boolean"), "packed")
    done = first.filter("not open").drop("open")
    rest = first.filter("open").drop("open", "sequence_id", "offset")
    return done.unionByName(merged(rest, window))


def merged(pieces: DataFrame, window: int, at_once: int = MERGED_AT_ONCE) -> DataFrame:
    """Places for the pieces of windows left open: rounds of best fit decreasing until one task holds what is left, or nothing much merges any more."""
    out, level, count = None, 0, pieces.count()
    while True:
        level += 1
        groups = -(-count // at_once)
        last = groups <= 1

        def fit(batches, level=level, last=last):
            import pyarrow as pa
            from pyspark import TaskContext

            got = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)), key=lambda r: (-r[2], r[0] if r[0] is not None else -(1 << 63), r[1], r[3]))
            packer = Packer(window, len(got))
            for r in got:
                at = packer.best(r[2])
                if at < 0:
                    packer.pieces.append([])
                    packer.free.append(window)
                    at = len(packer.free) - 1
                packer.put(at, r)
            keep = packer.full + [p for p, f in zip(packer.pieces, packer.free, strict=True) if last or f <= TOLERANCE]
            rest = [] if last else [p for p, f in zip(packer.pieces, packer.free, strict=True) if f > TOLERANCE]
            base, rows = level << 52 | TaskContext.get().partitionId() << 32, []
            for n, w in enumerate(keep + rest):
                at = 0
                for p in w:
                    rows.append((*p, base | n, at, n >= len(keep)))
                    at += p[2]
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"])

        dealt = pieces.coalesce(1) if last else pieces.repartition(groups, "doc_id", "start", "ids_crc32")
        fitted = stored(dealt.mapInArrow(fit, f"{PLACED}, open boolean"), "merged")
        done = fitted.filter("not open").drop("open")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        rest = fitted.filter("open").drop("open")
        pieces, before, count = rest.drop("sequence_id", "offset"), count, rest.count()
        if count > before * 0.9:  # what doesn't merge any more stays as it is, in windows of many tasks
            return out.unionByName(rest)
