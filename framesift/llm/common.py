"""Reading tables, shared storage, size checks and text arrays for the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.sources.storage import maybe_broadcast, stored  # noqa: F401  the operators take them from here

#: A-Z and a-z, for lower-casing that leaves all other characters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch at most: whole texts of a few KB make batches of some MB, in the JVM and in the worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the session's Arrow batches become no larger than BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, min(BATCH_ROWS, int(spark.conf.get(key)) or BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hidden(docs: DataFrame, *used: str):
    """(docs with all columns but those used under names of our own, a function that gives a result the columns of docs again)."""
    names = {c: c if c in used else f"_x{i}" for i, c in enumerate(docs.columns)}
    own = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return own, lambda out: out.select([F.col(n).alias(c) for c, n in names.items()])


def doc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def trim() -> None:
    """Give memory that a worker no longer uses back to the system: idle workers stay with their executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, most_bytes: int = 4 << 20, text: str = "text"):
    """Record batches cut into runs of rows with about most_bytes of text each (at least one row)."""
    import pyarrow.compute as pc

    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        n = len(column)
        if not n:
            continue
        lengths = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(lengths, lengths[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after another, and the n + 1 offsets; a null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(texts, lower: bool):
    """(dictionary of distinct words, code of each word in order, first word of each text as n + 1 offsets).

    Words are runs of anything but ASCII white space; a null text has none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = lists.flatten()
    off = np.asarray(lists.offsets, dtype=np.int64)
    off = off - off[0]
    full = np.asarray(pc.not_equal(flat, ""))
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        off, flat = before[off], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), off


def word_hashes(words) -> np.ndarray:
    """64-bit hashes of an array of strings, from their bytes alone."""
    data, off = text_bytes(words)
    n = len(off) - 1
    out = np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64)
    size = np.diff(off)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at, left, live = off[:-1].copy(), size.copy(), np.arange(n)
    with np.errstate(over="ignore"):
        out = mix64(out ^ size.astype(np.uint64))
        while len(live):
            chunk = np.zeros(len(live), dtype=np.uint64)
            take = np.minimum(left[live], 8)
            for i in range(8):
                byte = padded[np.minimum(at[live] + i, len(padded) - 1)].astype(np.uint64)
                chunk |= np.where(i < take, byte, np.uint64(0)) << np.uint64(8 * i)
            out[live] = mix64(out[live] * np.uint64(0x9E3779B97F4A7C15) + chunk)
            at[live] += 8
            left[live] -= 8
            live = live[left[live] > 0]
    return out
