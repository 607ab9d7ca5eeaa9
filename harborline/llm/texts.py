"""Whole texts as byte arrays: Arrow batches in, numpy inside the tasks.

Spark cuts the rows into tasks and moves them; the helpers here only turn a batch of texts
into arrays of words, codes and rolling codes. A block of texts holds at most a given number
of bytes, or one longer text: no text is ever cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("_key_id", "_key_text")  # tells rows apart that share a doc_id but not a text
WORD_BASE = 0x9E3779B97F4A7C15 | 1
WINDOW_BASE = 0xC2B2AE3D27D4EB4F | 1
OTHER_BASE = 0xD6E8FEB86659FD93 | 1

_powers: dict[int, np.ndarray] = {}


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` of `docs` and a key that is equal only for rows with the same id and text."""
    id_column = columns[0]
    return docs.select(
        *columns,
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**62))).alias(KEY[0]),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(KEY[1]),
    )


def sampled(rows: DataFrame, id_column: str, n: int) -> DataFrame:
    """At most `n` rows, those whose ids come first by hash; only ids are put in order, not texts."""
    ids = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_sampled"))
    ids = ids.orderBy(F.xxhash64("_sampled"), "_sampled").limit(n).distinct()
    return rows.join(F.broadcast(ids), F.col(id_column) == F.col("_sampled")).drop("_sampled").limit(n)


def whole_rows(rows: DataFrame, id_column: str, n: int, max_chars: int) -> DataFrame:
    """(id, text) of at most `n` rows; the first ones, by a hash of the id, that have `max_chars` together.

    Sizes are collected first. A row is taken whole or not at all, and at least one is taken.
    """
    rows = rows.where("text is not null").select(
        F.struct(F.xxhash64(id_column), F.col(id_column), F.xxhash64("text")).alias("_at"), id_column, "text"
    )
    sizes = [r[0] for r in rows.select("_at", F.length("text").alias("_size")).orderBy("_at").limit(n).select("_size").collect()]
    taken = max(int(np.searchsorted(np.cumsum(sizes), max_chars, "right")), 1) if sizes else 0
    return rows.orderBy("_at").limit(taken).select(id_column, "text")


def whole_texts(rows: DataFrame, id_column: str, n: int, max_chars: int) -> list[str]:
    """The texts of `whole_rows`, by id."""
    first = whole_rows(rows, id_column, n, max_chars)
    return [r[0] for r in first.orderBy(id_column, F.xxhash64("text")).select("text").collect()]


def in_one_task(rows: DataFrame, order: list[str | Column], make: Callable[[Iterator[pa.RecordBatch]], Any]) -> Any:
    """What `make` returns for the batches of a bounded table in that order.

    It runs in one task, so its rows and arrays never take the driver's memory; only the result comes there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"made": pa.array([pickle.dumps(make(batches))], pa.binary())})

    made = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "made binary").collect()
    return pickle.loads(made[0][0]) if made else make(iter(()))  # a table known to be empty has no task


def by_blocks(fn: Callable[[pa.RecordBatch], pa.Array], max_bytes: int, type_: str) -> Callable[[Column], Column]:
    """A column computed from whole texts, block by block, beside all other columns of a row.

    `fn` gets batches with one column, text, and returns one value a row; null texts come to it as null.
    """

    @F.arrow_udf(type_)
    def run(column: pa.Array) -> pa.Array:
        batch = pa.record_batch({"text": column})
        parts = [fn(block) for block in blocks(iter([batch]), max_bytes)]
        return pa.chunked_array(parts).combine_chunks() if parts else column

    return run


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit codes evenly; a bijection, so equal stays equal and different different."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
# Any byte of a character beyond ASCII counts as part of a word.
ALNUM = byte_set((ord("0"), ord("9")), (ord("A"), ord("Z")), (ord("a"), ord("z")), (0x80, 0xFF))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more at the end)."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, starts, data = column.buffers()
    if n == 0 or starts is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def blocks(batches: Iterator[pa.RecordBatch], max_bytes: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of at most `max_bytes` of text (or one longer row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, starts = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(starts, starts[row] + max_bytes, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def gathered(batches: Iterator[pa.RecordBatch], max_bytes: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Like `blocks`, but small neighbours are put together up to `max_bytes`."""
    kept, size = [], 0
    for block in blocks(batches, max_bytes, text):
        more = int(text_bytes(block.column(text))[1][-1])
        if kept and size + more > max_bytes:
            yield joined(kept)
            kept, size = [], 0
        kept.append(block)
        size += more
    if kept:
        yield joined(kept)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def word_bounds(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray):
    """Begin and end of every word, and the index of each text's first word (one more at the end)."""
    inside = is_word[data]
    cuts = starts[:-1][starts[:-1] < len(data)]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    before[cuts] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(begin, starts)


def word_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit code for each word."""
    if len(begin) == 0:
        return np.zeros(0, np.uint64)
    total = np.cumsum((BYTE_CODE[LOWER] if lower else BYTE_CODE)[data] * powers(WORD_BASE, len(data)), dtype=np.uint64)
    value = total[end - 1]
    inner = begin > 0
    value[inner] -= total[begin[inner] - 1]
    return mix(value * powers(inverse(WORD_BASE), len(data))[begin])


def span_codes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = WINDOW_BASE) -> np.ndarray:
    """A code for each run codes[begin:end]; equal runs have equal codes wherever they are."""
    total = prefix(codes, base)
    return mix((total[end] - total[begin]) * powers(inverse(base), len(total))[begin])


def prefix(codes: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)), out=total[1:])
    return total


def rolling(codes: np.ndarray, k: int, base: int = WINDOW_BASE) -> np.ndarray:
    """A code for each run of k; one for every place where a whole run fits."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    total = prefix(codes, base)
    return mix((total[k:] - total[:-k]) * powers(inverse(base), len(total) - k))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def doc_rows(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    change = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0
