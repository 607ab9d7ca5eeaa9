"""Benchmark decontamination: an FM-index for each shard of training texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.stored import Stored
from harborline.llm.texts import (
    ALNUM, by_blocks, covered, doc_rows, gathered, span_codes, spread, text_bytes, word_bounds, word_codes,
)

WINDOW = 10
SHARD_BYTES = 6 << 20  # of text in one index; a longer text has an index of its own
SAMPLE = 8  # every so many positions of the text are stored in the index
BLOCK_BYTES = 8 << 20  # of benchmark text that is broadcast at once


class BitRanks:
    """Bits with the number of ones before every 64th."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        low = self.words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[i >> 6] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Symbols by bit level, highest first; rank and access in one step a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for level in reversed(range(bits)):
            ones = (symbols >> level) & 1 != 0
            self.levels.append(BitRanks(ones))
            self.zeros.append(int(len(ones) - np.count_nonzero(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of `i` after the levels of `symbol`; less that of 0 it is the rank."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            is_one = (symbol >> (len(self.levels) - 1 - level)) & 1 != 0
            i = np.where(is_one, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at `i`, and their places after all levels."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            ones, is_one = bits.rank(i), bits.get(i)
            symbol = symbol * 2 + is_one
            i = np.where(is_one, zeros + ones, i - ones)
        return symbol, i


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; after the first sort only equal ones are sorted again."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = (int(symbols.max()) + 1).bit_length()
    width = max(1, 62 // bits)
    padded = np.concatenate([symbols + 1, np.zeros(width, symbols.dtype)])  # 0: behind the end
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    todo = np.arange(n)
    found = key[order]
    reach = width
    while len(todo):
        new = np.ones(len(todo), bool)
        new[1:] = found[1:] != found[:-1]
        heads = todo[new]
        rank[order[todo]] = heads[np.cumsum(new) - 1] + 1
        alone = new.copy()
        alone[:-1] &= new[1:]
        todo = todo[~alone]
        part = order[todo]
        key = rank[part] * (n + 1) + rank[np.minimum(part + reach, n)]
        resort = np.argsort(key)
        order[todo] = part[resort]
        found = key[resort]
        reach *= 2
    return order


class FMIndex:
    """Counts and places of word sequences in one shard.

    The shard's texts stand one after another, each with a 0 after it. Words are numbered by their
    codes' order, from 1. Backward search takes a phrase's words from the last to the first; each
    step maps a range of the suffix order by two ranks on the wavelet matrix of the preceding
    words. Every `SAMPLE`-th position and the first of each text is stored with its suffix, and
    other places are found by walking back to a stored one, never out of their text.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        docs = len(first) - 1
        by_code = np.argsort(codes)
        sorted_codes = codes[by_code]
        new = np.ones(len(codes), bool)
        new[1:] = sorted_codes[1:] != sorted_codes[:-1]
        self.alphabet = sorted_codes[new]
        number = np.empty(len(codes), np.int32)
        number[by_code] = np.cumsum(new)
        bits = max(1, int(len(self.alphabet)).bit_length())
        self.begin = first[:-1] + np.arange(docs)  # of each text, with the marks counted
        symbols = np.zeros(len(codes) + docs, np.int32)
        symbols[np.arange(len(codes)) + doc_rows(first)] = number
        order = suffix_array(symbols)
        self.size = len(symbols)
        self.counts = np.zeros(len(self.alphabet) + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1), out=self.counts[1:])
        self.wavelet = WaveletMatrix(symbols[order - 1], bits)
        self.bits = bits
        stored = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.stored, self.places = BitRanks(stored), order[stored]

    def number(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of words; 0 for those that are not in the shard."""
        if not len(self.alphabet):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase; phrases: word numbers, left-aligned rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        known = (phrases > 0) | (np.arange(phrases.shape[1]) >= lengths[:, None])
        high[~known.all(axis=1)] = 0
        for column in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((high > low) & (column < lengths))
            if not len(live):
                continue
            symbol = phrases[live, column]
            start = self.wavelet.descend(symbol, np.zeros(len(live), np.int64))
            base = self.counts[symbol] - start
            low[live] = base + self.wavelet.descend(symbol, low[live])
            high[live] = base + self.wavelet.descend(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        place = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            here = self.stored.get(at)
            place[todo[here]] = self.places[self.stored.rank(at[here])] + steps
            todo, at = todo[~here], at[~here]
            if len(todo):
                symbol, end = self.wavelet.access(at)
                start = self.wavelet.descend(symbol, np.zeros(len(at), np.int64))
                at = self.counts[symbol] + end - start
                steps += 1
        return place


class Phrases:
    """Distinct windows of a block of benchmark items, and the items that hold each."""

    def __init__(self, ids: list, texts: list, window: int):
        data, starts = text_bytes(pa.array(texts, pa.large_string()))
        begin, end, first = word_bounds(data, starts, ALNUM)
        codes = word_codes(data, begin, end, lower=True)
        words = np.diff(first)
        windows = np.where(words >= window, words - window + 1, np.minimum(words, 1))
        item = np.repeat(np.arange(len(texts)), windows)
        at = np.repeat(first[:-1], windows) + spread(windows)
        length = np.minimum(words, window)[item]
        rows = np.zeros((len(at), window + 1), np.uint64)
        for j in range(window):
            have = j < length
            rows[have, j] = codes[at[have] + j]
        rows[:, window] = length
        distinct, same = np.unique(rows, axis=0, return_inverse=True)
        self.codes, self.lengths = distinct[:, :window], distinct[:, window].astype(np.int64)
        order = np.argsort(same.ravel(), kind="stable")
        self.items = item[order]  # of window i: items[first[i]:first[i + 1]]
        self.first = np.searchsorted(same.ravel()[order], np.arange(len(distinct) + 1))
        self.names = [str(i) for i in ids]


SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start:long,end:long>>, clean_text string"
)


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _forget(broadcast) -> None:
    """Let a Python worker hold a broadcast no longer than it is used; its file is read again when needed."""
    if getattr(broadcast, "_path", None) is not None:  # with encryption there is no file to read again
        broadcast.__dict__.pop("_value", None)


def _search_shard(shard: pa.RecordBatch, blocks, with_text: bool) -> pa.RecordBatch:
    data, starts = text_bytes(shard.column("text"))
    begin, end, first = word_bounds(data, starts, ALNUM)
    index = FMIndex(word_codes(data, begin, end, lower=True), first)
    docs, words = shard.num_rows, np.diff(first)
    hit = np.zeros(len(begin), bool)
    found: dict[int, set[str]] = {}
    phrases = None
    for broadcast in blocks:
        del phrases  # the last block goes before the next is read
        phrases = broadcast.value
        if len(blocks) > 1:
            _forget(broadcast)
        if not len(phrases.lengths):
            continue
        numbers = index.number(phrases.codes.ravel()).reshape(phrases.codes.shape)
        low, high = index.search(numbers, phrases.lengths)
        count = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(count)), count)
        place = index.locate(np.repeat(low, count) + spread(count))
        doc = np.searchsorted(index.begin, place, "right") - 1
        at = place - doc  # without the marks after earlier texts
        hit |= covered(len(begin), at, at + phrases.lengths[window])
        pairs = np.unique(doc * len(count) + window)
        for d, w in zip((pairs // len(count)).tolist(), (pairs % len(count)).tolist()):
            names = found.setdefault(d, set())
            names.update(phrases.names[i] for i in phrases.items[phrases.first[w] : phrases.first[w + 1]])
    before = np.concatenate([[0], np.cumsum(hit)])
    hits = before[first[1:]] - before[first[:-1]]
    items = [sorted(found.get(d, ())) for d in range(docs)]
    nothing = hashlib.sha256(b"").hexdigest()
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else nothing for x in items]
    spans, texts = [None] * docs, shard.column("text").to_pylist() if with_text else [None] * docs
    for d in found:
        a, b = _ranges(hit[first[d] : first[d + 1]])
        lows, highs = begin[first[d] + a] - starts[d], end[first[d] + b - 1] - starts[d]
        raw = data[starts[d] : starts[d + 1]].tobytes()
        spans[d] = [
            {"start": len(raw[:x].decode()), "end": len(raw[:y].decode())} for x, y in zip(lows.tolist(), highs.tolist())
        ]
        if with_text:
            edges = [0, *[v for x, y in zip(lows.tolist(), highs.tolist()) for v in (x, y)], len(raw)]
            texts[d] = "".join(raw[x:y].decode() for x, y in zip(edges[::2], edges[1::2]))
    types = {"items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    return pa.record_batch(
        {
            "doc_id": pc.cast(shard.column("doc_id"), pa.int64()),
            "n_words": pa.array(words, pa.int64()),
            "n_hit": pa.array(hits, pa.int64()),
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": pa.array(digests, pa.string()),
            "contaminated": pa.array(hits > 0),
            "items": pa.array(items, types["items"]),
            "spans": pa.array([s or [] for s in spans], types["spans"]),
            "clean_text": pa.array(texts, pa.string()),
        }
    )


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the benchmark's windows, each of at most about `block_bytes` of text.

    Items go to blocks by a hash, and the number of blocks follows from the counted size, so no
    block grows with the benchmark. The driver makes one block after another and keeps each as a file only; Python
    workers read them one at a time. Several blocks are first dealt out to files, so that each reads its own items only.
    """
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 + int(total // block_bytes)
    blocks, kept = [], None
    if n > 1:
        kept = Stored(spark, "benchmark")
        items = kept.keep(items.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")), "_block")
    for b in range(n):
        rows = (items.where(F.col("_block") == b) if kept else items).toArrow()
        blocks.append(
            spark.sparkContext.broadcast(
                Phrases(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), window)
            )
        )
        del rows
    if kept:
        kept.drop(items)
    return blocks


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, with_text: bool = False
) -> DataFrame:
    """Per document: hit words, benchmark items found, and the merged spans to remove.

    Words are runs of ASCII letters (without regard to case), digits and characters beyond ASCII.
    A phrase is `window` consecutive words of a benchmark item, or a shorter item whole. Each task
    cuts its texts into shards of about `shard_bytes`, builds an FM-index of each and searches all
    phrases in it, block by block; nothing is shuffled. Words are compared by 64-bit codes.

    Columns: doc_id, n_words, n_hit (words inside occurrences), n_items and items (ids as strings,
    sorted), items_sha256 (of the ids joined by commas), contaminated, spans (code points from the
    first to behind the last word of each run of hit words), and with `with_text` clean_text, the text without the spans.

    Null or empty text: no words, not contaminated. Items with null id or text are left out;
    an item that stands in several rows counts once; an empty benchmark hits nothing. Rows are
    judged one by one, so repeated rows and null ids come out as they are. Further columns are not looked at.
    """
    blocks = benchmark_blocks(benchmark, window)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in gathered(batches, shard_bytes):
            yield _search_shard(shard, blocks, with_text)

    return docs.select("doc_id", "text").mapInArrow(search, SCHEMA)


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES
) -> Column:
    """The text without its spans of benchmark words as a column of `docs`; null stays null."""
    blocks = benchmark_blocks(benchmark, window)

    def clean(shard: pa.RecordBatch) -> pa.Array:
        ids = pa.nulls(shard.num_rows, pa.int64())
        return _search_shard(shard.append_column("doc_id", ids), blocks, True).column("clean_text")

    return by_blocks(clean, shard_bytes, "string")(docs["text"])
