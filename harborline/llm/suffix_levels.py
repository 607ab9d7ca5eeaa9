"""Suffix-array dedup with a logarithmic family of indexes, for long repeated byte strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.repeats import repeated_segments, shared_anchors, spans_by_key, with_spans
from harborline.llm.stored import Stored
from harborline.llm.texts import KEY, blocks, covered, keyed, text_bytes

WINDOW = 400
RUNS = (200, 368, 400)  # bytes of a suffix by which it is put in order, in each round
BATCHES = 4
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, clean binary"


class IndexFamily:
    """Sorted suffix arrays in levels: level i holds up to 2^i batches.

    A suffix array here is a table of sampled suffixes, each by the 64-bit code of its first bytes, in shards by that
    code and sorted within. The samples are chosen by content (see `segments`), so that of every
    repeated string of a window's length both copies have a sample at the same place. Adding a
    batch sorts its suffixes, merge-scans the new array against each level for equal beginnings, and
    puts it in at level 0; two arrays of a level merge into one of the next, like carries in a
    binary number. A suffix so takes part in a number of merges that is logarithmic in the batches.
    """

    def __init__(self, stored: Stored):
        self.stored = stored
        self.levels: dict[int, DataFrame] = {}

    def _sorted(self, array: DataFrame) -> DataFrame:
        # The array comes out of an aggregation, so it is in shards by its code already.
        return self.stored.keep(array.sortWithinPartitions("anchor"))

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Put a batch's suffixes in; returns the codes that it shares, with the index or within itself.

        The `last` batch is only scanned against the levels: nothing reads the index after it.
        """
        array = self._sorted(batch.groupBy("anchor").agg(F.count("*").alias("suffixes")))
        matches = array.where("suffixes > 1").select("anchor")
        for level in self.levels.values():
            matches = matches.unionAll(array.select("anchor").join(level.select("anchor"), "anchor"))
        matches = self.stored.keep(matches.distinct())
        if last:
            self.stored.drop(array)
            return matches
        at = 0
        while at in self.levels:
            other = self.levels.pop(at)
            merged = array.unionAll(other).groupBy("anchor").agg(F.sum("suffixes").alias("suffixes"))
            merged = self._sorted(merged)
            self.stored.drop(array, other)
            array, at = merged, at + 1
        self.levels[at] = array
        return matches

    def close(self) -> None:
        self.stored.drop(*self.levels.values())
        self.levels = {}


def shared_suffixes(rows: DataFrame, stored: Stored, batches: int = BATCHES) -> DataFrame:
    """Codes of the suffixes that stand twice, found by adding the documents batch by batch."""
    family, found = IndexFamily(stored), []
    batch = F.pmod(F.xxhash64(*KEY), F.lit(batches))
    for number in range(batches):
        found.append(family.add(rows.where(batch == number), last=number == batches - 1))
    family.close()
    if batches == 1:
        return found[0]
    codes = found[0]
    for more in found[1:]:
        codes = codes.unionAll(more)
    codes = stored.keep(codes.distinct())
    stored.drop(*found)
    return codes


def _remove(block: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    data, starts = text_bytes(block.column("text"))
    n_removed, n_spans, digests, clean = [], [], [], []
    for i, found in enumerate(block.column("spans")):
        raw = data[starts[i] : starts[i + 1]]
        removed = spans = 0
        if found.is_valid:
            edges = np.array([(s["begin"], s["end"]) for s in found.as_py()], np.int64)
            out = covered(len(raw), edges[:, 0], edges[:, 1])
            removed = int(out.sum())
            spans = int(np.count_nonzero(out[1:] & ~out[:-1]) + (out[0] if len(out) else 0))
            raw = raw[~out]
        n_removed.append(removed)
        n_spans.append(spans)
        digests.append(hashlib.sha256(np.ascontiguousarray(raw)).hexdigest())
        clean.append(raw.tobytes() if with_text else None)
    return pa.record_batch(
        {
            "doc_id": block.column("doc_id"),
            "n_bytes": pa.array(np.diff(starts), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
            "clean": pa.array(clean, pa.binary()),
        }
    )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, runs: Sequence[int] = RUNS, batches: int = BATCHES, with_text: bool = False
) -> DataFrame:
    """One row a document: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte of the UTF-8 text goes if any string of `window` bytes over it begins anywhere else,
    in the same document or another; judged is the input. Suffixes that share their beginning are found by an `IndexFamily`
    over `batches` batches; their surroundings are then compared up to whole windows (see `repeats`). `with_text` adds
    the remaining bytes (which may cut a character).

    Null or empty text has no bytes; less than `window` bytes: nothing is removed. Repeated rows
    are copies and go whole if they are long enough. Null ids are allowed. An empty table gives no
    rows; further columns are not looked at.
    """
    stored = Stored(docs.sparkSession, "suffixes")
    rows = keyed(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *KEY
    )
    # The index is over the first round's suffixes; later rounds only look at what surrounds those that it found.
    first = iter([True])

    def shared(found: DataFrame, stored: Stored) -> DataFrame:
        return shared_suffixes(found, stored, batches) if next(first, False) else shared_anchors(found, stored)

    found = repeated_segments(rows.select(*KEY, "text"), stored, False, window, runs, shared)
    end = (F.col("begin") + F.col("windows") + window - 1).alias("end")
    spans = found[0].select(*KEY, "begin", end)
    for more in found[1:]:
        spans = spans.unionAll(more.select(*KEY, "begin", end))
    by_key = stored.keep(spans_by_key(spans))
    stored.drop(*found)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            yield _remove(block, with_text)

    return with_spans(rows, by_key).select("doc_id", "text", "spans").mapInArrow(remove, SCHEMA)
