"""Windows that stand in two places: the search that word and byte operators share.

Rounds of segments (see `segments`), from long to short. In each round every segment is one row; Spark
counts anchors and contents. A segment whose content stands twice is repeated as a whole. One
whose anchor is shared with other contents is open: some of its windows may be repeated, and
one example of each such content goes into the next round, with longer runs and so shorter segments. In
the last round a run is a window: its anchor is the code of the whole window, so what shares it is repeated, and
nothing is open. Anchors that stand once end there.
So only anchors are shuffled for all of the text, and single windows only at the borders of repeats.
Contents are compared by anchor and content code together, 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.segments import Codes, segments, window_places
from harborline.llm.stored import Stored
from harborline.llm.texts import BYTE_CODE, KEY, NOT_SPACE, doc_rows, gathered, spread, text_bytes, word_bounds, word_codes

BLOCK_BYTES = 1 << 20  # of text whose codes are in memory at once
ROW = f"anchor long, content long, {KEY[0]} long, {KEY[1]} long, begin long, windows long, wanted boolean"


def units_of(block: pa.RecordBatch, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words or bytes of all texts, and the first of each text (one more at the end)."""
    data, starts = text_bytes(block.column("text"))
    if not words:
        return BYTE_CODE[data], starts
    begin, end, first = word_bounds(data, starts, NOT_SPACE)
    return word_codes(data, begin, end), first


def _rows(block: pa.RecordBatch, words: bool, window: int, run: int) -> pa.RecordBatch:
    codes, first = units_of(block, words)
    wanted = None
    if "ranges" in block.schema.names:
        ranges = block.column("ranges")
        doc = np.repeat(np.arange(block.num_rows), pc.list_value_length(ranges).to_numpy(zero_copy_only=False))
        flat = ranges.flatten()
        begin, count, want = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        order = np.lexsort((begin, doc))
        doc, begin, count, want = doc[order], begin[order], count[order], want[order].astype(bool)
        places = np.repeat(first[doc] + begin, count) + spread(count)
        wanted = np.repeat(want, count)
    else:
        places = window_places(first, window)
    found = segments(Codes(codes), places, window, run, wanted)
    doc = np.searchsorted(first, found.begin, "right") - 1
    doc_of = pa.array(doc)
    at = np.searchsorted(places, found.begin)
    return pa.record_batch(
        {
            "anchor": pa.array(found.anchor.view(np.int64)),
            "content": pa.array(found.content.view(np.int64)),
            KEY[0]: block.column(KEY[0]).take(doc_of),
            KEY[1]: block.column(KEY[1]).take(doc_of),
            "begin": pa.array(found.begin - first[doc]),
            "windows": pa.array(found.windows),
            "wanted": pa.array(np.ones(len(at), bool) if wanted is None else wanted[at]),
        }
    )


def segment_rows(docs: DataFrame, words: bool, window: int, run: int) -> DataFrame:
    """One row a segment; `docs`: key, text and, for some windows only, ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, BLOCK_BYTES):
            yield _rows(block, words, window, run)

    return docs.mapInArrow(cut, ROW)


Shared = Callable[[DataFrame, Stored], DataFrame]


def shared_anchors(rows: DataFrame, stored: Stored) -> DataFrame:
    """Anchors that stand in two places or more, as a stored table."""
    return stored.keep(rows.groupBy("anchor").count().where("count > 1").select("anchor"))


def repeated_segments(
    docs: DataFrame, stored: Stored, words: bool, window: int, runs: Sequence[int], shared: Shared = shared_anchors
) -> list[DataFrame]:
    """Of each round, all segments (rows of `ROW`) whose every window stands elsewhere too.

    `docs`: key and text. `runs`: length of a run in each round, rising, the last one `window`.
    `shared` finds the anchors that stand twice among a round's rows, and stores them.
    """
    found: list[DataFrame] = []
    source = docs
    for run in runs:
        rows = stored.keep(segment_rows(source, words, window, run))
        hits = shared(rows, stored)
        hit_rows = rows.join(hits.withColumnRenamed("anchor", "hit"), F.col("anchor") == F.col("hit")).drop("hit")
        if run == window:
            found.append(stored.keep(hit_rows.where("wanted")))
            stored.drop(rows, hits)
            break
        hit_rows = stored.keep(hit_rows)
        stored.drop(rows, hits)
        contents = stored.keep(
            hit_rows.groupBy("anchor", "content").agg(
                F.count("*").alias("copies"), F.min(F.struct(*KEY, "begin", "windows", "wanted")).alias("example")
            )
        )
        twice = contents.where("copies > 1").select(F.col("anchor").alias("twice_a"), F.col("content").alias("twice_c"))
        same = (F.col("anchor") == F.col("twice_a")) & (F.col("content") == F.col("twice_c"))
        found.append(stored.keep(hit_rows.where("wanted").join(twice, same).drop("twice_a", "twice_c")))
        stored.drop(hit_rows)
        still = (F.col("copies") == 1) & F.col("example.wanted")
        open_anchors = contents.groupBy("anchor").agg(F.count("*").alias("contents"), F.max(still).alias("any"))
        open_anchors = open_anchors.where("contents > 1 and any").select(F.col("anchor").alias("open"))
        ranges = contents.join(open_anchors, F.col("anchor") == F.col("open")).select(
            F.col(f"example.{KEY[0]}").alias("_range_id"),
            F.col(f"example.{KEY[1]}").alias("_range_text"),
            F.struct("example.begin", "example.windows", still.alias("wanted")).alias("range"),
        )
        ranges = stored.keep(ranges.groupBy("_range_id", "_range_text").agg(F.collect_list("range").alias("ranges")))
        stored.drop(contents)
        # Rows equal in id and text bring an example more than once. That changes nothing: whatever
        # stands in such rows has copies already, so it is not wanted.
        source = docs.join(
            ranges.hint("shuffle_hash"), (F.col(KEY[0]) == F.col("_range_id")) & (F.col(KEY[1]) == F.col("_range_text"))
        ).drop("_range_id", "_range_text")
    return found


def spans_by_key(spans: DataFrame) -> DataFrame:
    """(_span_id, _span_text, spans): the spans of each document as one list."""
    return spans.groupBy(F.col(KEY[0]).alias("_span_id"), F.col(KEY[1]).alias("_span_text")).agg(
        F.collect_list(F.struct("begin", "end")).alias("spans")
    )


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All documents with their list of spans (null for none)."""
    return docs.join(
        spans.hint("shuffle_hash"),
        (F.col(KEY[0]) == F.col("_span_id")) & (F.col(KEY[1]) == F.col("_span_text")),
        "left",
    ).drop("_span_id", "_span_text")
