"""Substring dedup: long repeated word sequences by compaction of a de Bruijn graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.repeats import repeated_segments, spans_by_key, with_spans
from harborline.llm.stored import Stored
from harborline.llm.texts import KEY, blocks, covered, keyed

WINDOW = 35
RUNS = (12, 35)  # words of an anchor's run in each round
MAX_DOUBLINGS = 40  # paths of 2^40 segments; longer ones stay in parts
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, clean_text string"


def graph_nodes(rows: DataFrame, stored: Stored) -> DataFrame:
    """(node_a, node_c, one_next, one_before) of each segment: whether just one segment follows it, and precedes it.

    `rows`: occurrences of repeated segments. A segment is a chain of k-mer edges and here one
    edge of the compacted graph. It is linked to another if they follow each other in a document
    without a gap.
    """
    along = Window.partitionBy(*KEY).orderBy("begin")
    leads = F.lead("begin").over(along) == F.col("begin") + F.col("windows")
    follows = F.lag("begin").over(along) + F.lag("windows").over(along) == F.col("begin")
    steps = rows.select(
        "anchor", "content",
        F.when(leads, F.lead("anchor").over(along)).alias("next_a"), F.when(leads, F.lead("content").over(along)).alias("next_c"),
        F.when(follows, F.lag("anchor").over(along)).alias("before_a"), F.when(follows, F.lag("content").over(along)).alias("before_c"),
    )

    def one(side: str) -> Column:
        same = [F.min(f"{side}_{part}") == F.max(f"{side}_{part}") for part in "ac"]
        return F.coalesce(same[0] & same[1], F.lit(False)).alias(f"one_{side}")

    keys = F.col("anchor").alias("node_a"), F.col("content").alias("node_c")
    return stored.keep(steps.groupBy(*keys).agg(one("next"), one("before")))


def walks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """`rows` with the walk that each lies on: head_begin, head_a, head_c (its first segment) and walk_end.

    A walk is a stretch of one document that takes no branch of the graph: where a segment has one
    successor and that has one predecessor, the two become one. It is the part of a path that the document holds.
    Rows equal in id and text share their walks.
    """
    along = Window.partitionBy(*KEY).orderBy("begin")

    def before(column: str) -> Column:
        return F.lag(column).over(along)

    rows = rows.join(nodes, (F.col("anchor") == F.col("node_a")) & (F.col("content") == F.col("node_c")))
    other = (before("anchor") != F.col("anchor")) | (before("content") != F.col("content"))
    plain = before("one_next") & F.col("one_before") & other
    goes_on = (before("begin") == F.col("begin")) | ((before("begin") + before("windows") == F.col("begin")) & plain)
    rows = rows.withColumn("opens", ~F.coalesce(goes_on, F.lit(False)))
    head = F.last(F.when(F.col("opens"), F.struct("begin", "anchor", "content")), ignorenulls=True)
    rows = rows.withColumn("head", head.over(along.rowsBetween(Window.unboundedPreceding, 0))).select(
        *KEY, "begin", "windows", "anchor", "content",
        F.col("head.begin").alias("head_begin"), F.col("head.anchor").alias("head_a"), F.col("head.content").alias("head_c"),
    )
    end = F.max(F.col("begin") + F.col("windows")).over(Window.partitionBy(*KEY, "head_begin"))
    return rows.withColumn("walk_end", end)


def walk_spans(walked: DataFrame, window: int) -> DataFrame:
    """(key, begin, end) in words: one row a walk."""
    return walked.where("begin = head_begin").select(*KEY, "begin", (F.col("walk_end") + window - 1).alias("end"))


def compact(rows: DataFrame, stored: Stored) -> DataFrame:
    """Paths of segments over all documents: (anchor, content, path_a, path_c, offset).

    `rows`: as for `graph_nodes`. A walk brings its segments to its head at once; a segment's pointer goes
    to the farthest head of its walks. Where that lies on a longer walk of another document, rounds join the table of
    segments with itself and double the reach of every segment's pointer towards the head of its path, so the rounds are
    the logarithm of the documents that the longest path takes. A path that closes on itself has no head; its pointers stop when all others have arrived.
    `offset` is the number of windows between the head and the segment.
    """
    nodes = graph_nodes(rows, stored)
    far = F.col("begin") - F.col("head_begin")
    state = stored.keep(
        walks(rows, nodes).where("begin > head_begin").groupBy("anchor", "content").agg(
            F.max_by("head_a", far).alias("path_a"), F.max_by("head_c", far).alias("path_c"), F.max(far).alias("offset")
        )
    )
    stored.drop(nodes)
    open_before = -1
    for _ in range(MAX_DOUBLINGS):
        far = state.select(
            F.col("anchor").alias("path_a"), F.col("content").alias("path_c"),
            F.col("path_a").alias("far_a"), F.col("path_c").alias("far_c"), F.col("offset").alias("far_offset"),
        )
        still = state.join(far, ["path_a", "path_c"], "left_semi").count()
        if still in (0, open_before):
            break
        open_before = still
        moved = state.join(far, ["path_a", "path_c"], "left")
        doubled = stored.keep(
            moved.select(
                "anchor", "content",
                F.coalesce("far_a", "path_a").alias("path_a"),
                F.coalesce("far_c", "path_c").alias("path_c"),
                (F.col("offset") + F.coalesce("far_offset", F.lit(0))).alias("offset"),
            )
        )
        stored.drop(state)
        state = doubled
    return state


def path_spans(rows: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """(key, begin, end) in words: the stretches of each document that lie on one path without a gap.

    The source coordinates tell: along one passage of a path, a segment's place in the document
    less its offset on the path stays the same.
    """
    on_path = rows.join(paths, ["anchor", "content"], "left").select(
        *KEY, "begin", "windows",
        F.coalesce("path_a", "anchor").alias("path_a"),
        F.coalesce("path_c", "content").alias("path_c"),
        (F.col("begin") - F.coalesce("offset", F.lit(0))).alias("origin"),
    )
    # Repeated rows bring the same stretch more than once, so lengths are those of distinct segments.
    pieces = on_path.groupBy(*KEY, "path_a", "path_c", "origin").agg(
        F.min("begin").alias("begin"),
        F.max(F.col("begin") + F.col("windows")).alias("last"),
        F.sort_array(F.collect_set(F.struct("begin", "windows"))).alias("parts"),
    )
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda total, part: total + part["windows"])
    spans = pieces.withColumn("whole", whole == F.col("last") - F.col("begin"))
    as_one = spans.where("whole").select(*KEY, "begin", (F.col("last") + window - 1).alias("end"))
    split = spans.where("not whole").select(*KEY, F.explode("parts").alias("part"))
    return as_one.unionAll(
        split.select(*KEY, "part.begin", (F.col("part.begin") + F.col("part.windows") + window - 1).alias("end"))
    )


def _remove(block: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    texts, spans = block.column("text"), block.column("spans")
    n_words, n_removed, digests, kept_texts = [], [], [], []
    for text, found in zip(texts, spans):
        words = (text.as_py() or "").encode().split()  # at ASCII white space, as the words are defined
        kept = words
        if found.is_valid:
            edges = np.array([(s["begin"], s["end"]) for s in found.as_py()], np.int64)
            out = covered(len(words), edges[:, 0], edges[:, 1])
            kept = [w for w, drop in zip(words, out.tolist()) if not drop]
        line = b" ".join(kept)
        n_words.append(len(words))
        n_removed.append(len(words) - len(kept))
        digests.append(hashlib.sha256(line).hexdigest())
        kept_texts.append(line.decode() if with_text else None)
    return pa.record_batch(
        {
            "doc_id": block.column("doc_id"),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
            "clean_text": pa.array(kept_texts, pa.string()),
        }
    )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, runs: Sequence[int] = RUNS, with_text: bool = False
) -> DataFrame:
    """One row a document: n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    The graph's edges are all windows of `window` words. Edges that stand twice are found by
    rounds of segments (see `repeats`); the segments compact into walks that take no branch, and the walks are the spans
    to remove. Which walks of different documents lie on one path changes no span (see `compact`, `path_spans`). Only
    the segments at the ends of a repeat are looked at edge by edge. Judged is the input: a word goes if any
    window over it stands elsewhere, in the same document or another. `with_text` adds clean_text.

    Null or empty text, or less than `window` words: nothing is removed. Repeated rows are copies
    of each other and go whole if they are long enough. Null ids are allowed. An empty table gives no rows; further columns
    are not looked at.
    """
    stored = Stored(docs.sparkSession, "debruijn")
    rows = keyed(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *KEY
    )
    first, *later = repeated_segments(rows.select(*KEY, "text"), stored, True, window, runs)
    nodes = graph_nodes(first, stored)
    spans = walk_spans(walks(first, nodes), window)
    for found in later:
        spans = spans.unionAll(found.select(*KEY, "begin", (F.col("begin") + F.col("windows") + window - 1).alias("end")))
    by_key = stored.keep(spans_by_key(spans))
    stored.drop(first, nodes, *later)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            yield _remove(block, with_text)

    return with_spans(rows, by_key).select("doc_id", "text", "spans").mapInArrow(remove, SCHEMA)
