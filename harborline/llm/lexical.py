"""Ranked search over all documents, term at a time, with accumulators that stop being made."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.stored import Stored
from harborline.llm.texts import ALNUM, doc_rows, gathered, text_bytes, word_bounds, word_codes

TOP = 20
BLOCK_BYTES = 1 << 20  # of text that is cut into terms at once
SHARD_DOCS = 1 << 15  # documents that are ranked together
SHARD_POSTINGS = 1 << 21
ITEM_BYTES = 4 << 20  # of items that are searched in one job
SALTS = 64


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all terms of the texts, and the first of each text (one more at the end)."""
    data, starts = text_bytes(column)
    begin, end, first = word_bounds(data, starts, ALNUM)
    return word_codes(data, begin, end, lower=True), first


class Items:
    """Search items: their terms, rarest first, with weights; `vocabulary` is all their terms, rising."""

    def __init__(self, names: list[int], texts: list[str]):
        codes, first = _terms(pa.array(texts, pa.large_string()))
        self.vocabulary = np.unique(codes)
        self.names, self.own = [], []
        by_name: dict[int, list[np.ndarray]] = {}
        for i, name in enumerate(names):
            by_name.setdefault(name, []).append(codes[first[i] : first[i + 1]])
        for name, parts in by_name.items():
            term, count = np.unique(np.concatenate(parts), return_counts=True)
            self.names.append(name)
            self.own.append((np.searchsorted(self.vocabulary, term), count))

    def weigh(self, documents: int, terms: int, found: dict[int, int]) -> None:
        """Weights from the number of documents, of their terms, and of documents that hold each term."""
        self.documents, self.terms = documents, terms
        df = [found.get(int(code.view(np.int64)), 0) for code in self.vocabulary]
        log = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) if n else 0 for n in df]
        weight = np.array(log, np.int64)
        for i, (term, count) in enumerate(self.own):
            some = weight[term] > 0
            term, count = term[some], count[some]
            order = np.lexsort((term, -weight[term]))
            self.own[i] = (term[order], (weight[term] * count)[order])


def _postings(block: pa.RecordBatch, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term (place in the vocabulary), document and occurrences, by document; and the terms of each document."""
    codes, first = _terms(block.column("text"))
    at = np.minimum(np.searchsorted(vocabulary, codes), max(len(vocabulary) - 1, 0))
    known = np.flatnonzero(vocabulary[at] == codes) if len(vocabulary) else at[:0]
    pair, tf = np.unique(doc_rows(first)[known] * max(len(vocabulary), 1) + at[known], return_counts=True)
    return pair % max(len(vocabulary), 1), pair // max(len(vocabulary), 1), tf, np.diff(first)


def _statistics(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's documents of each term; and, without a term, its documents with terms and all their terms."""
    df, documents, terms = np.zeros(len(vocabulary), np.int64), 0, 0
    for block in gathered(batches, BLOCK_BYTES):
        term, _, _, size = _postings(block, vocabulary)
        df += np.bincount(term, minlength=len(vocabulary))
        documents += int(np.count_nonzero(size))
        terms += int(size.sum())
    some = np.flatnonzero(df)
    yield pa.record_batch(
        {
            "term": pa.array([*vocabulary[some].view(np.int64).tolist(), None], pa.int64()),
            "documents": pa.array([*df[some].tolist(), documents], pa.int64()),
            "terms": pa.array([*[0] * len(some), terms], pa.int64()),
        }
    )


class _Best:
    """The best documents of each item so far, by score and then id; those without an id last."""

    def __init__(self, n: int, top: int):
        self.top = top
        self.least = [0] * n  # score of the last of `top`; 0 as long as there are fewer
        nothing = np.zeros(0, np.int64)
        self.rows = [(nothing, nothing, nothing.astype(bool))] * n

    def add(self, item: int, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray) -> None:
        old = self.rows[item]
        score, doc_id, no_id = (np.concatenate(x) for x in zip(old, (score, doc_id, no_id)))
        order = np.lexsort((doc_id, no_id, -score))[: self.top]
        self.rows[item] = (score[order], doc_id[order], no_id[order])
        if len(order) == self.top:
            self.least[item] = int(score[order[-1]])


class _Shard:
    """Postings of some documents, by term."""

    def __init__(self, parts: list[tuple], items: Items):
        term, doc, tf, size, ids, no_id = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        norm = 75 + (25 * size * items.documents) // max(items.terms, 1)
        self.impact = (1_000_000_000 * tf[order]) // (1000 * tf[order] + 12 * norm[self.doc])
        self.first = np.searchsorted(term[order], np.arange(len(items.vocabulary) + 1))
        self.most = np.zeros(len(items.vocabulary), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.first[some])
        self.size, self.ids, self.no_id = len(size), ids, no_id

    def rank(self, item: int, term: np.ndarray, weight: np.ndarray, best: _Best) -> None:
        """One item's best documents here.

        As long as what the terms from here on can give at most reaches the k-th score so far, documents get
        accumulators. From then on only those that have one go on, exactly.
        """
        bound = weight * self.most[term]
        term, weight, bound = term[bound > 0], weight[bound > 0], bound[bound > 0]
        left = np.cumsum(bound[::-1])[::-1]  # what this and all later terms can add
        if not len(term) or left[0] < best.least[item]:
            return
        score = np.zeros(self.size, np.int64)
        kth, making, mine = best.least[item], True, None
        for i in range(len(term)):
            low, high = self.first[term[i]], self.first[term[i] + 1]
            if making and left[i] < max(int(score.max()), kth):
                # The k-th score is looked for only where it may decide.
                if np.count_nonzero(score) >= best.top:
                    kth = max(kth, int(np.partition(score, -best.top)[-best.top]))
                making = left[i] >= kth
                if not making:
                    mine = np.flatnonzero(score)
            if making:
                score[self.doc[low:high]] += weight[i] * self.impact[low:high]
            elif len(mine):
                doc = self.doc[low:high]
                at = np.minimum(np.searchsorted(doc, mine), len(doc) - 1)
                same = doc[at] == mine
                score[mine[same]] += weight[i] * self.impact[low:high][at[same]]
        found = np.flatnonzero(score)
        if len(found) > best.top:
            # Ties with the last one are kept for their ids.
            least = np.partition(score[found], -best.top)[-best.top]
            found = found[score[found] >= least]
        found = found[score[found] >= best.least[item]]
        best.add(item, score[found], self.ids[found], self.no_id[found])


def _search(batches: Iterator[pa.RecordBatch], items: Items, top: int, shard_docs: int) -> Iterator[pa.RecordBatch]:
    """The best `top` documents of a task for each item, shard after shard."""
    best = _Best(len(items.names), top)
    parts, docs, postings = [], 0, 0

    def rank() -> None:
        shard = _Shard(parts, items)
        for i, (term, weight) in enumerate(items.own):
            shard.rank(i, term, weight, best)

    for block in gathered(batches, min(BLOCK_BYTES, shard_docs * 256)):
        term, doc, tf, size = _postings(block, items.vocabulary)
        ids = block.column("doc_id")
        no_id = ids.is_null().to_numpy(zero_copy_only=False)
        parts.append((term, doc + docs, tf, size, ids.fill_null(0).to_numpy(), no_id))
        docs, postings = docs + len(size), postings + len(term)
        if docs >= shard_docs or postings >= SHARD_POSTINGS:
            rank()
            parts, docs, postings = [], 0, 0
    if parts:
        rank()
    count = np.array([len(x[0]) for x in best.rows], np.int64)
    item = np.repeat(np.array(items.names, np.int64), count)
    score, doc_id, no_id = (np.concatenate(x) for x in zip(*best.rows)) if len(count) else ([], [], [])
    yield pa.record_batch(
        {
            "item_id": pa.array(item, pa.int64()),
            "doc_id": pa.array(doc_id, pa.int64(), mask=np.asarray(no_id, bool)),
            "score": pa.array(score, pa.int64()),
        }
    )


def _item_blocks(items: DataFrame, stored: Stored) -> Iterator[Items]:
    """The items in pieces of at most about `ITEM_BYTES` of text; their number follows from the counted size."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    items = items.distinct()
    n = 1 + int((items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // ITEM_BYTES)
    if n > 1:
        items = stored.keep(items.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")), "_block")
    for b in range(n):
        rows = (items.where(F.col("_block") == b) if n > 1 else items).orderBy("item_id", "text").toArrow()
        yield Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())


def _ranked(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The `top` best documents of each item: item_id, rank, doc_id, score; only scores above 0, ties by doc_id.

    Terms are runs of ASCII letters (without regard to case), digits and characters beyond ASCII. A term's weight is
    the log of how rare it is, in thousandths, and counts for each time an item has it; a document's part saturates with
    its occurrences and shrinks with its length; both are integers.

    One pass counts documents and the items' terms; in the next each task searches its own documents: it takes an item's
    terms rarest first and makes accumulators until no document without one can come among the best (of this task, so
    far). Postings never leave their task, only its best documents do. Items come in pieces
    of `ITEM_BYTES`, each a job of its own, so nothing that is broadcast grows with the data. Terms are told apart by 64-bit codes.

    Null and empty texts hold no terms. Items with null id or text are left out, equal rows count once, and rows of one id with
    different texts are one item with the terms of all. Documents without an id come last among equals; repeated rows
    are ranked each. No documents or no items give no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = Stored(spark, "search")
    out = None
    for block in _item_blocks(items, stored):
        vocabulary = spark.sparkContext.broadcast(block.vocabulary)
        counted = rows.select("text").mapInArrow(
            lambda batches, shared=vocabulary: _statistics(batches, shared.value), "term long, documents long, terms long"
        )
        # No more rows than the terms of this piece of items, and one.
        totals = counted.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()
        whole = next((r for r in totals if r.term is None), None)
        documents, terms = (whole.documents, whole.terms) if whole else (0, 0)
        block.weigh(documents, terms, {r.term: r.documents for r in totals if r.term is not None})
        shared = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(
            lambda batches, shared=shared: _search(batches, shared.value, top, shard_docs),
            "item_id long, doc_id long, score long",
        )
        out = found if out is None else out.unionAll(found)
    # Every task has up to `top` rows an item: those are ranked by salt first.
    salted = out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    ranked = _ranked(_ranked(salted, ["item_id", "salt"], top).drop("rank", "salt"), ["item_id"], top)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
