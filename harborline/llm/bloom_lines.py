"""Lines that many documents share: two Bloom filters name suspects, and only those are shuffled and counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.stored import Stored
from harborline.llm.texts import KEY, NOT_SPACE, doc_rows, gathered, keyed, mix, text_bytes, word_codes

MIN_DOCS = 10
MIN_CHARS = 1
LEAST_BITS = 1 << 20
MOST_BITS = 1 << 29  # of a filter: 64 MB, whatever the size of the corpus
BITS_A_BYTE = 4  # of text: some sixteen bits a line
CHUNK_BITS = 1 << 16  # of a filter, that are merged together
MOST_OFTEN = 1 << 18  # repeated lines that are broadcast; more are joined
SALTS = 16
BLOCK_BYTES = 1 << 20
OTHER_HASH = np.uint64(0xA0761D6478BD642F)


def line_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each line, cut at newlines, and the first line of each text (one more at the end)."""
    newline = np.flatnonzero(data == ord("\n"))
    before = np.searchsorted(newline, starts)
    first = before + np.arange(len(starts))
    begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    opens, closes = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    closes[first[1:] - 1] = True
    begin[opens], begin[~opens] = starts[:-1], newline + 1
    end[closes], end[~closes] = starts[1:], newline
    return begin, end, first


class _Lines:
    """The lines of a block of texts; `code` is 0 where a line has no key of enough characters."""

    def __init__(self, block: pa.RecordBatch, min_chars: int):
        self.data, self.starts = text_bytes(block.column("text"))
        begin, end, self.first = line_spans(self.data, self.starts)
        solid = np.flatnonzero(NOT_SPACE[self.data])
        low, high = np.searchsorted(solid, begin), np.searchsorted(solid, end)
        full = np.flatnonzero(high > low)
        self.begin, self.end = begin.copy(), begin.copy()
        self.begin[full], self.end[full] = solid[low[full]], solid[high[full] - 1] + 1
        marks = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        full = full[marks[self.end[full]] - marks[self.begin[full]] >= max(min_chars, 1)]
        self.code = np.zeros(len(begin), np.uint64)
        self.code[full] = np.maximum(word_codes(self.data, self.begin[full], self.end[full], lower=True), np.uint64(1))
        self.doc = doc_rows(self.first)
        self.raw_end = end

    def key(self, line: int) -> bytes:
        return self.data[self.begin[line] : self.end[line]].tobytes().lower()

    def once_a_document(self) -> np.ndarray:
        """Codes of the lines, each once for every document that has it."""
        lines = np.flatnonzero(self.code)
        order = lines[np.lexsort((self.doc[lines], self.code[lines]))]
        code, doc = self.code[order], self.doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        return code[new]


def _places(codes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each code."""
    low = np.uint64(bits - 1)
    return np.concatenate([codes & low, mix(codes ^ OTHER_HASH) & low]).astype(np.int64)


def _has(filled: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (filled[places >> 3] >> (places & 7).astype(np.uint8)) & np.uint8(1) == 1


def _put(filled: np.ndarray, places: np.ndarray) -> None:
    """Set bits; `places` rise."""
    if len(places):
        byte = places >> 3
        first = np.flatnonzero(np.diff(byte, prepend=-1))
        filled[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, places & 7).astype(np.uint8), first)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _task_filters(batches: Iterator[pa.RecordBatch], bits: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's two filters that have a bit: seen in one document, seen in two."""
    once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
    for block in gathered(batches, BLOCK_BYTES):
        places, count = np.unique(_places(_Lines(block, min_chars).once_a_document(), bits), return_counts=True)
        _put(twice, places[(count > 1) | _has(once, places)])
        _put(once, places)
    pack = zstandard.ZstdCompressor(1).compress
    size = CHUNK_BITS >> 3
    for at in range(0, len(once), size * 256):
        some = [i for i in range(at, min(at + size * 256, len(once)), size) if once[i : i + size].any()]
        yield pa.record_batch(
            {
                "chunk": pa.array([i // size for i in some], pa.int32()),
                "once": pa.array([pack(once[i : i + size].tobytes()) for i in some], pa.binary()),
                "twice": pa.array([pack(twice[i : i + size].tobytes()) for i in some], pa.binary()),
            }
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that come in order of their chunk, as one each; a bit that two pieces have once is seen twice."""
    unpack = zstandard.ZstdDecompressor().decompress
    pack = zstandard.ZstdCompressor(1).compress

    def done(chunk: int, twice: np.ndarray) -> pa.RecordBatch:
        columns = {"chunk": pa.array([chunk], pa.int32()), "twice": pa.array([pack(twice.tobytes())], pa.binary())}
        return pa.record_batch(columns)

    at = once = twice = None
    for batch in batches:
        for chunk, x, y in zip(*(batch.column(c).to_pylist() for c in ("chunk", "once", "twice"))):
            x, y = np.frombuffer(unpack(x), np.uint8), np.frombuffer(unpack(y), np.uint8)
            if chunk != at:
                if at is not None and twice.any():
                    yield done(at, twice)
                at, once, twice = chunk, x, y
            else:
                once, twice = once | x, twice | y | (once & x)
    if at is not None and twice.any():
        yield done(at, twice)


def seen_twice(texts: DataFrame, min_chars: int = MIN_CHARS, bits: int | None = None) -> np.ndarray:
    """The filter of lines that are in two documents, or seem to be. Its size is bounded by `MOST_BITS`.

    Tasks fill both filters from their own texts; the pieces are merged in a shuffle, chunk by chunk.
    """
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(max(1 << (BITS_A_BYTE * size).bit_length(), LEAST_BITS), MOST_BITS)
    pieces = texts.select("text").mapInArrow(
        lambda batches: _task_filters(batches, bits, min_chars), "chunk int, once binary, twice binary"
    )
    chunks = pieces.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merged, "chunk int, twice binary")
    found, filled = chunks.toArrow(), np.zeros(bits >> 3, np.uint8)
    unpack, size = zstandard.ZstdDecompressor().decompress, CHUNK_BITS >> 3
    for chunk, packed in zip(found.column("chunk").to_pylist(), found.column("twice").to_pylist()):
        filled[chunk * size : (chunk + 1) * size] = np.frombuffer(unpack(packed), np.uint8)
    return filled


SUSPECT = "digest binary, code long, docs long, no_id boolean, id long, text_key long, line int"


def _suspects(block: pa.RecordBatch, twice: np.ndarray, min_chars: int) -> dict[bytes, list]:
    """Suspected lines by key: code, documents, and the first place (no id, id, code of the text, line)."""
    lines = _Lines(block, min_chars)
    at = np.flatnonzero(lines.code)
    both = _has(twice, _places(lines.code[at], len(twice) << 3)).reshape(2, -1)
    at = at[both[0] & both[1]]
    ids = [(x is None, x or 0) for x in block.column("doc_id").to_pylist()]
    hashes = block.column(KEY[1]).to_pylist()
    found: dict[bytes, list] = {}
    for line, doc in zip(at.tolist(), lines.doc[at].tolist()):
        place = (*ids[doc], hashes[doc], line - int(lines.first[doc]))
        known = found.setdefault(lines.key(line), [int(lines.code[line].view(np.int64)), 0, -1, place])
        if known[2] != doc:
            known[1], known[2] = known[1] + 1, doc
        known[3] = min(known[3], place)
    return found


def _suspect_rows(batches: Iterator[pa.RecordBatch], twice, min_chars: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SUSPECT.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
    for block in gathered(batches, BLOCK_BYTES):
        found = _suspects(block, twice.value, min_chars)
        rows = [(_digest(key), code, docs, *place) for key, (code, docs, _, place) in found.items()]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int, twice) -> DataFrame:
    """Lines in at least `min_docs` documents: digest and code of the key, documents, and the first place of all.

    Suspects alone are shuffled, added up within each block and each task before.
    """
    rows = docs.mapInArrow(lambda batches: _suspect_rows(batches, twice, min_chars), SUSPECT)
    grouped = rows.groupBy("digest", "code").agg(
        F.sum("docs").alias("docs"), F.min(F.struct("no_id", "id", "text_key", "line")).alias("first")
    )
    return grouped.where(F.col("docs") >= min_docs)


def _cut(block: pa.RecordBatch, lines: _Lines, dropped: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts without the dropped lines, and how many those are."""
    total = np.concatenate([[0], np.cumsum(dropped)])
    n_dropped = total[lines.first[1:]] - total[lines.first[:-1]]
    texts = block.column("text").to_pylist()
    for doc in np.flatnonzero(n_dropped).tolist():
        low, high = lines.first[doc], lines.first[doc + 1]
        own = texts[doc].split("\n")
        texts[doc] = "\n".join(line for line, gone in zip(own, dropped[low:high].tolist()) if not gone)
    return pa.array(texts, pa.string()), n_dropped


def _result(block: pa.RecordBatch, lines: _Lines, dropped: np.ndarray) -> pa.RecordBatch:
    clean, n_dropped = _cut(block, lines, dropped)
    return pa.record_batch(
        {
            "doc_id": block.column("doc_id"),
            "n_lines": pa.array(np.diff(lines.first), pa.int64()),
            "n_dropped": pa.array(n_dropped, pa.int64()),
            "clean_text": clean,
        }
    )


RESULT = "doc_id long, n_lines long, n_dropped long, clean_text string"


def _by_broadcast(docs: DataFrame, often: DataFrame, min_chars: int, keep_first: bool) -> DataFrame:
    rows = often.toArrow()
    first = [tuple(x.values()) for x in rows.column("first").to_pylist()] if keep_first else [None] * rows.num_rows
    codes = np.unique(rows.column("code").to_numpy().view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((codes, dict(zip(rows.column("digest").to_pylist(), first))))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, known = shared.value
        for block in gathered(batches, BLOCK_BYTES):
            lines = _Lines(block, min_chars)
            dropped = np.zeros(len(lines.code), bool)
            at = np.flatnonzero(np.isin(lines.code, codes)) if len(codes) else ()
            ids, hashes = block.column("doc_id").to_pylist(), block.column(KEY[1]).to_pylist()
            digests: dict[bytes, bytes] = {}
            for line in at:
                key = lines.key(line)
                if key not in digests:
                    digests[key] = _digest(key)
                if digests[key] in known:
                    doc = lines.doc[line]
                    place = (ids[doc] is None, ids[doc] or 0, hashes[doc], int(line - lines.first[doc]))
                    dropped[line] = known[digests[key]] != place
            yield _result(block, lines, dropped)

    return docs.select("doc_id", "text", KEY[1]).mapInArrow(clean, RESULT)


def _by_join(docs: DataFrame, often: DataFrame, twice, min_chars: int, keep_first: bool) -> DataFrame:
    """The same where repeated lines are too many to broadcast: their places are joined and brought to the texts."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, BLOCK_BYTES):
            lines = _Lines(block, min_chars)
            at = np.flatnonzero(lines.code)
            both = _has(twice.value, _places(lines.code[at], len(twice.value) << 3)).reshape(2, -1)
            at = at[both[0] & both[1]]
            doc = lines.doc[at]
            yield pa.record_batch(
                [
                    *[block.column(k).take(pa.array(doc)) for k in KEY],
                    pa.array([_digest(lines.key(i)) for i in at.tolist()], pa.binary()),
                    pa.array(at - lines.first[doc], pa.int32()),
                    block.column("doc_id").take(pa.array(doc)),
                ],
                names=[*KEY, "digest", "line", "doc_id"],
            )

    places = docs.mapInArrow(marks, f"{KEY[0]} long, {KEY[1]} long, digest binary, line int, doc_id long").distinct()
    # A line that very many documents have is dealt out by salt.
    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = places.withColumn("salt", F.pmod(KEY[1], F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    if keep_first:
        place = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col(KEY[1]), F.col("line"))
        gone = gone.where(place != F.col("first"))
    gone = gone.groupBy(*KEY).agg(F.collect_set("line").alias("gone"))
    joined = docs.join(gone.hint("shuffle_hash"), list(KEY), "left").select("doc_id", "text", "gone")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, BLOCK_BYTES):
            lines = _Lines(block, min_chars)
            dropped = np.zeros(len(lines.code), bool)
            for doc, own in enumerate(block.column("gone").to_pylist()):
                dropped[lines.first[doc] + np.array(own or [], np.int64)] = True
            yield _result(block, lines, dropped)

    return joined.mapInArrow(clean, RESULT)


def drop_repeated_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    keep_first: bool = False,
    bits: int | None = None,
    most_often: int = MOST_OFTEN,
) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped and clean_text, without the lines that `min_docs` documents share.

    Lines are what stands between newlines; their key is the line without ASCII white space at both
    ends, A-Z in lower case. Keys of fewer than `min_chars` code points always stay. Of a repeated
    line all occurrences go, or with `keep_first` all but the one that comes first by doc_id, text code and line
    (so rows that are equal in id and text have it all).

    Two filters, merged from those of the tasks, tell lines in one document from suspects, seen in two; only suspects
    are shuffled, as digests of 128 bits with counts, and confirmed. The filters grow with the text up to
    `MOST_BITS`; beyond, more lines are falsely suspected, at last all, and shuffled, and results stay the same. Repeated
    lines are broadcast if they are counted and at most `most_often`, else joined, hot ones by salt.

    Null and empty texts are one empty line and stay as they are; a text whose lines all go is empty. Each row is a
    document, repeated rows too. An empty table gives no rows; further columns are not looked at.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    stored = Stored(docs.sparkSession, "lines")
    twice = docs.sparkSession.sparkContext.broadcast(seen_twice(rows, min_chars, bits))
    often = stored.keep(repeated_lines(rows, min_docs, min_chars, twice))
    if often.limit(most_often + 1).count() <= most_often:
        clean = _by_broadcast(rows, often, min_chars, keep_first)
        stored.drop(often)
        return clean
    return _by_join(rows, often, twice, min_chars, keep_first)
