"""Toxicity by compression distance: what a toxic dictionary saves over an ordinary one."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.texts import (  # noqa: F401  (whole_texts shows the sample)
    LOWER, NOT_SPACE, blocks, by_blocks, in_one_task, sampled, spread, text_bytes, whole_rows, whole_texts, word_bounds,
)

WINDOW = 16  # words compressed at once
SAMPLE_DOCS = 2500  # labelled documents of each class to fit on
SAMPLE_CHARS = 20_000  # of each of them on average, at most; texts are taken whole
DICTIONARY = 16_384  # bytes of the ordinary dictionary
# For a piece to enter each toxic dictionary: least ratio of its rates, and least share of the
# strongest evidence that any piece has.
TIERS = ((4.0, 0.0), (12.0, 0.0), (60.0, 0.1), (60.0, 0.3))
EVIDENCE = 14.0  # least likelihood ratio of such a piece
STEPS = (1, 2, 3, 4, 6)  # bytes saved from which a window counts
CALL = 20_000  # windows handed to the compressor at once
BLOCK_BYTES = 1 << 20

LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text is divisible by `folds`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=4,
        target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def _lengths(data: np.ndarray, begin: np.ndarray, end: np.ndarray, content: bytes) -> np.ndarray:
    """Compressed length of each span of `data`."""
    compressor = _compressor(content)
    out = np.zeros(len(begin), np.int64)
    for a in range(0, len(begin), CALL):
        part = slice(a, min(a + CALL, len(begin)))
        segments = np.stack([begin[part], end[part] - begin[part]], axis=1).astype(np.uint64)
        made = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()))
        out[part] = np.fromiter((len(made[i]) for i in range(len(made))), np.int64, len(made))
    return out


@dataclass
class Model:
    """Dictionaries, and a logistic curve over what the toxic ones save."""

    ordinary: bytes
    toxic: list[bytes]
    weights: np.ndarray
    prior: float

    def features(self, column: pa.Array, window: int = WINDOW) -> np.ndarray:
        data, starts = text_bytes(column)
        begin, end, first = word_bounds(data, starts, NOT_SPACE)
        data = np.ascontiguousarray(LOWER[data])
        words = np.diff(first)
        count = -(-words // window)
        doc = np.repeat(np.arange(len(words)), count)
        at = first[:-1][doc] + spread(count) * window
        low, high = begin[at], end[np.minimum(at + window, first[1:][doc]) - 1]
        n = len(words)
        plain = _lengths(data, low, high, self.ordinary)
        columns = [np.ones(n), np.log1p(count)]
        for content in self.toxic:
            saved = plain - _lengths(data, low, high, content + self.ordinary)
            most = np.full(n, -3.0)
            np.maximum.at(most, doc, saved)
            hits = [np.bincount(doc, saved >= s, n) for s in STEPS]
            share = np.maximum(count, 1)
            columns += [most, *[np.log1p(h) for h in hits], np.bincount(doc, saved, n) / share]
            columns += [h / share for h in hits[:3]]
        return np.stack(columns, axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.toxic:
            return np.full(len(column), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.weights, -30, 30)))


def _pieces(text: bytes) -> set[bytes]:
    """Words of a text and beginnings of words, with the space before them."""
    found = set()
    for word in LETTERS.findall(text):
        found.add(b" " + word + b" ")
        letters = word.decode(errors="replace")
        found.update((" " + letters[:n]).encode() for n in range(4, min(len(letters), 8) + 1))
    return found


def _toxic_content(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """For each tier the text that marks toxic documents, strongest last (that is nearest)."""
    seen = Counter(piece for text in toxic for piece in _pieces(text))
    seen = {piece: n for piece, n in seen.items() if n > 2}
    usual: Counter = Counter()
    for text in ordinary:
        usual.update(piece for piece in _pieces(text) if piece in seen)
    a, b = len(toxic), len(ordinary)

    def evidence(piece: bytes) -> float:
        x, y = seen[piece], usual[piece]
        share = (x + y) / (a + b)
        return 2 * (x * math.log(x / (a * share)) + (y * math.log(y / (b * share)) if y else 0))

    ratio = {piece: (n / a) / ((usual[piece] + 0.5) / b) for piece, n in seen.items()}
    strength = {p: evidence(p) for p in seen if ratio[p] >= TIERS[0][0]}
    ranked = sorted((p for p in strength if strength[p] >= EVIDENCE), key=lambda p: (-strength[p], p))
    strongest = max(strength.values(), default=0.0)
    contents = []
    for least, share in TIERS:
        chosen: list[bytes] = []
        for piece in ranked:
            if ratio[piece] < least or strength[piece] < share * strongest or any(piece in c for c in chosen):
                continue
            chosen = [c for c in chosen if c not in piece] + [piece]
        contents.append(b" ".join(reversed(chosen))[-DICTIONARY:])
    return [c for c in dict.fromkeys(contents) if c]


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, for raw columns; column 0 is 1."""
    mean, spread_ = x.mean(0), x.std(0) + 1e-9
    mean[0], spread_[0] = 0.0, 1.0
    z = (x - mean) / spread_
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(y) / 1000 * np.eye(len(w))
        w -= np.linalg.solve(hessian, z.T @ (weight * (p - y)) + ridge * len(y) / 1000 * w)
    w /= spread_
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Dictionaries and curve from at most `sample_docs` labelled documents of each class.

    The sample is whole documents that are not held out, in the order of a hash of their id, as long as
    they have at most `sample_chars` characters on average of `sample_docs`. The
    ordinary dictionary is trained on the ordinary texts. The toxic dictionaries hold, before that same
    content, the words and beginnings of words that mark toxic texts, at four levels of evidence;
    so what differs in length between them and the ordinary one comes from these marks alone.
    The curve weighs the classes as all usable labels do, so that 0.5 is its threshold. The sample is
    fitted on in one task; only the model comes to the driver.
    """
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.col("toxic").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (total + 2) if total else 0.0
    parts = []
    for label in (0, 1):
        chosen = sampled(usable.where(F.col("toxic") == label), "label_id", sample_docs)
        found = docs.select("doc_id", "text").join(
            F.broadcast(chosen.select("label_id").distinct()), F.col("doc_id") == F.col("label_id")
        )
        rows = whole_rows(found, "doc_id", sample_docs, sample_docs * sample_chars)
        parts.append(rows.withColumn("toxic", F.lit(label)))
    order = ["toxic", "doc_id", F.xxhash64("text")]
    return in_one_task(parts[0].unionAll(parts[1]), order, lambda batches: _fitted(batches, counts, prior))


def _fitted(batches: Iterator[pa.RecordBatch], counts: dict[int, int], prior: float) -> Model:
    texts: dict[int, list[str]] = {0: [], 1: []}
    for batch in batches:
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            texts[label].append(text)
    if not texts[0] or not texts[1]:
        return Model(b"", [], np.zeros(0), prior)
    raw = {k: [LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes() for t in v] for k, v in texts.items()}
    try:
        ordinary = zstandard.train_dictionary(DICTIONARY, raw[0], k=64, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        ordinary = b" ".join(raw[0])[-DICTIONARY:]
    toxic = _toxic_content(raw[1], raw[0])
    model = Model(ordinary, toxic, np.zeros(0), prior)
    if not toxic:
        return model
    both = pa.record_batch({"text": pa.array(texts[0] + texts[1], pa.large_string())})
    x = np.concatenate([model.features(block.column("text")) for block in blocks(iter([both]), BLOCK_BYTES)])
    y = np.repeat([0.0, 1.0], [len(texts[0]), len(texts[1])])
    share = np.where(y == 1, counts[1] / len(texts[1]), counts[0] / len(texts[0]))
    model.weights = _fit_logistic(x, y, share * len(y) / share.sum())
    return model


def score_toxicity(docs: DataFrame, model: Model, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Each text is cut into windows of `WINDOW` words, whole texts throughout; each window is
    compressed with the ordinary and with each toxic dictionary, and the bytes saved give the score.
    Null and empty texts have no windows and score by the curve at no saving. A model fitted
    without both classes gives every document the share of toxic labels. Null ids, repeated rows
    and empty tables come out as they are; label, language and source are never looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            score = shared.value.score(block.column("text"))
            yield pa.record_batch({"doc_id": pc.cast(block.column("doc_id"), pa.int64()), "score": pa.array(score)})

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def toxicity_score(docs: DataFrame, model: Model, block_bytes: int = BLOCK_BYTES) -> Column:
    """The score as a column of `docs`, to be used beside its other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return by_blocks(lambda block: pa.array(shared.value.score(block.column("text"))), block_bytes, "double")(docs["text"])
