"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.texts import (
    ALNUM, LOWER, blocks, by_blocks, byte_set, doc_rows, in_one_task, sampled, text_bytes, whole_rows, word_bounds,
)

BLOCK_BYTES = 2 << 20
SAMPLE_DOCS = 6000  # documents to fit on
SAMPLE_CHARS = 20_000  # of each of them on average, at most; texts are taken whole
SAMPLE_CLEAN = 1500  # pieces of lines without a pattern's match
LONGEST = 40  # tokens of a line in fitting; longer lines are fitted in pieces
EPOCHS = 60
FIT_BLOCK = 250  # documents made into training pieces at once
FIT_BYTES = 5_000_000  # of their text, or one longer text

ASSIGN, ACCESS, HEX, CRF = "assign", "access", "hex", "crf"
KINDS = (ASSIGN, ACCESS, HEX, CRF)
O, B, I = 0, 1, 2  # noqa: E741  (outside, begin, inside)


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


STEMS = (b"passw", b"secret", b"token", b"api")  # what the words of the pattern begin with, in lower case
ASSIGN_RE = re.compile(
    (
        "(" + "|".join([_either_case(w) for w in ("password", "passwd", "secret", "token")])
        + "|" + _either_case("api") + "_?" + _either_case("key")
        + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    ).encode()
)
ACCESS_RE = re.compile(b"AKIA[A-Z0-9]+")
KEYWORD_RE = re.compile(b"password|passwd|secret|token|api_?key")
HEX_BYTES = byte_set((0x30, 0x39), (0x61, 0x66))
LEAST = {ASSIGN: 8, ACCESS: 16, HEX: 32}


def _found(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


def base_spans(data: np.ndarray, starts: np.ndarray, lowered: bytes) -> list[tuple[int, int, int, int]]:
    """(text, begin, kind, end) of the patterns' matches, in bytes of `data`, in order of text and begin."""
    raw = data.tobytes()
    spans = []
    for kind, pattern, where in (
        (0, ASSIGN_RE, sorted(at for stem in STEMS for at in _found(lowered, stem))),
        (1, ACCESS_RE, list(_found(raw, b"AKIA"))),
    ):
        texts = np.searchsorted(starts, where, "right") - 1 if where else []
        done = 0
        for at, text in zip(where, texts):
            if at < done:
                continue
            match = pattern.match(raw, at, int(starts[text + 1]))
            if match:
                done = match.end()
                if len(match[pattern.groups]) >= LEAST[KINDS[kind]]:
                    spans.append((int(text), at, kind, done))
    begin, end, first = word_bounds(data, starts, HEX_BYTES)
    long = np.flatnonzero(end - begin >= LEAST[HEX])
    text = np.searchsorted(first, long, "right") - 1
    spans += [(t, b, 2, e) for t, b, e in zip(text.tolist(), begin[long].tolist(), end[long].tolist())]
    return sorted(spans)


# What stands before or behind a token.
EDGE_CLASS = np.full(256, 7, np.int64)
for _class, _chars in enumerate(("\n\r", " \t", "\"'`", "=", ":", "/", "-_.+")):
    EDGE_CLASS[list(_chars.encode())] = _class
LENGTHS = np.array([4, 8, 12, 16, 20, 28, 36, 48])
_A = np.zeros(256, np.int64)  # digits, capitals, bytes beyond ASCII: 20 bits each
_A[ord("0") : ord("9") + 1] += 1
_A[ord("A") : ord("Z") + 1] += 1 << 20
_A[0x80:] += 1 << 40
_B = np.zeros(256, np.int64)  # vowels, letters a-f
_B[list(b"aeiouyAEIOUY")] += 1
_B[ord("a") : ord("f") + 1] += 1 << 20
FIELD = (1 << 20) - 1
SIZES = (144, 90, 36, 8, 64, 256, 12)  # of the feature families
EDGES, BARE = 4, 1 * 8 + 1  # the family of what stands around a token, and spaces on both sides
CODE = byte_set(*[(b, b) for b in b"={}[]();<>\"'_"])


@dataclass
class Tokens:
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    line: np.ndarray  # number of the token's line, rising
    features: list[np.ndarray]


def tokens_of(data: np.ndarray, starts: np.ndarray, lowered: bytes) -> Tokens:
    """Tokens are runs of letters, digits and characters beyond ASCII; a chain is a line of a text."""
    begin, end, first = word_bounds(data, starts, ALNUM)
    doc, n = doc_rows(first), len(begin)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none, [none] * len(SIZES))
    length = end - begin
    letter = ALNUM[data] & ~((data >= 0x30) & (data <= 0x39))
    turns = np.zeros(len(data), np.int64)
    turns[1:] = (letter[1:] != letter[:-1]) & ALNUM[data[1:]] & ALNUM[data[:-1]]
    inner = np.zeros(n, np.int64)
    # Between two tokens of one text stand only other bytes, so sums up to the next begin are the token's.
    a = np.add.reduceat(_A[data], begin)
    b = np.add.reduceat(_B[data] + (turns << 40), begin)
    glued = np.flatnonzero((begin > 0) & ALNUM[data[np.maximum(begin, 1) - 1]])  # a text begins right behind another
    b[glued] -= turns[begin[glued]] << 40
    digits, capitals, wide = a & FIELD, (a >> 20) & FIELD, a >> 40
    vowels, hex_letters, turn = b & FIELD, (b >> 20) & FIELD, b >> 40
    small = length - digits - capitals - wide
    letters = np.maximum(length - digits, 1)
    size = np.searchsorted(LENGTHS, length, "right")
    shape = (digits > 0) + 2 * (capitals > 0) + 4 * (small > 0) + 8 * (wide > 0)
    turning = np.searchsorted([1, 2, 4, 8], turn, "right")
    hexed = digits + hex_letters == length
    vowel = np.searchsorted([0.1, 0.25, 0.45], vowels / letters, "right")
    keyword = np.zeros(n, bool)
    for stem in STEMS:
        for at in _found(lowered, stem):
            word = KEYWORD_RE.match(lowered, at)
            if word:
                i = int(np.searchsorted(begin, at, "right")) - 1
                if i >= 0 and word.end() <= end[i] + 4:  # api_key is two tokens
                    keyword[max(i, 0)] = True
    breaks = np.cumsum(data == 10)
    new_line = np.ones(n, bool)
    new_line[1:] = (breaks[begin[1:]] != breaks[begin[:-1]]) | (doc[1:] != doc[:-1])
    line = np.cumsum(new_line)
    same = np.zeros(n, bool)
    same[1:] = ~new_line[1:]
    one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
    one[1:] = keyword[:-1] & same[1:]
    two[2:] = keyword[:-2] & same[2:] & same[1:-1]
    left = np.where(begin > starts[doc], EDGE_CLASS[data[np.maximum(begin, 1) - 1]], 0)
    right = np.where(end < starts[doc + 1], EDGE_CLASS[data[np.minimum(end, len(data) - 1)]], 0)
    before, after = inner.copy(), inner.copy()
    before[1:] = np.where(same[1:], shape[:-1], 0)
    after[:-1] = np.where(same[1:], shape[1:], 0)
    total = np.concatenate([[0], np.cumsum(CODE[data])])
    code_share = (total[starts[1:]] - total[starts[:-1]]) / np.maximum(np.diff(starts), 1)
    known = np.bincount(doc[keyword], minlength=len(starts) - 1) > 0
    file = 3 * known + np.searchsorted([0.005, 0.03], code_share, "right")
    mixed = (digits > 0) & (letters > 0) & (digits < length)
    features = [
        size * 16 + shape,
        (size * 5 + turning) * 2 + hexed,
        size * 4 + vowel,
        one + 2 * two + 4 * keyword,
        left * 8 + right,
        before * 16 + after,
        file[doc] * 2 + mixed,
    ]
    return Tokens(begin, end, doc, line, features)


@dataclass
class Field:
    """Weights of a linear-chain random field over the states outside, begin and inside."""

    states: list[np.ndarray]  # for each family: feature x state
    steps: np.ndarray  # from x to
    start: np.ndarray

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        total = self.states[0][features[0]]
        for weights, ids in zip(self.states[1:], features[1:]):
            total = total + weights[ids]
        return total

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best states by Viterbi, exactly.

        A token is outside in every best path if its score for outside leads by more than any two
        transitions can win back. Such tokens cut the lines into short runs with known neighbours,
        which are decoded side by side.
        """
        n = len(tokens.begin)
        states = np.zeros(n, np.int8)
        if n == 0:
            return states
        score = self.emissions(tokens.features)
        lead = np.vstack([self.steps, self.start])  # what may come before: a state or the line's begin
        behind = np.hstack([self.steps, np.zeros((3, 1))])  # what may come after: a state or the line's end
        sure = np.ones(n, bool)
        for s in (B, I):
            back = (lead[:, s] - lead[:, O]).max() + (behind[s] - behind[O]).max()
            sure &= score[:, O] - score[:, s] > back
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return states
        first = np.ones(len(open_), bool)
        first[1:] = (np.diff(open_) > 1) | (tokens.line[open_[1:]] != tokens.line[open_[:-1]])
        begin = open_[first]
        end = np.append(open_[:-1][first[1:]], open_[-1]) + 1
        order = np.argsort(begin - end, kind="stable")  # longest first
        begin, end = begin[order], end[order]
        size = end - begin
        line_start = (begin == 0) | (tokens.line[begin] != tokens.line[np.maximum(begin, 1) - 1])
        line_end = (end == n) | (tokens.line[np.minimum(end, n - 1)] != tokens.line[end - 1])
        best = score[begin] + np.where(line_start[:, None], self.start, self.steps[O])
        back = np.zeros((int(size.sum()), 3), np.int8)
        place = np.cumsum(size) - size
        last = best.copy()
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, "left"))  # runs longer than t
            options = best[:live, :, None] + self.steps
            back[place[:live] + t] = options.argmax(axis=1)
            best = options.max(axis=1) + score[begin[:live] + t]
            last[:live] = best
        last = last + np.where(line_end[:, None], 0.0, self.steps[:, O])
        state = last.argmax(axis=1)
        states[end - 1] = state
        for t in range(int(size[0]) - 1, 0, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            state[:live] = back[place[:live] + t, state[:live]]
            states[begin[:live] + t - 1] = state[:live]
        return states


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _gradient(field: Field, ids: list[np.ndarray], truth: np.ndarray, size: np.ndarray):
    """Log-likelihood and its gradient by forward and backward sums; rows are lines, longest first."""
    lines, longest = truth.shape
    score = sum(w[i] for w, i in zip(field.states, ids))
    inside = np.arange(longest)[None, :] < size[:, None]
    forward = np.zeros((lines, longest, 3))
    backward = np.zeros((lines, longest, 3))
    forward[:, 0] = score[:, 0] + field.start
    for t in range(1, longest):
        step = _logsum(forward[:, t - 1, :, None] + field.steps, 1) + score[:, t]
        forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = _logsum(field.steps + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
    total = _logsum(forward[:, -1], 1)
    seen = np.eye(3)[truth] * inside[:, :, None]
    expected = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
    pair = np.exp(
        forward[:, :-1, :, None] + field.steps + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
    ) * inside[:, 1:, None, None]
    steps = np.einsum("lta,ltb->ab", seen[:, :-1], seen[:, 1:]) - pair.sum(axis=(0, 1))
    start = seen[:, 0].sum(0) - expected[:, 0].sum(0)
    rest = (seen - expected).reshape(-1, 3)
    states = []
    for weights, family in zip(field.states, ids):
        flat = family.ravel()
        states.append(np.stack([np.bincount(flat, rest[:, s], len(weights)) for s in range(3)], axis=1))
    return states, steps, start


def _training_pieces(texts: list[str]):
    """Pieces of lines of at most `LONGEST` tokens: features, states, sizes, and which hold a match.

    Of the pieces without a match every tenth is kept.
    """
    data, starts = text_bytes(pa.array(texts, pa.large_string()))
    lowered = LOWER[data].tobytes()
    tokens = tokens_of(data, starts, lowered)
    truth = np.zeros(len(tokens.begin), np.int64)
    raw = data.tobytes()
    for text, a, kind, b in base_spans(data, starts, lowered):
        if kind == 0:
            a = ASSIGN_RE.match(raw, a, int(starts[text + 1])).start(2)
        i, j = np.searchsorted(tokens.end, a, "right"), np.searchsorted(tokens.begin, b, "left")
        truth[i:j] = I
        truth[i : i + 1] = B
    if not len(truth):
        none = np.zeros(0, np.int64)
        return [np.zeros((0, LONGEST), np.int64)] * len(SIZES), np.zeros((0, LONGEST), np.int64), none, none > 0
    line_head = np.flatnonzero(np.diff(tokens.line, prepend=-1) != 0)
    within = np.arange(len(truth)) - line_head[tokens.line - 1]
    head = np.flatnonzero(within % LONGEST == 0)
    size = np.diff(np.append(head, len(truth)))
    marked = np.add.reduceat(truth, head) > 0
    keep = marked | (np.arange(len(head)) % 10 == 0)
    head, size, marked = head[keep], size[keep], marked[keep]
    grid = np.minimum(head[:, None] + np.arange(LONGEST), len(truth) - 1)
    return [f[grid] for f in tokens.features], truth[grid], size, marked


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted on at most `sample_docs` whole documents, in the order of a hash of their id, as long as
    they have at most `sample_chars` characters on average of `sample_docs`.

    The patterns' matches are its labels: a match's first token begins a secret, its others are
    inside (of an assignment, the value's tokens). All pieces of the sample's lines with a match
    are used, and some `SAMPLE_CLEAN` evenly from the others. Without any match nothing is tagged. The
    sample is fitted on in one task; only the field comes to the driver.
    """
    usable = docs.select("doc_id", "text").where("text is not null")
    rows = whole_rows(sampled(usable, "doc_id", sample_docs), "doc_id", sample_docs, sample_docs * sample_chars)
    return in_one_task(rows, ["doc_id", F.xxhash64("text")], _fitted)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Field:
    texts = [text for batch in batches for text in batch.column("text").to_pylist()]
    pieces = []
    for i in range(0, len(texts), FIT_BLOCK):
        part = pa.record_batch({"text": pa.array(texts[i : i + FIT_BLOCK], pa.large_string())})
        pieces += [_training_pieces(b.column("text").to_pylist()) for b in blocks(iter([part]), FIT_BYTES)]
    field = Field([np.zeros((n, 3)) for n in SIZES], np.zeros((3, 3)), np.zeros(3))
    if not any(marked.any() for *_, marked in pieces):
        field.start[O] = 50.0
        field.steps[:, O] = 50.0
        return field
    ids = [np.concatenate([p[0][f] for p in pieces]) for f in range(len(SIZES))]
    goal, size, marked = (np.concatenate([p[i] for p in pieces]) for i in (1, 2, 3))
    clean = np.flatnonzero(~marked)
    keep = np.concatenate([np.flatnonzero(marked), clean[:: max(1, len(clean) // SAMPLE_CLEAN)]])
    # Each piece with a match is seen again with plain spaces around the secret, so that its shape counts too.
    bare = np.flatnonzero(marked)
    keep = np.concatenate([keep, bare])
    again = np.arange(len(keep)) >= len(keep) - len(bare)
    ids, goal, size = [i[keep] for i in ids], goal[keep], size[keep]
    ids[EDGES] = np.where(again[:, None] & (goal != O), BARE, ids[EDGES])
    order = np.argsort(-size, kind="stable")  # longest first
    ids, goal, size = [i[order] for i in ids], goal[order], size[order]
    parts = [field.steps, field.start, *field.states]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for epoch in range(1, EPOCHS + 1):
        grads = [np.zeros_like(p) for p in parts]
        for a in range(0, len(size), 500):
            part = slice(a, a + 500)
            longest = int(size[part].max())
            states, steps, start = _gradient(
                field, [i[part, :longest] for i in ids], goal[part, :longest], size[part]
            )
            for g, more in zip(grads, [steps, start, *states]):
                g += more
        for p, g, m, v in zip(parts, grads, first, second):
            g -= 0.05 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.2 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return field


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_crf long, clean_text string"
)
REDACTED = "[secret]"


def _scan_block(block: pa.RecordBatch, field: Field, with_text: bool) -> pa.RecordBatch:
    data, starts = text_bytes(block.column("text"))
    lowered = LOWER[data].tobytes()
    spans = base_spans(data, starts, lowered)
    tokens = tokens_of(data, starts, lowered)
    states = field.decode(tokens)
    tagged = np.flatnonzero(states != O)
    if len(tagged):
        head = np.ones(len(tagged), bool)
        head[1:] = (
            (np.diff(tagged) > 1) | (states[tagged[1:]] == B) | (tokens.line[tagged[1:]] != tokens.line[tagged[:-1]])
        )
        a = tokens.begin[tagged[head]]
        b = tokens.end[np.append(tagged[:-1][head[1:]], tagged[-1])]
        by_text: dict[int, list] = {}
        for s in spans:
            by_text.setdefault(s[0], []).append(s)
        for text, x, y in zip(tokens.doc[tagged[head]].tolist(), a.tolist(), b.tolist()):
            if not any(s[1] <= x and y <= s[3] for s in by_text.get(text, ())):
                spans.append((text, x, 3, y))
        spans.sort()
    n = block.num_rows
    texts, column = [None] * n, block.column("text")
    if with_text:
        texts = column.to_pylist()
    count = np.zeros((4, n), np.int64)
    base, every = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
    at = 0
    while at < len(spans):
        text, to = spans[at][0], at
        while to < len(spans) and spans[to][0] == text:
            to += 1
        low, high = int(starts[text]), int(starts[text + 1])
        points = np.concatenate([[0], np.cumsum((data[low:high] & 0xC0) != 0x80)])
        found = [(int(points[a - low]), k, int(points[b - low])) for _, a, k, b in spans[at:to]]
        names = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
        every[text] = ",".join(names)
        base[text] = hashlib.sha256(",".join(x for x, s in zip(names, found) if s[1] < 3).encode()).hexdigest()
        for _, k, _ in found:
            count[k, text] += 1
        if with_text:
            whole, out, done = texts[text], [], 0
            for a, _, b in found:
                if a >= done:
                    out += [whole[done:a], REDACTED]
                done = max(done, b)
            texts[text] = "".join(out) + whole[done:]
        at = to
    return pa.record_batch(
        {
            "doc_id": pc.cast(block.column("doc_id"), pa.int64()),
            "n_assign": pa.array(count[0]),
            "n_access": pa.array(count[1]),
            "n_hex": pa.array(count[2]),
            "base_sha256": pa.array(base, pa.string()),
            "spans": pa.array(every, pa.string()),
            "n_crf": pa.array(count[3]),
            "clean_text": pa.array(texts, pa.string()),
        }
    )


def scan_secrets(docs: DataFrame, field: Field, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: counts by kind, digest of the patterns' spans, and all spans.

    A span is kind:begin:end in code points, end exclusive: the whole match of a pattern, or the tokens
    that the field tags as one secret, unless a pattern's match holds them already. Overlapping
    patterns of different kinds all stay. With `with_text`, clean_text is the text with every run
    of overlapping spans replaced. Whole texts are scanned; nothing is shuffled.

    Null text counts as empty: no spans, clean_text null. Null ids, repeated rows and empty tables come out as
    they are. Further columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            yield _scan_block(block, shared.value, with_text)

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def redacted(docs: DataFrame, field: Field, block_bytes: int = BLOCK_BYTES) -> Column:
    """The text without its secrets as a column of `docs`; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def clean(block: pa.RecordBatch) -> pa.Array:
        ids = pa.nulls(block.num_rows, pa.int64())
        return _scan_block(block.append_column("doc_id", ids), shared.value, True).column("clean_text")

    return by_blocks(clean, block_bytes, "string")(docs["text"])
