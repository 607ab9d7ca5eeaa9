import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from harborline.llm import secret_scan as S
from harborline.llm.texts import LOWER, text_bytes

from .edge import bag, documents, words


def either(word):
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


PATTERNS = (
    re.compile(
        "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
        + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    ),
    re.compile("(AKIA[A-Z0-9]+)"),
    re.compile("([0-9a-f]+)"),
)


def brute(docs):
    rows = []
    for doc_id, text in docs:
        found = []
        for kind, (pattern, least) in enumerate(zip(PATTERNS, (8, 16, 32))):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if len(m[1]) >= least]
        found.sort()
        line = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in found)
        counts = [sum(k == i for _, k, _ in found) for i in range(3)]
        rows.append((doc_id, *counts, hashlib.sha256(line.encode()).hexdigest()))
    return bag(rows)


TRICKY = [
    "password=token=abcdefgh12 é secret: token: abcdefghij",
    "AKIA" + "A" * 12 + " AKIA1 aKIA AKIAAKIA" + "B" * 9,
    "é API_KEY:\"abcd.efg+/=\" apikey=short Api_Key = 'x/y+z==0'",
    "deadbeef" * 4, "deadbeef" * 4 + "x", "Passwd' : 'aaaaaaaaaa", "token", "secret=", "éé token = 12345678é", "api",
    "toKen=12345678", "paſſword=12345678",
]


def many(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        text = words(rng, rng.randint(5, 60))
        if i % 2:
            key = "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(rng.randint(24, 40)))
            text += f' {rng.choice(["token", "secret", "api_key"])} = "{key}" {words(rng, 10)}\n{words(rng, 8)}'
        rows.append((i, text))
    rows += [(1000 + i, t) for i, t in enumerate(TRICKY)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_patterns_like_brute_force(spark):
    df, rows = many(spark)
    edge, edge_rows = documents(spark, clashing=True)
    field = S.fit(df)
    for frame, docs in ((df, rows), (edge, [(r[0], r[1]) for r in edge_rows])):
        got = S.scan_secrets(frame, field, block_bytes=3000)
        assert bag(tuple(r) for r in got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()) == brute(docs)
    assert S.scan_secrets(df.limit(0), field).count() == 0


def test_the_field_finds_more_and_leaves_prose(spark):
    df, rows = many(spark)
    field = S.fit(df)
    rng = random.Random(9)
    key = "9f3kQ7xT2mB8vL4cZ6wR1yN5pD0sHjUe"
    new = [(i, f"{words(rng, 12)} token {key[: 28 + i % 4]} {words(rng, 12)}") for i in range(10)]
    prose = [(100 + i, words(rng, 40)) for i in range(40)]
    frame = spark.createDataFrame(new + prose, "doc_id long, text string")
    got = {r.doc_id: r for r in S.scan_secrets(frame, field, with_text=True).collect()}
    assert sum(got[i].n_crf == 1 and key[:28] not in got[i].clean_text for i, _ in new) >= 8
    assert all(got[i].clean_text == text for i, text in prose)


def test_fitted_on_whole_texts(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 4000).ljust(20_001, "x") + f"\npassword = {rng.getrandbits(80):020x}\n") for i in range(30)]
    field = S.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert field.start[S.O] < 50
    one = spark.createDataFrame([(1, "a secret is 0f9e8d7c6b5a49382716 here"), (2, rows[0][1])], "doc_id long, text string")
    assert S.scan_secrets(one, field).where("doc_id = 2").first().n_assign == 1


def test_spans_hold_the_base_ones(spark):
    df, rows = many(spark)
    for r in S.scan_secrets(df, S.fit(df)).collect():
        spans = r.spans.split(",") if r.spans else []
        base = [s for s in spans if not s.startswith("crf")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), S.KINDS.index(s.split(":")[0])))


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    text = [words(random.Random(i), 60).replace(",", "\n") + ' token="a8B7c6D5e4F3"' for i in range(8)]
    data, starts = text_bytes(pa.array(text, pa.large_string()))
    tokens = S.tokens_of(data, starts, LOWER[data].tobytes())
    for scale in (0.2, 1.0, 3.0):
        field = S.Field([rng.normal(size=(n, 3)) * scale for n in S.SIZES], rng.normal(size=(3, 3)), rng.normal(size=3))
        got, score = field.decode(tokens), field.emissions(tokens.features)
        head = np.flatnonzero(np.diff(tokens.line, prepend=-1) != 0)
        for a, b in zip(head, np.append(head[1:], len(got))):
            s = got[a:b]
            value = field.start[s[0]] + score[np.arange(a, b), s].sum() + field.steps[s[:-1], s[1:]].sum()
            best = field.start + score[a]
            for i in range(a + 1, b):
                best = (best[:, None] + field.steps).max(0) + score[i]
            assert abs(value - best.max()) < 1e-9


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(1)
    field = S.Field([rng.normal(size=(n, 3)) * 0.3 for n in S.SIZES], rng.normal(size=(3, 3)), rng.normal(size=3))
    size = np.array([4, 3, 1])
    ids = [rng.integers(0, n, (3, 4)) for n in S.SIZES]
    truth = rng.integers(0, 3, (3, 4))

    def likelihood():
        total = 0.0
        score = sum(w[i] for w, i in zip(field.states, ids))
        for line, n in enumerate(size):
            s = truth[line, :n]
            total += field.start[s[0]] + score[line, np.arange(n), s].sum() + field.steps[s[:-1], s[1:]].sum()
            forward = field.start + score[line, 0]
            for t in range(1, n):
                forward = S._logsum(forward[:, None] + field.steps, 0) + score[line, t]
            total -= S._logsum(forward, 0)
        return total

    _, steps, start = S._gradient(field, ids, truth, size)
    states = S._gradient(field, ids, truth, size)[0]
    for array, grad in ((field.steps, steps), (field.start, start), (field.states[0], states[0])):
        at = np.unravel_index(int(np.abs(grad).argmax()), grad.shape)
        before = likelihood()
        array[at] += 1e-6
        assert abs((likelihood() - before) / 1e-6 - grad[at]) < 1e-3
        array[at] -= 1e-6


def test_no_secret_to_learn_from(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, words(rng, 30)) for i in range(20)] + [(None, None)], "doc_id long, text string")
    assert all(r.spans == "" for r in S.scan_secrets(df, S.fit(df)).collect())
    assert S.scan_secrets(df, S.fit(df.limit(0))).count() == 21
