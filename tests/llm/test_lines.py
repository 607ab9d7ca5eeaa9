import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harborline.llm import bloom_lines
from harborline.llm.texts import keyed

from .edge import bag, documents

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def brute(rows, min_docs, min_chars=1, keep_first=False):
    split = [(text or "").split("\n") for _, text in rows]
    having = {}
    for i, lines in enumerate(split):
        for line in lines:
            if len(key(line)) >= min_chars:
                having.setdefault(key(line), set()).add(i)
    often = {k for k, v in having.items() if len(v) >= min_docs}
    first = {}
    if keep_first:
        for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
            for j, line in enumerate(split[i]):
                first.setdefault(key(line), (rows[i], j))
    out = []
    for row, lines in zip(rows, split):
        kept = [x for j, x in enumerate(lines) if key(x) not in often or (keep_first and first[key(x)] == (row, j))]
        clean = row[1] if len(kept) == len(lines) else "\n".join(kept)
        out.append((row[0], len(lines), len(lines) - len(kept), clean))
    return bag(out)


def with_lines(spark):
    df, rows = documents(spark, clashing=True)
    rows = [(r[0], r[1]) for r in rows]
    lines = ["Same line", "  same LINE\t", "ÄÖ", "äö", "", " ", "é", "x" * 5000, "one\rtwo"]
    rng = np.random.default_rng(5)
    more = [(1000 + i, "\n".join(rng.choice(lines, rng.integers(0, 12)))) for i in range(40)]
    more += [(2000, "Same line\nSame line\nonly here"), (None, "same line\nonly here"), (2001, "\n"), (2002, "\n\n")]
    rows = rows + more
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    return extra.selectExpr("*", "1 as line", "2 as digest", "3 as first", "4 as gone", "5 as salt", "6 as _key_id"), rows


@pytest.mark.parametrize("most_often", [bloom_lines.MOST_OFTEN, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_like_brute_force(spark, most_often, keep_first):
    df, rows = with_lines(spark)
    for min_docs, min_chars in [(2, 1), (10, 1), (3, 4)]:
        got = bloom_lines.drop_repeated_lines(df, min_docs, min_chars, keep_first, most_often=most_often)
        assert bag(tuple(r) for r in got.collect()) == brute(rows, min_docs, min_chars, keep_first)


def test_full_filters_change_nothing(spark):
    """With next to no bits every line is suspected; what goes stays the same."""
    df, rows = with_lines(spark)
    got = bloom_lines.drop_repeated_lines(df, 10, bits=1 << 16)
    assert bag(tuple(r) for r in got.collect()) == brute(rows, 10)


def test_only_suspects_are_shuffled(spark):
    lines = [(i, f"line {i} alone\nshared by all\nline {i} once more") for i in range(300)]
    df = keyed(spark.createDataFrame(lines, "doc_id long, text string").repartition(5), "doc_id", "text")
    twice = spark.sparkContext.broadcast(bloom_lines.seen_twice(df))
    rows = df.mapInArrow(lambda batches: bloom_lines._suspect_rows(batches, twice, 1), bloom_lines.SUSPECT)
    assert rows.select("digest").distinct().count() < 10
    assert rows.agg({"docs": "max"}).first()[0] > 1  # added up before


def test_filters_miss_no_repeated_line():
    texts = [f"a{i % 7}\nb{i}\nc{i % 3}" for i in range(60)]
    pieces = []
    for part in (texts[:20], texts[20:41], texts[41:]):
        pieces += bloom_lines._task_filters(iter([pa.record_batch({"text": pa.array(part)})]), 1 << 16, 1)
    table = pa.Table.from_batches(pieces).sort_by("chunk")
    merged = list(bloom_lines._merged(iter(table.to_batches())))
    assert len(merged) == 1
    packed = merged[0].column("twice")[0].as_py()
    filled = np.frombuffer(bloom_lines.zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    for text in texts:
        lines = bloom_lines._Lines(pa.record_batch({"text": pa.array([text])}), 1)
        both = bloom_lines._has(filled, bloom_lines._places(lines.code, 1 << 16)).reshape(2, -1)
        assert (both[0] & both[1])[[0, 2]].all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA \n\té", max_size=20)), min_size=1, max_size=8))
def test_lines_like_split(texts):
    lines = bloom_lines._Lines(pa.record_batch({"text": pa.array(texts, pa.string())}), 1)
    want = [key(x) for t in texts for x in (t or "").split("\n")]
    got = [lines.key(i).decode() for i in range(len(lines.code))]
    assert got == want
    assert [bool(c) for c in lines.code] == [bool(w) for w in want]


def test_empty(spark):
    df, _ = documents(spark)
    assert bloom_lines.drop_repeated_lines(df.limit(0)).count() == 0
