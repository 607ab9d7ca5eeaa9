import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from harborline.llm import debruijn, suffix_levels
from harborline.llm.stored import Stored

from .edge import bag, documents


def brute_words(docs, window=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in docs]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    rows = []
    for (doc_id, _), w in zip(docs, split):
        out = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in out)
        rows.append((doc_id, len(w), len(out), hashlib.sha256(kept.encode()).hexdigest()))
    return bag(rows)


def brute_bytes(docs, window=400):
    raw = [(text or "").encode() for _, text in docs]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    rows = []
    for (doc_id, _), r in zip(docs, raw):
        out = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                out[i : i + window] = b"\x01" * window
        kept = bytes(b for b, o in zip(r, out) if not o)
        spans = sum(1 for i, o in enumerate(out) if o and (i == 0 or not out[i - 1]))
        rows.append((doc_id, len(r), sum(out), spans, hashlib.sha256(kept).hexdigest()))
    return bag(rows)


def test_words_like_brute_force(spark):
    df, rows = documents(spark, clashing=True)
    got = debruijn.remove_repeats(df).drop("clean_text")
    assert bag(tuple(r) for r in got.collect()) == brute_words([(r[0], r[1]) for r in rows])


def test_bytes_like_brute_force(spark):
    df, rows = documents(spark, clashing=True)
    got = suffix_levels.remove_repeats(df).drop("clean")
    assert bag(tuple(r) for r in got.collect()) == brute_bytes([(r[0], r[1]) for r in rows])


def test_empty(spark):
    df, _ = documents(spark)
    assert debruijn.remove_repeats(df.limit(0)).count() == 0
    assert suffix_levels.remove_repeats(df.limit(0)).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=12))
def test_small_windows(spark, texts):
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = debruijn.remove_repeats(df, window=4, runs=(2, 4)).drop("clean_text")
    assert bag(tuple(r) for r in got.collect()) == brute_words(docs, 4)
    got = suffix_levels.remove_repeats(df, window=6, runs=(3, 6), batches=3).drop("clean")
    assert bag(tuple(r) for r in got.collect()) == brute_bytes(docs, 6)


def test_a_nonbranching_path_is_one(spark):
    """A passage in two documents compacts to one path; a branch in its middle makes three parts."""
    stored = Stored(spark, "test")
    schema = "anchor long, content long, _key_id long, _key_text long, begin long, windows long, wanted boolean"
    chain = [(s, s, d, 0, 10 * i, 10, True) for d in (1, 2) for i, s in enumerate([11, 12, 13, 14, 15])]
    paths = debruijn.compact(spark.createDataFrame(chain, schema), stored)
    assert {(r.anchor, r.path_a, r.offset) for r in paths.collect()} == {(12, 11, 10), (13, 11, 20), (14, 11, 30), (15, 11, 40)}
    branch = chain + [(s, s, 3, 0, 10 * i, 10, True) for i, s in enumerate([11, 12, 13, 99])]
    paths = debruijn.compact(spark.createDataFrame(branch, schema), stored)
    assert {(r.anchor, r.path_a) for r in paths.collect()} == {(12, 11), (13, 11), (15, 14)}
    loop = [(s, s, 1, 0, 10 * i, 10, True) for i, s in enumerate([7, 8, 9, 7, 8, 9])]
    rows = spark.createDataFrame(loop, schema)
    spans = debruijn.path_spans(rows, debruijn.compact(rows, stored), 35)
    covered = {j for r in spans.collect() for j in range(r.begin, r.end)}
    assert covered == set(range(60 + 34))


def test_levels_carry_like_a_counter(spark):
    stored = Stored(spark, "test")
    family = suffix_levels.IndexFamily(stored)
    for b in range(5):
        batch = spark.createDataFrame([(b,), (100 + b,), (100 + b,), (b + 1,)], "anchor long")
        hits = {r.anchor for r in family.add(batch).collect()}
        assert hits == {100 + b} | ({b} if b else set())
    assert sorted(family.levels) == [0, 2]


def test_long_paths_take_no_more_tables(spark, monkeypatch):
    """However many segments a repeat has, the search stores the same number of tables."""
    kept = []
    keep = Stored.keep
    monkeypatch.setattr(Stored, "keep", lambda self, df, *by: kept.append(1) or keep(self, df, *by))
    counts = []
    for n in (40, 4000):
        passage = " ".join(f"w{i}" for i in range(n))
        docs = [(1, f"a {passage} b"), (2, f"c {passage}"), (3, passage + " d"), (4, "alone")]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        kept.clear()
        got = debruijn.remove_repeats(df).drop("clean_text")
        assert bag(tuple(r) for r in got.collect()) == brute_words(docs)
        counts.append(len(kept))
    assert counts[0] == counts[1] <= 11


def test_walks_end_at_branches(spark):
    """Walks of a document are cut where any document branches, also if a row stands twice; paths join them over documents."""
    schema = "anchor long, content long, _key_id long, _key_text long, begin long, windows long, wanted boolean"
    texts = {1: [11, 12, 13, 14], 2: [12, 13, 14, 15, 16], 3: [15, 16, 17, 18], 4: [31, 32, 33], 5: [34, 32, 35], 6: [51, 51]}
    rows = [(s, s, d, 0, 10 * i, 10, True) for d, found in texts.items() for i, s in enumerate(found)]
    df = spark.createDataFrame(rows + [r for r in rows if r[2] == 1], schema)
    stored = Stored(spark, "test")
    spans = debruijn.walk_spans(debruijn.walks(df, debruijn.graph_nodes(df, stored)), 35).distinct()
    got = bag((r[0], r.begin, r.end - 34) for r in spans.collect())
    whole = [(1, 0, 40), (2, 0, 50), (3, 0, 40)]
    assert got == bag(whole + [(d, 10 * i, 10 * i + 10) for d, n in ((4, 3), (5, 3), (6, 2)) for i in range(n)])
    paths = {(r.anchor, r.path_a, r.offset) for r in debruijn.compact(df, stored).collect()}
    assert paths == {(s, 11, 10 * (s - 11)) for s in range(12, 19)}


def test_index_holds_only_the_first_round(spark, monkeypatch):
    """Later rounds put nothing into the index, and the last batch is scanned but not put in."""
    added, kept = [], []
    add, keep = suffix_levels.IndexFamily.add, Stored.keep

    def counted(self, batch, **how):
        found = add(self, batch, **how)
        added.append(sorted(self.levels))
        return found

    monkeypatch.setattr(suffix_levels.IndexFamily, "add", counted)
    monkeypatch.setattr(Stored, "keep", lambda self, df, *by: kept.append(1) or keep(self, df, *by))
    passage = " ".join(f"w{i}" for i in range(300))
    docs = [(1, f"a {passage} b"), (2, f"c {passage}"), (3, passage[:700] + " d"), (4, "alone"), (5, "x" * 900), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_levels.remove_repeats(df).drop("clean")
    assert bag(tuple(r) for r in got.collect()) == brute_bytes(docs)
    assert added == [[0], [1], [0, 1], [0, 1]]
    assert len(kept) <= 25
