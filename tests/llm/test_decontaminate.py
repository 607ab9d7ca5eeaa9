import hashlib
import pickle
import random
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.core.broadcast import Broadcast

from harborline.llm import fmindex

from .edge import bag, documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(docs, items, window=10):
    rows = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, body in items:
            if item is None or body is None:
                continue
            v = split(body)
            n = min(window, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        names = ",".join(sorted(found))
        rows.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return bag(rows)


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_like_brute_force(spark, shard_bytes):
    df, rows = documents(spark, clashing=True)
    full = [r[1] for r in rows if r[1]]
    items = [(i, " ".join(full[i].split()[3:20])) for i in range(5)]
    items += [(100, "one TWO"), (100, "one TWO"), (7, ""), (8, None), (None, full[0]), (9, "absent words"), (20, "again " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = fmindex.decontaminate(df, bench, shard_bytes=shard_bytes).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )
    assert bag(tuple(r) for r in got.collect()) == brute([(r[0], r[1]) for r in rows], items)


def test_blocks_of_the_benchmark_and_spans(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, words(rng, 14)) for i in range(30)]
    docs = [(i, f"Start here, {items[i][1]} - and the é end.") for i in range(10)] + [(10, "nothing of it")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(fmindex.benchmark_blocks, "__defaults__", (10, 400))
    assert len(fmindex.benchmark_blocks(bench)) > 3
    got = {r.doc_id: r for r in fmindex.decontaminate(df, bench, with_text=True).collect()}
    assert bag((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.values()) == brute(docs, items)
    for i in range(10):
        assert len(got[i].spans) == 1
        a, b = got[i].spans[0]
        assert docs[i][1][a:b].rstrip(".,") == items[i][1].rstrip(".,")
        assert got[i].clean_text == docs[i][1][:a] + docs[i][1][b:]
    assert got[10].clean_text == docs[10][1] and not got[10].contaminated


def test_one_block_of_the_benchmark_at_a_time(tmp_path, monkeypatch):
    alive = weakref.WeakSet()
    rng = random.Random(8)
    texts = [words(rng, 14) for _ in range(6)]
    blocks = []
    for i, text in enumerate(texts):
        (tmp_path / str(i)).write_bytes(pickle.dumps(fmindex.Phrases([i], [text], 10)))
        blocks.append(Broadcast(path=str(tmp_path / str(i))))
    load, most = Broadcast.load_from_path, []

    def watched(self, path):
        value = load(self, path)
        alive.add(value)
        most.append(len(alive))
        return value

    monkeypatch.setattr(Broadcast, "load_from_path", watched)
    shard = pa.record_batch({"doc_id": list(range(6)), "text": texts})
    for _ in range(2):  # a worker's next shard
        got = fmindex._search_shard(shard, blocks, False)
        assert got.column("items").to_pylist() == [[str(i)] for i in range(6)]
    assert max(most) == 1 and len(most) == 12


def test_empty_tables(spark):
    df, rows = documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in fmindex.decontaminate(df, none).collect())
    assert fmindex.decontaminate(df.limit(0), none).count() == 0


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5, rng.integers(0, 60)).astype(np.uint64) for _ in range(80)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index = fmindex.FMIndex(np.concatenate(docs), first)
    phrases, lengths = rng.integers(0, 6, (60, 4)).astype(np.uint64), rng.integers(1, 5, 60)
    low, high = index.search(index.number(phrases.ravel()).reshape(phrases.shape), lengths)
    for phrase, n, a, b in zip(phrases, lengths, low, high):
        place = index.locate(np.arange(a, max(a, b)))
        doc = np.searchsorted(index.begin, place, "right") - 1
        found = sorted(zip(doc.tolist(), (place - index.begin[doc]).tolist()))
        assert found == [
            (d, i) for d, t in enumerate(docs) for i in range(len(t) - n + 1) if (t[i : i + n] == phrase[:n]).all()
        ]


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300):
        s = rng.integers(0, 3, n)
        assert fmindex.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    assert fmindex.suffix_array(np.ones(1000, np.int64)).tolist() == list(range(999, -1, -1))
