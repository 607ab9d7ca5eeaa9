import math
import re
from collections import Counter

import pytest

from harborline.llm import lexical

from .edge import bag, documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=20):
    split = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    split = [(doc_id, own, sum(own.values())) for doc_id, own in split if own]
    n_docs, n_terms = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, own, _ in split for t in own)
    queries = {}
    for item_id, text in dict.fromkeys(items):
        if item_id is not None and text is not None:
            queries.setdefault(item_id, Counter()).update(terms(text))
    out = []
    for item_id, query in queries.items():
        scored = []
        for doc_id, own, n in split:
            m = 75 + (25 * n * n_docs) // n_terms
            score = 0
            for t, times in query.items():
                if t in own:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * weight * ((10**9 * own[t]) // (1000 * own[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda x: x[:3])
        out += [(item_id, i, x[3], -x[0]) for i, x in enumerate(scored[:top], 1)]
    return bag(out)


def tables(spark):
    import random

    df, rows = documents(spark, clashing=True)
    rng = random.Random(9)
    items = [(i, words(rng, rng.randint(1, 25))) for i in range(30)]
    items += [(40, None), (None, "the river"), (41, ""), (42, "zzz unseen"), (43, "the THE the"), (44, "stone"), (44, "river")]
    items += [items[0], (45, rows[4][1])]
    made = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as score", "2 as rank", "3 as term")
    return df, [(r[0], r[1]) for r in rows], made, items


@pytest.mark.parametrize("top", [1, 3, 20])
def test_like_brute_force(spark, top):
    df, rows, made, items = tables(spark)
    got = lexical.search(df.repartition(3), made, top, shard_docs=7)  # many shards a task
    assert bag(tuple(r) for r in got.collect()) == brute(rows, items, top)


def test_items_in_several_pieces(spark, monkeypatch):
    df, rows, made, items = tables(spark)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 1000)
    assert bag(tuple(r) for r in lexical.search(df, made).collect()) == brute(rows, items)


def test_accumulators_stop_and_scores_stay_whole():
    import pyarrow as pa

    texts = [f"rare{i % 3} " + "common " * (i % 5 + 1) for i in range(50)] + ["common"] * 500
    items = lexical.Items([1], ["rare0 common"])
    block = pa.record_batch({"text": pa.array(texts), "doc_id": pa.array(range(550))})
    stats = next(lexical._statistics(iter([block]), items.vocabulary)).to_pylist()
    whole = next(r for r in stats if r["term"] is None)
    items.weigh(whole["documents"], whole["terms"], {r["term"]: r["documents"] for r in stats if r["term"] is not None})
    term, doc, tf, size = lexical._postings(block, items.vocabulary)
    ids = block.column("doc_id")
    shard = lexical._Shard([(term, doc, tf, size, ids.to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))], items)
    made = []

    class Seen(lexical._Best):
        def add(self, item, score, doc_id, no_id):
            made.append(len(score))
            super().add(item, score, doc_id, no_id)

    best = Seen(1, 10)
    shard.rank(0, *items.own[0], best)
    assert made[0] <= 17  # only documents with the rare term had an accumulator
    want = [eval(r) for r in brute(list(enumerate(texts)), [(1, "rare0 common")], 10)]
    assert sorted(zip(best.rows[0][1].tolist(), best.rows[0][0].tolist())) == sorted((r[2], r[3]) for r in want)


def test_empty(spark):
    df, _, made, _ = tables(spark)
    assert lexical.search(df.limit(0), made).count() == 0
    assert lexical.search(df, made.limit(0)).count() == 0
