import random
import zlib

import numpy as np
import pyarrow as pa

from harborline.llm import toxicity

from .edge import documents, words


def test_folds(spark):
    df, _ = documents(spark)
    got = df.select("doc_id", toxicity.held_out(df["doc_id"]).alias("h")).collect()
    for r in got:
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = words(rng, rng.randint(30, 300)).split(" ")
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(["nitwit", "blockhead", "scoundrel", "dimwitted"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    got = [r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect() if r.held_out]
    right = sum(truth[r.doc_id] == r.predicted for r in got)
    assert len(got) > 100 and right / len(got) > 0.9
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_labels_of_the_held_out_are_not_read(spark):
    docs, labels, _ = labelled(spark)
    kept = labels.where(~toxicity.held_out(labels["doc_id"]))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, kept)
    assert one.toxic == two.toxic and np.array_equal(one.weights, two.weights)


def test_awkward_rows(spark):
    docs, labels, _ = labelled(spark)
    model = toxicity.fit(docs, labels)
    df, rows = documents(spark, clashing=True)
    got = toxicity.score_toxicity(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    # Blocks do not change a score.
    texts = pa.array([r[1] for r in rows], pa.string())
    assert np.allclose(model.score(texts), [model.score(texts.slice(i, 1))[0] for i in range(len(texts))])


def test_marks_behind_a_long_beginning(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 4000).ljust(20_001) + (" nitwit blockhead scoundrel" if i % 2 else " ") + words(rng, 20)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))
    assert any(b"nitwit" in content for content in model.toxic)
    got = toxicity.score_toxicity(docs, model).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 76


def test_the_sample_is_whole_texts(spark):
    rows = [(i, chr(97 + i) * (10 + i)) for i in range(20)] + [(None, "z"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, size in ((50, 10_000), (5, 10_000), (50, 60), (50, 1)):
        got = toxicity.whole_texts(docs.where("doc_id is not null"), "doc_id", n, size)
        assert set(got) <= {r[1] for r in rows} and 1 <= len(got) <= n and (len(got) == 1 or sum(map(len, got)) <= size)
    assert len(toxicity.whole_texts(docs, "doc_id", 50, 10_000)) == 21 and toxicity.whole_texts(docs.limit(0), "doc_id", 5, 5) == []


def test_without_labels(spark):
    df, rows = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(df, toxicity.fit(df, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert all(0 < r.score < 0.5 for r in toxicity.score_toxicity(df, toxicity.fit(df, one)).collect())
