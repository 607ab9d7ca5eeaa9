import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import secret_scan, toxicity
from harborline.llm.queries import ORACLE, QUERIES

from .edge import documents, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic documents, near copies, a benchmark passage and a secret in them."""
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(400):
        text = words(rng, rng.randint(30, 90)).split(" ")
        if i % 5 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["nitwit", "blockhead", "scoundrel"]))
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    passage = words(rng, 14)
    rows.append((1001, rows[1][1] + " more", "en", "s1", 0))
    rows.append((1002, f"{rows[2][1]} {passage} {rows[3][1]}", "en", "s2", 0))
    rows.append((1003, f'{words(rng, 40)} token = "0123456789abcdef0123456789abcdef" {words(rng, 40)}', "en", "s3", 0))
    rows += [(None, None, None, None, None), (2000, "", "en", "s0", 0), (2000, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage


def test_each_stage(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, path).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and len(ids & set(range(0, 400, 5))) < 8
    assert len(ids & {i for i in range(400) if i % 5}) > 312 and {None, 2000, 1001, 1002, 1003} <= ids
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))).collect()}
    assert ids == {i for i, s in scores.items() if s < 0.5}

    single = corpus_pipeline.drop_near_duplicates(spark, kept, path).cache()
    left = [r.doc_id for r in single.collect()]
    assert single.columns == columns and sorted(map(str, left)) == sorted(
        str(r.doc_id) for r in kept.collect() if not (r.doc_id == 1001 and 1 in ids)
    )

    clean = corpus_pipeline.cut_benchmark(spark, single, path).cache()
    assert clean.columns == columns and clean.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        if r.doc_id == 1002:
            assert passage.rstrip(".,") in before[1002] and passage.rstrip(".,") not in r.text
        else:
            assert r.text == before[r.doc_id]
        assert r.n_chars == (None if r.text is None else len(r.text))

    safe = corpus_pipeline.cut_secrets(spark, clean, path).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        assert (r.text == before[r.doc_id]) == (r.doc_id != 1003)
        assert "0123456789abcdef" not in (r.text or "")

    mixed = corpus_pipeline.mix(spark, safe, path).collect()
    sizes = {r.source: r.source_size for r in mixed}
    for source in ("s0", "s1", "s2", "s3"):
        taken = sum(r.taken for r in mixed if r.source == source)
        target = next(r.target for r in mixed if r.source == source)
        assert abs(taken - target) <= 110 and target <= 3 * sizes[source] + 1e-6


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == want


def test_empty_and_odd_input(spark, folder):
    path, _ = folder
    odd, _ = documents(spark)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, path)
        docs.collect()


def test_fits_take_no_memory_of_the_driver(spark, folder, monkeypatch):
    """The texts that the models are fitted on, and all that is made of them, stay in a task."""
    path, _ = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")

    def here(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(toxicity, "_toxic_content", here)
    monkeypatch.setattr(secret_scan, "_training_pieces", here)
    assert toxicity.fit(docs, labels).toxic and secret_scan.fit(docs).states[0].any()


def test_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES}
    assert numbers == set(range(1, 14)) and set(ORACLE) <= set(QUERIES)
