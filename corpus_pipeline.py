"""From raw documents to a mixed training corpus, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import fmindex, mixing, secret_scan, token_groups, toxicity
from harborline.llm.stored import Stored
from harborline.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """`docs` with another text, and the count of its characters."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    configure(spark)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(docs, model) < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    configure(spark)
    return token_groups.keep_one_of_each(docs.select(*COLUMNS))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of benchmark passages."""
    configure(spark)
    return _with_text(docs, fmindex.without_benchmark(docs, _table(spark, sf_dir, "benchmark")))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    configure(spark)
    return _with_text(docs, secret_scan.redacted(docs, secret_scan.fit(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies; size and targets count what came here."""
    configure(spark)
    return mixing.apply_plan(docs, mixing.mixing_plan(docs), COLUMNS).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", cut_secrets),
    ("mixing", mix),
]

# Scores of a fitted model decide on rows, so SQL cannot say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`; each result is written and read again."""
    configure(spark)
    stored = Stored(spark, "pipeline")
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = stored.keep(stage(spark, docs, sf_dir))
        if before is not None:
            stored.drop(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
