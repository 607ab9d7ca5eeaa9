"""Batch tables and the task stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_table(spark: SparkSession, folder: str, name: str, cols: Sequence[str]) -> DataFrame:
    """One table with an explicit, ordered column list; only these columns are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*cols)


def task_stream(
    spark: SparkSession, folder: str, schema: StructType, max_files: int = 100, pattern: str | None = None
) -> DataFrame:
    """Unbounded task messages from files. `max_files` bounds the work in flight; the
    reader's checkpoint is what resumes it after a restart."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def decode_messages(messages: DataFrame, body_col: str = "body") -> DataFrame:
    """Add the `id` of a JSON body and whether the body is malformed.

    A malformed body is kept as a row with a null id, to be stored apart, not retried.
    """
    id_ = F.from_json(F.col(body_col), "id long")["id"]
    return messages.withColumn("id", id_).withColumn("is_malformed", F.col("id").isNull())


def route_unknown(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Well-formed messages whose task does not exist."""
    known = tasks.select("id")
    return messages.where(~F.col("is_malformed")).join(known, "id", "left_anti")


def as_event_time(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps without a zone, read in the session's zone, as a watermark needs them."""
    casts: dict[str, Column] = {c: F.col(c).cast("timestamp") for c in cols}
    return df.withColumns(casts)
