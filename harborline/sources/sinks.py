"""Rows made for outside readers: monitoring discovery and state notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# The states that end a set-up or a power-off, and what is told about them.
INITIALIZED_EVENT = "instance:initialized"
NOTIFIED_STATES = {1: "running", 5: "disabled"}


def discovery_export(targets: DataFrame) -> DataFrame:
    """One JSON document per target: its labels and addresses, without internal ids.

    Empty secret and scheme are left out: to_json drops null fields.
    """
    labels = F.struct(
        F.col("node_id").cast("string").alias("node_id"),
        F.col("instance_id").cast("string").alias("instance_id"),
        "kind",
        "job",
        F.nullif("secret", F.lit("")).alias("__param_secret"),
        F.nullif("scheme", F.lit("")).alias("__scheme__"),
    )
    document = F.struct(labels.alias("labels"), F.array("target").alias("targets"))
    return targets.select(F.to_json(document).alias("json"))


def write_discovery(targets: DataFrame, path: str) -> None:
    discovery_export(targets).write.mode("overwrite").text(path)


def state_notifications(instances: DataFrame) -> DataFrame:
    """Channel, event and payload for every instance that finished a set-up or power-off."""
    label = F.lit(None).cast("string")
    for state, text in NOTIFIED_STATES.items():
        label = F.when(F.col("state") == state, text).otherwise(label)
    return instances.where(F.col("state").isin(*NOTIFIED_STATES)).select(
        F.concat(F.lit("private-instance-"), F.col("id").cast("string")).alias("channel"),
        F.lit(INITIALIZED_EVENT).alias("event"),
        F.to_json(F.struct(label.alias("state"))).alias("payload"),
    )


def notification_writer(instances: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Streaming sink; a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        state_notifications(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return instances.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
