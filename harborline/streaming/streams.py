"""Structured Streaming jobs over task messages, state changes and attempts.

Event-time columns are zoned timestamps (`as_event_time`). Work in flight is bounded by
the reader (`task_stream`), and state by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from harborline.operators.timeline import late_rows
from harborline.operators.usage import LEDGER, ledger_upsert
from harborline.session import is_small, remove_folder


def dedupe_deliveries(messages: DataFrame, ts: str, delay: str, spread: tuple[str, int] | None = None) -> DataFrame:
    """Each message id once, however often the queue delivers it within `delay`.

    Malformed messages have no id and do not belong here. `spread` names a column that
    differs between copies and a number of salts: copies are then dropped per salt
    first, so that one id with very many copies is not left to one task.
    """
    marked = messages.withWatermark(ts, delay)
    if spread:
        column, salts = spread
        marked = (
            marked.withColumn("__salt", F.pmod(F.xxhash64(column), F.lit(salts)))
            .dropDuplicatesWithinWatermark(["id", "__salt"])
            .drop("__salt")
        )
    return marked.dropDuplicatesWithinWatermark(["id"])


def enrich_stream(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Messages with their task; unknown ids and finished tasks fall out.

    Every batch reads all of `tasks`; where that is a large table use `enrich_writer`.
    """
    return messages.join(tasks.where(F.col("state") <= 0), "id")


def enrich_writer(messages: DataFrame, tasks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same, written per batch, reading only the tasks that the batch's ids span.

    The smallest and largest id of a batch become a filter on the scan, which skips files
    and row groups: messages are about recent tasks. A batch of few ids is broadcast,
    after counting it, so that the tasks are not shuffled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        span = batch.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
        near = tasks.where(F.col("id").between(F.lit(span.low), F.lit(span.high)))
        side = F.broadcast(batch) if is_small(batch, 200_000) else batch
        enrich_stream(side, near).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_state(changes: DataFrame) -> DataFrame:
    """Current state per instance. Combined map-side, so a hot instance is no burden."""
    latest = F.max_by(F.struct("state", "ts", "seq"), F.struct("ts", "seq"))
    return changes.groupBy("instance_id").agg(latest.alias("latest"))


# Every so many batches a batch writes all of its state and not what changed alone.
COMPACT_EVERY = 100


def _last_whole(batch_id: int, every: int) -> int:
    """The newest batch before this one that wrote all of its state."""
    return max(batch_id - 1, 0) // every * every


def _remove_older(spark: SparkSession, path: str, batch_id: int, every: int) -> None:
    """Remove what came before the newest whole state, once the batch after that one runs."""
    whole = _last_whole(batch_id, every)
    if whole and batch_id == whole + 1:
        for old in range(whole - every, whole):
            remove_folder(spark, f"{path}/batch={old}")


def live_state_writer(
    changes: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY
) -> DataStreamWriter:
    """Write the instances that changed in each batch; `read_live_state` reduces them.

    Every `compact_every`-th batch also takes in the rows of those before it, which are removed after
    that: the reader has the changes of so many batches beside one row an instance.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("instance_id", "latest.*")
        if batch_id and batch_id % compact_every == 0:
            since = F.col("batch").between(_last_whole(batch_id, compact_every), batch_id - 1)
            rows = rows.unionByName(spark.read.parquet(path).where(since).select(*rows.columns))
            latest = F.max_by(F.struct("state", "ts", "seq"), F.struct("ts", "seq"))
            rows = rows.groupBy("instance_id").agg(latest.alias("latest")).select("instance_id", "latest.*")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        _remove_older(spark, path, batch_id, compact_every)

    return (
        live_state(changes)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )


def read_live_state(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("instance_id").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"))


LEDGER_SCHEMA = "project_id long, instance_id long, plan_id long, seq long, started_at timestamp, finished_at timestamp"


def live_ledger_writer(
    changes: DataFrame, path: str, checkpoint: str, buckets: int = 64, compact_every: int = COMPACT_EVERY
) -> DataStreamWriter:
    """Streaming usage ledger: a change closes its instance's open interval.

    Each batch of changes is merged with the open intervals of its instances, by the same job as
    the batch ledger, so a hot instance is cut into pieces here as well. Batch n writes
    closed/batch=n, and to open/batch=n the open intervals of the instances it touched, one row each.
    It reads those of earlier batches in the buckets of its instances only. Every `compact_every`-th
    batch writes all open intervals, and what came before is removed after it. A batch that is replayed after a
    failure reads what it read and writes the same rows again. A change older than its
    instance's open interval goes to late/batch=n and does not reopen anything.
    """
    bucket = F.pmod(F.xxhash64("instance_id"), F.lit(buckets)).cast("int").alias("bucket")

    def opened_before(spark: SparkSession, batch_id: int) -> DataFrame:
        """The newest open interval of each instance, with its bucket."""
        if batch_id == 0:
            return spark.createDataFrame([], f"{LEDGER_SCHEMA}, bucket int")
        rows = spark.read.schema(f"{LEDGER_SCHEMA}, batch int, bucket int").parquet(f"{path}/open")
        rows = rows.where(F.col("batch").between(_last_whole(batch_id, compact_every), batch_id - 1))
        newest = F.max_by(F.struct(*LEDGER), "batch")
        return rows.groupBy("instance_id", "bucket").agg(newest.alias("row")).select("row.*", "bucket")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Read the batch's files once; several of the writes below use it.
        batch = batch.select("project_id", "instance_id", "plan_id", "seq", "ts").persist()
        all_open = opened_before(spark, batch_id)
        # At most `buckets` numbers, which prune the folders that are read.
        touched = [r.bucket for r in batch.select(bucket).distinct().collect()]
        mine = batch.select("instance_id").distinct()
        before = all_open.where(F.col("bucket").isin(touched)).select(*LEDGER).join(mine, "instance_id", "left_semi")
        opened = before.select(
            "instance_id", F.struct(F.col("started_at").alias("ts"), F.col("seq")).alias("__opened")
        )
        marked = batch.join(opened, "instance_id", "left")
        is_late = F.coalesce(F.struct("ts", "seq") < F.col("__opened"), F.lit(False))
        marked.where(is_late).drop("__opened").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        after = ledger_upsert(before, marked.where(~is_late).drop("__opened"))
        # Written once and read back, so that both parts come from the same rows.
        merged = f"{path}/merged/batch={batch_id}"
        after.select(*LEDGER).write.mode("overwrite").parquet(merged)
        written = spark.read.schema(LEDGER_SCHEMA).parquet(merged)
        written.where("finished_at IS NOT NULL").write.mode("overwrite").parquet(f"{path}/closed/batch={batch_id}")
        still = written.where("finished_at IS NULL").select(*LEDGER, bucket)
        if batch_id and batch_id % compact_every == 0:
            still = still.unionByName(all_open.join(mine, "instance_id", "left_anti").select(*LEDGER, "bucket"))
        still.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/open/batch={batch_id}")
        batch.unpersist()
        remove_folder(spark, merged)
        _remove_older(spark, f"{path}/open", batch_id, compact_every)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_open_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Open intervals of a live ledger: the newest that any batch wrote for each instance."""
    rows = spark.read.schema(f"{LEDGER_SCHEMA}, batch int, bucket int").parquet(f"{path}/open")
    return rows.groupBy("instance_id").agg(F.max_by(F.struct(*LEDGER), "batch").alias("row")).select("row.*")


def windowed_tasks(tasks: DataFrame, ts: str, size: str, slide: str, delay: str) -> DataFrame:
    """Tasks per action in event-time windows; rows behind the watermark are dropped."""
    return (
        tasks.withWatermark(ts, delay)
        .groupBy(F.window(ts, size, slide).alias("window"), "action")
        .agg(F.count(F.lit(1)).alias("tasks"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "action", "tasks"
        )
    )


def session_bursts(attempts: DataFrame, gap: str, delay: str) -> DataFrame:
    """Attempts on a target with no longer pause than `gap`, once the session has closed."""
    return (
        attempts.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("session"), "target")
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("succeeded"))
        .select(
            "target",
            F.col("session.start").alias("started_at"),
            F.col("session.end").alias("closes_at"),
            "attempts",
            "succeeded",
        )
    )


def late_row_writer(
    df: DataFrame, source: str, ts: str, arrival: list[str], bound: str, path: str, checkpoint: str
) -> DataStreamWriter:
    """Set rows apart that come more than `bound` behind the newest earlier arrival of their source.

    The rule is that of `timeline.late_rows`, whichever way the input falls into batches: the newest
    time per source is carried from batch to batch, one row each, and stands before the batch's
    own rows in the order of arrival.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        here = batch.groupBy(source).agg(F.max(ts).alias("newest"))
        rows = batch.withColumn("__own", F.lit(1))
        if batch_id > 0:
            before = spark.read.schema(here.schema).parquet(f"{path}/newest/batch={batch_id - 1}")
            carried = before.select(source, F.col("newest").alias(ts), F.lit(0).alias("__own"))
            rows = rows.unionByName(carried, allowMissingColumns=True)
            here = here.unionByName(before).groupBy(source).agg(F.max("newest").alias("newest"))
        late = late_rows(rows, source, ts, ["__own", *arrival], bound).where("__own = 1").drop("__own")
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        here.write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_to_end(writer: DataStreamWriter) -> None:
    """Process what is available now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


# Writes the files of a checkpoint through FileSystem. On local folders the default, FileContext, starts
# a shell command for each file's permissions and links, which takes longer than all else about a small batch.
FILE_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
BY_FILE_SYSTEM = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def run_until_idle(writer: DataStreamWriter, checkpoint: str | None = None) -> None:
    """Process batch after batch until nothing is left, then stop: for sources that bound a batch themselves.

    `run_to_end` asks such a source for its end once, before the first batch, and stops at its first bound. Where `checkpoint`
    names a local folder, its files are written without shell commands; renaming is atomic there either way.
    """
    spark = writer._spark
    before = spark.conf.get(FILE_MANAGER, None)
    local = checkpoint is not None and ("://" not in checkpoint or checkpoint.startswith("file:"))
    if local and before is None:
        spark.conf.set(FILE_MANAGER, BY_FILE_SYSTEM)
    try:
        query = writer.trigger(processingTime="0 seconds").start()
    finally:
        if local and before is None:
            spark.conf.unset(FILE_MANAGER)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def append_rows(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
