"""Messages that wait for their task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def await_tasks(messages: DataFrame, tasks: DataFrame, delay: str, before: str, wait: str) -> DataFrame:
    """Each message of a stream with its task from another, whichever comes first; `rejected` where none came.

    A task belongs to a message if it was created at most `before` ahead of it and at most `wait` after it. Messages and tasks
    have (id, ts) and (id, created_at) as event times, each up to `delay` late. A message is held until its task
    comes, then comes out at once; when both watermarks have passed its `wait` it comes out rejected, once, with
    nulls for the task. So state holds the messages of `delay` and `wait`, and the tasks of `delay` and `before`, however long the stream runs.

    Malformed messages have no id and do not belong here; a message with a null id or time is never matched. Copies of a message
    are judged each (see `dedupe_deliveries`); several tasks of one id give a row each.
    """
    asked = messages.withWatermark("ts", delay)
    known = tasks.select(*[F.col(c).alias(f"task_{c}" if c == "id" else c) for c in tasks.columns])
    known = known.withWatermark("created_at", delay)
    near = (
        (F.col("id") == F.col("task_id"))
        & (F.col("created_at") >= F.col("ts") - F.expr(f"INTERVAL {before}"))
        & (F.col("created_at") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    )
    return asked.join(known, near, "left_outer").withColumn("rejected", F.col("task_id").isNull()).drop("task_id")
