"""Usage ledger: one interval per plan an instance was on, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordered import hot_cuts, last_where, running, running_max

LEDGER = ["project_id", "instance_id", "plan_id", "seq", "started_at", "finished_at"]


def usage_ledger(changes: DataFrame, cuts: DataFrame | None | str = "detect") -> DataFrame:
    """Each plan change closes the open interval at its own time and opens a new one."""
    following = running(
        changes, ["instance_id"], ["ts", "seq"], backward=True, cuts=cuts, finished_at=last_where(F.col("ts"))
    )
    return following.withColumnRenamed("ts", "started_at").select(*LEDGER)


def ledger_upsert(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Ledger after a batch of changes; equals `usage_ledger` over all of them.

    Only intervals that reach the instance's first change of the batch are redone; the
    others are passed on as they are, so a small batch does not shuffle a large ledger.
    A change that is in the ledger already (a redelivery) reaches its own interval, and
    the two fall together.
    """
    first = changes.groupBy("instance_id").agg(F.min("ts").alias("__first"))
    marked = ledger.join(first, "instance_id", "left")
    reached = F.col("__first").isNotNull() & (
        F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("__first"))
    )
    kept = marked.where(~reached).select(*LEDGER)
    redone = marked.where(reached).withColumnRenamed("started_at", "ts")
    columns = ["project_id", "instance_id", "plan_id", "ts", "seq"]
    points = redone.select(*columns).unionByName(changes.select(*columns))
    # Hot instances are looked for before the rows are shuffled.
    cuts = hot_cuts(points, ["instance_id"], ["ts", "seq"])
    # A redelivery repeats all values, so any of them will do; minima of numbers hash.
    once = points.groupBy("instance_id", "ts", "seq").agg(
        F.min("project_id").alias("project_id"), F.min("plan_id").alias("plan_id")
    )
    return kept.unionByName(usage_ledger(once, cuts))


def open_usages(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("finished_at").isNull())


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """Instances with more than one open interval, or with intervals that overlap."""
    end = F.coalesce("finished_at", F.lit("9999-12-31").cast(ledger.schema["started_at"].dataType))
    before = running(
        ledger.withColumn("__end", end),
        ["instance_id"],
        ["started_at", "seq"],
        reached=running_max(F.col("__end"), exclusive=True),
    )
    found = before.groupBy("instance_id").agg(
        F.count_if(F.col("finished_at").isNull()).alias("open_rows"),
        F.count_if(F.col("reached") > F.col("started_at")).alias("overlaps"),
    )
    return found.where("open_rows > 1 OR overlaps > 0")


def microseconds(start: Column, end: Column) -> Column:
    """Exact length between two timestamps; the zone cancels out."""
    return F.timestamp_diff("MICROSECOND", start, end)


def usage_hours(ledger: DataFrame, start: str, end: str) -> DataFrame:
    """Billable time per project and plan inside a period; open intervals run to its end."""
    kind = ledger.schema["started_at"].dataType
    low, high = F.lit(start).cast(kind), F.lit(end).cast(kind)
    begin = F.greatest("started_at", low)
    finish = F.least(F.coalesce("finished_at", high), high)
    billed = ledger.where(begin < finish).withColumn("us", microseconds(begin, finish))
    return (
        billed.groupBy("project_id", "plan_id")
        .agg(F.count(F.lit(1)).alias("intervals"), F.sum("us").alias("billable_us"))
        .withColumn("billable_hours", F.round(F.col("billable_us") / F.lit(3.6e9), 2))
    )
