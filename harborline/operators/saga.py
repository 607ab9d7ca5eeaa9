"""Outcome of tasks run step by step: do, fail, undo, resume.

Steps have (task_id, step_idx, step_name, do_ok, undo_ok). A step's outcome is stored by
its name, so a second step of the same name is skipped. The first step that fails ends
the task; then every step that was reached is undone in reverse order, the failing one
first, one undo per name at its last place, until an undo fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.operators.ordered import hot_cuts, running, running_count
from harborline.plans.actions import action_catalogue

STAGES = ["done", "failed", "undone", "undone_failed"]


Cuts = DataFrame | None | str  # of (task_id, step_idx), from `hot_cuts`, or "detect"


def _task_cuts(steps: DataFrame, cuts: Cuts, rows_per_piece: int | None = None) -> DataFrame | None:
    return hot_cuts(steps, ["task_id"], ["step_idx"], rows_per_piece) if isinstance(cuts, str) else cuts


def effective_steps(steps: DataFrame) -> DataFrame:
    """Flag the steps that are skipped because an earlier one had their name."""
    seen = running(steps, ["task_id", "step_name"], ["step_idx"], earlier=running_count(exclusive=True))
    return seen.withColumn("skipped_duplicate", F.col("earlier") > 0).drop("earlier")


def _places_by_window(steps: DataFrame) -> DataFrame:
    """First and last place of each name, first failure and undo stop of its task.

    All windows share the task's partitioning: one shuffle for the whole rule.
    """
    task = Window.partitionBy("task_id")
    name = Window.partitionBy("task_id", "step_name")
    first = F.col("step_idx") == F.col("first_idx")
    reached = F.col("step_idx") <= F.col("fail_idx")
    last = F.col("step_idx") == F.col("last_idx")
    return (
        steps.repartition("task_id")
        .withColumn("first_idx", F.min("step_idx").over(name))
        .withColumn("fail_idx", F.min(F.when(first & ~F.col("do_ok"), F.col("step_idx"))).over(task))
        .withColumn("last_idx", F.max(F.when(reached, F.col("step_idx"))).over(name))
        .withColumn("stop_idx", F.max(F.when(last & ~F.col("undo_ok"), F.col("step_idx"))).over(task))
        .where(first)
        .select("task_id", "step_name", "first_idx", "fail_idx", "last_idx", "stop_idx")
    )


def _places_by_aggregate(steps: DataFrame) -> DataFrame:
    """The same from grouped aggregates, which combine map-side: for tasks too large for
    one window. The joins against one row per failed task split at run time when skewed."""
    first = steps.groupBy("task_id", "step_name").agg(
        F.min("step_idx").alias("first_idx"), F.min_by("do_ok", "step_idx").alias("first_ok")
    )
    fails = first.where(~F.col("first_ok")).groupBy("task_id").agg(F.min("first_idx").alias("fail_idx"))
    last = (
        steps.join(fails, "task_id")
        .where(F.col("step_idx") <= F.col("fail_idx"))
        .groupBy("task_id", "step_name")
        .agg(F.max("step_idx").alias("last_idx"), F.max_by("undo_ok", "step_idx").alias("last_undo_ok"))
    )
    stops = last.where(~F.col("last_undo_ok")).groupBy("task_id").agg(F.max("last_idx").alias("stop_idx"))
    return (
        first.join(last, ["task_id", "step_name"], "left")
        .join(fails, "task_id", "left")
        .join(stops, "task_id", "left")
        .select("task_id", "step_name", "first_idx", "fail_idx", "last_idx", "stop_idx")
    )


def _places(steps: DataFrame, cuts: DataFrame | None) -> DataFrame:
    return _places_by_window(steps) if cuts is None else _places_by_aggregate(steps)


def saga_outcome(steps: DataFrame, rows_per_piece: int | None = None, cuts: Cuts = "detect") -> DataFrame:
    """Final stage of every step name that was run, and the state of its task.

    Task state is 2 after a failure, else 1. A task without steps has no rows here and is
    in state 1: left join from the task table and fill in 1.
    """
    first, fail = F.col("first_idx"), F.col("fail_idx")
    last, stop = F.col("last_idx"), F.col("stop_idx")
    no_fail = fail.isNull()
    undoing = last.isNotNull()
    return (
        _places(steps, _task_cuts(steps, cuts, rows_per_piece))
        .where(no_fail | (first <= fail))
        .select(
            "task_id",
            "step_name",
            first.alias("step_idx"),
            (no_fail | (first < fail)).alias("done"),
            F.coalesce(first == fail, F.lit(False)).alias("failed"),
            (undoing & (stop.isNull() | (last > stop))).alias("undone"),
            F.coalesce(undoing & (last == stop), F.lit(False)).alias("undone_failed"),
            F.when(no_fail, 1).otherwise(2).alias("task_state"),
        )
    )


def task_results(tasks: DataFrame, outcome: DataFrame) -> DataFrame:
    """Final state of every task. One that ran no steps is ok, even when that is because
    no workflow knows its action, which `known_action` tells."""
    states = outcome.groupBy("task_id").agg(F.max("task_state").alias("__state"))
    # Sixty rows, fixed in the catalogue: always small enough to broadcast.
    known = F.broadcast(action_catalogue(tasks.sparkSession).withColumn("__known", F.lit(True)))
    return (
        tasks.join(states, tasks["id"] == states["task_id"], "left")
        .join(known, "action", "left")
        .select(
            "id",
            "action",
            F.col("__known").isNotNull().alias("known_action"),
            F.coalesce("__state", F.lit(1)).alias("state"),
        )
    )


def undo_plan(steps: DataFrame, rows_per_piece: int | None = None, cuts: Cuts = "detect") -> DataFrame:
    """Order in which a failed task undoes its steps, the failing one first.

    A task that is not large in `steps` is not in its stack, so one look for hot tasks serves both.
    """
    cuts = _task_cuts(steps, cuts, rows_per_piece)
    stack = _places(steps, cuts).where(F.col("last_idx").isNotNull())
    ordered = running(
        stack.select("task_id", "step_name", F.col("last_idx").alias("step_idx")),
        ["task_id"],
        ["step_idx"],
        backward=True,
        cuts=cuts,
        undo_no=running_count(),
    )
    return ordered


def resume_point(steps: DataFrame, stages: DataFrame) -> DataFrame:
    """Where a redelivered task goes on: the first step that is not done, to do it or,
    if it failed, to undo; `finish` when all are done. A minimum per task, no window."""
    known = stages.select("task_id", "step_name", F.col("done").alias("__done"), F.col("failed").alias("__failed"))
    looked_up = steps.join(known, ["task_id", "step_name"], "left")
    is_open = ~F.coalesce("__done", F.lit(False))
    here = F.struct("step_idx", "step_name", F.coalesce("__failed", F.lit(False)).alias("is_failed"))
    return (
        looked_up.groupBy("task_id")
        .agg(F.min(F.when(is_open, here)).alias("next"))
        .select(
            "task_id",
            F.when(F.col("next").isNull(), "finish").when(F.col("next.is_failed"), "undo").otherwise("do").alias("resume"),
            "next.step_idx",
            "next.step_name",
        )
    )


def encode_stages(outcome: DataFrame, column: str = "data") -> DataFrame:
    """(task_id, `column`): a task's stages as it stores them, one JSON object by step name.

    It is one value of the task's row, so all stages of a task meet in it.
    """
    stage = F.struct(*STAGES)
    entries = F.map_from_entries(F.collect_list(F.struct("step_name", stage)))
    return outcome.groupBy("task_id").agg(F.to_json(entries).alias(column))


def stage_counts(tasks: DataFrame, column: str = "data") -> DataFrame:
    """Done, failed, undone and undone_failed per step name, from each task's stage map."""
    flags = ",".join(f"{name}:boolean" for name in STAGES)
    parsed = F.from_json(column, f"map<string,struct<{flags}>>")
    rows = tasks.select(F.explode(parsed).alias("step_name", "stage"))
    return rows.groupBy("step_name").agg(
        F.count(F.lit(1)).alias("stages"),
        *[F.count_if(F.coalesce(F.col(f"stage.{name}"), F.lit(False))).alias(name) for name in STAGES],
    )


def top_failing_steps(outcome: DataFrame, k: int) -> DataFrame:
    """The `k` step names that failed most, ties by name."""
    failures = outcome.groupBy("step_name").agg(F.count_if("failed").alias("failures"))
    return failures.where("failures > 0").orderBy(F.desc("failures"), F.asc("step_name")).limit(k)
