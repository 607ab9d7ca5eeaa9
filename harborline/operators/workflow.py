"""Workflow definitions: expanding tasks into steps, and checks on the steps.

A definition table has (action, idx, step, command, wants, provides, condition); a step
with a condition runs only for tasks whose metadata has that key. The checks take any
table with such steps and the columns `by` that group them: ["action"] for definitions,
["task_id"] for expanded tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.documents import CONDITION_KEYS, metadata_map
from harborline.operators.ordered import last_where, running
from harborline.session import is_small


ENTRY = ["idx", "step", "command", "wants", "provides", "condition"]


def _steps_by_action(defs: DataFrame) -> DataFrame:
    """One row per action with its steps as an array, in order."""
    return defs.groupBy("action").agg(F.array_sort(F.collect_list(F.struct(*ENTRY))).alias("flow"))


def _unfold(rows: DataFrame, present: str) -> DataFrame:
    """The steps of `flow` whose condition is among `present`, numbered from 1."""
    due = F.filter("flow", lambda s: s["condition"].isNull() | F.array_contains(F.col(present), s["condition"]))
    kept = [c for c in rows.columns if c != "flow"]
    return rows.select(*kept, F.posexplode(due).alias("pos", "s")).select(
        *kept, (F.col("pos") + 1).alias("idx"), *[f"s.{name}" for name in ENTRY[1:]]
    )


def _with_given(tasks: DataFrame) -> DataFrame:
    keys = F.map_keys(metadata_map(F.col("metadata")))
    return tasks.select(F.col("id").alias("task_id"), "action", keys.alias("given"))


# Steps of all variants together that may be broadcast.
MAX_STEPS = 200_000


def _variants(defs: DataFrame, max_steps: int) -> tuple[DataFrame, DataFrame] | None:
    """Steps per (action, variant), and the conditions of each action.

    The steps of a task depend only on its action and on which of that action's
    conditions it meets: a variant is the array of those it meets. All variants follow
    from the definitions, so their steps are counted first; None beyond `max_steps`.
    """
    if not is_small(defs, max_steps):
        return None
    conditions = F.transform("flow", lambda s: s["condition"])
    flows = _steps_by_action(defs).withColumn(
        "conditions", F.array_sort(F.array_distinct(F.array_compact(conditions)))
    )
    variants = F.lit(2.0) ** F.size("conditions")
    size = flows.agg(F.sum(variants * F.size("flow")).alias("steps"))
    if (size.first().steps or 0) > max_steps:
        return None
    # Bit i of the variant's number says whether condition i is met.
    number = F.explode(F.sequence(F.lit(0), variants.cast("int") - 1))
    listed = flows.select("action", "flow", "conditions", number.alias("number"))
    met = F.expr("filter(conditions, (c, i) -> (number & shiftleft(1, i)) <> 0)")
    steps = _unfold(listed.select("action", "flow", met.alias("variant")), "variant")
    return steps, flows.select("action", "conditions")


def _to_tasks(tasks: DataFrame, found: DataFrame, conditions: DataFrame) -> DataFrame:
    """Each task with what was found for its variant, as an array of rows. Both sides that
    are broadcast are bounded by the number of variants; the tasks are not shuffled."""
    by = ["action", "variant"]
    row = F.struct(*[c for c in found.columns if c not in by])
    arrays = found.groupBy(*by).agg(F.collect_list(row).alias("found"))
    marked = _with_given(tasks).join(F.broadcast(conditions), "action")
    marked = marked.withColumn("variant", F.expr("filter(conditions, c -> array_contains(given, c))"))
    return marked.join(F.broadcast(arrays), by)


def expand_workflow(tasks: DataFrame, defs: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Steps of each task, numbered from 1. A task with an unknown action has none.

    The steps travel as one array beside the task, so the tasks are not shuffled.
    """
    variants = _variants(defs, max_steps)
    if variants is None:
        flows = _steps_by_action(defs)
        if is_small(defs):
            flows = F.broadcast(flows)
        return _unfold(_with_given(tasks).join(flows, "action"), "given").select("task_id", "action", "given", *ENTRY)
    return _to_tasks(tasks, *variants).select("task_id", "action", "given", F.inline("found")).select(
        "task_id", "action", "given", *ENTRY
    )


def steps_by_variant(tasks: DataFrame, defs: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Steps of each (action, variant) that tasks have, with the number of those tasks.

    For sums over tasks: as many rows as the definitions have, whatever the number of tasks.
    """
    variants = _variants(defs, max_steps)
    if variants is None:
        return expand_workflow(tasks, defs, max_steps).withColumn("tasks", F.lit(1).cast("long"))
    steps, conditions = variants
    marked = _with_given(tasks).join(F.broadcast(conditions), "action")
    marked = marked.withColumn("variant", F.expr("filter(conditions, c -> array_contains(given, c))"))
    counted = marked.groupBy("action", "variant").agg(F.count(F.lit(1)).alias("tasks"))
    return counted.join(F.broadcast(steps), ["action", "variant"])


def analyse_tasks(
    tasks: DataFrame,
    defs: DataFrame,
    analyse: Callable[[DataFrame, list[str]], DataFrame],
    keep: Callable[[Column, Column], Column] | None = None,
    max_steps: int = MAX_STEPS,
) -> DataFrame:
    """A check below, per task: its result with task_id and action in front.

    It is done once per variant of an action, and tasks are joined to the result; with
    too many variants the tasks are expanded instead. `keep` may drop a row of the result
    by the keys its task was given.
    """
    variants = _variants(defs, max_steps)
    if variants is None:
        by = ["task_id", "action", "given"]
        found = analyse(expand_workflow(tasks, defs, max_steps), by)
        if keep:
            row = F.struct(*[c for c in found.columns if c not in by])
            found = found.where(keep(row, F.col("given")))
        return found.drop("given")
    steps, conditions = variants
    marked = _to_tasks(tasks, analyse(steps, ["action", "variant"]), conditions)
    rows = F.col("found") if keep is None else F.filter("found", lambda row: keep(row, F.col("given")))
    return marked.select("task_id", "action", F.inline(rows))


def _wanted(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    return steps.select(*by, "idx", "step", F.explode("wants").alias("key"))


def _provided(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    return steps.select(*by, "idx", "step", F.explode("provides").alias("key"))


def unmet_wants(steps: DataFrame, given: Sequence[str] | str, by: Sequence[str]) -> DataFrame:
    """Steps that want a key which is neither given nor provided by an earlier step.

    `given` is a list of keys, or the name of an array column of `steps`.
    """
    if isinstance(given, str):
        open_keys = F.array_except("wants", F.col(given))
    else:
        open_keys = F.array_except("wants", F.array(*[F.lit(k) for k in given]).cast("array<string>"))
    wanted = steps.select(*by, "idx", "step", F.explode(open_keys).alias("key"))
    earliest = _provided(steps, by).groupBy(*by, "key").agg(F.min("idx").alias("__from"))
    joined = wanted.join(earliest, [*by, "key"], "left")
    return joined.where(F.col("__from").isNull() | (F.col("__from") >= F.col("idx"))).select(*by, "idx", "step", "key")


def required_inputs(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys that are wanted but that no step provides, so they must come from outside."""
    wants = _wanted(steps, by).select(*by, "key", F.lit(0).alias("made"))
    makes = _provided(steps, by).select(*by, "key", F.lit(1).alias("made"))
    return (
        wants.unionByName(makes).groupBy(*by, "key").agg(F.max("made").alias("made")).where("made = 0").select(*by, "key")
    )


def step_edges(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges from the latest earlier step that provides a key to the step that wants it."""
    makes, uses = F.lit(1), F.lit(0)  # at one step its wants come before what it provides
    rows = (
        _wanted(steps, by)
        .withColumn("makes", uses)
        .unionByName(_provided(steps, by).withColumn("makes", makes))
    )
    producer = last_where(F.struct(F.col("idx"), F.col("step")), F.col("makes") == 1)
    linked = running(rows, [*by, "key"], ["idx", "makes"], producer=producer)
    return linked.where((F.col("makes") == 0) & F.col("producer").isNotNull()).select(
        *by,
        "key",
        F.col("producer.idx").alias("from_idx"),
        F.col("producer.step").alias("from_step"),
        F.col("idx").alias("to_idx"),
        F.col("step").alias("to_step"),
    )


def action_profile(steps: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Steps in all, without a condition, and per condition; each counts `weight` times."""
    condition, times = F.col("condition"), F.lit(1) if weight is None else F.col(weight)

    def total(when):
        return F.sum(F.when(when, times).otherwise(0)).cast("long")

    return steps.groupBy(*by).agg(
        F.sum(times).cast("long").alias("steps"),
        total(condition.isNull()).alias("unconditional"),
        *[total(condition == key).alias(f"on_{key}") for key in CONDITION_KEYS],
    )


def duplicate_steps(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Step names used more than once: only the first of them ever runs."""
    return steps.groupBy(*by, "step").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def shared_steps(steps: DataFrame, action_a: str, action_b: str) -> DataFrame:
    """Step names that occur in both actions."""
    both = steps.where(F.col("action").isin(action_a, action_b)).groupBy("step").agg(
        F.count_if(F.col("action") == action_a).alias("a"), F.count_if(F.col("action") == action_b).alias("b")
    )
    return both.where("a > 0 AND b > 0").select("step")
