"""Steps a user supplies, run over all rows of a table in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One step.

    `do` takes the wanted columns by name and returns the provided ones. `ok` says from
    wanted and provided columns whether the step succeeded. `undo` returns new values of
    provided columns for rows that are rolled back (null where it is not given), and
    `undo_ok` whether that worked.
    """

    name: str
    wants: Sequence[str]
    provides: Sequence[str]
    do: Callable[[Mapping[str, Column]], Mapping[str, Column]]
    ok: Callable[[Mapping[str, Column]], Column] = field(default=lambda cols: F.lit(True))
    undo: Callable[[Mapping[str, Column]], Mapping[str, Column]] | None = None
    undo_ok: Callable[[Mapping[str, Column]], Column] = field(default=lambda cols: F.lit(True))


def validate_steps(columns: Sequence[str], steps: Sequence[Step]) -> None:
    """Reject steps that want what no column and no earlier step gives. Looks at names only."""
    known = set(columns)
    names: set[str] = set()
    for step in steps:
        missing = [name for name in step.wants if name not in known]
        if missing:
            raise ValueError(f"step {step.name!r} wants {', '.join(missing)}, which nothing before it provides")
        taken = [name for name in step.provides if name in columns]
        if taken:
            raise ValueError(f"step {step.name!r} would overwrite {', '.join(taken)}")
        if step.name in names:
            raise ValueError(f"step name {step.name!r} is used twice")
        names.add(step.name)
        known.update(step.provides)


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run `steps` on every row: add what they provide, stop a row at its first failure,
    and take its steps back in reverse order, the failing one first.

    Adds task_state (1 ok, 2 failed), failed_step and undo_stopped_at. Only projections:
    no shuffle and no Python in the data path.
    """
    validate_steps(df.columns, steps)

    def cols(step: Step) -> dict[str, Column]:
        return {name: F.col(name) for name in [*step.wants, *step.provides]}

    out = df.withColumn("failed_at", F.lit(None).cast("int"))
    for number, step in enumerate(steps):
        running = F.col("failed_at").isNull()
        made = step.do({name: F.col(name) for name in step.wants})
        out = out.withColumns({name: F.when(running, made[name]) for name in step.provides})
        failed = running & ~F.coalesce(step.ok(cols(step)), F.lit(False))
        out = out.withColumn("failed_at", F.when(failed, number).otherwise(F.col("failed_at")))

    # A step's undo fails a row at most once; the highest such step stops the walk.
    stops = [
        F.when(
            (F.col("failed_at") >= number) & ~F.coalesce(step.undo_ok(cols(step)), F.lit(False)), number
        ).otherwise(-1)
        for number, step in enumerate(steps)
    ]
    stopped = F.greatest(*stops, F.lit(-1), F.lit(-1))
    out = out.withColumn("stopped_at", F.when(F.col("failed_at").isNotNull(), stopped))
    taken_back = {}
    for number, step in enumerate(steps):
        undone = (F.col("failed_at") >= number) & (F.col("stopped_at") < number)
        values = step.undo(cols(step)) if step.undo else {}
        for name in step.provides:
            taken_back[name] = F.when(undone, values.get(name, F.lit(None))).otherwise(F.col(name))
    out = out.withColumns(taken_back)

    names = F.array(*[F.lit(step.name) for step in steps])
    return out.withColumns(
        {
            "task_state": F.when(F.col("failed_at").isNull(), 1).otherwise(2),
            "failed_step": F.get(names, F.col("failed_at")),
            "undo_stopped_at": F.when(F.col("stopped_at") >= 0, F.get(names, F.col("stopped_at"))),
        }
    ).drop("failed_at", "stopped_at")


def map_batches_step(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A step whose logic cannot be a Column: `fn` gets Arrow batches as pandas frames."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)
