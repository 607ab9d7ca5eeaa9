"""Reports that are kept and folded forward: signed changes of sums, sketches of distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators.reports import capacity_parts

# Size of a sketch: 2^14 registers of at most a byte. The standard error of a count is below
# 1.04 / sqrt(2^14) = 0.8 %; merged sketches have the same.
SKETCH_BITS = 14


def node_deltas(base: DataFrame, changes: DataFrame, order_cols: Sequence[str], key: str = "id") -> DataFrame:
    """Rows that a batch of changes takes out of `base` (sign -1) and puts into it (sign 1).

    `changes` has the columns of `base`, `order_cols` and `deleted`; of several changes to a key the last counts.
    Deleting what is not there changes nothing. Null keys never match, so such rows are only added. A base in
    buckets by its key (`sources.bucketed`) is not shuffled.
    """
    rest = [c for c in base.columns if c != key]
    last = F.max_by(F.struct("deleted", *rest), F.struct(*order_cols))
    known = changes.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("__row")).select(key, "__row.*")
    nameless = changes.where(F.col(key).isNull()).select(key, "deleted", *rest)
    removed = base.join(known.select(key), key, "left_semi").select(*base.columns, F.lit(-1).alias("sign"))
    added = known.unionByName(nameless).where(~F.coalesce("deleted", F.lit(False)))
    return removed.unionByName(added.select(*base.columns, F.lit(1).alias("sign")))


def fold_capacity(kept: DataFrame, deltas: DataFrame, instances: DataFrame, plans: DataFrame) -> DataFrame:
    """`kept` (as `reports.capacity_parts` makes it) after signed node changes; groups that end without nodes go.

    Costs what the batch has and one row a group, whatever the fleet's size. Instances and plans that nodes refer to
    must not have changed since they were counted; a change of those is a change of the nodes.
    """
    parts = kept.unionByName(capacity_parts(deltas, instances, plans, F.col("sign")))
    return (
        parts.groupBy("cloud", "region", "kind")
        .agg(*[F.sum(c).alias(c) for c in ("nodes", "vcpu", "memory")])
        .where("nodes != 0")
    )


def popularity_sketches(instances: DataFrame, plans: DataFrame, day: str = "created_at") -> DataFrame:
    """Sketches of the instances and projects per day and plan kind, one row each.

    Partial sketches are merged map-side, so a kind that holds most rows is one sketch a task. Nulls
    are not counted. Rows of a day can be added later as a further row with the same day.
    """
    kinds = plans.select(F.col("id").alias("plan_id"), F.col("kind").alias("plan_kind"))
    rows = instances.select("id", "project_id", "plan_id", F.to_date(day).alias("day")).join(kinds, "plan_id")
    return rows.groupBy("day", "plan_kind").agg(
        F.hll_sketch_agg("id", SKETCH_BITS).alias("instances"), F.hll_sketch_agg("project_id", SKETCH_BITS).alias("projects")
    )


def sketched_popularity(sketches: DataFrame, by: Sequence[str] = ("plan_kind",)) -> DataFrame:
    """Estimates of distinct instances and projects per `by`, from sketches of any days."""
    return sketches.groupBy(*by).agg(
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("instances", "projects")]
    )
