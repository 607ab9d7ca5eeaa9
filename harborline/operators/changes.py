"""Table changes as snapshot + changes -> snapshot. Each keeps the columns of its base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordered import running, running_count
from harborline.plans.actions import command_roles

# A node in this state could not be deleted at its provider.
ORPHAN_STATE = 3


def append_keyed(
    base: DataFrame, new: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str], key: str
) -> DataFrame:
    """Append rows, each with the next number of its entity as its key."""
    numbered = running(new, part_cols, order_cols, __n=running_count())
    highest = base.groupBy(*part_cols).agg(F.max(key).alias("__highest"))
    keyed = (
        numbered.join(highest, list(part_cols), "left")
        .withColumn(key, (F.coalesce("__highest", F.lit(0)) + F.col("__n")).cast("long"))
        .drop("__n", "__highest")
    )
    return base.unionByName(keyed.select(*base.columns))


def update_by_key(
    base: DataFrame, changes: DataFrame, key: str, cols: Sequence[str], order_cols: Sequence[str] = ()
) -> DataFrame:
    """Overwrite `cols` where a change has the same key; a null new value is written too.

    Where a key can change more than once, `order_cols` says which change is the last;
    without them the greatest values win, so that reruns agree.
    """
    values = F.struct(*cols)
    last = F.max_by(values, F.struct(*order_cols)) if order_cols else F.max(values)
    new = changes.groupBy(key).agg(last.alias("__new"))
    joined = base.join(new, key, "left")
    updated = {c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in cols}
    return joined.withColumns(updated).select(*base.columns)


def delete_by_key(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Remove matching rows; a key that is not there changes nothing."""
    return base.join(keys.select(key).distinct(), key, "left_anti").select(*base.columns)


def insert_if_absent(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert rows whose key is not there yet, one per key (the smallest when several come)."""
    rest = [c for c in base.columns if c != key]
    if rest:
        one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row")).select(key, "__row.*")
    else:
        one = new.select(key).distinct()
    return base.unionByName(one.join(base.select(key).distinct(), key, "left_anti"))


def latest_state(changes: DataFrame, key: str, order_cols: Sequence[str], value: str) -> DataFrame:
    """Only the last change of each entity survives."""
    last = F.max_by(F.col(value), F.struct(*order_cols))
    return changes.groupBy(key).agg(last.alias(value))


def orphan_mark(nodes: DataFrame, delete_results: DataFrame) -> DataFrame:
    """Drop nodes that were deleted; keep those whose deletion failed, as orphans.

    `delete_results` has one row (id, deleted) per attempt on a node; one that worked counts.
    """
    results = delete_results.groupBy("id").agg(F.bool_or("deleted").alias("__deleted"))
    return (
        nodes.join(results, "id", "left")
        .where(F.col("__deleted").isNull() | ~F.col("__deleted"))
        .withColumn("state", F.when(F.col("__deleted").isNotNull(), ORPHAN_STATE).otherwise(F.col("state")))
        .select(*nodes.columns)
    )


def role_history(role_steps: DataFrame) -> DataFrame:
    """The role each node ended in: that of its last set-up or promotion."""
    roles = F.broadcast(command_roles(role_steps.sparkSession))
    return (
        role_steps.join(roles, "command")
        .groupBy("node_id")
        .agg(F.max_by("role", F.struct("ts", "seq")).alias("role"))
    )
