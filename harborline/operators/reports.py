"""Counts and summaries over the fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordered import running, running_count
from harborline.plans.actions import action_catalogue


def target_count(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count(F.lit(1)).alias("targets"))


def fleet_capacity(nodes: DataFrame, instances: DataFrame, plans: DataFrame) -> DataFrame:
    """Nodes, CPUs and memory by cloud, region and kind, with subtotals."""
    # Sum once per finest group, so that the subtotals expand few rows and not all.
    return capacity_subtotals(capacity_parts(nodes, instances, plans))


def capacity_parts(nodes: DataFrame, instances: DataFrame, plans: DataFrame, sign: Column | None = None) -> DataFrame:
    """Sums by cloud, region and kind alone; a node counts `sign` times."""
    kinds = instances.select(F.col("id").alias("instance_id"), "kind")
    sizes = plans.select(F.col("id").alias("plan_id"), "vcpu", "memory")
    times = F.lit(1) if sign is None else sign
    rows = nodes.select("instance_id", "plan_id", "cloud", "region", times.cast("long").alias("times"))
    return (
        rows.join(sizes, "plan_id")
        .join(kinds, "instance_id")
        .groupBy("cloud", "region", "kind")
        .agg(
            F.sum("times").alias("nodes"),
            F.sum(F.col("vcpu") * F.col("times")).alias("vcpu"),
            F.sum(F.col("memory") * F.col("times")).alias("memory"),
        )
    )


def capacity_subtotals(parts: DataFrame) -> DataFrame:
    return parts.rollup("cloud", "region", "kind").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("nodes").alias("nodes"),
        F.sum("vcpu").alias("vcpu"),
        F.sum("memory").alias("memory"),
    )


def task_outcomes(tasks: DataFrame) -> DataFrame:
    """Tasks by action and how they ended; the rate is of the finished ones."""
    state = F.col("state")
    counted = tasks.groupBy("action").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(state == 1).alias("succeeded"),
        F.count_if(state == 2).alias("failed"),
        F.count_if(state <= 0).alias("pending"),
    )
    rate = F.try_divide(F.col("succeeded") * F.lit(100.0), F.col("succeeded") + F.col("failed"))
    return counted.withColumn("success_pct", F.round(rate, 2))


def instance_topology(nodes: DataFrame) -> DataFrame:
    """One row an instance: its nodes and replicas, and the master's address. The replicas
    themselves are in `instance_replicas`."""
    return nodes.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("role") == "slave").alias("replicas"),
        F.min(F.when(F.col("role") == "master", F.struct("node_seq", "ip4")))["ip4"].alias("master_ip"),
    )


def instance_replicas(nodes: DataFrame) -> DataFrame:
    """Replicas of each instance in order, one row each."""
    replicas = nodes.where(F.col("role") == "slave").select("instance_id", "node_seq", "ip4")
    placed = running(replicas, ["instance_id"], ["node_seq"], place=running_count())
    return placed.select("instance_id", "place", "ip4")


def first_node(nodes: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """The first node of each instance. A minimum, combined map-side, not a ranking."""
    rest = [c for c in nodes.columns if c != "instance_id"]
    first = F.min_by(F.struct(*rest), F.struct(*order_cols))
    return nodes.groupBy("instance_id").agg(first.alias("__row")).select("instance_id", "__row.*")


def plan_popularity(instances: DataFrame, plans: DataFrame) -> DataFrame:
    """Distinct instances and projects per plan kind."""
    kinds = plans.select(F.col("id").alias("plan_id"), F.col("kind").alias("plan_kind"))
    return (
        instances.select("id", "project_id", "plan_id")
        .join(kinds, "plan_id")
        .groupBy("plan_kind")
        .agg(F.count_distinct("id").alias("instances"), F.count_distinct("project_id").alias("projects"))
    )


def _supported(df: DataFrame, action: str = "action") -> DataFrame:
    # Sixty rows, fixed in the catalogue: always small enough to broadcast.
    known = F.broadcast(action_catalogue(df.sparkSession).select(F.col("action").alias(action), F.lit(True).alias("__known")))
    return df.join(known, action, "left").withColumn("supported", F.col("__known").isNotNull()).drop("__known")


def recovery_action(nodes: DataFrame, instances: DataFrame) -> DataFrame:
    """Recovery an instance needs by the health of its master and replica.

    None when all nodes are healthy; an instance without a master is not, and counts as one
    whose master is down. `supported` tells if its kind has the action.
    """
    is_master = F.col("role") == "master"
    health = nodes.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.coalesce(F.bool_and(F.when(is_master, F.col("healthy"))), F.lit(False)).alias("master_ok"),
        F.bool_and(F.when(~is_master, F.col("healthy"))).alias("slave_ok"),
    )
    kinds = instances.select(F.col("id").alias("instance_id"), "kind")
    prefix = F.concat(F.lit("recover-"), "kind", F.lit("-master-"), F.col("master_ok").cast("string"))
    all_ok = F.col("master_ok") & F.coalesce("slave_ok", F.lit(True))
    action = F.when(~all_ok, F.when(F.col("slave_ok").isNull(), prefix).otherwise(
        F.concat(prefix, F.lit("-slave-"), F.col("slave_ok").cast("string"))
    ))
    needed = health.join(kinds, "instance_id").select("instance_id", "nodes", action.alias("action"))
    return _supported(needed)


def plan_change_action(changes: DataFrame, plans: DataFrame) -> DataFrame:
    """Update action for instances that move to another plan, by the nodes of both plans.

    `changes` has instance id, kind, plan_id and new_plan_id.
    """
    old = plans.select(F.col("id").alias("plan_id"), F.col("nodes").alias("n"))
    new = plans.select(F.col("id").alias("new_plan_id"), F.col("nodes").alias("m"))
    action = F.concat(
        F.lit("update-"), "kind", F.lit("-"), F.col("n").cast("string"), F.lit("-to-"), F.col("m").cast("string")
    )
    joined = changes.join(old, "plan_id").join(new, "new_plan_id")
    return _supported(joined.select("id", "plan_id", "new_plan_id", action.alias("action")))


def unsupported_actions(tasks: DataFrame) -> DataFrame:
    """Requested actions that no workflow knows; such tasks have no steps and end as ok."""
    asked = tasks.groupBy("action").agg(F.count(F.lit(1)).alias("tasks"))
    known = F.broadcast(action_catalogue(tasks.sparkSession))
    return asked.join(known, "action", "left_anti")
