"""Key lookups in bulk: a task, node or instance with what belongs to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions.rules import host_port, threads, usable_bytes
from harborline.plans.clouds import cloud_registry
from harborline.plans.tuning import COMMON_SETTINGS, DEFAULT_VERSIONS, SIZE_SETTINGS, tuning_table


def lookup_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among `keys`. These are made distinct first, map-side, so that a
    key that is asked for very often does not weigh on the join."""
    return df.join(keys.select(key).distinct(), key, "left_semi").select(*df.columns)


def lookup_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key: a filter that the scan can use."""
    return df.where(F.col(key) == F.lit(value))


def pending_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that are not finished yet."""
    return tasks.where(F.col("state") <= 0)


def instance_with_plan(instances: DataFrame, plans: DataFrame) -> DataFrame:
    """Each instance with the kind of its plan, null when the plan is not there."""
    kinds = plans.select(F.col("id").alias("plan_id"), F.col("kind").alias("plan_kind"))
    return instances.join(kinds, "plan_id", "left").select(*instances.columns, "plan_kind")


def task_context(tasks: DataFrame, instances: DataFrame, plans: DataFrame, nodes: DataFrame) -> DataFrame:
    """Task with its instance, plan and node, and the first link that is missing.

    `tasks` has instance_id and node_id.
    """
    found_instances = instances.select(
        F.col("id").alias("instance_id"), F.col("plan_id"), F.lit(True).alias("__instance")
    )
    found_plans = plans.select(
        F.col("id").alias("plan_id"), F.col("kind").alias("plan_kind"), "version", F.lit(True).alias("__plan")
    )
    found_nodes = nodes.select(F.col("id").alias("node_id"), "cloud", F.lit(True).alias("__node"))
    missing = (
        F.when(F.col("__instance").isNull(), "instance")
        .when(F.col("__plan").isNull(), "plan")
        .when(F.col("__node").isNull(), "node")
    )
    return (
        tasks.join(found_instances, "instance_id", "left")
        .join(found_plans, "plan_id", "left")
        .join(found_nodes, "node_id", "left")
        .select("id", "instance_id", "plan_id", "node_id", "plan_kind", "version", "cloud", missing.alias("missing"))
    )


def issuing_authority(nodes: DataFrame, instances: DataFrame, cas: DataFrame) -> DataFrame:
    """Node with the project whose authority signs its certificate, and if there is one."""
    owners = instances.select(F.col("id").alias("instance_id"), "project_id")
    signing = cas.select("project_id").distinct().withColumn("__ca", F.lit(True))
    return (
        nodes.join(owners, "instance_id")
        .join(signing, "project_id", "left")
        .select(F.col("id").alias("node_id"), "instance_id", "project_id", F.col("__ca").isNotNull().alias("has_ca"))
    )


def credential_coverage(nodes: DataFrame, enc_keys: DataFrame, acc_keys: DataFrame) -> DataFrame:
    """Whether a node's instance has both keys a restore needs, and which lacks first."""
    enc = enc_keys.select("instance_id").distinct().withColumn("__enc", F.lit(True))
    acc = acc_keys.select("instance_id").distinct().withColumn("__acc", F.lit(True))
    status = (
        F.when(F.col("__enc").isNull(), "no_encryption_key")
        .when(F.col("__acc").isNull(), "no_access_key")
        .otherwise("ready")
    )
    return (
        nodes.join(enc, "instance_id", "left")
        .join(acc, "instance_id", "left")
        .select(F.col("id").alias("node_id"), "instance_id", status.alias("status"))
    )


def tuning_lookup(plans: DataFrame, tuning: DataFrame | None = None) -> DataFrame:
    """Settings of a plan's size; without an entry the defaults of its version apply.

    A tuned plan has all its settings, those of its size and those that all sizes share.
    """
    # Seven rows, fixed above: always small enough to broadcast.
    table = F.broadcast(tuning_table(plans.sparkSession)) if tuning is None else tuning
    table = table.withColumn("__tuned", F.lit(True))
    source = (
        F.when(F.col("__tuned"), "tuned")
        .when(F.col("version").isin(*DEFAULT_VERSIONS), "default")
        .otherwise("none")
    )
    common = [F.when(F.col("__tuned"), F.lit(value)).alias(name) for name, value in COMMON_SETTINGS.items()]
    return plans.join(table, ["rotational", "vcpu", "memory"], "left").select(
        "id", "version", "rotational", "vcpu", "memory", source.alias("source"), *SIZE_SETTINGS, *common
    )


def adapter_dispatch(nodes: DataFrame, site_users: dict[str, str]) -> DataFrame:
    """Adapter and SSH login by cloud, flagging nodes that lack one."""
    # Fifteen rows at most: always small enough to broadcast.
    registry = F.broadcast(cloud_registry(nodes.sparkSession, site_users))
    return nodes.join(registry, "cloud", "left").select(
        "id",
        "cloud",
        "adapter",
        "ssh_user",
        F.col("adapter").isNotNull().alias("has_adapter"),
        (F.col("adapter").isNotNull() & F.col("ssh_user").isNull()).alias("is_unreachable"),
    )


def monitoring_targets(nodes: DataFrame, instances: DataFrame) -> DataFrame:
    """Labels and address under which each node is monitored."""
    kinds = instances.select(F.col("id").alias("instance_id"), F.col("kind"))
    return nodes.join(kinds, "instance_id").select(
        F.col("id").alias("node_id"),
        "instance_id",
        "kind",
        F.lit("node").alias("job"),
        F.col("exporter_password").alias("secret"),
        F.lit("https").alias("scheme"),
        host_port(F.col("ip4")).alias("target"),
    )


def monitoring_gaps(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes without a target and targets without a node.

    A union with a grouped flag, not a full outer join: it is combined map-side, so a
    node with very many targets costs nothing extra.
    """
    seen = nodes.select(F.col("id").alias("node_id"), F.lit(1).alias("n"), F.lit(0).alias("t")).unionByName(
        targets.select("node_id", F.lit(0).alias("n"), F.lit(1).alias("t"))
    )
    flags = seen.groupBy("node_id").agg(F.max("n").alias("n"), F.max("t").alias("t"))
    return flags.where("n <> t").select(
        "node_id", F.when(F.col("n") == 1, "no_target").otherwise("no_node").alias("gap")
    )


REDIS_KINDS = ["redis", "keydb", "keydb-pro"]

# Commands that only who knows an instance's secret can call.
GUARDED_COMMANDS = [
    "ACL", "SHUTDOWN", "CONFIG", "SAVE", "BGSAVE", "BGREWRITEAOF", "LATENCY", "CLIENT", "PSYNC", "MONITOR", "SLOWLOG",
    "SLAVEOF", "REPLICAOF",
]


def config_gaps(nodes: DataFrame, instances: DataFrame, plans: DataFrame) -> DataFrame:
    """Nodes that `config_params` has no settings for because a link is missing, and which."""
    owners = instances.select(F.col("id").alias("instance_id"), "plan_id", "kind", F.lit(True).alias("__instance"))
    found = plans.select(F.col("id").alias("plan_id"), F.lit(True).alias("__plan"))
    no_plan = F.col("kind").isin(*REDIS_KINDS) & F.col("__plan").isNull()
    missing = F.when(F.col("__instance").isNull(), "instance").when(no_plan, "plan")
    return (
        nodes.select(F.col("id").alias("node_id"), "instance_id")
        .join(owners, "instance_id", "left")
        .join(found, "plan_id", "left")
        .select("node_id", "instance_id", missing.alias("missing"))
        .where("missing IS NOT NULL")
    )


def config_secrets(nodes: DataFrame, instances: DataFrame, secrets: DataFrame) -> DataFrame:
    """Settings of Redis-family nodes that hold secrets: password, and hidden names of commands.

    `secrets` has (instance_id, password, secret), one row an instance. A replica logs in to
    its master with the same password.
    """
    owners = instances.where(F.col("kind").isin(*REDIS_KINDS)).select(F.col("id").alias("instance_id"))
    password, secret = F.col("password"), F.col("secret")
    pairs = [("requirepass", password), ("masterauth", F.when(F.col("role") == "slave", password))]
    renamed = [F.struct(F.lit("rename-command").alias("name"), F.concat(F.lit(f"{c} "), secret, F.lit(f"-{c}")).alias("value"))
               for c in GUARDED_COMMANDS]
    listed = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs], *renamed)
    return (
        nodes.select(F.col("id").alias("node_id"), "instance_id", "role")
        .join(owners, "instance_id")
        .join(secrets.select("instance_id", "password", "secret"), "instance_id")
        .select("node_id", F.inline(F.filter(listed, lambda p: p["value"].isNotNull())))
    )


def config_params(nodes: DataFrame, instances: DataFrame, plans: DataFrame) -> DataFrame:
    """Generated settings of Redis-family nodes, one row per setting.

    Memory and threads come from the instance's plan. A replica follows the master of
    its instance. Nodes whose instance or plan is missing are in `config_gaps`.
    """
    redis_like = F.col("kind").isin(*REDIS_KINDS)
    owners = instances.where(redis_like).select(
        F.col("id").alias("instance_id"), F.col("plan_id"), "kind", "eviction_policy", "license_key"
    )
    sizes = plans.select(F.col("id").alias("plan_id"), "vcpu", "memory")
    settings = owners.join(sizes, "plan_id").drop("plan_id")
    masters = (
        nodes.where(F.col("role") == "master")
        .groupBy("instance_id")
        .agg(F.min_by("ip4", "id").alias("master_ip"))
    )
    is_pro = F.col("kind") == "keydb-pro"
    thread_name = F.when(F.col("kind") == "redis", "io-threads").otherwise("server-threads")
    pairs = [
        (F.lit("maxmemory"), usable_bytes(F.col("memory")).cast("string")),
        (F.lit("maxmemory-policy"), F.col("eviction_policy")),
        (thread_name, threads(F.col("vcpu")).cast("string")),
        (F.lit("replicaof"), F.when(F.col("role") == "slave", F.concat("master_ip", F.lit(" 6379")))),
        (F.lit("enable-pro"), F.when(is_pro, F.coalesce("license_key", F.lit("")))),
    ]
    listed = F.array(*[F.struct(n.alias("name"), v.alias("value")) for n, v in pairs])
    return (
        nodes.select(F.col("id").alias("node_id"), "instance_id", "role")
        .join(settings, "instance_id")
        .join(masters, "instance_id", "left")
        .select("node_id", F.inline(F.filter(listed, lambda p: p["value"].isNotNull())))
    )
