"""Names of the workflow actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.session import local_table

# Database kinds, and those that can have a replica.
KINDS = ["redis", "keydb", "keydb-pro", "pg", "mysql"]
REPLICATED_KINDS = ["redis", "keydb", "pg"]

# The actions of a kind.
ONE_NODE_ACTIONS = [
    "create-{}-1", "poweron-{}-1", "poweroff-{}-1", "destroy-{}-1", "update-{}-1-to-1", "recover-{}-master-false",
]
TWO_NODE_ACTIONS = [
    "create-{}-2", "poweron-{}-2", "poweroff-{}-2", "destroy-{}-2",
    "update-{}-1-to-2", "update-{}-2-to-1", "update-{}-2-to-2",
    "recover-{}-master-false-slave-true", "recover-{}-master-false-slave-false",
    "recover-{}-master-true-slave-false",
]

# The role a node has after a command.
COMMAND_ROLES = {
    "setupRedis": "master",
    "setupKeyDBNode": "master",
    "setupKeyDBProNode": "master",
    "setupMySQLNode": "master",
    "setupMySQLNodeFromBackup": "master",
    "setupPgNode": "master",
    "setupPgPrimary": "master",
    "setupPgPrimaryFromLatestBackup": "master",
    "setupPgOnlyPrimaryFromLatestBackup": "master",
    "promotePgToMaster": "master",
    "promotePgToSingleMaster": "master",
    "promoteRedisCompatToMaster": "master",
    "setupRedisAsSlave": "slave",
    "setupKeyDBSlaveNode": "slave",
    "setupPgReplicaFromLatestBackup": "slave",
    "setupPgNextPrimaryFromLatestBackup": "slave",
}


def action_names() -> list[str]:
    single = [name.format(kind) for kind in KINDS for name in ONE_NODE_ACTIONS]
    double = [name.format(kind) for kind in REPLICATED_KINDS for name in TWO_NODE_ACTIONS]
    return single + double


def action_catalogue(spark: SparkSession) -> DataFrame:
    """The 60 known actions, one row each."""
    return local_table(spark, [(name,) for name in action_names()], "action string")


def command_roles(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(COMMAND_ROLES.items()), "command string, role string")
