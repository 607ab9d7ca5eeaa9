"""Workflow definitions as a table: all 60 actions, built from the parts they share.

Names, commands and keys are fixed values; what varies by kind of database is set out in
the tables below, and the parts put them in order. A caller with other workflows reads
them from a table with the same columns (`read_definitions`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.plans.actions import KINDS, REPLICATED_KINDS
from harborline.session import local_table

DEFINITION_SCHEMA = (
    "action string, idx int, step string, command string, "
    "wants array<string>, provides array<string>, condition string"
)

# Set-up commands of the Redis family, for a master and for its replica.
MASTER_SETUP = {"redis": "setupRedis", "keydb": "setupKeyDBNode", "keydb-pro": "setupKeyDBProNode"}
REPLICA_SETUP = {"redis": "setupRedisAsSlave", "keydb": "setupKeyDBSlaveNode"}

# Names of the eviction steps, by kind and by change of plan.
EVICTION_STEPS = {
    ("redis", "1-to-1"): ["update-redis-eviction-policy"],
    ("redis", "1-to-2"): ["update-redis-master-eviction-policy"],
    ("keydb", "1-to-1"): ["update-redis-eviction-policy"],
    ("keydb", "1-to-2"): ["update-redis-1-eviction-policy"],
    ("keydb-pro", "1-to-1"): ["update-redis-1-eviction-policy"],
}
BOTH_EVICTION_STEPS = ["update-redis-1-eviction-policy", "update-redis-2-eviction-policy"]

Step = tuple[str, str, str, str]  # name, command, wants and provides, keys apart by a blank


def _step(name: str, command: str, wants: str, provides: str = "") -> Step:
    return (name, command, wants, provides)


# ---- parts -------------------------------------------------------------------------

FINISH = _step("finish", "finishSetupForInstanceId", "instance_id")
SETUP_PGP = _step("setup-pgp", "setupPgp", "instance_id")
OPEN_WHITELIST = _step("update-whitelist", "updateAccessFromWhitelist", "instance_id")


def _monitor_off(node: str, name: str) -> Step:
    return _step(f"destroy-monitor-{name}", "disableMonitoringByNodeId", node)


def _dns_off(node: str, name: str) -> Step:
    return _step(f"destroy-dns-{name}", "destroyDNSRecordByNodeId", node)


def _node_off(node: str, name: str) -> Step:
    return _step(name, "destroyNodeById", node)


def _teardown(*nodes: str) -> list[Step]:
    """Monitoring, then DNS, then the machine, each for all nodes."""
    numbered = [(node, str(i)) for i, node in enumerate(nodes, start=1)]
    return (
        [_monitor_off(node, i) for node, i in numbered]
        + [_dns_off(node, i) for node, i in numbered]
        + [_node_off(node, f"destroy-node-{i}") for node, i in numbered]
    )


def _one_vm(node: str, name: str = "create-vm", encryption: str = "setup-encryption") -> list[Step]:
    return [
        _step(name, "createNodeByInstanceIdAndPlanId", "instance_id plan_id", node),
        _step("upload-pgp", "uploadPublicPGP", f"instance_id {node}"),
        _step(encryption, "setupEncryption", node),
    ]


def _two_vms(a: str, b: str) -> list[Step]:
    return [
        _step("create-two-vms", "createTwoNodes", "instance_id plan_id", f"{a} {b}"),
        _step("upload-pgp-1", "uploadPublicPGP", f"instance_id {a}"),
        _step("upload-pgp-2", "uploadPublicPGP", f"instance_id {b}"),
        _step("setup-encryption-1", "setupEncryption", a),
        _step("setup-encryption-2", "setupEncryption", b),
    ]


def _allow(name: str, destination: str, *sources: str) -> Step:
    return _step(name, "allowAccessFromMultipleIP", " ".join(["instance_id", destination, *sources]))


def _dns(name: str, node: str) -> Step:
    return _step(name, "createDNSRecord", f"{node} instance_id")


def _dns_pair(a: str, b: str) -> list[Step]:
    return [_dns("create-dns-for-first-vm", a), _dns("create-dns-for-second-vm", b)]


def _dns_move(name: str, old: str, new: str) -> Step:
    return _step(name, "upgradeDNSRecordByNodeIdAndNewNodeId", f"instance_id {old} {new}")


def _monitor(name: str, node: str) -> Step:
    return _step(name, "setupMonitoringByInstanceIdAndNodeId", f"instance_id {node}")


def _monitor_pair(a: str, b: str) -> list[Step]:
    return [_monitor("setup-monitoring-for-1", a), _monitor("setup-monitoring-for-2", b)]


def _setup(name: str, command: str, *nodes: str) -> Step:
    return _step(name, command, " ".join(["instance_id", *nodes]))


def _migrate(old: str, new: str) -> Step:
    return _step("migrate-old-to-new", "migrateOldToNew", f"instance_id {old} {new} password")


def _restore_files(node: str) -> Step:
    return _step("download-backup", "downloadLatestRedisBackup", f"instance_id {node}")


def _pg_prepare(node: str, suffix: str = "") -> list[Step]:
    return [
        _setup(f"update-conf{suffix}", "pgConfig", node),
        _setup(f"prepare-vm{suffix}", "preparePgWalG", node),
    ]


def _pg_replica(master: str, replica: str) -> Step:
    return _setup("setup-vm-2", "setupPgReplicaFromLatestBackup", master, replica)


# ---- one node ----------------------------------------------------------------------


def _configure(kind: str, node: str, from_backup: bool) -> list[Step]:
    if kind == "pg":
        last = (
            _setup("setup-from-latest-backup", "setupPgOnlyPrimaryFromLatestBackup", node)
            if from_backup
            else _setup("setup-vm", "setupPgNode", node)
        )
        return [*_pg_prepare(node), last]
    if kind == "mysql":
        last = (
            _setup("setup-from-latest-backup", "setupMySQLNodeFromBackup", node)
            if from_backup
            else _setup("setup-vm", "setupMySQLNode", node)
        )
        return [_setup("prepare-vm", "prepareMySQLNode", node), last]
    setup = _setup("setup-vm", MASTER_SETUP[kind], node)
    return [_restore_files(node), setup] if from_backup else [setup]


def _one_node(kind: str, node: str, from_backup: bool) -> list[Step]:
    return [
        *_one_vm(node),
        OPEN_WHITELIST,
        *_configure(kind, node, from_backup),
        _dns("create-dns", node),
        _monitor("setup-monitoring", node),
        FINISH,
    ]


def _recovered_node(kind: str) -> list[Step]:
    steps = [*_teardown("node0_id"), *_one_node(kind, "new_node_id", from_backup=True)]
    if kind == "pg":  # here the configuration comes before the whitelist
        conf = next(s for s in steps if s[0] == "update-conf")
        steps.remove(conf)
        steps.insert(steps.index(OPEN_WHITELIST), conf)
    if kind == "mysql":  # here the restore wants a key that the new machine is not stored under
        at = next(i for i, s in enumerate(steps) if s[0] == "setup-from-latest-backup")
        steps[at] = _setup("setup-from-latest-backup", "setupMySQLNodeFromBackup", "node_id")
    return steps


def _replace_one_by_one(kind: str) -> list[Step]:
    """New plan for a single node: Redis kinds migrate, the others start from a clean node."""
    old, new = "node1_id", "new_node_id"
    if kind not in MASTER_SETUP:
        return [*_teardown(old), *_one_node(kind, new, from_backup=kind == "pg")]
    second = [_allow("setup-ufw-for-second-vm", new)] if kind == "redis" else []
    return [
        _monitor_off(old, "1"),
        *_one_vm(new, "create-new-vm"),
        _allow("setup-ufw", old, new),
        *second,
        _setup("setup-new-vm", MASTER_SETUP[kind], new),
        _migrate(old, new),
        _dns_move("update-dns-record", old, new),
        _node_off(old, "destroy-old"),
        _monitor("setup-monitoring-for-1", new),
    ]


# ---- master and replica, Redis kinds -----------------------------------------------


def _redis_pair(kind: str, a: str, b: str, allow: list[Step]) -> list[Step]:
    """A restored master with its replica."""
    return [
        *_two_vms(a, b),
        OPEN_WHITELIST,
        *allow,
        _restore_files(a),
        _setup("setup-first-vm", MASTER_SETUP[kind], a),
        _setup("setup-second-vm", REPLICA_SETUP[kind], b, a),
        *_dns_pair(a, b),
        *_monitor_pair(a, b),
        FINISH,
    ]


def _redis_two_nodes(kind: str) -> dict[str, list[Step]]:
    is_redis = kind == "redis"
    n1, n2 = "node1_id", "node2_id"
    second = [_allow("setup-ufw-for-second-vm", n2)] if is_redis else []
    create = [
        SETUP_PGP,
        *_two_vms(n1, n2),
        _setup("setup-first-vm", MASTER_SETUP[kind], n1),
        _dns("create-dns-for-first-vm", n1),
        _allow("setup-ufw-for-first-vm", n1, n2),
        *second,
        _setup("setup-second-vm", REPLICA_SETUP[kind], n2, n1),
        _dns("create-dns-for-second-vm", n2),
        *_monitor_pair(n1, n2),
        FINISH,
    ]
    poweron = _redis_pair(kind, n1, n2, [_allow("setup-ufw", n1, n2), *second])
    r1, r2 = "new_node1_id", "new_node2_id"
    both_down = [
        *_teardown("node0_id", n1),
        *_redis_pair(kind, r1, r2, [_allow("setup-ufw", r1 if is_redis else n1, r2)]),
    ]
    finish = [_monitor("setup-monitoring", n2), FINISH] if is_redis else []
    master_down = [
        _monitor_off("node0_id", "for-old-master"),
        _dns_off(n1, "for-old-slave"),
        _step("promote-slave-to-master", "promoteRedisCompatToMaster", n1),
        _dns_move("update-dns-record-from-old-master-to-new", "node0_id", n1),
        *_one_vm(n2, "create-new-vm"),
        _allow("setup-ufw-for-new-master", n1, n2),
        _setup("setup-second-vm", REPLICA_SETUP[kind], n2, "node0_id"),
        _dns("create-slave-dns-for-new-slave", n2),
        _node_off("node0_id", "destroy-old-master"),
        *finish,
    ]
    allow = [_allow("setup-ufw", "node0_id", n2)] if is_redis else []
    replica_down = [
        _monitor_off(n1, "1"),
        *_one_vm(n2, "create-new-vm"),
        *allow,
        _setup("setup-new-vm" if is_redis else "setup-second-vm", REPLICA_SETUP[kind], n2, "node0_id"),
        _dns_move("update-dns-record", n1, n2),
        _node_off(n1, "destroy-node-1"),
    ]
    return {
        "create-{}-2": create,
        "poweron-{}-2": poweron,
        "recover-{}-master-false-slave-true": master_down,
        "recover-{}-master-false-slave-false": both_down,
        "recover-{}-master-true-slave-false": replica_down,
    }


def _redis_replacements(kind: str) -> dict[str, list[Step]]:
    is_redis = kind == "redis"
    n1, n2, new, master, replica = "node1_id", "node2_id", "new_node_id", "new_master_id", "new_slave_id"
    new_master = _setup("setup-new-master", MASTER_SETUP[kind], master)
    new_replica = _setup("setup-second-vm", REPLICA_SETUP[kind], replica, master)
    allow_new = _allow("setup-ufw-for-new-master", master, replica)
    grow_allow = (
        [_allow("setup-ufw-for-new-master", n1, master), allow_new, _allow("setup-ufw-for-new-slave", replica)]
        if is_redis
        else [allow_new]
    )
    grow = [
        _monitor_off(n1, "1"),
        *_two_vms(master, replica),
        *grow_allow,
        new_master,
        _dns_move("upgrade-dns-2", n1, master),
        _migrate(n1, master),
        new_replica,
        _dns("create-dns-for-new-slave", replica),
        _node_off(n1, "destroy-old"),
        *_monitor_pair(master, replica),
    ]
    shrink = [
        _monitor_off(n1, "1"),
        _monitor_off(n2, "2"),
        _dns_off(n2, "2"),
        _node_off(n2, "destroy-node-2"),
        *_one_vm(new, "create-new-vm", "setup-encryption" if is_redis else "setup-encryption-1"),
        _step("setup-ufw", "updateAccessFromWhitelist", "instance_id"),
        _allow("setup-ufw-for-new-master", n1, new),
        _setup("setup-new-master", MASTER_SETUP[kind], new),
        _dns_move("upgrade-dns-2", n1, new),
        _migrate(n1, new),
        _node_off(n1, "destroy-node-1"),
        _monitor("setup-monitoring-for-1", new),
    ]
    swap = [
        _monitor_off(n1, "1"),
        _monitor_off(n2, "2"),
        *_two_vms(master, replica),
        allow_new,
        _allow("setup-ufw-for-old-master", n1, n2, master),
        _step("setup-ufw", "updateAccessFromWhitelist", "instance_id"),
        new_master,
        new_replica,
        _migrate(n1, master),
        _dns_move("upgrade-dns-1", n1, master),
        _dns_move("upgrade-dns-2", n2, replica),
        _node_off(n1, "destroy-node-1"),
        _node_off(n2, "destroy-node-2"),
        *_monitor_pair(master, replica),
    ]
    return {"1-to-2": grow, "2-to-1": shrink, "2-to-2": swap}


# ---- master and replica, PostgreSQL ------------------------------------------------


def _pg_two_nodes() -> dict[str, list[Step]]:
    n1, n2 = "node1_id", "node2_id"
    allow = [_allow("setup-ufw-for-first-vm", n1, n2), _allow("setup-ufw-for-second-vm", n2)]
    outside = [*_dns_pair(n1, n2), *_monitor_pair(n1, n2), FINISH]
    create = [
        SETUP_PGP,
        *_two_vms(n1, n2),
        *allow,
        *_pg_prepare(n1, "-1"),
        _setup("setup-vm-1", "setupPgPrimary", n1),
        *_pg_prepare(n2, "-2"),
        _pg_replica(n1, n2),
        *outside,
    ]
    poweron = [
        *_two_vms(n1, n2),
        *allow,
        *_pg_prepare(n1, "-1"),
        *_pg_prepare(n2, "-2"),
        _setup("setup-vm-1", "setupPgPrimaryFromLatestBackup", n1),
        _pg_replica(n1, n2),
        *outside,
    ]
    master_down = [
        _monitor_off("node0_id", "for-old-master"),
        _dns_off(n1, "for-old-slave"),
        _node_off("node0_id", "destroy-old-master"),
        _step("promote-slave-to-master", "promotePgToMaster", n1),
        _dns_move("update-dns-record-from-old-master-to-new", "node0_id", n1),
        *_one_vm(n2, "create-new-vm"),
        _allow("setup-ufw-for-new-master", n1, n2),
        _allow("setup-ufw-for-new-slave", n2),
        *_pg_prepare(n2, "-2"),
        _pg_replica(n1, n2),
        _dns("create-slave-dns-for-new-slave", n2),
        _monitor("setup-monitoring", n2),
        FINISH,
    ]
    replica_down = [
        _node_off(n1, "destroy-node-1"),
        _monitor_off(n1, "1"),
        *_one_vm(n2, "create-new-vm"),
        _allow("setup-ufw", "node0_id", n2),
        *_pg_prepare(n2, "-2"),
        _pg_replica("node0_id", n2),
        _dns_move("update-dns-record", n1, n2),
    ]
    r1, r2 = "new_node1_id", "new_node2_id"
    both_down = [
        *_teardown("node0_id", n1),
        *_two_vms(r1, r2),
        OPEN_WHITELIST,
        _allow("setup-ufw", r1, r2),
        *_pg_prepare(r1, "-1"),
        _setup("setup-vm-1", "setupPgPrimaryFromLatestBackup", r1),
        *_pg_prepare(r2, "-2"),
        _pg_replica(r1, r2),
        *_dns_pair(r1, r2),
        *_monitor_pair(r1, r2),
        FINISH,
    ]
    return {
        "create-{}-2": create,
        "poweron-{}-2": poweron,
        "recover-{}-master-false-slave-true": master_down,
        "recover-{}-master-false-slave-false": both_down,
        "recover-{}-master-true-slave-false": replica_down,
    }


def _pg_replacements() -> dict[str, list[Step]]:
    n1, n2, master, replica = "node1_id", "node2_id", "new_master_id", "new_slave_id"
    next_primary = "setupPgNextPrimaryFromLatestBackup"
    (conf_1, prepare_1), (conf_2, prepare_2) = _pg_prepare(master, "-1"), _pg_prepare(replica, "-2")
    grow = [
        _monitor_off(n1, "1"),
        *_two_vms(master, replica),
        _allow("setup-ufw-for-old-master", n1, master),
        _allow("setup-ufw-for-new-master", master, replica),
        _allow("setup-ufw-for-new-slave", replica),
        conf_1,
        conf_2,
        prepare_1,
        prepare_2,
        _setup("setup-vm-1", next_primary, n1, master),
        _dns_move("upgrade-dns-1", n1, master),
        _node_off(n1, "destroy-old"),
        _step("promote-vm-1", "promotePgToMaster", master),
        _pg_replica(master, replica),
        _dns("create-dns-for-new-slave", replica),
        *_monitor_pair(master, replica),
    ]
    shrink = [
        _monitor_off(n1, "1"),
        _monitor_off(n2, "2"),
        _dns_off(n2, "2"),
        _node_off(n2, "destroy-node-2"),
        *_one_vm(master, "create-new-vm"),
        _step("setup-ufw", "updateAccessFromWhitelist", "instance_id"),
        _allow("setup-ufw-for-new-master", n1, master),
        *_pg_prepare(master, "-2"),
        _setup("setup-vm-2", next_primary, n1, master),
        _dns_move("upgrade-dns-2", n1, master),
        _node_off(n1, "destroy-node-1"),
        _step("promote-vm-2", "promotePgToSingleMaster", master),
        _monitor("setup-monitoring-for-1", master),
    ]
    swap = [
        _monitor_off(n1, "1"),
        _monitor_off(n2, "2"),
        *_two_vms(master, replica),
        _allow("setup-ufw-for-new-master", master, replica),
        _allow("setup-ufw-for-old-master", n1, n2, master),
        _step("setup-ufw", "updateAccessFromWhitelist", "instance_id"),
        conf_1,
        prepare_1,
        _setup("setup-vm-1", next_primary, n1, master),
        _dns_move("upgrade-dns-1", n1, master),
        _node_off(n1, "destroy-node-1"),
        _step("promote-vm-1", "promotePgToMaster", master),
        conf_2,
        prepare_2,
        _pg_replica(master, replica),
        _dns_move("upgrade-dns-2", n2, replica),
        _node_off(n2, "destroy-node-2"),
        *_monitor_pair(master, replica),
    ]
    return {"1-to-2": grow, "2-to-1": shrink, "2-to-2": swap}


# ---- updates: parts that run only for tasks with a key -----------------------------


def _password(kind: str, change: str) -> list[Step]:
    if kind in ("pg", "mysql"):
        command = "updatePgPassword" if kind == "pg" else "updateMySQLPassword"
        return [_step("update-password", command, "instance_id node1_id")]
    names = {"2-to-1": ["update-password1", "update-password2"], "2-to-2": ["update-password"] * 2}
    return [
        _step(name, "updateRedisPassword", f"instance_id node{i}_id old_password")
        for i, name in enumerate(names.get(change, ["update-password"]), start=1)
    ]


def _eviction(kind: str, change: str) -> list[Step]:
    if kind not in MASTER_SETUP:
        return []
    names = EVICTION_STEPS.get((kind, change), BOTH_EVICTION_STEPS)
    return [
        _step(name, "updateRedisCompatEviction", f"instance_id node{i}_id") for i, name in enumerate(names, start=1)
    ]


def _update(kind: str, change: str, replace: list[Step]) -> list[tuple[str | None, list[Step]]]:
    return [
        ("new_password", _password(kind, change)),
        ("eviction_policy", _eviction(kind, change)),
        ("plan_id", replace),
        ("whitelist", [OPEN_WHITELIST]),
        (None, [FINISH]),
    ]


def workflows() -> dict[str, list[tuple[str | None, list[Step]]]]:
    """Steps per action, in groups that run always (None) or only under a metadata key."""
    flows: dict[str, list[tuple[str | None, list[Step]]]] = {}
    poweroff = _step("finish-poweroff-1", "finishPoweroff", "instance_id")
    for kind in KINDS:
        plain = {
            "create-{}-1": [SETUP_PGP, *_one_node(kind, "node_id", from_backup=False)],
            "poweron-{}-1": _one_node(kind, "node_id", from_backup=True),
            "poweroff-{}-1": [*_teardown("node1_id"), poweroff],
            "destroy-{}-1": _teardown("node1_id"),
            "recover-{}-master-false": _recovered_node(kind),
        }
        changes = {"1-to-1": _replace_one_by_one(kind)}
        if kind in REPLICATED_KINDS:
            plain["poweroff-{}-2"] = [*_teardown("node1_id", "node2_id"), poweroff]
            plain["destroy-{}-2"] = _teardown("node1_id", "node2_id")
            plain |= _pg_two_nodes() if kind == "pg" else _redis_two_nodes(kind)
            changes |= _pg_replacements() if kind == "pg" else _redis_replacements(kind)
        flows |= {name.format(kind): [(None, steps)] for name, steps in plain.items()}
        flows |= {f"update-{kind}-{change}": _update(kind, change, steps) for change, steps in changes.items()}
    return flows


def definition_rows() -> list[tuple]:
    rows = []
    for action, groups in workflows().items():
        numbered = [(condition, step) for condition, steps in groups for step in steps]
        for idx, (condition, (name, command, wants, provides)) in enumerate(numbered, start=1):
            rows.append((action, idx, name, command, wants.split(), provides.split(), condition))
    return rows


def definitions(spark: SparkSession) -> DataFrame:
    return local_table(spark, definition_rows(), DEFINITION_SCHEMA)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """A caller's definition table, JSON lines with the columns above."""
    return spark.read.schema(DEFINITION_SCHEMA).json(path)
