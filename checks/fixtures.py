"""Test inputs derived from the given tables, as FIXTURES.md describes them.

Most derivations are select lists that Spark and DuckDB read alike, so one text serves
both. The few that need engine-specific functions have a text for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators.ordered import running, running_count
from harborline.plans.clouds import CLOUDS


def case(value: str, items) -> str:
    """CASE over 0..n-1; the last item is the default."""
    arms = " ".join(f"WHEN {i} THEN {item}" for i, item in enumerate(items[:-1]))
    return f"(CASE {value} {arms} ELSE {items[-1]} END)"


def quoted(items) -> list[str]:
    return [f"'{item}'" for item in items]


KINDS = ["redis", "keydb", "keydb-pro", "pg", "mysql"]
K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER)"

INSTANCE_KIND = (
    "(CASE o_orderpriority WHEN '1-URGENT' THEN 'redis' WHEN '2-HIGH' THEN 'keydb' "
    "WHEN '3-MEDIUM' THEN 'keydb-pro' WHEN '4-NOT SPECIFIED' THEN 'pg' ELSE 'mysql' END)"
)
NODE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
]
NODE_ID = "(l_orderkey * 100 + node_seq)"

# name -> (source table, {column: expression}, condition). Read by Spark and DuckDB.
SHARED = {
    "projects": ("customer", {
        "project_id": "c_custkey", "segment": "c_mktsegment", "nation": "c_nationkey"}, None),
    "plans": ("part", {
        "id": "p_partkey",
        "kind": case("p_partkey % 5", quoted(KINDS)),
        "name": "p_name",
        "cloud": case("p_partkey % 15", quoted(CLOUDS)),
        "region": "concat('r', p_size % 8)",
        "nodes": "CAST(1 + p_partkey % 2 AS INTEGER)",
        "vcpu": case("p_size % 4", ["1", "2", "4", "8"]),
        "memory": case("p_partkey % 5", [f"CAST({g}000000000 AS BIGINT)" for g in (1, 2, 8, 16, 32)]),
        "rotational": "(p_partkey % 7 = 0)",
        "version": "CAST(10 + p_size % 4 AS VARCHAR(10))",
        "price": "p_retailprice"}, None),
    "instances": ("orders", {
        "id": "o_orderkey",
        "name": "concat('db-', o_orderkey)",
        "project_id": "o_custkey",
        "plan_id": "o_orderkey % 2100",
        "kind": INSTANCE_KIND,
        "state": "(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 5 ELSE 0 END)",
        "license_key": f"(CASE WHEN {INSTANCE_KIND} = 'keydb-pro' AND o_orderkey % 3 <> 0 "
                       "THEN concat('lic-', o_orderkey) END)",
        "eviction_policy": case("o_orderkey % 3", quoted(["noeviction", "allkeys-lru", "volatile-ttl"])),
        "created_at": "o_orderdate"}, None),
    "cas": ("customer", {"project_id": "c_custkey"}, "c_custkey % 3 <> 0"),
    "enc_keys": ("orders", {"instance_id": "o_orderkey"}, "o_orderkey % 4 <> 0"),
    "acc_keys": ("orders", {"instance_id": "o_orderkey"}, "o_orderkey % 5 <> 0"),
    "usage_changes": ("events", {
        "instance_id": "user_id", "plan_id": f"CAST({K} AS BIGINT)", "ts": "ts", "seq": "event_id",
        "project_id": "user_id % 20"}, "event_type IN ('signup', 'purchase')"),
    "backups": ("events", {
        "instance_id": "user_id", "ts": "ts", "seq": "event_id"}, "event_type = 'purchase'"),
    "recoveries": ("events", {
        "instance_id": "user_id", "ts": "ts", "seq": "event_id"}, "event_type = 'error'"),
    "log_segments": ("events", {
        "instance_id": "user_id", "ts": "ts", "seq": "event_id"}, "event_type IN ('click', 'view')"),
    "role_steps": ("events", {
        "node_id": "user_id", "ts": "ts", "seq": "event_id",
        "command": "(CASE event_type WHEN 'signup' THEN 'setupRedis' WHEN 'purchase' THEN 'promotePgToMaster' "
                   "ELSE 'setupRedisAsSlave' END)"}, "event_type IN ('signup', 'purchase', 'view')"),
    "state_changes": ("events", {
        "instance_id": "user_id", "ts": "ts", "seq": "event_id",
        "state": "(CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 5 "
                 "WHEN 'purchase' THEN 4 ELSE 3 END)"}, None),
    "attempts": ("events", {
        "target": "user_id", "ts": "ts", "seq": "event_id", "ok": "(event_type <> 'error')"}, None),
    "late_arrivals": ("events", {
        "source": "user_id", "ts": "ts", "seq": "event_id",
        "arrival": "event_id + (event_id * 7919) % 2000"}, None),
    "tasks": ("events", {
        "id": "event_id",
        "instance_id": "user_id",
        "action": "(CASE event_type WHEN 'signup' THEN 'create-redis-1' WHEN 'click' THEN 'update-redis-1-to-1' "
                  "WHEN 'purchase' THEN 'update-mysql-1-to-1' WHEN 'view' THEN 'poweroff-redis-1' "
                  "ELSE 'resize-redis-1' END)",
        "state": "CAST(event_id % 3 AS INTEGER)",
        "metadata": "concat('{\"instance_id\":', user_id, ',\"node1_id\":', user_id * 100 + 1, "
                    f"CASE WHEN {K} % 2 = 0 THEN concat(',\"plan_id\":', {K}) ELSE '' END, "
                    f"CASE WHEN {K} % 3 = 0 THEN ',\"new_password\":\"pw\"' ELSE '' END, "
                    f"CASE WHEN {K} % 5 = 0 THEN ',\"whitelist\":[]' ELSE '' END, "
                    f"CASE WHEN {K} % 7 = 0 THEN ',\"eviction_policy\":null' ELSE '' END, '}}')",
        "created_at": "ts"}, None),
    "task_stages": ("events", {
        "id": "event_id",
        "data": "concat('{\"create-vm\":{\"done\":true,\"undone\":', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END, "
                "'},\"setup-vm\":{\"done\":', CASE WHEN event_id % 5 <> 0 THEN 'true' ELSE 'false' END, "
                "',\"failed\":', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END, "
                "'}', CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',\"finish\":{\"done\":', "
                "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',\"undone_failed\":', "
                "CASE WHEN event_id % 11 = 0 THEN 'true' ELSE 'false' END, '}') END, '}')"}, None),
    "message_base": ("events", {
        "event_id": "event_id",
        "body": "(CASE WHEN event_id % 97 = 0 THEN '{bad' WHEN event_id % 89 = 0 "
                "THEN concat('{\"id\": ', event_id + 1000000000, '}') ELSE concat('{\"id\": ', event_id, '}') END)",
        "copies": "(CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END)",
        "ts": "ts"}, None),
}

NODE_COLUMNS = {
    "id": NODE_ID,
    "instance_id": "l_orderkey",
    "plan_id": "l_partkey",
    "node_seq": "node_seq",
    "cloud": case("l_suppkey % 17", quoted([*CLOUDS, "unknown", "unknown"])),
    "state": "(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)",
    "role": "(CASE WHEN node_seq = 1 THEN 'master' ELSE 'slave' END)",
    "ip4": f"concat('10.', {NODE_ID} % 251, '.', l_suppkey % 251, '.', l_partkey % 251)",
    "ip6": f"(CASE WHEN l_linenumber % 2 = 0 THEN concat('fd00::', {NODE_ID} % 9999) ELSE '' END)",
    "record_id": f"concat('rec-', {NODE_ID})",
    "server_id": f"CAST({NODE_ID} % 100000 AS INTEGER)",
    "string_id": f"concat('vm-', {NODE_ID})",
    "exporter_password": f"(CASE WHEN {NODE_ID} % 4 = 0 THEN '' ELSE concat('pw-', {NODE_ID} % 1000) END)",
    "healthy": "(l_linestatus = 'O')",
    "supplier_id": "l_suppkey",
    "line_number": "l_linenumber",
    "launched_at": "l_shipdate",
}
TASK_STEPS = {
    "task_id": "l_orderkey",
    "step_idx": "node_seq",
    "step_name": "concat('step-', l_linenumber)",
    "do_ok": "(l_returnflag <> 'R')",
    "undo_ok": "(l_quantity >= 5)",
}


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table, columns, condition = SHARED[name]
    return derive(read(spark, folder, table), name)


def derive(source: DataFrame, name: str) -> DataFrame:
    """The derivation on a source that may be a stream."""
    _, columns, condition = SHARED[name]
    if condition:
        source = source.where(condition)
    return source.selectExpr(*_select(columns))


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem")
    return running(lines, ["l_orderkey"], NODE_ORDER, node_seq=running_count())


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return numbered_lines(spark, folder).selectExpr(*_select(NODE_COLUMNS))


def task_steps(spark: SparkSession, folder: str) -> DataFrame:
    return numbered_lines(spark, folder).selectExpr(*_select(TASK_STEPS))


def messages(base: DataFrame) -> DataFrame:
    """Deliveries from `message_base`: some come twice."""
    return base.withColumn("delivery", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def whitelist_column(shift: int = 0):
    """Addresses of an instance: as many as (id + shift) % 3."""
    return F.expr(
        f"transform(slice(array(1, 2), 1, CAST((id + {shift}) % 3 AS INTEGER)), "
        "p -> concat('192.168.', id % 251, '.', p, '/32'))"
    )


def with_instance_whitelist(instances: DataFrame, shift: int = 0) -> DataFrame:
    return instances.withColumn("whitelist", whitelist_column(shift))


def with_node_whitelist(nodes_: DataFrame) -> DataFrame:
    peer = F.expr("CASE WHEN node_seq = 1 THEN array() ELSE array(concat('10.200.', id % 251, '.1')) END")
    return nodes_.withColumn("whitelist", peer.cast("array<string>"))


def target_nodes(nodes_: DataFrame) -> DataFrame:
    """Targets: healthy nodes, and ids of nodes that no longer exist."""
    live = F.when(F.col("healthy"), F.col("id"))
    stale = F.when(F.col("line_number") == 7, F.col("id") + 90)
    return nodes_.select(F.explode(F.array_compact(F.array(live, stale))).alias("node_id"))


def peer_requests(nodes_: DataFrame) -> DataFrame:
    """A master lets in its replicas in order, and each replica lets in the master."""
    replica, master = F.col("id"), F.col("instance_id") * 100 + 1
    to_master = F.struct(master.alias("destination_id"), (F.col("node_seq") - 1).alias("position"), replica.alias("source_id"))
    to_replica = F.struct(
        replica.alias("destination_id"), F.lit(1).cast("long").alias("position"), master.alias("source_id")
    )
    return nodes_.where("node_seq > 1").select(F.inline(F.array(to_master, to_replica)))


# ---- the same inputs for DuckDB ---------------------------------------------------

def _cte(name: str) -> str:
    table, columns, condition = SHARED[name]
    where = f" WHERE {condition}" if condition else ""
    return f"{name} AS (SELECT {', '.join(_select(columns))} FROM {table}{where})"


NUMBERED = (
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY "
    + ", ".join(NODE_ORDER)
    + ") AS node_seq FROM lineitem)"
)
DUCK = {
    **{name: [_cte(name)] for name in SHARED},
    "nodes": [NUMBERED, f"nodes AS (SELECT {', '.join(_select(NODE_COLUMNS))} FROM numbered)"],
    "task_steps": [NUMBERED, f"task_steps AS (SELECT {', '.join(_select(TASK_STEPS))} FROM numbered)"],
    "messages": [
        _cte("message_base"),
        "messages AS (SELECT event_id, body, ts, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS delivery "
        "FROM message_base)",
    ],
    "whitelists": [
        "whitelists AS (SELECT o_orderkey AS instance_id, CAST(p AS INTEGER) AS pos, "
        "concat('192.168.', o_orderkey % 251, '.', p, '/32') AS cidr "
        "FROM orders, (VALUES (1), (2)) AS v(p) WHERE p <= o_orderkey % 3)"
    ],
    "new_whitelists": [
        "new_whitelists AS (SELECT o_orderkey AS instance_id, CAST(p AS INTEGER) AS pos, "
        "concat('192.168.', o_orderkey % 251, '.', p, '/32') AS cidr "
        "FROM orders, (VALUES (1), (2)) AS v(p) WHERE p <= (o_orderkey + 1) % 3)"
    ],
    "targets": [
        "targets AS (SELECT id AS node_id FROM nodes WHERE healthy "
        "UNION ALL SELECT id + 90 AS node_id FROM nodes WHERE line_number = 7)"
    ],
}


def duck(body: str, *inputs: str) -> str:
    """A query with the named inputs as common table expressions."""
    parts: list[str] = []
    for name in inputs:
        for cte in DUCK[name]:
            if cte not in parts:
                parts.append(cte)
    # A body may go on with expressions of its own: it then begins with a comma.
    return f"WITH {', '.join(parts)} {body}"
