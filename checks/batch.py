"""Batch queries: scans, table changes, rules, lookups, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import duck, shared
from checks.registry import query
from harborline.functions import documents, rules
from harborline.operators import changes, lookups, network
from harborline.plans.clouds import CLOUDS, SSH_USERS

from harborline.sources import sinks, tables

DOMAIN = "db.example.net"
SITE_USERS = {"gcp": "operator", "azure": "operator"}
TEST_KEY = "00112233445566778899aabbccddeeff"  # for the round trip below only


def sql_case(column: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {column} {arms} END"


# ---- sources and sinks -------------------------------------------------------------


@query("scan_table", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    return tables.scan_table(spark, d, "part", ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"])


@query(
    "decode_messages",
    duck(
        """SELECT event_id, delivery,
        CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.id') AS BIGINT) END AS id,
        NOT json_valid(body) AS is_malformed FROM messages""",
        "messages",
    ),
)
def _(spark, d):
    msgs = fx.messages(shared(spark, d, "message_base"))
    return tables.decode_messages(msgs).select("event_id", "delivery", "id", "is_malformed")


@query(
    "route_unknown",
    duck(
        """SELECT m.id, m.event_id, m.delivery FROM (SELECT *, CASE WHEN json_valid(body) THEN
        CAST(json_extract(body, '$.id') AS BIGINT) END AS id FROM messages) m
        WHERE m.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = m.id)""",
        "messages",
    ),
)
def _(spark, d):
    msgs = tables.decode_messages(fx.messages(shared(spark, d, "message_base")))
    return tables.route_unknown(msgs, shared(spark, d, "tasks")).select("id", "event_id", "delivery")


def _targets(spark, d):
    return lookups.monitoring_targets(fx.nodes(spark, d), shared(spark, d, "instances"))


@query(
    "discovery_export",
    duck(
        """SELECT concat('{"labels":{"node_id":"', n.id, '","instance_id":"', n.instance_id, '","kind":"', i.kind,
        '","job":"node"', CASE WHEN exporter_password = '' THEN '' ELSE
        concat(',"__param_secret":"', exporter_password, '"') END,
        ',"__scheme__":"https"},"targets":["', ip4, ':6666"]}') AS json
        FROM nodes n JOIN instances i ON i.id = n.instance_id""",
        "nodes", "instances",
    ),
)
def _(spark, d):
    return sinks.discovery_export(_targets(spark, d))


@query(
    "state_notifications",
    duck(
        """SELECT concat('private-instance-', id) AS channel, 'instance:initialized' AS event,
        CASE state WHEN 1 THEN '{"state":"running"}' ELSE '{"state":"disabled"}' END AS payload
        FROM instances WHERE state IN (1, 5)""",
        "instances",
    ),
)
def _(spark, d):
    return sinks.state_notifications(shared(spark, d, "instances"))


# ---- table changes -----------------------------------------------------------------


@query(
    "append_keyed",
    """WITH b AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY
    l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS seq
    FROM lineitem WHERE l_linenumber <= 3),
    n AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY
    l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS rn
    FROM lineitem WHERE l_linenumber > 3),
    h AS (SELECT l_orderkey, max(seq) AS m FROM b GROUP BY l_orderkey)
    SELECT l_orderkey, l_partkey, l_linenumber, seq FROM b UNION ALL
    SELECT n.l_orderkey, l_partkey, l_linenumber, coalesce(m, 0) + rn AS seq FROM n LEFT JOIN h USING (l_orderkey)""",
)
def _(spark, d):
    lines = fx.read(spark, d, "lineitem")
    kept = list(fx.NODE_ORDER) + ["l_orderkey"]
    none = lines.limit(0).select(*kept, F.lit(0).cast("long").alias("seq"))
    first = changes.append_keyed(none, lines.where("l_linenumber <= 3"), ["l_orderkey"], fx.NODE_ORDER, "seq")
    both = changes.append_keyed(first, lines.where("l_linenumber > 3"), ["l_orderkey"], fx.NODE_ORDER, "seq")
    return both.select("l_orderkey", "l_partkey", "l_linenumber", "seq")


@query(
    "update_by_key",
    duck(
        """SELECT id, name, project_id, CASE WHEN state = 5 THEN 2 ELSE state END AS state,
        CASE WHEN state = 5 THEN NULL ELSE license_key END AS license_key FROM instances""",
        "instances",
    ),
)  # every change comes twice, once with a smaller state
def _(spark, d):
    instances = shared(spark, d, "instances").select("id", "name", "project_id", "state", "license_key")
    cleared = F.lit(None).cast("string").alias("license_key")
    new = instances.where("state = 5").select("id", F.lit(2).alias("state"), cleared)
    again = new.withColumn("state", F.lit(1))
    return changes.update_by_key(instances, new.unionByName(again), "id", ["state", "license_key"])


@query(
    "update_by_key_last_change",
    """SELECT o_orderkey AS id, o_custkey AS project_id, coalesce(e.event_type, o_orderstatus) AS state FROM orders
    LEFT JOIN (SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) e
    ON e.user_id = o_orderkey""",
)
def _(spark, d):
    instances = fx.read(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS project_id", "o_orderstatus AS state"
    )
    new = fx.read(spark, d, "events").selectExpr("user_id AS id", "event_type AS state", "ts", "event_id")
    return changes.update_by_key(instances, new, "id", ["state"], ["ts", "event_id"])


@query(
    "delete_by_key",
    duck(
        """SELECT node_id FROM targets t WHERE NOT EXISTS
        (SELECT 1 FROM nodes n WHERE n.id = t.node_id AND n.state = 3)""",
        "nodes", "targets",
    ),
)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    destroyed = nodes.where("state = 3").select(F.col("id").alias("node_id"))
    return changes.delete_by_key(fx.target_nodes(nodes), destroyed, "node_id")


@query(
    "insert_if_absent",
    """SELECT o_orderkey AS instance_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'old' ELSE 'new' END AS key_text
    FROM orders""",
)
def _(spark, d):
    base = shared(spark, d, "enc_keys").withColumn("key_text", F.lit("old"))
    new = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("instance_id"), F.lit("new").alias("key_text"))
    return changes.insert_if_absent(base, new.unionByName(new), "instance_id")


@query(
    "latest_state",
    duck(
        """SELECT instance_id, arg_max(state, (ts, seq)) AS state FROM state_changes GROUP BY instance_id""",
        "state_changes",
    ),
)
def _(spark, d):
    return changes.latest_state(shared(spark, d, "state_changes"), "instance_id", ["ts", "seq"], "state")


@query(
    "orphan_mark",
    duck(
        """SELECT id, instance_id, cloud, CASE WHEN line_number <= 4 THEN 3 ELSE state END AS state FROM nodes
        WHERE line_number > 4 OR (healthy AND id % 3 <> 0)""",
        "nodes",
    ),
)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    # Deletion was tried on the first four lines; it failed where the node is healthy. Every node was
    # tried again, and for some ids it then worked.
    tried = nodes.where("line_number <= 4")
    first = tried.select("id", (~F.col("healthy")).alias("deleted"))
    second = tried.select("id", F.expr("id % 3 = 0").alias("deleted"))
    return changes.orphan_mark(nodes.select("id", "instance_id", "cloud", "state"), second.unionByName(first))


@query(
    "role_history",
    duck(
        """SELECT node_id, arg_max(CASE command WHEN 'setupRedisAsSlave' THEN 'slave' ELSE 'master' END, (ts, seq))
        AS role FROM role_steps GROUP BY node_id""",
        "role_steps",
    ),
)
def _(spark, d):
    return changes.role_history(shared(spark, d, "role_steps"))


# ---- projections, filters, rules ---------------------------------------------------


@query(
    "lookup_keys",
    duck("SELECT id, instance_id, cloud, role FROM nodes WHERE instance_id IN (SELECT user_id FROM events)", "nodes"),
)
def _(spark, d):
    keys = fx.read(spark, d, "events").select(F.col("user_id").alias("instance_id"))
    return lookups.lookup_keys(fx.nodes(spark, d).select("id", "instance_id", "cloud", "role"), keys, "instance_id")


@query("pending_tasks", duck("SELECT id, action, state FROM tasks WHERE state <= 0", "tasks"))
def _(spark, d):
    return lookups.pending_tasks(shared(spark, d, "tasks")).select("id", "action", "state")


@query("null_default", duck("SELECT id, coalesce(license_key, '') AS license_key FROM instances", "instances"))
def _(spark, d):
    return rules.null_default(shared(spark, d, "instances"), "license_key").select("id", "license_key")


@query(
    "decode_state",
    duck(
        """SELECT 'instance' AS entity, id, state, CASE state WHEN 0 THEN 'pending' WHEN 1 THEN 'running'
        ELSE 'disabled' END AS state_label FROM instances
        UNION ALL SELECT 'node', id, state, CASE state WHEN 1 THEN 'created' WHEN 2 THEN 'running' ELSE 'orphan' END
        FROM nodes""",
        "instances", "nodes",
    ),
)
def _(spark, d):
    cols = ["id", "state", "state_label"]
    instances = rules.decode_state(shared(spark, d, "instances"), "instance").select(F.lit("instance").alias("entity"), *cols)
    nodes = rules.decode_state(fx.nodes(spark, d), "node").select(F.lit("node").alias("entity"), *cols)
    return instances.unionByName(nodes)


@query(
    "thread_tier",
    duck("SELECT id, vcpu, CASE vcpu WHEN 8 THEN 6 WHEN 4 THEN 2 ELSE 1 END AS threads FROM plans", "plans"),
)
def _(spark, d):
    return rules.thread_tier(shared(spark, d, "plans")).select("id", "vcpu", "threads")


@query(
    "usable_memory",
    duck(
        """SELECT id, CASE WHEN id % 11 = 0 THEN id ELSE memory END AS memory,
        CASE WHEN id % 11 = 0 THEN CASE WHEN id >= 100000000 THEN id - 100000000 END ELSE memory - 100000000 END
        AS usable_memory FROM plans""",
        "plans",
    ),
)
def _(spark, d):
    # Some plans get a memory below what is reserved, for which there is no value.
    plans = shared(spark, d, "plans").withColumn("memory", F.expr("CASE WHEN id % 11 = 0 THEN id ELSE memory END"))
    return rules.usable_memory(plans).select("id", "memory", "usable_memory")


@query(
    "dns_names",
    duck(
        f"""SELECT id, r.name_role, concat(r.name_role, '-', instance_id, '.{DOMAIN}') AS dns_name FROM nodes,
        (VALUES ('master'), ('primary'), ('slave'), ('replica')) AS r(name_role)""",
        "nodes",
    ),
)
def _(spark, d):
    return rules.dns_names(fx.nodes(spark, d), DOMAIN).select("id", "name_role", "dns_name")


@query(
    "dns_records",
    duck(
        f"""SELECT id AS node_id, 'A' AS type, concat(role, '-', instance_id, '.{DOMAIN}') AS name, ip4 AS content,
        120 AS ttl, 10 AS priority, false AS proxied FROM nodes""",
        "nodes",
    ),
)
def _(spark, d):
    return rules.dns_records(fx.nodes(spark, d), DOMAIN)


@query(
    "resource_names",
    duck(
        """SELECT n.id, n.cloud, CASE WHEN n.cloud IN ('gcp', 'scw') THEN concat('instance-', n.id)
        WHEN n.cloud = 'hetzner' THEN concat('instance-', left(CAST(n.id AS VARCHAR), 8))
        WHEN n.cloud = 'do' THEN CAST(n.id AS VARCHAR)
        WHEN n.cloud IN ('azure', 'upcloud', 'linode', 'vultr') THEN concat('node-', left(CAST(n.id AS VARCHAR), 8))
        WHEN n.cloud IN ('exoscale', 'alibaba') THEN p.kind || '-' || n.id
        WHEN n.cloud = 'ibm' THEN concat(left(CAST(n.instance_id AS VARCHAR), 8), left(CAST(n.id AS VARCHAR), 8))
        END AS vm_name,
        CASE WHEN n.cloud = 'azure' THEN concat('disk-', left(CAST(n.id AS VARCHAR), 8)) END AS disk_name,
        CASE WHEN n.cloud = 'azure' THEN concat('nic-', left(CAST(n.id AS VARCHAR), 8)) END AS nic_name,
        CASE WHEN n.cloud = 'azure' THEN concat('ip-', left(CAST(n.id AS VARCHAR), 8)) END AS ip_name
        FROM nodes n LEFT JOIN plans p ON p.id = n.plan_id""",
        "nodes", "plans",
    ),
)
def _(spark, d):
    return rules.resource_names(fx.nodes(spark, d), shared(spark, d, "plans"))


@query(
    "host_port",
    duck(
        """SELECT id, concat(ip4, ':6666') AS v4, CASE WHEN ip6 = '' THEN ':6666' ELSE concat('[', ip6, ']:6666') END
        AS v6 FROM nodes""",
        "nodes",
    ),
)
def _(spark, d):
    v4, v6 = rules.host_port(F.col("ip4")), rules.host_port(F.col("ip6"))
    return fx.nodes(spark, d).select("id", v4.alias("v4"), v6.alias("v6"))


@query(
    "valid_ips",
    duck(
        """SELECT id, CASE WHEN ip6 <> '' AND id % 50 <> 0 THEN concat(ip4, ',', ip6) ELSE ip4 END AS ips FROM nodes""",
        "nodes",
    ),
)
def _(spark, d):
    broken = F.expr("CASE WHEN id % 50 = 0 THEN concat(ip6, ':::1') ELSE ip6 END")
    nodes = rules.valid_ips(fx.nodes(spark, d).withColumn("ip6", broken))
    return nodes.select("id", F.array_join("ips", ",").alias("ips"))


METADATA_JSON = """concat('{"role":"', role, '","record_id":"', record_id, '","ip4":"', ip4, '"',
    CASE WHEN ip6 = '' THEN '' ELSE concat(',"ip6":"', ip6, '"') END,
    CASE WHEN server_id = 0 THEN '' ELSE concat(',"id":', server_id) END,
    ',"string_id":"', string_id, '","prometheus_exporter_password":"', exporter_password, '"}')"""


@query("encode_metadata", duck(f"SELECT id, {METADATA_JSON} AS metadata FROM nodes", "nodes"))
def _(spark, d):
    return documents.encode_metadata(fx.nodes(spark, d)).select("id", "metadata")


@query(
    "decode_metadata",
    duck("SELECT id, role, record_id, ip4, ip6, server_id, string_id, exporter_password FROM nodes", "nodes"),
)
def _(spark, d):
    encoded = documents.encode_metadata(fx.nodes(spark, d)).select("id", "metadata")
    fields = ["role", "record_id", "ip4", "ip6", "server_id", "string_id", "exporter_password"]
    return documents.decode_metadata(encoded).select("id", *fields)


MACHINE_FIELDS = {k: f"'{v}'" for k, v in documents.MACHINE_TYPE_FIELDS.items()}


@query(
    "plan_details",
    duck(
        f"""SELECT id, cloud, rotational, nodes, vcpu, memory, CASE WHEN {sql_case('cloud', MACHINE_FIELDS)} IS NULL
        THEN NULL WHEN cloud = 'vultr' THEN CAST(id AS VARCHAR) ELSE concat('m-', id) END AS machine_type FROM plans""",
        "plans",
    ),
)
def _(spark, d):
    plans = shared(spark, d, "plans")
    own = F.lit("")
    for cloud, field in documents.MACHINE_TYPE_FIELDS.items():
        value = F.col("id").cast("string") if cloud == "vultr" else F.concat(F.lit('"m-'), F.col("id").cast("string"), F.lit('"'))
        text = F.concat(F.lit(f',"{cloud}":{{"{field}":'), value, F.lit("}"))
        own = F.when(F.col("cloud") == cloud, text).otherwise(own)
    common = F.format_string(
        '{"rotational":%s,"nodes":%d,"vcpu":%d,"memory":%d', F.col("rotational").cast("string"), "nodes", "vcpu", "memory"
    )
    rows = plans.select("id", "cloud", F.concat(common, own, F.lit("}")).alias("details"))
    return documents.plan_details(rows)


@query(
    "metadata_flags",
    duck(
        """SELECT id, json_exists(metadata, '$.new_password') AS has_new_password,
        json_exists(metadata, '$.eviction_policy') AS has_eviction_policy,
        json_exists(metadata, '$.plan_id') AS has_plan_id, json_exists(metadata, '$.whitelist') AS has_whitelist
        FROM tasks""",
        "tasks",
    ),
)
def _(spark, d):
    return documents.metadata_flags(shared(spark, d, "tasks")).select(
        "id", "has_new_password", "has_eviction_policy", "has_plan_id", "has_whitelist"
    )


# Action names as instances of any kind and health would ask for them.
ASKED = """(CASE id % 4 WHEN 0 THEN concat('create-', kind, '-', 1 + id % 2)
    WHEN 1 THEN concat('update-', kind, '-', 1 + id % 3, '-to-', 1 + id % 5)
    WHEN 2 THEN concat('recover-', kind, '-master-false') ELSE concat('recover-', kind, '-master-',
    CASE WHEN id % 8 = 3 THEN 'true' ELSE 'false' END, '-slave-', CASE WHEN id % 16 < 8 THEN 'true' ELSE 'false' END)
    END)"""


@query(
    "parse_action",
    duck(
        f"""SELECT id, {ASKED} AS action, CASE id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'recover' END
        AS verb, kind, CAST(CASE id % 4 WHEN 0 THEN 1 + id % 2 WHEN 1 THEN 1 + id % 3 END AS INTEGER) AS from_nodes,
        CAST(CASE id % 4 WHEN 1 THEN 1 + id % 5 END AS INTEGER) AS to_nodes,
        CASE id % 4 WHEN 2 THEN false WHEN 3 THEN id % 8 = 3 END AS master_ok,
        CASE id % 4 WHEN 3 THEN id % 16 < 8 END AS slave_ok FROM instances""",
        "instances",
    ),
)
def _(spark, d):
    asked = shared(spark, d, "instances").selectExpr("id", f"{ASKED} AS action")
    return documents.parse_action(asked)


@query(
    "render_commands",
    duck(
        """SELECT id, concat(CASE WHEN cloud IN ('gcp', 'azure', 'exoscale') THEN 'sudo ' ELSE '' END,
        'setnode --id ', id, ' --key ', CASE WHEN id % 2 = 0 THEN concat('''it''"''"''s ', id % 7, '''')
        ELSE concat('k=', id % 7) END) AS command FROM nodes""",
        "nodes",
    ),
)
def _(spark, d):
    text = F.expr("CASE WHEN id % 2 = 0 THEN concat(\"it's \", id % 7) ELSE concat('k=', id % 7) END")
    nodes = rules.render_commands(fx.nodes(spark, d), "sudo setnode --id %d --key %s", [F.col("id"), text])
    return nodes.select("id", "command")


@query(
    "backup_schedule",
    """SELECT event_id, concat(minute(ts - INTERVAL 1 MINUTE), ' ', hour(ts - INTERVAL 1 MINUTE), ' * * *') AS cron
    FROM events""",
)
def _(spark, d):
    return rules.backup_schedule(fx.read(spark, d, "events"), "ts").select("event_id", "cron")


@query("secret_columns", duck("SELECT id, string_id AS secret, true AS differs FROM nodes", "nodes"))
def _(spark, d):
    key = F.unhex(F.lit(TEST_KEY))
    stored = fx.nodes(spark, d).select("id", "string_id", rules.encrypt_col(F.col("string_id"), key).alias("stored"))
    return stored.select(
        "id", rules.decrypt_col(F.col("stored"), key).alias("secret"), (F.col("stored") != F.col("string_id")).alias("differs")
    )


@query(
    "service_port",
    duck(
        "SELECT id, kind, CASE kind WHEN 'pg' THEN 5432 WHEN 'mysql' THEN 3306 ELSE 6379 END AS service_port FROM instances",
        "instances",
    ),
)
def _(spark, d):
    return rules.service_port(shared(spark, d, "instances")).select("id", "kind", "service_port")


@query(
    "config_params",
    duck(
        """, j AS (SELECT n.id AS node_id, n.role, i.kind, i.eviction_policy, coalesce(i.license_key, '') AS lic,
        p.vcpu, p.memory, m.ip4 AS master_ip FROM nodes n JOIN instances i ON i.id = n.instance_id
        JOIN plans p ON p.id = i.plan_id JOIN nodes m ON m.instance_id = n.instance_id AND m.role = 'master'
        WHERE i.kind IN ('redis', 'keydb', 'keydb-pro'))
        SELECT node_id, 'maxmemory' AS name, CAST(memory - 100000000 AS VARCHAR) AS value FROM j
        UNION ALL SELECT node_id, 'maxmemory-policy', eviction_policy FROM j
        UNION ALL SELECT node_id, CASE kind WHEN 'redis' THEN 'io-threads' ELSE 'server-threads' END,
        CASE vcpu WHEN 8 THEN '6' WHEN 4 THEN '2' ELSE '1' END FROM j
        UNION ALL SELECT node_id, 'replicaof', concat(master_ip, ' 6379') FROM j WHERE role = 'slave'
        UNION ALL SELECT node_id, 'enable-pro', lic FROM j WHERE kind = 'keydb-pro'""",
        "nodes", "instances", "plans",
    ),
)
def _(spark, d):
    return lookups.config_params(fx.nodes(spark, d), shared(spark, d, "instances"), shared(spark, d, "plans"))


@query(
    "config_gaps",
    duck(
        """SELECT n.id AS node_id, n.instance_id, CASE WHEN i.id IS NULL THEN 'instance' ELSE 'plan' END AS missing
        FROM nodes n LEFT JOIN (SELECT * FROM instances WHERE id % 10 <> 3) i ON i.id = n.instance_id
        LEFT JOIN plans p ON p.id = i.plan_id
        WHERE i.id IS NULL OR (p.id IS NULL AND i.kind IN ('redis', 'keydb', 'keydb-pro'))""",
        "nodes", "instances", "plans",
    ),
)
def _(spark, d):
    some = shared(spark, d, "instances").where("id % 10 <> 3")
    return lookups.config_gaps(fx.nodes(spark, d), some, shared(spark, d, "plans"))


GUARDED_SQL = """('ACL'), ('SHUTDOWN'), ('CONFIG'), ('SAVE'), ('BGSAVE'), ('BGREWRITEAOF'), ('LATENCY'), ('CLIENT'),
    ('PSYNC'), ('MONITOR'), ('SLOWLOG'), ('SLAVEOF'), ('REPLICAOF')"""


@query(
    "config_secrets",
    duck(
        f""", j AS (SELECT n.id AS node_id, n.role, concat('pw-', i.id) AS password, concat('s', i.id) AS secret
        FROM nodes n JOIN instances i ON i.id = n.instance_id WHERE i.kind IN ('redis', 'keydb', 'keydb-pro'))
        SELECT node_id, 'requirepass' AS name, password AS value FROM j
        UNION ALL SELECT node_id, 'masterauth', password FROM j WHERE role = 'slave'
        UNION ALL SELECT node_id, 'rename-command', concat(c, ' ', secret, '-', c) FROM j, (VALUES {GUARDED_SQL}) AS g(c)""",
        "nodes", "instances",
    ),
)
def _(spark, d):
    instances = shared(spark, d, "instances")
    secrets = instances.selectExpr("id AS instance_id", "concat('pw-', id) AS password", "concat('s', id) AS secret")
    return lookups.config_secrets(fx.nodes(spark, d), instances, secrets)


@query(
    "cloud_resource_id",
    duck(
        """SELECT id, cloud, CASE WHEN cloud IN ('hetzner', 'ibm', 'linode') THEN CAST(server_id AS VARCHAR)
        WHEN cloud IN ('scw', 'aws', 'upcloud', 'vultr', 'exoscale', 'azure') THEN string_id
        WHEN cloud = 'alibaba' THEN record_id END AS resource_id, cloud = 'alibaba' AS is_overwritten FROM nodes""",
        "nodes",
    ),
)
def _(spark, d):
    return rules.cloud_resource_id(fx.nodes(spark, d))


# ---- joins -------------------------------------------------------------------------


@query(
    "instance_with_plan",
    duck(
        """SELECT i.id, i.plan_id, i.kind, p.kind AS plan_kind FROM instances i LEFT JOIN plans p ON p.id = i.plan_id""",
        "instances", "plans",
    ),
)
def _(spark, d):
    instances = shared(spark, d, "instances").select("id", "plan_id", "kind")
    return lookups.instance_with_plan(instances, shared(spark, d, "plans"))


SPREAD_TASKS = ["id", "id * 3 % 16000 AS instance_id", "(id * 3 % 16000) * 100 + 1 AS node_id"]


@query(
    "task_context",
    duck(
        f""", t AS (SELECT {', '.join(SPREAD_TASKS)} FROM tasks)
        SELECT t.id, t.instance_id, i.plan_id, t.node_id, p.kind AS plan_kind, p.version, n.cloud,
        CASE WHEN i.id IS NULL THEN 'instance' WHEN p.id IS NULL THEN 'plan' WHEN n.id IS NULL THEN 'node' END
        AS missing FROM t LEFT JOIN instances i ON i.id = t.instance_id LEFT JOIN plans p ON p.id = i.plan_id
        LEFT JOIN nodes n ON n.id = t.node_id""",
        "tasks", "instances", "plans", "nodes",
    ),
)
def _(spark, d):
    tasks = shared(spark, d, "tasks").selectExpr(*SPREAD_TASKS)
    return lookups.task_context(
        tasks, shared(spark, d, "instances"), shared(spark, d, "plans"), fx.nodes(spark, d)
    )


@query(
    "issuing_authority",
    duck(
        """SELECT n.id AS node_id, n.instance_id, i.project_id, c.project_id IS NOT NULL AS has_ca FROM nodes n
        JOIN instances i ON i.id = n.instance_id LEFT JOIN cas c ON c.project_id = i.project_id""",
        "nodes", "instances", "cas",
    ),
)
def _(spark, d):
    cas = shared(spark, d, "cas")
    return lookups.issuing_authority(fx.nodes(spark, d), shared(spark, d, "instances"), cas.unionByName(cas))


@query(
    "credential_coverage",
    duck(
        """SELECT n.id AS node_id, n.instance_id, CASE WHEN e.instance_id IS NULL THEN 'no_encryption_key'
        WHEN a.instance_id IS NULL THEN 'no_access_key' ELSE 'ready' END AS status FROM nodes n
        LEFT JOIN enc_keys e ON e.instance_id = n.instance_id LEFT JOIN acc_keys a ON a.instance_id = n.instance_id""",
        "nodes", "enc_keys", "acc_keys",
    ),
)
def _(spark, d):
    enc, acc = shared(spark, d, "enc_keys"), shared(spark, d, "acc_keys")
    return lookups.credential_coverage(fx.nodes(spark, d), enc.unionByName(enc), acc.unionByName(acc))


# Expected values of this check: settings of tuned plans (none is rotational) by vcpu and memory.
TUNED_SQL = """t(vcpu, memory, shared_buffers, effective_cache_size, maintenance_work_mem, wal_buffers, work_mem,
    max_worker_processes, max_parallel_workers_per_gather, max_parallel_workers) AS (VALUES
    (1, 1000000000, '256MB', '768MB', '64MB', '7864kB', '655kB', CAST(NULL AS INTEGER), NULL, NULL),
    (1, 2000000000, '512MB', '1536MB', '128MB', '16MB', '1310kB', NULL, NULL, NULL),
    (2, 1000000000, '256MB', '768MB', '64MB', '7864kB', '1310kB', 2, 1, 2),
    (2, 2000000000, '512MB', '1536MB', '128MB', '16MB', '2621kB', 2, 1, 2),
    (2, 8000000000, '2GB', '6GB', '512MB', '16MB', '1MB', 2, 1, 2),
    (4, 16000000000, '4GB', '12GB', '1GB', '16MB', '4MB', 4, 2, 4),
    (8, 32000000000, '8GB', '24GB', '2GB', '16MB', '4MB', 8, 4, 8)),
    common(max_connections, checkpoint_completion_target, default_statistics_target, random_page_cost,
    effective_io_concurrency, min_wal_size, max_wal_size) AS (VALUES ('512', '0.9', '100', '1.1', '200', '1GB', '4GB'))"""


@query(
    "tuning_lookup",
    duck(
        f""", {TUNED_SQL}, s AS (SELECT * FROM t, common)
        SELECT p.id, p.version, p.rotational, p.vcpu, p.memory, CASE WHEN s.vcpu IS NOT NULL THEN 'tuned'
        WHEN p.version IN ('10', '11', '12') THEN 'default' ELSE 'none' END AS source, s.* EXCLUDE (vcpu, memory)
        FROM plans p LEFT JOIN s ON NOT p.rotational AND p.vcpu = s.vcpu AND p.memory = s.memory""",
        "plans",
    ),
)
def _(spark, d):
    return lookups.tuning_lookup(shared(spark, d, "plans"))


SSH_SQL = sql_case("cloud", {**{k: f"'{v}'" for k, v in SSH_USERS.items()}, "gcp": "'operator'", "azure": "'operator'"})
CLOUD_SQL = ", ".join(f"'{c}'" for c in CLOUDS)


@query(
    "adapter_dispatch",
    duck(
        f"""SELECT id, cloud, CASE WHEN cloud IN ({CLOUD_SQL}) THEN cloud END AS adapter, {SSH_SQL} AS ssh_user,
        cloud IN ({CLOUD_SQL}) AS has_adapter, cloud IN ('alibaba', 'oracle', 'tencent', 'selectel') AS is_unreachable
        FROM nodes""",
        "nodes",
    ),
)
def _(spark, d):
    return lookups.adapter_dispatch(fx.nodes(spark, d), SITE_USERS)


@query(
    "monitoring_targets",
    duck(
        """SELECT n.id AS node_id, n.instance_id, i.kind, 'node' AS job, exporter_password AS secret,
        'https' AS scheme, concat(ip4, ':6666') AS target FROM nodes n JOIN instances i ON i.id = n.instance_id""",
        "nodes", "instances",
    ),
)
def _(spark, d):
    return _targets(spark, d)


@query(
    "monitoring_gaps",
    duck(
        """SELECT coalesce(n.id, t.node_id) AS node_id, CASE WHEN t.node_id IS NULL THEN 'no_target' ELSE 'no_node' END
        AS gap FROM nodes n FULL OUTER JOIN (SELECT DISTINCT node_id FROM targets) t ON t.node_id = n.id
        WHERE n.id IS NULL OR t.node_id IS NULL""",
        "nodes", "targets",
    ),
)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    return lookups.monitoring_gaps(nodes, fx.target_nodes(nodes))


@query(
    "peer_allowlist",
    duck(
        """, r AS (SELECT m.id AS destination_id, s.node_seq - 1 AS position, s.id AS source_id, s.ip4
        FROM nodes m JOIN nodes s ON s.instance_id = m.instance_id AND m.node_seq = 1 AND s.node_seq > 1
        UNION ALL SELECT s.id, 1, m.id, m.ip4 FROM nodes m JOIN nodes s
        ON s.instance_id = m.instance_id AND m.node_seq = 1 AND s.node_seq > 1)
        SELECT destination_id, position AS place, CASE WHEN source_id % 13 = 0 THEN -source_id ELSE source_id END
        AS source_id, CASE WHEN source_id % 13 <> 0 THEN ip4 END AS ip4, source_id % 13 = 0 AS missing FROM r""",
        "nodes",
    ),
)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    # Some requests name a source that does not exist.
    unknown = F.expr("CASE WHEN source_id % 13 = 0 THEN -source_id ELSE source_id END")
    return network.peer_allowlist(fx.peer_requests(nodes).withColumn("source_id", unknown), nodes)


@query(
    "dns_cutover",
    duck(
        f"""SELECT o.id AS previous_id, n.id AS next_id, o.instance_id,
        concat(o.role, '-', o.instance_id, '.{DOMAIN}') AS name, n.ip4 AS content, o.record_id,
        CAST(NULL AS VARCHAR) AS missing FROM nodes n JOIN nodes o ON o.id = n.id - 1 WHERE n.node_seq > 1
        UNION ALL SELECT -id, id, NULL, NULL, ip4, NULL, 'previous' FROM nodes WHERE node_seq = 1
        UNION ALL SELECT id, -id, instance_id, concat(role, '-', instance_id, '.{DOMAIN}'), NULL, record_id, 'next'
        FROM nodes WHERE node_seq = 1""",
        "nodes",
    ),
)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    pairs = nodes.select(
        F.explode(
            F.expr(
                "CASE WHEN node_seq > 1 THEN array(struct(id - 1 AS a, id AS b)) "
                "ELSE array(struct(-id AS a, id AS b), struct(id AS a, -id AS b)) END"
            )
        ).alias("pair")
    ).select(F.col("pair.a").alias("previous_id"), F.col("pair.b").alias("next_id"))
    return network.dns_cutover(pairs, nodes, DOMAIN)


# ---- set operations ----------------------------------------------------------------


@query(
    "firewall_rules",
    duck(
        """, s AS (SELECT n.id, n.instance_id, n.node_seq, CASE i.kind WHEN 'pg' THEN 5432 WHEN 'mysql' THEN 3306
        ELSE 6379 END AS port FROM nodes n JOIN instances i ON i.id = n.instance_id),
        r AS (SELECT id AS node_id, 22 AS port, NULL AS source, 0 AS rule_no FROM s
        UNION ALL SELECT id, 6666, NULL, 1 FROM s
        UNION ALL SELECT id, port, NULL, 2 FROM s WHERE instance_id % 3 = 0
        UNION ALL SELECT id, port, concat('10.200.', id % 251, '.1'), 2 FROM s WHERE instance_id % 3 <> 0 AND node_seq > 1
        UNION ALL SELECT s.id, port, w.cidr, CASE WHEN node_seq > 1 THEN 2 ELSE 1 END + w.pos FROM s
        JOIN whitelists w ON w.instance_id = s.instance_id)
        SELECT node_id, CAST(rule_no AS INTEGER) AS rule_no, port, source, p.protocol FROM r,
        (VALUES ('tcp'), ('udp')) AS p(protocol)""",
        "nodes", "instances", "whitelists",
    ),
)
def _(spark, d):
    nodes = fx.with_node_whitelist(fx.nodes(spark, d))
    return network.firewall_rules(nodes, fx.with_instance_whitelist(shared(spark, d, "instances")))


@query(
    "allowlist_diff",
    duck(
        """SELECT instance_id, 'added' AS change, cidr FROM (SELECT instance_id, cidr FROM new_whitelists
        EXCEPT SELECT instance_id, cidr FROM whitelists)
        UNION ALL SELECT instance_id, 'removed', cidr FROM (SELECT instance_id, cidr FROM whitelists
        EXCEPT SELECT instance_id, cidr FROM new_whitelists)""",
        "whitelists", "new_whitelists",
    ),
)
def _(spark, d):
    instances = shared(spark, d, "instances").select("id")
    old, new = fx.with_instance_whitelist(instances), fx.with_instance_whitelist(instances, shift=1)
    return network.allowlist_diff(old, new)
