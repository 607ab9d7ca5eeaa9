"""Column rules of plans, instances and nodes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.plans.clouds import SUDO_CLOUDS

# State codes.
STATE_LABELS = {
    "generic": ["pending", "created", "running", "updating", "down", "terminating", "terminated", "failure"],
    "instance": ["pending", "running", "terminated", "unhealthy", "maintenance", "disabled"],
    "task": ["pending", "ok", "failed"],
}
# A node in state 3 is one whose deletion failed.
STATE_LABELS["node"] = [
    "orphan" if code == 3 else label for code, label in enumerate(STATE_LABELS["generic"])
]

# Client ports by kind, the agent port, and memory kept for the system.
SERVICE_PORTS = {"redis": 6379, "keydb": 6379, "keydb-pro": 6379, "pg": 5432, "mysql": 3306}
AGENT_PORT = 6666
SSH_PORT = 22
RESERVED_MEMORY = 100_000_000


def pick(value: Column, choices: dict) -> Column:
    """CASE value WHEN key THEN choice ..., null otherwise."""
    result = None
    for key, choice in choices.items():
        choice = choice if isinstance(choice, Column) else F.lit(choice)
        result = F.when(value == key, choice) if result is None else result.when(value == key, choice)
    return result


def state_label(entity: str, state: Column) -> Column:
    return pick(state, dict(enumerate(STATE_LABELS[entity])))


def decode_state(df: DataFrame, entity: str) -> DataFrame:
    return df.withColumn("state_label", state_label(entity, F.col("state")))


def thread_tier(plans: DataFrame) -> DataFrame:
    """Threads by virtual CPUs: 2 from four, 6 from eight, else 1."""
    return plans.withColumn("threads", threads(F.col("vcpu")))


def threads(vcpu: Column) -> Column:
    return F.when(vcpu >= 8, 6).when(vcpu >= 4, 2).otherwise(1)


def usable_memory(plans: DataFrame) -> DataFrame:
    return plans.withColumn("usable_memory", usable_bytes(F.col("memory")))


def usable_bytes(memory: Column) -> Column:
    return F.when(memory >= RESERVED_MEMORY, memory - F.lit(RESERVED_MEMORY).cast("long"))


def null_default(df: DataFrame, column: str, default: str = "") -> DataFrame:
    return df.withColumn(column, F.coalesce(column, F.lit(default)))


def port_of(kind: Column) -> Column:
    return pick(kind, SERVICE_PORTS)


def service_port(instances: DataFrame) -> DataFrame:
    return instances.withColumn("service_port", port_of(F.col("kind")))


def host_port(ip: Column, port: int = AGENT_PORT) -> Column:
    """Address and port; an IPv6 address goes in brackets."""
    host = F.when(F.instr(ip, ":") > 0, F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip)
    return F.concat(host, F.lit(f":{port}"))


def dns_name(role: Column, instance: Column, domain: str) -> Column:
    return F.concat(role, F.lit("-"), instance.cast("string"), F.lit(f".{domain}"))


def dns_names(nodes: DataFrame, domain: str) -> DataFrame:
    """The four names a node's certificate covers, one row each."""
    roles = F.array(*[F.lit(r) for r in ("master", "primary", "slave", "replica")])
    return nodes.select(
        "id", "instance_id", F.explode(roles).alias("name_role")
    ).withColumn("dns_name", dns_name(F.col("name_role"), F.col("instance_id"), domain))


def dns_records(nodes: DataFrame, domain: str) -> DataFrame:
    return nodes.select(
        F.col("id").alias("node_id"),
        F.lit("A").alias("type"),
        dns_name(F.col("role"), F.col("instance_id"), domain).alias("name"),
        F.col("ip4").alias("content"),
        F.lit(120).alias("ttl"),
        F.lit(10).alias("priority"),
        F.lit(False).alias("proxied"),
    )


def _short(id_: Column) -> Column:
    return F.substring(id_.cast("string"), 1, 8)


def resource_names(nodes: DataFrame, plans: DataFrame) -> DataFrame:
    """What a node's machine is called at its provider; azure also names three parts."""
    kinds = plans.select(F.col("id").alias("plan_id"), F.col("kind").alias("plan_kind"))
    full, short = F.col("id").cast("string"), _short(F.col("id"))
    by_id = F.concat(F.lit("instance-"), full)
    by_short = F.concat(F.lit("node-"), short)
    by_kind = F.concat("plan_kind", F.lit("-"), full)
    name = pick(
        F.col("cloud"),
        {
            "gcp": by_id,
            "scw": by_id,
            "hetzner": F.concat(F.lit("instance-"), short),
            "do": full,
            "azure": by_short,
            "upcloud": by_short,
            "linode": by_short,
            "vultr": by_short,
            "exoscale": by_kind,
            "alibaba": by_kind,
            "ibm": F.concat(_short(F.col("instance_id")), short),
        },
    )
    azure = F.col("cloud") == "azure"
    parts = [F.when(azure, F.concat(F.lit(f"{p}-"), short)).alias(f"{p}_name") for p in ("disk", "nic", "ip")]
    return nodes.join(kinds, "plan_id", "left").select("id", "cloud", name.alias("vm_name"), *parts)


def _ipv6_pattern() -> str:
    """The IPv6 address grammar of RFC 3986, with at most one `::`."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    ipv4 = rf"({octet}\.){{3}}{octet}"
    group = "[0-9A-Fa-f]{1,4}"
    tail = f"({group}:{group}|{ipv4})"
    forms = [f"({group}:){{6}}{tail}"]
    for before in range(0, 8):
        head = "" if before == 0 else f"(({group}:){{0,{before - 1}}}{group})?"
        rest = 5 - before
        if rest >= 0:
            forms.append(f"{head}::({group}:){{{rest}}}{tail}")
        else:
            forms.append(f"{head}::" + (group if rest == -1 else ""))
    return f"^({'|'.join([*forms, ipv4])})$"


IP_PATTERN = _ipv6_pattern()


def valid_ips(nodes: DataFrame) -> DataFrame:
    """Addresses for a certificate: ip4 always, ip6 when it is one."""
    ip6 = F.when(F.col("ip6").rlike(IP_PATTERN), F.col("ip6"))
    return nodes.withColumn("ips", F.concat(F.array("ip4"), F.array_compact(F.array(ip6))))


def shell_quote(text: Column) -> Column:
    """Quote for a POSIX shell, only where a character needs it."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(text == "", "''").when(text.rlike(r"[^\w@%+=:,./-]"), quoted).otherwise(text)


def render_commands(nodes: DataFrame, template: str, args: list[Column], out: str = "command") -> DataFrame:
    """Fill `template` (with %s or %d) for each node. Only string arguments are quoted;
    `sudo ` is dropped from the template where the login is root already."""
    kinds = {f.name: f.dataType.typeName() for f in nodes.select(*[a.alias(f"a{i}") for i, a in enumerate(args)]).schema}
    ready = [shell_quote(a) if kinds[f"a{i}"] == "string" else a for i, a in enumerate(args)]
    kept = F.format_string(template, *ready)
    bare = F.format_string(template.replace("sudo ", ""), *ready)
    return nodes.withColumn(out, F.when(F.col("cloud").isin(*SUDO_CLOUDS), kept).otherwise(bare))


def backup_schedule(df: DataFrame, ts: str) -> DataFrame:
    """Daily cron entry one minute before `ts` (UTC)."""
    at = F.col(ts) - F.expr("INTERVAL 1 MINUTE")
    return df.withColumn("cron", F.format_string("%d %d * * *", F.minute(at), F.hour(at)))


def encrypt_col(text: Column, key: Column) -> Column:
    """AES-GCM with the 12-byte nonce in front, as unpadded base64. The caller keeps the key."""
    return F.rtrim(F.base64(F.aes_encrypt(text, key, F.lit("GCM"))), F.lit("="))


def decrypt_col(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key, F.lit("GCM")).cast("string")


def cloud_resource_id(nodes: DataFrame) -> DataFrame:
    """The provider's id of a node, by cloud. On alibaba it shares a field that the DNS
    step overwrites, which `is_overwritten` flags."""
    number, text = F.col("server_id").cast("string"), F.col("string_id")
    resource = pick(
        F.col("cloud"),
        {
            **{cloud: number for cloud in ("hetzner", "ibm", "linode")},
            **{cloud: text for cloud in ("scw", "aws", "upcloud", "vultr", "exoscale", "azure")},
            "alibaba": F.col("record_id"),
        },
    )
    return nodes.select(
        "id", "cloud", resource.alias("resource_id"), (F.col("cloud") == "alibaba").alias("is_overwritten")
    )
