"""JSON columns: node metadata, plan details and task metadata; and action names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.rules import pick
from harborline.plans.actions import KINDS

METADATA_SCHEMA = (
    "role string, record_id string, ip4 string, ip6 string, id int, string_id string, "
    "scaleway_snapshots array<string>, prometheus_exporter_password string"
)

# Fields of the plan document, and where each cloud names its machine type.
DETAILS_SCHEMA = (
    "rotational boolean, nodes int, vcpu int, memory long, "
    "aws struct<image:string,instance_type:string,subnet_id:string,zone:string,group_id:string>, "
    "gcp struct<machine_type:string,source_image:string,zone:string,subnet:string>, "
    "do struct<size:string,id:int,fingerprint:string>, "
    "hetzner struct<image:int,server_type:string,ssh_key_id:int>, "
    "scw struct<commercial_type:string,image:string>, "
    "linode struct<type:string,image:string>, "
    "upcloud struct<plan:string,storage:string,size:int>, "
    "azure struct<resource_group:string,vm_size:string,image_id:string,subnet_id:string>, "
    "vultr struct<region_id:int,plan_id:int,os_id:int,snapshot_id:string>, "
    "ibm struct<memory:int,cpus:int,os:string,key_id:int>, "
    "exoscale struct<size:bigint,service_offering_id:string,template_id:string,zone_id:string>, "
    "alibaba struct<image_id:string,instance_type:string,internet_charge_type:string>"
)
MACHINE_TYPE_FIELDS = {
    "aws": "instance_type",
    "gcp": "machine_type",
    "do": "size",
    "hetzner": "server_type",
    "scw": "commercial_type",
    "linode": "type",
    "upcloud": "plan",
    "azure": "vm_size",
    "vultr": "plan_id",
    "exoscale": "service_offering_id",
    "alibaba": "instance_type",
}

CONDITION_KEYS = ["new_password", "eviction_policy", "plan_id", "whitelist"]


def _unless_empty(name: str) -> Column:
    return F.nullif(name, F.lit(""))


def encode_metadata(nodes: DataFrame) -> DataFrame:
    """Node metadata as JSON without its empty fields; the exporter password always stays."""
    if "scaleway_snapshots" in nodes.columns:
        snapshots = F.when(F.size("scaleway_snapshots") > 0, F.col("scaleway_snapshots"))
    else:
        snapshots = F.lit(None).cast("array<string>")
    document = F.struct(
        _unless_empty("role").alias("role"),
        _unless_empty("record_id").alias("record_id"),
        _unless_empty("ip4").alias("ip4"),
        _unless_empty("ip6").alias("ip6"),
        F.nullif("server_id", F.lit(0)).alias("id"),
        _unless_empty("string_id").alias("string_id"),
        snapshots.alias("scaleway_snapshots"),
        F.coalesce("exporter_password", F.lit("")).alias("prometheus_exporter_password"),
    )
    return nodes.withColumn("metadata", F.to_json(document))


def decode_metadata(nodes: DataFrame) -> DataFrame:
    """The fields of `metadata`; a field that was left out becomes its empty value."""
    parsed = nodes.withColumn("__m", F.from_json("metadata", METADATA_SCHEMA))  # once per row
    m = F.col("__m")

    def text(name: str) -> Column:
        return F.coalesce(m[name], F.lit(""))

    return parsed.withColumns(
        {
            "role": text("role"),
            "record_id": text("record_id"),
            "ip4": text("ip4"),
            "ip6": text("ip6"),
            "server_id": F.coalesce(m["id"], F.lit(0)),
            "string_id": text("string_id"),
            "scaleway_snapshots": F.coalesce(m["scaleway_snapshots"], F.array().cast("array<string>")),
            "exporter_password": text("prometheus_exporter_password"),
        }
    ).drop("__m")


def plan_details(plans: DataFrame, column: str = "details") -> DataFrame:
    """Common plan fields and the machine type under the plan's own cloud."""
    parsed = plans.withColumn("__d", F.from_json(column, DETAILS_SCHEMA))
    machine = pick(
        F.col("cloud"),
        {cloud: F.col(f"__d.{cloud}.{field}").cast("string") for cloud, field in MACHINE_TYPE_FIELDS.items()},
    )
    common = [F.col(f"__d.{name}").alias(name) for name in ("rotational", "nodes", "vcpu", "memory")]
    kept = [c for c in plans.columns if c not in {column, "rotational", "nodes", "vcpu", "memory"}]
    return parsed.select(*kept, *common, machine.alias("machine_type"))


def metadata_map(metadata: Column) -> Column:
    return F.from_json(metadata, "map<string,string>")


def metadata_flags(tasks: DataFrame) -> DataFrame:
    """Which conditional keys a task carries. A key with a null value counts as present."""
    keys = metadata_map(F.col("metadata"))
    return tasks.withColumns({f"has_{key}": F.map_contains_key(keys, key) for key in CONDITION_KEYS})


def parse_action(df: DataFrame, column: str = "action") -> DataFrame:
    """Verb, kind, node counts and health flags out of an action name."""
    kinds = "|".join(sorted(KINDS, key=len, reverse=True))
    action = F.col(column)

    def part(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(action, pattern, group), F.lit(""))

    counts = rf"^[a-z]+-(?:{kinds})-([0-9])(?:-to-([0-9]))?$"
    return df.withColumns(
        {
            "verb": part(r"^([a-z]+)-"),
            "kind": part(rf"^[a-z]+-({kinds})-"),
            "from_nodes": part(counts, 1).cast("int"),
            "to_nodes": part(counts, 2).cast("int"),
            "master_ok": part(r"-master-(true|false)").cast("boolean"),
            "slave_ok": part(r"-slave-(true|false)").cast("boolean"),
        }
    )
