"""Firewall rules, peer lists and DNS changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions.rules import AGENT_PORT, SSH_PORT, dns_name, port_of
from harborline.operators.ordered import running, running_count


def peer_allowlist(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Addresses each destination is to let in, one row each: place in its list, source, address.

    `requests` names them: one row (destination_id, position, source_id) per source, as
    a workflow step wants them. So the work is that of the requests, not of all pairs.
    A source that is no node keeps its place, without an address and marked as missing.
    """
    sources = nodes.select(F.col("id").alias("source_id"), "ip4", F.lit(True).alias("__known"))
    placed = running(requests, ["destination_id"], ["position", "source_id"], place=running_count())
    return placed.join(sources, "source_id", "left").select(
        "destination_id", "place", "source_id", "ip4", F.col("__known").isNull().alias("missing")
    )


def dns_cutover(pairs: DataFrame, nodes: DataFrame, domain: str) -> DataFrame:
    """Records that move from an old node to a new one: old name and record, new address.

    `missing` names the node that is not there, `previous` or `next`; the pair then stays without its values.
    """
    old = nodes.select(
        F.col("id").alias("previous_id"), "instance_id", F.col("role").alias("old_role"), F.col("record_id"),
        F.lit(True).alias("__old"),
    )
    new = nodes.select(F.col("id").alias("next_id"), F.col("ip4").alias("content"), F.lit(True).alias("__new"))
    name = dns_name(F.col("old_role"), F.col("instance_id"), domain)
    return (
        pairs.join(old, "previous_id", "left")
        .join(new, "next_id", "left")
        .select(
            "previous_id", "next_id", "instance_id", name.alias("name"), "content", "record_id",
            F.when(F.col("__old").isNull(), "previous").when(F.col("__new").isNull(), "next").alias("missing"),
        )
    )


def firewall_rules(nodes: DataFrame, instances: DataFrame) -> DataFrame:
    """Accept rules per node for tcp and udp, in order.

    SSH and the agent are open. The service port is open to the node's and then the
    instance's whitelist; with an empty instance whitelist it is open to all, whatever
    the node's whitelist says. Rows come from exploding one array per node.
    """
    owners = instances.select(
        F.col("id").alias("instance_id"), port_of(F.col("kind")).alias("service"), F.col("whitelist").alias("allowed")
    )
    anywhere = F.lit(None).cast("string")

    def rule(port, source):
        return F.struct(port.alias("port"), source.alias("source"))

    def open_port(port):
        return F.array(rule(port, anywhere))

    service = F.col("service")
    listed = F.transform(F.concat("whitelist", "allowed"), lambda source: rule(service, source))
    rules = F.concat(
        open_port(F.lit(SSH_PORT)),
        open_port(F.lit(AGENT_PORT)),
        F.when(F.size("allowed") > 0, listed).otherwise(open_port(service)),
    )
    protocols = F.array(F.lit("tcp"), F.lit("udp"))
    return (
        nodes.join(owners, "instance_id")
        .select(F.col("id").alias("node_id"), F.posexplode(rules).alias("rule_no", "rule"))
        .select("node_id", "rule_no", "rule.port", "rule.source", F.explode(protocols).alias("protocol"))
    )


def allowlist_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Addresses added and removed when an instance's whitelist is replaced as a whole."""
    before = old.select(F.col("id").alias("instance_id"), F.col("whitelist").alias("was"))
    after = new.select(F.col("id").alias("instance_id"), F.col("whitelist").alias("now"))
    both = before.join(after, "instance_id", "full_outer")
    none = F.array().cast("array<string>")
    was, now = F.coalesce("was", none), F.coalesce("now", none)

    def marked(addresses, change):
        return F.transform(addresses, lambda a: F.struct(F.lit(change).alias("change"), a.alias("cidr")))

    changes = F.concat(marked(F.array_except(now, was), "added"), marked(F.array_except(was, now), "removed"))
    return both.select("instance_id", F.inline(changes))
