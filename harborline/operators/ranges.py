"""Whitelists as ranges of addresses: what they cover, and what a new one adds and removes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions.addresses import address_text, before, block_of
from harborline.operators.ordered import hot_cuts, last_where, running, running_max, running_sum


def _covered(rows: DataFrame, by: Sequence[str], cidr: str) -> DataFrame:
    """Disjoint ranges (version, first, end) per key, no two of which touch."""
    # Parsed once a row: a generator is not taken apart into its fields.
    blocks = rows.select(*by, F.inline(F.array_compact(F.array(block_of(F.col(cidr)))))).distinct()
    keys, order = [*by, "version"], ["first", "end"]
    cuts = hot_cuts(blocks, keys, order)
    reached = running(blocks, keys, order, cuts=cuts, reached=running_max(F.col("end"), exclusive=True))
    starts = F.col("reached").isNull() | (F.col("first") > F.col("reached"))
    numbered = running(
        reached.withColumn("starts", starts.cast("int")), keys, order, cuts=cuts, number=running_sum(F.col("starts"))
    )
    return numbered.groupBy(*keys, "number").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("number")


def _texts(ranges: DataFrame, *columns: str) -> DataFrame:
    version = F.col("version")
    return ranges.select(
        *columns, "version", address_text(version, F.col("first")).alias("first_address"),
        address_text(version, before(F.col("end"))).alias("last_address"),
    )


def covering_ranges(rows: DataFrame, by: Sequence[str], cidr: str) -> DataFrame:
    """The fewest ranges that cover each key's addresses and blocks, and no other address.

    Blocks within others and copies fall away, neighbours are joined; IPv4 and IPv6 never are. Each key is swept once
    in order of addresses, in pieces where it is hot. What is no address or block is left out (`invalid_blocks`).
    """
    return _texts(_covered(rows, by, cidr), *by)


def invalid_blocks(rows: DataFrame, by: Sequence[str], cidr: str) -> DataFrame:
    """Entries that are no address and no block, nulls too."""
    return rows.where(block_of(F.col(cidr)).isNull()).select(*by, cidr)


def range_changes(old: DataFrame, new: DataFrame, by: Sequence[str], cidr: str) -> DataFrame:
    """Ranges of addresses that are let in newly (`added`) or no longer (`removed`) when one whitelist replaces another.

    It does not matter how either one is written: a block in place of its halves changes nothing. The borders of
    both are swept in order; between two neighbouring borders an address is in the same ones.
    """

    def borders(rows: DataFrame, was: int, now: int) -> DataFrame:
        covered = _covered(rows, by, cidr)
        sides = F.array(*[
            F.struct(F.col(at).alias("at"), F.lit(sign * was).alias("was"), F.lit(sign * now).alias("now"))
            for at, sign in (("first", 1), ("end", -1))
        ])
        return covered.select(*by, "version", F.inline(sides))

    keys = [*by, "version"]
    points = borders(old, 1, 0).unionByName(borders(new, 0, 1))
    points = points.groupBy(*keys, "at").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    points = points.where("was <> 0 or now <> 0")
    cuts = hot_cuts(points, keys, ["at"])
    swept = running(points, keys, ["at"], cuts=cuts, in_old=running_sum(F.col("was")), in_new=running_sum(F.col("now")))
    swept = running(swept, keys, ["at"], cuts=cuts, backward=True, end=last_where(F.col("at")))
    change = F.when(F.col("in_new") > F.col("in_old"), "added").when(F.col("in_new") < F.col("in_old"), "removed")
    changed = swept.withColumn("change", change).where("change is not null").withColumnRenamed("at", "first")
    return _texts(changed, *by, "change")
