"""Connected components of links that do not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.stored import Stored

MAX_ROUNDS = 60


def _lowest(links: DataFrame) -> DataFrame:
    """(node, low): the least node among each node and its neighbours; sums up before the shuffle."""
    return links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("low"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame, stored: Stored) -> DataFrame:
    """(node, root): for every node of `links` (a, b: long) the least node it is connected to.

    Alternates two steps until nothing changes: each node's larger neighbours are tied to the least
    of its neighbours, then its smaller ones. Both are a grouped minimum and a join back, which Spark splits
    where a node has very many neighbours; no node's neighbours are ever gathered. The number of
    rounds is about the logarithm of the longest path.
    """
    links = links.where("a != b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("a"))
    links = stored.keep(links.select("a", F.col("low").alias("b")).distinct())
    before = _state(links)
    for _ in range(MAX_ROUNDS):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lowest(both), F.col("a") == F.col("node")).where("b > a")
        large = stored.keep(large.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        stored.drop(links)
        # Every link now leads from a node to a smaller one.
        small = large.join(_lowest(large), F.col("a") == F.col("node"))
        tied = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(small.select("a", F.col("low").alias("b")))
        links = stored.keep(tied.where("a != b").distinct())
        stored.drop(large)
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
