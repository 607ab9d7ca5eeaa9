"""What the edges between steps imply: all that must run before a step, levels, longest chains, cycles.

Edges may come from `workflow.step_edges` or from any table with two columns of nodes and the columns `by`
that group them. Through `workflow.analyse_tasks` this is done once per variant of an action, not once per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.session import cut_lineage


def step_closure(
    edges: DataFrame, by: Sequence[str], source: str = "from_idx", target: str = "to_idx"
) -> DataFrame:
    """Pairs of nodes with a path between them, and the edges on the longest one (`length`).

    Pointer doubling: each round joins paths to paths, so it takes as many rounds as the longest chain has
    binary digits. The result has a row per pair, at most the square of a group's nodes, and no round holds more. A node on a
    cycle reaches itself; lengths of paths that touch a cycle mean nothing. Repeated
    edges count once; edges with a null end are left out. At least one column `by`; it may be null.
    """
    keys = [*by, source, target]
    known = edges.select(*keys).where(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct()
    known = cut_lineage(known.withColumn("length", F.lit(1).cast("long")))
    ends = known.select(*by, F.col(source).alias("__node")).unionAll(known.select(*by, F.col(target)))
    nodes = ends.distinct().groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    reached, state = 1, None
    while reached < nodes:
        # Groups may have null names, so the join must not lose those.
        left = known.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(source), F.col(target).alias("__via"), F.col("length").alias("__l"))
        right = known.select(*by, F.col(source).alias("__from"), F.col(target), "length")
        on = F.col("__via") == F.col("__from")
        for c in by:
            on = on & F.col(f"__{c}").eqNullSafe(F.col(c))
        longer = left.join(right, on).select(*keys, (F.col("__l") + F.col("length")).alias("length"))
        known = cut_lineage(known.unionByName(longer).groupBy(*keys).agg(F.max("length").alias("length")))
        reached *= 2
        now = known.agg(F.count("*"), F.sum("length")).first()
        if now == state:
            break
        state = now
    return known


def step_levels(
    steps: DataFrame, edges: DataFrame, by: Sequence[str], node: str = "idx",
    source: str = "from_idx", target: str = "to_idx",
) -> DataFrame:
    """Each step with the longest chains before and after it, and whether it is on a longest chain of its group.

    Steps of one `level` can run side by side. `cyclic` steps lie on a cycle. What a cycle leads to has no
    level, what leads to a cycle no `after`, and a group with a cycle has no `critical` steps. A step without edges has
    level 0. Repeated steps count once. Edges to nodes that are no steps count, too.
    """
    paths = step_closure(edges, by, source, target)
    loops = paths.where(F.col(source) == F.col(target)).select(*by, F.col(source).alias("__loop"))
    loops = loops.withColumn("__cyclic", F.lit(True))

    def end(column: str, other: str, name: str) -> DataFrame:
        """Longest path to (or from) each node, null where its other end is on a cycle."""
        marked = _join(paths, loops.withColumnRenamed("__loop", other), [*by, other])
        longest = F.when(F.bool_or(F.coalesce("__cyclic", F.lit(False))), None).otherwise(F.max("length"))
        return marked.groupBy(*by, F.col(column).alias(node)).agg(longest.alias(name), F.lit(True).alias(f"__{name}"))

    out = steps.select(*by, node).distinct()
    out = _join(out, end(target, source, "level"), [*by, node])
    out = _join(out, end(source, target, "after"), [*by, node])
    out = _join(out, loops.withColumnRenamed("__loop", node), [*by, node])
    out = out.select(
        *by, node,
        F.when(F.col("__level").isNull(), 0).otherwise(F.col("level")).alias("level"),
        F.when(F.col("__after").isNull(), 0).otherwise(F.col("after")).alias("after"),
        F.coalesce("__cyclic", F.lit(False)).alias("cyclic"),
    )
    depth = out.groupBy(*by).agg(
        F.max("level").alias("__depth"), F.bool_or(F.col("level").isNull() | F.col("after").isNull()).alias("__open")
    )
    critical = ~F.col("__open") & F.coalesce(F.col("level") + F.col("after") == F.col("__depth"), F.lit(False))
    return _join(out, depth, list(by)).select(*by, node, "level", "after", critical.alias("critical"), "cyclic")


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which equal keys meet even when they are null."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(right, on, "left").drop(*[f"__r_{k}" for k in keys])
