"""Running computations in order within a key, also when one key is huge.

A window with ``partitionBy(key)`` sends all rows of a key to one task. ``running``
does that only when no key is large. When some are, each of their groups is cut into
pieces along its own order, every piece is windowed by itself, and the totals of the
earlier pieces (one small row per piece) are added on. The fact rows are shuffled once
in both cases.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.session import cut_lineage, local_table

# A group is cut only if it has more rows than this; a task sorts as many with ease.
ROWS_PER_PIECE = 2_000_000
# Bound of the pieces that all hot keys together are cut into. The cut points, one per
# piece, are what is broadcast: some megabytes at most.
MAX_PIECES = 32_768
SAMPLES_PER_PIECE = 32
# A key is hot from 2/MAX_PIECES of all rows on, so no more than this many can be.
MAX_HOT_KEYS = MAX_PIECES // 2
# Items of the frequent-items sketch. Its error is below 3.5/(4/3 of them) of the rows, less
# than the share that makes a key hot, so every hot key is found.
SKETCH_ITEMS = 4 * MAX_HOT_KEYS

# Inputs read from no more than this are counted before they are sketched: counting needs no columns.
COUNTED_BYTES = 1 << 30

PIECE = "__piece"
CUTS = "__cuts"
HASH = "__hash"


@dataclass(frozen=True)
class Metric:
    """A value that can be computed per piece and then combined across pieces."""

    over_rows: Callable[[], Column]  # window function within a piece
    total: Callable[[Column, bool], Column]  # over a whole piece, given its order and direction
    over_totals: Callable[[Column], Column]  # combines totals of earlier pieces
    merge: Callable[[Column, Column], Column]  # (earlier pieces, this piece)
    exclusive: bool = False


def running_count(exclusive: bool = False) -> Metric:
    return running_sum(F.lit(1), exclusive)


def running_sum(value: Column, exclusive: bool = False) -> Metric:
    value = value.cast("long")
    zero = F.lit(0).cast("long")
    return Metric(
        over_rows=lambda: F.sum(value),
        total=lambda at, backward: F.sum(value),
        over_totals=F.sum,
        merge=lambda before, here: F.coalesce(before, zero) + F.coalesce(here, zero),
        exclusive=exclusive,
    )


def running_max(value: Column, exclusive: bool = False) -> Metric:
    return Metric(
        over_rows=lambda: F.max(value),
        total=lambda at, backward: F.max(value),
        over_totals=F.max,
        merge=lambda before, here: F.greatest(before, here),
        exclusive=exclusive,
    )


def last_where(value: Column, condition: Column | None = None, exclusive: bool = True) -> Metric:
    """Value of the latest row that meets `condition`, null when there is none.

    `value` must not be null where the condition holds; wrap it in a struct if it can be.
    """
    seen = value if condition is None else F.when(condition, value)
    return Metric(
        over_rows=lambda: F.last(seen, ignorenulls=True),
        total=lambda at, backward: (F.min_by if backward else F.max_by)(seen, F.when(seen.isNotNull(), at)),
        over_totals=lambda c: F.last(c, ignorenulls=True),
        merge=lambda before, here: F.coalesce(here, before),
        exclusive=exclusive,
    )


def _has_few_rows(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows, by an exact count; a large input is not counted.

    The size of what is read only says whether counting is worth a job. No columns are needed, so
    windows and unused sides of the plan fall away, and of plain files only the footers are read.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.length())]
    if sum(int(str(size)) for size in sizes) > COUNTED_BYTES:
        return False
    return df.count() <= rows


def hot_cuts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_piece: int | None = None,
) -> DataFrame | None:
    """Cut points (key hash, array of order values) of the keys with too many rows.

    Returns None when there are none, which a frequent-items sketch tells in one pass
    with no shuffle of the rows, whatever the size of `df`. The cut points only place work;
    they never change a result. There are at most MAX_PIECES of them, and they are checkpointed, so every
    branch of a plan and every retried task sees the same ones.
    """
    if _has_few_rows(df, rows_per_piece or ROWS_PER_PIECE):
        return None  # no key can have more
    hashed = df.select(F.xxhash64(*keys).alias(HASH), F.struct(*order).alias("__at"))
    sketch = f"approx_top_k_accumulate({HASH}, {SKETCH_ITEMS})"
    found = (
        hashed.groupBy((F.spark_partition_id() % 256).alias("__g"))
        .agg(F.count(F.lit(1)).alias("n"), F.expr(sketch).alias("s"))
        # By a constant, so that no rows give no sketch.
        .groupBy(F.lit(0).alias("__all"))
        .agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(s, {SKETCH_ITEMS})").alias("s"))
        .selectExpr("n", f"approx_top_k_estimate(s, {MAX_HOT_KEYS}) AS top")
        .first()
    )
    if found is None:
        return None
    target = max(rows_per_piece or ROWS_PER_PIECE, 2 * found.n // MAX_PIECES)
    hot = {row["item"]: row["count"] for row in found.top if row["count"] > target}
    if not hot:
        return None
    pieces = sum(-(-count // target) for count in hot.values())
    hot_rows = sum(hot.values())
    hashes = local_table(df.sparkSession, [(h,) for h in hot], f"{HASH} long")
    in_hot = hashed.join(F.broadcast(hashes), HASH, "left_semi")
    share = min(1.0, SAMPLES_PER_PIECE * pieces / hot_rows)
    every = max(1, int(target * share))
    # Only the places of the cuts come from a sample, as in a range partitioner.
    sample = in_hot if share >= 1.0 else in_hot.sample(share, seed=7)
    rank = F.row_number().over(Window.partitionBy(HASH).orderBy("__at"))
    cuts = (
        sample.select("*", rank.alias("__rank"))
        .where(F.col("__rank") % every == 0)
        .groupBy(HASH)
        .agg(F.array_sort(F.collect_set("__at")).alias(CUTS))
    )
    return cut_lineage(cuts)


def with_piece(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: DataFrame, hot_only: bool = False
) -> DataFrame:
    """Add the piece number: how many cut points lie at or before the row, -1 if not cut.

    `hot_only` keeps the rows of cut groups alone.
    """
    longest = cuts.agg(F.max(F.size(CUTS)).alias("n")).first().n or 0
    at = F.struct(*order)
    pieced = (
        df.withColumn(HASH, F.xxhash64(*keys))
        .join(F.broadcast(cuts), HASH, "inner" if hot_only else "left")
        .withColumn(PIECE, F.lit(0))
    )
    # Binary search, one projection per halving: compiled code, unlike a lambda.
    for step in [2**i for i in range(longest.bit_length() - 1, -1, -1)]:
        cut = F.get(F.col(CUTS), F.col(PIECE) + (step - 1))
        pieced = pieced.withColumn(PIECE, F.col(PIECE) + F.when(cut <= at, step).otherwise(0))
    if not hot_only:
        pieced = pieced.withColumn(PIECE, F.when(F.col(CUTS).isNull(), -1).otherwise(F.col(PIECE)))
    return pieced.drop(HASH, CUTS)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    backward: bool = False,
    cuts: DataFrame | None | str = "detect",
    rows_per_piece: int | None = None,
    **metrics: Metric,
) -> DataFrame:
    """Add one column per metric, computed along `order` within `keys`.

    `order` must settle the order of rows within a key. `backward` runs from the end.
    Several calls on the same keys and order can share one `hot_cuts` result.
    """
    if isinstance(cuts, str):
        cuts = hot_cuts(df, keys, order, rows_per_piece)
    ordering = [F.desc(c) if backward else F.asc(c) for c in order]

    def frame(window, metric):
        return window.rowsBetween(Window.unboundedPreceding, -1 if metric.exclusive else 0)

    if cuts is None:
        window = Window.partitionBy(*keys).orderBy(*ordering)
        nothing = F.lit(None)
        added = [m.merge(nothing, m.over_rows().over(frame(window, m))).alias(n) for n, m in metrics.items()]
        return df.select("*", *added)

    pieced = with_piece(df, keys, order, cuts)
    window = Window.partitionBy(*keys, PIECE).orderBy(*ordering)
    local = pieced.select(
        "*", *[m.over_rows().over(frame(window, m)).alias(f"__in_{n}") for n, m in metrics.items()]
    )
    totals = (
        with_piece(df, keys, order, cuts, hot_only=True)
        .groupBy(*keys, PIECE)
        .agg(*[m.total(F.struct(*order), backward).alias(f"__all_{n}") for n, m in metrics.items()])
    )
    by_piece = Window.partitionBy(*keys).orderBy(F.desc(PIECE) if backward else F.asc(PIECE))
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        F.col(PIECE).alias("__to"),
        *[m.over_totals(F.col(f"__all_{n}")).over(earlier).alias(f"__pre_{n}") for n, m in metrics.items()],
    )
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys] + [F.col(PIECE) == F.col("__to")]
    joined = local.join(F.broadcast(carried), functools.reduce(operator.and_, same), "left")
    return joined.select(
        *df.columns,
        *[m.merge(F.col(f"__pre_{n}"), F.col(f"__in_{n}")).alias(n) for n, m in metrics.items()],
    )
