"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.texts import KEY, keyed, word_count
from harborline.session import cut_lineage, is_small

BUCKETS = 4096  # of a source's documents, to find where its extra copies end
TOLERANCE = 1e-12
MAX_STEPS = 100
MOST_BROADCAST = 50_000  # sources


def _fixed(table: DataFrame) -> DataFrame:
    """A table with one row a source, written once; broadcast where its counted rows are few."""
    table = cut_lineage(table)
    return F.broadcast(table) if is_small(table, MOST_BROADCAST) else table


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Target words of each source: (source, place, source_size, target).

    `sizes` has one row a source: source, size. Sources take the weights in turn, by code point,
    null last. They share the sum of all sizes; a target stops at `most` times its source's size
    and the excess is shared again by weight, until none is above. A source of size 0 gets 0.
    The shares are found on sums over all sources, by the usual filling: sources in the order
    of most*size/weight are full up to some place, the rest share what is left by weight.
    """
    # Sources are the groups of the data, so one row each; only sums over them are ordered.
    spread = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    placed = sizes.withColumn("place", F.row_number().over(spread) - 1)
    array = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.select(
        "source", "place", F.col("size").alias("source_size"), array[F.col("place") % len(weights)].alias("weight")
    )
    by_level = Window.orderBy((F.col("source_size") / F.col("weight")), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = placed.select(
        "*",
        F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"),
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
    )
    level = (F.col("total") - F.col("full")) / (F.col("weights") - F.col("gone"))
    cap = most * F.col("source_size")
    is_full = level * F.col("weight") >= cap
    # The first source that is not full sets the level for itself and all after it.
    open_level = F.first(F.when(~is_full, level), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.when(open_level.isNull(), cap).otherwise(F.least(cap, open_level * F.col("weight")))
    return filled.select("source", "place", "source_size", target.cast("double").alias("target"))


def balance(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Dual parameter and rate of each source: (source, lambda, rate, steps).

    Entropy balancing: of all document rates r that meet sum(size * r) = target in each source,
    take those nearest to 1 in relative entropy (weighed by size). They are r = exp(lambda_s), and
    lambda minimises the convex dual  sum_d size * exp(lambda_s) - lambda_s * target_s. Each Newton
    step adds up gradient and curvature over the documents' sizes; the curvature is diagonal, so
    the step is one division a source. Documents enter through their sums by (source, size), so a
    step reads a small table and a hot source is summed before it is shuffled. A source without
    words or target has rate 0.
    """
    state = _fixed(
        targets.where((F.col("source_size") > 0) & (F.col("target") > 0)).select(
            "source", "target", F.lit(0.0).alias("lambda"), F.lit(0).alias("steps"), F.lit(False).alias("done")
        )
    )
    weights = cut_lineage(
        documents.where("size > 0").groupBy("source", "size").agg(F.sum("size").cast("double").alias("base"))
    )
    for _ in range(MAX_STEPS):
        tilted = weights.alias("w").join(state.alias("s"), F.col("w.source").eqNullSafe(F.col("s.source")))
        sums = tilted.groupBy(
            F.col("s.source").alias("source"), "target", F.col("lambda"), "steps"
        ).agg(F.sum(F.col("base") * F.exp("lambda")).alias("curvature"))
        gradient = F.col("curvature") - F.col("target")
        # Newton's step on a convex exponential overshoots only downwards; one unit bounds it.
        step = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), gradient / F.col("curvature")))
        state = _fixed(
            sums.select(
                "source",
                "target",
                (F.col("lambda") - step).alias("lambda"),
                (F.col("steps") + 1).alias("steps"),
                (F.abs(gradient) <= TOLERANCE * F.col("target")).alias("done"),
            )
        )
        if state.where("not done").isEmpty():
            break
    return state.select("source", "lambda", F.exp("lambda").alias("rate"), "steps")


def _sized(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Documents with their size in words and their place in the order of copies."""
    order = F.xxhash64(F.lit("mix"), *KEY)
    rows = keyed(docs, "doc_id", *[c for c in columns if c != "doc_id"])
    return rows.withColumns({"_size": word_count(F.col("text")), "_order": order}).withColumn(
        "_bucket", F.expr(f"shiftrightunsigned(`_order`, 32) % {BUCKETS}")
    )


def mixing_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row a source: plan_source, source_size, target, rate, whole, extra and where the extra copies end.

    Rates are rounded into whole copies: every document of a source gets `whole` = floor(rate); the rest of
    the source's target goes, one more copy each, to documents in the order of a hash of id and
    text, as long as they stay within the target; then to the one further document that fits the
    rest best. To find where they end no source is sorted: sizes are summed by hash bucket first,
    and only the bucket in which the target falls is put in order, 1/`BUCKETS` of its source.
    Rows that are equal in id and text stand or fall together.
    """
    rows = _sized(docs, ("source", "text")).select(
        "source", F.col("_size").alias("size"), F.col("_order").alias("order"), F.col("_bucket").alias("bucket")
    )
    rows = cut_lineage(rows)
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"))
    targets = _fixed(source_targets(by_source, weights, float(most)))
    rates = balance(rows, targets).withColumnRenamed("source", "rate_source")
    plan = targets.join(rates, F.col("source").eqNullSafe(F.col("rate_source")), "left").select(
        F.col("source").alias("plan_source"),
        "source_size",
        "target",
        F.coalesce("rate", F.lit(0.0)).alias("rate"),
        # A rate within rounding of a whole number is that number.
        F.least(F.lit(most), F.floor(F.coalesce("rate", F.lit(0.0)) + 1e-9)).cast("int").alias("whole"),
    )
    plan = plan.withColumn("extra", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = _fixed(plan.withColumn("extra", F.when(F.col("whole") >= most, 0.0).otherwise(F.col("extra"))))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(along))
    edges = sums.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    # The first bucket whose words reach the target; no bucket when nothing extra is wanted.
    edge = edges.where("upto >= extra").groupBy("plan_source").agg(
        F.min(F.struct("bucket", "upto", "words")).alias("edge")
    )
    edge = edge.select(F.col("plan_source").alias("edge_source"), "edge.bucket", "edge.upto", "edge.words")
    plan = _fixed(
        plan.join(
            edge.withColumnsRenamed({"bucket": "edge_bucket", "upto": "edge_upto", "words": "edge_words"}),
            F.col("plan_source").eqNullSafe(F.col("edge_source")),
            "left",
        ).drop("edge_source")
    )
    full = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    units = full.groupBy("plan_source", "bucket", "order", "extra", "edge_bucket", "edge_upto", "edge_words").agg(
        F.sum("size").alias("words")
    )
    along = Window.partitionBy("plan_source").orderBy("order")
    inside = units.where("bucket = edge_bucket").withColumn(
        "reach", F.col("edge_upto") - F.col("edge_words") + F.sum("words").over(along)
    )
    last = inside.where("reach <= extra").groupBy("plan_source").agg(
        F.max(F.struct("order", "reach")).alias("last")
    ).select(F.col("plan_source").alias("last_source"), "last.order", "last.reach")
    plan = plan.join(last, F.col("plan_source").eqNullSafe(F.col("last_source")), "left").drop("last_source")
    plan = _fixed(
        plan.withColumnsRenamed({"order": "last_order", "reach": "last_reach"}).withColumn(
            "gap",
            F.col("extra") - F.coalesce("last_reach", F.col("edge_upto") - F.col("edge_words"), F.lit(0)),
        )
    )
    more = _in_order(F.col("bucket"), F.col("order"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    # What is missing then goes to the one further document whose size is nearest to it.
    spare = joined.where((F.col("gap") > 0) & ~more).groupBy("plan_source", "gap", "order").agg(
        F.sum("size").alias("words")
    )
    spare = spare.where(F.abs(F.col("words") - F.col("gap")) < F.col("gap")).groupBy("plan_source").agg(
        F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), F.col("order").alias("order"))).alias("best")
    )
    spare = spare.select(F.col("plan_source").alias("spare_source"), F.col("best.order").alias("spare_order"))
    plan = _fixed(plan.join(spare, F.col("plan_source").eqNullSafe(F.col("spare_source")), "left").drop("spare_source"))
    return plan


def _in_order(bucket: Column, order: Column) -> Column:
    """Whether a document gets one more copy by its place in the order."""
    return (F.col("extra") > 0) & (
        F.coalesce(bucket < F.col("edge_bucket"), F.lit(True))
        | ((bucket == F.col("edge_bucket")) & F.coalesce(order <= F.col("last_order"), F.lit(False)))
    )


def apply_plan(docs: DataFrame, plan: DataFrame, columns: Sequence[str] = ("doc_id", "source", "text")) -> DataFrame:
    """`columns` of every document, and size, source_size, target, rate, copies, taken by its source's plan."""
    full = _sized(docs, columns).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    spare = F.coalesce(F.col("_order") == F.col("spare_order"), F.lit(False))
    more = _in_order(F.col("_bucket"), F.col("_order")) | spare
    copies = (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")
    return full.select(
        *columns, F.col("_size").alias("size"), "source_size", "target", "rate",
        copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, rate, copies, taken.

    Targets of the sources, entropy-balanced rates, and whole copies: see `source_targets`,
    `balance` and `mixing_plan`. Null text or text without words: size 0, taken 0, whatever its
    copies. A null source is a source of its own, last in order. Null ids are allowed. An empty
    table gives no rows. Extra columns are not looked at. No document is taken more than `most` times.
    """
    return apply_plan(docs, mixing_plan(docs, weights, most)).drop("text")
