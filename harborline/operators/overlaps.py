"""Which intervals of a ledger clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordered import running, running_max

OPEN_END = 1 << 62  # microseconds; where an open interval ends


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def interval_clashes(ledger: DataFrame) -> DataFrame:
    """Pairs of an instance's intervals that overlap: the second one starts before the first one's end.

    First and second are by (started_at, seq); open intervals have no end, and of an empty one only its start counts, as in
    `ledger_violations`. One pass along each instance finds the seconds, those that start before an
    earlier end; where nothing clashes that is all. Firsts are put into bins as wide as the next power of two of their length, so
    each is in two at most, and a second looks into the one bin of each width, of at most 62, that holds its start. An
    instance with very many intervals is thus spread over its time. Rows out are the clashing pairs, which
    are as many as there are: an interval that is open by mistake clashes with all later ones.
    Rows without an instance clash with nothing; equal rows are copies and do not clash.
    """
    rows = ledger.select(
        "instance_id", "seq", "started_at", "finished_at", _micros("started_at").alias("low"),
        F.coalesce(_micros("finished_at"), F.lit(OPEN_END)).alias("high"),
    )
    reached = running(rows, ["instance_id"], ["started_at", "seq"], reached=running_max(F.col("high"), exclusive=True))
    seconds = reached.where("reached > low").select(
        "instance_id", F.col("seq").alias("second_seq"), F.col("started_at").alias("second_started_at"),
        F.col("low").alias("at"),
    )
    width = F.length(F.bin(F.col("high") - F.col("low") - 1))
    firsts = rows.where("high > low").withColumn("width", width)
    widths = [r.width for r in firsts.select("width").distinct().collect()]  # at most 62
    bins = F.array_distinct(F.array(F.expr("shiftright(low, width)"), F.expr("shiftright(high - 1, width)")))
    firsts = firsts.select("*", F.explode(bins).alias("bin"))
    looks = seconds.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>")))
    looks = looks.withColumn("bin", F.expr("shiftright(at, width)"))
    met = firsts.join(looks, ["instance_id", "width", "bin"]).where(
        (F.col("high") > F.col("at"))
        & (F.struct("started_at", "seq") < F.struct(F.col("second_started_at"), F.col("second_seq")))
    )
    return met.select(
        "instance_id", F.col("seq").alias("first_seq"), "second_seq", F.col("started_at").alias("first_started_at"),
        F.col("finished_at").alias("first_finished_at"), "second_started_at",
    ).distinct()
