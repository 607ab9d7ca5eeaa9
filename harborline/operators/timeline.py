"""Rows in time order per entity: backups and replays, state changes, retries, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators.ordered import hot_cuts, last_where, running, running_count, running_max, running_sum
from harborline.operators.usage import microseconds

# Order of rows at one instant: a segment written then belongs to the earlier backup,
# and a backup made then serves a recovery.
_SEGMENT, _BACKUP, _RECOVERY = 0, 1, 2


def _tagged(df: DataFrame, rank: int) -> DataFrame:
    return df.select("instance_id", "ts", "seq", F.lit(rank).alias("rank"))


def latest_backup(recoveries: DataFrame, backups: DataFrame) -> DataFrame:
    """For each recovery the newest backup at or before it, null when there is none.

    One pass over both in time order, not a range join.
    """
    rows = _tagged(backups, _BACKUP).unionByName(_tagged(recoveries, _RECOVERY))
    is_backup = F.col("rank") == _BACKUP
    seen = running(
        rows, ["instance_id"], ["ts", "rank", "seq"], backup_at=last_where(F.col("ts"), is_backup, exclusive=False)
    )
    return seen.where(F.col("rank") == _RECOVERY).select(
        "instance_id", F.col("seq").alias("recovery_seq"), F.col("ts").alias("recovery_at"), "backup_at"
    )


def _replay_timeline(rows: DataFrame) -> DataFrame:
    """Per row: its latest backup and how many segments lie between that and the row."""
    keys, order = ["instance_id"], ["ts", "rank", "seq"]
    cuts = hot_cuts(rows, keys, order)
    is_segment = F.when(F.col("rank") == _SEGMENT, 1).otherwise(0)
    counted = running(rows, keys, order, cuts=cuts, segments=running_sum(is_segment))
    mark = F.struct(F.col("ts").alias("backup_at"), F.col("segments").alias("before"))
    marked = running(
        counted, keys, order, cuts=cuts, mark=last_where(mark, F.col("rank") == _BACKUP, exclusive=False)
    )
    return marked.select(
        "instance_id", "ts", "seq", "rank", "mark.backup_at", (F.col("segments") - F.col("mark.before")).alias("n")
    )


def replay_set(recoveries: DataFrame, backups: DataFrame, segments: DataFrame) -> DataFrame:
    """For each recovery with a backup: the backup, and how many segments to replay.

    They are the first `segments` ones in `replay_order` after that backup. Recoveries
    that share a backup share its segments, so none is listed more than once.
    """
    rows = (
        _tagged(backups, _BACKUP).unionByName(_tagged(recoveries, _RECOVERY)).unionByName(_tagged(segments, _SEGMENT))
    )
    return (
        _replay_timeline(rows)
        .where((F.col("rank") == _RECOVERY) & F.col("backup_at").isNotNull())
        .select(
            "instance_id",
            F.col("seq").alias("recovery_seq"),
            F.col("ts").alias("recovery_at"),
            "backup_at",
            F.col("n").alias("segments"),
        )
    )


def replay_order(backups: DataFrame, segments: DataFrame) -> DataFrame:
    """Each segment with the backup it follows and its place in the replay."""
    rows = _tagged(backups, _BACKUP).unionByName(_tagged(segments, _SEGMENT))
    return (
        _replay_timeline(rows)
        .where((F.col("rank") == _SEGMENT) & F.col("backup_at").isNotNull())
        .select("instance_id", "backup_at", F.col("seq").alias("segment_seq"), F.col("n").alias("position"))
    )


def state_transitions(changes: DataFrame) -> DataFrame:
    """Previous and new state of each change, and how long the previous one lasted."""
    earlier = last_where(F.struct(F.col("state").alias("state"), F.col("ts").alias("ts")))
    rows = running(changes, ["instance_id"], ["ts", "seq"], before=earlier).where(F.col("before").isNotNull())
    return rows.select(
        "instance_id",
        "seq",
        F.col("before.state").alias("from_state"),
        F.col("state").alias("to_state"),
        microseconds(F.col("before.ts"), F.col("ts")).alias("dwell_us"),
    )


def transition_counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("from_state", "to_state").agg(
        F.count(F.lit(1)).alias("transitions"), F.sum("dwell_us").alias("dwell_us")
    )


def retry_bursts(attempts: DataFrame, gap: str, max_attempts: int) -> DataFrame:
    """Attempts on a target that are no further apart than `gap` form a burst.

    Per burst: attempts, the number of the first success, and whether the allowed
    attempts ran out without one. A distance of exactly `gap` still joins two attempts,
    as it does in a session window.
    """
    keys, order = ["target"], ["ts", "seq"]
    cuts = hot_cuts(attempts, keys, order)
    spaced = running(attempts, keys, order, cuts=cuts, previous=last_where(F.col("ts")))
    starts = F.col("previous").isNull() | (F.col("ts") > F.col("previous") + F.expr(f"INTERVAL {gap}"))
    numbered = running(
        spaced.withColumn("starts", F.when(starts, 1).otherwise(0)),
        keys,
        order,
        cuts=cuts,
        burst=running_sum(F.col("starts")),
        attempt=running_count(),
    )
    bursts = numbered.groupBy("target", "burst").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count(F.lit(1)).alias("attempts"),
        (F.min(F.when(F.col("ok"), F.col("attempt"))) - F.min("attempt") + 1).alias("first_success"),
    )
    late_or_none = F.col("first_success").isNull() | (F.col("first_success") > max_attempts)
    return bursts.withColumn("exhausted", late_or_none & (F.col("attempts") >= max_attempts))


def late_rows(df: DataFrame, source: str, ts: str, arrival: list[str], bound: str) -> DataFrame:
    """Rows that arrive more than `bound` behind the newest earlier arrival of their source."""
    newest = running(df, [source], arrival, newest=running_max(F.col(ts), exclusive=True))
    return newest.where(F.col(ts) < F.col("newest") - F.expr(f"INTERVAL {bound}"))
