"""The usage ledger of a stream as state per instance, with timers for changes out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

CHANGE = "project_id long, plan_id long, seq long, ts timestamp"
KEYED_LEDGER = (
    "project_id long, instance_id long, plan_id long, seq long, started_at timestamp, finished_at timestamp, late boolean"
)


def _micros(times: pd.Series) -> pd.Series:
    """Times as whole microseconds since the epoch; Spark hands them over in UTC and without a zone."""
    return times.dt.as_unit("us").astype("int64")


class LedgerProcessor(StatefulProcessor):
    """One value state an instance, its open interval; with `wait`, a list of changes that the watermark has not passed."""

    def __init__(self, wait: bool):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "project_id long, plan_id long, seq long, started_at long")
        if self.wait:
            self.waiting = handle.getListState("waiting", "project_id long, plan_id long, seq long, ts long")

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        """(change, end, late) as rows of the ledger."""
        changes = pd.DataFrame([(*c, end, late) for c, end, late in rows], columns=["p", "plan", "seq", "at", "end", "late"])
        return pd.DataFrame(
            {
                "project_id": changes["p"].astype("Int64"),
                "instance_id": pd.Series([key[0]] * len(changes), dtype="Int64"),
                "plan_id": changes["plan"].astype("Int64"),
                "seq": changes["seq"].astype("Int64"),
                "started_at": pd.to_datetime(changes["at"], unit="us"),
                "finished_at": pd.to_datetime(changes["end"].astype("Int64"), unit="us"),
                "late": changes["late"].astype(bool),
            }
        )

    def _apply(self, key: tuple, changes: list[tuple]) -> Iterator[pd.DataFrame]:
        """Changes in order, each of which closes what is open; one that lies before it is late, a copy of it nothing."""
        opened, out = self.open.get() if self.open.exists() else None, []
        before = opened
        for change in sorted(set(changes), key=lambda c: (c[3], c[2])):
            if opened is not None and (change[3], change[2]) < (opened[3], opened[2]):
                out.append((change, None, True))
            elif opened is None or change != tuple(opened):
                if opened is not None:
                    out.append((tuple(opened), change[3], False))
                opened = change
        if opened is not before:
            self.open.update(tuple(opened))
        if out:
            yield self._frame(key, out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for frame in rows:
            numbers = [[None if pd.isna(x) else int(x) for x in frame[c]] for c in ("project_id", "plan_id", "seq")]
            found += zip(*numbers, _micros(frame["ts"]).tolist())
        if not self.wait:
            yield from self._apply(key, found)
            return
        self.waiting.appendList(found)
        # One timer an instance and batch: it goes off once the watermark has passed all of these.
        self.handle.registerTimer(max(c[3] for c in found) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(c) for c in self.waiting.get()]
        ripe = [c for c in waiting if c[3] < passed]
        rest = [c for c in waiting if c[3] >= passed]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield from self._apply(key, ripe)

    def close(self) -> None:
        pass


def keyed_ledger(changes: DataFrame, delay: str | None = None) -> DataFrame:
    """Streaming usage ledger in append mode: an interval is a row once its instance's next change closes it.

    State is the open interval of each instance, in the state store; a batch looks up the instances it has
    changes of and no others, so its cost does not grow with what is open. A restart goes on from the
    checkpoint's state, and a batch that is run again gives the same rows: no table is written beside the stream.

    Without `delay` a change counts at once; one older than its instance's open interval comes out with `late` and no end,
    and changes nothing. With it, changes wait until the watermark, `delay` behind the newest, has passed them, and are then
    put in order, so that closed rows do not depend on how the stream was cut or shuffled within `delay`; rows older than the
    watermark are late in the same way if their instance has gone on since. A change that comes twice counts once. Open intervals never expire: an instance may rest for years.

    All changes of an instance in one batch are in memory of one task at once: the reader's bound on a batch is
    the bound of a hot instance's, too; where that is not enough, `live_ledger_writer` cuts it into pieces.
    `changes` has instance_id and the columns of `CHANGE`; others are not looked at. A null instance_id is an instance.
    """
    rows = changes.select("instance_id", "project_id", "plan_id", "seq", "ts")
    if delay is not None:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy("instance_id").transformWithStateInPandas(
        LedgerProcessor(delay is not None), KEYED_LEDGER, "append", "none" if delay is None else "eventTime"
    )
