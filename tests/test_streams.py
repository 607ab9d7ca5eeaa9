"""Streams over several files: state crosses batches, and results equal the batch jobs'."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from harborline.operators import changes as batch_changes
from harborline.operators import timeline, usage, workflow
from harborline.plans.catalogue import definitions
from harborline.sources import sinks
from harborline.sources.tables import as_event_time, decode_messages, task_stream
from harborline.streaming import streams

BASE = datetime.datetime(2024, 3, 1)


@pytest.fixture()
def feed(spark, tmp_path):
    """Write frames as files that the stream reads one per batch, in this order."""

    def make(*frames):
        folder = tmp_path / "in"
        for i, frame in enumerate(frames):
            part = tmp_path / f"part{i}"
            frame.coalesce(1).write.parquet(str(part))
            folder.mkdir(exist_ok=True)
            file = next(part.glob("*.parquet"))
            (folder / f"{i:03d}.parquet").write_bytes(file.read_bytes())
        return task_stream(spark, str(folder), frames[0].schema, max_files=1)

    return make


def events(spark, n=300, seed=1):
    rng = random.Random(seed)
    at = BASE
    rows = []
    for seq in range(n):
        at += datetime.timedelta(minutes=rng.randrange(1, 90))
        rows.append((1 if seq % 3 == 0 else rng.randrange(2, 9), at, seq, rng.randrange(6), rng.random() < 0.7, seq % 4))
    return spark.createDataFrame(rows, "instance_id long, ts timestamp_ntz, seq long, state int, ok boolean, plan_id long")


def thirds(df):
    return [df.where(f"seq >= {a} AND seq < {a + 100}") for a in (0, 100, 200)]


def text(df):
    return sorted(str(r) for r in df.collect())


def test_live_state_equals_batch(spark, feed, tmp_path):
    rows = events(spark).select("instance_id", "ts", "seq", "state")
    stream = feed(*thirds(rows))
    streams.run_to_end(streams.live_state_writer(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = streams.read_live_state(spark, f"{tmp_path}/out")
    want = batch_changes.latest_state(rows, "instance_id", ["ts", "seq"], "state")
    assert text(got.select("instance_id", "state")) == text(want)


def test_live_ledger_equals_batch(spark, feed, tmp_path):
    rows = events(spark).withColumn("project_id", F.lit(1).cast("long")).drop("state", "ok")
    stream = as_event_time(feed(*thirds(rows)), "ts")
    streams.run_to_end(streams.live_ledger_writer(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    ledger = usage.usage_ledger(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    closed = spark.read.parquet(f"{tmp_path}/out/closed").drop("batch").select(*usage.LEDGER)
    opened = streams.read_open_intervals(spark, f"{tmp_path}/out")
    assert text(closed) == text(ledger.where("finished_at IS NOT NULL"))
    assert text(opened) == text(usage.open_usages(ledger))
    assert spark.read.parquet(f"{tmp_path}/out/late").count() == 0


def test_live_tables_write_what_changed_and_are_compacted(spark, feed, tmp_path):
    """Ten batches of a few instances each, whole state every fourth batch."""
    rows = events(spark, n=100).withColumn("project_id", F.lit(1).cast("long"))
    first = rows.selectExpr("project_id", "seq + 1000 AS instance_id", "plan_id", "seq", "ts", "state")
    small = [rows.where(f"seq >= {a} AND seq < {a + 3}").select(*first.columns) for a in range(0, 27, 3)]
    every = [first, *small]
    stream = as_event_time(feed(*every), "ts")
    out = f"{tmp_path}/ledger"
    writer = streams.live_ledger_writer(stream.drop("state"), out, out + "-cp", buckets=8, compact_every=4)
    streams.run_to_end(writer)
    # Batch 8 wrote all of it, batch 9 the instances it touched; what came before is gone.
    written = {b: spark.read.parquet(f"{out}/open/batch={b}").count() for b in (8, 9)}
    assert written[9] <= 3 and written[8] > 100 and not os.path.exists(f"{out}/open/batch=7")
    everything = every[0]
    for more in small:
        everything = everything.unionByName(more)
    ledger = usage.usage_ledger(everything.drop("state").withColumn("ts", F.col("ts").cast("timestamp")))
    assert text(streams.read_open_intervals(spark, out)) == text(usage.open_usages(ledger))
    closed = spark.read.parquet(f"{out}/closed").drop("batch").select(*usage.LEDGER)
    assert text(closed) == text(ledger.where("finished_at IS NOT NULL"))

    out = f"{tmp_path}/state"
    changes = stream.select("instance_id", "ts", "seq", "state")
    streams.run_to_end(streams.live_state_writer(changes, out, out + "-cp", compact_every=4))
    got = streams.read_live_state(spark, out).select("instance_id", "state")
    assert text(got) == text(batch_changes.latest_state(everything, "instance_id", ["ts", "seq"], "state"))
    kept = {f for f in os.listdir(out) if f.startswith("batch=")}
    assert kept == {"batch=8", "batch=9"}


def test_live_ledger_sets_late_changes_apart(spark, feed, tmp_path):
    schema = "project_id long, instance_id long, plan_id long, seq long, ts timestamp"
    hour = datetime.timedelta(hours=1)
    first = spark.createDataFrame([(1, 1, 1, 1, BASE + 5 * hour)], schema)
    second = spark.createDataFrame([(1, 1, 2, 2, BASE), (1, 1, 3, 3, BASE + 6 * hour)], schema)
    stream = feed(first, second)
    streams.run_to_end(streams.live_ledger_writer(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    late = spark.read.parquet(f"{tmp_path}/out/late").collect()
    assert [(r.seq, r.plan_id) for r in late] == [(2, 2)]
    closed = spark.read.parquet(f"{tmp_path}/out/closed").collect()
    assert [(r.seq, r.finished_at - r.started_at) for r in closed] == [(1, hour)]


def test_deliveries_are_deduped_across_batches(spark, feed, tmp_path):
    def batch(ids, delivery):
        rows = [(f'{{"id": {i}}}' if i else "{bad", BASE, delivery) for i in ids]
        return spark.createDataFrame(rows, "body string, ts timestamp, delivery int")

    stream = decode_messages(feed(batch([1, 2, 0, 2], 1), batch([2, 3, 0], 2), batch([1, 1, 4], 3)))
    for spread in (None, ("delivery", 4)):
        out = f"{tmp_path}/out{spread is None}"
        once = streams.dedupe_deliveries(stream.where(~F.col("is_malformed")), "ts", "1 hour", spread)
        streams.run_to_end(streams.append_rows(once.select("id"), out, out + "-cp"))
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_sessions_equal_bursts_once_closed(spark, feed, tmp_path):
    rows = events(spark, seed=4).selectExpr("instance_id AS target", "ts", "seq", "ok")
    # A last row, far ahead, moves the watermark past every session before it.
    end = spark.createDataFrame([(99, BASE + datetime.timedelta(days=400), 999, True)], rows.schema)
    stream = as_event_time(feed(*thirds(rows), end), "ts")
    bursts = streams.session_bursts(stream, "2 hours", "10 minutes")
    streams.run_to_end(streams.append_rows(bursts, f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out").select("target", F.col("started_at").cast("timestamp_ntz"), "attempts")
    want = timeline.retry_bursts(rows, "2 HOURS", 3).select("target", "started_at", "attempts")
    assert text(got) == text(want)


def test_windows_drop_rows_behind_the_watermark(spark, feed, tmp_path):
    def batch(hours):
        return spark.createDataFrame([("a", BASE + datetime.timedelta(hours=h)) for h in hours], "action string, ts timestamp")

    # A batch is judged by the watermark that the batch before it started with.
    stream = feed(batch([0, 1, 30]), batch([31]), batch([2]), batch([100]))
    counted = streams.windowed_tasks(stream, "ts", "12 hours", "12 hours", "6 hours")
    streams.run_to_end(streams.append_rows(counted, f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = {r.window_start: r.tasks for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {BASE: 2, BASE + datetime.timedelta(hours=24): 2}  # hour 2 came too late


def test_late_rows_do_not_depend_on_the_batches(spark, tmp_path):
    """Rows are held against earlier ones of their own batch and of the batches before."""
    days = [("a", 10), ("b", 1), ("a", 8), ("a", 6), ("b", 0), ("b", 9), ("a", 10), ("b", 2), ("c", 5), ("c", 1), ("c", 3)]
    rows = [(s, BASE + datetime.timedelta(days=x), i) for i, (s, x) in enumerate(days)]
    schema = "source string, ts timestamp, arrival int"
    want = [("a", 6), ("b", 2), ("c", 1)]
    for n, cuts in enumerate(([0, 11], [0, 2, 5, 7, 11], list(range(12)))):
        out, folder = f"{tmp_path}/{n}", f"{tmp_path}/rows{n}"
        for a, b in zip(cuts, cuts[1:]):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        streams.run_to_end(streams.late_row_writer(stream, "source", "ts", ["arrival"], "3 DAYS", f"{out}/out", f"{out}/cp"))
        late = spark.read.parquet(f"{out}/out/late").collect()
        assert sorted((r.source, (r.ts - BASE).days) for r in late) == want


def test_notifications_stream(spark, feed, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "id long, state int")

    writer = sinks.notification_writer(feed(batch((1, 1), (2, 0)), batch((3, 5))), f"{tmp_path}/out", f"{tmp_path}/cp")
    streams.run_to_end(writer)
    got = sorted((r.channel, r.event, r.payload) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        ("private-instance-1", "instance:initialized", '{"state":"running"}'),
        ("private-instance-3", "instance:initialized", '{"state":"disabled"}'),
    ]


def test_discovery_files(spark, tmp_path):
    targets = spark.createDataFrame(
        [(1, 2, "pg", "node", "", "https", "10.0.0.1:6666")],
        "node_id long, instance_id long, kind string, job string, secret string, scheme string, target string",
    )
    sinks.write_discovery(targets, f"{tmp_path}/out")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert lines == [
        '{"labels":{"node_id":"1","instance_id":"2","kind":"pg","job":"node","__scheme__":"https"},'
        '"targets":["10.0.0.1:6666"]}'
    ]


def test_tasks_run_through_from_message_to_steps(spark, feed, tmp_path):
    """Messages in, steps to run out: decode, drop copies, look up, expand."""

    def batch(*bodies):
        return spark.createDataFrame([(b, BASE) for b in bodies], "body string, ts timestamp")

    tasks = spark.createDataFrame(
        [(1, "destroy-pg-1", 0, "{}"), (2, "destroy-pg-2", 1, "{}"), (3, "nope", 0, "{}"), (4, "update-pg-1-to-1", 0, '{"whitelist":[]}')],
        "id long, action string, state int, metadata string",
    )
    stream = decode_messages(feed(batch('{"id": 1}', "{bad", '{"id": 2}'), batch('{"id": 1}', '{"id": 3}', '{"id": 4}', '{"id": 9}')))
    once = streams.dedupe_deliveries(stream.where(~F.col("is_malformed")), "ts", "1 hour")
    steps = workflow.expand_workflow(streams.enrich_stream(once.select("id"), tasks), definitions(spark))
    streams.run_to_end(streams.append_rows(steps.select("task_id", "idx", "step"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = sorted((r.task_id, r.idx, r.step) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        (1, 1, "destroy-monitor-1"), (1, 2, "destroy-dns-1"), (1, 3, "destroy-node-1"),
        (4, 1, "update-whitelist"), (4, 2, "finish"),
    ]


def test_live_ledger_goes_on_after_a_restart(spark, feed, tmp_path):
    rows = events(spark).withColumn("project_id", F.lit(1).cast("long")).drop("state", "ok")
    stream = as_event_time(feed(*thirds(rows)), "ts")
    writer = lambda: streams.live_ledger_writer(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    query = writer().trigger(processingTime="0 seconds").start()
    while not (query.lastProgress and query.lastProgress["batchId"] >= 0):
        query.awaitTermination(1)
    query.stop()  # somewhere in the middle
    streams.run_to_end(writer())
    ledger = usage.usage_ledger(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    closed = spark.read.parquet(f"{tmp_path}/out/closed").drop("batch").select(*usage.LEDGER)
    assert text(closed) == text(ledger.where("finished_at IS NOT NULL"))
