"""Streams with state of their own: the keyed ledger, messages that wait, and the task log."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from harborline.operators import usage
from harborline.sources.tables import as_event_time, decode_messages
from harborline.sources import tasklog
from harborline.sources.tasklog import TaskLogReader, task_log
from harborline.streaming import streams
from harborline.streaming.keyed import keyed_ledger
from harborline.streaming.waiting import await_tasks

from .test_streams import BASE, events, feed, text, thirds  # noqa: F401  (feed is a fixture)

HOUR = datetime.timedelta(hours=1)


def closed_rows(spark, out):
    rows = spark.read.parquet(out)
    return text(rows.where("not late").select(*usage.LEDGER)), rows.where("late")


def changes_of(spark, n=300):
    return events(spark, n).withColumn("project_id", F.lit(1).cast("long")).drop("state", "ok")


def test_keyed_ledger_equals_batch(spark, feed, tmp_path):  # noqa: F811
    rows = changes_of(spark)
    stream = as_event_time(feed(*thirds(rows)), "ts")
    out = f"{tmp_path}/out"
    streams.run_to_end(streams.append_rows(keyed_ledger(stream), out, f"{tmp_path}/cp"))
    closed, late = closed_rows(spark, out)
    ledger = usage.usage_ledger(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    assert closed == text(ledger.where("finished_at IS NOT NULL")) and late.count() == 0


def test_keyed_ledger_goes_on_after_a_restart(spark, feed, tmp_path):  # noqa: F811
    rows = changes_of(spark)
    stream = as_event_time(feed(*thirds(rows)), "ts")
    out = f"{tmp_path}/out"
    writer = lambda: streams.append_rows(keyed_ledger(stream), out, f"{tmp_path}/cp")
    query = writer().trigger(processingTime="0 seconds").start()
    while not (query.lastProgress and query.lastProgress["batchId"] >= 0):
        query.awaitTermination(1)
    query.stop()
    streams.run_to_end(writer())
    ledger = usage.usage_ledger(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    assert closed_rows(spark, out)[0] == text(ledger.where("finished_at IS NOT NULL"))


def test_keyed_ledger_sets_late_changes_apart(spark, feed, tmp_path):  # noqa: F811
    schema = "project_id long, instance_id long, plan_id long, seq long, ts timestamp"
    first = spark.createDataFrame([(1, 1, 1, 1, BASE + 5 * HOUR), (None, None, None, 7, BASE)], schema)
    second = spark.createDataFrame(
        [(1, 1, 2, 2, BASE), (1, 1, 1, 1, BASE + 5 * HOUR), (1, 1, 3, 3, BASE + 6 * HOUR), (2, None, 4, 8, BASE + HOUR)], schema
    )
    out = f"{tmp_path}/out"
    streams.run_to_end(streams.append_rows(keyed_ledger(feed(first, second)), out, f"{tmp_path}/cp"))
    rows = {(r.instance_id, r.seq): r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {(1, 1), (1, 2), (None, 7)}
    assert rows[1, 2].late and rows[1, 2].finished_at is None
    assert rows[1, 1].finished_at - rows[1, 1].started_at == HOUR and rows[None, 7].project_id is None


@pytest.mark.parametrize("seed", [1, 2])
def test_waiting_changes_are_put_in_order(spark, feed, tmp_path, seed):  # noqa: F811
    """Rows out of order within the delay, cut anywhere: closed rows are those of the ordered table."""
    rows = [tuple(r) for r in changes_of(spark, 120).select("project_id", "instance_id", "plan_id", "seq", "ts").collect()]
    rng = random.Random(seed)
    shuffled = sorted(rows, key=lambda r: r[4] + rng.random() * 10 * HOUR)
    schema = "project_id long, instance_id long, plan_id long, seq long, ts timestamp_ntz"
    end = [(1, 99, 1, 10_000 + i, BASE + datetime.timedelta(days=400 + i)) for i in range(2)]
    cuts = [0, *sorted(rng.sample(range(1, 120), 3)), 120]
    frames = [spark.createDataFrame(shuffled[a:b], schema) for a, b in zip(cuts, cuts[1:])]
    frames += [spark.createDataFrame([e], schema) for e in end]
    stream = as_event_time(feed(*frames), "ts")
    out = f"{tmp_path}/out"
    streams.run_to_end(streams.append_rows(keyed_ledger(stream, "12 hours"), out, f"{tmp_path}/cp"))
    closed, late = closed_rows(spark, out)
    whole = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    assert closed == text(usage.usage_ledger(whole).where("finished_at IS NOT NULL")) and late.count() == 0


def test_messages_wait_for_their_task(spark, tmp_path):
    def write(name, *frames):
        for i, frame in enumerate(frames):
            frame.coalesce(1).write.parquet(f"{tmp_path}/{name}{i}")
            os.makedirs(f"{tmp_path}/{name}", exist_ok=True)
            part = next(f for f in os.listdir(f"{tmp_path}/{name}{i}") if f.endswith(".parquet"))
            os.link(f"{tmp_path}/{name}{i}/{part}", f"{tmp_path}/{name}/{i:03d}.parquet")
        return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    def asked(*rows):
        return spark.createDataFrame([(i, BASE + h * HOUR) for i, h in rows], "id long, ts timestamp")

    def known(*rows):
        return spark.createDataFrame(
            [(i, BASE + h * HOUR, f"a{i}") for i, h in rows], "id long, created_at timestamp, action string"
        )

    # 1 has its task, 2 gets it two batches later, 3 has none, 4's is too old, None is nobody's; the last rows move time on.
    messages = write("messages", asked((1, 10), (2, 10), (3, 10), (4, 10), (None, 10)), asked((5, 12)), asked((6, 300)), asked((7, 900)))
    tasks = write("tasks", known((1, 10), (4, 1)), known((5, 12)), known((2, 11)), known((6, 900)))
    found = await_tasks(messages, tasks, "1 hour", "2 HOURS", "3 HOURS")
    streams.run_to_end(streams.append_rows(found, f"{tmp_path}/out", f"{tmp_path}/cp"))
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    got = {(r.id, r.action, r.rejected) for r in rows}
    assert {(1, "a1", False), (2, "a2", False), (5, "a5", False), (3, None, True), (4, None, True)} <= got
    assert len([r for r in rows if r.id in (1, 2, 3, 4, 5)]) == 5
    assert not [r for r in rows if r.id in (3, 4) and not r.rejected]


def segments(folder, *bodies):
    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(bodies):
        with open(f"{folder}/{i:04d}.log", "w") as f:
            f.write("".join(line + "\n" for line in lines))


def numbers(n, first=0):
    return [json.dumps({"id": i}) for i in range(first, first + n)]


def test_log_offsets_and_bound(tmp_path):
    folder = str(tmp_path / "log")
    segments(folder, numbers(5), [], numbers(4, 5))
    reader = TaskLogReader(folder, 3, "g")
    seen, at, steps = [], reader.initialOffset(), 0
    while True:
        end = reader.latestOffset()
        if end == at:
            break
        batch = [x for p in reader.partitions(at, end) for b in reader.read(p) for x in b.column("body").to_pylist()]
        assert 1 <= len(batch) <= 3
        seen += batch
        reader.commit(end)
        at, steps = end, steps + 1
    assert seen == numbers(9) and steps == 3
    # A line that is not ended is not there; once it is, it is next.
    with open(f"{folder}/0003.log", "w") as f:
        f.write('{"id": 9}')
    assert reader.latestOffset() == at
    with open(f"{folder}/0003.log", "a") as f:
        f.write("\n")
    assert reader.latestOffset() == {"segment": "0003.log", "line": 1}
    assert TaskLogReader(folder, 3, "g")._restored() == at


def test_log_batches_begin_where_the_last_ended(tmp_path, monkeypatch):
    """What was read before is not read again with each batch."""
    folder, read = str(tmp_path / "log"), []
    segments(folder, numbers(300), numbers(200, 300))
    lines = tasklog._lines

    def counted(*args):
        for line in lines(*args):
            read.append(line)
            yield line

    monkeypatch.setattr(tasklog, "_lines", counted)
    reader = TaskLogReader(folder, 7, "g")
    seen, at = [], reader.initialOffset()
    while (end := reader.latestOffset()) != at:
        for part in reader.partitions(at, end):
            seen += [x for b in reader.read(part) for x in b.column("body").to_pylist()]
        reader.commit(end)
        at = end
    assert seen == numbers(500)
    assert len(read) < 4 * 500
    # One that begins anew, in the middle of a segment, has to look for that place only once.
    read.clear()
    late = TaskLogReader(folder, 7, "h")
    parts = late.partitions({"segment": "0000.log", "line": 290}, {"segment": "0001.log", "line": 5})
    assert [x for p in parts for b in late.read(p) for x in b.column("body").to_pylist()] == numbers(15, 290)
    assert late.partitions({"segment": "0001.log", "line": 5}, {"segment": "0001.log", "line": 9})[0].begin == 5


def test_each_message_once_after_a_crash(spark, tmp_path):
    folder, out = str(tmp_path / "log"), f"{tmp_path}/out"
    segments(folder, numbers(40), [*numbers(30, 40), "{bad", ""], numbers(20, 70))
    crash = {"left": 1}

    def write(batch, batch_id):
        rows = decode_messages(batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id == 2 and crash["left"]:
            crash["left"] = 0
            raise RuntimeError("lost before the batch was committed")

    def run():
        stream = task_log(spark, folder, prefetch=25)
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").start()

    query = run()
    with pytest.raises(Exception):
        query.awaitTermination(60)
    query = run()
    query.processAllAvailable()
    segments(folder + "2", numbers(5, 90))
    os.link(f"{folder}2/0000.log", f"{folder}/0009.log")  # a segment that comes while the query runs
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(out)
    assert sorted(r.id for r in rows.where("not is_malformed").collect()) == list(range(95))
    assert rows.where("is_malformed").count() == 2
    assert max(r["count"] for r in rows.groupBy("batch").count().collect()) <= 25
    assert rows.select("segment", "place").distinct().count() == rows.count()
