"""Streaming queries: each runs over the event files until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import derive, duck, shared
from checks.registry import query
from harborline.session import shared_dir
from harborline.sources.manifests import manifest_writer, read_manifested
from harborline.sources.sinks import state_notifications
from harborline.sources.tables import as_event_time, decode_messages, task_stream
from harborline.sources.tasklog import task_log
from harborline.streaming import streams
from harborline.streaming.keyed import keyed_ledger
from harborline.streaming.waiting import await_tasks


def _events(spark, d):
    schema = fx.read(spark, d, "events").schema
    return task_stream(spark, d, schema, max_files=100, pattern="events.parquet")


def _appended(spark, label, rows):
    """Run an append-mode stream into files and read those back."""
    where = shared_dir(spark, label)
    streams.run_to_end(streams.append_rows(rows, f"{where}/rows", f"{where}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{where}/rows")


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("task_stream", duck("SELECT action, count(*) AS tasks FROM tasks GROUP BY action", "tasks"))
def _(spark, d):
    tasks = derive(_events(spark, d), "tasks").select("id", "action")
    return _appended(spark, "task-stream", tasks).groupBy("action").agg(F.count(F.lit(1)).alias("tasks"))


def _messages(spark, d):
    decoded = decode_messages(fx.messages(derive(_events(spark, d), "message_base")))
    return as_event_time(decoded.where(~F.col("is_malformed")), "ts")


@query(
    "dedupe_deliveries",
    duck(
        """SELECT DISTINCT CAST(json_extract(body, '$.id') AS BIGINT) AS id FROM messages WHERE json_valid(body)""",
        "messages",
    ),
)
def _(spark, d):
    once = streams.dedupe_deliveries(_messages(spark, d), "ts", "1 hour", spread=("delivery", 8))
    return _appended(spark, "dedupe", once.select("id"))


PENDING_ASKED = duck(
    """SELECT t.id, t.action, t.instance_id FROM (SELECT DISTINCT CASE WHEN json_valid(body) THEN
    CAST(json_extract(body, '$.id') AS BIGINT) END AS id FROM messages) m JOIN tasks t ON t.id = m.id
    WHERE t.state <= 0""",
    "messages", "tasks",
)


def _asked_once(spark, d):
    """Each id once, and the task table to look it up in."""
    once = streams.dedupe_deliveries(_messages(spark, d), "ts", "1 hour", spread=("delivery", 8))
    return once.select("id"), shared(spark, d, "tasks").select("id", "action", "instance_id", "state")


@query("enrich_stream", PENDING_ASKED)
def _(spark, d):
    known = streams.enrich_stream(*_asked_once(spark, d))
    return _appended(spark, "enrich", known.select("id", "action", "instance_id"))


@query("enrich_writer", PENDING_ASKED)
def _(spark, d):
    where = shared_dir(spark, "enrich-batches")
    writer = streams.enrich_writer(*_asked_once(spark, d), f"{where}/rows", f"{where}/checkpoint")
    streams.run_to_end(writer)
    return spark.read.parquet(f"{where}/rows").select("id", "action", "instance_id")


@query(
    "live_state",
    duck(
        "SELECT instance_id, arg_max(state, (ts, seq)) AS state FROM state_changes GROUP BY instance_id",
        "state_changes",
    ),
)
def _(spark, d):
    where = shared_dir(spark, "live-state")
    changes = as_event_time(derive(_events(spark, d), "state_changes"), "ts")
    streams.run_to_end(streams.live_state_writer(changes, f"{where}/rows", f"{where}/checkpoint"))
    return streams.read_live_state(spark, f"{where}/rows")


CLOSED = duck(
    """SELECT * FROM (SELECT project_id, instance_id, plan_id, seq, ts AS started_at,
    lead(ts) OVER (PARTITION BY instance_id ORDER BY ts, seq) AS finished_at FROM usage_changes)
    WHERE finished_at IS NOT NULL""",
    "usage_changes",
)


@query("keyed_ledger", CLOSED)
def _(spark, d):
    changes = as_event_time(derive(_events(spark, d), "usage_changes"), "ts")
    closed = _appended(spark, "keyed-ledger", keyed_ledger(changes)).where("not late").drop("late")
    return _ntz(closed, "started_at", "finished_at")


@query(
    "await_tasks",
    duck(
        """, m AS (SELECT CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.id') AS BIGINT) END AS id
        FROM message_base)
        SELECT m.id, t.action, t.id IS NULL AS rejected FROM m LEFT JOIN tasks t ON t.id = m.id WHERE m.id IS NOT NULL""",
        "message_base", "tasks",
    ),
)
def _(spark, d):
    """Every third task is written a batch after its message; last rows far ahead end all waiting."""
    where = shared_dir(spark, "await-tasks")
    decoded = decode_messages(shared(spark, d, "message_base")).where("not is_malformed")
    asked = as_event_time(decoded.select("id", "ts"), "ts")
    known = as_event_time(shared(spark, d, "tasks").select("id", "created_at", "action"), "created_at")
    for days in (1000, 3000):
        far = known.agg(F.max("created_at").alias("at")).selectExpr("-1L AS id", f"at + INTERVAL {days} DAYS AS created_at")
        asked = asked.unionByName(far.withColumnRenamed("created_at", "ts"))
        known = known.unionByName(far.withColumn("action", F.lit("none")))

    def arriving(rows, name, ts, batches):
        last = known.agg(F.max("created_at")).first()[0]
        batch = F.when(F.col("id") >= 0, batches).otherwise(F.when(F.col(ts) < F.lit(last), 2).otherwise(3))
        for i in range(4):
            rows.where(batch == i).coalesce(1).write.mode("append").parquet(f"{where}/{name}")
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/{name}")

    messages = arriving(asked, "messages", "ts", F.lit(0))
    tasks = arriving(known, "tasks", "created_at", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    found = await_tasks(messages, tasks, "400 DAYS", "1 HOUR", "1 HOUR")
    return _appended(spark, "await-tasks", found).where("id >= 0").select("id", "action", "rejected")


@query(
    "task_log",
    duck(
        """, m AS (SELECT CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.id') AS BIGINT) END AS id FROM messages)
        SELECT id, count(*) AS deliveries FROM m GROUP BY id""",
        "messages",
    ),
)
def _(spark, d):
    where = shared_dir(spark, "task-log")
    fx.messages(shared(spark, d, "message_base")).repartition(8).select("body").write.text(f"{where}/log")
    found = decode_messages(task_log(spark, f"{where}/log", prefetch=10_000)).select("id", "segment", "place")
    streams.run_until_idle(streams.append_rows(found, f"{where}/rows", f"{where}/checkpoint"), f"{where}/checkpoint")
    once = spark.read.schema(found.schema).parquet(f"{where}/rows").distinct()
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("deliveries"))


@query("live_ledger", CLOSED)
def _(spark, d):
    where = shared_dir(spark, "live-ledger")
    changes = as_event_time(derive(_events(spark, d), "usage_changes"), "ts")
    streams.run_to_end(streams.live_ledger_writer(changes, f"{where}/rows", f"{where}/checkpoint"))
    closed = spark.read.parquet(f"{where}/rows/closed").drop("batch")
    return _ntz(closed, "started_at", "finished_at")


@query(
    "windowed_tasks",
    duck(
        """, w AS (SELECT action, created_at, unnest([time_bucket(INTERVAL 6 HOUR, created_at),
        time_bucket(INTERVAL 6 HOUR, created_at) - INTERVAL 6 HOUR]) AS window_start FROM tasks)
        SELECT window_start, window_start + INTERVAL 12 HOUR AS window_end, action, count(*) AS tasks FROM w
        GROUP BY window_start, action HAVING window_start + INTERVAL 12 HOUR <=
        (SELECT date_trunc('millisecond', max(created_at)) - INTERVAL 1 DAY FROM tasks)""",
        "tasks",
    ),
)
def _(spark, d):
    tasks = as_event_time(derive(_events(spark, d), "tasks"), "created_at").select("action", "created_at")
    counted = streams.windowed_tasks(tasks, "created_at", "12 hours", "6 hours", "1 day")
    return _ntz(_appended(spark, "windows", counted), "window_start", "window_end")


@query(
    "session_bursts",
    duck(
        """, s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts
        FROM attempts WINDOW w AS (PARTITION BY target ORDER BY ts, seq)),
        b AS (SELECT *, sum(starts) OVER (PARTITION BY target ORDER BY ts, seq) AS burst FROM s)
        SELECT target, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS closes_at, count(*) AS attempts,
        count(*) FILTER (WHERE ok) AS succeeded FROM b GROUP BY target, burst
        HAVING max(ts) + INTERVAL 6 HOUR <=
        (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM attempts)""",
        "attempts",
    ),
)
def _(spark, d):
    attempts = as_event_time(derive(_events(spark, d), "attempts"), "ts")
    bursts = streams.session_bursts(attempts, "6 hours", "10 minutes")
    return _ntz(_appended(spark, "sessions", bursts), "started_at", "closes_at")


@query(
    "late_rows_stream",
    duck(
        """, m AS (SELECT *, max(ts) OVER (PARTITION BY source ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING) AS newest FROM late_arrivals)
        SELECT source, seq, ts FROM m WHERE ts < newest - INTERVAL 3 DAY""",
        "late_arrivals",
    ),
)
def _(spark, d):
    where = shared_dir(spark, "late-rows")
    rows = as_event_time(shared(spark, d, "late_arrivals"), "ts")
    bounds = rows.agg(F.max("arrival").alias("top")).first()
    # Files in the order of arrival; each is a batch.
    for part in range(4):
        piece = rows.where(F.floor(F.col("arrival") * 4 / (bounds.top + 1)) == part)
        piece.coalesce(1).write.mode("append").parquet(f"{where}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/rows")
    writer = streams.late_row_writer(
        stream, "source", "ts", ["arrival", "seq"], "3 DAYS", f"{where}/out", f"{where}/checkpoint"
    )
    streams.run_to_end(writer)
    found = spark.read.parquet(f"{where}/out/late").select("source", "seq", "ts")
    return _ntz(found, "ts")


@query(
    "manifest_sink",
    duck(
        """SELECT concat('private-instance-', instance_id) AS channel,
        CASE state WHEN 1 THEN 'running' ELSE 'disabled' END AS state, count(*) AS told
        FROM state_changes WHERE state IN (1, 5) GROUP BY ALL""",
        "state_changes",
    ),
)
def _(spark, d):
    """Notifications of all state changes as lines of batches that count once."""
    where = shared_dir(spark, "notifications")
    changes = derive(_events(spark, d), "state_changes").selectExpr("instance_id AS id", "state")
    told = state_notifications(changes).select(F.to_json(F.struct("channel", "payload")).alias("json"))
    streams.run_to_end(manifest_writer(told, f"{where}/rows", f"{where}/checkpoint"))
    line = F.from_json("value", "channel string, payload string")
    rows = read_manifested(spark, f"{where}/rows").select(line.alias("line"))
    state = F.get_json_object("line.payload", "$.state")
    return rows.select("line.channel", state.alias("state")).groupBy("channel", "state").agg(F.count("*").alias("told"))
