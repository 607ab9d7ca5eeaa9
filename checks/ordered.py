"""Batch queries: reports, saga outcomes, usage ledger, timelines, workflows, user steps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.batch import ASKED
from checks.fixtures import duck, shared
from checks.registry import query
from harborline.operators import changes, kept, reports, saga, steps, timeline, usage, workflow
from harborline.operators.dependencies import step_closure, step_levels
from harborline.operators.overlaps import interval_clashes
from harborline.operators.ranges import covering_ranges, range_changes
from harborline.plans.actions import action_names
from harborline.plans.catalogue import definition_rows, definitions
from harborline.sources.bucketed import KeyedTable

ACTIONS_SQL = ", ".join(f"'{name}'" for name in action_names())

# ---- aggregates --------------------------------------------------------------------


@query("target_count", duck("SELECT count(*) AS targets FROM targets", "nodes", "targets"))
def _(spark, d):
    return reports.target_count(fx.target_nodes(fx.nodes(spark, d)))


@query(
    "fleet_capacity",
    duck(
        """SELECT n.cloud, na.n_name AS region, i.kind, CAST(grouping(n.cloud, na.n_name, i.kind) AS INTEGER) AS level,
        count(*) AS nodes, CAST(sum(p.vcpu) AS BIGINT) AS vcpu, CAST(sum(p.memory) AS BIGINT) AS memory
        FROM nodes n JOIN plans p ON p.id = n.plan_id JOIN instances i ON i.id = n.instance_id
        JOIN supplier s ON s.s_suppkey = n.supplier_id JOIN nation na ON na.n_nationkey = s.s_nationkey
        GROUP BY ROLLUP (n.cloud, na.n_name, i.kind)""",
        "nodes", "plans", "instances",
    ),
)
def _(spark, d):
    # The number of a node does not matter here, so lines are not numbered.
    columns = {"instance_id": "l_orderkey", "plan_id": "l_partkey", "cloud": fx.NODE_COLUMNS["cloud"], "s_suppkey": "l_suppkey"}
    lines = fx.read(spark, d, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])
    suppliers = fx.read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    nations = fx.read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    nodes = lines.join(suppliers, "s_suppkey").join(nations, "n_nationkey")
    return reports.fleet_capacity(nodes, shared(spark, d, "instances"), shared(spark, d, "plans"))


@query(
    "task_outcomes",
    duck(
        """SELECT action, count(*) AS tasks, count(*) FILTER (WHERE state = 1) AS succeeded,
        count(*) FILTER (WHERE state = 2) AS failed, count(*) FILTER (WHERE state <= 0) AS pending,
        round(count(*) FILTER (WHERE state = 1) * 100.0 / nullif(count(*) FILTER (WHERE state IN (1, 2)), 0), 2)
        AS success_pct FROM tasks GROUP BY action""",
        "tasks",
    ),
)
def _(spark, d):
    return reports.task_outcomes(shared(spark, d, "tasks"))


@query(
    "instance_topology",
    duck(
        """SELECT instance_id, count(*) AS nodes, count(*) FILTER (WHERE role = 'slave') AS replicas,
        max(ip4) FILTER (WHERE role = 'master') AS master_ip FROM nodes GROUP BY instance_id""",
        "nodes",
    ),
)
def _(spark, d):
    return reports.instance_topology(fx.nodes(spark, d))


@query(
    "instance_replicas",
    duck("SELECT instance_id, node_seq - 1 AS place, ip4 FROM nodes WHERE role = 'slave'", "nodes"),
)
def _(spark, d):
    return reports.instance_replicas(fx.nodes(spark, d))


@query(
    "first_node",
    duck(
        """SELECT instance_id, arg_min(id, (launched_at, id)) AS id, arg_min(role, (launched_at, id)) AS role,
        arg_min(ip4, (launched_at, id)) AS ip4, min(launched_at) AS launched_at FROM nodes GROUP BY instance_id""",
        "nodes",
    ),
)
def _(spark, d):
    nodes = fx.nodes(spark, d).select("id", "instance_id", "role", "ip4", "launched_at")
    return reports.first_node(nodes, ["launched_at", "id"])


@query(
    "plan_popularity",
    duck(
        """SELECT p.kind AS plan_kind, count(DISTINCT i.id) AS instances, count(DISTINCT i.project_id) AS projects
        FROM instances i JOIN plans p ON p.id = i.plan_id GROUP BY p.kind""",
        "instances", "plans",
    ),
)
def _(spark, d):
    return reports.plan_popularity(shared(spark, d, "instances"), shared(spark, d, "plans"))


@query(
    "recovery_action",
    duck(
        f""", h AS (SELECT instance_id, count(*) AS nodes,
        coalesce(bool_and(healthy) FILTER (WHERE role = 'master'), false) AS m,
        bool_and(healthy) FILTER (WHERE role = 'slave') AS s FROM nodes
        WHERE role = 'slave' OR instance_id % 11 <> 0 GROUP BY instance_id),
        a AS (SELECT h.instance_id, h.nodes, CASE WHEN m AND coalesce(s, true) THEN NULL
        WHEN s IS NULL THEN concat('recover-', i.kind, '-master-', CASE WHEN m THEN 'true' ELSE 'false' END)
        ELSE concat('recover-', i.kind, '-master-', CASE WHEN m THEN 'true' ELSE 'false' END, '-slave-',
        CASE WHEN s THEN 'true' ELSE 'false' END) END AS action FROM h JOIN instances i ON i.id = h.instance_id)
        SELECT *, coalesce(action IN ({ACTIONS_SQL}), false) AS supported FROM a""",
        "nodes", "instances",
    ),
)
def _(spark, d):
    left = fx.nodes(spark, d).where("role = 'slave' OR instance_id % 11 <> 0")
    return reports.recovery_action(left, shared(spark, d, "instances"))


@query(
    "plan_change_action",
    duck(
        f""", a AS (SELECT i.id, i.plan_id, i.plan_id + 1 AS new_plan_id,
        concat('update-', i.kind, '-', o.nodes, '-to-', n.nodes) AS action FROM instances i
        JOIN plans o ON o.id = i.plan_id JOIN plans n ON n.id = i.plan_id + 1)
        SELECT *, action IN ({ACTIONS_SQL}) AS supported FROM a""",
        "instances", "plans",
    ),
)
def _(spark, d):
    moved = shared(spark, d, "instances").withColumn("new_plan_id", F.col("plan_id") + 1)
    return reports.plan_change_action(moved, shared(spark, d, "plans"))


@query(
    "unsupported_actions",
    duck(
        f""", asked AS (SELECT action FROM tasks UNION ALL SELECT {ASKED} FROM instances)
        SELECT action, count(*) AS tasks FROM asked WHERE action NOT IN ({ACTIONS_SQL}) GROUP BY action""",
        "tasks", "instances",
    ),
)
def _(spark, d):
    asked = shared(spark, d, "tasks").select("action")
    more = shared(spark, d, "instances").selectExpr(f"{ASKED} AS action")
    return reports.unsupported_actions(asked.unionByName(more))


# ---- saga --------------------------------------------------------------------------

EFFECTIVE = """, e AS (SELECT *, row_number() OVER (PARTITION BY task_id, step_name ORDER BY step_idx) = 1 AS eff
    FROM task_steps),
    f AS (SELECT task_id, min(step_idx) AS f FROM e WHERE eff AND NOT do_ok GROUP BY task_id),
    l AS (SELECT e.task_id, step_name, max(step_idx) AS last_idx, arg_max(undo_ok, step_idx) AS ok
    FROM e JOIN f ON f.task_id = e.task_id AND e.step_idx <= f.f GROUP BY e.task_id, step_name),
    u AS (SELECT task_id, max(last_idx) AS u FROM l WHERE NOT ok GROUP BY task_id),
    o AS (SELECT e.task_id, e.step_name, e.step_idx, f.f IS NULL OR e.step_idx < f.f AS done,
    coalesce(e.step_idx = f.f, false) AS failed, l.last_idx IS NOT NULL AND (u.u IS NULL OR l.last_idx > u.u) AS undone,
    coalesce(l.last_idx = u.u, false) AS undone_failed, CASE WHEN f.f IS NULL THEN 1 ELSE 2 END AS task_state
    FROM e LEFT JOIN f USING (task_id) LEFT JOIN l ON l.task_id = e.task_id AND l.step_name = e.step_name
    LEFT JOIN u ON u.task_id = e.task_id WHERE e.eff AND (f.f IS NULL OR e.step_idx <= f.f))"""


@query(
    "effective_steps",
    duck(f"{EFFECTIVE} SELECT task_id, step_idx, step_name, NOT eff AS skipped_duplicate FROM e", "task_steps"),
)
def _(spark, d):
    rows = saga.effective_steps(fx.task_steps(spark, d))
    return rows.select("task_id", "step_idx", "step_name", "skipped_duplicate")


@query("saga_outcome", duck(f"{EFFECTIVE} SELECT * FROM o", "task_steps"))
def _(spark, d):
    return saga.saga_outcome(fx.task_steps(spark, d))


@query(
    "task_results",
    duck(
        f"""{EFFECTIVE}, r AS (SELECT task_id, max(task_state) AS state FROM o GROUP BY task_id),
        t AS (SELECT id, {ASKED} AS action FROM instances)
        SELECT t.id, t.action, t.action IN ({ACTIONS_SQL}) AS known_action, coalesce(r.state, 1) AS state
        FROM t LEFT JOIN r ON r.task_id = t.id""",
        "task_steps", "instances",
    ),
)
def _(spark, d):
    asked = shared(spark, d, "instances").selectExpr("id", f"{ASKED} AS action")
    return saga.task_results(asked, saga.saga_outcome(fx.task_steps(spark, d)))


@query(
    "undo_plan",
    duck(
        f"""{EFFECTIVE} SELECT task_id, step_name, last_idx AS step_idx,
        row_number() OVER (PARTITION BY task_id ORDER BY last_idx DESC) AS undo_no FROM l""",
        "task_steps",
    ),
)
def _(spark, d):
    return saga.undo_plan(fx.task_steps(spark, d))


@query(
    "resume_point",
    duck(
        """, task_steps_all AS (SELECT * FROM task_steps), prefix AS (SELECT * FROM task_steps WHERE step_idx <= task_id % 7),
        pe AS (SELECT *, row_number() OVER (PARTITION BY task_id, step_name ORDER BY step_idx) = 1 AS eff FROM prefix),
        pf AS (SELECT task_id, min(step_idx) AS f FROM pe WHERE eff AND NOT do_ok GROUP BY task_id),
        st AS (SELECT pe.task_id, step_name, f IS NULL OR step_idx < f AS done, coalesce(step_idx = f, false) AS failed
        FROM pe LEFT JOIN pf USING (task_id) WHERE eff AND (f IS NULL OR step_idx <= f)),
        j AS (SELECT s.task_id, s.step_idx, s.step_name, coalesce(st.done, false) AS done,
        coalesce(st.failed, false) AS failed FROM task_steps_all s
        LEFT JOIN st ON st.task_id = s.task_id AND st.step_name = s.step_name)
        SELECT task_id, CASE WHEN min(step_idx) FILTER (WHERE NOT done) IS NULL THEN 'finish'
        WHEN arg_min(failed, step_idx) FILTER (WHERE NOT done) THEN 'undo' ELSE 'do' END AS resume,
        min(step_idx) FILTER (WHERE NOT done) AS step_idx, arg_min(step_name, step_idx) FILTER (WHERE NOT done)
        AS step_name FROM j GROUP BY task_id""",
        "task_steps",
    ),
)
def _(spark, d):
    rows = fx.task_steps(spark, d)
    stages = saga.saga_outcome(rows.where("step_idx <= task_id % 7"))
    return saga.resume_point(rows, stages)


@query(
    "stage_counts",
    duck(
        f"""{EFFECTIVE} SELECT step_name, count(*) AS stages, count(*) FILTER (WHERE done) AS done,
        count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE undone) AS undone,
        count(*) FILTER (WHERE undone_failed) AS undone_failed FROM o GROUP BY step_name""",
        "task_steps",
    ),
)
def _(spark, d):
    # Through the stage map that each task stores.
    return saga.stage_counts(saga.encode_stages(saga.saga_outcome(fx.task_steps(spark, d))))


@query(
    "stage_counts_given",
    """WITH s AS (SELECT event_id % 5 = 0 AS bad, event_id % 2 = 0 AS even, event_id % 11 = 0 AS el FROM events)
    SELECT 'create-vm' AS step_name, count(*) AS stages, count(*) AS done, CAST(0 AS BIGINT) AS failed,
    count(*) FILTER (WHERE bad) AS undone, CAST(0 AS BIGINT) AS undone_failed FROM s
    UNION ALL SELECT 'setup-vm', count(*), count(*) FILTER (WHERE NOT bad), count(*) FILTER (WHERE bad), 0, 0 FROM s
    UNION ALL SELECT 'finish', count(*), count(*) FILTER (WHERE even), 0, 0, count(*) FILTER (WHERE el) FROM s WHERE NOT bad""",
)
def _(spark, d):
    return saga.stage_counts(shared(spark, d, "task_stages"))


@query(
    "top_failing_steps",
    duck(
        f"""{EFFECTIVE} SELECT step_name, count(*) AS failures FROM o WHERE failed GROUP BY step_name
        ORDER BY failures DESC, step_name LIMIT 3""",
        "task_steps",
    ),
)
def _(spark, d):
    return saga.top_failing_steps(saga.saga_outcome(fx.task_steps(spark, d)), 3)


# ---- usage -------------------------------------------------------------------------

LEDGER_SQL = """, ledger AS (SELECT project_id, instance_id, plan_id, seq, ts AS started_at,
    lead(ts) OVER (PARTITION BY instance_id ORDER BY ts, seq) AS finished_at FROM usage_changes)"""
PERIOD = ("2024-01-08 00:00:00", "2024-01-22 00:00:00")


def _ledger(spark, d):
    return usage.usage_ledger(shared(spark, d, "usage_changes"))


@query("usage_ledger", duck(f"{LEDGER_SQL} SELECT * FROM ledger", "usage_changes"))
def _(spark, d):
    return _ledger(spark, d)


@query("ledger_upsert", duck(f"{LEDGER_SQL} SELECT * FROM ledger", "usage_changes"))
def _(spark, d):
    # The ledger has the purchases; then all changes come, so sign-ups fall into closed
    # intervals and purchases are delivered again.
    rows = shared(spark, d, "usage_changes")
    purchases = fx.derive(fx.read(spark, d, "events").where("event_type = 'purchase'"), "usage_changes")
    return usage.ledger_upsert(usage.usage_ledger(purchases), rows)


@query("open_usages", duck(f"{LEDGER_SQL} SELECT * FROM ledger WHERE finished_at IS NULL", "usage_changes"))
def _(spark, d):
    return usage.open_usages(_ledger(spark, d))


BROKEN = f"""{LEDGER_SQL}, broken AS (SELECT * FROM ledger UNION ALL SELECT project_id, instance_id, plan_id,
    seq + 1000000, started_at + INTERVAL 1 SECOND, CASE WHEN seq % 2 = 0 THEN started_at + INTERVAL 2 SECOND END
    FROM ledger WHERE plan_id = 7)"""


@query(
    "interval_clashes",
    duck(
        f"""{BROKEN} SELECT a.instance_id, a.seq AS first_seq, b.seq AS second_seq, a.started_at AS first_started_at,
        a.finished_at AS first_finished_at, b.started_at AS second_started_at FROM broken a JOIN broken b
        ON a.instance_id = b.instance_id AND (a.started_at, a.seq) < (b.started_at, b.seq)
        AND coalesce(a.finished_at, TIMESTAMP '9999-12-31') > b.started_at""",
        "usage_changes",
    ),
)
def _(spark, d):
    return interval_clashes(_broken_ledger(spark, d))


def _broken_ledger(spark, d):
    """The ledger with a wrong interval inside each one of plan 7, every other one of them open."""
    ledger = _ledger(spark, d)
    wrong = ledger.where("plan_id = 7").selectExpr(
        "project_id",
        "instance_id",
        "plan_id",
        "seq + 1000000 AS seq",
        "started_at + INTERVAL 1 SECOND AS started_at",
        "CASE WHEN seq % 2 = 0 THEN started_at + INTERVAL 2 SECOND END AS finished_at",
    )
    return ledger.unionByName(wrong)


@query(
    "ledger_violations",
    duck(
        f"""{BROKEN},
        v AS (SELECT *, max(coalesce(finished_at, TIMESTAMP '9999-12-31')) OVER (PARTITION BY instance_id
        ORDER BY started_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM broken)
        SELECT instance_id, count(*) FILTER (WHERE finished_at IS NULL) AS open_rows,
        count(*) FILTER (WHERE reached > started_at) AS overlaps FROM v GROUP BY instance_id
        HAVING count(*) FILTER (WHERE finished_at IS NULL) > 1 OR count(*) FILTER (WHERE reached > started_at) > 0""",
        "usage_changes",
    ),
)
def _(spark, d):
    return usage.ledger_violations(_broken_ledger(spark, d))


@query(
    "usage_hours",
    duck(
        f"""{LEDGER_SQL}, c AS (SELECT project_id, plan_id, greatest(started_at, TIMESTAMP '{PERIOD[0]}') AS b,
        least(coalesce(finished_at, TIMESTAMP '{PERIOD[1]}'), TIMESTAMP '{PERIOD[1]}') AS e FROM ledger)
        SELECT project_id, plan_id, count(*) AS intervals, CAST(sum(date_diff('microsecond', b, e)) AS BIGINT)
        AS billable_us, round(CAST(sum(date_diff('microsecond', b, e)) AS DOUBLE) / 3.6e9, 2) AS billable_hours
        FROM c WHERE b < e GROUP BY project_id, plan_id""",
        "usage_changes",
    ),
)
def _(spark, d):
    return usage.usage_hours(_ledger(spark, d), *PERIOD)


# ---- timelines ---------------------------------------------------------------------


@query(
    "latest_backup",
    duck(
        """SELECT r.instance_id, r.seq AS recovery_seq, r.ts AS recovery_at, b.ts AS backup_at FROM recoveries r
        ASOF LEFT JOIN backups b ON b.instance_id = r.instance_id AND b.ts <= r.ts""",
        "recoveries", "backups",
    ),
)
def _(spark, d):
    return timeline.latest_backup(shared(spark, d, "recoveries"), shared(spark, d, "backups"))


@query(
    "replay_set",
    duck(
        """, j AS (SELECT r.instance_id, r.seq AS recovery_seq, r.ts AS recovery_at, b.ts AS backup_at
        FROM recoveries r ASOF JOIN backups b ON b.instance_id = r.instance_id AND b.ts <= r.ts)
        SELECT j.*, (SELECT count(*) FROM log_segments s WHERE s.instance_id = j.instance_id
        AND s.ts > j.backup_at AND s.ts <= j.recovery_at) AS segments FROM j""",
        "recoveries", "backups", "log_segments",
    ),
)
def _(spark, d):
    return timeline.replay_set(
        shared(spark, d, "recoveries"), shared(spark, d, "backups"), shared(spark, d, "log_segments")
    )


@query(
    "replay_order",
    duck(
        """, j AS (SELECT s.instance_id, b.ts AS backup_at, s.ts, s.seq AS segment_seq FROM log_segments s
        ASOF JOIN backups b ON b.instance_id = s.instance_id AND b.ts < s.ts)
        SELECT instance_id, backup_at, segment_seq,
        row_number() OVER (PARTITION BY instance_id, backup_at ORDER BY ts, segment_seq) AS position FROM j""",
        "backups", "log_segments",
    ),
)
def _(spark, d):
    return timeline.replay_order(shared(spark, d, "backups"), shared(spark, d, "log_segments"))


TRANSITIONS = """, t AS (SELECT instance_id, seq, lag(state) OVER w AS from_state, state AS to_state,
    date_diff('microsecond', lag(ts) OVER w, ts) AS dwell_us FROM state_changes
    WINDOW w AS (PARTITION BY instance_id ORDER BY ts, seq))"""


@query(
    "state_transitions",
    duck(f"{TRANSITIONS} SELECT * FROM t WHERE from_state IS NOT NULL", "state_changes"),
)
def _(spark, d):
    return timeline.state_transitions(shared(spark, d, "state_changes"))


@query(
    "transition_counts",
    duck(
        f"""{TRANSITIONS} SELECT from_state, to_state, count(*) AS transitions, CAST(sum(dwell_us) AS BIGINT) AS dwell_us
        FROM t WHERE from_state IS NOT NULL GROUP BY from_state, to_state""",
        "state_changes",
    ),
)
def _(spark, d):
    return timeline.transition_counts(timeline.state_transitions(shared(spark, d, "state_changes")))


@query(
    "retry_bursts",
    duck(
        """, s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts
        FROM attempts WINDOW w AS (PARTITION BY target ORDER BY ts, seq)),
        b AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY target ORDER BY ts, seq) AS BIGINT) AS burst FROM s),
        n AS (SELECT *, row_number() OVER (PARTITION BY target, burst ORDER BY ts, seq) AS no FROM b),
        g AS (SELECT target, burst, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS attempts,
        min(no) FILTER (WHERE ok) AS first_success FROM n GROUP BY target, burst)
        SELECT *, coalesce(first_success, 999999) > 3 AND attempts >= 3 AS exhausted FROM g""",
        "attempts",
    ),
)
def _(spark, d):
    return timeline.retry_bursts(shared(spark, d, "attempts"), "6 HOURS", 3)


@query(
    "late_rows",
    duck(
        """, m AS (SELECT *, max(ts) OVER (PARTITION BY source ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING) AS newest FROM late_arrivals)
        SELECT source, seq, ts, newest FROM m WHERE ts < newest - INTERVAL 3 DAY""",
        "late_arrivals",
    ),
)
def _(spark, d):
    rows = timeline.late_rows(shared(spark, d, "late_arrivals"), "source", "ts", ["arrival", "seq"], "3 DAYS")
    return rows.select("source", "seq", "ts", "newest")


# ---- workflows ---------------------------------------------------------------------


def _list_sql(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]::VARCHAR[]"


DEFS_SQL = "defs(action, idx, step, command, wants, provides, condition) AS (VALUES " + ", ".join(
    f"('{a}', {i}, '{s}', '{c}', {_list_sql(w)}, {_list_sql(p)}, {repr(k) if k else 'NULL'})"
    for a, i, s, c, w, p, k in definition_rows()
) + ")"

# Tasks that failed on an unknown action are taken as recoveries here.
TASK_ACTION = "CASE action WHEN 'resize-redis-1' THEN 'recover-mysql-master-false' ELSE action END"


def steps_sql(action: str) -> str:
    return f""", {DEFS_SQL}, t AS (SELECT id, metadata, {action} AS action FROM tasks),
    steps AS (SELECT t.id AS task_id, t.action, CAST(row_number() OVER (PARTITION BY t.id ORDER BY d.idx) AS INTEGER)
    AS idx, d.step, d.command, d.wants, d.provides, d.condition, json_keys(t.metadata) AS given
    FROM t JOIN defs d ON d.action = t.action
    WHERE d.condition IS NULL OR json_exists(t.metadata, concat('$.', d.condition)))"""


def _tasks(spark, d, action=TASK_ACTION):
    return shared(spark, d, "tasks").withColumn("action", F.expr(action))


def _steps(spark, d, action=TASK_ACTION):
    return workflow.expand_workflow(_tasks(spark, d, action), definitions(spark))


def _variants(spark, d):
    return workflow.steps_by_variant(_tasks(spark, d), definitions(spark))


def _per_task(spark, d, analyse, keep=None):
    return workflow.analyse_tasks(_tasks(spark, d), definitions(spark), analyse, keep)


@query(
    "expand_workflow",
    duck(f"{steps_sql('action')} SELECT task_id, action, idx, step, command, condition FROM steps", "tasks"),
)
def _(spark, d):
    return _steps(spark, d, "action").select("task_id", "action", "idx", "step", "command", "condition")


ASKED_METADATA = """concat('{"instance_id":', id, CASE WHEN id % 2 = 0 THEN ',"plan_id":1' ELSE '' END,
    CASE WHEN id % 3 = 0 THEN ',"new_password":"x"' ELSE '' END, CASE WHEN id % 5 = 0 THEN ',"whitelist":[]' ELSE '' END,
    CASE WHEN id % 7 = 0 THEN ',"eviction_policy":null' ELSE '' END, '}')"""


@query(
    "expand_workflow_all_kinds",
    duck(
        f""", {DEFS_SQL}, t AS (SELECT id, {ASKED} AS action, {ASKED_METADATA} AS metadata FROM instances)
        SELECT t.id AS task_id, t.action, CAST(row_number() OVER (PARTITION BY t.id ORDER BY d.idx) AS INTEGER) AS idx,
        d.step, d.command, array_to_string(d.wants, ' ') AS wants, array_to_string(d.provides, ' ') AS provides
        FROM t JOIN defs d ON d.action = t.action
        WHERE d.condition IS NULL OR json_exists(t.metadata, concat('$.', d.condition))""",
        "instances",
    ),
)
def _(spark, d):
    asked = shared(spark, d, "instances").selectExpr("id", f"{ASKED} AS action", f"{ASKED_METADATA} AS metadata")
    steps = workflow.expand_workflow(asked, definitions(spark))
    return steps.select(
        "task_id", "action", "idx", "step", "command",
        F.array_join("wants", " ").alias("wants"), F.array_join("provides", " ").alias("provides"),
    )


@query(
    "unmet_wants",
    duck(
        f"""{steps_sql(TASK_ACTION)}, w AS (SELECT task_id, idx, step, unnest(wants) AS key, given FROM steps),
        p AS (SELECT task_id, key, min(idx) AS since FROM (SELECT task_id, idx, unnest(provides) AS key FROM steps)
        GROUP BY task_id, key)
        SELECT w.task_id, w.idx, w.step, w.key FROM w LEFT JOIN p ON p.task_id = w.task_id AND p.key = w.key
        WHERE NOT list_contains(given, w.key) AND (p.since IS NULL OR p.since >= w.idx)""",
        "tasks",
    ),
)
def _(spark, d):
    not_given = lambda row, given: ~F.array_contains(given, row["key"])
    found = _per_task(spark, d, lambda steps_, by: workflow.unmet_wants(steps_, [], by), not_given)
    return found.select("task_id", "idx", "step", "key")


@query(
    "required_inputs",
    duck(
        f"""{steps_sql(TASK_ACTION)}, w AS (SELECT DISTINCT task_id, unnest(wants) AS key FROM steps),
        p AS (SELECT DISTINCT task_id, unnest(provides) AS key FROM steps)
        SELECT task_id, key FROM w EXCEPT SELECT task_id, key FROM p""",
        "tasks",
    ),
)
def _(spark, d):
    return _per_task(spark, d, workflow.required_inputs).select("task_id", "key")


@query(
    "step_edges",
    duck(
        f"""{steps_sql(TASK_ACTION)}, w AS (SELECT task_id, idx, step, unnest(wants) AS key FROM steps),
        p AS (SELECT task_id, idx, step, unnest(provides) AS key FROM steps)
        SELECT w.task_id, w.key, max(p.idx) AS from_idx, arg_max(p.step, p.idx) AS from_step, w.idx AS to_idx,
        w.step AS to_step FROM w JOIN p ON p.task_id = w.task_id AND p.key = w.key AND p.idx < w.idx
        GROUP BY w.task_id, w.key, w.idx, w.step""",
        "tasks",
    ),
)
def _(spark, d):
    edges = _per_task(spark, d, workflow.step_edges)
    return edges.select("task_id", "key", "from_idx", "from_step", "to_idx", "to_step")


@query(
    "action_profile",
    duck(
        f"""{steps_sql(TASK_ACTION)} SELECT action, count(*) AS steps,
        count(*) FILTER (WHERE condition IS NULL) AS unconditional,
        count(*) FILTER (WHERE condition = 'new_password') AS on_new_password,
        count(*) FILTER (WHERE condition = 'eviction_policy') AS on_eviction_policy,
        count(*) FILTER (WHERE condition = 'plan_id') AS on_plan_id,
        count(*) FILTER (WHERE condition = 'whitelist') AS on_whitelist FROM steps GROUP BY action""",
        "tasks",
    ),
)
def _(spark, d):
    return workflow.action_profile(_variants(spark, d), ["action"], "tasks")


@query(
    "duplicate_steps",
    duck(
        f"""{steps_sql(TASK_ACTION)} SELECT task_id, step, count(*) AS uses FROM steps GROUP BY task_id, step
        HAVING count(*) > 1""",
        "tasks",
    ),
)
def _(spark, d):
    return _per_task(spark, d, workflow.duplicate_steps).select("task_id", "step", "uses")


@query(
    "shared_steps",
    duck(
        f"""{steps_sql(TASK_ACTION)} SELECT step FROM steps WHERE action = 'create-redis-1'
        INTERSECT SELECT step FROM steps WHERE action = 'update-mysql-1-to-1'""",
        "tasks",
    ),
)
def _(spark, d):
    return workflow.shared_steps(_variants(spark, d), "create-redis-1", "update-mysql-1-to-1")


# ---- steps a user supplies ---------------------------------------------------------

CHECKS = [
    steps.Step(
        "price",
        ["l_extendedprice", "l_discount", "l_quantity"],
        ["net"],
        lambda c: {"net": c["l_extendedprice"] * (1 - c["l_discount"])},
        ok=lambda c: c["l_quantity"] >= 2,
    ),
    steps.Step(
        "tax",
        ["net", "l_tax"],
        ["gross"],
        lambda c: {"gross": c["net"] * (1 + c["l_tax"])},
        ok=lambda c: c["l_tax"] < 0.07,
        undo=lambda c: {"gross": -c["gross"]},
        undo_ok=lambda c: c["l_tax"] < 0.08,
    ),
    steps.Step("accept", ["l_returnflag"], [], lambda c: {}, ok=lambda c: c["l_returnflag"] != "R"),
]


@query(
    "run_steps",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag, l_extendedprice * (1 - l_discount)
    AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, CASE WHEN l_quantity < 2 THEN 0
    WHEN l_tax >= 0.07 THEN 1 WHEN l_returnflag = 'R' THEN 2 END AS f FROM lineitem),
    s AS (SELECT *, CASE WHEN f IS NULL THEN NULL WHEN f >= 1 AND l_tax >= 0.08 THEN 1 ELSE -1 END AS stop FROM r)
    SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN f >= 0 AND stop < 0 THEN NULL ELSE net END AS net,
    CASE WHEN f = 0 THEN NULL WHEN f >= 1 AND stop < 1 THEN -gross ELSE gross END AS gross,
    CASE WHEN f IS NULL THEN 1 ELSE 2 END AS task_state,
    CASE f WHEN 0 THEN 'price' WHEN 1 THEN 'tax' WHEN 2 THEN 'accept' END AS failed_step,
    CASE WHEN stop = 1 THEN 'tax' END AS undo_stopped_at FROM s""",
)
def _(spark, d):
    out = steps.run_steps(fx.read(spark, d, "lineitem"), CHECKS)
    return out.select(
        "l_orderkey", "l_linenumber", "l_quantity", "net", "gross", "task_state", "failed_step", "undo_stopped_at"
    )


@query(
    "map_batches_step",
    "SELECT event_id, user_id, length(event_type) AS type_length, value > 50 AS is_large FROM events",
)
def _(spark, d):
    def measure(frame):
        return frame.assign(
            type_length=frame["event_type"].str.len().astype("int64"), is_large=frame["value"] > 50
        )[["event_id", "user_id", "type_length", "is_large"]]

    rows = fx.read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return steps.map_batches_step(rows, measure, "event_id long, user_id long, type_length long, is_large boolean")


# ---- whitelists as ranges ------------------------------------------------------------


@query(
    "covering_ranges",
    duck(
        """, b AS (SELECT DISTINCT cloud, f - f % size AS first, f - f % size + size AS stop FROM (
        SELECT cloud, (10 * 256 + id % 251) * 65536 + (supplier_id % 251) * 256 + plan_id % 251 AS f,
        CAST(pow(2, 2 + id % 9) AS BIGINT) AS size FROM nodes)),
        r AS (SELECT *, CASE WHEN first <= max(stop) OVER (PARTITION BY cloud ORDER BY first, stop ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM b),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY cloud ORDER BY first, stop) AS no FROM r),
        g AS (SELECT cloud, min(first) AS x, max(stop) - 1 AS y FROM n GROUP BY cloud, no)
        SELECT cloud, 4 AS version, concat_ws('.', x // 16777216, x // 65536 % 256, x // 256 % 256, x % 256) AS first_address,
        concat_ws('.', y // 16777216, y // 65536 % 256, y // 256 % 256, y % 256) AS last_address FROM g""",
        "nodes",
    ),
)
def _(spark, d):
    nodes = fx.nodes(spark, d).selectExpr("cloud", "concat(ip4, '/', 30 - id % 9) AS cidr")
    return covering_ranges(nodes, ["cloud"], "cidr")


@query(
    "range_changes",
    duck(
        """, c AS (SELECT instance_id, 'added' AS change, pos FROM (SELECT instance_id, pos FROM new_whitelists
        EXCEPT SELECT instance_id, pos FROM whitelists)
        UNION ALL SELECT instance_id, 'removed', pos FROM (SELECT instance_id, pos FROM whitelists
        EXCEPT SELECT instance_id, pos FROM new_whitelists))
        SELECT instance_id, change, 4 AS version, concat('192.168.', instance_id % 251, '.', min(pos)) AS first_address,
        concat('192.168.', instance_id % 251, '.', max(pos)) AS last_address FROM c GROUP BY instance_id, change""",
        "whitelists", "new_whitelists",
    ),
)
def _(spark, d):
    instances = shared(spark, d, "instances").select("id")
    old, new = fx.with_instance_whitelist(instances), fx.with_instance_whitelist(instances, shift=1)
    entries = [x.select(F.col("id").alias("instance_id"), F.explode("whitelist").alias("cidr")) for x in (old, new)]
    return range_changes(*entries, ["instance_id"], "cidr")


# ---- what step edges imply ------------------------------------------------------------

EDGES_SQL = f"""{steps_sql(TASK_ACTION)}, w AS (SELECT task_id, idx, unnest(wants) AS key FROM steps),
    p AS (SELECT task_id, idx, unnest(provides) AS key FROM steps),
    e AS (SELECT DISTINCT task_id, from_idx, to_idx FROM (SELECT w.task_id, w.key, max(p.idx) AS from_idx, w.idx AS to_idx
    FROM w JOIN p ON p.task_id = w.task_id AND p.key = w.key AND p.idx < w.idx GROUP BY w.task_id, w.key, w.idx))"""
PATHS_SQL = """WITH RECURSIVE r(task_id, from_idx, to_idx, length) AS (SELECT task_id, from_idx, to_idx, 1 FROM e
    UNION SELECT r.task_id, r.from_idx, e.to_idx, r.length + 1 FROM r
    JOIN e ON e.task_id = r.task_id AND e.from_idx = r.to_idx)"""


@query(
    "step_closure",
    duck(
        f"""{EDGES_SQL} SELECT * FROM ({PATHS_SQL} SELECT task_id, from_idx, to_idx,
        CAST(max(length) AS BIGINT) AS length FROM r GROUP BY task_id, from_idx, to_idx)""",
        "tasks",
    ),
)
def _(spark, d):
    closed = _per_task(spark, d, lambda steps_, by: step_closure(workflow.step_edges(steps_, by), by))
    return closed.select("task_id", "from_idx", "to_idx", "length")


@query(
    "step_levels",
    duck(
        f"""{EDGES_SQL} SELECT * FROM ({PATHS_SQL}, l AS (SELECT s.task_id, s.idx,
        coalesce(b.n, 0) AS level, coalesce(a.n, 0) AS after FROM steps s
        LEFT JOIN (SELECT task_id, to_idx AS idx, max(length) AS n FROM r GROUP BY ALL) b USING (task_id, idx)
        LEFT JOIN (SELECT task_id, from_idx AS idx, max(length) AS n FROM r GROUP BY ALL) a USING (task_id, idx))
        SELECT task_id, idx, CAST(level AS BIGINT) AS level, CAST(after AS BIGINT) AS after,
        level + after = max(level) OVER (PARTITION BY task_id) AS critical FROM l)""",
        "tasks",
    ),
)
def _(spark, d):
    levels = _per_task(spark, d, lambda steps_, by: step_levels(steps_, workflow.step_edges(steps_, by), by))
    return levels.select("task_id", "idx", "level", "after", "critical")


# ---- reports that are kept ------------------------------------------------------------


@query(
    "capacity_after_changes",
    duck(
        """, m AS (SELECT instance_id, plan_id, CASE WHEN state = 2 THEN 'moved' ELSE cloud END AS cloud,
        concat('s', supplier_id) AS region FROM nodes WHERE state <> 3
        UNION ALL SELECT instance_id, plan_id, 'new', concat('s', supplier_id) FROM nodes WHERE role = 'master')
        SELECT n.cloud, n.region, i.kind, CAST(grouping(n.cloud, n.region, i.kind) AS INTEGER) AS level,
        count(*) AS nodes, CAST(sum(p.vcpu) AS BIGINT) AS vcpu, CAST(sum(p.memory) AS BIGINT) AS memory
        FROM m n JOIN plans p ON p.id = n.plan_id JOIN instances i ON i.id = n.instance_id
        GROUP BY ROLLUP (n.cloud, n.region, i.kind)""",
        "nodes", "plans", "instances",
    ),
)
def _(spark, d):
    # Nodes in state 3 go, those in state 2 move to another cloud (said twice), and each master gets a twin.
    nodes = fx.nodes(spark, d).selectExpr(
        "id", "instance_id", "plan_id", "cloud", "concat('s', supplier_id) AS region", "state", "role"
    )
    base = nodes.drop("state", "role")

    def change(rows, seq, deleted=False, **new):
        return rows.select(*base.columns).withColumns(new).withColumns({"deleted": F.lit(deleted), "seq": F.lit(seq)})

    batch = change(nodes.where("state = 3"), 1, True)
    batch = batch.unionByName(change(nodes.where("state = 2"), 1, cloud=F.lit("lost")))
    batch = batch.unionByName(change(nodes.where("state = 2"), 2, cloud=F.lit("moved")))
    batch = batch.unionByName(change(nodes.where("role = 'master'"), 1, id=-F.col("id"), cloud=F.lit("new")))
    instances, plans = shared(spark, d, "instances"), shared(spark, d, "plans")
    parts = reports.capacity_parts(base, instances, plans)
    return reports.capacity_subtotals(
        kept.fold_capacity(parts, kept.node_deltas(base, batch, ["seq"]), instances, plans)
    )


@query(
    "plan_popularity_sketched",
    duck(
        """SELECT p.kind AS plan_kind, count(DISTINCT i.id) AS instances, count(DISTINCT i.project_id) AS projects,
        true AS is_near FROM instances i JOIN plans p ON p.id = i.plan_id GROUP BY p.kind""",
        "instances", "plans",
    ),
)  # the exact counts, and whether the estimates from daily sketches are within 4 %
def _(spark, d):
    instances, plans = shared(spark, d, "instances"), shared(spark, d, "plans")
    guessed = kept.sketched_popularity(kept.popularity_sketches(instances, plans))
    guessed = guessed.withColumnsRenamed({"instances": "__i", "projects": "__p"})
    off = [F.abs(F.col(a) - F.col(b)) <= 0.04 * F.col(b) for a, b in (("__i", "instances"), ("__p", "projects"))]
    exact = reports.plan_popularity(instances, plans).join(guessed, "plan_kind")
    return exact.select("plan_kind", "instances", "projects", (off[0] & off[1]).alias("is_near"))


@query(
    "bucketed_changes",
    duck(
        """SELECT id, CASE WHEN state = 5 THEN 2 ELSE state END AS state FROM instances WHERE state <> 0
        UNION ALL SELECT id, 9 FROM instances WHERE state = 0 AND id % 5 <> 0""",
        "instances",
    ),
)
def _(spark, d):
    instances = shared(spark, d, "instances").select("id", "state")
    table = KeyedTable(spark, f"instances_{uuid.uuid4().hex}", "id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    table.replace(instances)
    new = instances.where("state = 5").select("id", F.lit(2).alias("state"))
    gone = instances.where("state = 0").select("id")
    offered = shared(spark, d, "acc_keys").select(F.col("instance_id").alias("id"), F.lit(9).alias("state"))
    table.apply(lambda base: changes.update_by_key(base, new, "id", ["state"]))
    table.apply(lambda base: changes.delete_by_key(base, gone, "id"))
    return table.apply(lambda base: changes.insert_if_absent(base, offered, "id"))
