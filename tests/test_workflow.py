"""The catalogue and the checks on it."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from harborline.operators import workflow
from harborline.plans.actions import COMMAND_ROLES, action_names
from harborline.plans.catalogue import definition_rows, definitions, read_definitions, workflows

# Steps per action: in all, or per key for updates (password, eviction, plan, whitelist).
COUNTS = {
    "redis": dict(c1=9, on1=9, off1=4, d1=3, c2=15, on2=16, off2=7, d2=6, u11=(1, 1, 11, 1), u12=(1, 1, 17, 1),
                  u21=(2, 2, 14, 1), u22=(2, 2, 19, 1), rf=12, rft=13, rff=21, rtf=8),
    "keydb": dict(c1=9, on1=9, off1=4, d1=3, c2=14, on2=15, off2=7, d2=6, u11=(1, 1, 10, 1), u12=(1, 1, 15, 1),
                  u21=(2, 2, 14, 1), u22=(2, 2, 19, 1), rf=12, rft=11, rff=21, rtf=7),
    "keydb-pro": dict(c1=9, on1=9, off1=4, d1=3, u11=(1, 1, 10, 1), rf=12),
    "pg": dict(c1=11, on1=10, off1=4, d1=3, c2=19, on2=18, off2=7, d2=6, u11=(1, 0, 13, 1), u12=(1, 0, 21, 1),
               u21=(1, 0, 16, 1), u22=(1, 0, 23, 1), rf=13, rft=16, rff=24, rtf=10),
    "mysql": dict(c1=10, on1=9, off1=4, d1=3, u11=(1, 0, 12, 1), rf=12),
}
NAMES = dict(
    c1="create-{}-1", c2="create-{}-2", on1="poweron-{}-1", on2="poweron-{}-2", off1="poweroff-{}-1", off2="poweroff-{}-2",
    d1="destroy-{}-1", d2="destroy-{}-2", u11="update-{}-1-to-1", u12="update-{}-1-to-2", u21="update-{}-2-to-1",
    u22="update-{}-2-to-2", rf="recover-{}-master-false", rft="recover-{}-master-false-slave-true",
    rff="recover-{}-master-false-slave-false", rtf="recover-{}-master-true-slave-false",
)


def test_steps_per_action(spark):
    got = {r.action: r for r in workflow.action_profile(definitions(spark), ["action"]).collect()}
    assert set(got) == set(action_names()) == set(workflows())
    for kind, counts in COUNTS.items():
        for short, want in counts.items():
            r = got[NAMES[short].format(kind)]
            if isinstance(want, tuple):
                keyed = (r.on_new_password, r.on_eviction_policy, r.on_plan_id, r.on_whitelist)
                assert (r.unconditional, keyed) == (1, want), r.action
            else:
                assert r.steps == r.unconditional == want, r.action


def test_size_of_the_catalogue():
    rows = definition_rows()
    assert len(rows) == 730
    assert len({r[3] for r in rows}) == 40
    assert set(COMMAND_ROLES) <= {r[3] for r in rows}


def test_duplicate_step_names(spark):
    got = {(r.action, r.step) for r in workflow.duplicate_steps(definitions(spark), ["action"]).collect()}
    assert got == {
        ("update-redis-1-to-2", "setup-ufw-for-new-master"),
        ("update-redis-2-to-2", "update-password"),
        ("update-keydb-2-to-2", "update-password"),
        ("update-pg-1-to-1", "update-whitelist"),
        ("update-pg-1-to-1", "finish"),
        ("update-mysql-1-to-1", "update-whitelist"),
        ("update-mysql-1-to-1", "finish"),
    }


def test_wants_that_nothing_provides(spark):
    given = ["instance_id", "plan_id", "node0_id", "node1_id", "node2_id", "old_password", "password"]
    unmet = workflow.unmet_wants(definitions(spark), given, ["action"]).collect()
    assert [(r.action, r.step, r.key) for r in unmet] == [("recover-mysql-master-false", "setup-from-latest-backup", "node_id")]


def test_edges_take_the_latest_earlier_provider(spark):
    rows = [("a", 1, "p", [], ["k"]), ("a", 2, "q", ["k"], ["k"]), ("a", 3, "r", ["k"], []), ("a", 4, "s", ["z"], ["z"])]
    steps = spark.createDataFrame(rows, "action string, idx int, step string, wants array<string>, provides array<string>")
    got = sorted((r.from_step, r.to_step) for r in workflow.step_edges(steps, ["action"]).collect())
    assert got == [("p", "q"), ("q", "r")]
    assert [(r.step, r.key) for r in workflow.unmet_wants(steps, [], ["action"]).collect()] == [("s", "z")]
    assert workflow.required_inputs(steps, ["action"]).count() == 0


def test_expansion_drops_unknown_actions_and_renumbers(spark):
    tasks = spark.createDataFrame(
        [(1, "update-mysql-1-to-1", '{"plan_id":null,"whitelist":[]}'), (2, "nope", "{}"), (3, "destroy-pg-2", "{}"),
         (4, "update-mysql-1-to-1", "{}")],
        "id long, action string, metadata string",
    )
    steps = workflow.expand_workflow(tasks, definitions(spark))
    assert Counter(r.task_id for r in steps.collect()) == {1: 14, 3: 6, 4: 1}
    first = [r.idx for r in steps.where("task_id = 1").orderBy("idx").collect()]
    assert first == list(range(1, 15))
    assert steps.where("task_id = 4").first().step == "finish"


def test_expansion_by_variant_equals_expansion_by_filter(spark):
    keys = ["new_password", "eviction_policy", "plan_id", "whitelist"]
    rows = []
    for i, action in enumerate(action_names()):
        for bits in range(16):
            met = ",".join(f'"{k}":null' for j, k in enumerate(keys) if bits >> j & 1)
            rows.append((i * 16 + bits, action, "{" + met + "}"))
    tasks, defs = spark.createDataFrame(rows, "id long, action string, metadata string"), definitions(spark)
    few = workflow.expand_workflow(tasks, defs)
    many = workflow.expand_workflow(tasks, defs, max_steps=10)
    assert few.columns == many.columns
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_definitions_from_a_file(spark, tmp_path):
    definitions(spark).write.json(f"{tmp_path}/defs")
    back = read_definitions(spark, f"{tmp_path}/defs")
    assert sorted(map(str, back.collect())) == sorted(map(str, definitions(spark).collect()))


def test_large_definition_tables_are_not_broadcast(spark, monkeypatch):
    tasks = spark.createDataFrame([(1, "a", "{}")], "id long, action string, metadata string")
    monkeypatch.setattr(workflow, "is_small", lambda *args: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = workflow.expand_workflow(tasks, definitions(spark), max_steps=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("check", ["step_edges", "required_inputs", "duplicate_steps", "unmet_wants"])
def test_analysis_by_variant_equals_analysis_of_expanded_tasks(spark, check):
    rows = []
    for i, action in enumerate([*action_names(), "unknown"]):
        for bits in range(16):
            keys = [k for j, k in enumerate(["new_password", "eviction_policy", "plan_id", "whitelist"]) if bits >> j & 1]
            rows.append((i * 16 + bits, action, "{" + ",".join(f'"{k}":null' for k in ["instance_id", *keys]) + "}"))
    tasks, defs = spark.createDataFrame(rows, "id long, action string, metadata string"), definitions(spark)
    analyse, keep = getattr(workflow, check), None
    if check == "unmet_wants":
        analyse = lambda steps, by: workflow.unmet_wants(steps, [], by)
        keep = lambda row, given: ~F.array_contains(given, row["key"])
    few = workflow.analyse_tasks(tasks, defs, analyse, keep)
    many = workflow.analyse_tasks(tasks, defs, analyse, keep, max_steps=10)
    assert few.count() > 0
    assert sorted(map(str, few.select(*many.columns).collect())) == sorted(map(str, many.collect()))
    assert "Exchange hashpartitioning(task_id" not in few._jdf.queryExecution().executedPlan().toString()
