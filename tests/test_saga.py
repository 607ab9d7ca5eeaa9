"""The saga rule against a literal walk, in both of its forms."""

import random
from collections import Counter

import pytest

from checks import fixtures as fx
from harborline.operators import saga

SCHEMA = "task_id long, step_idx int, step_name string, do_ok boolean, undo_ok boolean"


def random_steps(seed, tasks=300):
    rng = random.Random(seed)
    rows = []
    for task in range(tasks):
        for idx in range(1, rng.randrange(1, 10)):
            rows.append((task, idx, f"s{rng.randrange(5)}", rng.random() < 0.8, rng.random() < 0.85))
    return rows


def walk(rows):
    """Do, fail and undo one step after another, as a task runner would."""
    stages, order, states = {}, {}, {}
    for task in {r[0] for r in rows}:
        steps = sorted(r for r in rows if r[0] == task)
        stage, stack, failed = {}, [], False
        for step in steps:
            stack.append(step)
            _, _, name, do_ok, _ = step
            if stage.get(name, {}).get("done"):
                continue
            stage[name] = {"done": do_ok, "failed": not do_ok, "undone": False, "undone_failed": False}
            if not do_ok:
                failed = True
                break
        if failed:
            stopped = False
            planned = []
            for _, idx, name, _, undo_ok in reversed(stack):
                if name in planned:
                    continue
                planned.append(name)
                order[(task, name)] = len(planned)
                if stopped or stage[name]["undone"]:
                    continue
                stage[name]["undone" if undo_ok else "undone_failed"] = True
                stopped = not undo_ok
        states[task] = 2 if failed else 1
        stages.update({(task, name): s for name, s in stage.items()})
    return stages, order, states


@pytest.mark.parametrize("limit", [None, 20], ids=["window", "aggregate"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_outcome_equals_walk(spark, seed, limit):
    rows = random_steps(seed)
    if limit:  # one task with a third of all steps makes the other form be chosen
        rng = random.Random(seed)
        big = [(9999, i, f"s{rng.randrange(400)}", rng.random() < 0.999, rng.random() < 0.99) for i in range(1, 700)]
        rows += big
    stages, order, states = walk(rows)
    steps = spark.createDataFrame(rows, SCHEMA)
    if limit:
        assert saga.hot_cuts(steps, ["task_id"], ["step_idx"], limit) is not None
    got = saga.saga_outcome(steps, rows_per_piece=limit or 10**9).collect()
    assert {(r.task_id, r.step_name): tuple(r[s] for s in saga.STAGES) for r in got} == {
        key: tuple(s[name] for name in saga.STAGES) for key, s in stages.items()
    }
    assert {r.task_id: r.task_state for r in got} == states
    plan = saga.undo_plan(steps, rows_per_piece=limit or 10**9).collect()
    assert {(r.task_id, r.step_name): r.undo_no for r in plan} == order


def test_counts_at_sf001(spark):
    outcome = saga.saga_outcome(fx.task_steps(spark, "/root/testdata/sf0.01"))
    got = Counter(tuple(r[s] for s in saga.STAGES) for r in outcome.select(*saga.STAGES).collect())
    assert got == {
        (True, False, False, False): 12891,
        (True, False, True, False): 6718,
        (True, False, False, True): 560,
        (False, True, True, False): 9166,
        (False, True, False, True): 829,
    }


def test_duplicate_name_is_skipped_and_undone_at_its_last_place(spark):
    rows = [(1, 1, "a", True, False), (1, 2, "b", True, True), (1, 3, "a", False, True), (1, 4, "c", False, True)]
    steps = spark.createDataFrame(rows, SCHEMA)
    flags = {r.step_idx: r.skipped_duplicate for r in saga.effective_steps(steps).collect()}
    assert flags == {1: False, 2: False, 3: True, 4: False}
    plan = {r.undo_no: (r.step_name, r.step_idx) for r in saga.undo_plan(steps).collect()}
    assert plan == {1: ("c", 4), 2: ("a", 3), 3: ("b", 2)}
    outcome = {r.step_name: r for r in saga.saga_outcome(steps).collect()}
    # The second "a" never ran (its do_ok is not looked at), but its undo_ok counts.
    assert outcome["a"].done and outcome["a"].undone and outcome["a"].step_idx == 1


def test_resume(spark):
    steps = spark.createDataFrame(
        [(t, i, f"s{i}", True, True) for t in (1, 2, 3, 4) for i in (1, 2)], SCHEMA
    )
    stages = spark.createDataFrame(
        [(1, "s1", True, False), (2, "s1", False, True), (3, "s1", True, False), (3, "s2", True, False)],
        "task_id long, step_name string, done boolean, failed boolean",
    )
    got = {r.task_id: (r.resume, r.step_idx) for r in saga.resume_point(steps, stages).collect()}
    assert got == {1: ("do", 2), 2: ("undo", 1), 3: ("finish", None), 4: ("do", 1)}
