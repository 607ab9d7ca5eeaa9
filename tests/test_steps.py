"""User steps: validation by names, compensation row by row."""

import pytest
from pyspark.sql import functions as F

from harborline.operators.steps import Step, map_batches_step, run_steps, validate_steps


def step(name, wants, provides, **kw):
    return Step(name, wants, provides, lambda c: {p: F.lit(1) for p in provides}, **kw)


def test_wants_must_be_available():
    validate_steps(["a"], [step("x", ["a"], ["b"]), step("y", ["a", "b"], [])])
    with pytest.raises(ValueError, match="'x' wants b"):
        validate_steps(["a"], [step("x", ["b"], []), step("y", ["a"], ["b"])])
    with pytest.raises(ValueError, match="used twice"):
        validate_steps(["a"], [step("x", ["a"], []), step("x", ["a"], [])])
    with pytest.raises(ValueError, match="overwrite a"):
        validate_steps(["a"], [step("x", ["a"], ["a"])])


def test_failing_row_is_compensated_from_the_failing_step_back(spark):
    df = spark.createDataFrame([(1, 9, 9), (2, 1, 9), (3, 0, 9), (4, 1, 0)], "id int, a int, u int")
    steps = [
        Step("first", ["a"], ["p"], lambda c: {"p": c["a"] + 10}, undo_ok=lambda c: F.col("u") > 5),
        Step("second", ["p", "a"], ["q"], lambda c: {"q": c["p"] * 2}, ok=lambda c: c["a"] > 0, undo=lambda c: {"q": -c["q"]}),
        Step("third", ["q", "a"], ["r"], lambda c: {"r": c["q"] + 1}, ok=lambda c: c["a"] > 5),
    ]
    got = {r.id: (r.p, r.q, r.r, r.task_state, r.failed_step, r.undo_stopped_at) for r in run_steps(df, steps).collect()}
    assert got[1] == (19, 38, 39, 1, None, None)
    assert got[2] == (None, -22, None, 2, "third", None)
    assert got[3] == (None, -20, None, 2, "second", None)  # provided values are set even by a failing step
    assert got[4] == (11, -22, None, 2, "third", "first")  # the first step could not be undone


def test_unknown_outcome_is_a_failure(spark):
    df = spark.createDataFrame([(None,)], "a int")
    out = run_steps(df, [Step("s", ["a"], [], lambda c: {}, ok=lambda c: c["a"] > 1)]).first()
    assert (out.task_state, out.failed_step) == (2, "s")


def test_no_steps_is_ok(spark):
    assert run_steps(spark.range(2), []).select("task_state").distinct().collect() == [(1,)]


def test_batches(spark):
    out = map_batches_step(spark.range(10), lambda f: f.assign(twice=f["id"] * 2), "id long, twice long")
    assert sorted(r.twice for r in out.collect()) == list(range(0, 20, 2))
