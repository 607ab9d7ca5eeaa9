"""Closures, levels and critical steps against a plain walk over small graphs."""

import random

from harborline.operators.dependencies import step_closure, step_levels

EDGES = "g string, from_idx int, to_idx int"


def longest(edges):
    """{(a, b): longest path} by walking all paths; only for graphs without cycles."""
    found = {}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def walk(start, node, length):
        for b in after.get(node, ()):
            found[start, b] = max(found.get((start, b), 0), length + 1)
            walk(start, b, length + 1)

    for a in after:
        walk(a, a, 0)
    return found


def test_random_graphs_equal_a_walk(spark):
    rng = random.Random(3)
    graphs = {}
    for g in ("a", "b", None):
        n = rng.randint(4, 9)
        graphs[g] = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3]
    graphs["chain"] = [(i, i + 1) for i in range(13)]
    rows = [(g, a, b) for g, edges in graphs.items() for a, b in edges]
    closed = step_closure(spark.createDataFrame(rows + rows[:3], EDGES), ["g"]).collect()
    want = {(g, a, b): n for g, edges in graphs.items() for (a, b), n in longest(edges).items()}
    assert {(r.g, r.from_idx, r.to_idx): r.length for r in closed} == want and len(closed) == len(want)


def test_levels_and_critical_steps(spark):
    # 1 -> 2 -> 4, 1 -> 3, 5 alone
    edges = spark.createDataFrame([("x", 1, 2), ("x", 2, 4), ("x", 1, 3), ("x", 1, 2)], EDGES)
    steps = spark.createDataFrame([("x", i) for i in (1, 2, 3, 4, 5, 5)] + [("y", 1)], "g string, idx int")
    got = {(r.g, r.idx): (r.level, r.after, r.critical) for r in step_levels(steps, edges, ["g"]).collect()}
    assert got == {
        ("x", 1): (0, 2, True), ("x", 2): (1, 1, True), ("x", 3): (1, 0, False), ("x", 4): (2, 0, True),
        ("x", 5): (0, 0, False), ("y", 1): (0, 0, True),
    }


def test_cycles_are_reported_and_end(spark):
    # 0 -> 1 -> 2 -> 3 -> 1, 3 -> 4, 7 -> 7; group z has none
    edges = [("x", 0, 1), ("x", 1, 2), ("x", 2, 3), ("x", 3, 1), ("x", 3, 4), ("x", 7, 7), ("z", 1, 2), ("z", None, 1)]
    steps = spark.createDataFrame([("x", i) for i in (0, 1, 2, 3, 4, 7, 8)] + [("z", 1), ("z", 2)], "g string, idx int")
    got = {(r.g, r.idx): (r.level, r.after, r.critical, r.cyclic) for r in step_levels(steps, spark.createDataFrame(edges, EDGES), ["g"]).collect()}
    assert got == {
        ("x", 0): (0, None, False, False), ("x", 1): (None, None, False, True), ("x", 2): (None, None, False, True),
        ("x", 3): (None, None, False, True), ("x", 4): (None, 0, False, False), ("x", 7): (None, None, False, True),
        ("x", 8): (0, 0, False, False), ("z", 1): (0, 1, True, False), ("z", 2): (1, 0, True, False),
    }


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert step_closure(none, ["g"]).count() == 0
    steps = spark.createDataFrame([("x", 1)], "g string, idx int")
    assert [tuple(r) for r in step_levels(steps, none, ["g"]).collect()] == [("x", 1, 0, 0, True, False)]
    assert step_levels(steps.limit(0), none, ["g"]).count() == 0
