"""Folded reports equal a full recompute; sketches merge over days within their stated error."""

import random

from harborline.operators import kept
from harborline.operators.reports import capacity_parts

NODE = "id long, instance_id long, plan_id long, cloud string, region string"
SUMS = ["cloud", "region", "kind", "nodes", "vcpu", "memory"]


def parts(df):
    return sorted(map(str, (tuple(r[c] for c in SUMS) for r in df.collect())))


def test_batches_fold_to_a_recompute(spark):
    rng = random.Random(5)
    instances = spark.createDataFrame([(i, f"k{i % 2}") for i in range(6)], "id long, kind string")
    plans = spark.createDataFrame([(i, 1 + i, 10 * i) for i in range(4)], "id long, vcpu int, memory long")

    def node(i):
        return (i, rng.randrange(6), rng.randrange(5), rng.choice(["a", "b", None]), rng.choice(["r", "s"]))

    nodes = {i: node(i) for i in range(30)}
    base = spark.createDataFrame(list(nodes.values()), NODE)
    state = capacity_parts(base, instances, plans)
    for turn in range(3):
        changes = []
        for seq in range(25):
            i, deleted = rng.randrange(40), rng.random() < 0.4
            changes.append((*node(i), deleted, seq))
        if turn == 2:  # at last all go
            changes = [(*node(i), True, 0) for i in range(40)]
        batch = spark.createDataFrame(changes, f"{NODE}, deleted boolean, seq int")
        state = kept.fold_capacity(state, kept.node_deltas(base, batch, ["seq"]), instances, plans)
        for *row, deleted, _ in sorted(changes, key=lambda c: c[-1]):
            nodes.pop(row[0], None)
            if not deleted:
                nodes[row[0]] = tuple(row)
        base = spark.createDataFrame(list(nodes.values()), NODE)
        assert parts(state) == parts(capacity_parts(base, instances, plans))
    assert state.count() == 0


def test_rows_without_a_key_are_only_added(spark):
    base = spark.createDataFrame([(None, 1, 1, "a", "r"), (1, 1, 1, "a", "r")], NODE)
    batch = spark.createDataFrame([(None, 2, 1, "a", "r", None, 1), (9, 2, 1, "a", "r", True, 1)], f"{NODE}, deleted boolean, seq int")
    assert [(r.id, r.sign) for r in kept.node_deltas(base, batch, ["seq"]).collect()] == [(None, 1)]


def test_sketches_of_days_merge(spark):
    plans = spark.createDataFrame([(0, "x"), (1, "y")], "id long, kind string")
    # Two thirds of all rows are of one kind; every instance comes on two days.
    instances = spark.range(60_000).selectExpr(
        "id % 30000 AS id", "id % 30000 % 500 AS project_id", "CAST(id % 30000 % 3 = 0 AS BIGINT) AS plan_id",
        "date_add(DATE '2024-01-01', CAST(id DIV 30000 AS INT)) AS created_at",
    )
    daily = kept.popularity_sketches(instances, plans)
    assert daily.count() == 4
    got = {r.plan_kind: (r.instances, r.projects) for r in kept.sketched_popularity(daily).collect()}
    for kind, n in (("x", 20_000), ("y", 10_000)):
        assert abs(got[kind][0] - n) <= 0.04 * n and abs(got[kind][1] - 500) <= 20
    assert kept.sketched_popularity(daily.limit(0)).count() == 0
