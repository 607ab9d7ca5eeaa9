"""The cut form of a running computation gives what one window per key gives."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harborline.operators.ordered import (
    CUTS,
    MAX_PIECES,
    PIECE,
    hot_cuts,
    last_where,
    running,
    running_count,
    running_max,
    running_sum,
    with_piece,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to key 7, some rows share a time, some keys are null."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        key = 7 if i % 3 == 0 else (None if i % 50 == 1 else rng.randrange(40))
        rows.append((key, rng.randrange(900), i, None if rng.random() < 0.3 else rng.randrange(1000)))
    return spark.createDataFrame(rows, "k long, ts long, seq long, v long").repartition(5).cache()


def metrics():
    return dict(
        n=running_count(),
        earlier=running_count(exclusive=True),
        total=running_sum(F.col("v")),
        top=running_max(F.col("v"), exclusive=True),
        last=last_where(F.struct("ts", "v")),
        seen=last_where(F.col("v"), F.col("v") > 500, exclusive=False),
    )


@pytest.mark.parametrize("backward", [False, True])
def test_cut_groups_equal_whole_groups(skewed, backward):
    keys, order = ["k"], ["ts", "seq"]
    whole = running(skewed, keys, order, backward=backward, cuts=None, **metrics())
    cut = running(skewed, keys, order, backward=backward, rows_per_piece=100, **metrics())
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    assert whole.columns == cut.columns


def test_hot_key_is_cut_into_even_pieces(skewed):
    cuts = hot_cuts(skewed, ["k"], ["ts", "seq"], rows_per_piece=100)
    assert sum(len(r[CUTS]) for r in cuts.collect()) <= MAX_PIECES
    pieces = with_piece(skewed, ["k"], ["ts", "seq"], cuts).where("k = 7").groupBy(PIECE).count().collect()
    assert len(pieces) >= 15
    assert max(r["count"] for r in pieces) <= 200
    assert all(r[PIECE] >= 0 for r in pieces)


def test_pieces_follow_the_order(skewed):
    cuts = hot_cuts(skewed, ["k"], ["ts", "seq"], rows_per_piece=100)
    hot = with_piece(skewed, ["k"], ["ts", "seq"], cuts).where("k = 7")
    spans = hot.groupBy(PIECE).agg(F.min(F.struct("ts", "seq")).alias("a"), F.max(F.struct("ts", "seq")).alias("b"))
    spans = [(tuple(r.a), tuple(r.b)) for r in spans.orderBy(PIECE).collect()]
    assert all(b < a for (_, b), (a, _) in zip(spans, spans[1:]))


def test_cut_window_is_partitioned_by_piece(skewed):
    cut = running(skewed, ["k"], ["ts", "seq"], rows_per_piece=100, n=running_count())
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert PIECE in plan
    physical = cut._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical


def test_no_cuts_without_a_hot_key(spark):
    even = spark.range(5000).selectExpr("id % 500 AS k", "id AS ts")
    assert hot_cuts(even, ["k"], ["ts"], rows_per_piece=100) is None


def test_rows_that_come_out_of_an_array_are_seen(spark):
    """The planner takes this for a few rows; all of one key come out of an array."""
    rows = spark.range(4).selectExpr("id % 2 AS k", "explode(sequence(1L, IF(id = 0, 30000L, 3L))) AS ts")
    cuts = hot_cuts(rows, ["k"], ["ts"], rows_per_piece=1000)
    assert [len(r[CUTS]) for r in cuts.collect()] and cuts.count() == 1


def test_thousands_of_hot_keys_are_all_cut(spark):
    rows = spark.range(5000 * 40).selectExpr("id % 5000 AS k", "id AS ts")
    cuts = hot_cuts(rows, ["k"], ["ts"], rows_per_piece=30)
    assert cuts.count() == 5000
    assert sum(len(r[CUTS]) for r in cuts.collect()) <= MAX_PIECES


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from([1, 1, 1, 2, None]), st.integers(0, 30)), min_size=1, max_size=80),
    size=st.integers(2, 12),
    backward=st.booleans(),
)
def test_any_cut_gives_the_same(spark, rows, size, backward):
    df = spark.createDataFrame([(k, t, i, t % 7) for i, (k, t) in enumerate(rows)], "k long, ts long, seq long, v long")
    whole = running(df, ["k"], ["ts", "seq"], backward=backward, cuts=None, **metrics())
    cut = running(df, ["k"], ["ts", "seq"], backward=backward, rows_per_piece=size, **metrics())
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
