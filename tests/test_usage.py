"""Ledger: batches in any split give what all changes at once give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from harborline.operators import usage

BASE = datetime.datetime(2024, 1, 1)
SCHEMA = "project_id long, instance_id long, plan_id long, ts timestamp_ntz, seq long"


def random_changes(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        instance = 1 if seq % 3 == 0 else rng.randrange(2, 12)
        rows.append((instance % 3, instance, rng.randrange(9), BASE + datetime.timedelta(hours=rng.randrange(300)), seq))
    return rows


def text(df):
    return sorted(str(r) for r in df.collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_upsert_equals_whole(spark, seed):
    rows = random_changes(seed)
    rng = random.Random(seed)
    batches = [[], [], []]
    for row in rows:
        batches[rng.randrange(3)].append(row)
    ledger = usage.usage_ledger(spark.createDataFrame(batches[0], SCHEMA))
    for i in (1, 2):
        again = rng.sample(batches[i - 1], 20)  # delivered a second time
        ledger = usage.ledger_upsert(ledger, spark.createDataFrame(batches[i] + again, SCHEMA))
    assert text(ledger) == text(usage.usage_ledger(spark.createDataFrame(rows, SCHEMA)))


def test_hot_instance_is_cut(spark):
    changes = spark.createDataFrame(random_changes(8, 900), SCHEMA)
    cuts = usage.hot_cuts(changes, ["instance_id"], ["ts", "seq"], rows_per_piece=30)
    assert cuts is not None
    assert text(usage.usage_ledger(changes, cuts)) == text(usage.usage_ledger(changes, None))


def test_violations(spark):
    t = [BASE + datetime.timedelta(days=i) for i in range(6)]
    rows = [
        (1, 1, 1, 1, t[0], t[1]), (1, 1, 1, 2, t[1], None),  # sound
        (1, 2, 1, 3, t[0], None), (1, 2, 1, 4, t[1], None),  # two open, which also overlap
        (1, 3, 1, 5, t[0], t[4]), (1, 3, 1, 6, t[1], t[2]), (1, 3, 1, 7, t[3], t[5]),  # two overlaps
    ]
    schema = "project_id long, instance_id long, plan_id long, seq long, started_at timestamp_ntz, finished_at timestamp_ntz"
    got = {r.instance_id: (r.open_rows, r.overlaps) for r in usage.ledger_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: (2, 1), 3: (0, 2)}


def test_hours_are_clipped_to_the_period(spark):
    t = [BASE + datetime.timedelta(hours=12 * i) for i in range(5)]
    schema = "project_id long, instance_id long, plan_id long, seq long, started_at timestamp_ntz, finished_at timestamp_ntz"
    rows = [(1, 1, 4, 1, t[0], t[2]), (1, 1, 4, 2, t[2], None), (1, 2, 4, 3, t[4], None)]
    got = usage.usage_hours(spark.createDataFrame(rows, schema), "2024-01-01 18:00:00", "2024-01-02 18:00:00").collect()
    assert [(r.intervals, r.billable_hours) for r in got] == [(2, 24.0)]
    assert got[0].billable_us == 24 * 3600 * 10**6


def test_regression_counts(spark):
    from checks.fixtures import shared

    ledger = usage.usage_ledger(shared(spark, "/root/testdata/sf0.01", "usage_changes"))
    assert ledger.count() == 3998
    assert ledger.where(F.col("finished_at").isNotNull()).count() == 3848
