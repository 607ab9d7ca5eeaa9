"""Changes to a table in buckets: the base is not shuffled, and a failed write leaves it as it was."""

import uuid

import pytest
from pyspark.sql import functions as F

from harborline.operators import changes
from harborline.sources.bucketed import KeyedTable


@pytest.fixture
def table(spark):
    made = KeyedTable(spark, f"base_{uuid.uuid4().hex}", "id", 6)
    made.replace(spark.range(100).selectExpr("id", "CAST(id % 3 AS INT) AS state", "concat('n', id) AS name"))
    yield made
    made.drop()
    with pytest.raises(LookupError):
        made.read()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


CHANGES = {
    "update": lambda base, new: changes.update_by_key(base, new, "id", ["state"]),
    "delete": lambda base, new: changes.delete_by_key(base, new, "id"),
    "insert": lambda base, new: changes.insert_if_absent(base, new.withColumn("name", F.lit("new")), "id"),
}


@pytest.mark.parametrize("kind", CHANGES)
def test_only_the_changes_move(spark, table, no_broadcast, kind):
    new = spark.range(95, 105).selectExpr("id", "9 AS state")
    plain = spark.read.parquet(*[p for p in table.read().inputFiles()])
    want = sorted(map(tuple, CHANGES[kind](plain, new).select("id", "state", "name").collect()), key=str)
    changed = CHANGES[kind](table.read(), new).repartition(table.buckets, "id")
    plan = changed._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for i, line in enumerate(lines):
        if "FileScan" in line:
            # The nodes above the scan, by their indent.
            above, level = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < level:
                    above.append(lines[j])
                    level = depth[j]
            assert not any("Exchange" in x for x in above), plan
    assert "FileScan" in plan
    got = table.apply(lambda base: CHANGES[kind](base, new))
    assert sorted(map(tuple, got.select("id", "state", "name").collect()), key=str) == want


def test_a_failed_write_leaves_the_version_before(spark, table):
    before = table.read().count()
    with pytest.raises(Exception):
        table.apply(lambda base: base.withColumn("state", F.raise_error(F.lit("no")).cast("int")))
    assert table.read().count() == before
    assert table.apply(lambda base: base.where("id < 10")).count() == 10


def test_null_and_repeated_keys_stay(spark, table):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 1, "a"), (1, 2, "b"), (1, 2, "b")], "id long, state int, name string")
    table.replace(rows)
    new = spark.createDataFrame([(1, 7), (None, 7)], "id long, state int")
    got = table.apply(lambda base: changes.update_by_key(base, new, "id", ["state"])).collect()
    assert sorted((str(r.id), r.state) for r in got) == [("1", 7), ("1", 7), ("None", 1), ("None", 1)]
    assert table.replace(rows.limit(0)).count() == 0
