"""Counts at sf0.01 that were computed apart from this code (FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import fixtures as fx

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.queries()[name](spark, FOLDER)


def test_nodes(spark, run):
    nodes = fx.nodes(spark, FOLDER)
    got = nodes.agg(F.count("id").alias("n"), F.count_distinct("id").alias("d"), F.count_if(F.col("cloud") == "unknown").alias("u"))
    assert tuple(got.first()) == (60000, 60000, 5949)
    assert run("adapter_dispatch").where("NOT has_adapter").count() == 5949
    gaps = {r.gap: r["count"] for r in run("monitoring_gaps").groupBy("gap").count().collect()}
    assert gaps == {"no_target": 29912, "no_node": 8552}


def test_plans(run):
    assert run("instance_with_plan").where("plan_kind IS NULL").count() == 700
    assert run("tuning_lookup").where("source = 'tuned'").count() == 611


def test_timelines(run):
    backups = run("latest_backup")
    assert (backups.count(), backups.where("backup_at IS NULL").count()) == (2014, 134)
    assert run("retry_bursts").count() == 5725
    assert run("late_rows").count() == 1441


def test_messages_and_tasks(run):
    messages = run("decode_messages")
    assert (messages.count(), messages.where("is_malformed").count()) == (11000, 115)
    assert run("route_unknown").count() == 122
    flags = run("metadata_flags")
    got = {c: flags.where(c).count() for c in flags.columns if c != "id"}
    assert got == {"has_plan_id": 4947, "has_new_password": 3467, "has_whitelist": 2005, "has_eviction_policy": 1486}
