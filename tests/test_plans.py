"""Plans: what is broadcast, what is shuffled, what reaches the scan."""

import re

import pytest

import __spark_entry__ as entry
from checks.registry import QUERIES
from harborline.operators import lookups
from harborline.session import shared_dir
from harborline.sources.tables import scan_table

# Streams write files while they are built, so their plan is only that of reading these.
STREAMED = {"windowed_tasks", "session_bursts", "task_stream", "dedupe_deliveries", "enrich_stream", "enrich_writer", "live_state", "live_ledger", "late_rows_stream"}
PYTHON = {"map_batches_step"}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_plan(spark, data, name):
    plan = physical(entry.queries()[name](spark, data))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("Python" in plan or "InPandas" in plan) == (name in PYTHON)
    # Every window has keys, and rows meet in one task only for a total over all.
    assert not re.search(r"Window \[[^\n]*\], \[\], \[", plan)
    assert ("SinglePartition" in plan) == (name == "target_count")


# Shuffles of the facts that a query needs at least; one more is a regression.
SHUFFLES = {
    "saga_outcome": 1, "undo_plan": 1, "effective_steps": 1, "usage_ledger": 1, "latest_backup": 1, "replay_set": 1,
    "retry_bursts": 1, "state_transitions": 1, "late_rows": 1, "latest_state": 1, "role_history": 1,
    "run_steps": 0, "metadata_flags": 0, "decode_messages": 0, "tuning_lookup": 0, "parse_action": 0,
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles(spark, data, name):
    plan = physical(entry.queries()[name](spark, data))
    assert len(re.findall(r"Exchange (hash|range|RoundRobin)", plan)) == SHUFFLES[name]


@pytest.mark.parametrize("name", ["unmet_wants", "required_inputs", "step_edges", "duplicate_steps", "expand_workflow"])
def test_tasks_are_not_shuffled(spark, data, name):
    plan = physical(entry.queries()[name](spark, data))
    assert not re.search(r"Exchange hashpartitioning\((task_id|event_id)", plan)


def test_scan_reads_only_its_columns_and_pushes_the_key(spark, data):
    table = scan_table(spark, data, "part", ["p_partkey", "p_size"])
    plan = physical(lookups.lookup_key(table, "p_partkey", 7))
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
    assert "EqualTo(p_partkey,7)" in plan


def test_fixed_tables_are_broadcast_without_the_size_rule(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("tuning_lookup", "adapter_dispatch", "role_history", "plan_change_action"):
            assert "BroadcastHashJoin" in physical(entry.queries()[name](spark, data)), name
        # Sides that grow with the data are not hinted.
        for name in ("instance_with_plan", "issuing_authority", "credential_coverage", "monitoring_targets"):
            plan = physical(entry.queries()[name](spark, data))
            assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Session:
    def __init__(self, master, **conf):
        self.conf = _Conf(conf)
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_is_the_one_the_session_names():
    named = _Session("spark://host:7077", **{"spark.checkpoint.dir": "s3://bucket/cp/"})
    assert shared_dir(named, "x").startswith("s3://bucket/cp/harborline/x-")
    assert shared_dir(named, "x") != shared_dir(named, "x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://host:7077"), "x")
    assert "harborline" in shared_dir(_Session("local[4]"), "x")
