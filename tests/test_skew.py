"""Every query on tables where one key has a third of all rows, with groups cut small."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.registry import QUERIES
from checks import fixtures
from checks.compare import TABLES, compare, duck_connection
from harborline.operators import lookups, ordered

HOT_ORDER, HOT_USER = 10**9, 7


@pytest.fixture(scope="module")
def skewed(data, tmp_path_factory):
    """The given tables, with a third of the lines on one order and of the events on one user."""
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for table in TABLES.split():
        source = f"SELECT * FROM '{data}/{table}.parquet'"
        if table == "lineitem":
            numbered = f"(SELECT *, row_number() OVER () AS rn FROM '{data}/{table}.parquet')"
            hot = f"CASE WHEN rn % 3 = 0 THEN {HOT_ORDER} ELSE l_orderkey END AS l_orderkey"
            source = f"SELECT * EXCLUDE (rn) REPLACE ({hot}) FROM {numbered}"
        if table == "orders":
            source += f" UNION ALL SELECT * REPLACE ({HOT_ORDER} AS o_orderkey) FROM (SELECT * FROM '{data}/{table}.parquet' LIMIT 1)"
        if table == "events":
            source = f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN {HOT_USER} ELSE user_id END AS user_id) FROM '{data}/{table}.parquet'"
        con.execute(f"COPY ({source}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con.close()
    return str(folder)


@pytest.fixture(scope="module")
def con(skewed):
    connection = duck_connection(skewed)
    yield connection
    connection.close()


@pytest.fixture()
def small_pieces(monkeypatch):
    """Look for hot keys in small inputs too; count how often some were cut."""
    cut = []
    keep = ordered.cut_lineage

    def counted(cuts):
        cut.append(True)
        return keep(cuts)

    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 60)
    monkeypatch.setattr(ordered, "cut_lineage", counted)
    return cut


ORDERED = {
    "append_keyed", "instance_replicas", "peer_allowlist", "late_rows_stream", "effective_steps", "undo_plan", "usage_ledger", "usage_hours",
    "open_usages", "ledger_violations", "latest_backup", "replay_set", "replay_order", "state_transitions", "late_rows",
    "transition_counts", "retry_bursts",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_skewed_tables(spark, con, skewed, small_pieces, name):
    ok, note = compare(spark, con, skewed, name)
    assert ok, note
    assert small_pieces or name not in ORDERED


def test_join_on_a_hot_key_is_split(spark, skewed, tmp_path):
    """No side is broadcast, and what counts as skewed is made small, to see AQE split it."""
    fixtures.nodes(spark, skewed).write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes").repartition(6)
    instances = fixtures.shared(spark, skewed, "instances")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = lookups.monitoring_targets(nodes, instances)
        count = len(joined.collect())
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)
    assert "skew=true" in plan
    assert count == nodes.join(instances, nodes["instance_id"] == instances["id"]).count()
