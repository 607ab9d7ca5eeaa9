"""Column rules on small cases, one per behaviour worth keeping."""

import ipaddress
import shlex

import pytest
from pyspark.sql import functions as F

from harborline.functions import documents, rules
from harborline.operators import changes, lookups, network, reports
from harborline.plans.actions import action_catalogue, action_names


def one(spark, text, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_state_labels(spark):
    df = spark.createDataFrame([(i,) for i in range(9)], "state int")
    node = [r.state_label for r in rules.decode_state(df, "node").collect()]
    assert node[3] == "orphan" and node[2] == "running" and node[8] is None
    generic = [r.state_label for r in rules.decode_state(df, "generic").collect()]
    assert generic[:8] == ["pending", "created", "running", "updating", "down", "terminating", "terminated", "failure"]
    instance = [r.state_label for r in rules.decode_state(df, "instance").collect()]
    assert instance[:7] == ["pending", "running", "terminated", "unhealthy", "maintenance", "disabled", None]


def test_threads(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 3, 4, 7, 8, 96)], "vcpu int")
    assert [r.threads for r in rules.thread_tier(df).collect()] == [1, 1, 1, 2, 2, 6, 6]


def test_usable_memory_has_no_value_below_the_reserve(spark):
    df = spark.createDataFrame([(99_999_999,), (100_000_000,), (32 * 10**9,)], "memory long")
    assert [r.usable_memory for r in rules.usable_memory(df).collect()] == [None, 0, 31_900_000_000]


@pytest.mark.parametrize(
    "text",
    ["::", "::1", "fd00::12", "1:2:3:4:5:6:7:8", "1::8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1.2.3.4", "2001:DB8::a:b",
     ":::", "1:2", "fd00:::1", "12345::", "1:2:3:4:5:6:7:8:9", "::1::", "g::", "1.2.3", "1.2.3.256", "", "1::2::3", "::1.2.3.256"],
)
def test_ip_pattern(spark, text):
    try:
        ipaddress.ip_address(text)
        valid = True
    except ValueError:
        valid = False
    df = spark.createDataFrame([("10.0.0.1", text)], "ip4 string, ip6 string")
    assert rules.valid_ips(df).first().ips == (["10.0.0.1", text] if valid else ["10.0.0.1"])


def test_shell_quote_equals_posix_quoting(spark):
    texts = ["", "plain", "a b", "it's", "$HOME", "a=b,c:/d.e-f_@%+", "''", "new\nline", "a\"b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.q for r in df.select(rules.shell_quote(F.col("t")).alias("q")).collect()]
    assert got == [shlex.quote(t) for t in texts]


def test_sudo_only_where_login_is_not_root(spark):
    df = spark.createDataFrame([("gcp",), ("do",)], "cloud string").withColumn("x", F.lit("sudo y"))
    got = {r.cloud: r.command for r in rules.render_commands(df, "sudo mv %s && sudo ls", [F.col("x")]).collect()}
    assert got == {"gcp": "sudo mv 'sudo y' && sudo ls", "do": "mv 'sudo y' && ls"}


def test_secret_round_trip_differs_per_row(spark):
    key = F.unhex(F.lit("00112233445566778899aabbccddeeff"))
    df = spark.createDataFrame([("same",), ("same",), ("",)], "s string")
    sealed = df.select("s", rules.encrypt_col(F.col("s"), key).alias("e")).cache()
    texts = [r.e for r in sealed.collect()]
    assert len(set(texts)) == 3 and not any(t.endswith("=") for t in texts)
    assert [r.d for r in sealed.select(rules.decrypt_col(F.col("e"), key).alias("d")).collect()] == ["same", "same", ""]


def test_cron_goes_back_over_midnight(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:30' AS ts")
    assert rules.backup_schedule(df, "ts").first().cron == "59 23 * * *"


def test_metadata_round_trip_keeps_only_the_password_when_empty(spark):
    schema = (
        "role string, record_id string, ip4 string, ip6 string, server_id int, string_id string, "
        "scaleway_snapshots array<string>, exporter_password string"
    )
    df = spark.createDataFrame([("", "", "", "", 0, "", [], ""), ("slave", "r", "1.2.3.4", "::1", 7, "v", ["a"], "p")], schema)
    encoded = documents.encode_metadata(df).select("metadata")
    assert sorted(r.metadata for r in encoded.collect())[0] == '{"prometheus_exporter_password":""}'
    assert sorted(map(str, documents.decode_metadata(encoded).select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_null_value_counts_as_present(spark):
    df = spark.createDataFrame([('{"plan_id":null,"whitelist":[]}',), ("{}",)], "metadata string")
    got = [(r.has_plan_id, r.has_whitelist, r.has_new_password) for r in documents.metadata_flags(df).collect()]
    assert got == [(True, True, False), (False, False, False)]


def test_parse_every_known_action(spark):
    assert len(set(action_names())) == 60
    parsed = documents.parse_action(action_catalogue(spark))
    for r in parsed.collect():
        parts = [r.verb, r.kind]
        if r.verb == "recover":
            parts += ["master", str(r.master_ok).lower()]
            parts += ["slave", str(r.slave_ok).lower()] if r.slave_ok is not None else []
        else:
            parts += [str(r.from_nodes)]
            parts += ["to", str(r.to_nodes)] if r.to_nodes is not None else []
        assert "-".join(parts) == r.action


def test_empty_instance_whitelist_opens_the_port_whatever_the_node_lists(spark):
    nodes = spark.createDataFrame([(1, 1, ["9.9.9.9"]), (2, 2, ["9.9.9.9"])], "id long, instance_id long, whitelist array<string>")
    instances = spark.createDataFrame([(1, "pg", []), (2, "pg", ["8.8.8.8/32"])], "id long, kind string, whitelist array<string>")
    got = network.firewall_rules(nodes, instances).where("protocol = 'tcp' AND port = 5432").collect()
    assert sorted((r.node_id, r.rule_no, r.source) for r in got) == [(1, 2, None), (2, 2, "9.9.9.9"), (2, 3, "8.8.8.8/32")]


def test_whitelist_that_appears_or_goes(spark):
    schema = "id long, whitelist array<string>"
    old = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"])], schema)
    new = spark.createDataFrame([(2, ["b", "c"]), (3, ["d"])], schema)
    got = {(r.instance_id, r.change, r.cidr) for r in network.allowlist_diff(old, new).collect()}
    assert got == {(1, "removed", "a"), (2, "removed", "a"), (2, "added", "c"), (3, "added", "d")}


def test_orphans_and_missing_nodes(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, state int")
    results = spark.createDataFrame([(1, True), (2, False), (9, True)], "id long, deleted boolean")
    got = {r.id: r.state for r in changes.orphan_mark(nodes, results).collect()}
    assert got == {2: 3, 3: 1}


def test_null_new_value_wins(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, t string, n int")
    new = spark.createDataFrame([(2, None)], "id long, t string")
    assert {r.id: (r.t, r.n) for r in changes.update_by_key(base, new, "id", ["t"]).collect()} == {1: ("a", 1), 2: (None, 2)}


def test_adapters_need_site_logins(spark):
    nodes = spark.createDataFrame([(1, "alibaba"), (2, "gcp"), (3, "nowhere")], "id long, cloud string")
    with pytest.raises(ValueError, match="gcp, azure"):
        lookups.adapter_dispatch(nodes, {})
    got = {r.cloud: (r.ssh_user, r.has_adapter, r.is_unreachable) for r in lookups.adapter_dispatch(nodes, {"gcp": "me", "azure": "me"}).collect()}
    assert got == {"alibaba": (None, True, True), "gcp": ("me", True, False), "nowhere": (None, False, False)}


def test_recovery_without_replica(spark):
    nodes = spark.createDataFrame(
        [(1, "master", False), (2, "master", True), (3, "master", True), (3, "slave", False), (4, "master", False), (4, "slave", True)],
        "instance_id long, role string, healthy boolean",
    )
    instances = spark.createDataFrame([(1, "mysql"), (2, "pg"), (3, "pg"), (4, "mysql")], "id long, kind string")
    got = {r.instance_id: (r.action, r.supported) for r in reports.recovery_action(nodes, instances).collect()}
    assert got == {
        1: ("recover-mysql-master-false", True),
        2: (None, False),
        3: ("recover-pg-master-true-slave-false", True),
        4: ("recover-mysql-master-false-slave-true", False),
    }


def test_success_rate_without_finished_tasks(spark):
    tasks = spark.createDataFrame([("a", 0)], "action string, state int")
    assert reports.task_outcomes(tasks).first().success_pct is None
