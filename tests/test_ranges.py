"""Address ranges against the addresses themselves, clashing intervals against all pairs."""

import datetime
import ipaddress
import random

import pytest

from harborline.operators import ordered
from harborline.operators.overlaps import interval_clashes
from harborline.operators.ranges import covering_ranges, invalid_blocks, range_changes

BAD = ["", "10.0.0", "10.0.0.256", "10.0.0.1/33", "1.2.3.4.5", ":::", "1::2::3", "12345::", "::/129", "1:2:3:4:5:6:7", "x", None]


def blocks(rng, n):
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            out.append(f"10.0.{rng.randrange(2)}.{rng.randrange(256)}/{rng.choice([22, 24, 28, 30, 31, 32])}")
        else:
            out.append(f"fd00::{rng.randrange(16):x}{rng.randrange(16):x}/{rng.choice([120, 124, 126, 127, 128])}")
    return out


def merged(cidrs):
    """(version, first, last) of the fewest ranges."""
    out = []
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    for version in (4, 6):
        spans = sorted((int(n[0]), int(n[-1])) for n in nets if n.version == version)
        joined = []
        for low, high in spans:
            if joined and low <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([low, high])
        out += [(version, low, high) for low, high in joined]
    return out


def found(df, *columns):
    return sorted(
        (*[r[c] for c in columns], r.version, int(ipaddress.ip_address(r.first_address)), int(ipaddress.ip_address(r.last_address)))
        for r in df.collect()
    )


@pytest.mark.parametrize("rows_per_piece", [None, 5])
def test_fewest_ranges(spark, monkeypatch, rows_per_piece):
    if rows_per_piece:
        monkeypatch.setattr(ordered, "ROWS_PER_PIECE", rows_per_piece)
    rng = random.Random(3)
    lists = {i: blocks(rng, rng.choice([1, 3, 10, 60])) for i in range(12)}
    lists[12] = ["0.0.0.0/0", "::/0", "1.2.3.4"]
    lists[13] = ["2001:db8::/64", "2001:db8:0:1::/64", "2001:DB8::1", "::ffff", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "1::/33"]
    lists[14] = ["255.255.255.255", "255.255.255.254/32", "0.0.0.0"]
    rows = [(i, c) for i, cs in lists.items() for c in cs] + [(0, lists[0][0]), *[(7, b) for b in BAD]]
    df = spark.createDataFrame(rows, "id long, cidr string")
    want = sorted((i, *r) for i, cs in lists.items() for r in merged(cs))
    assert found(covering_ranges(df, ["id"], "cidr"), "id") == want
    assert sorted(map(str, (r.cidr for r in invalid_blocks(df, ["id"], "cidr").collect()))) == sorted(map(str, BAD))


def test_changes_are_those_of_addresses(spark):
    rng = random.Random(4)
    old = {i: blocks(rng, 4) for i in range(10)}
    new = {i: (blocks(rng, 3) + rng.sample(old[i], 2)) for i in range(8)}
    old[20], new[20] = ["10.0.0.0/24"], ["10.0.0.0/25", "10.0.0.128/25"]
    new[21] = ["10.1.0.0/16"]

    def frame(lists):
        return spark.createDataFrame([(i, c) for i, cs in lists.items() for c in cs], "id long, cidr string")

    def addresses(cidrs, version):
        nets = [ipaddress.ip_network(c, strict=False) for c in cidrs]
        return {a for n in nets if n.version == version for a in range(int(n[0]), int(n[-1]) + 1)}

    got = found(range_changes(frame(old), frame(new), ["id"], "cidr"), "id", "change")
    assert not [r for r in got if r[0] == 20]
    for i in [*range(10), 20, 21]:
        for version in (4, 6):
            was, now = addresses(old.get(i, []), version), addresses(new.get(i, []), version)
            for change, want in (("added", now - was), ("removed", was - now)):
                mine = [range(r[3], r[4] + 1) for r in got if r[:3] == (i, change, version)]
                assert sum(map(len, mine)) == len(want) and want == {a for r in mine for a in r}


def test_clashes_are_all_pairs(spark):
    rng, base = random.Random(5), datetime.datetime(1969, 12, 31, 23)
    rows = []
    for seq in range(400):
        start = base + datetime.timedelta(seconds=rng.randrange(20_000))
        length = rng.choice([None, 0, 1, 60, 300, 5000]) if seq % 40 == 0 else rng.choice([0, 1, 7, 60, 61])
        end = None if length is None else start + datetime.timedelta(seconds=length)
        rows.append((1, 1 if seq % 3 == 0 else rng.randrange(2, 40), 1, seq, start, end))
    rows += [rows[5], (1, None, 1, 900, base, None), (1, None, 1, 901, base, None)]
    schema = "project_id long, instance_id long, plan_id long, seq long, started_at timestamp_ntz, finished_at timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    far = datetime.datetime(9999, 1, 1)
    kept = [r for r in set(rows) if r[1] is not None]
    want = {
        (a[1], a[3], b[3]) for a in kept for b in kept
        if a[1] == b[1] and (a[4], a[3]) < (b[4], b[3]) and (a[5] or far) > b[4]
    }
    got = [(r.instance_id, r.first_seq, r.second_seq) for r in interval_clashes(df).collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
    assert interval_clashes(df.limit(0)).count() == 0
