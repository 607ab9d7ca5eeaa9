import random

from harborline.llm import queries, revisits

from .edge import bag

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"


def records(seed, n=400):
    """Half of all under one URL; times tie; kinds, times, urls, validators and headers are missing at times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = rng.choice(["http://hot.org/", "http://hot.org", "HTTP://HOT.org:80/#x", "http://hot.org/a", "https://b.org/?q", None])
        headers = {h: f"{h}{i}" for h in ("date", "etag", "vary", "content-type", "server") if rng.random() < 0.6}
        rows.append(
            (i, url, rng.choice([None, *range(40)]), rng.choice(["response", "revisit", "revisit", "request", None]),
             rng.choice(["t", "u", None]), rng.choice(["m", "n", None]), rng.choice([headers, headers, None]))
        )
    return rows + rows[:20]


def brute(rows):
    canonical = {"http://hot.org": "http://hot.org/", "HTTP://HOT.org:80/#x": "http://hot.org/"}
    rows = [(r[0], canonical.get(r[1], r[1]), *r[2:]) for r in rows]
    out = []
    for record_id, url, ts, kind, etag, modified, headers in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and None not in (url, ts, r[2]) and r[1] == url and r[2] <= ts]
        if not earlier:
            out.append((record_id, url, None, "no_response", None))
            continue
        last = max(earlier, key=lambda r: (r[2], r[0]))
        pair = next(((a, b) for a, b in ((etag, last[4]), (modified, last[5])) if None not in (a, b)), (0, 0))
        if pair[0] != pair[1]:
            out.append((record_id, url, None, "changed", None))
            continue
        renewed = {k: v for k, v in (headers or {}).items() if k in revisits.RENEWED}
        out.append((record_id, url, last[0], "resolved", sorted({**(last[6] or {}), **renewed}.items())))
    return out


def test_random_records_against_brute_force(spark):
    for seed, piece in ((1, None), (2, 25)):
        rows = records(seed)
        found = revisits.resolve_revisits(spark.createDataFrame(rows, SCHEMA), rows_per_piece=piece).collect()
        got = [(r.record_id, r.url, r.response_id, r.status, None if r.headers is None else sorted(r.headers.items())) for r in found]
        assert bag(got) == bag(brute(rows))
        assert {r[3] for r in got} == {"resolved", "changed", "no_response"}


def test_the_query_reaches_every_status(spark):
    found = queries.QUERIES["op3_revisit_asof"](spark, "/root/testdata/sf0.001").collect()
    assert {r.status for r in found} == {"resolved", "changed", "no_response"}
    chosen = [r.response_id for r in found if r.response_id is not None and r.url == "http://www.example.com/"]
    assert len(set(chosen)) > 5  # several responses of one URL to choose from
