import re
from collections import defaultdict

import pytest

from harborline.llm import mixing

from .edge import bag, documents


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by rounds: full sources leave, the rest share again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            target.update(share)
            break
        target.update({s: most * sizes[s] for s in full})
        open_ -= full
    return target


def check(rows, got):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes, largest = defaultdict(int), defaultdict(int)
    for r, n in zip(rows, size):
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    target = brute_targets(sizes)
    assert bag((r.doc_id, r.source, r["size"], r.source_size) for r in got) == bag(
        (r[0], r[3], n, sizes[r[3]]) for r, n in zip(rows, size)
    )
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        assert r.copies in (int(r.rate + 1e-9), int(r.rate + 1e-9) + 1)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_targets_and_copies(spark):
    df, rows = documents(spark, clashing=True)
    got = mixing.mix_sources(df).collect()
    check(rows, got)
    assert bag(got) == bag(mixing.mix_sources(df).collect())
    assert mixing.mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{"a": 1, "b": 300, "c": 40}, {"a": 2, "b": 2, "z": 900, None: 5}, {"x": 50}])
def test_full_sources(spark, counts):
    rows = []
    for source, n in counts.items():
        for i in range(n):
            rows.append((len(rows), " ".join(["w"] * (1 + i * 7 % 23)), "en", source, 0))
    rows.append((9999, "", "en", "empty", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(rows, mixing.mix_sources(df).collect())


def test_rates_solve_the_dual(spark):
    df, rows = documents(spark)
    sizes = df.groupBy("source").agg({"n_chars": "sum"}).withColumnRenamed("sum(n_chars)", "size")
    targets = mixing.source_targets(sizes)
    rates = mixing.balance(df.selectExpr("source", "n_chars AS size"), targets)
    for r in rates.join(targets, rates.source.eqNullSafe(targets.source)).collect():
        assert r.rate * r.source_size == pytest.approx(r.target, rel=1e-9)
        assert r.steps < 30
