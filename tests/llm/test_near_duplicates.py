import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from harborline.llm import cover_tree, token_groups
from harborline.llm.components import components
from harborline.llm.stored import Stored

from .edge import bag, documents, words
from .edge import components as brute_components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def least_ids(ids, low):
    best = {}
    for i, root in zip(ids, low):
        if i is not None:
            best[root] = min(best.get(root, i), i)
    return [best.get(root) for root in low]


def brute(docs):
    sets = [shingles(text) for _, text in docs]
    links = [
        (a, b) for a, b in combinations(range(len(sets)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    low = brute_components(len(docs), links)
    return bag((d[0], len(s), c) for d, s, c in zip(docs, sets, least_ids([d[0] for d in docs], low))), low


def test_jaccard_like_brute_force(spark):
    df, rows = documents(spark, clashing=True)
    got = token_groups.jaccard_components(df).select("doc_id", "n_shingles", "component_id")
    assert bag(tuple(r) for r in got.collect()) == brute([(r[0], r[1]) for r in rows])[0]
    assert token_groups.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [3, 64])
def test_a_large_group_of_near_copies(spark, monkeypatch, group_rows):
    """Chains of edits: many members are linked to some of the group only."""
    import random

    rng = random.Random(8)
    base = words(rng, 60).split(" ")
    docs = []
    for i in range(150):
        copy = base.copy()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(12)}"
        docs.append((i, " ".join(copy)))
    docs += [(500 + i, words(rng, 40)) for i in range(30)]
    monkeypatch.setattr(token_groups, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(token_groups, "QUERY_ROWS", 5)
    got = token_groups.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    want, low = brute(docs)
    assert len(set(low[:150])) > 3  # not all are one component
    assert bag(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want


def test_much_edited_copies_do_not_meet(spark, monkeypatch):
    """Copies of one text with few to many edits: most candidates would be pairs that link to nothing."""
    import random

    rng = random.Random(5)
    base = [f"word{rng.randrange(5000)}" for _ in range(200)]
    docs = []
    for i in range(240):
        copy = base.copy()
        for _ in range(rng.randrange(13)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    near, met = token_groups._near, []

    def counted(*args):
        found = near(*args)
        met.append(found.count())
        return found

    monkeypatch.setattr(token_groups, "_near", counted)
    got = token_groups.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    want, low = brute(docs)
    assert bag(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want
    assert len(set(low)) > 20 and max(low.count(x) for x in set(low)) > 100
    assert sum(met) < 2 * len(docs)


def test_one_of_each_group_stays(spark):
    df, rows = documents(spark)
    kept = token_groups.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = kept.collect()
    _, low = brute([(r[0], r[1]) for r in rows])
    groups = {low[i] for i, r in enumerate(rows) if shingles(r[1])}
    empty = sum(not shingles(r[1]) for r in rows)
    assert len(got) == len(groups) + empty
    ids = least_ids([r[0] for r in rows], low)
    assert bag(r.doc_id for r in got if shingles(r.text)) == bag({ids[g] if ids[g] is not None else None for g in groups})


def test_components(spark):
    rng = np.random.default_rng(2)
    for links in (
        [(i, i + 1) for i in range(200)],
        [(0, i) for i in range(1, 300)] + [(1000, 300)],
        rng.integers(0, 400, (260, 2)).tolist(),
        [(5, 5)],
    ):
        df = spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long")
        got = {r.node: r.root for r in components(df, Stored(spark, "test")).collect()}
        low = brute_components(1001, links)
        for a, b in links:
            if a != b:
                assert got[a] == got[b] == low[a]


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centres[i % 12] + rng.choice([0.03, 0.2]) * rng.normal(size=16)
        rows.append((i, [float(x) for x in v.astype(np.float32)], 1))
    rows += [(300 + i, rows[7][1], 0) for i in range(20)]  # equal vectors
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] + [1.0] * 15, 0)]
    rows += [(404, [None] + [1.0] * 15, 0), (405, [float("inf")] + [1.0] * 15, 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0)]
    rows += [rows[0], (None, rows[5][1], 0), (None, [1.0] * 3, 0), (408, [x * 5 for x in rows[9][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS cid", "2 AS cell", "3 AS size")
    good = [
        v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows
    ]
    unit = [np.array(v, np.float32).astype(float) if g else None for g, (_, v, _) in zip(good, rows)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = [
        (a, b) for a, b in combinations(range(len(rows)), 2)
        if good[a] and good[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    ]
    low = brute_components(len(rows), links)
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    ids = least_ids([r[0] for r in rows], low)
    want = bag((r[0], int(c), i, r[0] == i) for r, c, i in zip(rows, count, ids))
    for tree_rows in (25, 4096):
        got = cover_tree.near_duplicates(df, tree_rows=tree_rows)
        assert bag(tuple(r) for r in got.collect()) == want
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim, noise", [(64, 0.02), (8, 0.2), (64, 0.05), (3, 0.5)])
def test_dual_traversal(dim, noise):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(40, dim))
    vectors = (base[rng.integers(0, 40, 700)] + noise * rng.normal(size=(700, dim))).astype(np.float32)
    size = rng.integers(1, 4, 700)

    def tree(a, b):
        return cover_tree._grow(
            pa.table(
                {
                    "cid": pa.array(range(a, b), pa.int64()),
                    "cell": pa.array([0] * (b - a), pa.int64()),
                    "chunk": pa.array([0] * (b - a), pa.int32()),
                    "size": pa.array(size[a:b], pa.int64()),
                    "embedding": pa.array([v.tolist() for v in vectors[a:b]], pa.list_(pa.float32())),
                }
            )
        )

    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    one, two = tree(0, 400), tree(400, 700)
    total, ties = np.zeros(700, int), []
    for a, b in ((one, None), (two, None), (one, two)):
        both = a.append_column("left", pa.array([True] * len(a)))
        if b is not None:
            both = pa.concat_tables([both, b.append_column("left", pa.array([False] * len(b)))])
        for r in cover_tree._meet(both, 0.1**0.5, 0.95).to_pylist():
            total[r["cid"]] += r["links"]
            ties.append((r["cid"], r["root"]))
    assert (total == linked @ size).all()
    assert brute_components(700, ties) == brute_components(700, np.argwhere(linked).tolist())


def hot_vectors(n, dim=64):
    """A third around one centre, about as far from each other as links reach, a third in small clusters, the rest alone."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim))
    x[: n // 3] = rng.normal(size=dim) + 0.22 * rng.normal(size=(n // 3, dim))
    few = rng.normal(size=(n // 15, dim))
    x[n // 3 : 2 * n // 3] = few[rng.integers(0, len(few), 2 * n // 3 - n // 3)] + 0.1 * rng.normal(size=(2 * n // 3 - n // 3, dim))
    return x.astype(np.float32)[rng.permutation(n)]


def linked_pairs(vectors):
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    return linked


def test_vectors_are_sent_once_a_block(spark, monkeypatch):
    """Not once for every tree that can hold a partner."""
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=32) + 0.01 * rng.normal(size=(600, 32))).astype(np.float32)
    keep, rows = Stored.keep, []

    def counted(self, df, *partition):
        table = keep(self, df, *partition)
        if table.columns == ["cid", "links", "root"]:  # a row for each vector that was sent, as all have links
            rows.append(table.count())
        return table

    monkeypatch.setattr(Stored, "keep", counted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = cover_tree.near_duplicates(df, tree_rows=20).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(599, 0)}
    assert rows == [600]


def test_blocks_of_trees_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "LEAST_BLOCK", 40)
    vectors = hot_vectors(400)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, [1.0, i + 1.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = []
    for part, first in ((vectors, 0), (np.array([v for _, v in rows[400:]], np.float32), 1000)):
        linked = linked_pairs(part)
        low = brute_components(len(part), np.argwhere(linked).tolist())
        want += [(first + i, int(n), first + c) for i, (n, c) in enumerate(zip(linked.sum(axis=1), low))]
    got = cover_tree.near_duplicates(df, tree_rows=15, most_cells=20).collect()
    assert bag((r.vec_id, r.n_links, r.component_id) for r in got) == bag(want)


@pytest.mark.parametrize(
    "settings",
    [{}, {"DENSE": 4, "DIRECT": 60}, {"LISTED": 1e3, "CALL": 1e3}, {"SWEPT": 1e3, "DENSE": 30}, {"SWEPT": 1e3, "LISTED": 1e-12}, {"FEW": 64}],
)
def test_traversals_from_any_level(monkeypatch, settings):
    for name, value in {"STRIP": 16, "WIDE": 50, **settings}.items():
        monkeypatch.setattr(cover_tree, name, value)
    vectors = hot_vectors(500)
    size = np.random.default_rng(1).integers(1, 4, 500)

    def trees(a, b, left):
        grown = [
            cover_tree._grow(
                pa.table(
                    {
                        "cid": pa.array(range(c, min(c + 70, b)), pa.int64()),
                        "cell": pa.array([c // 140] * (min(c + 70, b) - c), pa.int64()),
                        "chunk": pa.array([c // 70 % 2] * (min(c + 70, b) - c), pa.int32()),
                        "size": pa.array(size[c : min(c + 70, b)], pa.int64()),
                        "embedding": pa.array(vectors[c : min(c + 70, b)].tolist(), pa.list_(pa.float32())),
                    }
                )
            )
            for c in range(a, b, 70)
        ]
        return pa.concat_tables(grown).append_column("left", pa.array([left] * (b - a)))

    linked = linked_pairs(vectors)
    total, ties = np.zeros(500, int), []
    for table in (trees(0, 280, True), trees(280, 500, True), pa.concat_tables([trees(0, 280, True), trees(280, 500, False)])):
        for r in cover_tree._meet(table, 0.1**0.5, 0.95).to_pylist():
            total[r["cid"]] += r["links"]
            ties.append((r["cid"], r["root"]))
    assert (total == linked @ size).all()
    assert brute_components(500, ties) == brute_components(500, np.argwhere(linked).tolist())
