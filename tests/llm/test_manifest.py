import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.llm import merkle, midstates

from .edge import bag, documents


def joined(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    fields = [doc_id, source, lang, n_chars, text]
    return joined("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)


def levels_of(level):
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([joined(below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def climb(levels, place, new):
    beside = []
    for level in levels[:-1]:
        first = place // 3 * 3
        run = level[first : first + 3]
        beside += run[: place - first] + run[place - first + 1 :]
        new = joined([*run[: place - first], new, *run[place - first + 1 :]])
        place //= 3
    return beside, new


def brute(rows):
    by_source = {}
    for row in rows:
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        new = row[1].replace("\n", "") if even and row[1] is not None else row[1]
        by_source.setdefault(row[3], []).append((row[0], leaf(row, row[1]), leaf(row, new)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in by_source.values():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [levels_of([x[1] for x in by_source[s]]) for s in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, source in enumerate(order):
        for place, (doc_id, old, new) in enumerate(by_source[source]):
            low, folded = climb(trees[k], place, new)
            high, folded = climb(top, k, folded)
            out.append((doc_id, old, trees[k][-1][0], top[-1][0], joined(low + high), folded, folded == top[-1][0]))
    return bag(out)


def test_states_go_on_like_hashlib():
    rng = np.random.default_rng(3)
    digests = [rng.integers(0, 2**32, (8, 7), dtype=np.uint32) for _ in range(3)]
    state = np.repeat(midstates.START, 7, axis=1)
    for n, digest in enumerate(digests, 1):
        state = midstates.compress(state, midstates.hex_block(digest))
        done = midstates.to_bytes(midstates.compress(state, midstates.last_block(n)))
        for i in range(7):
            text = "".join(midstates.to_bytes(d[:, i : i + 1]).hex() for d in digests[:n])
            assert done[32 * i : 32 * i + 32] == hashlib.sha256(text.encode()).digest()


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_like_brute_force(spark, levels):
    # Few levels a block: trees of many blocks, and more than two rounds of them.
    df, rows = documents(spark, clashing=True)
    got = merkle.verify_documents(df, merkle.without_newlines(df), levels)
    assert bag(tuple(r) for r in got.collect()) == brute(rows)


def test_one_document_and_none(spark):
    df, rows = documents(spark)
    one = df.where("doc_id = 4").limit(1)
    got = merkle.verify_documents(one, merkle.without_newlines(one)).collect()
    assert bag(tuple(r) for r in got) == brute([r for r in rows if r[0] == 4][:1])
    assert got[0].leaf == got[0].root and got[0].proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.verify_documents(df.limit(0), F.lit(None).cast("string")).count() == 0


def test_any_change_shows_and_no_change_does_not(spark):
    df, _ = documents(spark)
    df = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    same = merkle.verify_documents(df, F.lit(None).cast("string"))
    assert same.where("not verified or folded_root <> root").count() == 0
    changed = merkle.verify_documents(df, F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("."))))
    assert {r.doc_id % 3 == 0 for r in changed.where("not verified").collect()} == {True}
    assert changed.where("verified and doc_id % 3 = 0").count() == 0


def test_kept_states_are_what_the_fold_starts_from(spark):
    """With a state of the manifest changed, leaves to the right of it no longer give the root."""
    df, _ = documents(spark)
    leaves, blocks = merkle.build_manifest(df)
    spoilt = blocks.withColumn("states", F.expr("cast(repeat('x', octet_length(states)) as binary)"))
    assert merkle.fold_manifest(leaves, blocks).where("not verified").count() == 0
    assert merkle.fold_manifest(leaves, spoilt.where("octet_length(states) > 0")).where("verified").count() == 0
