"""N-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.components import components
from harborline.llm.stored import Stored
from harborline.llm.texts import (
    KEY, NOT_SPACE, blocks, doc_rows, gathered, keyed, mix, rolling, span_codes, text_bytes, word_bounds, word_codes, word_count,
)

NGRAM = 5
PERCENT = 75
MINHASHES = 3  # ways of putting documents into groups at first
GROUP_ROWS = 64  # members of a group in the matrix
QUERY_ROWS = 512  # queries that meet a group in one task
HEAVY = 16  # documents with a token among their first ones from which on it is put last
FREQUENT = 1 << 20  # such tokens, the most frequent ones, whose counts are broadcast
DENSE = 10  # a set's whole tokens are counted if one in so many of its first ones is heavy
BLOCK_BYTES = 1 << 20
SALTS = tuple(int(x) for x in mix(np.arange(101, 101 + MINHASHES, dtype=np.uint64)))


def shingle_sets(block: pa.RecordBatch, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each text's distinct shingles, rising, and the first of each text (one more at the end)."""
    data, starts = text_bytes(block.column("text"))
    begin, end, first = word_bounds(data, starts, NOT_SPACE)
    words = word_codes(data, begin, end, lower=True)
    count = np.diff(first)
    doc = doc_rows(first)
    codes = rolling(words, ngram)
    inside = np.flatnonzero(np.arange(len(codes)) + ngram <= first[1:][doc[: len(codes)]]) if len(codes) else doc[:0]
    short = np.flatnonzero((count > 0) & (count < ngram))
    whole = span_codes(words, first[:-1][short], first[1:][short]) if len(short) else np.zeros(0, np.uint64)
    codes = np.concatenate([codes[inside], whole])
    doc = np.concatenate([doc[inside], short])
    order = np.argsort(codes)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(count) < 65536 else np.int64), kind="stable")]
    codes, doc = codes[order], doc[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    return codes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(count)))])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def _classes(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One code for each set; equal sets have equal codes. 0 for the empty set."""
    return _sums(mix(codes), first)


def least(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n must share with any set it links to."""
    return -(-n * percent // 100)


FIRST = f"doc_id long, n long, class long, {KEY[0]} long, {KEY[1]} long, prefix array<long>, " + ", ".join(
    f"g{i} long" for i in range(MINHASHES)
)


def _first_pass(block: pa.RecordBatch, ngram: int, percent: int) -> pa.RecordBatch:
    """A row a document: class, size, groups, and its first tokens in an order by code alone."""
    codes, first = shingle_sets(block, ngram)
    n = block.num_rows
    size = np.diff(first)
    some = np.flatnonzero(size)
    groups = []
    for salt in SALTS:
        low = np.zeros(n, np.uint64)
        if len(some):
            low[some] = np.minimum.reduceat(mix(codes ^ np.uint64(salt)), first[:-1][some])
        groups.append(pa.array(low.view(np.int64)))
    return pa.record_batch(
        [
            block.column("doc_id"), pa.array(size, pa.int64()), pa.array(_classes(codes, first).view(np.int64)),
            block.column(KEY[0]), block.column(KEY[1]), _prefixes(codes, first, percent, codes[:0], NO_COUNTS), *groups,
        ],
        names=[c.split()[0] for c in FIRST.split(", ")],
    )


NO_COUNTS = np.zeros(0, np.int64)


def _prefixes(codes: np.ndarray, first: np.ndarray, percent: int, token: np.ndarray, seen: np.ndarray) -> pa.Array:
    """The first tokens of each set, heavy ones last: as many as two linked sets cannot both avoid."""
    place = codes >> np.uint64(1)
    if len(token):
        at = np.minimum(np.searchsorted(token, codes), len(token) - 1)
        heavy = token[at] == codes
        count = np.minimum(seen[at[heavy]], (1 << 29) - 1).astype(np.uint64)
        place[heavy] = np.uint64(1 << 63) | (count << np.uint64(34)) | (codes[heavy] >> np.uint64(30))
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.argsort(place)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(size) < 65536 else np.int64), kind="stable")]
    rank = np.arange(len(codes)) - first[:-1][doc]
    taken = np.where(size > 0, size - least(size, percent) + 1, 0)
    keep = rank < taken[doc]
    ends = np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[order][keep].view(np.int64)))


def _prefix_rows(block: pa.RecordBatch, ngram: int, percent: int, token: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    codes, first = shingle_sets(block, ngram)
    return pa.record_batch(
        {
            "class": pa.array(_classes(codes, first).view(np.int64)),
            "prefix": _prefixes(codes, first, percent, token, seen),
        }
    )


def _dense_rows(block: pa.RecordBatch, ngram: int, percent: int, token: np.ndarray) -> pa.RecordBatch:
    """The tokens not yet known as heavy of those sets that have many heavy ones among the first by code."""
    codes, first = shingle_sets(block, ngram)

    def heavy(some: np.ndarray) -> np.ndarray:
        return token[np.minimum(np.searchsorted(token, some), len(token) - 1)] == some

    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    taken = np.where(size > 0, size - least(size, percent) + 1, 0)
    front = np.arange(len(codes)) - first[:-1][doc] < taken[doc]
    known = np.bincount(doc[front][heavy(codes[front])], minlength=len(size))
    dense = (size > 0) & (known * DENSE >= taken)
    inside = np.flatnonzero(dense[doc])
    inside = inside[~heavy(codes[inside])]
    ends = np.cumsum(np.bincount(doc[inside], minlength=len(size))[dense])
    return pa.record_batch(
        {
            "class": pa.array(_classes(codes, first).view(np.int64)[dense]),
            "prefix": pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(codes[inside].view(np.int64))
            ),
        }
    )


def _set_rows(block: pa.RecordBatch, ngram: int) -> pa.RecordBatch:
    codes, first = shingle_sets(block, ngram)
    sets = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), block.num_rows, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(codes)]
    )
    return pa.record_batch({"class": block.column("class"), "tokens": sets.cast(pa.binary())})


def _links(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * 100 >= (len(x) + len(y) - shared) * percent


def _star(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [
            _links(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column("tokens"), batch.column("pivot_tokens"))
        ]
        yield pa.record_batch({"a": batch.column("class"), "b": batch.column("pivot")}).filter(pa.array(good, pa.bool_()))


def _is_core(percent: int) -> Column:
    """Whether a token can be the first one that its set shares with a linked set of at least its own size."""
    return F.expr(f"n - pos >= ({2 * percent} * n + {99 + percent}) div {100 + percent}")


def _near(asks: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Queries that may have their first shared token with a member of the group here.

    From that token on, what is left of either set must hold their overlap, `percent`/(100 + `percent`) of both sizes; the
    smallest member with the token that can link by size needs least. In the smaller one of
    two linked sets that token is a core one, so tokens that are core on neither side are not joined at all: texts
    that have a passage in common and differ in the rest do not meet at the passage.
    """
    smallest = f"greatest(low_n, ({percent} * n + 99) div 100)"
    needed = f"({percent} * (n + {smallest}) + {99 + percent}) div {100 + percent}"
    return (
        asks.join(matrix, "token")
        .where("group != to and (size < to_size or (size = to_size and group < to))")
        .where(f"{smallest} <= least(high_n, (100 * n) div {percent}) and n - pos >= {needed} and left >= {needed}")
        .select("class", "n", "to", "to_part", "least_n", "most_n")
    )


def _qualifying(queries: DataFrame, percent: int) -> DataFrame:
    """Queries that may share enough with a member of the group, by the count of shared prefix tokens.

    Of two sets, one's prefix ends first in the order of tokens; what of it is shared lies in the other's prefix
    too. So their overlap is at most the shared prefix tokens and what that set has behind its
    prefix, and must be `percent`/(100 + `percent`) of both sizes. The bound is loosest at the
    smallest or largest member that can link by size; one is left for rounding.
    """

    def needed(n: str, m: str) -> str:
        both = f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"
        return f"{both} - ({percent} * greatest({n}, {m}) + 99) div 100"

    window = queries.withColumns(
        {
            "low": F.expr(f"greatest(least_n, ({percent} * n + 99) div 100)"),
            "high": F.expr(f"least(most_n, (100 * n) div {percent})"),
        }
    ).where("low <= high")
    return window.where(F.expr(f"shared >= least({needed('n', 'low')}, {needed('n', 'high')})"))


def _open_group(queries: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """Queries that link to a member of the group: the bound first, then the members' sets."""
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in members.column("member_tokens")]
    names = members.column("member").to_pylist()
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], np.repeat(np.arange(len(sets)), sizes)[order]
    head = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1)) != 0)
    union, head = tokens[head], np.append(head, len(tokens))
    a, b = [], []
    for name, packed in zip(queries.column("class").to_pylist(), queries.column("tokens")):
        query = np.frombuffer(packed.as_py(), np.uint64)
        at = np.minimum(np.searchsorted(union, query), len(union) - 1)
        at = at[union[at] == query]
        if len(at) * 100 < len(query) * percent:
            continue  # not even all members together share enough with it
        count = head[at + 1] - head[at]
        places = np.repeat(head[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        shared = np.bincount(member[places], minlength=len(sets))
        linked = np.flatnonzero(shared * 100 >= (sizes + len(query) - shared) * percent)
        if len(linked):  # the group is connected, so one link is as good as all
            a.append(name)
            b.append(names[linked[0]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _light_prefixes(
    rows: DataFrame, lists: DataFrame, stored: Stored, ngram: int, percent: int
) -> tuple[DataFrame, ...]:
    """(class, prefix) of all documents with heavy tokens last, those of their tokens (hit) that two classes have, and
    the written tables of both.

    Tokens are counted in all prefixes. Those that more than `HEAVY` documents have move to the end of
    the order, by their counts. What then comes forward is as frequent wherever documents are much alike, so of
    sets with many heavy tokens in their prefixes all other tokens are counted too, and the frequent ones
    move as well. So a set's own tokens stand first, and texts that are like a large group but link to none
    of it have hardly a token of the group in their prefixes. Any one order gives the same links; this one only
    keeps few documents together at a token.
    """
    spark = rows.sparkSession

    def counted(some: DataFrame) -> DataFrame:
        tokens = some.select(F.explode("prefix").alias("token"), "class").groupBy("token")
        count = tokens.agg(F.count("*").alias("seen"), F.min("class").alias("low"), F.max("class").alias("high"))
        return stored.keep(count.where("low != high").select(F.col("token").alias("hit"), "seen"))

    def frequent(hits: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = hits.where(F.col("seen") > HEAVY).orderBy(F.desc("seen"), "hit").limit(FREQUENT).toArrow()
        codes, counts = found.column("hit").to_numpy().view(np.uint64), found.column("seen").to_numpy()
        order = np.argsort(codes)
        return codes[order], counts[order]

    hits = counted(lists)
    token, seen = frequent(hits)
    if not len(token):
        return lists, hits.select("hit"), hits
    stored.drop(hits)
    first = spark.sparkContext.broadcast(token)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, BLOCK_BYTES):
            yield _dense_rows(block, ngram, percent, first.value)

    whole = stored.keep(rows.select("text").mapInArrow(dense, "class long, prefix array<long>"))
    hits = counted(whole)
    more, seen_more = frequent(hits)
    stored.drop(whole, hits)
    token, seen = np.concatenate([token, more]), np.concatenate([seen, seen_more])
    most = np.argsort(-seen, kind="stable")[:FREQUENT]
    order = most[np.argsort(token[most])]
    shared = spark.sparkContext.broadcast((token[order], seen[order]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, BLOCK_BYTES):
            yield _prefix_rows(block, ngram, percent, *shared.value)

    lists = stored.keep(rows.select("text").mapInArrow(prefixes, "class long, prefix array<long>"))
    hits = counted(lists)
    return lists, hits.select("hit"), hits, lists


def jaccard_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable), its group and its key.

    A document's set is its distinct word shingles; two link if they share `percent` % of their union.
    Documents with equal sets are one class. Any two linked sets share a token among the first
    n - ceil(percent % of n) + 1 of each in one order of all tokens, here heavy ones last; only these
    tokens are shuffled, and only classes that share one go on. Which tokens are heavy is
    counted over all prefixes (see `_light_prefixes`), and matters for speed alone.

    Classes with equal min-hashes are put together and compared with one of them each, the one with fewest prefix tokens of
    its own; what links is a first partition into groups of similar documents. Then the matrix: the prefix tokens of each group (at most
    `GROUP_ROWS` members; larger ones in parts) against queries from other, smaller groups. Where the first shared
    one stands (see `_near`) and the number of shared ones (see `_qualifying`) bound the overlap. Of the groups left the whole token
    union is made: a query that shares less than `percent` % of its own tokens with all members
    together is dropped. Qualifying groups are opened and their sets compared. All pairs of
    different groups that can link are met in one of the two directions, so no link between groups is lost;
    links within a group need no further look, as it is connected. A group with very many queries meets them in several tasks.

    Fewer words than `ngram`: the whole sequence is one shingle. Null text or no words: 0 shingles, no links,
    component is the own id. Repeated rows are copies; null ids link but name no component unless
    all are null. An empty table gives no rows; further columns are not looked at. Shingles and
    sets are told apart by 64-bit codes.
    """
    stored = Stored(docs.sparkSession, "jaccard")
    rows = keyed(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *KEY
    )

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, BLOCK_BYTES):
            yield _first_pass(block, ngram, percent)

    first = stored.keep(rows.mapInArrow(first_pass, FIRST))
    named = first.drop("prefix")
    lists, hits, *written = _light_prefixes(rows, first.select("class", "prefix"), stored, ngram, percent)
    prefix = lists.select(F.posexplode("prefix").alias("pos", "token"), "class").join(hits, F.col("token") == F.col("hit"))
    prefix = stored.keep(prefix.drop("hit").distinct())
    stored.drop(*written)

    # The classes that share a token, how many of their first tokens no other has, and one document of each.
    active = prefix.groupBy(F.col("class").alias("active")).agg(F.count("*").alias("hits"))
    example = named.where("n > 0").groupBy("class", "n", *[f"g{i}" for i in range(MINHASHES)]).agg(
        F.min(F.struct(*KEY)).alias("example")
    )
    example = stored.keep(example.join(active, F.col("class") == F.col("active")).drop("active"))
    alone = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - hits")

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            yield _set_rows(block, ngram)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(class, tokens) of the classes in `wanted` (class), from the text of one document each."""
        chosen = example.join(wanted.distinct(), "class").select(
            "class", F.col(f"example.{KEY[0]}").alias("_e1"), F.col(f"example.{KEY[1]}").alias("_e2")
        )
        same = (F.col(KEY[0]) == F.col("_e1")) & (F.col(KEY[1]) == F.col("_e2"))
        texts = rows.select("text", *KEY).join(chosen.hint("shuffle_hash"), same)
        sets = texts.select("class", "text").mapInArrow(make_sets, "class long, tokens binary")
        return stored.keep(sets.groupBy("class").agg(F.first("tokens").alias("tokens")))

    # First partition: each class against that one of those with the same min-hash that has least of its own. Among
    # near copies this is one with few edits, to which most others link; a much edited one would leave them apart.
    grouped = example.select(
        "class", alone.alias("alone"), F.explode(F.array(*[F.struct(F.lit(i).alias("by"), F.col(f"g{i}").alias("group")) for i in range(MINHASHES)])).alias("at")
    ).select("class", "alone", "at.by", "at.group")
    pivots = grouped.groupBy("by", "group").agg(F.min(F.struct("alone", "class")).alias("least"), F.count("*").alias("n"))
    pivots = pivots.where("n > 1").select("by", "group", F.col("least.class").alias("pivot"))
    pairs = grouped.join(pivots, ["by", "group"]).where("class != pivot").select("class", "pivot").distinct()
    pairs = stored.keep(pairs)
    sets = sets_of(pairs.select("class").unionAll(pairs.select(F.col("pivot").alias("class"))))
    pivot_sets = sets.select(F.col("class").alias("pivot"), F.col("tokens").alias("pivot_tokens"))
    stars = pairs.join(sets, "class").join(pivot_sets, "pivot").mapInArrow(
        lambda batches: _star(batches, percent), "a long, b long"
    )
    stars = stored.keep(stars)
    stored.drop(sets, pairs)
    groups = example.select("class", "n").join(
        components(stars, stored), F.col("class") == F.col("node"), "left"
    ).select("class", "n", F.coalesce("root", "class").alias("group"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    groups = groups.join(sizes, "group").withColumn(
        "part", F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / GROUP_ROWS)).cast("int")
    )
    groups = stored.keep(groups)
    parts = groups.groupBy("group", "part").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    groups = stored.keep(groups.join(parts, ["group", "part"]))

    # The matrix of tokens and groups, for tokens that more than one group has.
    marked = stored.keep(prefix.join(groups, "class"))
    between = marked.groupBy("token").agg(
        F.min("group").alias("low"), F.max("group").alias("high"), F.max(F.struct("size", "group")).alias("largest")
    )
    between = stored.keep(between.where("low != high").select("token", "largest"))
    marked = stored.keep(marked.join(between, "token"))
    matrix = marked.groupBy(
        "token", F.col("group").alias("to"), F.col("size").alias("to_size"), F.col("part").alias("to_part"), "least_n", "most_n"
    ).agg(
        F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.max(F.expr("n - pos")).alias("left"),
        F.bool_or(_is_core(percent)).alias("has_core"),
    )
    # Smaller groups ask larger ones, so members of a token's largest group ask nobody.
    asks = marked.where("group != largest.group").select("token", "pos", "class", "group", "size", "n")
    core = _is_core(percent)
    near = _near(asks.where(core), matrix, percent).unionAll(_near(asks.where(~core), matrix.where("has_core"), percent))
    near = stored.keep(near.distinct())
    # One row a candidate, beside the tokens of both as arrays: those of the query, and the union of the part's members.
    asking, asked_parts = near.select("class").distinct(), near.select("to", "to_part").distinct()
    own = asks.select("class", "token").join(asking, "class", "left_semi")
    own = own.groupBy("class").agg(F.collect_list("token").alias("own"))
    union = marked.select("token", F.col("group").alias("to"), F.col("part").alias("to_part"))
    union = union.join(asked_parts, ["to", "to_part"], "left_semi")
    union = union.groupBy("to", "to_part").agg(F.collect_set("token").alias("union"))
    queries = near.join(own, "class").join(union, ["to", "to_part"])
    queries = queries.withColumn("shared", F.size(F.array_intersect("own", "union"))).drop("own", "union")
    queries = stored.keep(_qualifying(queries, percent).select("class", "to", "to_part"))
    stored.drop(prefix, marked, between, near)
    asked_members = groups.join(
        queries.select(F.col("to").alias("group"), F.col("to_part").alias("part")).distinct(), ["group", "part"]
    )
    sets = sets_of(queries.select("class").unionAll(asked_members.select("class")))
    load = queries.groupBy("to", "to_part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("tasks"))
    load = stored.keep(load)
    asked = queries.join(load, ["to", "to_part"]).withColumn("task", F.pmod(F.xxhash64("class"), F.col("tasks")).cast("int"))
    asked = asked.drop("tasks").join(sets, "class")
    members = groups.select(F.col("class").alias("member"), F.col("group").alias("to"), F.col("part").alias("to_part"))
    members = members.join(load, ["to", "to_part"]).select(
        "member", "to", "to_part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")
    )
    member_sets = sets.select(F.col("class").alias("member"), F.col("tokens").alias("member_tokens"))
    members = members.join(member_sets, "member")
    opened = asked.groupBy("to", "to_part", "task").cogroup(members.groupBy("to", "to_part", "task")).applyInArrow(
        lambda q, m: _open_group(q, m, percent), "a long, b long"
    )
    opened = stored.keep(opened)
    stored.drop(sets, queries, load)

    roots = stored.keep(components(stars.unionAll(opened), stored))
    lows = named.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("low"))
    lows = lows.join(roots, F.col("class") == F.col("node"), "left")
    lows = stored.keep(lows.select("class", "low", F.coalesce("root", "class").alias("root")))
    best = lows.groupBy("root").agg(F.min("low").alias("component"))
    best = lows.join(best, "root").select(F.col("class").alias("_class"), F.col("root").alias("group"), "component")
    out = named.join(best, (F.col("class") == F.col("_class")) & (F.col("n") > 0), "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("group", "class")).alias("group"),
        *KEY,
    )


def keep_one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each group of linked documents: the least id, rows without one last.

    Of rows that are equal in id and text one stays. Texts without words are linked with nothing, so all stay.
    """
    members = jaccard_components(docs, ngram, percent).where(F.col("group").isNotNull())
    least = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), *KEY)).alias("least"))
    least = least.select(F.col(f"least.{KEY[0]}").alias("_least_id"), F.col(f"least.{KEY[1]}").alias("_least_text"))
    rows = keyed(docs, "doc_id", *[c for c in docs.columns if c != "doc_id"])
    alone = word_count(F.col("text")) == 0
    rows = rows.withColumn("_alone", F.when(alone, F.monotonically_increasing_id()).otherwise(-1))
    kept = rows.join(
        least.hint("shuffle_hash"),
        (F.col(KEY[0]) == F.col("_least_id")) & (F.col(KEY[1]) == F.col("_least_text")),
        "left",
    ).where("_alone >= 0 or _least_id is not null")
    return kept.dropDuplicates([*KEY, "_alone"]).select(*docs.columns)
