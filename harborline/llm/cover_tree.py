"""Embedding near-dedup: exact pairs above a cosine by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.components import components
from harborline.llm.stored import Stored
from harborline.session import local_table

COSINE = 0.95
RADII = (1.0, 0.5, 0.25)  # halving; the level above holds all of a tree, up to 2 apart
TREE_ROWS = 4096  # vectors of one tree
MOST_CELLS = 256
BLOCK_ROWS = 49_152  # vectors of 64 components in the trees that one task holds of each side; longer ones fewer
BLOCKS = 8  # for tasks enough, where vectors are few
LEAST_BLOCK = 1024
STRIP, WIDE = 256, 2048  # nodes multiplied with nodes at once
SLACK = 1e-7  # of distances; pairs that near a bound are looked at one by one
DIRECT = 200_000  # pairs of nodes compared at once
DENSE = 4096  # children of two nodes that are multiplied rather than listed
FEW = 16  # directions of a first bound on cosines
SAMPLE = 128  # nodes that tell what each level leaves over
SWEPT, LISTED, CALL = 3e-9, 7e-7, 5e-5  # seconds: a pair multiplied in 64 components, a pair listed, a call


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as lists or as bytes, as rows of unit length in double precision."""
    if pa.types.is_binary(column.type):
        raw = column.buffers()
        offsets = np.frombuffer(raw[1], np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(raw[2], np.float32, (offsets[-1] - offsets[0]) // 4, offsets[0]).astype(np.float64)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


def _packed(column: pa.Array) -> pa.Array:
    """Vectors of one length as bytes."""
    flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.float32)
    ends = np.arange(len(column) + 1, dtype=np.int64) * (flat.nbytes // max(len(column), 1))
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _net(vectors: np.ndarray, parent: np.ndarray, radius: float) -> np.ndarray:
    """For each vector a centre among those before it, some `radius` off and under the same parent, or itself."""
    least = 1 - radius * radius / 2
    centre = np.arange(len(vectors))
    some = np.flatnonzero(np.bincount(parent, minlength=len(vectors))[parent] > 1)
    vectors, parent = vectors[some], parent[some]
    found = np.full(len(some), -1)
    centres = np.zeros(0, np.int64)
    for a in range(0, len(some), 256):
        part = np.arange(a, min(a + 256, len(some)))
        if len(centres):
            near = vectors[part] @ vectors[centres].T
            near[parent[part][:, None] != parent[centres][None, :]] = -2
            best = near.argmax(axis=1)
            good = near[np.arange(len(part)), best] >= least
            found[part[good]] = centres[best[good]]
        left = part[found[part] < 0]
        inner = vectors[left] @ vectors[left].T
        inner[parent[left][:, None] != parent[left][None, :]] = -2
        taken = np.zeros(len(left), bool)
        new = []
        for i in range(len(left)):
            if not taken[i]:
                new.append(left[i])
                mine = (inner[i] >= least) & ~taken
                mine[:i] = False
                mine[i] = True
                found[left[mine]] = left[i]
                taken |= mine
        centres = np.concatenate([centres, np.array(new, np.int64)])
    centre[some] = some[found]
    return centre


LEVELS = ", ".join(f"c{i} int, r{i} double" for i in range(len(RADII)))
TREE = f"cid long, cell long, chunk int, place int, size long, embedding binary, {LEVELS}"


def _grow(table: pa.Table) -> pa.Table:
    """The cover tree of one chunk: per vector its centre on each level and that centre's covering radius."""
    embedding = table.column("embedding").combine_chunks()
    vectors = _units(embedding)
    rough = vectors.astype(np.float32)  # near enough to choose centres; radii are exact
    n = len(vectors)
    parent = np.zeros(n, np.int64)
    columns = {}
    for i, radius in enumerate(RADII):
        parent = _net(rough, parent, radius)
        far = _distance(np.einsum("ij,ij->i", vectors, vectors[parent]))
        far[parent == np.arange(n)] = 0
        cover = np.zeros(n)
        np.maximum.at(cover, parent, far)
        columns[f"c{i}"] = pa.array(parent, pa.int32())
        columns[f"r{i}"] = pa.array(cover[parent])
    return pa.table(
        {
            "cid": table.column("cid"),
            "cell": table.column("cell"),
            "chunk": table.column("chunk"),
            "place": pa.array(np.arange(n), pa.int32()),
            "size": table.column("size"),
            "embedding": _packed(embedding),
            **columns,
        }
    )


class _Trees:
    """The trees of one side of a task, as one: places of the later trees follow those of the earlier."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("cell", "ascending"), ("chunk", "ascending"), ("place", "ascending")]).combine_chunks()
        self.cid = table.column("cid").to_numpy()
        self.size = table.column("size").to_numpy()
        self.vectors = _units(table.column("embedding").combine_chunks())
        n = len(self.cid)
        shift = np.arange(n) - table.column("place").to_numpy()
        # Nodes of each level as places of their centres; the last level is the vectors themselves.
        self.centre = [table.column(f"c{i}").to_numpy() + shift for i in range(len(RADII))] + [np.arange(n)]
        self.radius = [table.column(f"r{i}").to_numpy() for i in range(len(RADII))] + [np.zeros(n)]
        self.nodes = [np.unique(c) for c in self.centre]
        self.weight = [np.bincount(c, self.size, n) for c in self.centre]
        self.members = [np.bincount(c, minlength=n) for c in self.centre]
        self.children, self.first = [], []  # of a level's nodes, on the next level
        for level in range(len(RADII)):
            below = self.nodes[level + 1]
            above = self.centre[level][below]
            order = np.argsort(above, kind="stable")
            self.children.append(below[order])
            self.first.append(np.searchsorted(above[order], np.arange(n + 1)))
        self.links = [np.zeros(n) for _ in self.centre]  # by node: weight linked to all of the node
        self.own = [np.zeros(n, bool) for _ in self.centre]  # nodes linked to themselves as a whole

    def total(self) -> np.ndarray:
        return sum(links[centre] for links, centre in zip(self.links, self.centre))

    def of_itself(self) -> np.ndarray:
        """Weight that a vector was given for itself, where a node was linked to itself as a whole."""
        return self.size * np.any([own[centre] for own, centre in zip(self.own, self.centre)], axis=0)

    def below(self, level: int, node: int) -> np.ndarray:
        return self.children[level][self.first[level][node] : self.first[level][node + 1]]


def _directions(a: _Trees, b: _Trees) -> np.ndarray | None:
    """Orthonormal columns along which the vectors of both sides are longest; None where they are few anyway."""
    if a.vectors.shape[1] < 2 * FEW:
        return None
    some = np.concatenate([v[:: len(v) // 4096 + 1] for v in (a.vectors, b.vectors)])
    return np.linalg.eigh(some.T @ some)[1][:, -FEW:]


class _Bound:
    """A bound from above on the cosine that members of two nodes can have, less what is asked for, as one product.

    For nodes u and v with covering radii p and q, members are near enough only if u and v are at most epsilon + p + q
    apart: u.v + pq + f(p) + f(q) >= 1 - epsilon^2 / 2 with f(p) = p^2 / 2 + p epsilon. With few
    directions, u.v is at most the product along them and that of the lengths of the rests. Single precision, with a margin.
    """

    def __init__(self, a: _Trees, b: _Trees, epsilon: float, directions: np.ndarray | None):
        self.epsilon, self.whole = epsilon, directions is None
        self.rows = [self._parts(t.vectors, directions) for t in (a, b)]
        self.margin = 2.0**-20 * (self.rows[0].shape[1] + 16)
        self.least = 1 - epsilon * epsilon / 2 - self.margin

    @staticmethod
    def _parts(vectors: np.ndarray, directions: np.ndarray | None) -> np.ndarray:
        if directions is None:
            return vectors.astype(np.float32)
        along = vectors @ directions
        rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", along, along), 0) + 1e-14)
        return np.concatenate([along, rest[:, None]], axis=1).astype(np.float32)

    def sides(self, x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = self.rows[0][x], self.rows[1][y]
        if p.any() or q.any():
            grow = [r * r / 2 + r * self.epsilon for r in (p, q)]
            u = np.column_stack([u, p, grow[0], np.ones(len(p))]).astype(np.float32)
            v = np.column_stack([v, q, np.ones(len(q)), grow[1]]).astype(np.float32)
        return u, v

    @property
    def cost(self) -> float:
        return SWEPT * max(self.rows[0].shape[1], 24) / 64


def _match(a: _Trees, b: _Trees, epsilon: float, cosine: float):
    """Dual traversal; adds to the trees' links and yields pairs of places to tie together.

    All nodes of one level meet in products; pairs left over go down level by level. A pair is dropped if its centres are
    further apart than the threshold and both covering radii; it is linked as a whole if even its furthest members are
    near enough; else its children meet. Vectors at the end are compared by their exact cosine, unless their product in
    single precision is further from the threshold than its error. A sample of nodes tells on which level to begin, and whether few
    directions do for that: with clusters a level of few nodes, without any the vectors themselves.
    """
    same, last = a is b, len(RADII)
    full = _Bound(a, b, epsilon, None)
    directions = _directions(a, b)
    bounds = [full] if directions is None else [full, _Bound(a, b, epsilon, directions)]

    def linked(x: np.ndarray, y: np.ndarray):
        a.links[last] += np.bincount(x, b.size[y], len(a.cid))
        if not same:
            b.links[last] += np.bincount(y, a.size[x], len(b.cid))
        return last, x, y

    def sweep(level: int, nodes_a: np.ndarray, nodes_b: np.ndarray, bound: _Bound):
        """All nodes of one side with all of the other."""
        u, v = bound.sides(nodes_a, a.radius[level][nodes_a], nodes_b, b.radius[level][nodes_b])
        v = np.ascontiguousarray(v.T)
        exact = level == last and bound.whole
        held, waiting = [], 0

        def ahead():
            x, y = (np.concatenate(c) for c in zip(*held))
            for k in range(0, len(x), DIRECT):
                yield from down(level, x[k : k + DIRECT], y[k : k + DIRECT])

        for i in range(0, len(u), STRIP):
            for j in range(0, v.shape[1], WIDE):
                product = u[i : i + STRIP] @ v[:, j : j + WIDE]
                some = np.flatnonzero(product.max(axis=1) >= bound.least)  # most often few rows, and faster so
                if not len(some):
                    continue
                product = product[some]
                at = np.flatnonzero(product >= bound.least)
                value = product.ravel()[at]
                x, y = np.divmod(at, product.shape[1])
                x, y = nodes_a[some[x] + i], nodes_b[y + j]
                if exact:
                    sure = value >= cosine + bound.margin
                    off = sure & ((x != y) | (not same))
                    yield linked(x[off], y[off])
                    x, y = x[~sure], y[~sure]
                held.append((x, y))
                waiting += len(x)
                if waiting >= DIRECT:
                    yield from ahead()
                    held, waiting = [], 0
        if held:
            yield from ahead()

    def down(level: int, x: np.ndarray, y: np.ndarray):
        near = np.einsum("ij,ij->i", a.vectors[x], b.vectors[y])
        if level == last:
            good = (near >= cosine) & ((x != y) | (not same))
            yield linked(x[good], y[good])
            return
        far, reach = _distance(near), a.radius[level][x] + b.radius[level][y]
        if same:
            far[x == y] = 0
        whole = far + reach <= epsilon - SLACK
        keep = ~whole & (far - reach <= epsilon + SLACK)
        u, v = x[whole], y[whole]
        if len(u):
            a.links[level] += np.bincount(u, b.weight[level][v], len(a.cid))
            if same:
                a.own[level][u[u == v]] = True
            else:
                b.links[level] += np.bincount(v, a.weight[level][u], len(b.cid))
            yield level, u, v
        x, y = x[keep], y[keep]
        if not len(x):
            return
        first_a, first_b = a.first[level], b.first[level]
        wide = first_b[y + 1] - first_b[y]
        product = (first_a[x + 1] - first_a[x]) * wide
        many = product >= DENSE
        for one, two in zip(x[many].tolist(), y[many].tolist()):
            yield from sweep(level + 1, a.below(level, one), b.below(level, two), full)
        x, y, wide, product = x[~many], y[~many], wide[~many], product[~many]
        ends = np.cumsum(product)
        for at in range(0, int(ends[-1]) if len(ends) else 0, DIRECT):
            k = np.arange(at, min(at + DIRECT, int(ends[-1])))
            pair = np.searchsorted(ends, k, "right")
            k -= (ends - product)[pair]
            yield from down(
                level + 1,
                a.children[level][first_a[x[pair]] + k // wide[pair]],
                b.children[level][first_b[y[pair]] + k % wide[pair]],
            )

    def seconds(level: int, bound: _Bound) -> float:
        """What it takes to begin there, by a sample of the nodes."""
        nodes_a, nodes_b = a.nodes[level], b.nodes[level]
        some = nodes_a[:: len(nodes_a) // SAMPLE + 1]
        u, v = bound.sides(some, a.radius[level][some], nodes_b, b.radius[level][nodes_b])
        left = 0.0
        for j in range(0, len(v), WIDE):
            x, y = np.nonzero(u @ v[j : j + WIDE].T >= bound.least)
            pairs = a.members[level][some[x]] * b.members[level][nodes_b[y + j]]
            left += LISTED * len(x) + np.minimum(LISTED * pairs, CALL + SWEPT * pairs).sum()
        return len(nodes_a) * (len(nodes_b) * bound.cost + left / len(some))

    _, level, i = min((seconds(level, bound), level, i) for level in range(last + 1) for i, bound in enumerate(bounds))
    yield from sweep(level, a.nodes[level], b.nodes[level], bounds[i])


def _root(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    root = label[x]
    while (label[root] != root).any():
        root = label[root]
    return root


def _tie(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of each x and y; labels lead to the least member."""
    while True:
        one, two = _root(label, x), _root(label, y)
        apart = one != two
        if not apart.any():
            return
        label[x], label[y] = one, two
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])


def _meet(table: pa.Table, epsilon: float, cosine: float) -> pa.Table:
    """Links between the trees of the two sides of one group, or within its one side."""
    left = table.column("left").to_numpy()
    a = _Trees(table.filter(pa.array(left)))
    same = left.all()
    b = a if same else _Trees(table.filter(pa.array(~left)))
    n = len(a.cid)
    cid = a.cid if same else np.concatenate([a.cid, b.cid])
    label = np.arange(len(cid))
    shift = 0 if same else n
    for level, u, v in _match(a, b, epsilon, cosine):
        _tie(label, u, v + shift)
        if level < len(RADII):  # members hang on their centres
            for tree, nodes, add in ((a, u, 0), (b, v, shift)):
                inside = np.flatnonzero(np.isin(tree.centre[level], nodes))
                _tie(label, inside + add, tree.centre[level][inside] + add)
    label = _root(label, np.arange(len(cid)))
    links = a.total()
    if same:
        links = links - a.of_itself()
    else:
        links = np.concatenate([links, b.total()])
    some = links > 0
    return pa.table(
        {
            "cid": pa.array(cid[some], pa.int64()),
            "links": pa.array(np.rint(links[some]).astype(np.int64)),
            "root": pa.array(cid[label[some]], pa.int64()),
        }
    )


def _cells(classes: DataFrame, stored: Stored, tree_rows: int, most_cells: int):
    """Classes with the nearest of a bounded number of centres, and which cells can hold pairs."""
    count = classes.count()
    wanted = int(min(most_cells, max(1, math.ceil(count / tree_rows))))
    rows = classes.orderBy("h1", "h2").limit(wanted).select("embedding").collect()
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(len(row[0]), []).append(row[0])
    centres = {d: _units(pa.array(v, pa.list_(pa.float32()))) for d, v in by_length.items()}
    first = {}
    for d in sorted(centres):
        first[d] = sum(len(centres[e]) for e in first)
    total = sum(map(len, centres.values()))
    shared = classes.sparkSession.sparkContext.broadcast((centres, first, total))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first, total = shared.value
        for batch in batches:
            column = batch.column("embedding")
            length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            cell, far = np.zeros(len(length), np.int64), np.full(len(length), 2.0)
            for d in np.unique(length).tolist():
                rows = np.flatnonzero(length == d)
                if d not in centres:
                    cell[rows] = total + d  # all vectors of that length
                    continue
                near = _units(column.take(pa.array(rows))) @ centres[d].T
                cell[rows] = first[d] + near.argmax(axis=1)
                far[rows] = _distance(near.max(axis=1))
            yield pa.record_batch(
                {
                    "cid": batch.column("cid"), "size": batch.column("size"), "embedding": column,
                    "cell": pa.array(cell), "far": pa.array(far),
                }
            )

    placed = stored.keep(classes.select("cid", "size", "embedding").mapInArrow(
        assign, "cid long, size long, embedding array<float>, cell long, far double"
    ))
    # One row a cell: at most `most_cells`, and one more for each vector length without a centre.
    cells = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    return placed, cells, centres, first, total


def _blocks(cells: dict, chunks: dict, centres: dict, first: dict, total: int, epsilon: float):
    """Trees as (cell, chunk, block), and pairs of blocks that can hold links: a block has trees of one length of vectors."""
    of_length: dict[int, list] = {}
    for d, found in centres.items():
        mine = [i for i in range(len(found)) if first[d] + i in cells]
        order = mine[:1]  # each cell after the one nearest to it, so that fewer blocks can meet
        rest = set(mine[1:])
        while rest:
            near = found @ found[order[-1]]
            order.append(max(rest, key=lambda i: near[i]))
            rest.remove(order[-1])
        of_length[d] = [first[d] + i for i in order]
    for c in cells:
        if c >= total:
            of_length[c - total] = [c]
    trees, pairs, blocks = [], [], 0
    for d, mine in of_length.items():
        rows = sum(cells[c][0] for c in mine)
        most = min(BLOCK_ROWS, max(1, BLOCK_ROWS * 64 // d), max(LEAST_BLOCK, math.ceil(rows / BLOCKS)))
        inside, held = [set()], 0.0
        for c in mine:
            for chunk in range(chunks[c]):
                tree = cells[c][0] / chunks[c]
                if inside[-1] and held + tree / 2 > most:
                    inside.append(set())
                    held = 0.0
                trees.append((c, chunk, blocks + len(inside) - 1))
                inside[-1].add(c)
                held += tree
        far = np.array([cells[c][1] for c in mine])
        if d in centres:
            found = centres[d][[c - first[d] for c in mine]]
            meet = _distance(found @ found.T) <= epsilon + far[:, None] + far[None, :] + SLACK
        else:
            meet = np.ones((1, 1), bool)
        places = [np.array([i for i, c in enumerate(mine) if c in cells_]) for cells_ in inside]
        for i, one in enumerate(places):
            for j in range(i, len(places)):
                if i == j or meet[np.ix_(one, places[j])].any():
                    pairs.append((blocks + i, blocks + j))
        blocks += len(inside)
    return trees, pairs


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, tree_rows: int = TREE_ROWS, most_cells: int = MOST_CELLS
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (least vec_id reachable), kept.

    Two vectors link if their cosine in double precision is at least `cosine`. Equal vectors are one
    class, which counts by its size and is never expanded into pairs. Classes go to the nearest of a
    bounded number of centres; cells are cut into chunks of about `tree_rows`, and each chunk grows
    a cover tree with halving radii. Trees of cells next to each other are held in blocks of bounded size. Pairs of blocks
    whose cells are all too far apart for their covering radii never meet; the others' trees do, each pair of blocks in a
    task of its own, by dual traversal. So a vector is sent once for every block and not for every tree. A task returns one
    row a vector with links: its linked weight and a local root; sums and components are grouped over these.
    All pairs above the threshold are found. How much is pruned depends on the data: where vectors
    have no clusters, distances of many dimensions are so alike that most centres must meet.

    Vectors that are null or of length zero, hold null or non-finite components, or only zeros have
    no links, nor do vectors of different lengths link. Rows with a null vec_id link, but name
    no component unless all its ids are null. Repeated rows are copies. An empty table gives no rows.
    """
    stored = Stored(vectors.sparkSession, "cover")
    epsilon = math.sqrt(2 - 2 * cosine)
    value = F.col("embedding").cast("array<float>")
    usable = F.coalesce(
        value.isNotNull()
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"), usable.alias("usable"))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit("other"), "embedding"))
    classes = rows.where("usable").groupBy("h1", "h2").agg(
        F.count("*").alias("size"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding")
    )
    classes = stored.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    placed, cells, centres, first, total = _cells(classes, stored, tree_rows, most_cells)
    chunks = {c: math.ceil(n / tree_rows) for c, (n, _) in cells.items()}
    spark = vectors.sparkSession

    trees, pairs = _blocks(cells, chunks, centres, first, total, epsilon)
    meeting = [(i, i, j, True) for i, j in pairs] + [(j, i, j, False) for i, j in pairs if i != j]
    counts = local_table(spark, [(c, k) for c, k in chunks.items()], "cell long, chunks int")
    held = local_table(spark, trees, "cell long, chunk int, block int")
    meets = local_table(spark, meeting, "block int, low int, high int, left boolean")
    cut = placed.join(F.broadcast(counts), "cell").withColumn(
        "chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    )
    grown = stored.keep(
        cut.select("cid", "cell", "chunk", "size", "embedding").groupBy("cell", "chunk").applyInArrow(_grow, TREE)
    )
    both = grown.join(F.broadcast(held), ["cell", "chunk"]).join(F.broadcast(meets), "block").drop("block")
    both = both.repartition(4 * max(len(pairs), 1), "low", "high")
    met = stored.keep(
        both.groupBy("low", "high").applyInArrow(
            lambda table: _meet(table, epsilon, cosine), "cid long, links long, root long"
        )
    )
    stored.drop(placed, grown)
    sums = met.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("cid").alias("a"), F.col("root").alias("b")), stored)
    known = classes.select("h1", "h2", "low", "size", "cid").join(sums, "cid", "left").join(
        roots, F.col("cid") == F.col("node"), "left"
    )
    known = stored.keep(known.withColumn("root", F.coalesce("root", "cid")).drop("node", "cid"))
    least = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(least, "root").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component",
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    )
    stored.drop(met)
    out = rows.select("vec_id", "usable", "h1", "h2").join(
        known, F.col("usable") & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left"
    )
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
