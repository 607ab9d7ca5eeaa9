"""A Merkle manifest of a dataset whose parents keep the state of their hash before each child."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.midstates import START, compress, from_bytes, hex_block, last_block, to_bytes
from harborline.llm.stored import Stored

FAN = 3
LEVELS = 8  # of the tree that one task builds, a block: 6,561 nodes, whatever the size of a source
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    """SHA-256 (binary) of a document's columns, each with its length; `text` in place of its text."""
    parts = []
    for name in COLUMNS:
        value = (text if text is not None and name == "text" else docs[name]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(rows: DataFrame, order: list[str], stored: Stored) -> DataFrame:
    """`rows` with their place `at` within `tree` and the size `n` of it; `order` begins with tree and settles all ties.

    Rows are dealt by ranges of the whole order, so a tree of any size is spread out; only the
    counts of ranges are put one after another.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored.keep(ranged.withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftrightunsigned("_at", 33).alias("_piece")
    by_piece = Window.partitionBy("tree").orderBy("_piece")
    starts = placed.groupBy("tree", piece).agg(F.min("_at").alias("_low"), F.count("*").alias("_count")).select(
        "tree", "_piece", (F.sum("_count").over(by_piece) - F.col("_count") - F.col("_low")).alias("_shift"),
        F.sum("_count").over(Window.partitionBy("tree")).alias("n"),
    )
    placed = placed.withColumn("_piece", F.shiftrightunsigned("_at", 33))
    at = (F.col("_at") + F.col("_shift")).alias("at")
    return placed.join(starts, ["tree", "_piece"]).select(*rows.columns, at, "n")


def _depth(n: int, levels: int) -> int:
    """Levels until n nodes are one, as far as one task goes."""
    depth = 0
    while depth < levels and FAN**depth < n:
        depth += 1
    return depth


def _sizes(n: int, depth: int) -> list[int]:
    """Nodes on each level above n of them."""
    return [-(-n // FAN**level) for level in range(depth + 1)]


def _absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return compress(state, hex_block(digests))


def _grow(leaves: np.ndarray, depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes (8, n) of each level, and the states (3, 8, n) of the parents above each: one before each child slot."""
    nodes, states = [leaves], []
    for _ in range(depth):
        below = nodes[-1]
        parents = -(-below.shape[1] // FAN)
        kept = np.broadcast_to(START, (FAN + 1, 8, parents)).copy()
        for slot in range(FAN):
            child = below[:, slot::FAN]
            kept[slot + 1, :, : child.shape[1]] = _absorb(kept[slot, :, : child.shape[1]], child)
        above = compress(kept[FAN], last_block(FAN))
        few = below.shape[1] - FAN * (parents - 1)  # children of the last parent
        above[:, -1:] = compress(kept[few, :, -1:], last_block(few))
        nodes.append(above)
        states.append(kept[:FAN])
    return nodes, states


def _resume(state: np.ndarray, slot: np.ndarray, children: np.ndarray, new: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Digests of parents where the child in `slot` is `new`: from the state before it, over it and what is to its right."""
    state = state.copy()
    for j in range(FAN):
        rows = np.flatnonzero((slot <= j) & (j < children))
        if len(rows):
            own = slot[rows] == j
            state[:, rows] = _absorb(state[:, rows], np.where(own, new[:, rows], right[j][:, rows]))
    out = np.empty_like(state)
    for n in range(1, FAN + 1):
        rows = np.flatnonzero(children == n)
        if len(rows):
            out[:, rows] = compress(state[:, rows], last_block(n))
    return out


BLOCK = "tree string, block long, at long, n long, root binary, nodes binary, states binary"


def _build(key: tuple, rows: pa.Table, levels: int) -> pa.Table:
    """One block of neighbouring nodes of a tree as one row: all nodes above them and the kept states."""
    rows = rows.sort_by("at")
    total, block = rows.column("n")[0].as_py(), key[1].as_py()
    depth = _depth(total, levels)
    leaves = from_bytes(b"".join(rows.column("leaf").to_pylist()))
    nodes, states = _grow(leaves, depth)
    packed = [to_bytes(level) for level in nodes]
    kept = [to_bytes(states[i][slot]) for i in range(depth) for slot in range(FAN)]
    return pa.table(
        {
            "tree": [key[0].as_py()], "block": [block], "at": [block], "n": [-(-total // FAN**depth) if depth else total],
            "root": [packed[-1]], "nodes": [b"".join(packed)], "states": [b"".join(kept)],
        },
        pa.schema([("tree", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64()),
                   ("root", pa.binary()), ("nodes", pa.binary()), ("states", pa.binary())]),
    )


class _Block:
    """A block read back."""

    def __init__(self, nodes: bytes, states: bytes):
        # The number of leaves is the only one whose levels have so many nodes and parents.
        total, parents = len(nodes) // 32, len(states) // (32 * FAN)
        leaves = total - parents
        depth, n, count = 0, leaves, 0
        while count < parents:
            n = -(-n // FAN)
            count += n
            depth += 1
        all_nodes, all_states = from_bytes(nodes), from_bytes(states)
        self.depth, self.levels, self.states = depth, [], []
        node = state = 0
        for level, size in enumerate(_sizes(leaves, depth)):
            self.levels.append(all_nodes[:, node : node + size])
            node += size
            if level:
                self.states.append(all_states[:, state : state + FAN * size].reshape(8, FAN, size))
                state += FAN * size

    def siblings(self) -> list[list[bytes]]:
        """For each level, the hex texts of each node's siblings."""
        out = []
        for level in self.levels[: self.depth]:
            words = to_bytes(level).hex()
            texts = [words[i : i + 64] for i in range(0, len(words), 64)]
            runs = [texts[i : i + FAN] for i in range(0, len(texts), FAN)]
            out.append(["".join(run[:j] + run[j + 1 :]) for run in runs for j in range(len(run))])
        return out

    def fold(self, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The root of this block for each replaced leaf, alone."""
        for level in range(self.depth):
            below = self.levels[level]
            parent, slot = at // FAN, at % FAN
            children = np.minimum(FAN, below.shape[1] - FAN * parent)
            state = self.states[level][:, slot, parent]
            right = [below[:, np.minimum(FAN * parent + j, below.shape[1] - 1)] for j in range(FAN)]
            at, new = parent, _resume(state, slot, children, new, right)
        return new

    def steps(self) -> Iterator[bytes]:
        """For each leaf: slot, children, state and siblings of every level above it, packed."""
        above = [b""]
        for level in range(self.depth - 1, -1, -1):
            below, kept = self.levels[level], self.states[level]
            texts = to_bytes(below)
            here = []
            for i in range(below.shape[1]):
                parent, slot = divmod(i, FAN)
                children = min(FAN, below.shape[1] - FAN * parent)
                run = texts[32 * FAN * parent : 32 * (FAN * parent + children)]
                others = run[: 32 * slot] + run[32 * (slot + 1) :]
                state = to_bytes(kept[:, slot, parent : parent + 1])
                here.append(bytes([slot, children]) + state + others + above[parent])
            above = here
        if self.depth:
            yield from above
        else:
            yield from [b""] * self.levels[0].shape[1]


def _path_steps(path: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    at = 0
    while at < len(path):
        slot, children = path[at], path[at + 1]
        end = at + 34 + 32 * (children - 1)
        yield slot, children, path[at + 2 : at + 34], path[at + 34 : end]
        at = end


PATH = "tree string, at long, path binary, subroot binary, top binary"


def _child_paths(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """The way from each child of upper blocks to the root of all: its steps in its block, then those of the block."""
    for batch in batches:
        for row in batch.to_pylist():
            paths = [steps + row["path"] for steps in _Block(row["nodes"], row["states"]).steps()]
            n = len(paths)
            yield pa.record_batch(
                {
                    "tree": pa.array([row["tree"]] * n, pa.string()),
                    "at": pa.array(np.arange(n) + row["block"] * span, pa.int64()),
                    "path": pa.array(paths, pa.binary()),
                    "subroot": pa.array([row["subroot"]] * n, pa.binary()),
                    "top": pa.array([row["top"]] * n, pa.binary()),
                }
            )


def _rounds(nodes: DataFrame, stored: Stored, levels: int) -> list[DataFrame]:
    """Blocks of `nodes` (tree, at, n, leaf), blocks of their roots and so on, until each tree is one block."""
    rounds = []
    while True:
        grouped = nodes.select("tree", F.expr(f"at div {FAN**levels}").alias("block"), "at", "n", "leaf").groupBy("tree", "block")
        rounds.append(stored.keep(grouped.applyInArrow(lambda key, rows: _build(key, rows, levels), BLOCK)))
        most = rounds[-1].agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return rounds
        nodes = rounds[-1].select("tree", "at", "n", F.col("root").alias("leaf"))


def _paths(rounds: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """(tree, at, path, subroot, top) of the blocks of the first round; `top` has those of the last."""
    for blocks in reversed(rounds[1:]):
        ways = top.withColumnRenamed("at", "block")
        joined = blocks.select("tree", "block", "nodes", "states").join(ways, ["tree", "block"])
        top = joined.mapInArrow(lambda batches: _child_paths(batches, FAN**levels), PATH)
    return top


def build_manifest(docs: DataFrame, replaced: Column | None = None, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The manifest of `docs` as two written tables: leaves and blocks.

    Leaves: doc_id, tree (the source), at (place among the leaves of its source by doc_id, nulls first), leaf, and as
    `new` the digest of the document with the text `replaced`, if that is given and not null, else `leaf`.
    Blocks: for every `FAN` ** `levels` neighbouring leaves all nodes above them, the states kept by their parents before each child
    slot, the way (states and siblings) from the block to the root of all, the source's root and the root.

    Every `FAN` consecutive nodes become a parent, the hash of their digests as hex text; a last run may be shorter, even
    one node. A source's leaves become its subroot, the subroots by source, null first, the root. A tree is built
    block by block, blocks of any source side by side, and then blocks of their roots: no task has more nodes than a block.
    Leaves that are alike in source and doc_id come by their digest. Null texts, columns and ids have a mark
    of their own in a leaf; repeated rows are leaves of their own; an empty table has no leaves, no blocks and no root.
    Columns other than `COLUMNS` are not looked at.
    """
    stored = Stored(docs.sparkSession, "merkle")
    leaf = leaf_digest(docs)
    new = leaf if replaced is None else F.when(replaced.isNotNull(), leaf_digest(docs, replaced)).otherwise(leaf)
    tree = F.when(docs["source"].isNull(), "-").otherwise(F.concat(F.lit("="), docs["source"]))
    rows = docs.select(
        tree.alias("tree"), docs["doc_id"], leaf.alias("leaf"), new.alias("new"), F.monotonically_increasing_id().alias("row")
    )
    leaves = _numbered(stored.keep(rows), ["tree", "doc_id", "leaf", "row"], stored).drop("row")
    rounds = _rounds(leaves, stored, levels)
    subroots = rounds[-1].select(F.col("tree").alias("of"), F.lit("").alias("tree"), F.col("root").alias("leaf"))
    numbered = stored.keep(_numbered(subroots, ["tree", "of"], stored))
    upper = _rounds(numbered, stored, levels)
    whole = upper[-1].select("tree", "at", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"), F.col("root").alias("top"))
    by_place = _paths([upper[0], *upper], whole, levels).select("at", "path", "top")
    ways = numbered.join(by_place, "at").select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("leaf").alias("subroot"), "top"
    )
    ways = _paths(rounds, ways, levels).withColumnRenamed("at", "block")
    blocks = rounds[0].select("tree", "block", "nodes", "states").join(ways, ["tree", "block"])
    return leaves, stored.keep(blocks)


FOLDED = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "tree string, at long"
)


def _fold_block(leaves: pa.Table, block: pa.Table, span: int) -> pa.Table:
    block = block.to_pylist()[0]
    kept = _Block(block["nodes"], block["states"])
    at = leaves.column("at").to_numpy()
    inside = at % span
    new = kept.fold(inside, from_bytes(b"".join(leaves.column("new").to_pylist())))
    proofs, n = "", len(at)
    for slot, children, state, others in _path_steps(block["path"]):
        proofs += others.hex()
        known = from_bytes(others)
        right = [np.repeat(known[:, max(j - 1, 0) : max(j, 1)], n, axis=1) if children > 1 else new for j in range(FAN)]
        new = _resume(np.repeat(from_bytes(state), n, axis=1), np.full(n, slot), np.full(n, children), new, right)
    for siblings in reversed(kept.siblings()):
        # What stands above a node follows what stands beside it.
        proofs = [s + (proofs if isinstance(proofs, str) else proofs[i // FAN]) for i, s in enumerate(siblings)]
    if isinstance(proofs, str):
        proofs = [proofs] * kept.levels[0].shape[1]
    folded = to_bytes(new)
    top = block["top"]
    digests = [folded[i : i + 32] for i in range(0, 32 * n, 32)]
    return pa.table(
        {
            "doc_id": leaves.column("doc_id"),
            "leaf": [x.hex() for x in leaves.column("leaf").to_pylist()],
            "subroot": pa.array([block["subroot"].hex()] * n, pa.string()),
            "root": pa.array([top.hex()] * n, pa.string()),
            "proof_sha256": [hashlib.sha256(proofs[i].encode()).hexdigest() for i in inside.tolist()],
            "folded_root": [x.hex() for x in digests],
            "verified": [x == top for x in digests],
            "tree": leaves.column("tree"),
            "at": leaves.column("at"),
        }
    )


def fold_manifest(leaves: DataFrame, blocks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The root that each leaf's `new` digest alone would give, with its proof: hashes of the siblings on its way.

    Each step takes the state its parent kept before the child's slot and goes on with the new digest
    and the siblings to its right; those to its left are in the state. `verified`: the root comes out again.
    """
    keyed = leaves.select("doc_id", "tree", "at", "leaf", "new", F.expr(f"at div {FAN**levels}").alias("block"))
    return (
        keyed.groupBy("tree", "block")
        .cogroup(blocks.groupBy("tree", "block"))
        .applyInArrow(lambda leaves, block: _fold_block(leaves, block, FAN**levels), FOLDED)
    )


def verify_documents(docs: DataFrame, replaced: Column, levels: int = LEVELS) -> DataFrame:
    """A row a document: its leaf, its source's root, the root, its proof and the root folded from the text `replaced`.

    See `build_manifest` and `fold_manifest`. Documents whose `replaced` is null are folded from their own leaf.
    """
    return fold_manifest(*build_manifest(docs, replaced, levels), levels).drop("tree", "at")


def without_newlines(docs: DataFrame) -> Column:
    """The tampered text of those documents whose id has an even CRC-32; null for the others."""
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit("")))
