"""Merkle manifest of a table, its trees stored as blocks in van Emde Boas order.

Rows are leaves, hashed field by field. The leaves of a group (say, a source) ascend by a key; every ``fanout``
consecutive nodes become one node above until one is left, the group's subroot. Subroots in order of their
group form the tree of the manifest in the same way.

A tree is cut into aligned subtrees of ``height`` levels above their leaves. Each is one row, a block: its digests
lie in van Emde Boas order, that is, the upper half of the levels first, then the subtrees below it one after
the other, each laid out alike. Where a node lies follows from its level and index alone; building a block and
looking up siblings go by that arithmetic and need no pointers. The roots of blocks are the leaves of the next
blocks, so a tree of any size takes a logarithmic number of rounds, and no task holds more than a block.
"""
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storelens.operators.durable import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Tree:
    """``fanout`` nodes make one above; a block has up to fanout ** height leaves."""
    fanout: int = 16
    height: int = 3

    @property
    def span(self) -> int:
        return self.fanout ** self.height

    def height_over(self, n: int) -> int:
        """Levels above ``n`` leaves."""
        levels, reach = 0, 1
        while reach < n:
            levels, reach = levels + 1, reach * self.fanout
        return levels

    def size(self, levels: int, n: int) -> int:
        """Nodes of a subtree of ``levels`` levels (its leaves and its root counted) with ``n`` leaves."""
        total = 0
        for _ in range(levels):
            total += n
            n = -(-n // self.fanout)
        return total

    def address(self, levels: int, n: int, level: int, index: np.ndarray) -> np.ndarray:
        """Where the nodes ``index`` of a level (0: leaves) lie in a subtree of ``levels`` levels and ``n`` leaves.

        Subtrees below the cut are full but for the last, so the place of each is a product.
        """
        if levels == 1:
            return np.zeros_like(index)
        top = levels // 2
        low = levels - top
        above = -(-n // self.fanout ** low)
        if level >= low:
            return self.address(top, above, level - low, index)
        leaves = self.fanout ** (low - 1)
        per_tree = self.fanout ** (low - 1 - level)
        tree = index // per_tree
        last = -(-n // leaves) - 1
        inside = index % per_tree
        full = tree < last
        found = self.size(top, above) + tree * self.size(low, leaves)
        found[full] += self.address(low, leaves, level, inside[full])
        found[~full] += self.address(low, n - last * leaves, level, inside[~full])
        return found


@dataclass(frozen=True)
class Block:
    """One aligned subtree: ``nodes`` are 32-byte digests in van Emde Boas order."""
    tree: Tree
    levels: int
    leaves: int
    nodes: np.ndarray

    @classmethod
    def built(cls, tree: Tree, height: int, leaves: np.ndarray) -> "Block":
        n = len(leaves)
        block = cls(tree, height + 1, n, np.zeros((tree.size(height + 1, n), 32), np.uint8))
        block.nodes[block.address(0, np.arange(n))] = leaves
        for level in range(height):
            runs = [sha256(run).digest() for run in block.runs(level)]
            block.nodes[block.address(level + 1, np.arange(len(runs)))] = np.frombuffer(b"".join(runs), np.uint8).reshape(-1, 32)
        return block

    @classmethod
    def read(cls, tree: Tree, height: int, n: int, layout: bytes) -> "Block":
        return cls(tree, height + 1, n, np.frombuffer(layout, np.uint8).reshape(-1, 32))

    def address(self, level: int, index: np.ndarray) -> np.ndarray:
        return self.tree.address(self.levels, self.leaves, level, index)

    def runs(self, level: int) -> list[bytes]:
        """Hex digests of each run of siblings of a level, one text a run."""
        n = -(-self.leaves // self.tree.fanout ** level)
        text = self.nodes[self.address(level, np.arange(n))].tobytes().hex().encode()
        width = 64 * self.tree.fanout
        return [text[k:k + width] for k in range(0, len(text), width)]

    def root(self) -> bytes:
        return self.nodes[self.address(self.levels - 1, np.zeros(1, np.int64))[0]].tobytes()

    def paths(self) -> list[list[bytes]]:
        """Per leaf, level by level: the hex digests left and right of the node in its run."""
        found: list[list[bytes]] = [[] for _ in range(self.leaves)]
        for level in range(self.levels - 1):
            runs, below = self.runs(level), self.tree.fanout ** level
            for leaf in range(self.leaves):
                run, own = divmod(leaf // below, self.tree.fanout)
                found[leaf] += [runs[run][:64 * own], runs[run][64 * own + 64:]]
        return found


def folded(digest: bytes, path: Sequence[bytes]) -> bytes:
    """The root that a leaf's hex digest leads to, going up between the siblings of ``path``."""
    for k in range(0, len(path), 2):
        digest = sha256(path[k] + digest + path[k + 1]).hexdigest().encode()
    return digest


def row_digest(fields: Sequence[str | Column]) -> Column:
    """Hex SHA-256 of all fields in turn: ``-`` for a null, else the length in UTF-8 bytes, a colon and the value."""
    def one(field: str | Column) -> Column:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``at``, the place of a row in its group ``g`` by ``order``, from 0, and ``n``, the rows of the group.

    A group is sorted over as many range partitions as it fills; only one count per group and partition
    meets in a window.
    """
    sorted_rows = durable(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
                          .withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33).alias("part")
    pieces = sorted_rows.groupBy("g", part).agg(F.min("row").alias("first"), F.count("*").alias("m"))
    group = Window.partitionBy("g")
    pieces = pieces.select("g", "part", "first", F.sum("m").over(group).alias("n"),
                           (F.sum("m").over(group.orderBy("part")) - F.col("m")).alias("before"))
    return (sorted_rows.withColumn("part", part).join(pieces, ["g", "part"])
            .withColumn("at", F.col("row") - F.col("first") + F.col("before")).drop("row", "part", "first", "before"))


def _blocks(nodes: DataFrame, tree: Tree) -> list[DataFrame]:
    """Blocks over the leaves, over the roots of these, and so on; ``nodes``: g, at, n, digest.

    (g, block, n, root, layout), n being the nodes of the group that the blocks of this round stand on.
    """
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table.column("n")[0].as_py()
        leaves = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        block = Block.built(tree, min(tree.height, tree.height_over(n)), leaves)
        return pa.table({"g": table.column("g")[:1], "block": table.column("block")[:1], "n": table.column("n")[:1],
                         "leaves": pa.array([len(leaves)], pa.int64()), "root": pa.array([block.root()], pa.binary()),
                         "layout": pa.array([block.nodes.tobytes()], pa.binary())})

    found = []
    while True:
        found.append(durable(
            nodes.withColumn("block", F.floor(F.col("at") / tree.span)).select("g", "block", "at", "n", "digest")
            .groupBy("g", "block").applyInArrow(
                build, "g string, block bigint, n bigint, leaves bigint, root binary, layout binary")))
        nodes = found[-1].where(F.col("n") > tree.span).select(
            "g", F.col("block").alias("at"), F.ceil(F.col("n") / tree.span).alias("n"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return found


def _subroots(levels: list[DataFrame], tree: Tree) -> DataFrame:
    """(g, root): the root of the block that is the last of its group."""
    found = None
    for blocks in levels:
        last = blocks.where(F.col("n") <= tree.span).select("g", "root")
        found = last if found is None else found.unionByName(last)
    return found


Emit = Callable[[pa.Table, list[list[bytes]], str | None], pa.Table]


def _under(children: DataFrame, parents: DataFrame, tree: Tree, emit: Emit, schema: str) -> DataFrame:
    """``emit(children of a block by place, their paths to the very root, subroot)`` for every block.

    ``children``: g, at and more; ``parents``: blocks with ``path`` and ``subroot``.
    """
    def per_block(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        rows, above = rows.sort_by("at"), blocks.to_pylist()[0]
        block = Block.read(tree, min(tree.height, tree.height_over(above["n"])), above["leaves"], above["layout"])
        upper = [text.encode() for text in above["path"]]
        return emit(rows, [path + upper for path in block.paths()], above["subroot"])

    placed = children.withColumn("block", F.floor(F.col("at") / tree.span))
    return (placed.groupBy("g", "block").cogroup(parents.groupBy("g", "block")).applyInArrow(per_block, schema))


def _with_paths(levels: list[DataFrame], tops: DataFrame, tree: Tree) -> DataFrame:
    """The blocks over the leaves with ``path``, the siblings from a block's root up to the very root, and ``subroot``.

    ``tops``: (g, path, subroot) of each group's subroot.
    """
    def carry(rows: pa.Table, paths: list[list[bytes]], subroot: str | None) -> pa.Table:
        texts = [[text.decode() for text in path] for path in paths]
        return pa.table({"g": rows.column("g"), "block": rows.column("at"), "path": pa.array(texts, pa.list_(pa.string())),
                         "subroot": pa.array([subroot] * len(rows), pa.string())})

    above = None
    for blocks in reversed(levels):
        found = blocks.where(F.col("n") <= tree.span).join(tops, "g")
        if above is not None:
            inner = _under(blocks.where(F.col("n") > tree.span).select("g", F.col("block").alias("at")), above, tree, carry,
                           "g string, block bigint, path array<string>, subroot string")
            found = found.unionByName(blocks.join(inner, ["g", "block"]).select(found.columns))
        above = durable(found)
    return above


class Manifest:
    """The trees of a table.

    ``root``: hex digest over everything, None for an empty table. ``subroots``: one row per group.
    """

    def __init__(self, docs: DataFrame, fields: Sequence[str], group: str, order: str, claimed: Column | None = None,
                 tree: Tree = Tree()):
        """``claimed``: the leaf digest somebody presents for a row, for ``audit``; a row's own where null.

        Groups and keys may be null: null groups are one group and come first, null keys come first in theirs.
        Rows of equal keys ascend by digest, so repeated rows are leaves of their own, in any order the same.
        Columns that are not named are not read.
        """
        own = row_digest(fields)
        leaves = docs.select(
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("g"),
            F.col(order).alias("k"), F.unhex(own).alias("digest"),
            F.unhex(F.coalesce(claimed, own) if claimed is not None else own).alias("claimed"))
        self.tree, self._group, self._order = tree, group, order
        self._types = docs.select(group, order).dtypes
        self._leaves = durable(_placed(durable(leaves), "k", "digest", "claimed"))
        self._levels = _blocks(self._leaves.select("g", "at", "n", "digest"), tree)
        tops = _placed(_subroots(self._levels, tree).select(F.lit("").alias("g"), F.col("g").alias("name"),
                                                            F.col("root").alias("digest")), "name")
        self._tops = durable(tops)
        self._over = _blocks(self._tops.select("g", "at", "n", "digest"), tree)
        root = _subroots(self._over, tree).first()
        self.root = root["root"].hex() if root else None

    def subroots(self) -> DataFrame:
        """(group, subroot)."""
        name = F.when(F.col("name") != "-", F.substring("name", 2, 1 << 30)).cast(self._types[0][1])
        return self._tops.select(name.alias(self._group), F.lower(F.hex("digest")).alias("subroot"))

    def _under_leaves(self, emit: Emit, schema: str) -> DataFrame:
        def named(rows: pa.Table, paths: list[list[bytes]], _) -> pa.Table:
            return pa.table({"g": rows.column("name"),
                             "path": pa.array([[t.decode() for t in path] for path in paths], pa.list_(pa.string())),
                             "subroot": pa.array([d.hex() for d in rows.column("digest").to_pylist()], pa.string())})

        very_top = self._tops.select("g").limit(1).select(
            "g", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"))
        over = _with_paths(self._over, very_top, self.tree)
        tops = durable(_under(self._tops.select("g", "at", "name", "digest"), over, self.tree, named,
                              "g string, path array<string>, subroot string"))
        return _under(self._leaves, _with_paths(self._levels, tops, self.tree), self.tree, emit, schema)

    def proofs(self) -> DataFrame:
        """(order key, leaf, subroot, path): path holds, level by level up to the root, the hex digests left of the
        row's node in its run and those right of it."""
        def emit(rows: pa.Table, paths: list[list[bytes]], subroot: str) -> pa.Table:
            return pa.table({"k": rows.column("k"),
                             "leaf": pa.array([d.hex() for d in rows.column("digest").to_pylist()], pa.string()),
                             "subroot": pa.array([subroot] * len(rows), pa.string()),
                             "path": pa.array([[t.decode() for t in p] for p in paths], pa.list_(pa.string()))})
        return self._under_leaves(emit, f"k {self._types[1][1]}, leaf string, subroot string, path array<string>"
                                  ).withColumnRenamed("k", self._order)

    def audit(self) -> DataFrame:
        """(order key, leaf, subroot, root, proof_sha256, folded_root, verified): the claimed leaf of each row folded
        up with the row's proof, and whether that ends at the root."""
        root = self.root

        def emit(rows: pa.Table, paths: list[list[bytes]], subroot: str) -> pa.Table:
            leaves, claims = rows.column("digest").to_pylist(), rows.column("claimed").to_pylist()
            proofs = [sha256(b"".join(path)).hexdigest() for path in paths]
            within = 2 * min(self_tree.height, self_tree.height_over(rows.column("n")[0].as_py()))
            # All rows of the block that are as they were reach the same node at its top.
            above: dict[bytes, str] = {}
            ends = []
            for claim, path in zip(claims, paths):
                node = folded(claim.hex().encode(), path[:within])
                if node not in above:
                    above[node] = folded(node, path[within:]).decode()
                ends.append(above[node])
            return pa.table({"k": rows.column("k"), "leaf": pa.array([d.hex() for d in leaves], pa.string()),
                             "subroot": pa.array([subroot] * len(rows), pa.string()),
                             "root": pa.array([root] * len(rows), pa.string()),
                             "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(ends, pa.string()),
                             "verified": pa.array([end == root for end in ends], pa.bool_())})

        self_tree = self.tree
        return self._under_leaves(
            emit, f"k {self._types[1][1]}, leaf string, subroot string, root string, proof_sha256 string, "
                  "folded_root string, verified boolean").withColumnRenamed("k", self._order)
