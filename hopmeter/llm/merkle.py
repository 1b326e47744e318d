"""Merkle manifest of a table, its trees laid out after van Emde Boas.

Rows are the leaves of one binary tree per group, in key order; the roots of the
groups are the leaves of one more tree. A tree is cut into aligned blocks of
2^``HEIGHT`` leaves. A block is one binary of raw digests: the subtree is split at
half its height, the upper half is laid out first and then each lower subtree, all
by the same rule. ``address`` computes where a node lies from its depth and index,
so a path from leaf to root touches few cache lines whatever their size, and no
pointers are kept. The roots of the blocks are the leaves of the next level of
blocks, until a tree is a single block. Blocks are written tables, level by level;
paths are put together from the top down and meet the leaves block by block, so
that no task ever holds more than one block with its leaves.

Defined cases: a null group is a group of its own and comes first; a null value is
hashed as ``-``; rows of equal key stand in the order of their digests; a node
without a sibling is hashed alone; an empty table has no rows and no root. Texts of
any length are hashed whole, in the JVM. The caller names the columns to hash, so
further columns change nothing.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter.operators.ordinal import with_ordinal
from hopmeter.session import cut

HEIGHT = 10
STEP = "struct<left:boolean,digest:string>"
BLOCK = "tree string, block bigint, blocks bigint, n int, height int, nodes binary, root binary"
_STEPS = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))


# -- digests ------------------------------------------------------------------------


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of the values, each with its length in UTF-8 bytes before it."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its path give."""
    def up(at: Column, step: Column) -> Column:
        beside = F.coalesce(step["digest"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(beside, at)).otherwise(F.concat(at, beside)), 256)

    return F.aggregate(steps, leaf, up)


def siblings(steps: Column) -> Column:
    """The digests of a path, from the leaf up, in one text."""
    return F.array_join(F.transform(steps, lambda s: s["digest"]), "")


# -- blocks -------------------------------------------------------------------------


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth lie in a tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, inside = levels - upper, depth - upper
    tree, local = index >> inside, index & ((1 << inside) - 1)
    return (1 << upper) - 1 + tree * ((1 << lower) - 1) + address(lower, inside, local)


def lay_out(leaves: Sequence[bytes], height: int) -> np.ndarray:
    """(2^(height + 1) - 1, 32) digests of the tree over at most 2^height raw digests."""
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    row = [hexlify(leaf) for leaf in leaves]
    for depth in range(height, -1, -1):
        at = address(height + 1, depth, np.arange(len(row)))
        nodes[at] = np.frombuffer(bytes.fromhex(b"".join(row).decode()), np.uint8).reshape(-1, 32)
        row = [hashlib.sha256(b"".join(row[i : i + 2])).hexdigest().encode() for i in range(0, len(row), 2)]
    return nodes


def inner_steps(nodes: bytes, n: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the ``n`` leaves of a block: (sibling digest in hex, is it on the left, is there one), a column per level."""
    names = np.frombuffer(hexlify(nodes), "S64")
    digest = np.zeros((n, height), "S64")
    left, there = np.zeros((n, height), bool), np.zeros((n, height), bool)
    for level in range(height):
        own = np.arange(n) >> level
        beside = own ^ 1
        there[:, level] = beside < -(-n >> level)
        left[:, level] = beside < own
        digest[:, level] = names[address(height + 1, height - level, np.where(there[:, level], beside, own))]
    return digest, left, there


def _build(tree_height: int):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree, block = table["tree"][0].as_py(), table["at"][0].as_py() >> tree_height
        leaves, all_leaves = table["digest"].to_pylist(), table["n"][0].as_py()
        blocks = -(-all_leaves >> tree_height)
        height = tree_height if blocks > 1 else (len(leaves) - 1).bit_length()
        nodes = lay_out(leaves, height)
        return pa.table({
            "tree": pa.array([tree], pa.string()), "block": pa.array([block], pa.int64()),
            "blocks": pa.array([blocks], pa.int64()), "n": pa.array([len(leaves)], pa.int32()),
            "height": pa.array([height], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary()),
            "root": pa.array([nodes[0].tobytes()], pa.binary()),
        })

    return build


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Tables of blocks over ``nodes`` (tree, at, n, digest), from the leaves up."""
    levels = []
    while True:
        level = cut(
            nodes.groupBy("tree", F.shiftright("at", height).alias("block")).applyInArrow(_build(height), BLOCK), "merkle",
        )
        levels.append(level)
        inner = level.filter("blocks > 1")
        if inner.isEmpty():
            return levels
        nodes = inner.select("tree", F.col("block").alias("at"), F.col("blocks").alias("n"), F.col("root").alias("digest"))


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    found = [level.filter("blocks = 1").select("tree", "root") for level in levels]
    top = found[0]
    for more in found[1:]:
        top = top.union(more)
    return top


def _steps_of(block: dict, at: np.ndarray) -> pa.Array:
    """Paths of the leaves ``at`` of a block: inside it, then above it."""
    digest, left, there = inner_steps(block["nodes"], block["n"], block["height"])
    above = block["above"]
    up = np.array([(s["digest"] or "").encode() for s in above], "S64")
    digest = np.concatenate([digest[at], np.broadcast_to(up, (len(at), len(up)))], axis=1)
    sides = np.array([bool(s["left"]) for s in above], bool)
    left = np.concatenate([left[at], np.broadcast_to(sides, (len(at), len(up)))], axis=1)
    known = np.array([s["digest"] is not None for s in above], bool)
    there = np.concatenate([there[at], np.broadcast_to(known, (len(at), len(up)))], axis=1)
    names = pa.array(digest.ravel().tolist(), pa.binary(), mask=~there.ravel()).cast(pa.string())
    flat = pa.StructArray.from_arrays([pa.array(left.ravel()), names], ["left", "digest"])
    ends = np.arange(len(at) + 1, dtype=np.int32) * digest.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), flat)


def _children(table: pa.Table) -> pa.Table:
    """The paths above the blocks whose roots are the leaves of one block."""
    block = table.to_pylist()[0]
    at = np.arange(block["n"])
    return pa.table({
        "tree": pa.array([block["tree"]] * len(at), pa.string()),
        "block": pa.array((block["block"] << HEIGHT) + at),
        "above": _steps_of(block, at).cast(_STEPS),
    })


def _with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks of ``levels`` with the path ``above`` them; ``above``: (tree, above) of every tree."""
    below = None
    for level in reversed(levels):
        top = level.filter("blocks = 1").join(above, "tree")
        if below is None:
            at = top
        else:
            at = top.unionByName(level.filter("blocks > 1").join(below, ["tree", "block"]))
        if level is not levels[0]:
            at = cut(at, "merkle-paths")
            below = at.groupBy("tree", "block").applyInArrow(_children, f"tree string, block bigint, above array<{STEP}>")
    return at


# -- manifest -----------------------------------------------------------------------


@dataclass
class Manifest:
    """What ``build`` wrote: leaves, block tables of the groups' trees, and those of the tree over their roots."""

    leaves: DataFrame
    levels: list[DataFrame]
    crown: list[DataFrame]
    groups: DataFrame

    def root(self) -> DataFrame:
        """One row, or none for an empty table."""
        return _tops(self.crown).select(F.lower(F.hex("root")).alias("root"))


def build(
    docs: DataFrame, fields: Sequence[Column], group: Column, key: Column, carry: dict[str, Column] | None = None
) -> Manifest:
    """Manifest of ``docs``: a leaf per row over ``fields``, a tree per ``group``, leaves in order of ``key``.

    ``carry`` are further columns to keep beside the leaves.
    """
    name = group.cast("string")
    rows = cut(docs.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("tree"), key.alias("key"),
        F.unhex(leaf_digest(fields)).alias("digest"), *[c.alias(k) for k, c in (carry or {}).items()],
    ), "merkle-rows")
    placed = cut(with_ordinal(rows, [], ["tree", "key", "digest"], "place"), "merkle-placed")
    size = placed.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    leaves = cut(placed.join(size, "tree").select(
        "tree", (F.col("place") - F.col("first")).alias("at"), "n", "key", "digest", *(carry or {}),
    ), "merkle-leaves")
    levels = _levels(leaves.select("tree", "at", "n", "digest"), HEIGHT)
    groups = cut(with_ordinal(_tops(levels), [], ["tree"], "at"), "merkle-groups")
    roots = groups.select(
        F.lit("").alias("tree"), "at", F.lit(groups.count()).cast("bigint").alias("n"), F.col("root").alias("digest")
    )
    return Manifest(leaves, levels, _levels(roots, HEIGHT), groups)


def _prove(columns: list[str]):
    def prove(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0] if leaves.num_rows else None
        kept = leaves.select(columns)
        if block is None:
            steps = pa.array([], _STEPS)
        else:
            steps = _steps_of(block, leaves["at"].to_numpy() - (block["block"] << HEIGHT)).cast(_STEPS)
        subroot = pa.array([block["subroot"] if block else None] * leaves.num_rows, pa.binary())
        return pa.table({**{c: kept[c] for c in columns}, "subroot": subroot, "steps": steps})

    return prove


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, at, key, leaf, subroot, root, steps) and what is carried, for every leaf.

    ``steps`` lead from the leaf to the root: the sibling's digest and whether it is
    on the left, or a null digest where a node is hashed alone.
    """
    over = F.array().cast(f"array<{STEP}>")
    top = manifest.root().first()
    paths = _with_paths(manifest.crown, _tops(manifest.crown).select("tree", over.alias("above")))
    ends = paths.groupBy("tree", "block").applyInArrow(_children, f"tree string, block bigint, above array<{STEP}>")
    groups = manifest.groups.join(ends.select(F.col("block").alias("at"), "above"), "at")
    groups = cut(groups.select("tree", "above", F.col("root").alias("subroot")), "merkle-subroots")
    blocks = _with_paths(manifest.levels, groups.select("tree", "above")).join(groups.select("tree", "subroot"), "tree")
    leaves = manifest.leaves.withColumn("block", F.shiftright("at", HEIGHT))
    columns = [c for c in manifest.leaves.columns if c != "n"]
    schema = ", ".join(f"`{c}` {manifest.leaves.schema[c].dataType.simpleString()}" for c in columns)
    found = leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(
        _prove(columns), f"{schema}, subroot binary, steps array<{STEP}>"
    )
    name = lambda c: F.lower(F.hex(c))
    return found.select(
        *[c for c in columns if c != "digest"], name("digest").alias("leaf"), name("subroot").alias("subroot"),
        F.lit(top["root"] if top else None).cast("string").alias("root"), "steps",
    )
