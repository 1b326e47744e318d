"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards is descended level by level: each child draws
``-ln(u) / weight`` with u hashed from the document's id and the child's name, and
the smallest draw wins. The id and the tree decide alone, so a shard never depends
on what else is in the table, and a change of weight moves only documents of the
subtrees it touches (and into the one that grew).

``layout`` fills regions of two racks with four shards each; a further region
starts with one shard, so one more shard after full regions takes documents only
into itself. Slots number the documents of a shard from 0 by id, in tasks that
hold ranges of (shard, id), with the numbers of earlier ranges added; a shard is
never gathered in one task. Defined cases: a null text has size 1 and the checksum
of the empty text; a null id hashes as the empty text; repeated rows get
different slots; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmeter.session import cut

RACK, REGION = 4, 2


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a leaf has the number of its shard."""

    name: str
    weight: float
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None


def layout(shards: int, rack: int = RACK, region: int = REGION) -> Node:
    """Tree of equal shards, ``rack`` of them in a rack and ``region`` racks in a region."""
    def group(nodes: list[Node], size: int, kind: str) -> list[Node]:
        parts = [tuple(nodes[i : i + size]) for i in range(0, len(nodes), size)]
        return [Node(f"{kind}{i}", sum(n.weight for n in p), p) for i, p in enumerate(parts)]

    leaves = [Node(f"shard{i}", 1.0, shard=i) for i in range(shards)]
    regions = group(group(leaves, rack, "rack"), region, "region")
    return Node("root", sum(n.weight for n in regions), tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    """Exponential draw of a child: the first 13 hex digits of a hash as u in (0, 1)."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/" + node.name)).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)
    return -F.log(u) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """Shard of ``key`` below ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    children = [n for n in node.children if n.weight > 0]
    if len(children) == 1:
        return descend(key, children[0])
    draws = [F.struct(_draw(key, n).alias("draw"), F.lit(i).alias("child")) for i, n in enumerate(children)]
    winner = F.least(*draws)["child"]
    return F.transform(
        F.array(winner),
        lambda w: F.coalesce(*[F.when(w == i, descend(key, n)) for i, n in enumerate(children)]),
    )[0]


def shard_of(doc_id: Column, tree: Node) -> Column:
    return descend(F.coalesce(doc_id.cast("string"), F.lit("")), tree).cast("int")


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    order = ["shard", "doc_id", "text_crc32", "size", "row"]
    laid = cut(
        docs.select(
            "doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
            shard_of(F.col("doc_id"), layout(shards)).alias("shard"),
            shard_of(F.col("doc_id"), layout(shards + 1)).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        )
        .repartitionByRange(*order)
        .withColumn("task", F.spark_partition_id()),
        "sharded",
    )
    # One row per shard and range: as many as tasks and shards together.
    counts = laid.groupBy("shard", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    here = Window.partitionBy("shard", "task").orderBy(*order[1:])
    return laid.join(first, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.row_number().over(here) - 1).cast("bigint").alias("slot"), "grown_shard",
    )
