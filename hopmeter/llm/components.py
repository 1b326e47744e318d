"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmeter.session import cut


def _toward_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Links of each node redirected to its smallest neighbour (or itself, if smaller).

    ``larger_only``: redirect neighbours above the node; else those below it and
    the node itself. The smallest neighbour is a map-side combined minimum joined
    back, so that a hub's links are never gathered in one group.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if larger_only:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        down = both.filter("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        moved = (
            down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(least.select("a", F.col("low").alias("b")))
        )
    return moved.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``links``; the label is the component's smallest node.

    Alternating contraction: after a number of rounds logarithmic in the size of
    a component every link points to its smallest node. Each round is a written
    table, so that a lost executor costs one round at most.
    """
    at = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    before = _state(at)
    while True:
        at = cut(_toward_least(_toward_least(at, True), False), "links")
        now = _state(at)
        if now == before:
            break
        before = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        at.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
