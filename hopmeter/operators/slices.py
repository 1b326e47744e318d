"""Statistics of many slices of many vectors at once.

Where ``std_slice`` takes one pair of bounds for all groups, a ``SliceTree`` answers a table of
(group, lo, hi). The vectors are cut into aligned blocks of 32 positions, those into blocks of
32 blocks and so on; each block has count, sum, mean, centred squares, minimum and
maximum, and is stored in one row with the 31 others of its parent. A slice is then at
most 62 whole blocks on each of log32(length) levels, in at most two rows a level, which are
looked up by their number. Slices with the same bounds are answered once. Nothing is scanned
per slice, no join has a range for a condition, and a long vector is spread over tasks
block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter.operators.ordinal import with_ordinal
from hopmeter.operators.summary import same_group
from hopmeter.session import cut

FANOUT_BITS = 5
NAN, INF = float("nan"), float("inf")


def _part(n: Column, total: Column, mean: Column, m2: Column, least: Column, most: Column, nans: Column) -> Column:
    return F.struct(
        n.cast("bigint").alias("n"), total.alias("total"), mean.alias("mean"), m2.alias("m2"),
        least.alias("least"), most.alias("most"), nans.cast("bigint").alias("nans"),
    )


def _of_one(x: Column) -> Column:
    """Part of a single element; of none for a null."""
    x = x.cast("double")
    some = x.isNotNull()
    return _part(
        some.cast("int"), F.coalesce(x, F.lit(0.0)), F.coalesce(x, F.lit(0.0)), F.coalesce(x * 0.0, F.lit(0.0)),
        F.coalesce(x, F.lit(INF)), F.coalesce(x, F.lit(-INF)), F.coalesce(F.isnan(x), F.lit(False)).cast("int"),
    )


def _merged(parts: Column) -> Column:
    """One part of an array of parts; means and squares are merged pair by pair."""
    zero = F.lit(0.0)
    nothing = _part(F.lit(0), zero, zero, zero, F.lit(INF), F.lit(-INF), F.lit(0))

    def both(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        apart = b["mean"] - a["mean"]
        joined = _part(
            n, a["total"] + b["total"], a["mean"] + apart * b["n"] / n,
            a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n,
            F.least(a["least"], b["least"]), F.greatest(a["most"], b["most"]), a["nans"] + b["nans"],
        )
        return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(joined)

    return F.aggregate(parts, nothing, both)


_STATISTICS = {
    "sum": lambda p: p["total"],
    "max": lambda p: p["most"],
    "min": lambda p: F.when(p["nans"] > 0, F.lit(NAN)).otherwise(p["least"]),
    "mean": lambda p: F.when(p["n"] > 0, p["mean"]).otherwise(F.lit(NAN)),
    "var": lambda p: F.when(p["n"] > 1, p["m2"] / (p["n"] - 1)).otherwise(F.lit(NAN)),
    "varp": lambda p: F.when(p["n"] > 0, p["m2"] / p["n"]).otherwise(F.lit(NAN)),
    "stddev": lambda p: F.sqrt(_STATISTICS["var"](p)),
    "stddevp": lambda p: F.sqrt(_STATISTICS["varp"](p)),
}


def slice_fault(lo: Column, hi: Column, length: Column) -> Column:
    """Why a slice can't be taken of a vector of this length; null if it can."""
    return (
        F.when(lo.isNull() | hi.isNull(), F.lit("slice without bounds"))
        .when((lo < 0) | (lo > hi), F.lit("slice bounds out of order"))
        .when(hi > length, F.lit("slice bounds out of range"))
    )


def runs(lo: Column, hi: Column, levels: int) -> Column:
    """Array of (level, parent, first, end): blocks that together are the positions ``[lo, hi)``.

    A run holds the blocks ``[first, end)`` of a level, all children of the block ``parent`` of the next.
    """
    fan = 1 << FANOUT_BITS

    def run(level: int, parent: Column, first: Column, end: Column, only: Column) -> Column:
        found = F.struct(F.lit(level).alias("level"), parent.alias("parent"), first.alias("first"), end.alias("end"))
        return F.when(only & (first < end), found)

    def cover(level: int) -> tuple[Column, Column]:
        width = 1 << FANOUT_BITS * level
        return F.ceil(lo / width).cast("bigint"), F.floor(hi / width).cast("bigint")

    found = []
    for level in range(levels):
        (first, end), (above, above_end) = cover(level), cover(level + 1)
        # Blocks left and right of the parents that the slice holds whole; or all lie inside one parent.
        apart = above <= above_end
        found += [
            run(level, above - 1, first, above * fan, apart),
            run(level, above_end, F.when(apart, above_end * fan).otherwise(first), end, F.lit(True)),
        ]
    return F.array_compact(F.array(*found))


def whole_blocks(lo: Column, hi: Column, levels: int) -> Column:
    """Array of (level, block) that together are the positions ``[lo, hi)``."""
    return F.flatten(F.transform(runs(lo, hi, levels), lambda r: F.transform(
        F.sequence(r["first"], r["end"] - 1), lambda b: F.struct(r["level"].alias("level"), b.alias("block"))
    )))


class SliceTree:
    """Blocks over the vectors ``x`` of the groups ``by``, positions by ``order`` (total); written once."""

    def __init__(self, df: DataFrame, by: list[str], order: Sequence[str], x: str, group_rows: int | None = None):
        self.by = by
        narrow = df.select(*dict.fromkeys([*by, *order, x]))
        placed = with_ordinal(narrow, by, list(order), "_position", group_rows)
        elements = placed.select(*by, F.col("_position").alias("_at"), F.col(x).cast("double").alias("_child"))
        #: Per level a table (by, block, children): what the blocks of 32 are made of, in order.
        self.tables = [self._children(elements)]
        lowest = self.tables[0]
        self.lengths = lowest.groupBy(*by).agg(
            F.max(F.col("block") * (1 << FANOUT_BITS) + F.size("children")).alias("_length")
        )
        longest = self.lengths.agg(F.max("_length")).first()[0] or 0
        while longest >> FANOUT_BITS * self.levels:
            whole = self.tables[-1].select(*by, F.col("block").alias("_at"), self._parts(self.levels - 1).alias("_child"))
            self.tables.append(self._children(whole))

    @property
    def levels(self) -> int:
        return len(self.tables)

    def _children(self, rows: DataFrame) -> DataFrame:
        # At most 32, in order, so that sums don't depend on who comes first.
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_child"))), lambda c: c["_child"])
        block = F.shiftright("_at", FANOUT_BITS).alias("block")
        return cut(rows.groupBy(*self.by, block).agg(ordered.alias("children")), "slice-blocks")

    @staticmethod
    def _parts(level: int, first: Column | None = None, end: Column | None = None) -> Column:
        """One part of all children, or of those with the numbers ``[first, end)``."""
        children = F.col("children")
        if first is not None:
            children = F.slice(children, (first % (1 << FANOUT_BITS) + 1).cast("int"), (end - first).cast("int"))
        return _merged(children if level else F.transform(children, _of_one))

    def answer(self, slices: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
        """``slices`` (by, lo, hi and any other columns, all kept) with the statistics ``names``.

        Bounds outside a vector end the job with ``strict``; else the row gets its reason in
        ``fault`` and null statistics. An empty slice gives NaN, infinities or 0.
        """
        lengths, bounds = self.lengths, [*self.by, "lo", "hi"]
        asked = cut(slices, "slices")
        sized = asked.join(lengths, same_group(asked, lengths, self.by), "left").select(
            *[asked[c] for c in asked.columns], F.coalesce("_length", F.lit(0).cast("bigint")).alias("_length")
        )
        fault = slice_fault(F.col("lo"), F.col("hi"), F.col("_length"))
        if strict:
            stop = F.when(fault.isNotNull(), F.raise_error(F.concat_ws(
                " ", fault, F.lit("of length"), F.col("_length").cast("string")
            )).cast("bigint"))
            sized = sized.withColumn("lo", F.coalesce(stop, F.col("lo")))
        judged = cut(sized.withColumn("fault", fault), "slices-judged")
        # Written, as the ids depend on the layout of tasks.
        different = cut(
            judged.filter("fault IS NULL").select(*bounds).distinct()
            .withColumn("_slice", F.monotonically_increasing_id()), "slices-different",
        )
        pieces = different.select(
            *self.by, "_slice", F.inline(runs(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), self.levels))
        )

        def found(level: int) -> DataFrame:
            wanted, table = pieces.filter(F.col("level") == level).drop("level"), self.tables[level]
            wanted = wanted.withColumnRenamed("parent", "block")
            # By its files Spark takes either side for small: slices are counted before they become pieces, and blocks
            # are compressed. Merging keeps both out of the driver.
            return wanted.join(table.hint("merge"), same_group(wanted, table, [*self.by, "block"])).select(
                "_slice", F.lit(level).alias("level"), wanted["block"],
                self._parts(level, F.col("first"), F.col("end")).alias("part"),
            )

        met = found(0)
        for level in range(1, self.levels):
            met = met.unionByName(found(level))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("level", "block", "part"))), lambda p: p["part"])
        whole = met.groupBy("_slice").agg(parts.alias("_parts"))
        part = _merged(F.coalesce("_parts", F.array().cast(whole.schema["_parts"].dataType)))
        values = [_STATISTICS[n](F.col("_part")).alias(f"_{n}") for n in names]
        answers = different.join(whole.hint("merge"), "_slice", "left").withColumn("_part", part).select(*bounds, *values)
        return judged.join(answers.hint("merge"), same_group(judged, answers, bounds), "left").select(
            *[judged[c] for c in slices.columns], *([] if strict else ["fault"]),
            *[F.when(F.col("fault").isNull(), F.col(f"_{n}")).alias(n) for n in names],
        )
