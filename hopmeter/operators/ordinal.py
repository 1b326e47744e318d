"""Positions of rows inside their group, also where a group outgrows a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmeter.operators.skew import split_hot
from hopmeter.session import cut, forget_shuffles

# monotonically_increasing_id keeps the position inside a partition in its low bits.
_POSITION_BITS = 33


def with_ordinal(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str,
    group_rows: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group; ``order`` must be total.

    Ordinary groups take one shuffle and a window. Groups beyond ``group_rows``
    are sorted across tasks and numbered from per-task counts.
    """
    if not group:
        return _spread_ordinal(df, group, order, name)
    plain, hot = split_hot(df, group, group_rows)
    window = Window.partitionBy(*group).orderBy(*order)
    numbered = plain.withColumn(name, F.row_number().over(window).cast("long") - 1)
    if hot is None:
        return numbered
    return numbered.unionByName(_spread_ordinal(hot, group, order, name))


def _spread_ordinal(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number rows after a range sort, so one group may span many tasks.

    The sorted rows are written once: their task-local positions are then fixed
    for both readers below. ``runs`` has one row per group and sort task, and a
    (group, task) pair is never larger than one sort range, so the join back is
    even whatever the group sizes.
    """
    placed = cut(
        df.orderBy(*group, *order).withColumn("_place", F.monotonically_increasing_id()),
        "ordinal",
    )
    # What the sort has shuffled goes before the next shuffle of as many rows.
    forget_shuffles(df.sparkSession)
    placed = placed.withColumn("_run", F.shiftright("_place", _POSITION_BITS))

    runs = placed.groupBy(*group, "_run").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_run")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = runs.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_run").alias("_task"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same_run = F.col("_run") == F.col("_task")
    for i, c in enumerate(group):
        same_run = same_run & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(shifts, same_run).select(
        *df.columns, (F.col("_place") + F.col("_shift")).alias(name)
    )


def in_slice(position: str, lo: int, hi: int) -> Column:
    """Whether a position lies in ``[lo, hi)``; bad bounds fail while the plan is built."""
    if lo < 0 or lo > hi:
        raise ValueError(f"slice bounds out of order: [{lo}, {hi})")
    return (F.col(position) >= lo) & (F.col(position) < hi)
