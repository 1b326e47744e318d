"""Telling hot groups from ordinary ones before an operator that needs whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter.session import cut

# Up to this many rows a group may go through one window task, unless the session
# sets another number. Where there are few groups, this is also what one task holds
# at least, and how long all others wait for it.
GROUP_ROWS = 1_000_000
GROUP_ROWS_SETTING = "spark.hopmeter.groupRows"
# Groups are counted per hash slot, so the count table has at most this many rows.
# Up to about 10^11 rows the mean slot stays below a tenth of the limit above, so
# slots do not look hot just because the table is big.
SLOTS = 1 << 20


def slot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def hot_slots(df: DataFrame, keys: list[str], group_rows: int | None = None) -> DataFrame:
    """(_slot) of the hash slots with more rows than a group may have, as a written table."""
    if group_rows is None:
        group_rows = int(df.sparkSession.conf.get(GROUP_ROWS_SETTING, str(GROUP_ROWS)))
    counts = df.groupBy(slot(keys).alias("_slot")).count()
    return cut(counts.filter(F.col("count") > group_rows).select("_slot"), "hot-slots")


def split_hot(
    df: DataFrame, keys: list[str], group_rows: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None when there are none).

    Counting hash slots instead of keys shrinks to ``SLOTS`` rows on the map
    side, however many keys there are. A slot holds whole groups, so one under
    the limit has only groups under the limit; an ordinary group sharing a hot
    slot is merely treated as hot. The list of hot slots is a written table of at
    most ``SLOTS`` integers, empty most of the time.
    """
    listed = hot_slots(df, keys, group_rows)
    if listed.isEmpty():
        return df, None
    marked = df.withColumn("_slot", slot(keys))
    return (
        marked.join(listed, "_slot", "left_anti").drop("_slot"),
        marked.join(listed, "_slot", "left_semi").drop("_slot"),
    )
