"""Statistics over latencies and over vectors of numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmeter.functions import moments
from hopmeter.operators.latency import METRICS
from hopmeter.operators.ordinal import in_slice, with_ordinal

# Values per band of the median histogram.
BAND = 1 << 14


def per_metric(df: DataFrame, keep: Sequence[str], name: str = "value") -> DataFrame:
    """Long form: one row per metric."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in METRICS]
    return df.select(*keep, F.inline(F.array(*cells)))


def _aggregate(latency: DataFrame, by: Sequence[str], make: Callable[[Column], Column], name: str) -> DataFrame:
    """One pass over the wide rows, then one output row per metric and group."""
    wide = latency.groupBy(*by).agg(*[make(F.col(m)).alias(m) for m in METRICS])
    return wide.unpivot(list(by), METRICS, "metric", name)


def latency_mean(latency: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _aggregate(latency, by, F.avg, "mean")


def latency_stddev(latency: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Population standard deviation."""
    return _aggregate(latency, by, F.stddev_pop, "stddev")


def latency_median(latency: DataFrame, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Middle value, or the mean of the two middle ones; ``approx`` trades that for one pass."""
    if approx:
        return _aggregate(latency, by, lambda x: F.percentile_approx(x, 0.5).cast("double"), "median")
    return exact_median(per_metric(latency, by), [*by, "metric"], "value")


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    """Join condition on group columns; a null group meets the null group."""
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(right[c])
    return same


def exact_median(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median of whole numbers per group, without holding a group's values.

    Values are counted (combined before the shuffle), the counts are summed per
    band to find the band of the middle ranks, and only that band is ordered.
    A band has at most ``BAND`` different values.
    """
    # The join below tests the band for null; tested here as well, both readers of
    # the counts have one plan and share its shuffle.
    known = F.col(value).isNotNull() & F.floor(F.col(value) / BAND).isNotNull()
    counts = values.filter(known).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return median_of_counts(counts, by)


def median_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Exact median per group from ``_n``, how often each whole number ``_v`` occurs."""
    counts = counts.withColumn("_band", F.floor(F.col("_v") / BAND))
    bands = counts.groupBy(*by, "_band").agg(F.sum("_n").alias("_rows"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Ranks count from 1; with an odd total both middle ranks are the same.
    middle = (
        bands.select(
            *by, "_band", "_rows",
            F.sum("_rows").over(upto).alias("_upto"),
            F.sum("_rows").over(whole).alias("_total"),
        )
        .withColumn("_low", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_high", F.floor(F.col("_total") / 2) + 1)
        .filter("_upto >= _low AND _upto - _rows < _high")
        .select(*by, "_band", "_low", "_high", (F.col("_upto") - F.col("_rows")).alias("_before"))
    )
    in_band = (
        Window.partitionBy(*by, "_band").orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    own = [*by, "_band"]
    middle = middle.withColumnsRenamed({c: f"_m_{c}" for c in own})
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    ranked = counts.join(middle, same).drop(*[f"_m_{c}" for c in own]).withColumn(
        "_last", F.col("_before") + F.sum("_n").over(in_band)
    )

    def at_rank(rank: str) -> Column:
        covers = (F.col("_last") >= F.col(rank)) & (F.col("_last") - F.col("_n") < F.col(rank))
        return F.max(F.when(covers, F.col("_v")))

    return ranked.groupBy(*by).agg(((at_rank("_low") + at_rank("_high")) / 2.0).alias("median"))


def latency_summary(latency: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median and population deviation of every metric, per group."""
    moments_of = {"n": F.count, "mean": F.avg, "stddev": F.stddev_pop}
    wide = latency.groupBy(*by).agg(*[
        F.struct(*[make(F.col(m)).alias(n) for n, make in moments_of.items()]).alias(m)
        for m in METRICS
    ])
    long = wide.unpivot(list(by), METRICS, "metric", "_s").select(*by, "metric", "_s.*")
    medians = latency_median(latency, by)
    return long.join(medians, same_group(long, medians, [*by, "metric"]), "left").select(
        *[long[c] for c in [*by, "metric"]], "n", "mean", "median", "stddev"
    )


def partial_moments(latency: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, n, mean, m2): count, mean and sum of squares about it, to be merged."""
    wide = latency.groupBy(*by).agg(*[
        F.struct(
            F.count(m).alias("n"), F.avg(m).alias("mean"), (F.var_pop(m) * F.count(m)).alias("m2"),
        ).alias(m)
        for m in METRICS
    ])
    long = wide.unpivot(list(by), METRICS, "metric", "_s").select(*by, "metric", "_s.*")
    return long.filter("n > 0")


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Parts of a group as one: squares about the parts' means, and the means' own about the common mean."""
    n = F.sum("n")
    whole = parts.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(
        n.alias("_n"), (F.sum(F.col("n") * F.col("mean")) / n).alias("_mean")
    )
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    about = parts.join(whole, same).select(
        *by, "_n", "_mean",
        (F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("_m2"),
    )
    return about.groupBy(*by, F.col("_n").alias("n"), F.col("_mean").alias("mean")).agg(F.sum("_m2").alias("m2"))


def value_counts(latency: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, _v, _n): how often each value occurs."""
    long = per_metric(latency, by).filter("value IS NOT NULL")
    return long.groupBy(*by, "metric", F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def merge_counts(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "_v").agg(F.sum("_n").alias("_n"))


def summary_of_parts(moments: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``latency_summary`` from the parts of any number of batches."""
    groups = [*by, "metric"]
    whole = merge_moments(moments, groups)
    medians = median_of_counts(merge_counts(counts, groups), groups)
    return whole.join(medians, same_group(whole, medians, groups), "left").select(
        *[whole[c] for c in groups], "n", "mean", "median", F.sqrt(F.col("m2") / F.col("n")).alias("stddev")
    )


def phase_vectors(latency: DataFrame, keep: list[str]) -> DataFrame:
    """The metric vectors split into CREATE and UPDATE, in long form."""
    return per_metric(latency, [*keep, "phase"])


def cycle_collect(
    latency: DataFrame, fields: list[str], order: Sequence[str] = ("update_no",), group_rows: int | None = None
) -> DataFrame:
    """Probes of a cycle in order: one row per probe with its ``position`` in the cycle."""
    placed = with_ordinal(
        latency.select(*dict.fromkeys(["cycle_no", *order, *fields])), ["cycle_no"], list(order), "position", group_rows
    )
    return placed.select("cycle_no", "position", *order, *fields)


def metric_sorted(
    latency: DataFrame, tie_break: str, group_rows: int | None = None
) -> DataFrame:
    """Every metric sorted by itself; ``position`` is the place in that order."""
    long = per_metric(latency, [tie_break])
    placed = with_ordinal(long, ["metric"], ["value", tie_break], "position", group_rows)
    return placed.select("metric", "position", "value")


def std_table(df: DataFrame, by: list[str], x: Column, names: list[str]) -> DataFrame:
    """Chosen statistics of ``x`` per group; with no group, one row even for no input."""
    return df.groupBy(*by).agg(*[moments.ALL[n](x).alias(n) for n in names])


def std_slice(
    df: DataFrame,
    by: list[str],
    order: list[str],
    x: str,
    lo: int,
    hi: int,
    names: list[str],
    strict: bool = True,
    group_rows: int | None = None,
) -> DataFrame:
    """Statistics over positions ``[lo, hi)`` of every group.

    A group shorter than ``hi`` is an error with ``strict``, otherwise the slice
    is clipped to it. An empty slice keeps its group and gives NaN, infinities or
    0. Rows outside the slice are masked, not filtered, for that reason.
    """
    inside = in_slice("_position", lo, hi)
    placed = with_ordinal(df.select(*dict.fromkeys([*by, *order, x])), by, order, "_position", group_rows)
    masked = F.when(inside, F.col(x))
    results = placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_length"),
        *[moments.ALL[n](masked).alias(n) for n in names],
    )
    if strict:
        too_short = F.raise_error(F.concat(
            F.lit(f"slice bounds out of range: [{lo}, {hi}) of "), F.col("_length").cast("string")
        ))
        results = results.withColumn(
            "_length", F.when(F.col("_length") >= hi, F.col("_length")).otherwise(too_short)
        ).filter(F.col("_length") >= 0)
    return results.drop("_length")
