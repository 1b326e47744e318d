"""Aggregate expressions with array-library edge rules.

A vector is the rows of a group. Unlike plain Spark aggregates these return NaN
or an infinity, not NULL, where the vector is empty, and NaN wherever any
element is NaN. NULL rows are not part of the vector.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))


def std_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def std_max(x: Column) -> Column:
    return F.coalesce(F.max(x.cast("double")), F.lit(float("-inf")))


def std_min(x: Column) -> Column:
    # Spark orders NaN last, so a minimum would skip it.
    x = x.cast("double")
    return (
        F.when(F.max(F.isnan(x) & x.isNotNull()), F.lit(float("nan")))
        .otherwise(F.coalesce(F.min(x), F.lit(float("inf"))))
    )


def std_mean(x: Column) -> Column:
    return _or_nan(F.avg(x.cast("double")))


def std_var(x: Column) -> Column:
    """Sample variance; NaN for fewer than two elements."""
    return _or_nan(F.var_samp(x.cast("double")))


def std_varp(x: Column) -> Column:
    """Population variance."""
    return _or_nan(F.var_pop(x.cast("double")))


def std_stddev(x: Column) -> Column:
    return _or_nan(F.stddev_samp(x.cast("double")))


def std_stddevp(x: Column) -> Column:
    return _or_nan(F.stddev_pop(x.cast("double")))


ALL = {
    "sum": std_sum,
    "max": std_max,
    "min": std_min,
    "mean": std_mean,
    "var": std_var,
    "varp": std_varp,
    "stddev": std_stddev,
    "stddevp": std_stddevp,
}
