"""From first hits to hop latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["raw_to_source_ms", "source_to_update_ms", "total_ms"]


def phase(update_no: Column) -> Column:
    """The first message of a cycle creates the entity, later ones update it."""
    return F.when(update_no == 0, F.lit("CREATE")).otherwise(F.lit("UPDATE"))


def _stage_times(first_hits: DataFrame, topics: list[str], by: list[str]) -> DataFrame:
    """One row per probe with a column per topic; a single shuffle joins all stages."""
    return first_hits.filter(F.col("ts_ms").isNotNull()).groupBy(*by).agg(*[
        F.max(F.when(F.col("topic") == t, F.col("ts_ms"))).alias(f"_t{i}")
        for i, t in enumerate(topics)
    ])


def stage_latency(first_hits: DataFrame, topics: list[str], by: list[str]) -> DataFrame:
    """Three stages: both hops and their sum, for probes seen on every stage.

    ``by`` identifies a probe and has ``update_no``. Negative latencies stay.
    """
    raw, source, update = (F.col(f"_t{i}") for i in range(3))
    hop1, hop2 = source - raw, update - source
    return (
        _stage_times(first_hits, topics, by)
        .filter(raw.isNotNull() & source.isNotNull() & update.isNotNull())
        .select(
            *by,
            phase(F.col("update_no")).alias("phase"),
            hop1.alias("raw_to_source_ms"),
            hop2.alias("source_to_update_ms"),
            (hop1 + hop2).alias("total_ms"),
        )
    )


def stage_latency_2(
    first_hits: DataFrame, source: str, update: str, by: list[str]
) -> DataFrame:
    """Two stages: source to update, for probes seen on both."""
    start, end = F.col("_t0"), F.col("_t1")
    return (
        _stage_times(first_hits.filter(F.col("topic").isin(source, update)), [source, update], by)
        .filter(start.isNotNull() & end.isNotNull())
        .select(
            *by,
            phase(F.col("update_no")).alias("phase"),
            (end - start).alias("source_to_update_ms"),
        )
    )


def probe_facts(first_hits: DataFrame, topics: list[str], by: list[str]) -> DataFrame:
    """Every probe with its three base offsets, and its hops where all stages matched."""
    def per_topic(value: str, names: list[str]) -> list[Column]:
        return [
            F.max(F.when(F.col("topic") == t, F.col(value))).alias(n)
            for t, n in zip(topics, names)
        ]

    wide = first_hits.groupBy(*by).agg(
        *per_topic("base_offset", ["raw_base", "source_base", "update_base"]),
        *per_topic("ts_ms", ["_t0", "_t1", "_t2"]),
    )
    complete = F.col("_t0").isNotNull() & F.col("_t1").isNotNull() & F.col("_t2").isNotNull()
    return wide.select(
        *by, "raw_base", "source_base", "update_base",
        F.when(complete, F.col("_t1") - F.col("_t0")).alias("raw_to_source_ms"),
        F.when(complete, F.col("_t2") - F.col("_t1")).alias("source_to_update_ms"),
    )


def unmatched(first_hits: DataFrame) -> DataFrame:
    """Probes and the topics where no record matched them, with the reason."""
    keyless = F.col("id").isNull() | F.col("lat").isNull() | F.col("xlong").isNull()
    reason = (
        F.when(F.col("base_offset").isNull(), "no base offset").when(keyless, "no key").otherwise("no record")
    )
    return (
        first_hits.filter(F.col("offset").isNull()).withColumn("reason", reason)
        .drop("offset", "ts_ms").withColumnRenamed("topic", "missing_topic")
    )
