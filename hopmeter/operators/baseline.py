"""End offset of every stage topic at the moment a probe was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Width of a time bucket. Inside one there are at most this many distinct
# milliseconds, which bounds the rows of a window group; ten years are about
# five million buckets per partition, which bounds the second level.
BUCKET_MS = 1 << 16


def bucket_of(ms: Column, bucket_ms: int = BUCKET_MS) -> Column:
    return F.floor(ms / bucket_ms)


def asked_buckets(probes: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(partition, bucket) of the time buckets that hold probes."""
    known = probes.select("partition", "ms").dropna()
    return known.select("partition", bucket_of(F.col("ms"), bucket_ms).alias("bucket")).distinct()


def baseline_offsets(
    records: DataFrame, probes: DataFrame, topics: list[str], bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Probes x topics with ``base_offset``, the end offset before the probe's ``ms``.

    ``records``: topic, partition, offset, ts_ms. ``probes``: partition, ms and
    any other columns, all kept. A probe without partition or ``ms`` keeps its rows,
    with a null base offset.

    A running maximum over a topic partition would put a hot partition into one
    task. It is a maximum, so it can be taken in levels instead: over whole time
    buckets, and per millisecond inside the buckets that hold probes. Both levels
    combine records before the shuffle, and all topics share their shuffles.
    """
    records = records.filter(F.col("topic").isin(topics)).select(
        "topic", "partition", "offset", F.col("ts_ms").alias("ms")
    )
    ends = records.select("topic", "partition", bucket_of(F.col("ms"), bucket_ms).alias("bucket"), "offset")
    return offsets_within(ends, records, probes, topics, bucket_ms)


def offsets_within(
    ends: DataFrame, records: DataFrame, probes: DataFrame, topics: list[str], bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """``baseline_offsets`` from ``ends`` (topic, partition, bucket, offset), of which the maxima count,
    and the ``records`` (topic, partition, offset, ms) of at least the buckets that hold probes.
    """
    names = [f"_end{i}" for i in range(len(topics))]
    bucket = bucket_of(F.col("ms"), bucket_ms).alias("bucket")
    asked = probes.select("partition", "ms").dropna().distinct().select("*", bucket)
    with_probes = asked.select("partition", "bucket").distinct()

    def end_per_topic() -> list[Column]:
        return [
            (F.max(F.when(F.col("topic") == t, F.col("offset"))) + 1).alias(name)
            for t, name in zip(topics, names)
        ]

    def no_ends() -> list[Column]:
        return [F.lit(None).cast("long").alias(name) for name in names]

    # Whole earlier buckets; a bucket with probes but no records gets a row too.
    per_bucket = ends.groupBy("partition", "bucket").agg(*end_per_topic())
    earlier = (
        Window.partitionBy("partition").orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        per_bucket.unionByName(with_probes.select("*", *no_ends()))
        .groupBy("partition", "bucket").agg(*[F.max(name).alias(name) for name in names])
        .select("partition", "bucket", *[
            F.max(name).over(earlier).alias(f"_before{name}") for name in names
        ])
    )

    # Earlier milliseconds of the same bucket, where probes ask for them. A record
    # at the probe's own millisecond counts as later (kind 0 sorts first).
    detail = records.select("*", bucket).join(with_probes, ["partition", "bucket"], "left_semi")
    marks = (
        detail.groupBy("partition", "bucket", "ms").agg(*end_per_topic())
        .withColumn("kind", F.lit(1))
        .unionByName(asked.select("*", *no_ends(), F.lit(0).alias("kind")))
    )
    upto = (
        Window.partitionBy("bucket", "partition").orderBy("ms", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = marks.select(
        "partition", "bucket", "ms", "kind",
        *[F.max(name).over(upto).alias(f"_inside{name}") for name in names],
    ).filter("kind = 0")

    base = F.array(*[
        F.struct(
            F.lit(t).alias("topic"),
            F.coalesce(F.greatest(f"_before{name}", f"_inside{name}"), F.lit(0)).alias("base_offset"),
        )
        for t, name in zip(topics, names)
    ])
    answers = inside.join(before, ["partition", "bucket"]).select("partition", "ms", base.alias("base"))
    unknown = F.array(*[
        F.struct(F.lit(t).alias("topic"), F.lit(None).cast("long").alias("base_offset")) for t in topics
    ])
    return probes.join(answers, ["partition", "ms"], "left").select(
        *probes.columns, F.inline(F.coalesce("base", unknown))
    )
