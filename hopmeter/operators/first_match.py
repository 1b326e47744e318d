"""First record of each probe per topic, at or after the probe's base offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopmeter.operators.skew import split_hot
from hopmeter.session import cut

KEY = ["topic", "partition", "id", "lat", "xlong"]
# Offsets per bucket of a hot key; offsets are unique inside a topic partition,
# so this also bounds the records of one window group.
BUCKET_OFFSETS = 1 << 20
# Milliseconds per bucket of a hot key when matching by time.
BUCKET_MS = 1 << 22
TIME_KEY = ["topic", "id", "lat", "xlong"]


def keep_probed(records: DataFrame, probes: DataFrame) -> DataFrame:
    """Drop records no probe can match.

    Topics carry all traffic, probes are a sliver of it. Whether the probes are
    broadcast is left to Spark, which measures them.
    """
    keys = ["id", "lat", "xlong"]
    return records.join(probes.select(*keys).distinct(), keys, "left_semi")


def first_match(
    records: DataFrame,
    marks: DataFrame,
    group_rows: int | None = None,
    bucket_offsets: int = BUCKET_OFFSETS,
) -> DataFrame:
    """``marks`` with ``offset`` and ``ts_ms`` of the first hit, null where there is none.

    ``records``: KEY, offset, ts_ms. ``marks``: KEY, base_offset and any other
    columns, all kept; one row per probe and topic. A mark without base offset or
    without a complete key has no hit.

    Records and marks of a key are laid in offset order and each mark takes the
    next record, so the work grows with rows, not with (mark, record) pairs. Keys
    beyond ``group_rows`` are cut into offset buckets.
    """
    extra = [c for c in marks.columns if c not in KEY and c != "base_offset"]
    hit = F.struct(F.col("offset"), F.col("ts_ms"))
    return _match(
        records.select(*KEY, F.col("offset").alias("at"), hit.alias("hit")),
        marks.withColumn("at", F.col("base_offset")), KEY, group_rows, bucket_offsets,
    ).select(*KEY, "base_offset", *extra, "hit.offset", "hit.ts_ms")


def first_match_by_time(
    records: DataFrame,
    probes: DataFrame,
    topics: list[str],
    group_rows: int | None = None,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """``probes`` x ``topics`` with the first record at or after the probe's ``ms``, in any partition.

    For messages sent without a key, which land in any partition: records of a
    topic and key are laid in order of time (then partition, offset), so nothing
    is repeated per partition. ``probes``: id, lat, xlong, ms and any other
    columns, all kept but a partition of their own.
    """
    kept = [c for c in probes.columns if c not in ("id", "lat", "xlong", "partition")]
    marks = probes.select(
        F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"), "id", "lat", "xlong", *kept
    )
    hit = F.struct(F.col("ts_ms"), F.col("partition"), F.col("offset"))
    return _match(
        records.filter(F.col("topic").isin(topics)).select(*TIME_KEY, F.col("ts_ms").alias("at"), hit.alias("hit")),
        marks.withColumn("at", F.col("ms")), TIME_KEY, group_rows, bucket_ms,
    ).select(*TIME_KEY, *kept, "hit.partition", "hit.offset", "hit.ts_ms")


def _match(
    records: DataFrame, marks: DataFrame, key: list[str], group_rows: int | None, bucket: int
) -> DataFrame:
    """``marks`` with ``hit`` of the first record of their key from ``at`` on.

    ``records``: key, at, hit (ordered among equal ``at``). Marks keep all columns.
    """
    extra = [c for c in marks.columns if c not in key and c != "at"]
    askable = F.col("at").isNotNull()
    for c in key:
        askable = askable & F.col(c).isNotNull()
    lane = _lane(records, marks.filter(askable), key, extra)
    plain, hot = split_hot(lane, key, group_rows)
    found = _next_record(plain, key).filter("NOT is_record")
    if hot is not None:
        found = found.unionByName(_bucketed(cut(hot, "hot-keys"), key, bucket))
    rest = marks.filter(~askable).select(
        *key, "at", *extra, F.lit(None).cast(records.schema["hit"].dataType).alias("hit")
    )
    return found.select(*key, "at", *[f"extra.{c}" for c in extra], "hit").unionByName(rest)


def _lane(records: DataFrame, marks: DataFrame, key: list[str], extra: list[str]) -> DataFrame:
    """Records and marks as rows of one shape; ``at`` is where they stand."""
    kept = F.struct(*[F.col(c) for c in extra]) if extra else F.struct(F.lit(0).alias("_"))
    right = marks.select(
        *key, "at", F.lit(False).alias("is_record"),
        F.lit(None).cast(records.schema["hit"].dataType).alias("record"), kept.alias("extra"),
    )
    # A record without id or coordinates cannot match and would pile up on one key.
    whole = F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("xlong").isNotNull()
    left = records.filter(whole).select(
        *key, "at", F.lit(True).alias("is_record"), F.col("hit").alias("record"),
        F.lit(None).cast(right.schema["extra"].dataType).alias("extra"),
    )
    return left.unionByName(right)


def _next_record(lane: DataFrame, group: list[str]) -> DataFrame:
    """Each row with the nearest record at or after it in its group.

    Read backwards, so the frame only grows; a record at a mark's own offset is
    met before the mark.
    """
    # Sorting compares the number first and the texts of the key only within it.
    backwards = (
        Window.partitionBy("_hash", *group).orderBy(F.desc("at"), F.desc("is_record"), F.desc("record"))
    )
    return lane.withColumn("_hash", F.xxhash64(*group)).withColumn(
        "hit",
        F.last("record", ignorenulls=True)
        .over(backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    ).drop("_hash")


def _bucketed(lane: DataFrame, key: list[str], width: int) -> DataFrame:
    """Marks of hot keys with their hits: inside the bucket of ``at``, else in a later one."""
    lane = lane.withColumn("bucket", F.floor(F.col("at") / width))
    cell = [*key, "bucket"]
    records = lane.filter("is_record")
    marks = lane.filter("NOT is_record")

    # Probes standing at one place share the answer, so they become one row.
    points = marks.select(*cell, "at").distinct()
    inside = (
        _next_record(
            records.select(*cell, "at", "is_record", "record").unionByName(
                points.withColumn("is_record", F.lit(False))
                .withColumn("record", F.lit(None).cast(records.schema["record"].dataType))
            ),
            cell,
        )
        .filter("NOT is_record").select(*cell, "at", "hit")
    )

    # First record of every bucket, then of all later buckets of the key.
    heads = lane.groupBy(*cell).agg(F.min_by("record", F.when(F.col("is_record"), F.struct("at", "record"))).alias("head"))
    later = (
        Window.partitionBy(*key).orderBy(F.desc("bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    following = heads.select(*cell, F.last("head", ignorenulls=True).over(later).alias("head"))

    answers = inside.join(following, cell).select(
        *key, "at", F.coalesce("hit", "head").alias("hit")
    )
    return (
        marks.join(answers, [*key, "at"], "left")
        .select(*key, "at", "is_record", "record", "extra", "hit")
    )
