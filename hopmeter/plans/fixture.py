"""Topic tables derived from the ``events`` table.

One user is one cycle; its events in time order are the cycle's probes. The
derived topics have lost records, later re-deliveries and stale records from
before a probe's baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmeter.functions import codec
from hopmeter.operators.ordinal import with_ordinal
from hopmeter.operators.probes import coordinates, number_updates
from hopmeter.schemas import ENTITY_ID_PREFIX, UPDATE_TOPIC, raw_topic

SOURCE = "src"
PARTITIONS = 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def probes_of(events: DataFrame, group_rows: int | None = None) -> DataFrame:
    numbered = number_updates(
        events.select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("start_time")),
        "user_id", ["start_time", "event_id"], group_rows,
    )
    lat, xlong = coordinates(F.col("update_no"))
    return numbered.select(
        F.col("event_id").alias("probe_id"),
        F.col("user_id").alias("cycle_no"),
        "update_no",
        F.concat(F.lit(ENTITY_ID_PREFIX), F.col("user_id").cast("string")).alias("id"),
        lat.alias("lat"),
        xlong.alias("xlong"),
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition"),
        "start_time",
        F.unix_millis("start_time").alias("ms"),
        F.floor("value").alias("v"),
    )


def _arrivals():
    """Which messages a probe leaves behind, as (topic, ts_ms, copy_no) structs."""
    n, ms, v = F.col("probe_id"), F.col("ms"), F.col("v")

    def message(topic: str, ts_ms, copy_no: int, when=None):
        m = F.struct(
            F.lit(topic).alias("topic"), ts_ms.alias("ts_ms"), F.lit(copy_no).alias("copy_no")
        )
        return m if when is None else F.when(when, m)

    return F.array_compact(F.array(
        message(raw_topic(SOURCE), ms, 0),
        message(SOURCE, ms + 1 + v, 0, n % 40 != 7),
        message(SOURCE, ms + 251 + v, 1, n % 10 == 0),
        message(SOURCE, ms - 60000, 2, n % 25 == 4),
        message(UPDATE_TOPIC, ms + 2 + v + n % 97, 0, n % 50 != 3),
        message(UPDATE_TOPIC, ms + 502 + v + n % 97, 1, n % 10 == 5),
    ))


def topics_of(probes: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The topic table, offsets by time of arrival in each topic partition."""
    return with_values(placed_messages(probes, group_rows))


def placed_messages(probes: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The messages of the topic table with their offsets, values still to be made."""
    messages = probes.select("probe_id", "id", "lat", "xlong", "partition", "ms", F.inline(_arrivals()))
    return with_ordinal(
        messages, ["topic", "partition"], ["ts_ms", "probe_id", "copy_no"], "offset", group_rows
    )


def with_values(placed: DataFrame) -> DataFrame:
    record = codec.entity_record(F.col("id"), F.col("lat"), F.col("xlong"), SOURCE)
    value = (
        F.when(F.col("topic") == raw_topic(SOURCE), codec.raw_message(
            F.col("id"), F.col("lat"), F.col("xlong"), SOURCE, F.col("ms")
        ))
        .when(F.col("topic") == SOURCE, codec.entity_message(record))
        .otherwise(codec.update_message(record))
    )
    return placed.select(
        "topic", "partition", "offset", F.timestamp_millis("ts_ms").alias("timestamp"),
        value.alias("value"),
    )


#: Topic of the row that tells a stream how late it is.
CLOCK = "clock"


def in_slices(rows: DataFrame, ms: str, slices: int, span: tuple[int, int], path: str) -> None:
    """Append ``rows`` in ``slices`` slices of time, as they would have come, one write after the other."""
    first, last = span
    width = (last - first) // slices + 1
    for i in range(slices):
        at = F.col(ms) - first
        inside = (at >= i * width) if i else F.lit(True)
        rows.filter(inside & (at < (i + 1) * width) if i < slices - 1 else inside).write.mode("append").parquet(path)


def dealt(rows: DataFrame, at: str, slices: int, span: tuple[int, int], some: range, path: str) -> None:
    """Write the slices of ``some``, of ``slices`` of time, as folders slice=0, slice=1, ... in one pass over ``rows``."""
    first, last = span
    width = (last - first) // slices + 1
    turn = F.floor((F.unix_millis(at) - first) / width)
    turn = F.greatest(F.lit(0), F.least(F.lit(slices - 1), turn)).cast("int")
    # A row without time belongs to no slice.
    here = rows.filter(F.col(at).isNotNull()).withColumn("slice", turn).filter(F.col("slice").between(some[0], some[-1]))
    here.write.partitionBy("slice").parquet(path)


def tick(rows: DataFrame, ms: int, *times: str) -> DataFrame:
    """One row of the shape of ``rows`` that belongs to nothing: a later moment and a key no one has."""
    def value(field):
        if field.name in times:
            at = F.lit(ms) if field.dataType.typeName() == "long" else F.timestamp_millis(F.lit(ms))
            return at.alias(field.name)
        known = {"topic": CLOCK, "partition": -1, "id": "", "lat": "", "xlong": "", "offset": 0, "base_offset": 0}
        return F.lit(known.get(field.name)).cast(field.dataType).alias(field.name)

    return rows.sparkSession.range(1).select(*[value(f) for f in rows.schema.fields])


def spoiled(topics: DataFrame) -> DataFrame:
    """The topic table with some documents cut off, renamed or of other types."""
    value, turn = F.col("value"), F.col("offset") % 11
    half = F.substring(value, F.lit(1), F.floor(F.length(value) / 2).cast("int"))
    return topics.withColumn(
        "value",
        F.when(turn == 1, half)
        .when(turn == 3, F.replace(value, F.lit('"lat":'), F.lit('"lot":')))
        .when(turn == 5, F.regexp_replace(value, '"long":[0-9.E]+', '"long":true'))
        .when(turn == 7, F.replace(value, F.lit("xternalSystemID"), F.lit("xternal")))
        .when(turn == 9, F.lit(None).cast("string")).otherwise(value),
    )
