"""Topic tables: reading, bounding, end offsets, writing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmeter.schemas import TOPIC_TABLE


def read_topics(
    spark: SparkSession, path: str | None = None, format: str = "parquet", **options: str
) -> DataFrame:
    """Topic table from files, or from Kafka with the options of ``kafka_options``."""
    if format == "kafka":
        kafka = spark.read.format("kafka").options(**options).load()
        return kafka.select(*_kafka_columns())
    files = spark.read.format(format).schema(TOPIC_TABLE).options(**options).load(path)
    # Folder columns would otherwise come last.
    return files.select(*TOPIC_TABLE.fieldNames())


def _kafka_columns() -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in TOPIC_TABLE.fields]


def kafka_options(
    servers: str, partitions: dict[str, list[int]], starting_offsets: str = "earliest"
) -> dict[str, str]:
    """Options of Spark's Kafka source for fixed topic partitions."""
    return {
        "kafka.bootstrap.servers": servers,
        "assign": json.dumps(partitions),
        "startingOffsets": starting_offsets,
    }


def starting_offsets_json(bounds: DataFrame) -> DataFrame:
    """Kafka ``startingOffsets`` text, one row, from (topic, partition, base_offset).

    One entry per topic partition; the number of partitions of a Kafka cluster
    bounds the text.
    """

    by_name = lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)

    def as_map(name: str, value: str) -> Column:
        pairs = F.collect_list(F.struct(F.col(name).alias("name"), F.col(value).alias("value")))
        # Sorted before the names become text, so that partition 10 follows 9.
        named = F.transform(F.array_sort(pairs, by_name), lambda x: F.struct(x["name"].cast("string"), x["value"]))
        return F.map_from_entries(named)

    per_topic = bounds.groupBy("topic").agg(as_map("partition", "base_offset").alias("offsets"))
    return per_topic.agg(F.to_json(as_map("topic", "offsets")).alias("starting_offsets"))


def scan(
    topics: DataFrame, names: list[str] | None = None, partitions: list[int] | None = None
) -> DataFrame:
    """Records of the named topics and partitions; prunes a topic=/partition= layout."""
    if names is not None:
        topics = topics.filter(F.col("topic").isin(names))
    if partitions is not None:
        topics = topics.filter(F.col("partition").isin(partitions))
    return topics


def end_offsets(topics: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Next offset to be written per topic partition; 0 for a known but empty one."""
    ends = topics.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    if known is None:
        return ends
    return (
        known.select("topic", "partition").distinct()
        .join(ends, ["topic", "partition"], "left")
        .select("topic", "partition", F.coalesce("end_offset", F.lit(0)).alias("end_offset"))
    )


def least_bounds(marks: DataFrame) -> DataFrame:
    """Smallest base offset per topic partition: nothing older can match any probe."""
    return marks.filter("base_offset IS NOT NULL").groupBy("topic", "partition").agg(
        F.min("base_offset").alias("base_offset")
    )


def scan_from(topics: DataFrame, bounds: DataFrame) -> DataFrame:
    """Records at or after their topic partition's ``base_offset``.

    Bounds have one row per topic partition. How they are joined is left to
    Spark, which measures them: a few are broadcast, and a hot topic partition
    is split.
    """
    bounds = bounds.select("topic", "partition", "base_offset")
    return (
        topics.join(bounds, ["topic", "partition"])
        .filter(F.col("offset") >= F.col("base_offset"))
        .select(*topics.columns)
    )


def since(topics: DataFrame, ms: int | None) -> DataFrame:
    """Records from a moment on; the bound reaches the scan and skips older row groups.

    A base offset lies behind every record older than its probe, so records from
    before the first probe can be left unread when looking for first hits.
    """
    if ms is None:
        return topics.filter("false")
    return topics.filter(F.col("timestamp") >= F.timestamp_millis(F.lit(ms)))


#: Records a file of a topic table holds at most, so that a bound on offsets can leave files unopened.
FILE_RECORDS = 4_000_000


def write_topics(
    topics: DataFrame, path: str, mode: str = "errorifexists", file_records: int = FILE_RECORDS,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write a topic table in a topic=/partition= layout, each file in offset order.

    Ranges over (topic, partition, offset) spread a hot partition over many
    tasks, and the files keep narrow offset ranges for min/max pruning.
    ``index.extend_index`` afterwards keeps those ranges at hand. Finding the ranges
    reads ``topics`` once more; ``finish`` makes the table's columns of its rows, kept
    in order, after that.
    """
    ranged = topics if finish else topics.select(*TOPIC_TABLE.fieldNames())
    ranged = (
        ranged.repartitionByRange("topic", "partition", "offset")
        .sortWithinPartitions("topic", "partition", "offset")
    )
    (
        (finish(ranged) if finish else ranged).select(*TOPIC_TABLE.fieldNames())
        .write.mode(mode).option("maxRecordsPerFile", file_records)
        .partitionBy("topic", "partition").parquet(path)
    )


def write_kafka(topics: DataFrame, servers: str) -> None:
    """Send the records to Kafka (needs Spark's Kafka connector on the class path)."""
    (
        topics.select("topic", F.col("value").cast("string").alias("value"))
        .write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    )
