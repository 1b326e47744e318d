"""Topic streams: reading, copying, first matches and stage latencies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hopmeter.operators import summary
from hopmeter.operators.first_match import KEY
from hopmeter.operators.latency import stage_latency
from hopmeter.schemas import TOPIC_TABLE
from hopmeter.session import forget_shuffles
from hopmeter.sources.topics import scan_from

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Seconds between two collections of a stream's old shuffle files.
_FORGET_EVERY = 10


def read_stream(
    spark: SparkSession, path: str | None = None, format: str = "parquet", **options: str
) -> DataFrame:
    """Topic table as a stream, from its files or from Kafka, earliest record first."""
    if format == "kafka":
        stream = spark.readStream.format("kafka").options(**options).load()
        return stream.select(*[F.col(f.name).cast(f.dataType) for f in TOPIC_TABLE.fields])
    files = spark.readStream.format(format).schema(TOPIC_TABLE).options(**options).load(path)
    return files.select(*TOPIC_TABLE.fieldNames())


def start(
    stream: DataFrame, checkpoint: str, per_batch: Callable[[DataFrame, int], None],
    mode: str = "append", every: str | None = None,
) -> StreamingQuery:
    """Run over all that is there, or every ``every`` for ever.

    Shuffle files of earlier batches go as the stream runs.
    """
    last = time.monotonic()

    def tidy(batch: DataFrame, batch_id: int) -> None:
        nonlocal last
        if time.monotonic() - last > _FORGET_EVERY:
            forget_shuffles(batch.sparkSession)
            last = time.monotonic()
        per_batch(batch, batch_id)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**trigger).foreachBatch(tidy).start()
    )


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings a stream takes over when it starts; the session gets its own back."""
    saved = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batch_path(out: str, batch_id: int) -> str:
    # A repeated batch replaces what its first try wrote.
    return f"{out}/batch={batch_id}"


def copy_topics(
    stream: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Continuous read into a topic=/partition= table; the checkpoint keeps the position."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.format("parquet").option("path", out).partitionBy("topic", "partition")
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def collect_by_topic(
    stream: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Callback per micro-batch that files the records under their topic."""
    def file_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("topic").parquet(batch_path(out, batch_id))

    return start(stream, checkpoint, file_batch, every=every)


def first_per_key(
    records: DataFrame, bounds: DataFrame, out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Smallest offset per topic and key, at or after the topic partition's bound.

    Each micro-batch writes its own minima, combined inside each task before the
    shuffle; ``latest_first`` takes the minimum over batches when it reads. So no
    state is kept, no record is ever too late, and a repeated batch changes
    nothing. ``compact`` keeps the table small.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        firsts = batch.groupBy(*KEY).agg(F.min(F.struct("offset", "ts_ms")).alias("hit"))
        firsts.select(*KEY, "hit.*").write.mode("overwrite").parquet(batch_path(out, batch_id))

    return start(scan_from(records, bounds), checkpoint, write, every=every)


def match_probes(
    records: DataFrame, marks: DataFrame, out: str, checkpoint: str,
    state_partitions: int | None = None, every: str | None = None,
    within: str | None = None, lateness: str | None = None, sent: str = "start_time",
) -> StreamingQuery:
    """First hits of the probes, where records and ``marks`` both are streams.

    Either side may come first: both wait in the join's state (RocksDB, by key),
    so a probe sent long after the stream began is matched, and nothing is read
    again for a later batch. Each micro-batch writes its minima per probe and
    topic; ``latest_first`` merges them.

    Without ``within`` both sides wait for ever. With it, as an interval such as
    "10 minutes", a hit's broker time lies at most so far behind the probe's time
    ``sent`` (and at most ``lateness`` before it), and rows of either side may come
    ``lateness`` behind the newest of their kind. Rows leave the state when the
    watermark says that nothing can meet them any more. A mark that leaves without a
    hit is written with null ``offset`` and ``ts_ms``, once, and so is a mark that
    nothing can match: every mark ends up in the table, as a hit or as a miss.
    """
    columns = marks.columns
    if within is None:
        pairs = records.select(*KEY, "offset", "ts_ms").join(marks, KEY).filter(F.col("offset") >= F.col("base_offset"))
    else:
        pairs = _match_in_time(records, marks, within, lateness or within, sent)

    def write(batch: DataFrame, batch_id: int) -> None:
        hits = batch.groupBy(*columns).agg(F.min(F.struct("offset", "ts_ms")).alias("hit"))
        hits.select(*columns, "hit.*").write.mode("overwrite").parquet(batch_path(out, batch_id))

    with settings(records.sparkSession, state_settings(state_partitions)):
        return start(pairs, checkpoint, write, every=every)


def _match_in_time(records: DataFrame, marks: DataFrame, within: str, lateness: str, sent: str) -> DataFrame:
    """Marks with every record in their interval, or with nulls once there can't be one."""
    askable = F.col("base_offset").isNotNull() & F.col(sent).isNotNull()
    for c in KEY:
        askable = askable & F.col(c).isNotNull()
    left = marks.filter(askable).withWatermark(sent, lateness)
    right = records.select(
        *[F.col(c).alias(f"_{c}") for c in KEY], "offset", "ts_ms", F.timestamp_millis("ts_ms").alias("_at")
    ).withWatermark("_at", lateness)
    meets = (F.col("offset") >= F.col("base_offset")) & F.expr(
        f"_at >= {sent} - INTERVAL {lateness} AND _at <= {sent} + INTERVAL {within}"
    )
    for c in KEY:
        meets = meets & (F.col(c) == F.col(f"_{c}"))
    met = left.join(right, meets, "left_outer").select(*marks.columns, "offset", "ts_ms")
    nothing = F.lit(None).cast("bigint")
    return met.unionByName(marks.filter(~askable).select("*", nothing.alias("offset"), nothing.alias("ts_ms")))


def read_batches(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """What a job above writes, as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").options(**options).parquet(path)


def stage_latencies(
    hits: DataFrame, topics: list[str], by: list[str], out: str, checkpoint: str,
    state_partitions: int | None = None, every: str | None = None,
    delay: str | None = None, sent: str = "start_time",
) -> StreamingQuery:
    """Hop latencies of a stream of first hits, written when a probe's third stage arrives.

    The state holds the first hit of each stage per probe. A smaller offset that
    arrives late corrects the probe: its row is written again, and
    ``latest_latency`` reads the last one.

    With ``delay``, the time after which no more hits of a probe can come (``within``
    and ``lateness`` of ``match_probes`` together), a probe is written once and for
    all when the watermark of ``sent`` has passed it, and leaves the state.
    """
    hits = hits.filter("offset IS NOT NULL")
    groups = list(by)
    if delay is not None:
        hits = hits.withWatermark(sent, delay)
        groups = [*groups, *([] if sent in by else [sent])]
    first = [
        F.min(F.when(F.col("topic") == t, F.struct("offset", "ts_ms"))).alias(f"_h{i}")
        for i, t in enumerate(topics)
    ]
    stages = hits.groupBy(*groups).agg(*first)

    def write(batch: DataFrame, batch_id: int) -> None:
        times = [F.struct(F.lit(t).alias("topic"), F.col(f"_h{i}.ts_ms").alias("ts_ms")) for i, t in enumerate(topics)]
        rows = batch.select(*by, F.inline(F.array(*times)))
        stage_latency(rows, topics, by).write.mode("overwrite").parquet(batch_path(out, batch_id))

    with settings(hits.sparkSession, state_settings(state_partitions)):
        return start(stages, checkpoint, write, mode="append" if delay else "update", every=every)


def summarize(
    latencies: DataFrame, by: list[str], out: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Statistics of a stream of final latencies: one row per probe, as ``stage_latencies`` with ``delay`` writes.

    Each micro-batch writes what can be merged: count, mean and centred squares per
    group and metric, and how often each value occurs, for the median. No state is kept and a
    repeated batch replaces its first try. ``latest_summary`` merges on read,
    ``compact_summary`` keeps the tables small.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        summary.partial_moments(batch, by).write.mode("overwrite").parquet(batch_path(f"{out}/moments", batch_id))
        summary.value_counts(batch, by).write.mode("overwrite").parquet(batch_path(f"{out}/counts", batch_id))
        batch.unpersist()

    return start(latencies, checkpoint, write, every=every)


def latest_summary(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """``latency_summary`` of all latencies that ``summarize`` has seen."""
    moments, counts = (spark.read.parquet(f"{out}/{name}").drop("batch") for name in ("moments", "counts"))
    return summary.summary_of_parts(moments, counts, by)


def compact_summary(spark: SparkSession, out: str, by: list[str]) -> None:
    """Merge the batches of ``summarize`` into one; call it between runs of the stream."""
    _merge_batches(spark, f"{out}/moments", lambda parts: summary.merge_moments(parts, [*by, "metric"]))
    _merge_batches(spark, f"{out}/counts", lambda parts: summary.merge_counts(parts, [*by, "metric"]))


def state_settings(partitions: int | None) -> dict[str, str]:
    """State in RocksDB; a stream keeps its number of state partitions for life.

    A stream goes on from its last batch or repeats it, so states of older batches are not kept.
    """
    settings = {
        "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
        "spark.sql.streaming.minBatchesToRetain": "2",
        "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
    }
    return settings | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})


def latest_first(spark: SparkSession, out: str, missed: bool = False) -> DataFrame:
    """The table of first hits written above, with one row per key or mark.

    With ``missed`` only the marks given up: a null offset is the least, so a mark that has one
    has no hit, and the hits need not be merged.
    """
    written = spark.read.parquet(out).drop("batch")
    if missed:
        written = written.filter("offset IS NULL")
    keys = [c for c in written.columns if c not in ("offset", "ts_ms")]
    return (
        written.groupBy(*keys).agg(F.min(F.struct("offset", "ts_ms")).alias("hit"))
        .select(*keys, "hit.offset", "hit.ts_ms")
    )


def latest_latency(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """The table of latencies written above, with the last row of each probe."""
    written = spark.read.parquet(out)
    rest = [c for c in written.columns if c not in (*by, "batch")]
    last = F.max_by(F.struct(*rest), "batch").alias("last")
    return written.groupBy(*by).agg(last).select(*by, "last.*")


def compact(spark: SparkSession, out: str) -> None:
    """Merge the batches of a table of first hits into one; call it between runs of the stream.

    The merged batch is written before the others go, and minima merge again to
    the same, so a crash in between loses nothing.
    """
    old, merged = _batches(spark, out)
    latest_first(spark, out).write.mode("overwrite").parquet(batch_path(out, merged))
    _drop(spark, old)


def _batches(spark: SparkSession, out: str) -> tuple[list[str], int]:
    """(folders of the batches, number of the batch that they may be merged into)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(out)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    lowest = min((int(p.getName().removeprefix("batch=")) for p in old), default=0)
    return [p.toString() for p in old], min(lowest, 0) - 1


def _drop(spark: SparkSession, folders: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in folders:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _merge_batches(spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the batches of sums by one.

    Sums must not be read beside what they were made of, so the merged batch lies
    hidden until the others are gone; a crash in between leaves it to the next call.
    """
    jvm = spark.sparkContext._jvm
    hidden = jvm.org.apache.hadoop.fs.Path(f"{out}/_merged")
    fs = hidden.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = jvm.org.apache.hadoop.fs.Path(f"{out}/_merged/_SUCCESS")
    old, number = _batches(spark, out)
    if fs.exists(done):
        # The last call wrote the sums and was ended before all batches were gone; it named them.
        named = [r[0] for r in spark.read.text(f"{out}/_merged_of").collect()]
        old = [f for f in old if f in named]
        number = min([int(f.rsplit("=", 1)[1]) for f in named] + [0]) - 1
    else:
        fs.delete(hidden, True)
        spark.createDataFrame([(f,) for f in old], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/_merged_of")
        merge(spark.read.parquet(*old).drop("batch")).write.parquet(f"{out}/_merged")
    _drop(spark, old)
    fs.rename(hidden, jvm.org.apache.hadoop.fs.Path(batch_path(out, number)))
