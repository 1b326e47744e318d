"""The stages of the analysis over one data folder, each a written table.

topics -> marks (base offsets), wanted (decoded records) -> hits -> latency, facts
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmeter.operators.baseline import baseline_offsets
from hopmeter.operators.buckets import RecordBuckets
from hopmeter.operators.decode import unify
from hopmeter.operators.first_match import KEY, first_match, keep_probed
from hopmeter.operators.latency import probe_facts, stage_latency
from hopmeter.plans import fixture
from hopmeter.schemas import stage_topics
from hopmeter.session import (
    ON_DROP, cut, discard, drop_stage_tables, forget_shuffles, fresh_path, move, passing, pin_utc, settle,
)
from hopmeter.sources import index
from hopmeter.sources.topics import least_bounds, read_topics, since, write_topics
from hopmeter.streaming import jobs

FILES_PER_BATCH = "64"
# Slices of time in which the streams' rows come, and milliseconds within which a probe is answered.
SLICES, WITHIN = 4, 600_000
# Records of a slice, for large tables have more slices, and slices that are laid out at a time.
SLICE_RECORDS, DEALT = 1_000_000, 16
# Records of a bucket or a state partition: what one task sorts or keeps.
TASK_RECORDS = 500_000
PROBE = ["probe_id", "cycle_no", "update_no"]
_OPEN: dict[tuple, "StageTables"] = {}


class StageTables:
    """Stage tables are written on first use and shared by the later stages."""

    source = fixture.SOURCE

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @property
    def stages(self) -> list[str]:
        return stage_topics(self.source)

    @cached_property
    def probes(self) -> DataFrame:
        return settle(self.spark, lambda: fixture.probes_of(fixture.events(self.spark, self.sf_dir)), "probes")

    @cached_property
    def topics_path(self) -> str:
        path = fresh_path(self.spark, "topics")
        probes = self.probes
        with passing(self.spark):
            write_topics(fixture.placed_messages(probes), path, finish=fixture.with_values)
        index.extend_index(self.spark, path)
        return path

    @property
    def topics(self) -> DataFrame:
        return read_topics(self.spark, self.topics_path)

    @cached_property
    def parts(self) -> int:
        """Buckets, and state partitions of streams: as many as the records need, however large the table is."""
        # Counted in the files' footers.
        return max(self.spark.sparkContext.defaultParallelism, -(-self.topics.count() // TASK_RECORDS))

    def read_records(self) -> DataFrame:
        return unify(self.topics, self.source)

    def find_marks(self) -> DataFrame:
        """Base offsets need positions only: no value is read for them."""
        positions = self.topics.select(
            "topic", "partition", "offset", F.unix_millis("timestamp").alias("ts_ms")
        )
        asked = self.probes.select(*PROBE, "start_time", "id", "lat", "xlong", "partition", "ms")
        return baseline_offsets(positions, asked, self.stages).select(
            *PROBE, "start_time", *KEY, "base_offset"
        )

    @cached_property
    def marks_path(self) -> str:
        path = fresh_path(self.spark, "marks")
        self.find_marks().write.parquet(path)
        forget_shuffles(self.spark)
        return path

    @cached_property
    def marks(self) -> DataFrame:
        return self.spark.read.parquet(self.marks_path)

    @property
    def bounds(self) -> DataFrame:
        """Where reading may start: no probe looks further back."""
        return least_bounds(self.marks)

    @cached_property
    def span(self) -> tuple[int, int]:
        """Moments of the first and the last probe."""
        return tuple(self.probes.agg(F.min("ms"), F.max("ms")).first())

    @property
    def late_probes(self) -> DataFrame:
        """A second batch of probes: those of the later half of the time."""
        return self.probes.filter(F.col("ms") * 2 >= sum(self.span))

    # Streams: what came in slices of time, and a tick at the end that lets all windows close.

    @cached_property
    def slices(self) -> int:
        """As many as the records need: a stream waits for a slice, and its state is some slices, however large the table is."""
        return max(SLICES, -(-self.topics.count() // SLICE_RECORDS))

    @property
    def state_parts(self) -> int:
        """State partitions of streams fed slice by slice: up to three slices of records and of marks wait."""
        least = self.spark.sparkContext.defaultParallelism
        return min(self.parts, max(least, -(-6 * SLICE_RECORDS // TASK_RECORDS)))

    @property
    def lateness(self) -> int:
        """Milliseconds that a row may come behind others: a slice, and the records older than their probes."""
        first, last = self.span
        return (last - first) // self.slices + 120_000

    @property
    def closing(self) -> int:
        first, last = self.span
        return last + 2 * (last - first + WITHIN + self.lateness) + 1

    @cached_property
    def arrivals_path(self) -> str:
        path = fresh_path(self.spark, "arrivals")
        ms = F.unix_millis("timestamp")
        fixture.in_slices(self.topics.withColumn("_ms", ms), "_ms", SLICES, self.span, path)
        fixture.tick(self.topics, self.closing, "timestamp").write.mode("append").parquet(path)
        return path

    def slices_in_turn(self, place: str) -> Iterator[str]:
        """Folders of records and marks, slice by slice and at last ticks; only a few slices lie there at a time.

        Slices of a small table come together.
        """
        at_once = max(1, SLICE_RECORDS * self.slices // max(1, self.topics.count()))
        for start in range(0, self.slices, DEALT):
            some = range(start, min(start + DEALT, self.slices))
            hand = f"{place}/hand-{start}"
            for rows, at, name in ((self.topics, "timestamp", "records"), (self.marks, "start_time", "marks")):
                fixture.dealt(rows, at, self.slices, self.span, some, f"{hand}/{name}")
            for turn in range(start, some.stop, at_once):
                for i in range(turn, min(turn + at_once, some.stop)):
                    for name in ("records", "marks"):
                        move(self.spark, f"{hand}/{name}/slice={i}", f"{hand}/turn-{turn}/{i}/{name}")
                yield f"{hand}/turn-{turn}"
            discard(self.spark, hand)
        # The first moves the watermark, and what it closes goes out as the next comes.
        for i in range(2):
            fixture.tick(self.topics, self.closing + i, "timestamp").write.parquet(f"{place}/tick-{i}/0/records")
            fixture.tick(self.marks, self.closing + i, "start_time").write.parquet(f"{place}/tick-{i}/0/marks")
            yield f"{place}/tick-{i}"

    def record_arrivals(self, path: str | None = None) -> DataFrame:
        """Decoded records as a stream, a tick at its end."""
        arrived = jobs.read_stream(self.spark, path or self.arrivals_path, maxFilesPerTrigger=FILES_PER_BATCH)
        records = unify(arrived, self.source, also=[fixture.CLOCK])
        # The tick has no document.
        is_tick = F.col("topic") == fixture.CLOCK
        return records.withColumns({
            c: F.when(is_tick, F.lit("")).otherwise(F.col(c)) for c in ("id", "lat", "xlong")
        })

    @cached_property
    def stream_hits_path(self) -> str:
        """First hits and misses of a stream of marks over a stream of records, and a tick.

        A slice comes when the one before it is done with, and goes with it.
        """
        out, checkpoint, coming, came = (
            fresh_path(self.spark, name) for name in ("stream-hits", "stream-checkpoint", "stream-coming", "stream-came")
        )
        records = self.record_arrivals(f"{came}/*/*/records")
        marks = jobs.read_batches(self.spark, f"{came}/*/*/marks", self.marks.schema, maxFilesPerTrigger=FILES_PER_BATCH)
        forget_shuffles(self.spark)
        # One slice follows another; what is over goes with the next one, not in a batch of its own.
        with jobs.settings(self.spark, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
            query = jobs.match_probes(
                records, marks, out, checkpoint, self.state_parts, every="0 seconds",
                within=f"{WITHIN} milliseconds", lateness=f"{self.lateness} milliseconds",
            )
        try:
            for i, folder in enumerate(self.slices_in_turn(coming)):
                move(self.spark, folder, f"{came}/{i}")
                query.processAllAvailable()
                discard(self.spark, f"{came}/{i}")
        finally:
            query.stop()
        self._over(checkpoint, coming, came)
        end = fixture.tick(jobs.latest_first(self.spark, out), self.closing + WITHIN, "start_time")
        end.write.parquet(f"{out}/batch=1000000000")
        return out

    @cached_property
    def stream_latency_path(self) -> str:
        """Latencies of that stream, each probe once."""
        out, checkpoint = (fresh_path(self.spark, name) for name in ("stream-latency", "stream-checkpoint"))
        schema = jobs.latest_first(self.spark, self.stream_hits_path).schema
        hits = jobs.read_batches(self.spark, self.stream_hits_path, schema, maxFilesPerTrigger=FILES_PER_BATCH)
        jobs.stage_latencies(
            hits, self.stages, PROBE, out, checkpoint, self.state_parts,
            delay=f"{WITHIN + self.lateness} milliseconds",
        ).awaitTermination()
        self._over(checkpoint)
        return out

    def _over(self, *folders: str) -> None:
        """Nothing goes on from the folders of a stream that has ended."""
        discard(self.spark, *folders)
        forget_shuffles(self.spark)

    def find_wanted(self) -> DataFrame:
        """Decoded records that a probe may match: none is older than the first probe."""
        first = self.probes.agg(F.min("ms")).first()[0]
        return keep_probed(unify(since(self.topics, first), self.source), self.probes)

    @cached_property
    def wanted(self) -> DataFrame:
        return cut(self.find_wanted(), "wanted")

    @cached_property
    def record_buckets(self) -> RecordBuckets:
        return RecordBuckets(self.wanted, self.marks.schema, self.parts)

    def find_hits(self) -> DataFrame:
        return first_match(self.wanted, self.marks)

    @cached_property
    def hits(self) -> DataFrame:
        return cut(self.find_hits(), "hits")

    @cached_property
    def latency(self) -> DataFrame:
        return cut(stage_latency(self.hits, self.stages, PROBE), "latency")

    @cached_property
    def facts(self) -> DataFrame:
        """One row per probe, matched or not: base offsets and hops, for the reports."""
        by = [*PROBE, "start_time", "id", "lat", "xlong"]
        return cut(probe_facts(self.hits, self.stages, by), "facts")


def open_tables(spark: SparkSession, sf_dir: str) -> StageTables:
    """The stage tables of a data folder, shared by all queries of the application."""
    pin_utc(spark)
    # Other files in the folder are other data.
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(fixture.events(spark, sf_dir).inputFiles()))
    if key not in _OPEN:
        _OPEN[key] = StageTables(spark, sf_dir)
    return _OPEN[key]


def _forget(app: str) -> None:
    for key in [k for k in _OPEN if k[0] == app]:
        del _OPEN[key]


ON_DROP.append(_forget)


def close_tables(spark: SparkSession) -> None:
    """Delete the stage tables of this application."""
    drop_stage_tables(spark)


def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage latencies from the topic table on, nothing shared with other queries."""
    shared = open_tables(spark, sf_dir)
    alone = StageTables(spark, sf_dir)
    alone.probes, alone.topics_path = shared.probes, shared.topics_path
    return stage_latency(alone.find_hits(), alone.stages, PROBE)
