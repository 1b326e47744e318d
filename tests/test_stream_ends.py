"""Streams whose state has an end: matches in time, misses, latencies once, statistics kept up."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hopmeter.operators import summary
from hopmeter.operators.latency import unmatched
from hopmeter.plans.fixture import CLOCK
from hopmeter.plans.stages import open_tables
from hopmeter.session import fresh_path
from hopmeter.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"
RECORD = "topic string, partition int, id string, lat string, xlong string, offset long, ts_ms long"
MARK = (
    "probe_id int, update_no int, start_time timestamp, topic string, partition int, id string, lat string, "
    "xlong string, base_offset long"
)
KEY = (0, "e", "4.3", "6.4")
TOPICS = ["src-raw-data", "src", "update"]


@pytest.fixture(scope="module")
def tables(spark):
    return open_tables(spark, SF_DIR)


class Streams:
    """Folders of records and marks, matched in time as they grow."""

    def __init__(self, spark, within="10 seconds", lateness="2 seconds"):
        self.spark, self.within, self.lateness = spark, within, lateness
        place = fresh_path(spark, "test-ends")
        self.records, self.marks, self.out, self.checkpoint = (f"{place}/{n}" for n in ("records", "marks", "out", "checkpoint"))
        self.run([], [])

    def run(self, records, marks):
        marks = [(p, u, t / 1000, *rest) for p, u, t, *rest in marks]
        at = self.spark.createDataFrame(marks, MARK.replace("timestamp", "double"))
        at = at.withColumn("start_time", F.timestamp_millis((F.col("start_time") * 1000).cast("long")))
        for df, path in ((self.spark.createDataFrame(records, RECORD), self.records), (at, self.marks)):
            df.coalesce(1).write.mode("append").parquet(path)
        stream = self.spark.readStream
        query = jobs.match_probes(
            stream.schema(RECORD).parquet(self.records), stream.schema(at.schema).parquet(self.marks), self.out,
            self.checkpoint, 2, within=self.within, lateness=self.lateness,
        )
        query.awaitTermination()
        progress = query.lastProgress
        self.state = progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else None
        return query

    def found(self):
        rows = jobs.latest_first(self.spark, self.out).select("probe_id", "topic", "offset").collect()
        return sorted((r["probe_id"], r["topic"], r["offset"]) for r in rows if r["topic"] != CLOCK)

    def clock(self, ms):
        """Both sides are told the time."""
        self.run([(CLOCK, -1, "", "", "", 0, ms)], [(0, 0, ms, CLOCK, -1, "", "", "", 0)])


def test_marks_are_met_or_given_up_once(spark):
    s = Streams(spark)
    marks = [(1, 0, 100_000, "src", *KEY, 5), (2, 0, 100_000, "update", *KEY, 5)]
    s.run([("src", *KEY, 4, 99_900), ("src", *KEY, 7, 101_000), ("src", *KEY, 6, 100_500)], marks)
    assert s.found() == [(1, "src", 6)]
    # Before its time is over nothing is said about the other mark; a record may still come.
    s.clock(105_000)
    assert s.found() == [(1, "src", 6)]
    s.clock(200_000)
    s.clock(200_001)
    assert s.found() == [(1, "src", 6), (2, "update", None)]
    hits = jobs.latest_first(spark, s.out).filter(F.col("topic") != CLOCK)
    missed = unmatched(hits).collect()
    assert [(r["probe_id"], r["missing_topic"], r["reason"]) for r in missed] == [(2, "update", "no record")]


def test_a_probe_sent_later_meets_what_came_before_it_and_after(spark):
    s = Streams(spark)
    s.run([("src", *KEY, 9, 100_200)], [])
    s.run([], [(1, 0, 100_000, "src", *KEY, 5)])
    assert s.found() == [(1, "src", 9)]
    s.run([("src", *KEY, 8, 101_000)], [])
    assert s.found() == [(1, "src", 8)]
    # Beyond its interval a record is no hit.
    s.run([("src", *KEY, 30, 131_000)], [(2, 1, 120_000, "src", *KEY, 20)])
    s.clock(300_000)
    s.clock(300_001)
    assert s.found() == [(1, "src", 8), (2, "src", None)]


def test_marks_that_nothing_can_match_are_written_at_once(spark):
    s = Streams(spark)
    marks = [(1, 0, 100_000, "src", *KEY, None), (2, 0, 100_000, "src", 0, None, "4.3", "6.4", 3)]
    s.run([("src", *KEY, 9, 100_200)], marks)
    hits = jobs.latest_first(spark, s.out)
    got = sorted((r["probe_id"], r["reason"]) for r in unmatched(hits).collect())
    assert got == [(1, "no base offset"), (2, "no key")]


def test_state_falls_as_time_goes_on(spark):
    s = Streams(spark)
    most = 0
    for step in range(6):
        ms = 100_000 + step * 60_000
        records = [("src", 0, f"e{step}-{i}", "4.3", "6.4", step * 100 + i, ms + i) for i in range(100)]
        marks = [(step * 100 + i, 0, ms, "src", 0, f"e{step}-{i}", "4.3", "6.4", 0) for i in range(0, 100, 2)]
        s.run(records, marks)
        most = max(most, s.state or 0)
    s.clock(2_000_000)
    s.clock(2_000_001)
    assert most >= 100 and s.state <= 4
    assert s.found() == sorted((step * 100 + i, "src", step * 100 + i) for step in range(6) for i in range(0, 100, 2))


def test_matched_and_unmatched_are_all_probes(spark, tables):
    hits = jobs.latest_first(spark, tables.stream_hits_path).filter(F.col("topic") != CLOCK)
    kept = ["probe_id", "topic", "partition", "base_offset", "offset", "ts_ms"]
    assert sorted(hits.select(kept).collect(), key=str) == sorted(tables.hits.select(kept).collect(), key=str)
    once = spark.read.parquet(tables.stream_latency_path)
    assert once.count() == once.select("probe_id").distinct().count() == tables.latency.count()


# -- statistics ---------------------------------------------------------------------------


def _latencies(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["CREATE", "UPDATE", None]), *(rng.randrange(-50, 10**rng.randrange(1, 6)) for _ in range(2))) for _ in range(n)]
    return spark.createDataFrame([(p, a, b, a + b) for p, a, b in rows], "phase string, raw_to_source_ms long, source_to_update_ms long, total_ms long")


@pytest.mark.parametrize("by", [[], ["phase"]])
def test_summary_of_many_batches_is_that_of_all(spark, by):
    place = fresh_path(spark, "test-summary")
    source, out, checkpoint = f"{place}/in", f"{place}/out", f"{place}/checkpoint"
    key = lambda r: str(tuple(r)[: len(by) + 1])

    def same():
        want = sorted(summary.latency_summary(spark.read.parquet(source), by).collect(), key=key)
        got = sorted(jobs.latest_summary(spark, out, by).collect(), key=key)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert tuple(a)[: len(by) + 2] == tuple(b)[: len(by) + 2] and a["median"] == b["median"]
            assert math.isclose(a["mean"], b["mean"], rel_tol=1e-12) and math.isclose(a["stddev"], b["stddev"], rel_tol=1e-9)

    for seed, n in enumerate([1, 40, 200, 3, 90]):
        _latencies(spark, seed, n).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        jobs.summarize(stream, by, out, checkpoint).awaitTermination()
        if seed == 2:
            jobs.compact_summary(spark, out, by)
            jobs.compact_summary(spark, out, by)
        same()
    # A batch that is tried again replaces its first try.
    last = spark.read.parquet(f"{out}/counts/batch=4")
    last.unionByName(last).write.mode("overwrite").parquet(f"{place}/twice")
    again = _latencies(spark, 4, 90)
    summary.value_counts(again, by).write.mode("overwrite").parquet(f"{out}/counts/batch=4")
    summary.partial_moments(again, by).write.mode("overwrite").parquet(f"{out}/moments/batch=4")
    same()
    jobs.compact_summary(spark, out, by)
    same()


def test_compaction_ended_half_way_is_finished_by_the_next(spark, monkeypatch):
    place = fresh_path(spark, "test-crash")
    out = f"{place}/out"
    for batch in range(3):
        rows = _latencies(spark, batch, 20)
        summary.value_counts(rows).write.parquet(f"{out}/counts/batch={batch}")
        summary.partial_moments(rows).write.parquet(f"{out}/moments/batch={batch}")
    want = sorted(jobs.latest_summary(spark, out, []).select("metric", "n", "median").collect())
    drop = jobs._drop

    def ended(spark, folders):
        drop(spark, folders[:1])
        raise RuntimeError("ended")

    monkeypatch.setattr(jobs, "_drop", ended)
    with pytest.raises(RuntimeError):
        jobs.compact_summary(spark, out, [])
    monkeypatch.setattr(jobs, "_drop", drop)
    jobs.compact_summary(spark, out, [])
    assert sorted(jobs.latest_summary(spark, out, []).select("metric", "n", "median").collect()) == want
    assert len(jobs._batches(spark, f"{out}/moments")[0]) == 1
