"""What streams keep on disk: some slices of state and input, and nothing once they are over."""

import os

import pytest
from pyspark.sql import functions as F

from hopmeter.operators.latency import unmatched
from hopmeter.operators.skew import GROUP_ROWS_SETTING
from hopmeter.plans import catalog, stages
from hopmeter.plans.fixture import CLOCK
from hopmeter.session import _own_folder, fresh_path
from hopmeter.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark):
    place = fresh_path(spark, "test-events")
    spark.range(600).selectExpr(
        "id AS event_id", "timestamp_millis(1700000000000 + id * 60000) AS ts", "id % 50 AS user_id",
        "'click' AS event_type", "CAST(id % 90 AS DOUBLE) AS value", "'{}' AS props",
    ).coalesce(1).write.parquet(f"{place}/events.parquet")
    return place


def _lying(spark, *labels):
    names = os.listdir(_own_folder(spark).removeprefix("file:"))
    return {n for n in names if n.rsplit("-", 1)[0] in labels}


def test_a_stream_of_many_slices_keeps_a_few_of_them(spark, folder, monkeypatch):
    monkeypatch.setattr(stages, "SLICE_RECORDS", 320)
    monkeypatch.setattr(stages, "DEALT", 4)
    spent = ("stream-checkpoint", "stream-coming", "stream-came", "arrivals", "mark-arrivals")
    before = _lying(spark, *spent)
    tables = stages.StageTables(spark, folder)
    begun, match = [], jobs.match_probes

    def watched(*args, **more):
        begun.append(match(*args, **more))
        return begun[-1]

    monkeypatch.setattr(jobs, "match_probes", watched)
    # A stream's rows are all rows, whatever the number of slices.
    hits = jobs.latest_first(spark, tables.stream_hits_path).filter(F.col("topic") != CLOCK)
    kept = ["probe_id", "topic", "partition", "base_offset", "offset", "ts_ms"]
    assert sorted(hits.select(kept).collect(), key=str) == sorted(tables.hits.select(kept).collect(), key=str)
    # The state is that of some slices.
    rows = tables.topics.count() + tables.marks.count()
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in begun[0].recentProgress if p["stateOperators"])
    assert 0 < most < rows * 0.6
    assert _lying(spark, *spent) == before
    # Latencies come once, and their stream leaves no checkpoint either.
    once = spark.read.parquet(tables.stream_latency_path).drop("batch")
    assert sorted(once.collect()) == sorted(tables.latency.collect()) and once.count() > 500
    assert _lying(spark, *spent) == before


def test_marks_given_up_are_found_without_merging_hits(spark):
    out = fresh_path(spark, "test-missed")
    key = "topic string, partition int, id string, lat string, xlong string"
    schema = f"probe_id int, {key}, base_offset long, offset long, ts_ms long"
    mark = lambda probe, offset, ts: (probe, "src", 0, "e", "4.3", "6.4", 1, offset, ts)
    batches = [[mark(1, 5, 50), mark(2, None, None), mark(3, None, None)], [mark(1, 4, 40), mark(2, None, None), mark(3, 7, 70), mark(4, 9, 9)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(jobs.batch_path(out, i))
    missed = unmatched(jobs.latest_first(spark, out, missed=True))
    assert sorted(missed.collect()) == sorted(unmatched(jobs.latest_first(spark, out)).collect())
    assert sorted(r["probe_id"] for r in missed.collect()) == [2, 3]


def test_tables_on_the_way_to_the_topics_do_not_stay(spark, folder):
    spark.conf.set(GROUP_ROWS_SETTING, "20")
    try:
        before = _lying(spark, "ordinal", "hot-slots")
        hot, plain = stages.StageTables(spark, folder), stages.StageTables(spark, folder)
        assert hot.topics.count() > 1800 and hot.marks.count() == 1800
        assert _lying(spark, "ordinal", "hot-slots") == before
        spark.conf.unset(GROUP_ROWS_SETTING)
        assert sorted(hot.topics.collect()) == sorted(plain.topics.collect())
        assert sorted(hot.probes.collect()) == sorted(plain.probes.collect())
    finally:
        spark.conf.unset(GROUP_ROWS_SETTING)


def test_the_summary_of_the_stream_needs_no_batch_job(spark, folder):
    got = catalog.queries()["stream_latency_summary"](spark, folder).collect()
    tables = stages.open_tables(spark, folder)
    assert not {"wanted", "hits", "latency"} & set(vars(tables))
    want = catalog.queries()["latency_summary"](spark, folder).collect()
    assert sorted(got) == sorted(want) and got[0]["n"] > 500
