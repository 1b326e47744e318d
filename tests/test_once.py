"""First record per key, each key told once."""

from pyspark.sql import functions as F

from hopmeter.session import fresh_path
from hopmeter.streaming.once import first_once

RECORD = "topic string, partition int, id string, lat string, xlong string, offset long, ts_ms long"
PAUSE, LATENESS = "2 seconds", "1 second"


class Run:
    def __init__(self, spark):
        self.spark = spark
        place = fresh_path(spark, "test-once")
        self.source, self.out, self.checkpoint = (f"{place}/{n}" for n in ("in", "out", "checkpoint"))
        self.bounds = spark.createDataFrame([("src", 0, 3)], "topic string, partition int, base_offset long")

    def add(self, *rows):
        records = [("src", 0, key, "4.3", "6.4", offset, ms) for key, offset, ms in rows]
        self.spark.createDataFrame(records, RECORD).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(RECORD).parquet(self.source)
        query = first_once(stream, self.bounds, self.out, self.checkpoint, PAUSE, LATENESS, 2)
        query.awaitTermination()
        progress = query.lastProgress
        self.state = progress["stateOperators"][0]["numRowsTotal"] if progress["stateOperators"] else None
        rows = self.spark.read.schema("id string, offset long, batch long").parquet(self.out).collect()
        return sorted((r["id"], r["offset"]) for r in rows)

    def clock(self, ms):
        # A record before the bound tells the time and nothing else.
        self.add(("clock", 0, ms))
        return self.add(("clock", 0, ms))


def test_least_offset_is_told_once_the_key_pauses(spark):
    run = Run(spark)
    assert run.add(("a", 9, 10_000), ("a", 7, 10_100), ("b", 5, 10_200), ("a", 1, 10_000)) == []
    assert run.add(("a", 6, 11_900)) == []
    # The watermark, a second back, has passed two seconds after the last record of the one, not of the other.
    assert run.clock(13_500) == [("b", 5)]
    assert run.add(("a", 8, 13_000)) == [("b", 5)]
    assert run.clock(16_500) == [("a", 6), ("b", 5)]
    assert run.clock(30_000) == [("a", 6), ("b", 5)]
    # Seen again after its pause it is a new key.
    run.add(("b", 20, 31_000))
    assert run.clock(40_000) == [("a", 6), ("b", 5), ("b", 20)]


def test_keys_leave_the_state(spark):
    run = Run(spark)
    run.add(*[(f"k{i}", 10 + i, 20_000 + i) for i in range(50)])
    assert run.state >= 50
    assert len(run.clock(26_000)) == 50
    assert run.state == 0


def test_each_key_once_as_the_merged_table_has_it(spark):
    from hopmeter.plans import catalog

    sf_dir = "/root/testdata/sf0.001"
    once = catalog.queries()["stream_first_match_once"](spark, sf_dir)
    merged = catalog.queries()["stream_first_match"](spark, sf_dir)
    key = ["topic", "partition", "id", "lat", "xlong"]
    assert once.count() == once.select(key).distinct().count()
    assert once.exceptAll(merged.select(once.columns)).isEmpty() and once.count() == merged.count()
    assert once.filter(F.col("topic") == "clock").isEmpty()


def test_state_and_buckets_grow_with_the_records(spark, monkeypatch):
    from hopmeter.plans import stages

    tables = stages.StageTables(spark, "")
    tables.topics_path = fresh_path(spark, "test-parts")
    spark.range(1000).selectExpr(
        "'src' AS topic", "0 AS partition", "id AS offset", "timestamp_millis(id) AS timestamp", "'' AS value"
    ).write.partitionBy("topic", "partition").parquet(tables.topics_path)
    monkeypatch.setattr(stages, "TASK_RECORDS", 30)
    assert tables.parts == 34
