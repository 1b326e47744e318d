import json

import pytest
from pyspark.sql import functions as F

from hopmeter import session
from hopmeter.operators import probes
from hopmeter.operators.skew import GROUP_ROWS
from hopmeter.schemas import TOPIC_TABLE
from hopmeter.session import fresh_path, shared_folder
from hopmeter.sources import topics as T


@pytest.fixture(scope="module")
def table(spark):
    data = [("a", 0, o) for o in range(5)] + [("a", 1, o) for o in range(7, 9)] + [("b", 0, 0)]
    df = spark.createDataFrame(data, "topic string, partition int, offset long")
    return df.select(
        "*", F.timestamp_millis(F.col("offset") * 1000).alias("timestamp"), F.lit("{}").alias("value")
    ).to(TOPIC_TABLE)


def test_end_offsets(spark, table, rows):
    known = spark.createDataFrame([("a", 0), ("a", 1), ("c", 0), ("c", 0)], "topic string, partition int")
    assert rows(T.end_offsets(table, known)) == [("a", 0, 5), ("a", 1, 9), ("c", 0, 0)]
    assert rows(T.end_offsets(table)) == [("a", 0, 5), ("a", 1, 9), ("b", 0, 1)]


def test_scan_and_bounds(spark, table, rows):
    bounds = spark.createDataFrame([("a", 0, 3), ("a", 1, 0)], "topic string, partition int, base_offset long")
    want = [("a", 0, 3), ("a", 0, 4), ("a", 1, 7), ("a", 1, 8)]
    assert rows(T.scan_from(table, bounds), "topic", "partition", "offset") == want
    assert T.scan(table, ["a"], [1]).count() == 2
    text = T.starting_offsets_json(bounds).first()["starting_offsets"]
    assert json.loads(text) == {"a": {"0": 3, "1": 0}}
    odd = spark.createDataFrame([('q"uote', 10, 1), ('q"uote', 9, 2)], "topic string, partition int, base_offset long")
    assert T.starting_offsets_json(odd).first()[0] == '{"q\\"uote":{"9":2,"10":1}}'
    marks = spark.createDataFrame([("a", 0, 3), ("a", 0, 2), ("a", None, None)], bounds.schema)
    assert rows(T.least_bounds(marks)) == [("a", 0, 2)]
    options = T.kafka_options("host:9092", {"a": [0, 1]}, text)
    assert json.loads(options["assign"]) == {"a": [0, 1]}


def test_written_table_reads_back_and_prunes(spark, table):
    path = fresh_path(spark, "test-topics")
    T.write_topics(table, path)
    back = T.read_topics(spark, path)
    assert sorted(back.collect()) == sorted(table.collect())
    plan = T.scan(back, ["a"], [0]).filter("offset >= 3")._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "topic" in folders and "partition" in folders and "GreaterThanOrEqual(offset,3)" in plan
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        T.write_topics(table, path)


def test_since_reaches_the_scan(spark, table):
    path = fresh_path(spark, "test-since")
    T.write_topics(table, path)
    recent = T.since(T.read_topics(spark, path), 3000)
    assert sorted(r["offset"] for r in recent.collect()) == [3, 4, 7, 8]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,1970-01-01" in plan
    assert T.since(table, None).count() == 0


def test_folder_comes_from_the_session(spark):
    class Stub:
        conf = {"spark.checkpoint.dir": "s3a://team/checkpoints/"}

    assert shared_folder(Stub) == "s3a://team/checkpoints"

    class Cluster:
        conf = {}

        class sparkContext:
            master = "yarn"

    Cluster.conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)


def test_own_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_own_folder", lambda s: f"{shared_folder(s)}/hopmeter/drop-test")
    kept = fresh_path(spark, "x")
    frame = session.cut(spark.range(3), "y")
    assert frame.count() == 3 and kept.startswith(f"{shared_folder(spark)}/hopmeter/drop-test/x-")
    session.drop_stage_tables(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(frame.inputFiles()[0])


def test_queries_run_again_after_the_tables_were_dropped(spark):
    from hopmeter.plans import catalog

    query = catalog.queries()["latency_mean"]
    before = sorted(query(spark, "/root/testdata/sf0.001").collect())
    session.drop_stage_tables(spark)
    assert sorted(query(spark, "/root/testdata/sf0.001").collect()) == before


def test_grid(spark, rows):
    cycles = spark.range(3).withColumnRenamed("id", "cycle_no")
    grid = probes.probe_grid(cycles, 4, "s", seed=1)
    assert rows(grid, "cycle_no", "update_no", "lat", "xlong")[:4] == [
        (0, 0, "4.3", "6.4"), (0, 1, "5.3", "7.4"), (0, 2, "6.3", "8.4"), (0, 3, "7.3", "9.4")]
    ids = {r["cycle_no"]: set() for r in cycles.collect()}
    for r in grid.collect():
        ids[r["cycle_no"]].add(r["id"])
    assert all(len(s) == 1 for s in ids.values()) and len(set.union(*ids.values())) == 3
    assert rows(grid) == rows(probes.probe_grid(cycles, 4, "s", seed=1))
    assert rows(grid, "id") != rows(probes.probe_grid(cycles, 4, "s", seed=2), "id")
    with pytest.raises(ValueError):
        probes.probe_grid(cycles, 0, "s")


def test_long_cycle_unfolds_whole(spark):
    grid = probes.probe_grid(spark.range(1).withColumnRenamed("id", "cycle_no"), 25_001, "s")
    assert grid.agg(F.count("*"), F.countDistinct("update_no"), F.max("update_no")).first()[:] == (25_001, 25_001, 25_000)


def test_entity_ids_are_signed_64_bit(spark):
    from hopmeter.functions.text import entity_id

    ids = [int(r[0].removeprefix("performanceProcess-"))
           for r in spark.range(200).select(entity_id(0, F.col("id"))).collect()]
    assert min(ids) < 0 < max(ids) and all(-2**63 <= i < 2**63 for i in ids)


def test_two_steps(spark, rows):
    got = probes.two_step_probes(spark.range(2).withColumnRenamed("id", "cycle_no"), "s")
    assert rows(got, "cycle_no", "update_no", "action", "lat", "xlong") == [
        (c, n, a, lat, lon) for c in range(2)
        for n, a, lat, lon in [(0, "create", "44.9", "95.8"), (1, "update", "34.66", "48.66")]]


def test_messages_of_probes(spark, rows):
    sent = probes.two_step_probes(spark.range(2).withColumnRenamed("id", "cycle_no"), "s").withColumn("ms", F.lit(5))
    raw = probes.raw_messages(sent, "s")
    assert {r["topic"] for r in raw.collect()} == {"s-raw-data"} and raw.count() == 4
    assert json.loads(raw.first()["value"])["timestamp"] == "5"
    per_topic = probes.entity_messages(sent, "s").groupBy("topic").count()
    assert rows(per_topic) == [("creation", 2), ("s", 4)]


def test_values_are_made_after_the_ranges_are_found(spark, table):
    """Finding the ranges reads the rows once more; the values made by ``finish`` are not part of that."""
    made, path = spark.sparkContext.accumulator(0), fresh_path(spark, "test-finish")

    @F.udf("string")
    def value(offset):
        made.add(1)
        return str(offset)

    T.write_topics(table.drop("value"), path, finish=lambda rows: rows.withColumn("value", value("offset")))
    back = T.read_topics(spark, path).collect()
    assert made.value == len(back) == table.count()
    assert all(r["value"] == str(r["offset"]) for r in back)


def test_a_task_gets_no_more_than_a_million_rows_of_a_group():
    assert GROUP_ROWS <= 1_000_000
