import pytest
from pyspark.sql.types import StructType

from hopmeter.operators import decode, latency
from hopmeter.plans.stages import PROBE, open_tables
from hopmeter.session import fresh_path
from hopmeter.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"
RECORD = "topic string, partition int, id string, lat string, xlong string, offset long, ts_ms long"


@pytest.fixture(scope="module")
def tables(spark):
    return open_tables(spark, SF_DIR)


def _places(spark):
    place = fresh_path(spark, "test-stream")
    return f"{place}/in", f"{place}/out", f"{place}/checkpoint"


def _records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def _run_match(spark, stream, marks, out, checkpoint):
    query = jobs.match_probes(stream, marks, out, checkpoint, 2)
    query.awaitTermination()
    return query


def test_many_small_batches_match_like_one_batch_job(spark, tables):
    _, out, checkpoint = _places(spark)
    stream = jobs.read_stream(spark, tables.topics_path, maxFilesPerTrigger="3")
    marks = jobs.read_batches(spark, tables.marks_path, tables.marks.schema, maxFilesPerTrigger="2")
    query = _run_match(spark, decode.unify(stream, "src"), marks, out, checkpoint)
    assert query.lastProgress["batchId"] > 1
    got = latency.stage_latency(jobs.latest_first(spark, out), tables.stages, PROBE)
    assert sorted(got.collect()) == sorted(tables.latency.collect())


MARK = "probe_id int, update_no int, topic string, partition int, id string, lat string, xlong string, base_offset long"
KEY = (0, "e", "4.3", "6.4")


def test_latencies_appear_when_the_third_stage_arrives_and_are_corrected(spark):
    source, hits_out, hits_checkpoint = _places(spark)
    marks_in, out, checkpoint = _places(spark)
    topics = ["src-raw-data", "src", "update"]
    by = ["probe_id", "update_no"]

    def run(records, marks=()):
        for rows, schema, path in ((records, RECORD, source), (marks, MARK, marks_in)):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(RECORD).parquet(source)
        _run_match(spark, stream, spark.readStream.schema(MARK).parquet(marks_in), hits_out, hits_checkpoint)
        schema = MARK + ", offset long, ts_ms long"
        hits = jobs.read_batches(spark, hits_out, StructType.fromDDL(schema))
        jobs.stage_latencies(hits, topics, by, out, checkpoint, 2).awaitTermination()
        return sorted(tuple(r) for r in jobs.latest_latency(spark, out, by).collect())

    first = [(1, 0, t, *KEY, 4) for t in topics]
    assert run([(topics[0], *KEY, 5, 100), (topics[1], *KEY, 6, 130)], first) == []
    assert run([(topics[2], *KEY, 8, 200)]) == [(1, 0, "CREATE", 30, 70, 100)]
    # A smaller offset arrives late and corrects the row.
    assert run([(topics[2], *KEY, 7, 190)]) == [(1, 0, "CREATE", 30, 60, 90)]
    # A probe that is known only now meets records that came before it.
    later = [(2, 1, t, *KEY, 6) for t in topics]
    assert run([(topics[0], *KEY, 9, 150)], later) == [(1, 0, "CREATE", 30, 60, 90), (2, 1, "UPDATE", -20, 60, 40)]


def test_stream_goes_on_where_it_stopped(spark):
    source, out, checkpoint = _places(spark)
    marks_in, _, _ = _places(spark)
    spark.createDataFrame([(1, 0, "src", *KEY, 4)], MARK).write.parquet(marks_in)

    def run(rows):
        _records(spark, rows).coalesce(1).write.mode("append").parquet(source)
        marks = spark.readStream.schema(MARK).parquet(marks_in)
        _run_match(spark, spark.readStream.schema(RECORD).parquet(source), marks, out, checkpoint)
        return [r["offset"] for r in jobs.latest_first(spark, out).collect()]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert run([("src", *KEY, 3, 10)]) == []
    assert run([("src", *KEY, 9, 90)]) == [9]
    # Files may arrive out of offset order; the smaller offset still wins.
    assert run([("src", *KEY, 5, 50)]) == [5]
    assert run([("src", *KEY, 7, 70)]) == [5]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_first_per_key_takes_the_smallest_offset_over_batches(spark):
    key, other = ("src", 0, "e", "4.3", "6.4"), ("src", 0, "f", "4.3", "6.4")
    source, out, checkpoint = _places(spark)
    bounds = spark.createDataFrame([("src", 0, 2)], "topic string, partition int, base_offset long")

    def firsts():
        return {r["id"]: r["offset"] for r in jobs.latest_first(spark, out).collect()}

    def run(rows):
        _records(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RECORD).parquet(source)
        query = jobs.first_per_key(stream, bounds, out, checkpoint)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == []
        return firsts()

    assert run([(*key, 8, 80), (*key, 5, 50), (*key, 1, 10)]) == {"e": 5}
    assert run([(*key, 3, 30), (*other, 9, 90)]) == {"e": 3, "f": 9}
    for _ in range(2):
        jobs.compact(spark, out)
        assert firsts() == {"e": 3, "f": 9} and spark.read.parquet(out).count() == 2
    assert run([(*key, 2, 20), (*other, 11, 95)]) == {"e": 2, "f": 9}


def test_copy_and_collect_hold_every_record(spark, tables):
    for job in (jobs.copy_topics, jobs.collect_by_topic):
        _, out, checkpoint = _places(spark)
        stream = jobs.read_stream(spark, tables.topics_path, maxFilesPerTrigger="4")
        job(stream, out, checkpoint).awaitTermination()
        job(stream, out, checkpoint).awaitTermination()  # nothing new: nothing doubled
        names = ["topic", "partition", "offset", "value"]
        got = spark.read.parquet(out).select(*names)
        assert sorted(got.collect()) == sorted(tables.topics.select(*names).collect())


def test_repeated_batch_replaces_its_first_try(spark):
    out = fresh_path(spark, "test-batch")
    for n in (3, 2):
        spark.range(n).write.mode("overwrite").parquet(jobs.batch_path(out, 0))
    assert spark.read.parquet(out).count() == 2
