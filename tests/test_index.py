"""The stored index of a topic table: files and buckets that stay closed."""

import pytest
from pyspark.sql import functions as F

from hopmeter.operators.baseline import baseline_offsets
from hopmeter.plans.stages import open_tables
from hopmeter.schemas import TOPIC_TABLE
from hopmeter.session import fresh_path
from hopmeter.sources import index
from hopmeter.sources.topics import end_offsets, read_topics, scan_from, write_topics

SF_DIR = "/root/testdata/sf0.001"
BUCKET = 3_600_000


@pytest.fixture(scope="module")
def tables(spark):
    return open_tables(spark, SF_DIR)


@pytest.fixture(scope="module")
def path(spark, tables):
    """The topic table in small files, come in two batches, each indexed when it came."""
    path = fresh_path(spark, "test-index")
    late = F.unix_millis("timestamp") * 2 >= sum(tables.span)
    for part in (~late, late):
        write_topics(tables.topics.filter(part), path, "append", file_records=25)
        assert index.extend_index(spark, path, BUCKET) > 10
    assert index.extend_index(spark, path, BUCKET) == 0
    return path


def _positions(df):
    return sorted(tuple(r) for r in df.select("topic", "partition", "offset").collect())


def test_index_lies_beside_the_table_and_counts_its_records(spark, tables, path):
    rows = index.read_index(spark, path)
    assert rows.agg(F.sum("records")).first()[0] == tables.topics.count() == read_topics(spark, path).count()
    assert rows.select("path").distinct().count() == len(read_topics(spark, path).inputFiles())
    assert sorted(index.end_offsets_of_files(spark, path).collect()) == sorted(end_offsets(tables.topics).collect())


def test_scan_opens_only_files_that_can_hold_an_offset(spark, tables, path):
    ends = end_offsets(tables.topics)
    present = len(read_topics(spark, path).inputFiles())
    for share, most in ((0.5, 0.75), (0.9, 0.3), (0.0, 1.0)):
        bounds = ends.select("topic", "partition", F.floor(F.col("end_offset") * share).alias("base_offset"))
        scan = index.scan_from_files(spark, path, bounds)
        assert _positions(scan) == _positions(scan_from(tables.topics, bounds))
        assert len(index.files_from(spark, path, bounds)) == len([f for f in scan.inputFiles() if path in f]) <= most * present
        assert "GreaterThanOrEqual(offset" in scan._jdf.queryExecution().toString()
    nothing = index.scan_from_files(spark, path, ends.select("topic", "partition", F.col("end_offset").alias("base_offset")))
    assert nothing.count() == 0 and nothing.columns == tables.topics.columns


def test_bounds_of_single_partitions(spark, tables, path):
    """A topic partition without a bound isn't read at all."""
    bounds = spark.createDataFrame([("src", 1, 30), ("update", 2, 10**9)], "topic string, partition int, base_offset long")
    files = index.files_from(spark, path, bounds)
    assert files and all(f.startswith("topic=src/partition=1/") for f in files)
    assert _positions(index.scan_from_files(spark, path, bounds)) == _positions(scan_from(tables.topics, bounds))


def test_base_offsets_of_a_second_batch_read_their_buckets_only(spark, tables, path):
    positions = tables.topics.select("topic", "partition", "offset", F.unix_millis("timestamp").alias("ts_ms"))
    late = tables.late_probes.select("probe_id", "partition", "ms")
    few = late.orderBy(F.desc("ms"), "probe_id").limit(3)
    for asked in (few, late, tables.probes.select("probe_id", "partition", "ms")):
        got = index.baseline_from_files(spark, path, asked, tables.stages, BUCKET)
        want = baseline_offsets(positions, asked, tables.stages)
        assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    opened = index.baseline_from_files(spark, path, few, tables.stages, BUCKET).inputFiles()
    data = [f for f in opened if "/_index/" not in f and "topic=" in f]
    assert 0 < len(data) < len(read_topics(spark, path).inputFiles()) / 4


def test_probes_before_all_records_without_time_or_in_unknown_partitions(spark, tables, path):
    asked = spark.createDataFrame([(1, 0, 0), (2, None, 5), (3, 0, None), (4, 99, 2**41), (5, 3, 2**41)], "probe_id long, partition int, ms long")
    positions = tables.topics.select("topic", "partition", "offset", F.unix_millis("timestamp").alias("ts_ms"))
    got = index.baseline_from_files(spark, path, asked, tables.stages, BUCKET)
    want = baseline_offsets(positions, asked, tables.stages).select(*got.columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(got.collect()) == order(want.collect())


def test_topic_names_that_paths_escape(spark):
    path = fresh_path(spark, "test index+%")
    rows = [(f"a b:%{i}", 0, n, n) for i in range(2) for n in range(40)]
    topics = spark.createDataFrame(rows, "topic string, partition int, offset long, s long").select(
        "topic", "partition", "offset", F.timestamp_seconds("s").alias("timestamp"), F.lit("v").alias("value")
    )
    write_topics(topics, path, file_records=10)
    assert index.extend_index(spark, path) >= 8 and index.extend_index(spark, path) == 0
    bounds = spark.createDataFrame([("a b:%1", 0, 35)], "topic string, partition int, base_offset long")
    assert _positions(index.scan_from_files(spark, path, bounds)) == [("a b:%1", 0, n) for n in range(35, 40)]


def test_names_are_made_after_the_grouping(spark):
    path = fresh_path(spark, "index-names")
    spark.createDataFrame([("a", 0, i, None, "v") for i in range(3)], TOPIC_TABLE).write.partitionBy("topic", "partition").parquet(path)
    files = spark.read.schema(TOPIC_TABLE).parquet(path)
    plan = index.rows_of(files, f"{path}/")._jdf.queryExecution().analyzed().toString()
    # The outer step comes first in the text.
    assert 0 <= plan.index("url_decode") < plan.index("Aggregate") and "url_decode" not in plan[plan.index("Aggregate"):]
    names = [r["path"] for r in index.rows_of(files, f"{path.rsplit(':', 1)[-1]}/").select("path").distinct().collect()]
    assert names and all(n.startswith("topic=a/partition=0/") for n in names)
