"""Later batches of probes against records in buckets: same hits, no shuffle of records."""

import random

import pytest

from hopmeter.operators.buckets import RecordBuckets
from hopmeter.operators.first_match import KEY, first_match

RECORD = "topic string, partition int, id string, lat string, xlong string, offset long, ts_ms long"
MARK = "topic string, partition int, id string, lat string, xlong string, base_offset long, probe_id long, note string"


def _rows(rng, n, keys, last):
    some = lambda: (rng.choice(["a", "b"]), rng.randrange(2), rng.choice(keys), "1", rng.choice(["2", "2", "2", None]))
    return [(*some(), *last(i)) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    keys = ["hot"] * 12 + [f"k{i}" for i in range(20)] + [None]
    records = spark.createDataFrame(_rows(rng, 3000, keys, lambda i: (i * 3, 10_000 + i)), RECORD)
    batches = [
        spark.createDataFrame(_rows(rng, 200, [*keys, "new"], lambda i: (rng.choice([rng.randrange(9500), None, i]), n * 1000 + i, "x")), MARK)
        for n in range(2)
    ]
    return records, batches


@pytest.mark.parametrize("group_rows", [None, 100])
def test_batches_meet_as_in_one_shuffle(spark, data, group_rows):
    """Also where the hot key lies beyond the limit for a group and is cut into offset buckets."""
    records, batches = data
    buckets = RecordBuckets(records, batches[0].schema, 4, group_rows, bucket_offsets=500)
    assert buckets.hot_records.isEmpty() == (group_rows is None)
    for marks in batches:
        got = buckets.match(marks)
        want = first_match(records, marks, group_rows, 500)
        assert sorted(got.collect(), key=str) == sorted(want.select(got.columns).collect(), key=str)
    buckets.drop(spark)


def test_records_are_not_shuffled(spark, data):
    records, batches = data
    buckets = RecordBuckets(records, batches[0].schema, 4)
    plan = buckets.match(batches[0])._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if buckets.name in line)
    depth = lines[scan].index("FileScan") if "FileScan" in lines[scan] else lines[scan].index("Scan")
    above = []
    for line in reversed(lines[:scan]):
        at = len(line) - len(line.lstrip(" :+-"))
        if at < depth:
            depth = at
            above.append(line)
    assert any("Window" in line for line in above) and not any("Exchange" in line for line in above)
    assert "Bucketed: true" in lines[scan]


def test_marks_of_nothing_else_and_no_records(spark, data):
    records, batches = data
    slim = batches[0].select(*KEY, "base_offset")
    got = RecordBuckets(records.limit(0), slim.schema, 2).match(slim)
    assert got.count() == slim.count() and got.filter("offset IS NOT NULL").isEmpty()
    assert RecordBuckets(records, slim.schema, 2).match(slim.limit(0)).isEmpty()
