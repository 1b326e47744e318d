import random

import pytest
from pyspark.sql import functions as F

from hopmeter.operators.ordinal import in_slice, with_ordinal
from hopmeter.operators.skew import split_hot


def _expected(data):
    out = []
    groups = {}
    for g, t, n in data:
        groups.setdefault(g, []).append((t, n))
    for g, items in groups.items():
        out += [(g, t, n, i) for i, (t, n) in enumerate(sorted(items))]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    # One group holds a third of all rows and many rows share a time.
    return [
        (0 if n % 3 == 0 else rng.randrange(1, 40), rng.randrange(200), n) for n in range(6000)
    ]


@pytest.mark.parametrize("limit", [10_000_000, 500, 0])
def test_positions_do_not_depend_on_the_way_taken(spark, data, limit):
    df = spark.createDataFrame(data, "g int, t int, n int").repartition(7)
    got = with_ordinal(df, ["g"], ["t", "n"], "pos", group_rows=limit)
    assert sorted((tuple(r) for r in got.select("g", "t", "n", "pos").collect()), key=str) == _expected(data)


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (5, 9)], "g int, t int")
    for limit in (100, 0):
        got = {tuple(r) for r in with_ordinal(df, ["g"], ["t"], "pos", limit).collect()}
        assert got == {(None, 1, 0), (None, 2, 1), (5, 9, 0)}


def test_without_group_everything_is_one_vector(spark):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("t")).repartition(5)
    got = with_ordinal(df, [], ["t"], "pos").orderBy("t").collect()
    assert [(r["t"], r["pos"]) for r in got] == [(i + 1, i) for i in range(1000)]


def test_split_keeps_every_row_and_whole_groups(spark, data):
    df = spark.createDataFrame(data, "g int, t int, n int")
    plain, hot = split_hot(df, ["g"], 500)
    assert plain.count() + hot.count() == len(data)
    assert hot.filter("g = 0").count() == 2000
    assert plain.groupBy("g").count().agg(F.max("count")).first()[0] <= 500
    assert split_hot(df, ["g"], 10_000)[1] is None


def test_bad_slice_bounds_fail_early():
    for lo, hi in [(-1, 3), (4, 3)]:
        with pytest.raises(ValueError):
            in_slice("pos", lo, hi)
