import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hopmeter.functions import moments
from hopmeter.operators import summary

ALL = list(moments.ALL)


@pytest.fixture
def stats(spark):
    def run(values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return summary.std_table(df, [], F.col("x"), ALL).first().asDict()
    return run


def test_known_sample(stats):
    got = stats([3.0, 1.0, 2.0, 5.0, 4.0])
    assert (got["min"], got["mean"], got["max"], got["sum"]) == (1.0, 3.0, 5.0, 15.0)
    assert round(got["stddev"], 3) == 1.581
    assert math.isclose(got["varp"], 2.0) and math.isclose(got["stddevp"] ** 2, got["varp"])


def test_empty(stats):
    got = stats([])
    assert (got["max"], got["min"], got["sum"]) == (-math.inf, math.inf, 0.0)
    assert all(math.isnan(got[n]) for n in ["mean", "var", "varp", "stddev", "stddevp"])


def test_single_value(stats):
    got = stats([7.0])
    assert math.isnan(got["var"]) and math.isnan(got["stddev"])
    assert (got["varp"], got["stddevp"], got["mean"]) == (0.0, 0.0, 7.0)


def test_nan_reaches_every_result(stats):
    assert all(math.isnan(x) for x in stats([1.0, math.nan, 3.0]).values())


def test_nulls_are_no_elements(stats):
    got = stats([None, 2.0, None, 4.0])
    assert (got["min"], got["max"], got["mean"], got["var"]) == (2.0, 4.0, 3.0, 2.0)


def test_whole_numbers_do_not_wrap(spark):
    df = spark.createDataFrame([(2**31 - 1,), (2**31 - 1,)], "x int")
    assert summary.std_table(df, [], F.col("x"), ["mean", "sum"]).first()["mean"] == 2**31 - 1


@pytest.mark.parametrize("limit", [1000, 0])
def test_slice(spark, limit):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([9, 3, 1, 2, 5, 4, 9])], "i int, x double")

    def sliced(lo, hi, strict=True):
        return summary.std_slice(
            df.withColumn("g", F.lit(1)), ["g"], ["i"], "x", lo, hi, ALL, strict, limit
        ).first()

    got = sliced(1, 6)
    assert (got["min"], got["max"], got["mean"], round(got["stddev"], 3)) == (1.0, 5.0, 3.0, 1.581)
    empty = sliced(3, 3)
    assert (empty["max"], empty["min"], empty["sum"]) == (-math.inf, math.inf, 0.0)
    assert math.isnan(empty["mean"]) and math.isnan(empty["var"])
    assert sliced(5, 99, strict=False)["sum"] == 13.0
    with pytest.raises(Exception, match="slice bounds out of range"):
        sliced(5, 8)
    with pytest.raises(ValueError):
        sliced(3, 2)


@pytest.mark.parametrize("spread", [3, 100_000])
def test_exact_median(spark, rows, spread):
    rng = random.Random(spread)
    data = [(g, rng.randrange(-spread, spread)) for g in range(9) for _ in range(1 + g * 7)]
    data.append((3, None))
    got = summary.exact_median(spark.createDataFrame(data, "g int, v long"), ["g"], "v")
    want = [(g, statistics.median(v for k, v in data if k == g and v is not None)) for g in range(9)]
    assert rows(got) == want


@pytest.fixture(scope="module")
def latency(spark):
    rng = random.Random(5)
    data = []
    for n in range(60):
        a, b = rng.randrange(1, 50), rng.randrange(1, 50)
        phase = "CREATE" if n % 10 == 0 else "UPDATE"
        data.append((n, n // 10, n % 10, phase, a, b, a + b))
    schema = ("probe_id int, cycle_no int, update_no int, phase string, raw_to_source_ms long, "
              "source_to_update_ms long, total_ms long")
    return data, spark.createDataFrame(data, schema)


def test_summary(latency):
    data, df = latency
    got = {r["metric"]: r for r in summary.latency_summary(df).collect()}
    for i, metric in [(4, "raw_to_source_ms"), (5, "source_to_update_ms"), (6, "total_ms")]:
        values = [row[i] for row in data]
        r = got[metric]
        assert r["n"] == len(values) and math.isclose(r["mean"], statistics.mean(values))
        assert r["median"] == statistics.median(values)
        assert math.isclose(r["stddev"], statistics.pstdev(values))
    approx = {r["metric"]: r["median"] for r in summary.latency_median(df, approx=True).collect()}
    assert abs(approx["total_ms"] - got["total_ms"]["median"]) <= 5


def test_no_latencies_give_null_statistics(latency):
    _, df = latency
    got = summary.latency_summary(df.filter("false")).collect()
    assert [(r["n"], r["mean"], r["median"], r["stddev"]) for r in got] == [(0, None, None, None)] * 3


@pytest.mark.parametrize("limit", [1000, 0])
def test_cycles_collected_in_order(latency, limit):
    data, df = latency
    got = summary.cycle_collect(df, ["total_ms"], group_rows=limit).orderBy("cycle_no", "position").collect()
    assert [r["position"] for r in got] == list(range(10)) * 6
    assert [(r["cycle_no"], r["update_no"], r["total_ms"]) for r in got] == [(row[1], row[2], row[6]) for row in data]


def test_a_null_group_has_a_median(spark):
    df = spark.createDataFrame(
        [("a", 1, 2, 3), ("a", 3, 4, 7), (None, 5, 6, 11), (None, 9, 6, 15)],
        "phase string, raw_to_source_ms long, source_to_update_ms long, total_ms long")
    got = {(r["phase"], r["metric"]): (r["n"], r["median"]) for r in summary.latency_summary(df, ["phase"]).collect()}
    assert len(got) == 6
    assert got["a", "raw_to_source_ms"] == (2, 2.0) and got[None, "raw_to_source_ms"] == (2, 7.0)
    assert got[None, "total_ms"] == (2, 13.0)


@pytest.mark.parametrize("limit", [1000, 0])
def test_metrics_sorted_each_by_itself(latency, limit):
    data, df = latency
    got = summary.metric_sorted(df, "probe_id", limit).orderBy("metric", "position").collect()
    total = [(r["position"], r["value"]) for r in got if r["metric"] == "total_ms"]
    assert total == list(enumerate(sorted(row[6] for row in data)))
