"""Many slices answered from a tree of blocks, against a loop over each slice."""

import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopmeter.operators.slices import SliceTree, whole_blocks

NAMES = ["sum", "max", "min", "mean", "var", "varp", "stddev", "stddevp"]


def _want(xs):
    xs = [x for x in xs if x is not None]
    nan, n = math.nan, len(xs)
    if any(math.isnan(x) for x in xs):
        return [nan] * 8 if n > 1 else [nan, nan, nan, nan, nan, nan, nan, nan]
    mean = sum(xs) / n if n else nan
    m2 = sum((x - mean) ** 2 for x in xs)
    var, varp = (m2 / (n - 1) if n > 1 else nan), (m2 / n if n else nan)
    return [sum(xs), max(xs, default=-math.inf), min(xs, default=math.inf), mean, var, varp, math.sqrt(var), math.sqrt(varp)]


def _close(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    sizes = {"a": 1, "b": 32, "c": 33, "d": 1100, "e": 3000, None: 70}
    out = {g: [rng.gauss(1e6, 3.0) for _ in range(n)] for g, n in sizes.items()}
    out["d"][500], out["d"][40], out["c"][7] = math.nan, None, None
    return out


@pytest.fixture(scope="module")
def tree(spark, vectors):
    rows = [(g, i, x) for g, xs in vectors.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(5)
    return SliceTree(df, ["g"], ["i"], "x")


def test_slices_against_a_loop(spark, vectors, tree):
    rng = random.Random(8)
    asked = [(g, 0, len(xs)) for g, xs in vectors.items()] + [("d", 32, 64), ("d", 31, 65), ("e", 1024, 2048), ("e", 7, 7), ("a", 1, 1)]
    for _ in range(400):
        g = rng.choice(list(vectors))
        lo = rng.randrange(len(vectors[g]) + 1)
        asked.append((g, lo, rng.randrange(lo, len(vectors[g]) + 1)))
    rows = [(k, *a) for k, a in enumerate(asked)]
    got = tree.answer(spark.createDataFrame(rows, "k long, g string, lo long, hi long"), NAMES).collect()
    assert len(got) == len(rows)
    for r in got:
        _, g, lo, hi = rows[r["k"]]
        for name, want in zip(NAMES, _want(vectors[g][lo:hi])):
            assert _close(r[name], want), (g, lo, hi, name, r[name], want)


def test_bad_bounds_are_faults_of_their_row_or_end_the_job(spark, tree):
    rows = [(1, "a", -1, 1), (2, "a", 1, 0), (3, "a", 0, 2), (4, "zz", 0, 0), (5, "zz", 0, 1), (6, "a", None, 1), (7, "a", 0, 1)]
    slices = spark.createDataFrame(rows, "k long, g string, lo int, hi int")
    got = {r["k"]: r for r in tree.answer(slices, ["sum", "mean"], strict=False).collect()}
    order, range_ = "slice bounds out of order", "slice bounds out of range"
    assert {k: r["fault"] for k, r in got.items()} == {1: order, 2: order, 3: range_, 4: None, 5: range_, 6: "slice without bounds", 7: None}
    assert got[4]["sum"] == 0 and math.isnan(got[4]["mean"]) and got[3]["sum"] is None
    with pytest.raises(PySparkException, match="slice bounds out of range of length 1"):
        tree.answer(slices.filter("k = 3"), ["sum"]).collect()
    assert tree.answer(slices.filter("k = 7"), ["sum"]).columns == ["k", "g", "lo", "hi", "sum"]


def test_empty_table(spark):
    tree = SliceTree(spark.createDataFrame([], "g string, i long, x double"), ["g"], ["i"], "x")
    slices = spark.createDataFrame([("a", 0, 0), ("a", 0, 1)], "g string, lo int, hi int")
    got = sorted((r["hi"], r["fault"], r["sum"]) for r in tree.answer(slices, ["sum"], strict=False).collect())
    assert got == [(0, None, 0.0), (1, "slice bounds out of range", None)]


def test_blocks_cover_a_slice_once_and_stay_few(spark):
    rng = random.Random(2)
    rows = [(lo, rng.randrange(lo, 40_000)) for lo in (rng.randrange(40_000) for _ in range(300))]
    df = spark.createDataFrame(rows, "lo long, hi long").select("*", whole_blocks(F.col("lo"), F.col("hi"), 4).alias("b"))
    for r in df.collect():
        at = [p for b in r["b"] for p in range(b["block"] << 5 * b["level"], b["block"] + 1 << 5 * b["level"])]
        assert sorted(at) == list(range(r["lo"], r["hi"])) and len(r["b"]) <= 62 * 4


def test_statistics_of_a_slice_far_from_zero_keep_their_digits(spark):
    xs = [1e9 + (i % 7) for i in range(5000)]
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x double")
    tree = SliceTree(df.withColumn("g", F.lit(1)), ["g"], ["i"], "x")
    row = tree.answer(spark.createDataFrame([(1, 3, 4999)], "g int, lo int, hi int"), ["varp"]).first()
    assert math.isclose(row["varp"], statistics.pvariance([x - 1e9 for x in xs[3:4999]]), rel_tol=1e-7)


def test_no_slices_or_blocks_pass_through_the_driver(spark, tree):
    rows = spark.range(200).selectExpr("id AS k", "'e' AS g", "id % 4 AS lo", "id % 4 + 1100 + id AS hi")
    answers = tree.answer(rows, ["sum"])
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    # All joins but the one with the lengths of the groups, which were counted before, merge.
    assert plan.count("strategy=merge") == tree.levels + 2
    joined = answers._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in joined and "BroadcastNestedLoopJoin" not in joined


def test_slices_with_the_same_bounds_are_answered_once_and_all_kept(spark, vectors, tree):
    rows = [(k, g, 3, 30 + k % 2) for k in range(40) for g in ("d", None)]
    got = tree.answer(spark.createDataFrame(rows, "k long, g string, lo long, hi long"), ["sum"]).collect()
    assert sorted(r["k"] for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert _close(r["sum"], sum(x for x in vectors[r["g"]][3 : r["hi"]] if x is not None))
