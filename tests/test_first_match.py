import random

import pytest

from hopmeter.operators import latency
from hopmeter.operators.baseline import baseline_offsets
from hopmeter.operators.first_match import first_match, first_match_by_time, keep_probed

RECORD = "topic string, partition int, id string, lat string, xlong string, offset long, ts_ms long"
MARK = "probe_id int, topic string, partition int, id string, lat string, xlong string, base_offset long"


def _brute(records, marks):
    out = []
    for n, *key, base in marks:
        later = [(o, ts) for *k, o, ts in records if k == key and o >= base]
        out.append((n, key[0], *(min(later) if later else (None, None))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def crowd():
    """One key holds a third of the records and a third of the marks."""
    rng = random.Random(11)

    def key():
        n = 0 if rng.random() < 0.34 else rng.randrange(60)
        return [f"id{n}", f"{n}.3", "6.4"]

    records, marks = [], []
    for topic in ["src", "update"]:
        for offset in range(2000):
            records.append([topic, 0, *key(), offset, offset * 10])
    for n in range(900):
        base = rng.choice([0, 77, 1999, 2500, rng.randrange(2100)])
        marks.append([n, rng.choice(["src", "update"]), rng.choice([0, 0, 0, 1]), *key(), base])
    return records, marks


@pytest.mark.parametrize("limit,bucket", [(10_000_000, 1 << 20), (200, 64), (0, 1), (0, 500)])
def test_against_brute_force(spark, crowd, limit, bucket):
    records, marks = crowd
    got = first_match(
        spark.createDataFrame(records, RECORD), spark.createDataFrame(marks, MARK), limit, bucket
    )
    found = [tuple(r) for r in got.select("probe_id", "topic", "offset", "ts_ms").collect()]
    assert sorted(found, key=str) == _brute(records, marks)


def test_redelivery_wins_when_the_original_is_lost(spark):
    key = ["src", 0, "e", "4.3", "6.4"]
    records = spark.createDataFrame([[*key, 3, 100], [*key, 9, 400]], RECORD)
    marks = spark.createDataFrame([[1, *key, 3], [2, *key, 4], [3, *key, 10]], MARK)
    got = {r["probe_id"]: r["offset"] for r in first_match(records, marks).collect()}
    assert got == {1: 3, 2: 9, 3: None}


def test_keys_compare_as_text_and_null_never_matches(spark):
    records = spark.createDataFrame(
        [["src", 0, "e", "4.30", "6.4", 5, 1], ["src", 0, None, "4.3", "6.4", 6, 2],
         ["src", 0, "e", None, "6.4", 7, 3]], RECORD)
    marks = spark.createDataFrame(
        [[1, "src", 0, "e", "4.3", "6.4", 0], [2, "src", 0, None, "4.3", "6.4", 0]], MARK)
    for limit in (1000, 0):
        got = {r["probe_id"]: r["offset"] for r in first_match(records, marks, limit).collect()}
        assert got == {1: None, 2: None}


def test_pruning_keeps_all_records_of_probes(spark, crowd):
    records, marks = crowd
    df, probes = spark.createDataFrame(records, RECORD), spark.createDataFrame(marks[:20], MARK)
    wanted = {tuple(m[3:6]) for m in marks[:20]}
    assert keep_probed(df, probes).count() == sum(tuple(r[2:5]) in wanted for r in records)
    every = spark.createDataFrame(marks, MARK)
    asked = {tuple(m[3:6]) for m in marks}
    assert keep_probed(df, every).count() == sum(tuple(r[2:5]) in asked for r in records)


@pytest.mark.parametrize("limit,bucket", [(10_000_000, 1 << 22), (0, 1), (0, 3000)])
def test_match_by_time_in_any_partition(spark, limit, bucket):
    rng = random.Random(3)
    keys = [(f"id{n}", f"{n}.3", "6.4") for n in range(9)]
    pick = lambda: keys[0] if rng.random() < 0.4 else rng.choice(keys)
    records = [
        (t, rng.randrange(4), *pick(), o, rng.randrange(9000)) for t in ["src", "update"] for o in range(600)
    ]
    probes = [(n, 0, *pick(), rng.randrange(9500)) for n in range(200)] + [(200, 0, None, "1.3", "6.4", 5), (201, 0, *keys[0], None)]
    want = []
    for n, _, *key, ms in probes:
        for topic in ["src", "update"]:
            later = [(ts, p, o) for t, p, *k, o, ts in records if t == topic and k == key and ms is not None and ts >= ms]
            best = min(later, default=(None, None, None))
            want.append((n, topic, best[1], best[2], best[0]))
    got = first_match_by_time(
        spark.createDataFrame(records, RECORD),
        spark.createDataFrame(probes, "n int, partition int, id string, lat string, xlong string, ms long"),
        ["src", "update"], limit, bucket,
    )
    found = [tuple(r) for r in got.select("n", "topic", "partition", "offset", "ts_ms").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_probes_without_time_partition_or_key_are_unmatched_not_lost(spark):
    records = spark.createDataFrame([["src", 0, "e", "4.3", "6.4", o, 10 * o] for o in range(5)], RECORD)
    probes = spark.createDataFrame(
        [(1, "e", "4.3", "6.4", 0, 15), (2, "e", "4.3", "6.4", 0, None), (3, "e", "4.3", "6.4", None, 15),
         (4, None, "4.3", "6.4", 0, 15), (5, "f", "4.3", "6.4", 0, 15)],
        "probe_id int, id string, lat string, xlong string, partition int, ms long")
    for limit in (1000, 0):
        hits = first_match(records, baseline_offsets(records.select("topic", "partition", "offset", "ts_ms"), probes, ["src"]), limit)
        assert hits.count() == 5
        assert [r["probe_id"] for r in hits.filter("offset IS NOT NULL").collect()] == [1]
        reasons = {r["probe_id"]: r["reason"] for r in latency.unmatched(hits).collect()}
        assert reasons == {2: "no base offset", 3: "no base offset", 4: "no key", 5: "no record"}


def test_negative_latency_is_kept_and_missing_stage_is_reported(spark, rows):
    topics = ["src-raw-data", "src", "update"]
    data = [(1, 0, t, 0, ms) for t, ms in zip(topics, [100, 90, 95])]
    data += [(2, 1, topics[0], 0, 100), (2, 1, topics[1], 0, 105), (2, 1, topics[2], None, None)]
    hits = spark.createDataFrame(data, "probe_id int, update_no int, topic string, offset long, ts_ms long")
    hits = hits.selectExpr("*", "'e' AS id", "'4.3' AS lat", "'6.4' AS xlong", "0L AS base_offset")
    by = ["probe_id", "update_no"]
    assert rows(latency.stage_latency(hits, topics, by)) == [(1, 0, "CREATE", -10, 5, -5)]
    two = latency.stage_latency_2(hits, "src", "update", by)
    assert rows(two) == [(1, 0, "CREATE", 5)]
    assert rows(latency.unmatched(hits), "probe_id", "missing_topic") == [(2, "update")]


def test_plain_plan_has_one_shuffle_and_no_pair_join(spark, crowd):
    records, marks = crowd
    got = first_match(spark.createDataFrame(records, RECORD), spark.createDataFrame(marks, MARK))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Cartesian" not in plan
