import random

import pytest

from hopmeter.operators.baseline import baseline_offsets

TOPICS = ["a", "b"]


def _brute(records, probes):
    out = []
    for n, part, ms in probes:
        for topic in TOPICS:
            ends = [o + 1 for t, p, o, ts in records if (t, p) == (topic, part) and ts < ms]
            out.append((n, topic, max(ends, default=0)))
    return sorted(out)


@pytest.mark.parametrize("bucket_ms", [1, 10, 1 << 16])
def test_against_brute_force(spark, bucket_ms):
    rng = random.Random(bucket_ms)
    records = []
    for topic, part in [("a", 0), ("a", 1), ("b", 0), ("other", 0)]:
        times = sorted(rng.choice([50, rng.randrange(300)]) for _ in range(150))
        records += [(topic, part, o, ts) for o, ts in enumerate(times)]
    probes = [(n, rng.randrange(3), rng.choice([50, 51, rng.randrange(320)])) for n in range(200)]
    got = baseline_offsets(
        spark.createDataFrame(records, "topic string, partition int, offset long, ts_ms long"),
        spark.createDataFrame(probes, "n int, partition int, ms long"),
        TOPICS, bucket_ms,
    )
    assert sorted(tuple(r) for r in got.select("n", "topic", "base_offset").collect()) == _brute(records, probes)


def test_trimmed_topic_and_silent_partition(spark, rows):
    records = spark.createDataFrame([("a", 0, 900, 10), ("a", 0, 901, 20)],
                                    "topic string, partition int, offset long, ts_ms long")
    probes = spark.createDataFrame([(1, 0, 5), (2, 0, 10), (3, 0, 11), (4, 0, 99), (5, 7, 99)],
                                   "n int, partition int, ms long")
    got = baseline_offsets(records, probes, ["a"])
    assert rows(got, "n", "base_offset") == [(1, 0), (2, 0), (3, 901), (4, 902), (5, 0)]
