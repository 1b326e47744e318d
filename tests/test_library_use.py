"""The library as the README shows it: own topic files, own probes."""

import random

from pyspark.sql import functions as F

from hopmeter.functions import codec
from hopmeter.operators.baseline import baseline_offsets
from hopmeter.operators.decode import unify
from hopmeter.operators.first_match import first_match, keep_probed
from hopmeter.operators.latency import stage_latency, unmatched
from hopmeter.operators.summary import latency_summary
from hopmeter.schemas import stage_topics
from hopmeter.session import cut, fresh_path
from hopmeter.sources.topics import read_topics, since, write_topics

PROBE = ["probe_id", "cycle_no", "update_no"]


def _brute(log, probes):
    """Latencies by scanning every topic from the probe's base offset."""
    out, lost = [], []
    for n, key, ms in probes:
        times = []
        for topic in stage_topics("src"):
            base = max((o + 1 for t, o, ts, _ in log if t == topic and ts < ms), default=0)
            hits = [(o, ts) for t, o, ts, k in log if t == topic and k == key and o >= base]
            times.append(min(hits)[1] if hits else None)
            if not hits:
                lost.append((n, topic))
        if None not in times:
            out.append((n, times[1] - times[0], times[2] - times[1]))
    return sorted(out), sorted(lost)


def test_standing_entity_probed_again_and_again(spark):
    """Entity 0 never moves, so a third of probes and records share one key."""
    rng = random.Random(2)
    probes, arrivals, now = [], [], 1_500_000_000_000
    for n in range(240):
        entity = 0 if n % 3 == 0 else rng.randrange(1, 30)
        step = 0 if entity == 0 else rng.randrange(3)
        key = (f"e{entity}", str(4.3 + step), str(6.4 + step))
        now += rng.randrange(1, 40)
        probes.append((n, key, now))
        arrivals.append(("src-raw-data", now, key))
        for topic, delay in [("src", 5), ("update", 30)]:
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                arrivals.append((topic, now + delay + rng.randrange(60), key))
    log, ends = [], {}
    for topic, ts, key in sorted(arrivals, key=lambda a: a[1]):
        log.append((topic, ends.setdefault(topic, 0), ts, key))
        ends[topic] += 1

    c = F.col
    record = codec.entity_record(c("id"), c("lat"), c("xlong"), "src")
    topics = spark.createDataFrame(
        [(t, 0, o, ts, *k) for t, o, ts, k in log],
        "topic string, partition int, offset long, ts_ms long, id string, lat string, xlong string",
    ).withColumns({
        "timestamp": F.timestamp_millis("ts_ms"),
        "value": F.when(c("topic") == "src-raw-data", codec.raw_message(c("id"), c("lat"), c("xlong"), "src", c("ts_ms")))
        .when(c("topic") == "src", codec.entity_message(record)).otherwise(codec.update_message(record)),
    })
    path = fresh_path(spark, "library-use")
    write_topics(topics, path)

    topics = read_topics(spark, path)
    positions = topics.select("topic", "partition", "offset", F.unix_millis("timestamp").alias("ts_ms"))
    asked = spark.createDataFrame(
        [(n, 0, n, *key, 0, ms) for n, key, ms in probes],
        "probe_id int, cycle_no int, update_no int, id string, lat string, xlong string, partition int, ms long",
    )
    marks = cut(baseline_offsets(positions, asked, stage_topics("src")).drop("ms"), "marks")
    wanted = cut(keep_probed(unify(since(topics, probes[0][2]), "src"), asked), "wanted")
    want, lost = _brute(log, probes)
    for limit in (1_000_000, 30):
        hits = first_match(wanted, marks, group_rows=limit, bucket_offsets=50)
        latency = stage_latency(hits, stage_topics("src"), PROBE)
        got = latency.select("probe_id", "raw_to_source_ms", "source_to_update_ms").collect()
        assert sorted(tuple(r) for r in got) == want
        assert sorted(tuple(r) for r in unmatched(hits).select("probe_id", "missing_topic").collect()) == lost
        assert {r["n"] for r in latency_summary(latency).collect()} == {len(want)}
