"""Registered queries: name -> function of (spark, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmeter.functions import codec
from hopmeter.functions.text import minute_stamp
from hopmeter.operators import decode, latency, probes, report, summary
from hopmeter.operators.first_match import KEY, first_match_by_time
from hopmeter.operators.slices import SliceTree
from hopmeter.plans.fixture import CLOCK, PARTITIONS, events, spoiled
from hopmeter.plans.stages import FILES_PER_BATCH, PROBE, WITHIN, StageTables, open_tables, whole_run
from hopmeter.schemas import CATEGORIES, CREATION_TOPIC, NATIONALITIES, UPDATE_TOPIC
from hopmeter.session import cut, fresh_path, pin_utc
from hopmeter.sources import index
from hopmeter.sources import topics as T
from hopmeter.streaming import jobs
from hopmeter.streaming.once import first_once

Query = Callable[[SparkSession, str], DataFrame]
GRID_UPDATES = 5
SEED = 7
SLICE = (20, 150)
OFF_HALVES = 1.234e-7

_QUERIES: dict[str, Query] = {}


def _query(fn: Callable[[StageTables], DataFrame]) -> Callable[[StageTables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(open_tables(spark, sf_dir))

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Float aggregates depend on merge order in their last digits."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# Sources and decoding

_POSITION = ["topic", "partition", "offset"]


def _ts_ms():
    return F.unix_millis("timestamp").alias("ts_ms")


@_query
def topic_scan(p: StageTables) -> DataFrame:
    return T.scan(p.topics, [p.source]).select(*_POSITION, _ts_ms(), "value")


@_query
def earliest_scan(p: StageTables) -> DataFrame:
    return p.topics.select(*_POSITION, _ts_ms())


@_query
def end_offsets(p: StageTables) -> DataFrame:
    names = F.array(*[F.lit(t) for t in [*p.stages, CREATION_TOPIC]])
    known = p.topics.select("partition").distinct().select(F.explode(names).alias("topic"), "partition")
    return T.end_offsets(p.topics, known)


@_query
def scan_from_offset(p: StageTables) -> DataFrame:
    return T.scan_from(p.topics, p.bounds).select(*_POSITION, _ts_ms())


@_query
def end_offsets_indexed(p: StageTables) -> DataFrame:
    return index.end_offsets_of_files(p.spark, p.topics_path)


@_query
def baseline_offsets_indexed(p: StageTables) -> DataFrame:
    """Base offsets from the stored index, and the records of the probes' own time buckets."""
    asked = p.probes.select("probe_id", "partition", "ms")
    return index.baseline_from_files(p.spark, p.topics_path, asked, p.stages).select(
        "probe_id", "topic", "partition", "base_offset"
    )


@_query
def scan_from_offset_indexed(p: StageTables) -> DataFrame:
    """What a second batch of probes may match: files before its first base offsets stay closed."""
    bounds = cut(index.bounds_from_files(p.spark, p.topics_path, p.late_probes.select("partition", "ms"), p.stages), "bounds")
    return index.scan_from_files(p.spark, p.topics_path, bounds).select(*_POSITION, _ts_ms())


@_query
def kafka_starting_offsets(p: StageTables) -> DataFrame:
    return T.starting_offsets_json(p.bounds)


@_query
def baseline_offsets(p: StageTables) -> DataFrame:
    return p.find_marks().select("probe_id", "topic", "partition", "base_offset")


@_query
def raw_json_decode(p: StageTables) -> DataFrame:
    return decode.raw_fields(p.topics, p.source).select(
        "partition", "offset", "id", "lat", "xlong",
        F.element_at("attributes", "category").alias("category"),
        F.element_at("attributes", "timestamp").alias("sent_ms"),
        F.size("attributes").alias("n_attributes"),
    )


@_query
def event_props_decode(p: StageTables) -> DataFrame:
    """JSON that this library did not write: the properties of the given events."""
    attributes = codec.raw_attributes(F.col("props"))
    return events(p.spark, p.sf_dir).select(
        "event_id", F.element_at(attributes, "k").alias("k"), F.size(attributes).alias("n_attributes")
    )


@_query
def envelope_decode(p: StageTables) -> DataFrame:
    m = F.col("message")
    wrapped = m["entityAttributes"].isNotNull()
    return decode.entity_fields(p.topics, [p.source, UPDATE_TOPIC]).select(
        *_POSITION, "id", "lat", "xlong", wrapped.alias("is_wrapped"),
        F.when(wrapped, m["entityAttributes"]["speed"]).otherwise(m["speed"]).alias("speed"),
        F.when(wrapped, m["entityAttributes"]["basicAttributes"]["entityOffset"])
        .otherwise(m["basicAttributes"]["entityOffset"]).alias("entity_offset"),
    )


@_query
def unified_topic_records(p: StageTables) -> DataFrame:
    return p.read_records()


@_query
def decode_rejects(p: StageTables) -> DataFrame:
    """Records of a spoiled topic table that carry no complete key, and why."""
    return decode.faults(spoiled(p.topics), p.source)


@_query
def decode_reject_counts(p: StageTables) -> DataFrame:
    return decode.faults(spoiled(p.topics), p.source).groupBy("topic", "fault").agg(F.count("*").alias("n"))


@_query
def match_predicate(p: StageTables) -> DataFrame:
    """Every record against the create probe of its cycle (one per id); false where there is none."""
    creates = p.probes.filter("update_no = 0").select(
        F.col("id").alias("want_id"), F.col("lat").alias("want_lat"), F.col("xlong").alias("want_long")
    )
    c = F.col
    matches = codec.same_key(c("id"), c("lat"), c("xlong"), c("want_id"), c("want_lat"), c("want_long"))
    joined = p.read_records().join(creates, c("id") == c("want_id"), "left")
    return joined.select(*_POSITION, F.coalesce(matches, F.lit(False)).alias("matches"))


@_query
def entity_validate(p: StageTables) -> DataFrame:
    """Entity records with symbols in and out of the domains, split and put together again."""
    def one_of(symbols: list[str], stranger: str):
        values = F.array(*[F.lit(s) for s in [*symbols, stranger]])
        return F.element_at(values, (F.col("probe_id") % (len(symbols) + 1) + 1).cast("int"))

    record = codec.entity_record(
        F.col("id"), F.col("lat"), F.col("xlong"), p.source,
        one_of(NATIONALITIES, "FRANCE"), one_of(CATEGORIES, "car"),
    )
    sent = p.probes.select("probe_id", codec.envelope(codec.entity_message(record)).alias("m"))
    valid, rejected, _ = decode.write_validated(
        sent.select("probe_id", "m.nationality", "m.category"), "nationality", "category", fresh_path(p.spark, "validated")
    )
    return valid.withColumn("fault", F.lit(None).cast("string")).unionByName(rejected)


# Encoding and probe tables


@_query
def raw_json_encode(p: StageTables) -> DataFrame:
    value = codec.raw_message(F.col("id"), F.col("lat"), F.col("xlong"), p.source, F.col("ms"))
    return p.probes.select("probe_id", value.alias("value"))


@_query
def entity_encode(p: StageTables) -> DataFrame:
    record = codec.entity_record(F.col("id"), F.col("lat"), F.col("xlong"), p.source)
    return p.probes.select(
        "probe_id",
        codec.entity_message(record).alias("source_value"),
        codec.update_message(record).alias("update_value"),
    )


@_query
def detection_encode(p: StageTables) -> DataFrame:
    return probes.detections(p.probes, p.source)


def _cycles(p: StageTables) -> DataFrame:
    customers = p.spark.read.parquet(f"{p.sf_dir}/customer.parquet")
    return customers.select(F.col("c_custkey").alias("cycle_no"))


@_query
def probe_grid(p: StageTables) -> DataFrame:
    return probes.probe_grid(_cycles(p), GRID_UPDATES, p.source, SEED)


@_query
def two_step_probes(p: StageTables) -> DataFrame:
    return probes.two_step_probes(_cycles(p), p.source, SEED)


@_query
def update_ordinal(p: StageTables) -> DataFrame:
    numbered = probes.number_updates(
        events(p.spark, p.sf_dir).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]
    )
    return numbered.select("event_id", "user_id", "update_no", latency.phase(F.col("update_no")).alias("phase"))


# Matching


@_query
def first_match_asof(p: StageTables) -> DataFrame:
    return p.find_hits().filter("offset IS NOT NULL").select(
        "probe_id", "topic", "partition", "base_offset", "offset", "ts_ms"
    )


@_query
def first_match_bucketed(p: StageTables) -> DataFrame:
    """Two batches of probes against records that lie in buckets of their key."""
    late = F.unix_millis("start_time") * 2 >= sum(p.span)
    hits = [p.record_buckets.match(p.marks.filter(part)) for part in (late, ~late)]
    return hits[0].unionByName(hits[1]).filter("offset IS NOT NULL").select(
        "probe_id", "topic", "partition", "base_offset", "offset", "ts_ms"
    )


@_query
def first_match_any_partition(p: StageTables) -> DataFrame:
    """Messages sent without a key: source records land in another partition than the probe's."""
    moved = F.when(F.col("topic") == p.source, (F.col("partition") + 1) % PARTITIONS).otherwise(F.col("partition"))
    records = p.read_records().withColumn("partition", moved.cast("int"))
    asked = p.probes.select("probe_id", "id", "lat", "xlong", "ms")
    return first_match_by_time(records, asked, p.stages).filter("offset IS NOT NULL").select(
        "probe_id", "topic", "partition", "offset", "ts_ms"
    )


def _run_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    return whole_run(spark, sf_dir)


_QUERIES["stage_latency_3"] = _run_whole


@_query
def stage_latency_2(p: StageTables) -> DataFrame:
    return latency.stage_latency_2(p.hits, p.source, UPDATE_TOPIC, PROBE)


@_query
def unmatched_probes(p: StageTables) -> DataFrame:
    return latency.unmatched(p.hits).select("probe_id", "cycle_no", "update_no", "missing_topic", "reason")


# Statistics of latencies


@_query
def latency_mean(p: StageTables) -> DataFrame:
    return _rounded(summary.latency_mean(p.latency), "mean")


@_query
def latency_median(p: StageTables) -> DataFrame:
    return summary.latency_median(p.latency)


@_query
def latency_stddev_pop(p: StageTables) -> DataFrame:
    return _rounded(summary.latency_stddev(p.latency), "stddev")


@_query
def latency_summary(p: StageTables) -> DataFrame:
    return _rounded(summary.latency_summary(p.latency), "mean", "stddev")


@_query
def latency_by_phase(p: StageTables) -> DataFrame:
    return _rounded(summary.latency_summary(p.latency, ["phase"]), "mean", "stddev")


@_query
def phase_vectors(p: StageTables) -> DataFrame:
    return summary.phase_vectors(p.latency, PROBE)


@_query
def cycle_collect(p: StageTables) -> DataFrame:
    return summary.cycle_collect(p.latency, ["raw_to_source_ms", "source_to_update_ms"])


@_query
def metric_sorted(p: StageTables) -> DataFrame:
    return summary.metric_sorted(p.latency, "probe_id")


# Statistics over vectors


def _std(name: str) -> None:
    def run(p: StageTables) -> DataFrame:
        table = summary.std_table(events(p.spark, p.sf_dir), ["event_type"], F.col("value"), [name])
        return _rounded(table, name)

    run.__name__ = f"std_{name}"
    _query(run)


for _name in ["max", "min", "mean", "var", "varp", "stddev", "stddevp", "sum"]:
    _std(_name)


@_query
def std_slice(p: StageTables) -> DataFrame:
    names = ["max", "min", "mean", "var", "varp", "stddev", "stddevp", "sum"]
    table = summary.std_slice(
        events(p.spark, p.sf_dir), ["event_type"], ["ts", "event_id"], "value", *SLICE, names,
    )
    return _rounded(table, *names)


@_query
def std_slices(p: StageTables) -> DataFrame:
    """A slice of its own for every event, over the values of its type."""
    names = ["max", "min", "mean", "var", "varp", "stddev", "stddevp", "sum"]
    rows = events(p.spark, p.sf_dir)
    lo = F.col("user_id") % 40
    slices = rows.select("event_id", "event_type", lo.alias("lo"), (lo + F.col("event_id") % 300 - 2).alias("hi"))
    tree = SliceTree(rows, ["event_type"], ["ts", "event_id"], "value")
    # Means of hundredths often lie on half a millionth, where the last digit of a float would decide.
    answers = tree.answer(slices, names, strict=False)
    return answers.withColumns({n: F.round(F.col(n) + OFF_HALVES, 6) for n in names})


# Reports


@_query
def latency_csv(p: StageTables) -> DataFrame:
    return report.latency_csv(p.latency, p.source)


@_query
def latency_csv_all(p: StageTables) -> DataFrame:
    return report.latency_csv(p.latency, p.source, [])


@_query
def latency_csv_phase(p: StageTables) -> DataFrame:
    return report.latency_csv(p.latency, p.source, ["phase"])


@_query
def probe_report(p: StageTables) -> DataFrame:
    return report.probe_report(p.facts, p.source)


@_query
def summary_report(p: StageTables) -> DataFrame:
    return report.summary_report(p.latency, p.source)


@_query
def action_report(p: StageTables) -> DataFrame:
    complete = p.facts.filter("raw_to_source_ms IS NOT NULL")
    return report.action_report(complete, p.source)


@_query
def action_report_2(p: StageTables) -> DataFrame:
    return report.action_report(stage_latency_2(p), p.source, stages=2)


@_query
def action_report_short(p: StageTables) -> DataFrame:
    return report.action_report(stage_latency_2(p), p.source, short=True)


@_query
def report_sink(p: StageTables) -> DataFrame:
    last = p.probes.agg(minute_stamp(F.max("start_time")).alias("stamp")).first()["stamp"]
    text = report.full_report(p.facts, p.latency, p.source)
    path = report.write_report(text, fresh_path(p.spark, "report"), last)
    return p.spark.read.text(path).withColumnRenamed("value", "line")


# Streams


def _stream_places(p: StageTables, name: str) -> tuple[str, str]:
    place = fresh_path(p.spark, name)
    return f"{place}/out", f"{place}/checkpoint"


def _record_stream(p: StageTables) -> DataFrame:
    return decode.unify(jobs.read_stream(p.spark, p.topics_path, maxFilesPerTrigger=FILES_PER_BATCH), p.source)


@_query
def stream_topic_read(p: StageTables) -> DataFrame:
    out, checkpoint = _stream_places(p, "stream-copy")
    stream = jobs.read_stream(p.spark, p.topics_path, maxFilesPerTrigger=FILES_PER_BATCH)
    jobs.copy_topics(stream, out, checkpoint).awaitTermination()
    return T.read_topics(p.spark, out).select(*_POSITION, _ts_ms())


@_query
def stream_sink(p: StageTables) -> DataFrame:
    out, checkpoint = _stream_places(p, "stream-sink")
    stream = jobs.read_stream(p.spark, p.topics_path, maxFilesPerTrigger=FILES_PER_BATCH)
    jobs.collect_by_topic(stream, out, checkpoint).awaitTermination()
    return p.spark.read.parquet(out).select(*_POSITION, _ts_ms())


@_query
def stream_first_match(p: StageTables) -> DataFrame:
    out, checkpoint = _stream_places(p, "stream-first")
    jobs.first_per_key(_record_stream(p), p.bounds, out, checkpoint).awaitTermination()
    jobs.compact(p.spark, out)
    return jobs.latest_first(p.spark, out).select(*KEY, "offset", "ts_ms")


@_query
def stream_first_match_once(p: StageTables) -> DataFrame:
    """The same with each key told once, when its time is over."""
    out, checkpoint = _stream_places(p, "stream-once")
    pause = f"{p.span[1] - p.span[0] + WITHIN} milliseconds"
    first_once(
        p.record_arrivals(), p.bounds, out, checkpoint, pause, pause, p.parts
    ).awaitTermination()
    return p.spark.read.parquet(out).select(*KEY, "offset", "ts_ms")


@_query
def stream_stage_latency(p: StageTables) -> DataFrame:
    """Records and probes as streams, first hits as a stream of their own, then latencies; all state has an end."""
    return p.spark.read.parquet(p.stream_latency_path).drop("batch")


@_query
def stream_unmatched(p: StageTables) -> DataFrame:
    """Probes that the stream gave up waiting for, with the topic where nothing came."""
    hits = jobs.latest_first(p.spark, p.stream_hits_path, missed=True).filter(F.col("topic") != CLOCK)
    return latency.unmatched(hits).select("probe_id", "cycle_no", "update_no", "missing_topic", "reason")


@_query
def stream_latency_summary(p: StageTables) -> DataFrame:
    """Statistics kept up batch by batch over the stream of latencies."""
    out, checkpoint = _stream_places(p, "stream-summary")
    schema = p.spark.read.parquet(p.stream_latency_path).drop("batch").schema
    rows = jobs.read_batches(p.spark, p.stream_latency_path, schema, maxFilesPerTrigger=FILES_PER_BATCH)
    jobs.summarize(rows, [], out, checkpoint).awaitTermination()
    return _rounded(jobs.latest_summary(p.spark, out, []), "mean", "stddev")
