"""Why records carry no key, and validation in one pass."""

import json

import pytest
from pyspark.sql import functions as F

from hopmeter.functions import codec
from hopmeter.operators import decode
from hopmeter.session import fresh_path

ENTITY = {"externalSystemID": "e", "basicAttributes": {"coordinate": {"lat": 4.3, "long": 6.4}}}
RAW = {"id": "e", "lat": "4.3", "xlong": "6.4"}
CASES = [
    ("src", json.dumps(ENTITY), None),
    ("src", json.dumps({**ENTITY, "more": [1, {"lat": None}]}), None),
    ("src", json.dumps(ENTITY)[:-4], ("malformed", None)),
    ("src", "", ("malformed", None)),
    ("src", None, ("no value", None)),
    ("src", "[1, 2]", ("missing field", "id,lat,xlong")),
    ("src", "null", ("missing field", "id,lat,xlong")),
    ("src", json.dumps({**ENTITY, "externalSystemID": None}), ("missing field", "id")),
    ("src", json.dumps({**ENTITY, "basicAttributes": {"coordinate": {"lat": "x", "long": 6.4}}}), ("wrong type", "lat")),
    ("src", json.dumps({**ENTITY, "basicAttributes": {"coordinate": {"lat": True}}}), ("wrong type", "lat,xlong")),
    ("update", json.dumps({"entityAttributes": ENTITY}), None),
    ("update", json.dumps({"entityAttributes": {"externalSystemID": "e"}}), ("missing field", "lat,xlong")),
    # The wrapper decides as a whole: what stands beside it doesn't count.
    ("update", json.dumps({**ENTITY, "entityAttributes": {"externalSystemID": "e"}}), ("missing field", "lat,xlong")),
    ("src-raw-data", json.dumps(RAW), None),
    ("src-raw-data", json.dumps({**RAW, "lat": 4.3}), None),
    ("src-raw-data", json.dumps({"id": "e", "lat": "4.3"}), ("missing field", "xlong")),
    ("src-raw-data", "{'id'", ("malformed", None)),
    ("other", "{", None),
]


@pytest.fixture(scope="module")
def topics(spark):
    rows = [(t, 0, i, v) for i, (t, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    return df.withColumn("timestamp", F.timestamp_millis(F.lit(0)))


def test_reasons(topics):
    got = {r["offset"]: (r["fault"], r["fields"]) for r in decode.faults(topics, "src").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES) if want}


def test_reasons_are_given_for_exactly_the_rejects(topics):
    rejected = {r["offset"] for r in decode.rejects(decode.unify(topics, "src")).collect()}
    assert rejected == {r["offset"] for r in decode.faults(topics, "src").collect()}


def test_validation_reads_and_parses_once(spark):
    source, path = fresh_path(spark, "test-entities"), fresh_path(spark, "test-validated")
    rows = [(i, n, c) for i, (n, c) in enumerate([("USA", "boat"), ("FRANCE", "boat"), (None, "car"), ("SPAIN", "airplane")] * 5)]
    spark.createDataFrame(rows, "k long, nationality string, category string").select(
        "k", F.to_json(F.struct("nationality", "category")).alias("value")
    ).write.parquet(source)
    parsed = spark.read.parquet(source).select("k", codec.envelope(F.col("value")).alias("m"))
    fields = parsed.select("k", "m.nationality", "m.category")
    valid, rejected, counts = decode.write_validated(fields, "nationality", "category", path)
    assert counts == {"valid": valid.count(), "rejected": rejected.count()} == {"valid": 10, "rejected": 10}
    assert valid.columns == fields.columns and rejected.columns == [*fields.columns, "fault"]
    both = decode.validate(fields, "nationality", "category")
    for got, want in zip((valid, rejected), both):
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        plan = got._jdf.queryExecution().toString()
        assert "from_json" not in plan and source not in plan and "PartitionFilters: [" in plan
    nothing = decode.write_validated(fields.limit(0), "nationality", "category", fresh_path(spark, "test-validated"))
    assert nothing[0].count() == nothing[1].count() == 0 and nothing[2] == {"valid": 0, "rejected": 0}
