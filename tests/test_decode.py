import pytest
from pyspark.sql import functions as F

from hopmeter.functions import codec
from hopmeter.operators import decode
from hopmeter.operators.first_match import keep_probed
from hopmeter.schemas import TOPIC_TABLE

ENTITY = ('{"basicAttributes":{"coordinate":{"lat":4.3,"long":1500.0}},"externalSystemID":"e1"%s}')


@pytest.fixture
def topic(spark):
    def make(name, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "offset long, value string")
        return df.select(
            F.lit(name).alias("topic"), F.lit(0).alias("partition"), "offset",
            F.timestamp_millis(F.lit(1500000000123)).alias("timestamp"), "value",
        ).to(TOPIC_TABLE)
    return make


def _keys(df):
    return [tuple(r) for r in df.orderBy("offset").select("id", "lat", "xlong").collect()]


def test_raw_documents(topic):
    records = decode.unify(topic(
        "s-raw-data",
        '{"id":"a","lat":"4.30","xlong":"6.4","more":"x"}',
        '{"id":"a","lat":"1","lat":"2","xlong":"6.4"}',
        '{"id":"a","lat":6.40,"xlong":7}',
        '{"lat":"4.3","xlong":"6.4"}',
        "no json at all",
    ), "s")
    assert _keys(records) == [
        ("a", "4.30", "6.4"),
        ("a", "2", "6.4"),           # of a repeated key the last one counts
        ("a", "6.4", "7"),            # numbers are rendered anew, strings stay as they are
        (None, "4.3", "6.4"),
        (None, None, None),
    ]
    assert records.first()["ts_ms"] == 1500000000123
    assert decode.rejects(records).count() == 2


def test_bad_document_can_fail_the_job(topic):
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        decode.unify(topic("s-raw-data", "{broken"), "s", mode="FAILFAST").collect()


def test_wrapper_decides_as_a_whole(topic):
    wrapped = '{"entityAttributes":%s}' % (ENTITY % "")
    top_wins_nothing = '{"entityAttributes":{},"externalSystemID":"top"}'
    null_wrapper = ENTITY % ',"entityAttributes":null'
    records = decode.unify(topic("update", wrapped, ENTITY % "", top_wins_nothing, null_wrapper), "s")
    assert _keys(records) == [
        ("e1", "4.3", "1500.0"), ("e1", "4.3", "1500.0"), (None, None, None), ("e1", "4.3", "1500.0"),
    ]


def test_other_topics_are_left_out(topic):
    assert decode.unify(topic("creation", ENTITY % ""), "s").count() == 0


def test_round_trip_and_one_probe(spark, topic):
    key = spark.createDataFrame([("id1", "44.9", "95.8")], "id string, lat string, xlong string")
    c = F.col
    record = codec.entity_record(c("id"), c("lat"), c("xlong"), "s")
    texts = key.select(
        codec.raw_message(c("id"), c("lat"), c("xlong"), "s", F.lit(1500000000000)).alias("raw"),
        codec.entity_message(record).alias("source"),
        codec.update_message(record).alias("update"),
        codec.detection_message(c("id"), "s").alias("creation"),
    ).first()
    for name, text in [("s-raw-data", texts["raw"]), ("s", texts["source"]), ("update", texts["update"])]:
        records = decode.unify(topic(name, text), "s")
        assert _keys(records) == [("id1", "44.9", "95.8")]
        assert decode.of_probe(records, "id1", "44.9", "95.8").count() == 1
        assert decode.of_probe(records, "id1", "44.90", "95.8").count() == 0
    assert texts["creation"] == '{"sourceName":"s","externalSystemID":"id1"}'
    attributes = decode.raw_fields(topic("s-raw-data", texts["raw"]), "s").first()["attributes"]
    assert attributes["timestamp"] == "1500000000000" and len(attributes) == 13
    whole = decode.entity_fields(topic("s", texts["source"]), ["s"]).first()["message"]
    assert (whole["speed"], whole["pictureURL"], whole["basicAttributes"]["entityOffset"]) == (4.7, "huh?", 50)


def test_coordinate_that_is_no_number(spark):
    df = spark.createDataFrame([("x",)], "t string")
    lenient = codec.entity_record(F.col("t"), F.col("t"), F.lit("1"), "s", strict=False)
    assert df.select(lenient.alias("e")).first()["e"]["basicAttributes"]["coordinate"]["lat"] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(codec.entity_record(F.col("t"), F.col("t"), F.lit("1"), "s").alias("e")).collect()


def test_symbols(spark, rows):
    df = spark.createDataFrame(
        [(1, "USA", "boat"), (2, "usa", "boat"), (3, "SPAIN", None), (4, None, "car")],
        "n int, nationality string, category string")
    valid, rejected = decode.validate(df, "nationality", "category")
    assert rows(valid, "n") == [(1,)]
    assert rows(rejected, "n", "fault") == [(2, "nationality"), (3, "category"), (4, "nationality,category")]


def test_a_value_is_parsed_once_whoever_asks_for_the_key(spark, topic, tmp_path):
    topic("src", ENTITY % "").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    probes = spark.createDataFrame([("e1", "4.3", "1500.0")], "id string, lat string, xlong string")
    for found in (keep_probed(decode.unify(table, "src"), probes), decode.rejects(decode.unify(table, "src")), decode.faults(table, "src")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1
