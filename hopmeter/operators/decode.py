"""Topic records in one normal form, whatever their topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from hopmeter.functions import codec
from hopmeter.schemas import raw_topic, stage_topics


def unify(
    topics: DataFrame, source: str, mode: str = "PERMISSIVE", also: Sequence[str] = ()
) -> DataFrame:
    """topic, partition, offset, ts_ms, id, lat, xlong for the three stage topics.

    Every value is parsed once with a schema that fits all topics, then the topic
    decides which fields count. A bad document gives nulls, or fails the job with
    ``mode="FAILFAST"``. Topics in ``also`` pass like entity topics.
    """
    parsed = topics.filter(F.col("topic").isin([*stage_topics(source), *also])).select(
        "topic", "partition", "offset",
        F.unix_millis("timestamp").alias("ts_ms"),
        codec.any_stage_key(F.col("value"), mode).alias("m"),
    )
    is_raw = F.col("topic") == raw_topic(source)
    id, lat, xlong = codec.entity_key("m")
    key = F.struct(
        F.when(is_raw, F.col("m.id")).otherwise(id).alias("id"),
        F.when(is_raw, F.col("m.lat")).otherwise(lat).alias("lat"),
        F.when(is_raw, F.col("m.xlong")).otherwise(xlong).alias("xlong"),
    )
    # One row each. Filters and joins on the key stay above the inline; a filter below it would parse
    # the value anew for every field it tests.
    keyed = parsed.select("topic", "partition", "offset", "ts_ms", key.alias("k"))
    return keyed.select("topic", "partition", "offset", "ts_ms", F.inline(F.array("k")))


def rejects(records: DataFrame) -> DataFrame:
    """Records that carry no complete key: bad documents and missing fields."""
    return records.filter("id IS NULL OR lat IS NULL OR xlong IS NULL")


def faults(topics: DataFrame, source: str) -> DataFrame:
    """Records of the stage topics that carry no complete key: topic, partition, offset, ``fault``, ``fields``.

    ``fault`` is "no value", "malformed" (the value is no JSON document), "missing field" or
    "wrong type" (a field is there, but not as its schema wants it); ``fields`` names the
    fields, and the worst of their faults counts. The document is parsed once more as
    a variant, which tells what is there whatever its type.
    """
    parsed = topics.filter(F.col("topic").isin(stage_topics(source))).select(
        "topic", "partition", "offset", "value",
        codec.any_stage_key(F.col("value")).alias("m"), F.try_parse_json("value").alias("v"),
    )
    is_raw = F.col("topic") == raw_topic(source)
    found = dict(zip(codec.KEY_FIELDS, zip(
        [F.col(f"m.{name}") for name in codec.KEY_FIELDS], codec.entity_key("m"),
    )))

    def there(path: str) -> Column:
        return F.try_variant_get(F.col("v"), path, "string").isNotNull()

    def of(name: str) -> Column:
        raw, entity = found[name]
        at = codec.ENTITY_PATHS[name]
        wrapped = there("$.entityAttributes")
        present = (
            F.when(is_raw, there(f"$.{name}"))
            .when(wrapped, there(f"$.entityAttributes.{at}")).otherwise(there(f"$.{at}"))
        )
        fault = F.when(present, F.lit("wrong type")).otherwise(F.lit("missing field"))
        return F.when(F.when(is_raw, raw).otherwise(entity).isNull(), F.struct(fault.alias("fault"), F.lit(name).alias("field")))

    bad = F.array_compact(F.array(*[of(name) for name in codec.KEY_FIELDS]))
    whole = F.when(F.col("value").isNull(), F.lit("no value")).when(F.col("v").isNull(), F.lit("malformed"))
    judged = parsed.select("topic", "partition", "offset", whole.alias("whole"), bad.alias("bad"))
    found = F.struct(
        F.coalesce("whole", F.array_max("bad.fault")).alias("fault"),
        F.when(F.col("whole").isNull(), F.array_join("bad.field", ",")).alias("fields"),
    )
    # Not a filter: that would move below the parsing and parse the value anew for every field it tests.
    kept = judged.select(
        "topic", "partition", "offset", F.when(F.col("whole").isNotNull() | (F.size("bad") > 0), found).alias("found")
    )
    return kept.select("topic", "partition", "offset", F.inline(F.array_compact(F.array("found"))))


def of_probe(records: DataFrame, id: str, lat: str, xlong: str) -> DataFrame:
    """The records of one probe."""
    key = [F.col(c) for c in ("id", "lat", "xlong")]
    return records.filter(codec.same_key(*key, F.lit(id), F.lit(lat), F.lit(xlong)))


def raw_fields(topics: DataFrame, source: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Raw messages: their key, and all attributes as a map."""
    return (
        topics.filter(F.col("topic") == raw_topic(source))
        .select(
            "partition", "offset",
            codec.raw_key(F.col("value"), mode).alias("k"),
            codec.raw_attributes(F.col("value"), mode).alias("attributes"),
        )
        .select("partition", "offset", "k.id", "k.lat", "k.xlong", "attributes")
    )


def entity_fields(topics: DataFrame, names: list[str], mode: str = "PERMISSIVE") -> DataFrame:
    """Entity and wrapped entity records: key, and the parsed envelope."""
    parsed = topics.filter(F.col("topic").isin(names)).select(
        "topic", "partition", "offset", codec.envelope(F.col("value"), mode).alias("m")
    )
    id, lat, xlong = codec.entity_key("m")
    return parsed.select(
        "topic", "partition", "offset",
        id.alias("id"), lat.alias("lat"), xlong.alias("xlong"), F.col("m").alias("message"),
    )


def validate(entities: DataFrame, nationality: str, category: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with ``fault``) by the declared enumeration symbols."""
    checked = entities.withColumn("fault", codec.enum_fault(F.col(nationality), F.col(category)))
    return checked.filter("fault IS NULL").drop("fault"), checked.filter("fault IS NOT NULL")


def write_validated(
    entities: DataFrame, nationality: str, category: str, path: str
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Both parts of ``validate`` from one write, and their counts.

    Rows are parsed and judged once: one write files them under valid=true/ and
    valid=false/, and the counts are observed while it runs.
    """
    seen = Observation("validated")
    checked = entities.withColumn("fault", codec.enum_fault(F.col(nationality), F.col(category)))
    observed = checked.observe(
        seen, F.count_if(F.col("fault").isNull()).alias("valid"), F.count_if(F.col("fault").isNotNull()).alias("rejected")
    )
    observed.withColumn("valid", F.col("fault").isNull()).write.partitionBy("valid").parquet(path)
    schema = StructType([*checked.schema.fields, StructField("valid", BooleanType())])
    written = entities.sparkSession.read.schema(schema).parquet(path)
    return written.filter("valid").drop("valid", "fault"), written.filter("NOT valid").drop("valid"), dict(seen.get)
