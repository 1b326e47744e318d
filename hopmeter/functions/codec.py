"""Message texts: building them and reading them back, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopmeter import schemas as S


def raw_message(id: Column, lat: Column, xlong: Column, source: str, start_ms: Column) -> Column:
    """Flat JSON of the raw topic; every value is a string."""
    constants = [F.lit(v).alias(k) for k, v in S.RAW_CONSTANTS.items()]
    return F.to_json(F.struct(
        id.cast("string").alias("id"),
        lat.cast("string").alias("lat"),
        xlong.cast("string").alias("xlong"),
        F.lit(source).alias("source_name"),
        *constants,
        start_ms.cast("string").alias("timestamp"),
    ))


def entity_record(
    id: Column,
    lat: Column,
    xlong: Column,
    source: str,
    nationality: Column | None = None,
    category: Column | None = None,
    strict: bool = True,
) -> Column:
    """Nested entity record; coordinates arrive as text and are parsed to double.

    Text that is no number fails the job, or gives null with ``strict=False``.
    """
    c = S.ENTITY_CONSTANTS

    def number(x: Column) -> Column:
        return x.cast("double") if strict else x.try_cast("double")

    basic = F.struct(
        F.struct(number(lat).alias("lat"), number(xlong).alias("long")).alias("coordinate"),
        F.lit(c["isNotTracked"]).alias("isNotTracked"),
        F.lit(c["entityOffset"]).cast("long").alias("entityOffset"),
        F.lit(source).alias("sourceName"),
    )
    return F.struct(
        basic.alias("basicAttributes"),
        F.lit(c["speed"]).alias("speed"),
        F.lit(c["elevation"]).alias("elevation"),
        F.lit(c["course"]).alias("course"),
        (F.lit(c["nationality"]) if nationality is None else nationality).alias("nationality"),
        (F.lit(c["category"]) if category is None else category).alias("category"),
        F.lit(c["pictureURL"]).alias("pictureURL"),
        F.lit(c["height"]).alias("height"),
        F.lit(c["nickname"]).alias("nickname"),
        id.cast("string").alias("externalSystemID"),
    )


def entity_message(record: Column) -> Column:
    """Value of the source topic."""
    return F.to_json(record)


def update_message(record: Column) -> Column:
    """Value of the update topic: the entity record one level deeper."""
    return F.to_json(F.struct(record.alias("entityAttributes")))


def detection_message(id: Column, source: str) -> Column:
    """Value of the creation topic."""
    return F.to_json(F.struct(
        F.lit(source).alias("sourceName"), id.cast("string").alias("externalSystemID")
    ))


def raw_attributes(value: Column, mode: str = "PERMISSIVE") -> Column:
    """All attributes of a raw message as a string map."""
    return F.from_json(value, S.RAW_ATTRIBUTES, {"mode": mode})


def raw_key(value: Column, mode: str = "PERMISSIVE") -> Column:
    """id, lat and xlong of a raw message; of a repeated key the last one counts."""
    return F.from_json(value, S.RAW_KEY, {"mode": mode})


def envelope(value: Column, mode: str = "PERMISSIVE") -> Column:
    """An entity or wrapped entity record with all its fields."""
    return F.from_json(value, S.ENVELOPE, {"mode": mode})


def any_stage_key(value: Column, mode: str = "PERMISSIVE") -> Column:
    """Only the fields that matching needs, whichever topic the value is from."""
    return F.from_json(value, S.ANY_STAGE_KEY, {"mode": mode})


#: Names of the key's fields as the raw topic has them, and where an entity record has them.
KEY_FIELDS = ["id", "lat", "xlong"]
ENTITY_PATHS = {
    "id": "externalSystemID", "lat": "basicAttributes.coordinate.lat", "xlong": "basicAttributes.coordinate.long",
}


def entity_key(message: str) -> tuple[Column, Column, Column]:
    """(id, lat, long) of a parsed envelope column, coordinates as text.

    The wrapper decides as a whole: where it is present, nothing is taken from
    the top level, even if a wrapped field is missing.
    """
    wrapped = F.col(f"{message}.entityAttributes").isNotNull()

    def pick(path: str) -> Column:
        inside = F.col(f"{message}.entityAttributes.{path}")
        return F.when(wrapped, inside).otherwise(F.col(f"{message}.{path}"))

    return (
        pick("externalSystemID"),
        pick("basicAttributes.coordinate.lat").cast("string"),
        pick("basicAttributes.coordinate.long").cast("string"),
    )


def same_key(
    id: Column, lat: Column, xlong: Column, want_id: Column, want_lat: Column, want_long: Column
) -> Column:
    """A record belongs to a probe when id, lat and long agree as text ("4.30" is not "4.3")."""
    return (id == want_id) & (lat == want_lat) & (xlong == want_long)


def enum_fault(nationality: Column, category: Column) -> Column:
    """Null for declared symbols, otherwise which attribute is outside its domain."""
    bad_nationality = F.coalesce(~nationality.isin(S.NATIONALITIES), F.lit(True))
    bad_category = F.coalesce(~category.isin(S.CATEGORIES), F.lit(True))
    fault = F.concat_ws(
        ",",
        F.when(bad_nationality, F.lit("nationality")),
        F.when(bad_category, F.lit("category")),
    )
    return F.when(fault != "", fault)
