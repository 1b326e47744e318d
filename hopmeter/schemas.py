"""Topic names, message schemas and the fixed values of the message formats."""

from __future__ import annotations

from pyspark.sql import types as T

UPDATE_TOPIC = "update"
CREATION_TOPIC = "creation"


def raw_topic(source: str) -> str:
    return f"{source}-raw-data"


def stage_topics(source: str) -> list[str]:
    """The three stages in travel order."""
    return [raw_topic(source), source, UPDATE_TOPIC]


TOPIC_TABLE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.StringType()),
])

COORDINATE = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
])
BASIC_ATTRIBUTES = T.StructType([
    T.StructField("coordinate", COORDINATE),
    T.StructField("isNotTracked", T.BooleanType()),
    T.StructField("entityOffset", T.LongType()),
    T.StructField("sourceName", T.StringType()),
])
ENTITY = T.StructType([
    T.StructField("basicAttributes", BASIC_ATTRIBUTES),
    T.StructField("speed", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("course", T.DoubleType()),
    T.StructField("nationality", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("pictureURL", T.StringType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("nickname", T.StringType()),
    T.StructField("externalSystemID", T.StringType()),
])
# A record of the source topic has the entity fields on top, one of the update
# topic has them inside entityAttributes; one nullable schema reads both.
ENVELOPE = T.StructType([T.StructField("entityAttributes", ENTITY), *ENTITY.fields])
DETECTION = T.StructType([
    T.StructField("sourceName", T.StringType()),
    T.StructField("externalSystemID", T.StringType()),
])
RAW_ATTRIBUTES = T.MapType(T.StringType(), T.StringType())
RAW_KEY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("lat", T.StringType()),
    T.StructField("xlong", T.StringType()),
])
# What matching needs from any of the three topics, parsed in one go.
ANY_STAGE_KEY = T.StructType([
    *RAW_KEY.fields,
    T.StructField("entityAttributes", T.StructType([
        T.StructField("basicAttributes", T.StructType([T.StructField("coordinate", COORDINATE)])),
        T.StructField("externalSystemID", T.StringType()),
    ])),
    T.StructField("basicAttributes", T.StructType([T.StructField("coordinate", COORDINATE)])),
    T.StructField("externalSystemID", T.StringType()),
])

# Constant attributes of a raw message.
RAW_CONSTANTS = {
    "category": "boat",
    "speed": "444",
    "course": "5.55",
    "elevation": "7.8",
    "nationality": "USA",
    "picture_url": "URL",
    "height": "44",
    "nickname": "mick",
}
# Constant attributes of an entity record.
ENTITY_CONSTANTS = {
    "isNotTracked": False,
    "entityOffset": 50,
    "speed": 4.7,
    "elevation": 7.8,
    "course": 8.3,
    "nationality": "USA",
    "category": "boat",
    "pictureURL": "huh?",
    "height": 6.1,
    "nickname": "rerere",
}
# Declared symbols of the two enumerations.
NATIONALITIES = ["ISRAEL", "USA", "SPAIN"]
CATEGORIES = ["airplane", "boat"]
# Entity id prefix, probe coordinates.
ENTITY_ID_PREFIX = "performanceProcess-"
FIRST_LAT, FIRST_LONG = 4.3, 6.4
CREATE_STEP = ("44.9", "95.8")
UPDATE_STEP = ("34.66", "48.66")
