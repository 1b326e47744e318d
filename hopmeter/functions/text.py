"""Small text helpers of ids, dates and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopmeter.schemas import ENTITY_ID_PREFIX

# Default text form of a date, and the report file's minute stamp.
DATE_TEXT = "EEE MMM dd HH:mm:ss zzz yyyy"
MINUTE_STAMP = "yyyyMMdd_HHmm"


def entity_id(seed: int, cycle: Column) -> Column:
    """Entity id with a random-looking signed 64-bit number.

    Taken from a digest of seed and cycle, so a retried task or a second run
    gives the same ids.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), cycle.cast("string")))
    return F.concat(F.lit(ENTITY_ID_PREFIX), F.conv(F.substring(digest, 1, 16), 16, -10))


def date_text(ts: Column) -> Column:
    return F.date_format(ts, DATE_TEXT)


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, MINUTE_STAMP)


def number_text(x: Column) -> Column:
    """Number as double text: 4.3 -> "4.3", 1500 -> "1500.0"."""
    return x.cast("double").cast("string")
