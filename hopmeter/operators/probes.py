"""Probe tables: which entity is sent where, in which cycle and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter import schemas as S
from hopmeter.functions import codec
from hopmeter.functions.text import entity_id, number_text
from hopmeter.operators.ordinal import with_ordinal

# Numbers made from one row at a time when a cycle is unfolded into updates.
_UNFOLD = 10_000


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def coordinates(update_no: Column) -> tuple[Column, Column]:
    """lat and long text of an update: both grow by one per update."""
    return (
        number_text(F.lit(S.FIRST_LAT) + update_no),
        number_text(F.lit(S.FIRST_LONG) + update_no),
    )


def probe_grid(cycles: DataFrame, num_updates: int, source: str, seed: int = 0) -> DataFrame:
    """``num_updates`` probes for every row of ``cycles`` (cycle_no), one entity id per cycle."""
    if num_updates < 1:
        raise ValueError("a cycle needs at least one update")
    starts = cycles.select(
        "cycle_no",
        F.explode(F.sequence(_long(0), _long(num_updates - 1), _long(_UNFOLD))).alias("_from"),
    )
    last = F.least(F.col("_from") + (_UNFOLD - 1), _long(num_updates - 1))
    grid = starts.select("cycle_no", F.explode(F.sequence("_from", last)).alias("update_no"))
    lat, xlong = coordinates(F.col("update_no"))
    return grid.select(
        "cycle_no",
        "update_no",
        entity_id(seed, F.col("cycle_no")).alias("id"),
        lat.alias("lat"),
        xlong.alias("xlong"),
        F.lit(source).alias("source_name"),
    )


def two_step_probes(cycles: DataFrame, source: str, seed: int = 0) -> DataFrame:
    """A create and an update probe at fixed coordinates for every row of ``cycles``."""
    steps = F.array(*[
        F.struct(
            F.lit(n).cast("long").alias("update_no"),
            F.lit(action).alias("action"),
            F.lit(lat).alias("lat"),
            F.lit(xlong).alias("xlong"),
        )
        for n, (action, (lat, xlong)) in enumerate(
            [("create", S.CREATE_STEP), ("update", S.UPDATE_STEP)]
        )
    ])
    return cycles.select(
        "cycle_no",
        entity_id(seed, F.col("cycle_no")).alias("id"),
        F.inline(steps),
        F.lit(source).alias("source_name"),
    )


def raw_messages(probes: DataFrame, source: str) -> DataFrame:
    """What the probes send in a three-stage run: topic and value."""
    value = codec.raw_message(F.col("id"), F.col("lat"), F.col("xlong"), source, F.col("ms"))
    return probes.select(F.lit(S.raw_topic(source)).alias("topic"), value.alias("value"))


def entity_messages(probes: DataFrame, source: str) -> DataFrame:
    """What the probes send in a two-stage run, and a detection per new entity."""
    record = codec.entity_record(F.col("id"), F.col("lat"), F.col("xlong"), source)
    sent = probes.select(F.lit(source).alias("topic"), codec.entity_message(record).alias("value"))
    return detections(probes, source).unionByName(sent)


def detections(probes: DataFrame, source: str) -> DataFrame:
    """One message per entity for the creation topic."""
    return probes.select("id").distinct().select(
        F.lit(S.CREATION_TOPIC).alias("topic"),
        codec.detection_message(F.col("id"), source).alias("value"),
    )


def number_updates(
    events: DataFrame, cycle: str, order: list[str], group_rows: int | None = None
) -> DataFrame:
    """Add ``update_no``, the position of an event in its cycle."""
    return with_ordinal(events, [cycle], order, "update_no", group_rows)
