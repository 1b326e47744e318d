"""Texts: probe blocks, summary sentences, CSV lines, the whole report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopmeter.functions import wording as W
from hopmeter.functions.text import date_text, number_text
from hopmeter.operators.latency import METRICS
from hopmeter.operators.ordinal import with_ordinal
from hopmeter.operators.summary import latency_summary
from hopmeter.session import cut


def csv_labels(source: str) -> dict[str, str]:
    return {metric: text.format(source=source) for metric, text in W.CSV_LABELS.items()}


def summary_sentences(source: str) -> list[tuple[int, str, str, str]]:
    """(line, metric, statistic, text before the number)."""
    return [
        (no, metric, statistic, text.format(source=source))
        for no, (metric, statistic, text) in enumerate(W.SUMMARY, start=1)
    ]


def latency_csv(
    latency: DataFrame,
    source: str,
    group_cols: Sequence[str] = ("cycle_no", "phase"),
    order: Sequence[str] = ("cycle_no", "update_no"),
    group_rows: int | None = None,
) -> DataFrame:
    """CSV cells, one row per value: group, metric, label, position in arrival order, value as text.

    However long a vector is, no row grows with it, and every row has its label.
    ``group_cols=[]`` takes everything as one vector per metric. An empty vector
    keeps its label, in a row with neither position nor value: where ``phase`` is
    a group column, both phases are there for every other group.
    """
    groups = list(group_cols)
    placed = with_ordinal(
        latency.select(*dict.fromkeys([*groups, *order, *METRICS])), groups, list(order), "position", group_rows
    )
    labels = F.create_map(*[F.lit(t) for pair in csv_labels(source).items() for t in pair])
    cells = placed.unpivot([*groups, "position"], METRICS, "metric", "_value").select(
        *groups, "metric", "position", number_text(F.col("_value")).alias("value")
    )
    missing = _empty_vectors(latency, groups).select(
        *groups, F.explode(F.array(*map(F.lit, METRICS))).alias("metric"),
        F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("value"),
    )
    return cells.unionByName(missing).select(
        *groups, "metric", labels[F.col("metric")].alias("label"), "position", "value"
    )


def _empty_vectors(latency: DataFrame, groups: list[str]) -> DataFrame:
    """Groups that have a vector without values."""
    if "phase" in groups:
        others = [c for c in groups if c != "phase"]
        seen = latency.groupBy(*others).agg(F.collect_set("phase").alias("_seen"))
        both = F.array(F.lit("CREATE"), F.lit("UPDATE"))
        return seen.select(*others, F.explode(F.array_except(both, "_seen")).alias("phase")).select(*groups)
    if groups:
        return latency.select(*groups).limit(0)
    return latency.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")


def _line(label: str, value: Column | str, end: str = "") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(label), value.cast("string"), F.lit(end))


def probe_report(probes: DataFrame, source: str) -> DataFrame:
    """A text block per probe; offsets and latencies only for a positive first hop.

    ``probes``: start_time, cycle_no, update_no, id, lat, xlong, the three base
    offsets and the two hops (null for a probe without a full match).
    """
    always = F.concat_ws(
        "\n",
        F.lit(W.RULE),
        _line(W.START_TIME, date_text(F.col("start_time"))),
        _line(W.CYCLE_NO, "cycle_no"),
        _line(W.UPDATE_NO, "update_no"),
        _line(W.ENTITY_ID, "id"),
        _line(W.LAT, "lat"),
        _line(W.LONG, "xlong"),
        F.lit(""),
    )
    measured = F.concat_ws(
        "\n",
        _line(W.RAW_OFFSET, "raw_base"),
        _line(W.SOURCE_OFFSET, "source_base"),
        _line(W.UPDATE_OFFSET, "update_base"),
        _line(W.PROBE_HOP_1.format(source=source), "raw_to_source_ms", W.MILLISEC),
        _line(W.PROBE_HOP_2.format(source=source), "source_to_update_ms", W.MILLISEC),
        F.lit(""), F.lit(""),
    )
    guard = F.col("raw_to_source_ms") > 0
    return probes.select(
        "cycle_no", "update_no",
        F.concat(always, F.when(guard, measured).otherwise("")).alias("block"),
    )


def action_report(
    probes: DataFrame, source: str, stages: int = 3, short: bool = False
) -> DataFrame:
    """Sentences per create or update action, with the base offsets for three stages.

    ``short`` is the wording of the mode that names no topics; it has two stages.
    """
    create = F.col("update_no") == 0
    start = F.when(create, F.lit("The create")).otherwise(F.lit("The update"))
    end = W.MILLISEC + "\n"
    second = F.concat(start, _line(W.ACTION_HOP_2.format(source=source), "source_to_update_ms", end))
    if short:
        text = F.concat(start, _line(W.ACTION_TOOK, "source_to_update_ms", end))
    elif stages == 2:
        text = second
    else:
        text = F.concat(
            F.when(create, F.lit(W.CREATE_TITLE)).otherwise(F.lit(W.UPDATE_TITLE)),
            F.lit(W.OFFSETS_TITLE),
            _line(W.OFFSETS_RAW.format(source=source), "raw_base", "\n"),
            _line(W.OFFSETS_SOURCE.format(source=source), "source_base", "\n"),
            _line(W.OFFSETS_UPDATE, "update_base", "\n"),
            start, _line(W.ACTION_HOP_1.format(source=source), "raw_to_source_ms", end),
            second,
            F.when(create, F.lit("\n")).otherwise(""),
        )
    return probes.select("cycle_no", "update_no", text.alias("text"))


def summary_report(latency: DataFrame, source: str, digits: int = 6) -> DataFrame:
    """The nine summary sentences."""
    numbers = latency_summary(latency).unpivot(
        ["metric"], ["mean", "median", "stddev"], "statistic", "number"
    )
    sentence = F.lit(None).cast("string")
    line_no = F.lit(None).cast("int")
    for no, metric, statistic, text in summary_sentences(source):
        here = (F.col("metric") == metric) & (F.col("statistic") == statistic)
        sentence = F.when(here, F.lit(text)).otherwise(sentence)
        line_no = F.when(here, F.lit(no)).otherwise(line_no)
    return numbers.select(
        line_no.alias("line_no"),
        # Statistics of no latencies are no numbers.
        F.concat(sentence, F.coalesce(number_text(F.round("number", digits)), F.lit("NaN"))).alias("line"),
    )


def full_report(
    probes: DataFrame, latency: DataFrame, source: str, digits: int = 6,
    group_rows: int | None = None,
) -> DataFrame:
    """All parts of the multi-cycle report as ordered rows: part, a, b, text.

    The CSV part is written one value to a line: label, position, value.
    """
    spark = latency.sparkSession
    blocks = probe_report(probes, source).select(
        F.lit(1).alias("part"), F.col("cycle_no").alias("a"), F.col("update_no").alias("b"),
        # Text files end every row with a newline already.
        F.expr("substr(block, 1, length(block) - 1)").alias("text"),
    )
    sentences = summary_report(latency, source, digits).select(
        F.lit(3).alias("part"), F.col("line_no").cast("long").alias("a"),
        F.lit(0).cast("long").alias("b"), F.col("line").alias("text"),
    )
    csv = latency_csv(latency, source, ["phase"], group_rows=group_rows)
    rank = F.lit(0)
    for i, m in enumerate(METRICS):
        rank = F.when(F.col("metric") == m, F.lit(i)).otherwise(rank)
    cells = csv.select(
        F.when(F.col("phase") == "CREATE", F.lit(6)).otherwise(F.lit(9)).alias("part"),
        rank.cast("long").alias("a"), F.coalesce("position", F.lit(0)).alias("b"),
        F.concat("label", F.lit(","), F.concat_ws(",", F.col("position").cast("string"), "value")).alias("text"),
    )
    headings = spark.createDataFrame(
        [
            (2, 0, 0, ""), (4, 0, 0, W.CSV_HEADING), (5, 0, 0, W.CREATE_HEADING), (7, 0, 0, ""),
            (8, 0, 0, W.UPDATE_HEADING), (10, 0, 0, ""), (11, 0, 0, ""),
        ],
        "part int, a long, b long, text string",
    )
    return blocks.unionByName(sentences).unionByName(cells).unionByName(headings)


def write_report(report: DataFrame, folder: str, stamp: str) -> str:
    """Write the ordered report under its minute stamp; a second run in that minute replaces it.

    Finding the ranges of the order reads the rows once more: from a written table, not from their operators.
    """
    path = f"{folder}/{W.REPORT_FILE.format(stamp=stamp)}"
    cut(report.select("part", "a", "b", "text"), "report-rows").orderBy("part", "a", "b").select("text").write.mode("overwrite").text(path)
    return path
