"""The registered queries as SQL for DuckDB, over the same given tables."""

from __future__ import annotations

from hopmeter.functions.wording import RULE
from hopmeter.operators.report import csv_labels, summary_sentences
from hopmeter.plans.catalog import GRID_UPDATES, OFF_HALVES, SEED, SLICE

PROBES = """
WITH p AS (
  SELECT event_id, user_id, value, ts, epoch_us(ts) // 1000 AS ms,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS update_no
  FROM events),
k AS (
  SELECT event_id AS probe_id, user_id AS cycle_no, update_no, ts, ms,
         'performanceProcess-' || CAST(user_id AS VARCHAR) AS id,
         CAST(CAST(4.3 AS DOUBLE) + update_no AS VARCHAR) AS lat,
         CAST(CAST(6.4 AS DOUBLE) + update_no AS VARCHAR) AS xlong,
         CAST(user_id % 4 AS INTEGER) AS part, CAST(floor(value) AS BIGINT) AS v
  FROM p)"""

TOPICS = PROBES + """,
msgs AS (
  SELECT 'src-raw-data' AS topic, part, id, lat, xlong, probe_id, ms AS ts_ms, 0 AS copy_no FROM k
  UNION ALL SELECT 'src', part, id, lat, xlong, probe_id, ms + 1 + v, 0 FROM k WHERE probe_id % 40 <> 7
  UNION ALL SELECT 'src', part, id, lat, xlong, probe_id, ms + 251 + v, 1 FROM k WHERE probe_id % 10 = 0
  UNION ALL SELECT 'src', part, id, lat, xlong, probe_id, ms - 60000, 2 FROM k WHERE probe_id % 25 = 4
  UNION ALL SELECT 'update', part, id, lat, xlong, probe_id, ms + 2 + v + probe_id % 97, 0 FROM k
            WHERE probe_id % 50 <> 3
  UNION ALL SELECT 'update', part, id, lat, xlong, probe_id, ms + 502 + v + probe_id % 97, 1 FROM k
            WHERE probe_id % 10 = 5),
topics AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY topic, part ORDER BY ts_ms, probe_id, copy_no) - 1 AS BIGINT) AS off
  FROM msgs)"""

MARKS = TOPICS + """,
marks AS (
  SELECT topic, part, ts_ms, 1 AS kind, probe_id, CAST(1 AS BIGINT) AS one FROM topics
  UNION ALL
  SELECT t.topic, k.part, k.ms, 0, k.probe_id, CAST(0 AS BIGINT)
  FROM k CROSS JOIN (SELECT DISTINCT topic FROM msgs) t),
baseline AS (
  SELECT probe_id, topic, part, base_off FROM (
    SELECT *, CAST(sum(one) OVER (PARTITION BY topic, part ORDER BY ts_ms, kind, probe_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS base_off FROM marks) z
  WHERE kind = 0),
bounds AS (SELECT topic, part, min(base_off) AS base_off FROM baseline GROUP BY topic, part)"""

HITS = MARKS + """,
hits AS (
  SELECT b.probe_id, b.topic, b.part, b.base_off, t.ts_ms, t.off,
         row_number() OVER (PARTITION BY b.probe_id, b.topic ORDER BY t.off) AS rn
  FROM baseline b JOIN k ON k.probe_id = b.probe_id
  JOIN topics t ON t.topic = b.topic AND t.part = b.part AND t.id = k.id AND t.lat = k.lat AND t.xlong = k.xlong
               AND t.off >= b.base_off),
first_hit AS (SELECT * FROM hits WHERE rn = 1)"""

FIRST_PER_KEY = """,
ranked AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.topic, t.part, id, lat, xlong ORDER BY off) AS rn
  FROM topics t JOIN bounds h ON h.topic = t.topic AND h.part = t.part WHERE t.off >= h.base_off)
SELECT topic, part AS partition, id, lat, xlong, off AS "offset", ts_ms FROM ranked WHERE rn = 1"""

UNMATCHED = """
SELECT k.probe_id, k.cycle_no, k.update_no, b.topic AS missing_topic, 'no record' AS reason
FROM baseline b JOIN k ON k.probe_id = b.probe_id
WHERE NOT EXISTS (SELECT 1 FROM first_hit h WHERE h.probe_id = b.probe_id AND h.topic = b.topic)"""

LATENCY = HITS + """,
lat AS (
  SELECT k.probe_id, k.cycle_no, k.update_no,
         CASE WHEN k.update_no = 0 THEN 'CREATE' ELSE 'UPDATE' END AS phase,
         s.ts_ms - r.ts_ms AS raw_to_source_ms, u.ts_ms - s.ts_ms AS source_to_update_ms, u.ts_ms - r.ts_ms AS total_ms
  FROM k JOIN first_hit r ON r.probe_id = k.probe_id AND r.topic = 'src-raw-data'
         JOIN first_hit s ON s.probe_id = k.probe_id AND s.topic = 'src'
         JOIN first_hit u ON u.probe_id = k.probe_id AND u.topic = 'update'),
lat2 AS (
  SELECT k.probe_id, k.cycle_no, k.update_no,
         CASE WHEN k.update_no = 0 THEN 'CREATE' ELSE 'UPDATE' END AS phase,
         u.ts_ms - s.ts_ms AS source_to_update_ms
  FROM k JOIN first_hit s ON s.probe_id = k.probe_id AND s.topic = 'src'
         JOIN first_hit u ON u.probe_id = k.probe_id AND u.topic = 'update'),
facts AS (
  SELECT k.*, br.base_off AS raw_base, bs.base_off AS source_base, bu.base_off AS update_base,
         lat.raw_to_source_ms, lat.source_to_update_ms
  FROM k JOIN baseline br ON br.probe_id = k.probe_id AND br.topic = 'src-raw-data'
         JOIN baseline bs ON bs.probe_id = k.probe_id AND bs.topic = 'src'
         JOIN baseline bu ON bu.probe_id = k.probe_id AND bu.topic = 'update'
         LEFT JOIN lat ON lat.probe_id = k.probe_id),
long AS (
  SELECT probe_id, cycle_no, update_no, phase, 'raw_to_source_ms' AS metric, raw_to_source_ms AS value FROM lat
  UNION ALL SELECT probe_id, cycle_no, update_no, phase, 'source_to_update_ms', source_to_update_ms FROM lat
  UNION ALL SELECT probe_id, cycle_no, update_no, phase, 'total_ms', total_ms FROM lat)"""

RAW_VALUE = """'{"id":"' || id || '","lat":"' || lat || '","xlong":"' || xlong || '","source_name":"src",'
  || '"category":"boat","speed":"444","course":"5.55","elevation":"7.8","nationality":"USA",'
  || '"picture_url":"URL","height":"44","nickname":"mick","timestamp":"' || CAST(ms AS VARCHAR) || '"}'"""
ENTITY_VALUE = """'{"basicAttributes":{"coordinate":{"lat":' || lat || ',"long":' || xlong
  || '},"isNotTracked":false,"entityOffset":50,"sourceName":"src"},"speed":4.7,"elevation":7.8,"course":8.3,'
  || '"nationality":"USA","category":"boat","pictureURL":"huh?","height":6.1,"nickname":"rerere",'
  || '"externalSystemID":"' || id || '"}'"""

ENTITY_ID = f"""'performanceProcess-' || CAST(
  CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END
  AS VARCHAR)"""
CYCLES = f"""
WITH c AS (
  SELECT c_custkey AS cycle_no,
         CAST('0x' || substr(md5('{SEED}:' || CAST(c_custkey AS VARCHAR)), 1, 16) AS UBIGINT) AS h
  FROM customer)"""

STATS = {
    "max": "max({x})",
    "min": "min({x})",
    "mean": "avg({x})",
    "var": "var_samp({x})",
    "varp": "var_pop({x})",
    "stddev": "stddev_samp({x})",
    "stddevp": "stddev_pop({x})",
    "sum": "coalesce(sum({x}), 0)",
}
EMPTY = {n: "CAST('nan' AS DOUBLE)" for n in STATS} | {
    "max": "CAST('-inf' AS DOUBLE)", "min": "CAST('inf' AS DOUBLE)", "sum": "0",
}
POSITION = "topic, part AS partition, off AS \"offset\""
GROUPED = """count(*) AS n, round(avg(value), 6) AS mean, median(value) AS median,
       round(stddev_pop(value), 6) AS stddev"""


LABELS = " ".join(f"WHEN '{m}' THEN '{label}'" for m, label in csv_labels("src").items())
CELL = "CAST(CAST(value AS DOUBLE) AS VARCHAR)"


def _csv(groups: list[str]) -> str:
    """Cells with label and position; a cycle without an update (or a create) keeps its labels."""
    names = "".join(f"{g}, " for g in groups)
    filled = ""
    if "phase" in groups:
        others = "".join(f"{g}, " for g in groups if g != "phase")
        filled = f"""
UNION ALL
SELECT {names}metric, CASE metric {LABELS} END, NULL, NULL
FROM (SELECT {others}phase FROM (SELECT DISTINCT {others or "1 AS one, "}0 AS zero FROM lat) o
      CROSS JOIN (VALUES ('CREATE'), ('UPDATE')) AS both_phases(phase)
      EXCEPT SELECT {others}phase FROM lat) e CROSS JOIN (SELECT DISTINCT metric FROM long) m"""
    return LATENCY + f"""
SELECT {names}metric, CASE metric {LABELS} END AS label,
       CAST(row_number() OVER (PARTITION BY {names}metric ORDER BY cycle_no, update_no) - 1 AS BIGINT) AS position,
       {CELL} AS value
FROM long{filled}"""


# Wording of sentences and blocks, as in the reports.
SENTENCES = """sentences AS (
  SELECT * FROM (VALUES {rows}) AS s(line_no, metric, statistic, text)),
numbers AS (
  SELECT metric, 'mean' AS statistic, round(avg(value), 6) AS number FROM long GROUP BY metric
  UNION ALL SELECT metric, 'median', round(median(value), 6) FROM long GROUP BY metric
  UNION ALL SELECT metric, 'stddev', round(stddev_pop(value), 6) FROM long GROUP BY metric)""".format(
    rows=", ".join(f"({n}, '{m}', '{s}', '{t}')" for n, m, s, t in summary_sentences("src"))
)

# A probe's block.
BLOCK = f"""'{RULE}' || chr(10) || 'StartTime: ' || strftime(ts, '%a %b %d %H:%M:%S UTC %Y') || chr(10)
  || 'Cycle NO: ' || cycle_no || chr(10) || 'Update NO: ' || update_no || chr(10)
  || 'externalSystemID: ' || id || chr(10) || 'lat: ' || lat || chr(10) || 'longX: ' || xlong || chr(10)
  || CASE WHEN raw_to_source_ms > 0 THEN
       'lastOffsetForRawData: ' || raw_base || chr(10) || 'lastOffsetForSource: ' || source_base || chr(10)
       || 'lastOffsetForUpdate: ' || update_base || chr(10)
       || 'The action between topics  <src-row-data> and <src> took ' || raw_to_source_ms || ' millisec' || chr(10)
       || 'The action between topics  <src> and <update> took ' || source_to_update_ms || ' millisec'
       || chr(10) || chr(10)
     ELSE '' END"""

# Sentences of one action.
ACTION = "CASE WHEN update_no = 0 THEN 'create' ELSE 'update' END"
HOP2 = f"""'The ' || {ACTION} || ' action between topics  <src> and <update> took '
  || source_to_update_ms || ' millisec' || chr(10)"""


def _std(name: str) -> str:
    expression = STATS[name].format(x="value")
    return f"SELECT event_type, round({expression}, 6) AS {name} FROM events GROUP BY event_type"


def _report() -> str:
    return LATENCY + f""",
{SENTENCES},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY phase, metric ORDER BY cycle_no, update_no) - 1 AS pos FROM long),
blocks AS (SELECT {BLOCK} AS block FROM facts)
SELECT unnest(string_split(substr(block, 1, length(block) - 1), chr(10))) AS line FROM blocks
UNION ALL SELECT text || CAST(number AS VARCHAR) FROM sentences JOIN numbers USING (metric, statistic)
UNION ALL SELECT CASE metric {LABELS} END || ',' || pos || ',' || {CELL} FROM placed
UNION ALL SELECT unnest(['', 'Export to CSV ', 'CREATE', '', 'UPDATE', '', ''])"""


# What each way of spoiling a document does to it, by topic.
REJECTS = """,
rejects AS (
  SELECT *, CASE off % 11 WHEN 1 THEN 'malformed' WHEN 9 THEN 'no value' WHEN 3 THEN 'missing field'
              WHEN 5 THEN CASE WHEN topic <> 'src-raw-data' THEN 'wrong type' END
              WHEN 7 THEN CASE WHEN topic <> 'src-raw-data' THEN 'missing field' END END AS fault,
            CASE off % 11 WHEN 3 THEN 'lat'
              WHEN 5 THEN CASE WHEN topic <> 'src-raw-data' THEN 'xlong' END
              WHEN 7 THEN CASE WHEN topic <> 'src-raw-data' THEN 'id' END END AS fields
  FROM topics)"""


def _slices() -> str:
    values = ", ".join(
        f"CASE WHEN fault IS NULL THEN round(coalesce({e.format(x='v.value')}, {EMPTY[n]}) + {OFF_HALVES}, 6) END AS {n}"
        for n, e in STATS.items()
    )
    return f"""
WITH placed AS (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events),
sizes AS (SELECT event_type, count(*) AS size FROM events GROUP BY event_type),
asked AS (
  SELECT event_id, event_type, user_id % 40 AS lo, user_id % 40 + event_id % 300 - 2 AS hi FROM events),
judged AS (
  SELECT a.*, CASE WHEN lo < 0 OR lo > hi THEN 'slice bounds out of order'
                   WHEN hi > size THEN 'slice bounds out of range' END AS fault
  FROM asked a JOIN sizes s ON s.event_type = a.event_type)
SELECT event_id, j.event_type, lo, hi, fault, {values}
FROM judged j LEFT JOIN placed v ON v.event_type = j.event_type AND v.pos >= j.lo AND v.pos < j.hi AND j.fault IS NULL
GROUP BY event_id, j.event_type, lo, hi, fault"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "topic_scan": TOPICS + f"""
SELECT {POSITION}, ts_ms, {ENTITY_VALUE} AS value FROM topics WHERE topic = 'src'""",
        "earliest_scan": TOPICS + f" SELECT {POSITION}, ts_ms FROM topics",
        "end_offsets": TOPICS + """
SELECT topic, part AS partition, max(off) + 1 AS end_offset FROM topics GROUP BY topic, part
UNION ALL SELECT DISTINCT 'creation', part, CAST(0 AS BIGINT) FROM topics""",
        "scan_from_offset": MARKS + """
SELECT t.topic, t.part AS partition, t.off AS "offset", t.ts_ms
FROM topics t JOIN bounds h ON h.topic = t.topic AND h.part = t.part WHERE t.off >= h.base_off""",
        "end_offsets_indexed": TOPICS + """
SELECT topic, part AS partition, max(off) + 1 AS end_offset FROM topics GROUP BY topic, part""",
        "baseline_offsets_indexed": MARKS + """
SELECT probe_id, topic, part AS partition, base_off AS base_offset FROM baseline""",
        "scan_from_offset_indexed": MARKS + """,
late AS (
  SELECT b.topic, b.part, min(b.base_off) AS base_off FROM baseline b JOIN k ON k.probe_id = b.probe_id
  WHERE k.ms * 2 >= (SELECT min(ms) + max(ms) FROM k) GROUP BY b.topic, b.part)
SELECT t.topic, t.part AS partition, t.off AS "offset", t.ts_ms
FROM topics t JOIN late h ON h.topic = t.topic AND h.part = t.part WHERE t.off >= h.base_off""",
        "decode_rejects": TOPICS + REJECTS + f" SELECT {POSITION}, fault, fields FROM rejects WHERE fault IS NOT NULL",
        "decode_reject_counts": TOPICS + REJECTS + """
SELECT topic, fault, count(*) AS n FROM rejects WHERE fault IS NOT NULL GROUP BY topic, fault""",
        "kafka_starting_offsets": MARKS + """,
per_topic AS (
  SELECT topic, '"' || topic || '":{' ||
         string_agg('"' || part || '":' || base_off, ',' ORDER BY part) || '}' AS entry
  FROM bounds GROUP BY topic)
SELECT '{' || string_agg(entry, ',' ORDER BY entry) || '}' AS starting_offsets FROM per_topic""",
        "baseline_offsets": MARKS + """
SELECT probe_id, topic, part AS partition, base_off AS base_offset FROM baseline""",
        "raw_json_decode": TOPICS + """
SELECT part AS partition, off AS "offset", id, lat, xlong, 'boat' AS category,
       CAST(ts_ms AS VARCHAR) AS sent_ms, 13 AS n_attributes
FROM topics WHERE topic = 'src-raw-data'""",
        "envelope_decode": TOPICS + f"""
SELECT {POSITION}, id, lat, xlong, topic = 'update' AS is_wrapped, CAST(4.7 AS DOUBLE) AS speed,
       CAST(50 AS BIGINT) AS entity_offset
FROM topics WHERE topic IN ('src', 'update')""",
        "unified_topic_records": TOPICS + f" SELECT {POSITION}, ts_ms, id, lat, xlong FROM topics",
        "match_predicate": TOPICS + """
SELECT t.topic, t.part AS partition, t.off AS "offset",
       coalesce(t.lat = c.lat AND t.xlong = c.xlong, false) AS matches
FROM topics t LEFT JOIN k c ON c.id = t.id AND c.update_no = 0""",
        "event_props_decode": """
SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS INTEGER) AS n_attributes
FROM events""",
        "first_match_any_partition": TOPICS + """,
moved AS (SELECT *, CAST(CASE WHEN topic = 'src' THEN (part + 1) % 4 ELSE part END AS INTEGER) AS lands FROM topics),
ranked AS (
  SELECT k.probe_id, t.topic, t.lands, t.off, t.ts_ms,
         row_number() OVER (PARTITION BY k.probe_id, t.topic ORDER BY t.ts_ms, t.lands, t.off) AS rn
  FROM k JOIN moved t ON t.id = k.id AND t.lat = k.lat AND t.xlong = k.xlong AND t.ts_ms >= k.ms)
SELECT probe_id, topic, lands AS partition, off AS "offset", ts_ms FROM ranked WHERE rn = 1""",
        "entity_validate": PROBES + """,
named AS (
  SELECT probe_id, ['ISRAEL', 'USA', 'SPAIN', 'FRANCE'][probe_id % 4 + 1] AS nationality,
         ['airplane', 'boat', 'car'][probe_id % 3 + 1] AS category FROM k)
SELECT *, CASE WHEN nationality = 'FRANCE' AND category = 'car' THEN 'nationality,category'
               WHEN nationality = 'FRANCE' THEN 'nationality' WHEN category = 'car' THEN 'category' END AS fault
FROM named""",
        "raw_json_encode": PROBES + f" SELECT probe_id, {RAW_VALUE} AS value FROM k",
        "entity_encode": PROBES + f"""
SELECT probe_id, {ENTITY_VALUE} AS source_value, '{{"entityAttributes":' || {ENTITY_VALUE} || '}}' AS update_value
FROM k""",
        "detection_encode": PROBES + """
SELECT DISTINCT 'creation' AS topic, '{"sourceName":"src","externalSystemID":"' || id || '"}' AS value FROM k""",
        "probe_grid": CYCLES + f"""
SELECT cycle_no, CAST(u AS BIGINT) AS update_no, {ENTITY_ID} AS id,
       CAST(CAST(4.3 AS DOUBLE) + u AS VARCHAR) AS lat, CAST(CAST(6.4 AS DOUBLE) + u AS VARCHAR) AS xlong,
       'src' AS source_name
FROM c CROSS JOIN range({GRID_UPDATES}) AS r(u)""",
        "two_step_probes": CYCLES + f"""
SELECT cycle_no, {ENTITY_ID} AS id, s.update_no, s.action, s.lat, s.xlong, 'src' AS source_name
FROM c CROSS JOIN (VALUES (CAST(0 AS BIGINT), 'create', '44.9', '95.8'),
                          (CAST(1 AS BIGINT), 'update', '34.66', '48.66')) AS s(update_no, action, lat, xlong)""",
        "update_ordinal": PROBES + """
SELECT probe_id AS event_id, cycle_no AS user_id, update_no,
       CASE WHEN update_no = 0 THEN 'CREATE' ELSE 'UPDATE' END AS phase FROM k""",
        "first_match_asof": HITS + """
SELECT probe_id, topic, part AS partition, base_off AS base_offset, off AS "offset", ts_ms FROM first_hit""",
        "first_match_bucketed": HITS + """
SELECT probe_id, topic, part AS partition, base_off AS base_offset, off AS "offset", ts_ms FROM first_hit""",
        "stage_latency_3": LATENCY + " SELECT * FROM lat",
        "stage_latency_2": LATENCY + " SELECT * FROM lat2",
        "unmatched_probes": HITS + UNMATCHED,
        "latency_mean": LATENCY + " SELECT metric, round(avg(value), 6) AS mean FROM long GROUP BY metric",
        "latency_median": LATENCY + " SELECT metric, median(value) AS median FROM long GROUP BY metric",
        "latency_stddev_pop": LATENCY + """
SELECT metric, round(stddev_pop(value), 6) AS stddev FROM long GROUP BY metric""",
        "latency_summary": LATENCY + f" SELECT metric, {GROUPED} FROM long GROUP BY metric",
        "latency_by_phase": LATENCY + f" SELECT phase, metric, {GROUPED} FROM long GROUP BY phase, metric",
        "phase_vectors": LATENCY + " SELECT probe_id, cycle_no, update_no, phase, metric, value FROM long",
        "cycle_collect": LATENCY + """
SELECT cycle_no, CAST(row_number() OVER (PARTITION BY cycle_no ORDER BY update_no) - 1 AS BIGINT) AS position,
       update_no, raw_to_source_ms, source_to_update_ms
FROM lat""",
        "metric_sorted": LATENCY + """
SELECT metric, CAST(row_number() OVER (PARTITION BY metric ORDER BY value, probe_id) - 1 AS BIGINT) AS position, value
FROM long""",
        "std_slice": f"""
WITH placed AS (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos
  FROM events),
masked AS (
  SELECT event_type, CASE WHEN pos >= {SLICE[0]} AND pos < {SLICE[1]} THEN value END AS x FROM placed)
SELECT event_type, {", ".join(f"round({e.format(x='x')}, 6) AS {n}" for n, e in STATS.items())}
FROM masked GROUP BY event_type""",
        "latency_csv": _csv(["cycle_no", "phase"]),
        "latency_csv_all": _csv([]),
        "latency_csv_phase": _csv(["phase"]),
        "probe_report": LATENCY + f" SELECT cycle_no, update_no, {BLOCK} AS block FROM facts",
        "summary_report": LATENCY + f""",
{SENTENCES}
SELECT line_no, text || CAST(number AS VARCHAR) AS line FROM sentences JOIN numbers USING (metric, statistic)""",
        "action_report": LATENCY + f"""
SELECT cycle_no, update_no,
  CASE WHEN update_no = 0 THEN 'Create a new entity' || chr(10) || '===================' || chr(10)
       ELSE 'Update the entity' || chr(10) || '=================' || chr(10) END
  || 'The current offset before produce the message are ' || chr(10)
  || 'src-raw-data : ' || raw_base || chr(10) || 'src :' || source_base || chr(10)
  || 'update :' || update_base || chr(10)
  || 'The ' || {ACTION} || ' action between topics  <src-row-data> and <src> took '
  || raw_to_source_ms || ' millisec' || chr(10) || {HOP2}
  || CASE WHEN update_no = 0 THEN chr(10) ELSE '' END AS text
FROM facts WHERE raw_to_source_ms IS NOT NULL""",
        "action_report_2": LATENCY + f" SELECT cycle_no, update_no, {HOP2} AS text FROM lat2",
        "action_report_short": LATENCY + f"""
SELECT cycle_no, update_no, 'The ' || {ACTION} || ' took ' || source_to_update_ms || ' millisec' || chr(10) AS text
FROM lat2""",
        "report_sink": _report(),
        "stream_topic_read": TOPICS + f" SELECT {POSITION}, ts_ms FROM topics",
        "stream_sink": TOPICS + f" SELECT {POSITION}, ts_ms FROM topics",
        "stream_first_match": MARKS + FIRST_PER_KEY,
        "stream_first_match_once": MARKS + FIRST_PER_KEY,
        "stream_stage_latency": LATENCY + " SELECT * FROM lat",
        "stream_unmatched": HITS + UNMATCHED,
        "stream_latency_summary": LATENCY + f" SELECT metric, {GROUPED} FROM long GROUP BY metric",
        "std_slices": _slices(),
    }
    for name in STATS:
        sql[f"std_{name}"] = _std(name)
    return sql
