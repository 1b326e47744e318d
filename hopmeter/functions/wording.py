"""All wording of the reports, kept verbatim with its spelling and spacing.

``{source}`` stands for the source topic.
"""

# Report file, by minute stamp.
REPORT_FILE = "enginePeformanceResult_{stamp}.log"

# Block of one probe: a rule, then a line per label.
RULE = "*" * 42
START_TIME = "StartTime: "
CYCLE_NO = "Cycle NO: "
UPDATE_NO = "Update NO: "
ENTITY_ID = "externalSystemID: "
LAT = "lat: "
LONG = "longX: "
RAW_OFFSET = "lastOffsetForRawData: "
SOURCE_OFFSET = "lastOffsetForSource: "
UPDATE_OFFSET = "lastOffsetForUpdate: "
PROBE_HOP_1 = "The action between topics  <{source}-row-data> and <{source}> took "
PROBE_HOP_2 = "The action between topics  <{source}> and <update> took "
MILLISEC = " millisec"

# Report of one action.
CREATE_TITLE = "Create a new entity\n===================\n"
UPDATE_TITLE = "Update the entity\n=================\n"
OFFSETS_TITLE = "The current offset before produce the message are \n"
OFFSETS_RAW = "{source}-raw-data : "
OFFSETS_SOURCE = "{source} :"
OFFSETS_UPDATE = "update :"
ACTION_HOP_1 = " action between topics  <{source}-row-data> and <{source}> took "
ACTION_HOP_2 = " action between topics  <{source}> and <update> took "

# The same sentence in the mode of two topics.
ACTION_TOOK = " took "

# Summary sentences in order: (metric, statistic, text before the number).
SUMMARY = [
    ("raw_to_source_ms", "mean", "The average between <{source}-row-data> and <{source}> is "),
    ("source_to_update_ms", "mean", "The average between <{source}> and <update> is "),
    ("total_ms", "mean", "The average of total is "),
    ("raw_to_source_ms", "median", "The median between <{source}-row-data> and <{source}> is "),
    ("source_to_update_ms", "median", "The median between <{source}> and <update> is "),
    ("total_ms", "median", "The median of total is "),
    ("raw_to_source_ms", "stddev", "The standard deviation between <{source}-row-data> and <{source}> is "),
    ("source_to_update_ms", "stddev", "The standard deviation  between <{source}> and <update> is "),
    ("total_ms", "stddev", "The standard deviation  of total is "),
]

# First cell of the CSV line of each metric.
CSV_LABELS = {
    "raw_to_source_ms": "DiffTime between between <{source}-row-data> and <{source}>",
    "source_to_update_ms": "DiffTime between <{source}> and <update>",
    "total_ms": "Total DiffTime",
}

# Headings of the whole report.
CSV_HEADING = "Export to CSV "
CREATE_HEADING = "CREATE"
UPDATE_HEADING = "UPDATE"
