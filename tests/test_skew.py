"""All queries on data where one user holds a third of the events and one moment many of them.

The limit of an ordinary group is set so low that hot groups take the split ways.
"""

import duckdb
import pytest
from compare import connect, differences

import __spark_entry__ as contract
from hopmeter.operators.skew import GROUP_ROWS_SETTING

SF_DIR = "/root/testdata/sf0.001"
SPLIT = [
    "update_ordinal", "earliest_scan", "baseline_offsets", "first_match_asof", "stage_latency_3",
    "unmatched_probes", "latency_by_phase", "cycle_collect", "metric_sorted", "std_slice", "latency_csv",
    "latency_csv_all", "stream_stage_latency", "stream_first_match",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    con.execute(f"""
        COPY (SELECT event_id, CASE WHEN event_id % 5 = 1 THEN TIMESTAMP '2024-01-09 10:00:00.5' ELSE ts END AS ts,
                     CASE WHEN event_id % 3 = 0 THEN CAST(7 AS BIGINT) ELSE user_id END AS user_id,
                     event_type, value, props
              FROM read_parquet('{SF_DIR}/events.parquet'))
        TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", SPLIT)
@pytest.mark.parametrize("limit", ["20", "100000"])
def test_split_ways_give_the_same_rows(spark, skewed, name, limit):
    spark.conf.set(GROUP_ROWS_SETTING, limit)
    try:
        df = contract.queries()[name](spark, skewed)
        assert differences(df, connect(skewed), contract.oracle_sql()[name]) is None
    finally:
        spark.conf.unset(GROUP_ROWS_SETTING)
