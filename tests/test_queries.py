"""Every registered query against its SQL, over whole tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from hopmeter.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert differences(df, con, contract.oracle_sql()[name]) is None


def test_entry_has_both_phases(spark):
    phases = {r["phase"] for r in contract.entry(spark).collect()}
    assert phases == {"CREATE", "UPDATE"}


def test_second_run_gives_equal_rows(spark):
    for name in ["stage_latency_3", "probe_grid", "latency_csv_all"]:
        query = contract.queries()[name]
        assert sorted(query(spark, SF_DIR).collect()) == sorted(query(spark, SF_DIR).collect())


def test_properties_of_latencies(spark):
    from hopmeter.plans.stages import open_tables

    p = open_tables(spark, SF_DIR)
    assert p.latency.filter("total_ms <> raw_to_source_ms + source_to_update_ms").count() == 0
    by_phase = {r["phase"]: r["count"] for r in p.latency.groupBy("phase").count().collect()}
    assert sum(by_phase.values()) == p.latency.count()
    assert p.hits.filter("offset < base_offset").count() == 0
    unmatched = p.hits.filter("offset IS NULL").select("probe_id").distinct().count()
    assert unmatched + p.latency.count() == p.probes.count()
