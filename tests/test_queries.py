"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from check_oracles import difference, oracle_connection

SF = "/root/testdata/sf0.001"
CHECKED = (
    "src_panel", "read_meetings", "xml_meetings", "demand_metrics", "course_summary", "history_features", "risk_label",
    "validate_tables", "stable_terms", "lag_panel", "course_continuity", "eda_numeric", "feat_scale", "baseline_metrics",
    "model_metrics", "conflict_edges", "schedule_quality", "event_chain", "dash_sample",
)


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 10


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, connection, name):
    verdict = difference(spark, connection, name, spark_entry.queries()[name], spark_entry.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict
