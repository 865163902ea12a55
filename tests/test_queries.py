"""The registered queries: contract, plans, and agreement with their SQL twins on the smallest tables."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
from panelweave.bindings import registry
from tools import check_queries, plan_report

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE  # of the library itself; the training data queries have their own tests
# one or more of each family; tools/check_queries.py runs all of them
SAMPLE = [
    "normalize_entity_year", "classify_code_prefix", "normalize_records", "factorize_first_seen", "make_text_key", "title_case_place",
    "left_join_panels", "two_pass_fallback_join", "rescaled_region_proxy", "task_dataset", "mismatch_report", "multi_grain_aggregate",
    "event_to_person_rollup", "two_level_string_agg", "zscore_by_period", "impute_short_gaps", "fill_cascade", "group_series_fill",
    "percentile_rank_avg", "ranked_groups_topk", "set_difference_ids", "scan_yearly_files", "upsert_keep_last", "error_metrics_grouping_sets",
    "consistency_checks", "bounded_scenario_path", "component_projection", "linear_recursive_forecast", "permutation_importance", "banded_projection_grid", "ridge_model",
    "skill_rollup_join", "preview_with_overflow", "truthy_text", "source_quality_summary", "weighted_mean_ci", "national_series_join",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in check_queries.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_twins_read_whole_tables():
    for name, text in ORACLE.items():
        assert not re.search(r"\bTABLESAMPLE\b|\bUSING SAMPLE\b", text, re.I), name


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin_and_plans_wide(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert plan_report.suspects(plan_report.plan_text(df)) == []
    rows = [tuple(r) for r in df.collect()]
    cursor = duck.execute(ORACLE[name])
    sides = check_queries.ordered(df.columns, rows), check_queries.ordered([d[0] for d in cursor.description], cursor.fetchall())
    assert sides[0][0] == sides[1][0] and len(sides[0][1]) == len(sides[1][1])
    for a, b in zip(sides[0][1], sides[1][1]):
        assert all(check_queries.near(x, y) for x, y in zip(a, b)), (a, b)
