"""Queries against DuckDB on the smallest scale factor.

``tests/check_oracles.py`` runs the whole catalogue at any scale factor; set
PANELLOOM_ALL_QUERIES=1 to do so here.
"""

from __future__ import annotations

import os

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
# One query of each operator family that the unit tests do not reach otherwise.
PICKED = """
a2_descriptive_statistics a3_quality_profile_items a5_period_pivot a6_key_figures a11_histogram
a13_scatter_rows f3_four_slices flagship_panel j1_full_outer_merge j7_row_against_frame_statistic
j8_group_pairs l4_top_listing q1_duplicate_keys q2_broken_contract r2_wide_category_grid
r3_subperiod_mean s8_value_level_fallback t3_spearman_pairs t5_significance_list
t8_shapiro_by_group t12_group_test_of_rate t13_mann_whitney_pairs t15_bootstrap_group_means
t17_component_scores t18_pressure_drivers t19_current_facts t20_cumulative_facts
w2_soft_gap_fill_segmented w7_chained_index_segmented w10_provenance_label
""".split()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_belongs_to_a_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert set(PICKED) <= names


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["entity", "grp", "period"]


NAMES = sorted(entry.queries()) if os.environ.get("PANELLOOM_ALL_QUERIES") else PICKED


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, sql) == ""
