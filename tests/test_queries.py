"""Registered queries against DuckDB. A short list by default, all of them with TICKLOOM_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SHORT = [
    "a05_contract_summary", "t02_contract_ranking", "a11_fill_distribution", "r12_ratio_bootstrap", "s06_quote_grid_next",
    "j04_forward_asof", "j05_fill_window", "w13_causal_windows", "m02_path_and_fill_labels", "x11_order_flow_imbalance",
    "a03_strata", "a17_r2_by_groups", "a20_calibration_table", "a30_binned_means", "r08_repeated_kfold", "r03_stratified_split",
]
NAMES = sorted(entry.queries()) if os.environ.get("TICKLOOM_ALL") else SHORT

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, duck, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SF).count() > 0
    else:
        assert compare(spark, duck, entry.queries()[name], sql, SF) is None


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
