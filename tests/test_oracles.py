"""A spread of registered queries against their SQL; tools/check_oracles.py runs them all."""

import pytest
from check_oracles import compare, connect

import __spark_entry__ as driver

SF = "/root/testdata/sf0.01"
NAMES = [
    "s05_bar_upsert", "s14_tolerant_log", "i07_forward_fill", "i08_standardize", "i09_calendar_gaps", "t03_rolling_stats",
    "t05_rolling_beta", "t06_cumulative", "t09_exponential_means", "x02_demeaned_target", "x03_sector_neutral",
    "x05_conviction_weights", "x06_cross_sectional_ic", "b07_exposures", "b13_fills", "b14_triple_barrier", "j09_session_as_of",
    "a13_classifier_metrics", "d04_business_days", "g04_action_values", "l01_split_bounds", "l03_walk_forward_folds",
    "u05_collapse_restatements", "z01_stream_bars", "z04_stream_gap_alarms",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    got = driver.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    assert compare(got, con.execute(driver.oracle_sql()[name]).df()) == ""
