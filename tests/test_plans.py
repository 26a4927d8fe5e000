"""Physical plans: what is pushed down, shuffled and never crossed."""

import re

import pytest

import __spark_entry__ as driver
from panelforge.catalog import base
from panelforge.operators import features as feats

SF = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    p = plan(base.raw_bars(spark, SF))
    schema = re.search(r"ReadSchema: struct<(.*?)>", p).group(1)
    assert "l_tax" not in schema and "l_returnflag" not in schema and "l_quantity" in schema


def test_range_scan_prunes_and_pushes(spark, tmp_path):
    from panelforge.sources.bars import read_bars
    path = str(tmp_path / "bars")
    base.raw_bars(spark, SF).selectExpr("*", "'1wk' AS interval").write.partitionBy("interval").parquet(path)
    p = plan(read_bars(spark, path, ["1"], "1wk", "1997-01-01", "1998-12-31"))
    assert re.search(r"PartitionFilters: \[.*interval", p)
    assert "GreaterThanOrEqual(ts" in p and "LessThanOrEqual(ts" in p


def test_features_take_one_exchange(spark):
    b = base.bars(spark, SF)
    p = plan(feats.daily_features(b))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, _chunk#\d+", p)) == 1
    assert len(re.findall(r"Exchange ", p)) == 1


def test_a_symbol_is_never_one_window_partition(spark):
    p = plan(feats.daily_features(base.bars(spark, SF)))
    for spec in re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", p):
        assert "_chunk" in spec


@pytest.mark.parametrize("name", ["j02_outer_alignment", "x06_cross_sectional_ic", "x03_sector_neutral"])
def test_no_cross_joins(spark, name):
    p = plan(driver.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_entry_runs(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) > 70 and rows[0]["equity"] > 0 and any(r["n_held"] > 0 for r in rows)


def test_every_oracle_has_a_query():
    q, o = driver.queries(), driver.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140
