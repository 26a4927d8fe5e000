"""Ranks of dates that one task holds."""

import pandas as pd

from panelforge.operators.xsec import cross_sectional_normalize


def test_ranks_of_whole_dates_hold_no_sort_for_each_column(spark):
    df = spark.createDataFrame([(i % 2, f"s{i}", float(i % 5) if i % 7 else None, -float(i)) for i in range(60)], "ts int, symbol string, a double, b double")
    got = cross_sectional_normalize(df, ["a", "b"], min_names=10)
    assert got._jdf.queryExecution().executedPlan().toString().count("Window") == 0
    want = df.toPandas()
    g = want.groupby("ts")
    for c in ("a", "b"):
        want[c] = 2 * g[c].rank() / g[c].transform("count") - 1
    got = got.toPandas().set_index("symbol").sort_index()
    pd.testing.assert_frame_equal(got[["a", "b"]], want.set_index("symbol").sort_index()[["a", "b"]])
    thin = cross_sectional_normalize(df, ["a"], min_names=31, mode="augment").toPandas()
    assert thin["a"].isna().all() and thin["a_cs"].isna().all()
