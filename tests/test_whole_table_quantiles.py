"""Quantiles of a whole table, found from counts of bits."""

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import ranks
from panelforge.operators.ranks import _doubles, _ordered_bits, column_quantiles


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, 0.0, 1e-310, 1.0, 2.5, np.inf, np.nan])
    u = _ordered_bits(x)
    assert (np.diff(u.astype(float)) > 0).all()
    np.testing.assert_array_equal(_doubles(u), x)
    assert _ordered_bits(np.array([-0.0])) == _ordered_bits(np.array([0.0]))


@pytest.mark.parametrize("few", [0, 3, 500])
def test_whole_table_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "_FEW", few)
    rng = np.random.default_rng(8)
    n = 5000
    pdf = pd.DataFrame({"normal": rng.normal(0, 1, n), "ties": rng.integers(-2, 3, n).astype(float), "one": 7.0, "near": 1 + rng.integers(0, 9, n) * 2.0**-50,
                        "wide": rng.normal(0, 1, n) * 10.0 ** rng.integers(-200, 200, n)})
    df = spark.createDataFrame(pdf).selectExpr("*", "IF(normal < 0, NULL, normal) AS half", "CAST(NULL AS DOUBLE) AS none",
                                               "IF(normal < 1, double('-inf'), double('inf')) AS ends").repartition(5)
    pdf["half"] = pdf.normal.where(pdf.normal >= 0)
    qs = [0.0, 0.25, 0.5, 0.83, 1.0]
    d = column_quantiles(df, [*pdf.columns, "none", "ends"], qs, limit=100)
    got = {(r["feature"], r["q"]): r["value"] for r in d.collect()}
    want = {(c, q): pdf[c].quantile(q) for c in pdf.columns for q in qs}
    assert {f for f, _ in got} == {*pdf.columns, "ends"} and got["ends", 0.5] == -np.inf and got["ends", 1.0] == np.inf
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=0), k


def test_nothing_is_sorted_or_cut_for_a_whole_table(spark, monkeypatch):
    def refused(*how):
        raise AssertionError("rows of one group were bracketed")

    monkeypatch.setattr(ranks, "_bracketed", refused)
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x")
    assert column_quantiles(df, ["x"], [0.25], limit=10).first()["value"] == 249.75
