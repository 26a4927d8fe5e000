"""Ranks and quantiles of groups larger than one sort."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators.ranks import _ranges, average_rank, column_quantiles, exact_quantiles, group_ranks
from panelforge.operators.xsec import cross_sectional_normalize


def sample(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n), 2)
    x[rng.random(n) < 0.33] = 0.5  # one value holds a third of the rows
    return pd.DataFrame({"g": rng.choice(["a", "a", "a", "b"], n), "id": range(n), "x": x})


@pytest.mark.parametrize("limit", [50, 10_000_000])
@pytest.mark.parametrize("keys", [["g"], []])
def test_average_ranks(spark, limit, keys):
    pdf = sample()
    df = spark.createDataFrame(pdf)
    got = group_ranks(df, keys, "x", ["id"], limit=limit).withColumn("r", average_rank()).orderBy("id").toPandas()
    want = pdf.groupby("g")["x"].rank() if keys else pdf["x"].rank()
    np.testing.assert_allclose(got["r"], want)


@pytest.mark.parametrize("limit", [50, 10_000_000])
def test_places_break_ties(spark, limit):
    pdf = sample(1)
    got = group_ranks(spark.createDataFrame(pdf), ["g"], "x", ["id"], ["id"], limit=limit).toPandas()
    want = pdf.sort_values(["g", "x", "id"]).groupby("g").cumcount()
    got = got.set_index("id").sort_index()
    np.testing.assert_array_equal(got["pos"], want.sort_index())


def test_nulls_take_no_part(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 1.0)], "g string, id int, x double")
    got = {r["id"]: (r["n"], r["less"]) for r in group_ranks(df, ["g"], "x", ["id"]).collect()}
    assert got == {1: (2, 1), 2: (2, None), 3: (2, 0)}


@pytest.mark.parametrize("limit", [40, 10_000_000])
def test_exact_quantiles(spark, limit):
    pdf = sample(2)
    got = exact_quantiles(spark.createDataFrame(pdf), "x", [0.0, 0.25, 0.5, 0.777, 1.0], ["g"], limit=limit).toPandas()
    for r in got.itertuples():
        assert np.isclose(r.value, np.quantile(pdf.x[pdf.g == r.g], r.q)), r
    assert len(got) == 10


@pytest.mark.parametrize("n", [1, 2, 7, 57, 300])
def test_quantiles_at_every_place(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    qs = [0.0, 0.1, 0.5, 0.7, 0.95, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "none": [None] * n, "few": [float(i) if i < 3 else None for i in range(n)]}),
                               "g string, x double, none double, few double")
    for limit in (1, 20_000):
        got = column_quantiles(df, ["x", "none", "few"], qs, ["g"], limit).toPandas()
        assert set(got.feature) == {"x", "few"}
        for r in got.itertuples():
            assert np.isclose(r.value, np.quantile(x if r.feature == "x" else np.arange(min(n, 3)), r.q)), (n, limit, r)
    assert column_quantiles(df.limit(0), ["x"], qs).count() == 0


def test_a_value_with_most_rows_and_groups_of_many_limits(spark):
    """90 % of one group share a value, another holds hundreds of limits: no sort exceeds its limit by much."""
    rng = np.random.default_rng(5)
    n = 6_000
    x = np.where(rng.random(n) < 0.9, 7.0, rng.normal(7, 3, n))
    pdf = pd.concat([pd.DataFrame({"g": "tied", "id": [f"s{i:06d}" for i in range(n)], "x": x}),
                     pd.DataFrame({"g": "wide", "id": [f"s{i:06d}" for i in range(n)], "x": rng.lognormal(size=n)})])
    df = spark.createDataFrame(pdf)
    ranges = _ranges(df.withColumn("x", F.col("x")), ["g"], "x", (), 20)
    sizes = ranges.groupBy("g", "_rng", "_tied").count().toPandas()
    assert sizes[~sizes._tied]["count"].max() <= 20 and len(sizes[sizes.g == "wide"]) > 255
    assert sizes[sizes._tied & (sizes.g == "tied")]["count"].max() > 4_000
    got = group_ranks(df, ["g"], "x", limit=20).withColumn("r", average_rank()).toPandas().sort_values(["g", "id"])
    want = pdf.assign(r=pdf.groupby("g")["x"].rank()).sort_values(["g", "id"])
    np.testing.assert_allclose(got["r"], want["r"])
    # The tied rows, in order of a text that breaks their ties, are cut by it.
    by_name = _ranges(df, ["g"], "x", ("id",), 600).groupBy("g", "_rng").count().toPandas()
    assert by_name["count"].max() <= 600
    placed = group_ranks(df, ["g"], "x", tie=["id"], limit=600).toPandas().set_index(["g", "id"]).sort_index()
    place = pdf.sort_values(["g", "x", "id"]).assign(p=lambda d: d.groupby("g").cumcount()).set_index(["g", "id"]).sort_index()
    np.testing.assert_array_equal(placed["pos"], place["p"])


@pytest.mark.parametrize("mode", ["replace", "augment"])
def test_wide_and_long_cross_sections_agree(spark, mode):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"ts": rng.integers(0, 6, 300), "symbol": [f"s{i}" for i in range(300)], "a": np.round(rng.normal(size=300), 1), "b": rng.normal(size=300)})
    pdf.loc[pdf.index % 7 == 0, "a"] = None
    df = spark.createDataFrame(pdf)
    one, many = (cross_sectional_normalize(df, ["a", "b"], min_names=50, mode=mode, limit=k).toPandas().set_index("symbol").sort_index() for k in (10**6, 10))
    pd.testing.assert_frame_equal(one[sorted(one)], many[sorted(one)])
    assert one.filter(like="a").notna().any().all() and one["b"].isna().any()
