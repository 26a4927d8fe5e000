"""The features' look-backs in numpy, against pandas group by group."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from panelforge.operators import features as feats
from panelforge.operators.feature_arrays import Frames, whole_groups
from panelforge.schema import EPS

SIZES = [1, 3, 40, 400, 252, 7, 600]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"g": np.repeat(np.arange(len(SIZES)), SIZES)})
    df["x"] = rng.normal(0, 1, len(df)).round(1)
    df.loc[rng.random(len(df)) < 0.01, "x"] = np.nan
    df.loc[50:90, "x"] = 0.1  # equal values
    df.loc[300, "x"] = 1e13
    df["place"] = df.groupby("g").cumcount()
    return df


def by_group(df, fn):
    return df.groupby("g")["x"].transform(fn).to_numpy()


def test_full_frames(rows):
    f, x = Frames(rows.place.to_numpy()), rows.x.to_numpy()
    for k in (1, 5, 21):
        np.testing.assert_array_equal(f.lag(x, k), by_group(rows, lambda s: s.shift(k)))
        np.testing.assert_array_equal(f.lead(x, k), by_group(rows, lambda s: s.shift(-k)))
    for k in (3, 20, 63):
        mean, sd = f.roll(x, k, spread=True)
        # Frame by frame, as pandas' own sums keep a trace of the large value.
        np.testing.assert_allclose(mean, by_group(rows, lambda s: s.rolling(k).apply(np.mean, raw=True)), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(sd, by_group(rows, lambda s: s.rolling(k).apply(lambda v: v.std(ddof=1), raw=True)), rtol=1e-9, atol=1e-12)
        np.testing.assert_array_equal(f.extreme(x, k, np.minimum), by_group(rows, lambda s: s.rolling(k).min()))
    assert f.roll(x, 20, spread=True)[1][70] == 0.0 and f.roll(x, 20)[70] == 0.1
    few = Frames(np.array([0, 1, 0]))
    assert np.isnan(few.roll(np.ones(3), 5)).all() and np.isnan(few.lag(np.ones(3), 5)).all() and np.isnan(few.extreme(np.ones(3), 5, np.minimum)).all()


def test_totals_means_and_long_frames(rows):
    late = rows[rows.g >= 3]
    f, x = Frames(late.place.to_numpy()), late.x.to_numpy()

    def of_total(s):
        t = s.cumsum()
        return (t - t.rolling(20).mean()) / (t.rolling(20).std() + EPS)

    np.testing.assert_allclose(f.score_of_total(x, 20)[400:], by_group(late, of_total)[400:], rtol=1e-6, atol=1e-6)
    filled = late.assign(x=late.x.fillna(0.0))
    got, want = f.ewm(x, 1 / 14), by_group(filled, lambda s: s.ewm(alpha=1 / 14, adjust=False).mean())
    np.testing.assert_allclose(got[400:], want[400:], rtol=1e-9, atol=1e-12)
    z = f.zscores({"x": x, "y": -x}, 252, 60)
    want = by_group(late, lambda s: (s - s.rolling(252, 60).mean()) / (s.rolling(252, 60).std() + EPS))
    np.testing.assert_allclose(z["x"][400:], want[400:], rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(z["y"], -z["x"])


@pytest.mark.parametrize("held", [1, 10, 10_000])
def test_groups_are_never_cut(rows, held):
    t = pa.table({"symbol": [f"s{g}" if g else None for g in rows.g], "_chunk": [0] * len(rows), "n": np.arange(len(rows))})
    got = list(whole_groups(iter(t.to_batches(max_chunksize=17)), ["symbol", "_chunk"], held))
    assert np.concatenate([part.column("n").to_numpy() for part, _ in got]).tolist() == list(range(len(rows)))
    assert np.concatenate([place for _, place in got]).tolist() == rows.place.tolist()
    assert all(place[0] == 0 for _, place in got)
    assert len(got) == 1 if held == 10_000 else len(got) > 1


def test_features_run_no_windows(spark):
    rng = np.random.default_rng(3)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020-01-01", periods=300).date, "open": close, "high": close * 1.01,
                        "low": close * 0.99, "close": close, "volume": 1000.0})
    pdf.loc[:, "volume"] += np.arange(300.0)
    d = feats.daily_features(spark.createDataFrame(pdf.assign(bar_no=np.arange(300))))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    got = d.toPandas().sort_values("bar_no")
    r = pd.Series(close).pct_change()
    vol = r.rolling(20).std()
    want = (vol - vol.rolling(252, 60).mean()) / vol.rolling(252, 60).std()
    np.testing.assert_allclose(got["vol_20d"], want[got.bar_no], rtol=1e-6)
    np.testing.assert_allclose(got["raw_vol"], vol[got.bar_no], rtol=1e-9)
