"""Chunked time axis: the same values whatever the chunk size, and pandas as brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import features as feats
from panelforge.operators.ewm import ewm_means, span_alpha, with_blocks
from panelforge.operators.monitor import collapse_restatements
from panelforge.operators.rolling import block_roll
from panelforge.operators.scans import affine_scan, holding_filter, realized_pnl
from panelforge.operators.timeaxis import chunked, forward_fill, number_rows, own_rows, running


def walk(n, symbols=("A", "B"), seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for k, s in enumerate(symbols):
        m = n - 7 * k
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, m)))
        frames.append(pd.DataFrame({
            "symbol": s, "ts": [dt.date(1990, 1, 1) + dt.timedelta(days=i) for i in range(m)],
            "open": close * (1 + rng.normal(0, 0.003, m)), "high": close * (1 + abs(rng.normal(0, 0.005, m))),
            "low": close * (1 - abs(rng.normal(0, 0.005, m))), "close": close,
            "volume": rng.integers(1_000, 5_000, m).astype(float)}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark):
    return number_rows(spark.createDataFrame(walk(4000))).persist()


def frame(df, cols):
    return df.select("symbol", "bar_no", *cols).orderBy("symbol", "bar_no").toPandas()


def test_numbering_crosses_buckets(spark, bars):
    got = frame(bars, ["ts"])
    for _, g in got.groupby("symbol"):
        assert list(g["bar_no"]) == list(range(len(g)))
        assert g["ts"].is_monotonic_increasing


def test_forward_fill_crosses_buckets_and_never_looks_ahead(spark):
    pdf = walk(900, ("A",))
    pdf.loc[:3, "close"] = np.nan
    pdf.loc[300:800, "close"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None)))
    got = forward_fill(df, ["close"]).orderBy("ts").toPandas()["close"]
    np.testing.assert_allclose(got, pdf["close"].ffill(), equal_nan=True)


@pytest.mark.parametrize("size", [64, 500, 100_000])
def test_running_totals(bars, size):
    b = bars.withColumn("x", F.when(F.col("volume") > 1500, F.col("volume")))
    got = frame(running(b, {"s": ("sum", "x"), "m": ("max", "close"), "p": ("min", "close")}, size=size), ["s", "m", "p", "x", "close"])
    for _, g in got.groupby("symbol"):
        np.testing.assert_allclose(g["s"], g["x"].cumsum(), equal_nan=True)
        np.testing.assert_allclose(g["m"], g["close"].cummax())
        np.testing.assert_allclose(g["p"], g["close"].cummin())


@pytest.mark.parametrize("size", [700, 100_000])
def test_exponential_means(bars, size):
    d = with_blocks(chunked(bars, halo=600, size=size))
    got = frame(own_rows(ewm_means(d, {"e": ("close", span_alpha(26)), "w": ("volume", 1 / 14)})), ["e", "w", "close", "volume"])
    for _, g in got.groupby("symbol"):
        np.testing.assert_allclose(g["e"], g["close"].ewm(span=26, adjust=False).mean(), rtol=1e-12)
        np.testing.assert_allclose(g["w"], g["volume"].ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-12)


@pytest.mark.parametrize("size,k", [(63, 63), (200, 20), (100_000, 252)])
def test_block_windows(bars, size, k):
    b = bars.withColumn("x", F.when(F.col("volume") > 1500, F.col("close")))
    d = block_roll(chunked(b, halo=k - 1, size=size), k, {
        "m": ("mean", "x", 10), "s": ("std", "x", 10), "lo": ("min", "x", 10), "hi": ("max", "x", 10),
        "c": ("cov", ("x", "volume"), 10), "pm": ("plain_mean", "x", 10), "ps": ("plain_std", "x", 10)})
    got = frame(own_rows(d), ["m", "s", "lo", "hi", "c", "pm", "ps", "x", "volume"])
    for _, g in got.groupby("symbol"):
        r = g["x"].rolling(k, min_periods=10)
        for c, want in (("m", r.mean()), ("s", r.std()), ("lo", r.min()), ("hi", r.max()), ("pm", r.mean()), ("ps", r.std())):
            np.testing.assert_allclose(g[c], want, rtol=1e-7, equal_nan=True)
        np.testing.assert_allclose(g["c"], g["x"].rolling(k, min_periods=10).cov(g["volume"]), rtol=1e-6, atol=1e-6, equal_nan=True)


def test_large_value_leaves_no_trace(spark):
    pdf = walk(400, ("A",))
    pdf.loc[50, "close"] = 1e14
    b = number_rows(spark.createDataFrame(pdf))
    got = frame(own_rows(block_roll(chunked(b, halo=19), 20, {"s": ("plain_std", "close", 20)})), ["s", "close"])
    want = [np.std(got["close"][i - 19:i + 1], ddof=1) for i in range(70, 400)]
    np.testing.assert_allclose(got["s"][70:], want, rtol=1e-9)


def test_features_do_not_depend_on_chunks(bars):
    a = feats.daily_features(bars, size=1_200).orderBy("symbol", "bar_no").toPandas()
    b = feats.daily_features(bars, size=1_000_000).orderBy("symbol", "bar_no").toPandas()
    assert len(a) == len(b) > 7000
    for c in feats.FEATURE_COLS:
        np.testing.assert_allclose(a[c], b[c], rtol=1e-6, atol=1e-8, err_msg=c)
    assert a["bar_no"].min() >= 100  # warm-up rows are gone


def test_features_are_causal(spark):
    pdf = walk(500, ("A",))
    full = feats.daily_features(number_rows(spark.createDataFrame(pdf))).orderBy("bar_no").toPandas()
    cut = feats.daily_features(number_rows(spark.createDataFrame(pdf.iloc[:400]))).orderBy("bar_no").toPandas()
    np.testing.assert_allclose(full[full.bar_no < 400][feats.FEATURE_COLS], cut[feats.FEATURE_COLS], rtol=1e-9, atol=1e-9)


def hold_reference(sig, h):
    out, pos, entered = [], 0.0, -h - 1
    for i, s in enumerate(sig):
        if np.sign(s) != np.sign(pos) and i >= entered + h:
            pos = s
            if pos != 0:
                entered = i
        out.append(pos)
    return out


@pytest.mark.parametrize("size", [3, 17, 100_000])
def test_holding_filter(spark, size):
    rng = np.random.default_rng(4)
    sig = rng.choice([-1, -0.5, 0, 0, 0.25, 1], 300)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_no": range(300), "s": sig}))
    got = frame(holding_filter(df, "s", 5, size=size), ["position"])["position"]
    np.testing.assert_array_equal(got, hold_reference(sig, 5))


@pytest.mark.parametrize("size", [7, 16, 1000])
@pytest.mark.parametrize("h", [1, 3, 9])
def test_holding_filter_of_gaps_and_sizes(spark, size, h):
    """Signals of any size, missing ones and long silences: the rule row by row gives the same positions in chunks of any size."""
    rng = np.random.default_rng(h)
    signals = [None if v == 9 else float(v) for v in rng.choice([-2, -0.5, 0, 0, 0, 1, 3, 9], size=90)] + [0.0] * 40 + [1.0] * 30
    want, value, age = [], 0.0, h
    for s in signals:
        x = np.nan if s is None else s
        if np.sign(x) != np.sign(value) and (value == 0 or age >= h):
            value, age = x, 0
        want.append(value)
        age += 1
    df = spark.createDataFrame([("A", i, s) for i, s in enumerate(signals)], "symbol string, bar_no long, s double")
    got = [r.position for r in holding_filter(df, "s", h, size=size).orderBy("bar_no").collect()]
    assert np.array_equal([np.nan if v is None else v for v in got], want, equal_nan=True)


@pytest.mark.parametrize("size", [4, 100_000])
def test_affine_scan(spark, size):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(-1, 1, 60), rng.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_no": range(60), "a": a, "b": b}))
    got = frame(affine_scan(df, "a", {"y": "b"}, size=size), ["y"])["y"]
    y, want = 0.0, []
    for i in range(60):
        want.append(y)
        y = a[i] * y + b[i]
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("size", [2, 100_000])
def test_ledger_by_hand(spark, size):
    rows = [("A", 0, "BUY", 100, 10.0, 1.0), ("A", 1, "BUY", 100, 12.0, 1.0), ("A", 2, "SELL", 50, 15.0, 0.5),
            ("A", 3, "SELL", 250, 9.0, 2.5), ("A", 4, "BUY", 100, 8.0, 1.0), ("A", 5, "BUY", 10, 7.0, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, bar_no bigint, side string, shares bigint, fill_price double, commission double")
    got = frame(realized_pnl(df, size=size), ["pnl", "position"])
    assert list(got["position"]) == [100, 200, 150, -100, 0, 10]
    want = [np.nan, np.nan, 4 * 50 - 0.02 * 50, -2 * 150 - 0.02 * 150, 1 * 100 - 0.02 * 100, np.nan]
    np.testing.assert_allclose(got["pnl"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("size", [2, 100_000])
def test_ledgers_of_symbols_stand_alone(spark, size):
    rows = [("A", 0, "BUY", 10, 10.0), ("B", 0, "SELL", 5, 20.0), ("A", 1, "SELL", 4, 11.0), ("B", 1, "BUY", 5, 18.0),
            ("A", 2, "SELL", 6, 9.0), ("B", 2, "BUY", 1, 17.0)]
    df = spark.createDataFrame(rows, "symbol string, bar_no bigint, side string, shares bigint, fill_price double")
    got = realized_pnl(df, size=size)
    assert sorted(got.columns) == sorted([*df.columns, "commission", "pnl", "position"])
    found = {(r["symbol"], r["bar_no"]): (r["position"], r["pnl"]) for r in got.collect()}
    assert found == {("A", 0): (10, None), ("A", 1): (6, 4.0), ("A", 2): (0, -6.0),
                     ("B", 0): (-5, None), ("B", 1): (0, 10.0), ("B", 2): (1, None)}


def test_collapse_restatements(spark):
    d = dt.date(2024, 1, 1)
    rows = [(d + dt.timedelta(days=i), b, "m", "A", p) for i, (b, p) in enumerate([
        (d, 1.0), (d, 1.0), (None, 2.0), (None, 2.0), (None, None), (None, 2.0)])]
    df = spark.createDataFrame(rows, "date date, bar_date date, model string, symbol string, price double")
    kept = [r["date"].day for r in collapse_restatements(df).orderBy("date").collect()]
    assert kept == [1, 3, 5, 6]
