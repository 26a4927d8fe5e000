"""Cross-section and book properties."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars as sc
from panelforge.functions.stats import normal_cdf
from panelforge.operators import book, metrics, overfit, xsec
from panelforge.operators.xsec import BookConfig


def panel(spark, dates=60, names=30, seed=0, edge=0.0):
    rng = np.random.default_rng(seed)
    ret = rng.normal(0, 0.02, (dates, names))
    pred = edge * ret + rng.normal(0, 0.02, (dates, names))
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), f"S{n:02d}", float(pred[d, n]), float(ret[d, n]), 1.0)
            for d in range(dates) for n in range(names)]
    return spark.createDataFrame(rows, "ts date, symbol string, pred double, ret double, beta double")


def date_loop(pdf, decile, r, gross=1.0):
    """The book one date at a time."""
    pred, ret = (pdf.pivot(index="ts", columns="symbol", values=c) for c in ("pred", "ret"))
    prev, rows = pd.Series(0.0, index=pred.columns), []
    for i, d in enumerate(pred.index):
        w = prev
        if i % r == 0:
            w = pd.Series(0.0, index=pred.columns)
            row = pred.loc[d].dropna().sort_values(kind="stable")
            k = min(int(len(row) * decile), len(row) // 2)
            if len(row) >= 20 and k:
                w[row.index[:k]] = -gross / 2 / k
                w[row.index[-k:]] = gross / 2 / k
        rows.append(((w * ret.loc[d]).sum(), (w - prev).abs().sum()))
        prev = w * (1 + ret.loc[d].fillna(0))
    return np.array(rows)


@pytest.mark.parametrize("r", [1, 4])
def test_book_equals_date_loop(spark, r):
    p = panel(spark).withColumn("pred", F.when(F.col("pred") < 0.05, F.col("pred"))).withColumn(
        "ret", F.when(F.col("ret") < 0.04, F.col("ret")))
    got = book.run_book(p, [BookConfig(0.2, r, use_beta=False)]).orderBy("i").toPandas()
    want = date_loop(p.toPandas(), 0.2, r)
    np.testing.assert_allclose(got[["gross_ret", "turnover"]], want, atol=1e-12)


def test_foresight_profits_and_noise_does_not(spark):
    good = book.run_book(panel(spark, edge=5.0), [BookConfig(0.1)]).agg(F.avg("book_ret")).first()[0]
    noise = book.run_book(panel(spark, dates=250), [BookConfig(0.1, cost_bps=0.0, borrow_bps=0.0)])
    m, s = noise.agg(F.avg("book_ret"), F.stddev_samp("book_ret")).first()
    assert good > 0.01
    assert abs(m / s) * np.sqrt(250) < 3.5


def test_rank_is_location_invariant_and_legs_balance(spark):
    p = panel(spark, dates=3)
    for conviction in (False, True):
        cfg = [BookConfig(0.2, conviction=conviction, use_beta=False)]
        a = xsec.target_weights(xsec.rank_panel(p), cfg)
        b = xsec.target_weights(xsec.rank_panel(p.withColumn("pred", F.col("pred") + 7)), cfg)
        sums = a.groupBy("ts").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("gross")).collect()
        assert all(abs(s["net"]) < 1e-12 and abs(s["gross"] - 1) < 1e-12 for s in sums)
        wa, wb = ({(r.ts, r.symbol): r.w for r in x.collect()} for x in (a, b))
        assert wa.keys() == wb.keys() and max(abs(wa[k] - wb[k]) for k in wa) < 1e-9


def test_beta_cases(spark):
    def legs_for(beta_long, beta_short, n_known=4):
        rows = [(dt.date(2020, 1, 1), f"S{i:02d}", float(i), 0.0,
                 (beta_long if i >= 16 else beta_short) if not (i >= 16 and i - 16 >= n_known) else None) for i in range(20)]
        df = spark.createDataFrame(rows, "ts date, symbol string, pred double, ret double, beta double")
        w = xsec.target_weights(xsec.rank_panel(df), [BookConfig(0.2)]).collect()
        return sum(r.w for r in w if r.w > 0), -sum(r.w for r in w if r.w < 0)

    assert legs_for(2.0, 1.0) == pytest.approx((1 / 3, 2 / 3))     # beta exposures cancel
    assert legs_for(1.0, 1.0, n_known=2) == pytest.approx((0.5, 0.5))  # partial coverage: dollar neutral
    assert legs_for(1.0, 1.0, n_known=0) == (0, 0)                 # nothing known: flat
    assert legs_for(-1.0, 1.0) == (0, 0)                           # unsolvable: flat


def test_thin_sectors_and_missing_names_pass_through(spark):
    rows = [(1, f"A{i}", float(i)) for i in range(4)] + [(1, f"B{i}", float(i)) for i in range(3)] + [(1, "Z", 9.0), (1, "A9", None)]
    df = spark.createDataFrame(rows, "ts int, symbol string, pred double")
    sec = spark.createDataFrame([(s, s[0]) for _, s, _ in rows if s != "Z"], "symbol string, sector string")
    got = {r.symbol: r.pred for r in xsec.sector_neutralize(df, sec).collect()}
    assert [got[f"A{i}"] for i in range(4)] == [-1.5, -0.5, 0.5, 1.5]
    assert got["B2"] == 2.0 and got["Z"] == 9.0 and got["A9"] is None


def test_drift_seeds_and_keeps(spark):
    held = spark.createDataFrame([("A", 0.5, 10.0), ("B", -0.5, None), ("C", 0.1, 5.0)], "symbol string, weight double, price double")
    now = spark.createDataFrame([("A", 12.0), ("B", 3.0)], "symbol string, price_now double")
    got = {r.symbol: (r.weight, r.price) for r in book.drift_book(held, now).collect()}
    assert got == {"A": (0.6, 12.0), "B": (-0.5, 3.0), "C": (0.1, 5.0)}


@pytest.mark.parametrize("noise,low,high", [(1.0, 0.2, 0.8), (0.1, 0.0, 0.1)])
def test_overfit_probability(spark, noise, low, high):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(41, 10)) * noise
    if noise < 1:
        m[:, 3] += 1.0
    rows = [(o, f"c{c}", c, float(m[o, c])) for o in range(41) for c in range(10)]
    df = spark.createDataFrame(rows, "o int, config string, config_no int, v double")
    r = overfit.overfit_probability(overfit.overfit_logits(df, "config", "config_no", "o", "v", 41)).first()
    assert r["n_combinations"] == 12870 and low <= r["pbo"] <= high


def test_deflated_sharpe_cases(spark):
    rng = np.random.default_rng(0)
    rows = [("strong", i, 0, float(v)) for i, v in enumerate(0.003 + 0.01 * rng.normal(size=750))] + [("short", i, 0, 0.01) for i in range(2)]
    df = spark.createDataFrame(rows, "k string, i int, n int, r double").withColumn("cfg", F.lit("x"))
    mo = metrics.return_moments(df, "r", ["k"]).withColumn("trial_var", F.lit(1e-4))
    got = {r.k: r.dsr for r in overfit.deflated_sharpe(mo, 20).collect()}
    assert got["strong"] > 0.9 and got["short"] == 0.0


def test_normal_cdf(spark):
    from statistics import NormalDist
    xs = [-9.0, -4.5, -4.0, -1.0, 0.0, 0.3, 2.0, 3.99, 4.01, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(normal_cdf("x")).collect()]
    np.testing.assert_allclose(got, [NormalDist().cdf(x) for x in xs], rtol=1e-9, atol=1e-16)


def test_business_day_arithmetic(spark):
    days = [dt.date(2024, 2, 20) + dt.timedelta(days=i) for i in range(25)]
    df = spark.createDataFrame([(a, b) for a in days for b in days], "a date, b date")
    for r in df.select("a", "b", sc.business_days("a", "b").alias("n")).collect():
        assert r.n == np.busday_count(r.a, r.b), r
    for n in (-6, -4, -1, 1, 5, 7):
        for r in df.select("a", sc.add_business_days("a", n).alias("s")).distinct().collect():
            assert r.s == (pd.Timestamp(r.a) + pd.tseries.offsets.BDay(n)).date(), (r, n)


@pytest.mark.parametrize("horizon", [5, 250])
def test_entry_exits_follow_the_bars(spark, horizon):
    rng = np.random.default_rng(horizon)
    rows = [(s, i, 100.0 * float(np.exp(x))) for s, n in (("hot", 900), ("b", 40), ("c", 1)) for i, x in enumerate(np.cumsum(rng.normal(0, 0.02, n)))]
    bars = spark.createDataFrame(rows, "symbol string, bar_no long, close double")
    entries = bars.where("bar_no % 7 = 0").withColumn("side", F.when(F.col("bar_no") % 2 == 0, 1).otherwise(-1))
    by = {}
    for s, i, c in rows:
        by.setdefault(s, []).append(c)
    got = book.entry_exits(entries, bars, horizon, F.lit(0.15), F.lit(0.2)).collect()
    assert len(got) == entries.count()
    for r in got:
        path = [(c - r.close) / r.close * r.side for c in by[r.symbol][r.bar_no + 1:r.bar_no + 1 + horizon]]
        first = next((k for k, g in enumerate(path) if g > 0.2 or g < -0.15), None)
        want = (("take_profit" if path[first] > 0.2 else "stop_loss", first + 1, path[first]) if first is not None
                else ("max_holding", horizon, path[-1]) if len(path) == horizon else (None, None, None))
        assert (r.exit_reason, r.exit_bars) == want[:2] and (want[2] is None or abs(r.exit_gain - want[2]) < 1e-12)


def test_the_plan_of_exits_does_not_grow_with_the_horizon(spark):
    bars = spark.range(100).selectExpr("'a' AS symbol", "id AS bar_no", "id + 1.0D AS close", "1 AS side")
    size = lambda h: len(book.entry_exits(bars, bars, h, F.lit(0.1), F.lit(0.1))._jdf.queryExecution().executedPlan().toString().splitlines())
    assert size(5) == size(250)


def test_exits_sort_no_pairs(spark):
    bars = spark.range(100).selectExpr("'a' AS symbol", "id AS bar_no", "id + 1.0D AS close", "1 AS side")
    plan = book.entry_exits(bars, bars, 50, F.lit(0.1), F.lit(0.1))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_held_rows_are_dealt_by_their_number(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), f"s{k}", float(rng.normal()), 0.01) for i in range(30) for k in range(40)]
    panel = spark.createDataFrame(rows, "ts timestamp, symbol string, pred double, ret double")
    grid = [xsec.BookConfig(0.2, 3, min_names=5, use_beta=False)]
    whole = book.run_book(panel, grid).select("i", "gross_ret", "n_held").orderBy("i").collect()
    monkeypatch.setattr(book, "HELD_ROWS", 40, raising=False)
    assert book.held_positions(panel, grid).rdd.getNumPartitions() == 12
    for r, w in zip(book.run_book(panel, grid).select("i", "gross_ret", "n_held").orderBy("i").collect(), whole, strict=True):
        assert r.n_held == w.n_held and abs(r.gross_ret - w.gross_ret) < 1e-12
