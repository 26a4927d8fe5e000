"""The three jobs end to end on a small universe."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import features as feats
from panelforge.operators import quality
from panelforge.operators.timeaxis import number_rows
from panelforge.operators.xsec import BookConfig
from panelforge.plans import daily, panel_eval, training
from panelforge.schema import FEATURE_COLS

NAMES = [f"S{i:02d}" for i in range(8)]


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2020-01-01", periods=320).date
    market = rng.normal(0, 0.01, 320)
    frames = []
    for s in NAMES:
        close = 50 * np.exp(np.cumsum(market + rng.normal(0, 0.01, 320)))
        frames.append(pd.DataFrame({
            "symbol": s, "ts": days, "open": close * (1 + rng.normal(0, 0.002, 320)), "high": close * 1.01, "low": close * 0.99,
            "close": close, "volume": rng.integers(1_000, 9_000, 320).astype(float)}))
    return number_rows(spark.createDataFrame(pd.concat(frames, ignore_index=True))).persist()


def test_training_then_panel_then_daily(spark, bars):
    bench = feats.equal_weight_benchmark(bars)
    data = training.build_dataset(bars, bench, demean=True)
    result = training.train(data)
    assert result.model.cols == FEATURE_COLS
    test = result.test_metrics.first()
    assert test["n"] > 100 and -1 <= test["ic"] <= 1
    cutoff = result.bounds.where("role = 'test'").first()
    assert cutoff["recorded_train_end"] < cutoff["first_date"]

    panel, dropped = panel_eval.build_panel(bars, bench, result.model)
    assert dropped.count() == 0 and panel.select("symbol").distinct().count() == len(NAMES)
    b = number_rows(bench, keys=())
    nxt = b.selectExpr("bar_no - 1 AS bar_no", "close AS c1")
    returns = b.join(nxt, "bar_no", "left").selectExpr("ts", "c1 / close - 1 AS bench_ret")
    grid = [BookConfig(0.25, 1, min_names=5), BookConfig(0.25, 5, min_names=5)]
    report = panel_eval.evaluate(panel, returns, dropped, grid=grid)
    verdict = report.verdict.first()
    assert verdict["config"] in {c.label for c in grid} and 0 <= verdict["pbo"] <= 1
    # Flat until the trailing beta is known, invested after.
    assert report.diagnostics.where("n_flat_days between 55 and n_dates / 2").count() == 2

    scored = number_rows(panel)
    last_day = panel.agg(F.max("ts")).first()[0]
    log = panel.where(F.col("ts") < last_day).selectExpr(
        "ts AS date", "ts AS bar_date", "symbol", "'daily_predictor' AS model", "IF(pred > 0, 'BUY', 'SELL') AS signal",
        "0.6D AS confidence", "close AS price")
    registry = spark.createDataFrame([("daily_predictor", dt.datetime(2019, 1, 1))], "model_key string, trained_at timestamp")
    empty = spark.createDataFrame([], "as_of date, symbol string, weight double, price double")
    today = (last_day + dt.timedelta(days=1)).isoformat()
    run = daily.run_daily(scored, bars, log, empty, registry, bars.select("symbol").distinct(), today,
                          BookConfig(0.25, 5, min_names=5))
    held = run.book.toPandas()
    assert held["rebalanced"].all() and len(held) == 4 and abs(held["weight"].abs().sum() - 1) < 1e-9
    assert run.stale.count() == 1 and run.new_records.count() == len(NAMES) and run.documents.count() == len(NAMES)
    assert run.realized.first()["lookback_n"] is not None
    again = daily.run_daily(scored, bars, log, run.book.select("as_of", "symbol", "weight", "price"), registry,
                            bars.select("symbol").distinct(), (last_day + dt.timedelta(days=2)).isoformat(),
                            BookConfig(0.25, 5, min_names=5)).book.toPandas()
    assert not again["rebalanced"].any() and set(again["symbol"]) == set(held["symbol"])


def test_truncated_universe_is_refused(spark, bars):
    ledger = spark.createDataFrame([(f"S{i}", "x") for i in range(3)], "symbol string, reason string")
    quality.check_universe(ledger, 40)
    with pytest.raises(quality.UniverseError):
        quality.check_universe(ledger, 10)


def test_registering_replaces_the_active_version(spark):
    reg = spark.createDataFrame([("a", 1, True)], "model_key string, version int, is_active boolean")
    out = training.register(reg, spark.createDataFrame([("a",)], "model_key string"))
    assert {(r.version, r.is_active) for r in out.collect()} == {(1, False), (2, True)}
