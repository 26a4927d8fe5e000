"""Cases whose values were worked out by hand."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import session
from panelforge.operators import metrics, models, monitor
from panelforge.plans import eval_report
from panelforge.sources import logs, tables

D = dt.date


def days(n, start=D(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_forward_returns_follow_the_dates_of_the_panel(spark):
    d = days(4)
    rows = [(d[0], "a", 10.0, 1.0), (d[1], "a", 11.0, 1.0), (d[3], "a", 13.0, 1.0), *[(x, "b", 5.0 + i, 2.0) for i, x in enumerate(d)]]
    f = metrics.dated_forward_returns(spark.createDataFrame(rows, "ts date, symbol string, close double, pred double"), [1, 2])
    got = {(r.symbol, r.ts, r.horizon): r.fwd for r in f.collect()}
    assert got["a", d[0], 1] == pytest.approx(0.1) and got["a", d[0], 2] is None  # absent on the second next date
    assert got["a", d[1], 1] is None and got["a", d[1], 2] == pytest.approx(13 / 11 - 1) and got["b", d[2], 1] == pytest.approx(8 / 7 - 1)


def test_constant_excess_has_ratio_zero_and_alpha_is_the_difference(spark):
    d = days(5)
    closes = [100.0, 110.0, 99.0, 118.8, 130.68]
    bench = spark.createDataFrame([(x, c, None if i == 0 else c / closes[i - 1] - 1) for i, (x, c) in enumerate(zip(d, closes))],
                                  "ts date, bench_close double, bench_ret double")
    rets = [c / closes[i] - 1 + 0.01 for i, c in enumerate(closes[1:])]
    rows = [("same", x, r, 100.0 + i) for i, (x, r) in enumerate(zip(d[1:], rets))] + [("part", d[2], 0.05, 50.0), ("part", d[4], 0.02, 60.0)]
    got = {r.config: r for r in metrics.benchmark_comparison(
        spark.createDataFrame(rows, "config string, ts date, r double, eq double"), bench, ["config"], "r", equity="eq").collect()}
    assert got["same"].information_ratio == 0.0 and got["same"].alpha_pct == pytest.approx(3.0 - 30.68)
    b = [c / closes[i] - 1 for i, c in enumerate(closes[1:])]
    excess = np.array([0 - b[0], 0.05 - b[1], 0 - b[2], 0.02 - b[3]])
    assert got["part"].information_ratio == pytest.approx(np.sqrt(252) * excess.mean() / excess.std(ddof=1))


def test_models_of_one_key_get_versions_one_by_one(spark):
    reg = spark.createDataFrame([("a", 3), ("b", 1)], "model_key string, version int")
    new = spark.createDataFrame([("a", "m1"), ("a", "m2"), ("c", "m3")], "model_key string, name string")
    assert sorted((r.model_key, r.name, r.version) for r in tables.next_versions(reg, new).collect()) == [
        ("a", "m1", 4), ("a", "m2", 5), ("c", "m3", 1)]


def test_records_without_a_bar_date_do_not_count(spark):
    log = spark.createDataFrame([("2024-01-05", "2024-01-05", "s", "m"), ("2024-01-06", None, "s", "m")],
                                "date string, bar_date string, symbol string, model string")
    new = spark.createDataFrame([("2024-01-07", "2024-01-05", "s", "m", "BUY"), ("2024-01-07", "2024-01-07", "s", "m", "BUY")],
                                "date string, bar_date string, symbol string, model string, signal string")
    assert [r.bar_date for r in logs.unrecorded(new, log).collect()] == ["2024-01-07"]
    twice = log.limit(1).union(spark.createDataFrame([("2024-01-05", "2024-01-04", "s", "m")], log.schema))
    assert [r.bar_date for r in logs.unrecorded(new, twice).collect()] == ["2024-01-07"]


def test_a_record_before_the_first_bar_looks_forward_from_it(spark):
    d = days(12, D(2024, 1, 10))
    bars = spark.createDataFrame([("s", x, i, 100.0 + i * i) for i, x in enumerate(d)], "symbol string, ts date, bar_no long, close double")
    rows = [(D(2024, 1, 3), "s", "m", "BUY", 0.5, 90.0), (d[2], "s", "m", "SELL", 0.6, 104.0)]
    log = spark.createDataFrame(rows, "date date, symbol string, model string, signal string, confidence double, price double")
    r = monitor.realized_ic(log, bars, "2024-03-01", min_lookback=2, horizon=3).first()
    # 90 -> 109 by the fourth bar, and 104 -> 125: a right and a wrong direction.
    assert (r.lookback_n, r.n_directional, r.directional_accuracy) == (2, 2, 0.5)


def test_an_upsert_of_a_day_leaves_other_months_alone(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [(s, dt.datetime(2024, m, 3), "1d", float(m)) for s in "ab" for m in (1, 2, 3)]
    ddl = "symbol string, ts timestamp, interval string, close double"
    tables.upsert(spark, path, "bar_data", spark.createDataFrame(rows, ddl))
    stamp = lambda: {os.path.join(p, f): os.stat(os.path.join(p, f)).st_mtime_ns for p, _, fs in os.walk(path) for f in fs if f.startswith("part") and "month=2024-02" not in p}
    before = stamp()
    tables.upsert(spark, path, "bar_data", spark.createDataFrame([("a", dt.datetime(2024, 2, 3), "1d", 9.0), ("a", dt.datetime(2024, 2, 4), "1d", 8.0)], ddl))
    assert stamp() == before and len(before) >= 2
    got = {(r.symbol, r.ts.month, r.ts.day): r.close for r in spark.read.parquet(path).collect()}
    assert len(got) == 7 and got["a", 2, 3] == 9.0 and got["b", 2, 3] == 2.0


def test_new_rows_win_and_recency_decides_within_them(spark):
    old = spark.createDataFrame([("k", 9, "old")], "k string, at int, v string")
    new = spark.createDataFrame([("k", 1, "late"), ("k", 0, "early")], "k string, at int, v string")
    assert [r.v for r in tables.merge_by_key(old, new, ["k"], "at").collect()] == ["late"]


def test_a_shared_folder_is_required(spark, monkeypatch):
    assert session.shared_dir(spark)
    monkeypatch.setattr(session, "named_dir", lambda _: None)
    with pytest.raises(RuntimeError):
        session.shared_dir(spark)


def test_elastic_path_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    y = x @ [1, -2, 0, 0, 0.5, 0] + rng.normal(size=300) + 3
    m = np.column_stack([np.ones(300), x, y])
    for penalty, (b, c) in zip((0.5, 0.05), models.elastic_path(m.T @ m, (0.5, 0.05), 0.5)):
        g = x.T @ (y - x @ b - c) / 300 - penalty * 0.5 * b
        assert abs((y - x @ b - c).mean()) < 1e-6
        assert np.allclose(g[b != 0], penalty * 0.5 * np.sign(b[b != 0]), atol=1e-6) and (np.abs(g[b == 0]) <= penalty * 0.5 + 1e-6).all()
        assert models._squared_error(m.T @ m, b, c) == pytest.approx(((y - x @ b - c) ** 2).mean())


def test_decisions_are_held_and_traded_a_bar_later(spark):
    preds = [0.1] * 25 + [5.0, -5.0, -5.0, -5.0, -5.0, -5.0, -5.0, 0.1, 0.1]
    df = spark.createDataFrame([("s", i, p, 1.0) for i, p in enumerate(preds)], "symbol string, bar_no long, pred double, ret double")
    got = [r.r for r in eval_report.decision_trials(df, quantiles=[0.8], windows=[24]).orderBy("bar_no").collect()]
    # Long is decided on bar 25 and stays 5 bars; bars 26 to 30 earn it, the short decided on bar 30 earns from bar 31.
    assert got[25] == 0.0 and got[26:31] == [1.0] * 5 and got[31:33] == [-1.0] * 2


def test_folds_give_an_overfitting_estimate(spark):
    rng = np.random.default_rng(5)
    rows = [(s, f, c, float(rng.normal() + (c == 1) * 3)) for s in "ab" for f in range(6) for c in range(4)]
    lg = eval_report.fold_overfit(spark.createDataFrame(rows, "symbol string, fold int, config_no int, ic double"))
    assert lg.count() == 924 and lg.agg(F.avg((F.col("logit") < 0).cast("int"))).first()[0] < 0.05
