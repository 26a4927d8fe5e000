"""Models against closed forms on small fixtures."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge import schema
from panelforge.catalog import model_queries
from panelforge.operators import models, monitor, quality, splits
from panelforge.operators.splits import FoldConfig
from panelforge.sources import logs, tables


def matrix(n=400, k=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    y = x @ np.arange(1, k + 1) * 0.01 + rng.normal(0, 0.02, n)
    return x, y


def frame(spark, x, y):
    cols = [f"x{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=cols).assign(y=y, symbol="A", bar_no=range(len(y)))
    return spark.createDataFrame(pdf), cols


def test_ridge_equals_closed_form(spark):
    x, y = matrix()
    df, cols = frame(spark, x, y)
    m = models.fit_ridge(df, cols, "y", alpha=10.0)
    lo, mid, hi = np.percentile(x, [25, 50, 75], axis=0)
    z = np.clip((x - mid) / (hi - lo), -5, 5)
    b, c = models.ridge_solve(z, y, 10.0)
    np.testing.assert_allclose(m.coef, b, rtol=1e-8)
    assert m.intercept == pytest.approx(c, rel=1e-8, abs=1e-12)
    got = m.score(df).orderBy("bar_no").toPandas()["pred"]
    np.testing.assert_allclose(got, z @ b + c, rtol=1e-8, atol=1e-12)


def test_fold_predictions_equal_one_fold_at_a_time(spark):
    x, y = matrix()
    df, cols = frame(spark, x, y)
    cfg = FoldConfig(train=100, test=21, step=7)
    got = models.fold_predictions(df, cols, "y", cfg, per_task=5).toPandas()
    n_folds = (400 - cfg.length) // cfg.step + 1
    assert sorted(got.fold.unique()) == list(range(n_folds)) and len(got) == n_folds * cfg.length
    for f in (0, 4, 5, n_folds - 1):
        s = slice(f * 7, f * 7 + cfg.length)
        want = models._fit_window(x[s], y[s], 100, cfg.alpha)
        np.testing.assert_allclose(got[got.fold == f].sort_values("offset").pred, want, rtol=1e-9)


def test_split_leaves_an_embargo(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(50)]
    df = spark.createDataFrame([(d, s) for d in days for s in ("A", "B")], "ts date, symbol string")
    roles = {r.ts: r.role for r in splits.date_roles(df).collect()}
    assert [roles.get(d) for d in days[38:45]] == ["train", "train", None, None, None, "test", "test"]
    bounds = splits.split_bounds(splits.date_roles(df))
    splits.check_split(bounds)
    assert bounds.where("role = 'test'").first()["recorded_train_end"] == days[42]
    with pytest.raises(splits.SplitError):
        splits.check_split(splits.split_bounds(splits.date_roles(df.where(F.col("ts") < days[3]))))


def test_out_of_sample_is_strict(spark):
    df = spark.createDataFrame([("m", dt.date(2020, 1, d)) for d in range(1, 11)], "model string, ts date")
    cut = spark.createDataFrame([("m", dt.date(2020, 1, 4))], "model string, train_end date")
    assert quality.out_of_sample(df, cut, "model").agg(F.min("ts")).first()[0] == dt.date(2020, 1, 8)
    with pytest.raises(quality.UniverseError):
        quality.require_out_of_sample(quality.out_of_sample(df.where("day(ts) < 5"), cut, "model"))


def test_malformed_log_lines(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"date":"2024-01-02","symbol":"A","model":"m","signal":"BUY","confidence":0.5,"price":1.0}\n\n{"date": \n')
    assert logs.read_jsonl(spark, str(p)).where("symbol is not null").count() == 1
    r = logs.parse_lines(spark.read.text(str(p)), schema.PREDICTION_LOG)
    assert r.count() == 2 and r.where("malformed").count() == 1


def test_registry_lifecycle(spark):
    reg = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, False)], "model_key string, version int, is_active boolean")
    new = tables.next_versions(reg, spark.createDataFrame([("a",), ("c",)], "model_key string"))
    assert {(r.model_key, r.version) for r in new.collect()} == {("a", 3), ("c", 1)}
    off = tables.deactivate_older(reg, reg.where("model_key = 'a' and version = 2"))
    assert {(r.model_key, r.version): r.is_active for r in off.collect()} == {("a", 1): False, ("a", 2): True, ("b", 1): False}
    assert [(r.model_key, r.version) for r in tables.active_models(off).collect()] == [("a", 2)]


def test_upsert_is_idempotent_and_checked(spark, tmp_path):
    path = str(tmp_path / "preds")
    row = [("A", "m", dt.date(2024, 1, 2), "BUY", 0.5)]
    ddl = "symbol string, model_key string, prediction_date date, signal string, confidence double"
    for _ in range(2):
        tables.upsert(spark, path, "daily_predictions", spark.createDataFrame(row, ddl))
    tables.upsert(spark, path, "daily_predictions", spark.createDataFrame([("A", "m", dt.date(2024, 1, 2), "SELL", 0.9)], ddl))
    assert [(r.signal, r.confidence) for r in spark.read.parquet(path).collect()] == [("SELL", 0.9)]
    with pytest.raises(tables.CheckViolation):
        tables.upsert(spark, path, "daily_predictions", spark.createDataFrame([("A", "m", dt.date(2024, 1, 3), "MAYBE", 0.9)], ddl))


def test_retrain_trigger(spark):
    d = dt.date(2024, 1, 1)
    ics = [0.1] + [-0.1] * 10 + [0.2] + [-0.1] * 3
    df = spark.createDataFrame([("m", d + dt.timedelta(days=i), v) for i, v in enumerate(ics)], "model string, computed_at date, ic double")
    r = monitor.retrain_runs(df).first()
    assert (r.longest_run, r.retrain) == (10, True)


def test_feature_contract():
    schema.check_feature_contract(schema.FEATURE_COLS)
    assert len(schema.FEATURE_COLS) == 30 and len(schema.model_inputs("augment")) == 60
    with pytest.raises(schema.ContractError):
        schema.check_feature_contract(schema.FEATURE_COLS[::-1])


def test_boosted_query_has_all_rounds(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def estimator(**params):
        seen.update(params)
        raise Stop

    monkeypatch.setattr(models, "GBTRegressor", estimator)
    with pytest.raises(Stop):
        model_queries.boosted(spark, "/root/testdata/sf0.001")
    assert seen["maxIter"] == 300


def test_boosted_classes(spark):
    rng = np.random.default_rng(2)
    n = 600
    x = rng.normal(size=(n, 3))
    label = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] > 0, 0, 1))
    rows = [(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, label))] + [(9000, 9.0, 9.0, 9.0, None), (9001, None, 1.0, None, 0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label int")
    model = models.fit_boosted_classes(df.where("id < 400 or id >= 9000"), ["a", "b", "c"], "label", "sqrt", rounds=15, rate=0.3)
    got = {r.id: (r.proba, r.label) for r in model.score(df).collect()}
    assert len(got) == len(rows) and all(abs(sum(p) - 1) < 1e-9 and min(p) >= 0 for p, _ in got.values())
    held = [int(np.argmax(p)) == k for i, (p, k) in got.items() if 400 <= i < 9000]
    assert np.mean(held) > 0.9
    # Scores are the binary models' probabilities over their sum.
    vec = model.scaled.vectors(df.where("id = 1"))
    raw = [m.transform(vec).first().probability[1] for m in model.models]
    np.testing.assert_allclose(got[1][0], np.array(raw) / sum(raw))
    # A class that training never saw scores 0.
    two = models.fit_boosted_classes(df.where("label <> 1"), ["a", "b", "c"], "label", rounds=3)
    assert two.models[1] is None and all(r.proba[1] == 0 and abs(sum(r.proba) - 1) < 1e-9 for r in two.score(df).collect())


def test_boosted_fits_run_one_task_a_core(spark, monkeypatch):
    seen = []

    def estimator(**params):
        return SimpleNamespace(fit=lambda d: seen.append(d.rdd.getNumPartitions()))

    monkeypatch.setattr(models, "GBTRegressor", estimator)
    monkeypatch.setattr(models, "GBTClassifier", estimator)
    df = spark.range(600, numPartitions=40).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS y", "CAST(id % 3 AS INT) AS label").repartition(40, "id")
    cores = spark.sparkContext.defaultParallelism
    with monkeypatch.context() as m:
        m.setattr(models, "materialize", lambda d, name: d)
        models.fit_boosted(df, ["a"], "y")
        models.fit_boosted_classes(df, ["a"], "label")
    assert seen == [cores] * 4
    monkeypatch.setattr(models, "BOOST_ROWS", 50)
    models.fit_boosted(df, ["a"], "y")
    assert seen[-1] == 2 * cores
