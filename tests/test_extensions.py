"""Scorers and decisions of a user's own, models as functions, the table function."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import extensions as ext
from panelforge.operators import signals
from panelforge.operators.overfit import overfit_logits, split_means

ROWS = [("A", i, 10.0 + i, float((-1) ** (i // 7) * (i % 11))) for i in range(120)]


@pytest.fixture()
def panel(spark):
    return spark.createDataFrame(ROWS, "symbol string, bar_no long, close double, pred double")


def test_steps_by_name_equal_the_direct_call(panel):
    want = {(r.symbol, r.bar_no): r.position for r in signals.strategy_positions(panel).collect()}
    got = {(r.symbol, r.bar_no): r.position for r in ext.positions(panel, "stored").collect()}
    assert got == want and len(set(want.values())) > 1


def test_own_scorer_and_decision(panel):
    ext.register_scorer("flipped", lambda df: df.withColumn("pred", -F.col("pred")))
    ext.register_decision("sign", lambda df: df.withColumn("signal", F.signum("pred").cast("int")))
    rows = ext.positions(panel, "flipped", "sign", holding=0).orderBy("bar_no").collect()
    assert [r.position for r in rows] == [0.0] + [float(np.sign(-r[3])) + 0.0 for r in ROWS[:-1]]
    with pytest.raises(ValueError, match="unknown name 'other'"):
        ext.score(panel, "other")
    with pytest.raises(ValueError, match="no column close"):
        ext.score(panel, lambda df: df.drop("close"))
    with pytest.raises(ValueError, match="no column signal"):
        ext.decide(panel, lambda df: df)


def test_function_scorer_and_missing_features(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 2.0), (4, float("inf"), None)], "id int, a double, b double")
    def total(x):
        return 1 / x.sum(axis=1)

    def run(missing, **more):
        return {r.id: r.pred for r in ext.function_scorer(total, ["a", "b"], missing=missing, **more)(df).collect()}

    assert run("null") == {1: 1 / 3, 2: None, 3: None, 4: None}
    with np.errstate(divide="ignore"):
        assert run("zero") == {1: 1 / 3, 2: 0.5, 3: 0.5, 4: None}  # 1/0 is no score
    with pytest.raises(Exception, match="a feature is missing"):
        run("raise")
    assert run("null") | {} == {r.id: r.pred for r in ext.function_scorer(total, ["a", "b"], missing="null")(df.repartition(3)).collect()}
    assert ext.function_scorer(total, ["a"])(df.where("id < 0")).count() == 0
    proba = ext.function_scorer(lambda x: np.column_stack([x[:, 0], 1 - x[:, 0]]), ["a"], "p", "null", classes=2)(df)
    assert [r.p for r in proba.orderBy("id").collect()] == [[1.0, 0.0], None, None, None]


def test_large_models_are_refused():
    weights = np.zeros(10_000)
    with pytest.raises(ValueError, match="more than the 1,000"):
        ext.function_scorer(lambda x: x @ weights, ["a"], max_bytes=1000)
    with pytest.raises(ValueError, match="missing is"):
        ext.function_scorer(lambda x: x, ["a"], missing="skip")


def test_table_function_ranks_splits(spark):
    rng = np.random.default_rng(1)
    perf = spark.createDataFrame([(f"c{c}", c, i, float(rng.normal(c * 0.1))) for c in range(5) for i in range(40)] + [("c5", 5, i, 0.0) for i in range(40)],
                                 "config string, config_no int, i long, r double")
    want = {r["mask"]: (r.best, r.n_configs, r.logit) for r in overfit_logits(perf, "config", "config_no", "i", "r", 40).collect()}
    means = split_means(perf, "config", "config_no", "i", "r", 40).select("mask", "_cfg.*", "is_mean", "oos_mean")
    ext.register_functions(spark)
    sql = "SELECT * FROM split_logit(TABLE(SELECT * FROM {t}) PARTITION BY mask ORDER BY (oos_mean, config_no))"
    got = {r["mask"]: (r.best, r.n_configs, r.logit) for r in spark.sql(sql, t=means).collect()}
    assert got.keys() == want.keys() and all(g[:2] == want[m][:2] and math.isclose(g[2], want[m][2], abs_tol=1e-12) for m, g in got.items())
    assert spark.sql(sql, t=means.where("mask < 0")).count() == 0
    ties = spark.createDataFrame([(1, "a", 0, None, None), (1, "b", 1, 1.0, 0.0), (1, "c", 2, 1.0, 0.0)],
                                 "mask int, config string, config_no int, is_mean double, oos_mean double")
    assert [tuple(r)[:3] for r in spark.sql(sql, t=ties).collect()] == [(1, "b", 3)]
