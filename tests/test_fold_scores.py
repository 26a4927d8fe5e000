"""Folds and settings are scored where their rows are, and agree with one at a time."""

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import models
from panelforge.operators.signals import trailing_thresholds
from panelforge.operators.splits import FoldConfig


def panel(n=150, symbols=("a", "b"), seed=2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(s, i, float(np.round(rng.normal(), 2)), float(rng.normal())) for s in symbols for i in range(n)],
                        columns=["symbol", "bar_no", "pred", "y"])


def test_thresholds_are_those_of_the_rows_before():
    x = np.abs(panel(60, "a")["pred"].to_numpy())
    x[[3, 30]] = np.nan
    got = trailing_thresholds(x, 25, [0.6, 0.8])
    for i in range(60):
        known = x[max(i - 25, 0):i]
        known = known[~np.isnan(known)]
        want = np.quantile(known, [0.6, 0.8]) if len(known) >= 20 else [np.nan] * 2
        np.testing.assert_allclose(got[i], want)


def _ic(p, y, least):
    return pd.Series(p).rank().corr(pd.Series(y).rank()) if len(p) >= least and np.std(p) > 0 else 0.0


def test_fold_scores_and_settings(spark):
    pdf, cfg = panel(), FoldConfig(train=60, test=15, step=7)
    df = spark.createDataFrame(pdf)
    preds = models.fold_predictions(df, ["pred"], "y", cfg).toPandas().sort_values(["symbol", "fold", "offset"])
    scores = models.fold_scores(df, ["pred"], "y", cfg).toPandas().set_index(["symbol", "fold"])
    matrix = models.config_ic_matrix(df, ["pred"], "y", cfg, [0.6, 0.7], [25, 40], min_active=5)
    assert "Window" not in matrix._jdf.queryExecution().executedPlan().toString()  # no sort for each window and rank
    matrix = matrix.toPandas().set_index(["symbol", "fold", "config_no"])
    assert len(scores) == 2 * 11 and len(matrix) == 4 * len(scores)
    for key, g in preds.groupby(["symbol", "fold"]):
        p, y = g["pred"].to_numpy(), g["y"].to_numpy()
        assert scores.loc[key, "ic"] == pytest.approx(_ic(p[63:], y[63:], 2))
        assert scores.loc[key, "dir_acc"] == pytest.approx((np.sign(p[63:]) == np.sign(y[63:])).mean())
        for no, (q, k) in enumerate([(0.6, 25), (0.6, 40), (0.7, 25), (0.7, 40)]):
            fires = [i for i in range(63, len(p)) if abs(p[i]) > np.quantile(np.abs(p[i - k:i]), q)]
            row = matrix.loc[(*key, no)]
            assert (row["quantile"], row["window"]) == (q, k) and row["ic"] == pytest.approx(_ic(p[fires], y[fires], 5))
