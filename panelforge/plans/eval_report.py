"""Honest-evaluation report: every decision setting tried per symbol, deflated for the trying."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import overfit, quality
from panelforge.operators.scans import held_positions
from panelforge.operators.signals import trailing_thresholds
from panelforge.operators.timeaxis import CHUNK_ROWS, number_rows
from panelforge.schema import SWEEP_QUANTILES, SWEEP_WINDOWS

# Fixed value: least number of bars between two changes of position.
HOLDING = 5


def decision_trials(df: DataFrame, pred: str = "pred", ret: str = "ret", quantiles: Sequence[float] = SWEEP_QUANTILES,
                    windows: Sequence[int] = SWEEP_WINDOWS, holding: int = HOLDING, size: int = CHUNK_ROWS) -> DataFrame:
    """(symbol, bar_no, config, config_no, r): return of every (quantile, window) setting on every bar.

    `ret` is the return from a bar to the next.  A decision is held for at least `holding` bars and traded on the bar
    after it, so a bar earns the position decided one bar before.  Thresholds, decisions and holdings of all settings come from
    one pass over the symbol's rows; the settings become rows only to be summed.
    """
    settings = [(q, k) for q in quantiles for k in windows]

    def decisions(pdf: pd.DataFrame) -> np.ndarray:
        p = pdf[pred].to_numpy(float)
        thr = {k: trailing_thresholds(np.abs(p), k, quantiles) for k in windows}
        return np.stack([np.where(np.abs(p) > thr[k][:, list(quantiles).index(q)], np.sign(p), 0.0) for q, k in settings])

    names = [f"_h{i}" for i in range(len(settings))]
    # Of unit signals every one is held for a bar, so a holding of none is one of 1.
    traded = held_positions(df.select("symbol", "bar_no", pred, ret), decisions, max(holding, 1), names, ("symbol",), size, max(windows), lag=True)
    options = F.array(*[F.struct(F.lit(f"q{q:g}_w{k}").alias("config"), F.lit(i).alias("config_no"), (F.coalesce(name, F.lit(0.0)) * F.col(ret)).alias("r"))
                        for i, ((q, k), name) in enumerate(zip(settings, names))])
    return traded.where(F.col(ret).isNotNull()).select("symbol", "bar_no", F.inline(options))


def deflated_by_symbol(df: DataFrame, min_rows: int = 300, train_end: DataFrame | None = None, **how) -> DataFrame:
    """Best setting and deflated Sharpe of every symbol with enough out-of-sample rows.

    train_end: symbol, train_end of the model behind the forecasts; rows up to it and its embargo go first, then
    symbols with fewer than `min_rows` rows, and the remaining bars are numbered anew.
    """
    quantiles, windows = how.get("quantiles", SWEEP_QUANTILES), how.get("windows", SWEEP_WINDOWS)
    if train_end is not None:
        df = number_rows(quality.out_of_sample(df, train_end, "symbol").drop("bar_no"))
    trials = decision_trials(quality.min_history(df, min_rows), **how)
    return overfit.best_trial(trials, "config", "config_no", "r", len(quantiles) * len(windows), ["symbol"])


def fold_overfit(matrix: DataFrame) -> DataFrame:
    """Splits of the fold by setting IC matrix (models.config_ic_matrix): does the setting that is best on half of the
    folds stay above the median on the other half?  See overfit.overfit_logits.

    Folds are ordered by symbol and fold; one row per symmetric split of them.
    """
    folds = _numbered_folds(matrix)
    n_obs = folds.count()
    return overfit.overfit_logits(matrix.join(folds, ["symbol", "fold"]).withColumn("config", F.col("config_no").cast("string")),
                                  "config", "config_no", "obs", "ic", n_obs)


def _numbered_folds(matrix: DataFrame) -> DataFrame:
    """(symbol, fold, obs): places from per-symbol fold counts, so only one row per symbol is ordered as a whole."""
    per = matrix.groupBy("symbol").agg(F.countDistinct("fold").alias("n"))
    before = F.sum("n").over(Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("symbol", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("fold")) - 1
    return matrix.select("symbol", "fold").distinct().withColumn("_p", place).join(starts, "symbol").select(
        "symbol", "fold", (F.col("_start") + F.col("_p")).alias("obs"))
