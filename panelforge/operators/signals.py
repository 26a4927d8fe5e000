"""From forecasts to per-symbol signals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalars import argmax, class_decision, col, q_gate, signal_name, signal_number
from panelforge.operators.scans import holding_filter
from panelforge.operators.timeaxis import CHUNK_ROWS, CURRENT, chunk_window, chunked, own_rows, roll_quantile
from panelforge.schema import FALLBACK_QUANTILE, FALLBACK_WINDOW

CONVICTION_FULL_SIZE = 2.0
MIN_THRESHOLD_OBS = 20


def predictor_signal(df: DataFrame, pred: str = "pred", quantile: float = FALLBACK_QUANTILE,
                     window: int = FALLBACK_WINDOW, conviction: bool = False, out: str = "signal",
                     keys: Sequence[str] = ("symbol",), size: int = CHUNK_ROWS) -> DataFrame:
    """Trade where |forecast| exceeds the quantile of its own trailing window (today excluded).

    HOLD until 20 forecasts are known.  With conviction the sign is scaled by how
    far the threshold is exceeded, reaching 1 at twice the threshold.
    """
    d = chunked(df, halo=window, size=size)
    size_of = F.abs(pred)
    thr = roll_quantile(size_of, quantile, chunk_window(keys), window, MIN_THRESHOLD_OBS)
    d = own_rows(d.withColumn("_thr", thr))
    return d.withColumn(out, threshold_signal(pred, "_thr", conviction)).drop("_thr")


def threshold_signal(pred: str | Column, thr: str | Column, conviction: bool = False) -> Column:
    p, t = col(pred), col(thr)
    fires = F.abs(p) > t
    if conviction:
        scale = F.least(F.try_divide(F.abs(p), CONVICTION_FULL_SIZE * t), F.lit(1.0))
        return F.when(fires, F.signum(p) * scale).otherwise(F.lit(0.0))
    return F.when(fires, F.signum(p).cast("int")).otherwise(F.lit(0))


def trailing_thresholds(x: np.ndarray, window: int, quantiles: Sequence[float], start: int = 0, min_obs: int = MIN_THRESHOLD_OBS) -> np.ndarray:
    """Quantiles of the `window` values before each place of the last axis from `start` on, NaN below `min_obs` values.

    x: (.., rows), NaN where missing; the result is (.., rows - start, quantiles).  Interpolates as Spark's percentile, to the bit.
    """
    before = np.full((*x.shape[:-1], window), np.nan)
    frames = sliding_window_view(np.concatenate([before, x[..., :-1]], axis=-1), window, axis=-1)[..., start:, :]
    known = np.sort(frames, axis=-1)  # missing ones last
    n = window - np.isnan(known).sum(axis=-1)
    out = np.empty((*n.shape, len(quantiles)))
    for i, q in enumerate(quantiles):
        spot = np.maximum(n - 1, 0) * q
        lower, upper = np.floor(spot), np.ceil(spot)
        lo, hi = (np.take_along_axis(known, at.astype(int)[..., None], axis=-1)[..., 0] for at in (lower, upper))
        out[..., i] = np.where((lower == upper) | (lo == hi), lo, (upper - spot) * lo + (spot - lower) * hi)
    return np.where((n >= min_obs)[..., None], out, np.nan)


def quantile_decision(df: DataFrame, score: str = "score", quantile: float = 0.7, window: int = 63,
                      out: str = "signal", keys: Sequence[str] = ("symbol",), size: int = CHUNK_ROWS) -> DataFrame:
    """As `predictor_signal` but inclusive, from the second bar on."""
    thr = roll_quantile(F.abs(score), quantile, chunk_window(keys), window, 1)
    d = own_rows(chunked(df, halo=window, size=size).withColumn("_thr", thr))
    fires = F.abs(score) >= F.col("_thr")
    return d.withColumn(out, F.when(fires, F.signum(score).cast("int")).otherwise(F.lit(0))).drop("_thr")


def threshold_decision(score: str | Column, proba: str | Column | None, threshold: float = 0.55) -> Column:
    sign = F.signum(col(score)).cast("int")
    if proba is None:
        return sign
    return F.when(F.array_max(col(proba)) < F.lit(threshold), F.lit(0)).otherwise(sign)


def q_decision(q: str | Column, min_spread: float = 2.0, min_advantage: float = 1.0) -> Column:
    """Signal from action values [hold, long, short]; an all-zero (warm-up) row holds."""
    v = col(q)
    blank = (v[0] == 0) & (v[1] == 0) & (v[2] == 0)
    return F.when(blank, F.lit(0)).otherwise(signal_number(q_gate(v[0], v[1], v[2], min_spread, min_advantage)))


def class_scores(proba: str | Column, classes: str | Column) -> Column:
    """Most likely class, through the model's own class list, as -1 / 0 / +1."""
    return (F.element_at(col(classes), argmax(proba) + 1) - 1).cast("double")


def execution_lag(df: DataFrame, signal: str, out: str = "position", keys: Sequence[str] = ("symbol",),
                  size: int = CHUNK_ROWS) -> DataFrame:
    """Position traded on the bar after the decision; flat on the first bar."""
    lagged = F.coalesce(F.lag(signal).over(chunk_window(keys)).cast("double"), F.lit(0.0))
    return own_rows(chunked(df, halo=1, size=size).withColumn(out, lagged))


def strategy_positions(df: DataFrame, pred: str = "pred", quantile: float = FALLBACK_QUANTILE,
                       window: int = FALLBACK_WINDOW, holding: int = 5, conviction: bool = False) -> DataFrame:
    """Score -> decide -> hold -> lag, as a per-bar target position."""
    s = predictor_signal(df, pred, quantile, window, conviction, out="_signal")
    h = holding_filter(s, "_signal", holding, out="_held")
    return execution_lag(h, "_held").drop("_signal", "_held")


def clip_signal(signal: str | Column) -> Column:
    return F.greatest(F.least(col(signal), F.lit(1.0)), F.lit(-1.0))


def regressor_confidence(df: DataFrame, pred: str = "pred", window: int = FALLBACK_WINDOW, out: str = "confidence",
                         keys: Sequence[str] = ("symbol",), size: int = CHUNK_ROWS) -> DataFrame:
    """Share of the trailing window whose |forecast| does not exceed today's; 0 with under two."""
    w = chunk_window(keys).rowsBetween(-(window - 1), CURRENT)
    d = own_rows(chunked(df, halo=window - 1, size=size).withColumn("_w", F.collect_list(F.abs(pred)).over(w)))
    share = F.size(F.filter("_w", lambda v: v <= F.abs(pred))) / F.size("_w")
    return d.withColumn(out, F.when(F.size("_w") < 2, F.lit(0.0)).otherwise(share)).drop("_w")


def live_regressor(df: DataFrame, pred: str = "pred", quantile: float = FALLBACK_QUANTILE,
                   window: int = FALLBACK_WINDOW) -> DataFrame:
    """Latest signal, confidence and raw forecast of every symbol."""
    s = predictor_signal(df, pred, quantile, window)
    c = regressor_confidence(s, pred, window)
    return c.groupBy("symbol").agg(F.max_by(F.struct(
        "ts", signal_name("signal").alias("signal"), "confidence", F.col(pred).alias("predicted_return"),
        F.col("close").alias("price")), "bar_no").alias("r")).select("symbol", "r.*")


def live_classifier(df: DataFrame, proba: str = "proba", threshold: str | float = 0.55) -> DataFrame:
    """Signal of every (symbol, model) row; a row without usable probabilities carries an error instead."""
    p = F.col(proba)
    bad = p.isNull() | (F.size(p) != 3) | F.exists(p, lambda v: v.isNull() | F.isnan(v))
    thr = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    return df.withColumns({
        "error": F.when(bad, F.lit("probabilities missing or malformed")),
        "signal": F.when(~bad, class_decision(p, thr)),
        "confidence": F.when(~bad, F.array_max(p))})
