"""Monitoring of the prediction log: realised skill, drift, consensus, retraining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import signal_score
from panelforge.operators.metrics import rank_ic
from panelforge.operators.timeaxis import CHUNK_ROWS, chunk_window, chunked, forward_fill, number_rows, own_rows
from panelforge.schema import HORIZON

MIN_LOOKBACK = 20
DRIFT_DAYS, MIN_DRIFT_OBS, DRIFT_SIGMA, DRIFT_ABS = 30, 10, 2.0, 0.002
RETRAIN_RUN = 10


def fetch_plan(log: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """One padded date range per symbol, so that prices are scanned once."""
    return log.groupBy("symbol").agg(
        F.date_sub(F.min("date"), 10).alias("start"), F.date_add(F.max("date"), 2 * horizon + 10).alias("end"),
        F.countDistinct("date").alias("n_dates"))


def resolve_sessions(log: DataFrame, sessions: DataFrame, bucket: str = "trunc(date, 'month')") -> DataFrame:
    """Add `session`: the latest trading session at or before each record's date.

    A backward as-of join by union and forward fill: sessions and the distinct
    record dates share one time axis, and the last session seen is carried along it.
    log: symbol, date, ...; sessions: symbol, ts.
    """
    marks = sessions.select("symbol", F.to_date("ts").alias("date"), F.to_date("ts").alias("session"),
                            F.lit(0).alias("_side"))
    days = log.select("symbol", "date").distinct()
    both = days.withColumns({"session": F.lit(None).cast("date"), "_side": F.lit(1)}).unionByName(marks)
    filled = forward_fill(both, ["session"], order=("date", "_side"), bucket=bucket)
    return log.join(filled.where("_side = 1").select("symbol", "date", "session"), ["symbol", "date"], "left")


def dedupe_sessions(resolved: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """First record per (model, symbol, session); unresolved records keep their own date."""
    r = resolved.withColumn("session", F.coalesce("session", "date"))
    keys = ["model", "symbol", "session"]
    rest = [c for c in r.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("date", *order))
    return r.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*")


def latest_dates(df: DataFrame, n: int, keys: Sequence[str] = ("model",), date: str = "session") -> DataFrame:
    """Rows on each key's latest n distinct dates; adds n_dates, the key's number of dates."""
    # Distinct (key, date) pairs only: one row per calendar day.
    days = df.select(*keys, date).distinct()
    w = Window.partitionBy(*keys)
    kept = days.withColumns({
        "_rn": F.row_number().over(w.orderBy(F.col(date).desc())), "n_dates": F.count(F.lit(1)).over(w)}).where(
        F.col("_rn") <= n).drop("_rn")
    return df.join(kept, [*keys, date])


def realized_ic(log: DataFrame, bars: DataFrame, today: str, min_lookback: int = MIN_LOOKBACK, horizon: int = HORIZON,
                tie: Sequence[str] = ()) -> DataFrame:
    """Scorecard per model; NULL metrics where there are too few dates or scored rows.

    log: date, symbol, model, signal, confidence, price; bars: symbol, ts, bar_no, close.
    """
    cutoff = F.date_sub(F.lit(today).cast("date"), horizon + 1)
    usable = log.where(
        F.col("price").isNotNull() & F.col("signal").isNotNull() & F.col("confidence").isNotNull()
        & (F.col("date") <= cutoff))
    known = dedupe_sessions(resolve_sessions(usable, bars), tie)
    recent = latest_dates(known, min_lookback)
    # The bar `horizon` places after the session.  A date without a session lies before
    # its symbol's first bar, and looks forward from that.
    at = bars.select("symbol", F.to_date("ts").alias("session"), "bar_no")
    later = bars.select("symbol", (F.col("bar_no") - horizon).alias("bar_no"), F.col("close").alias("realized"))
    first = bars.groupBy("symbol").agg(F.min("bar_no").alias("_first"))
    placed = recent.join(at, ["symbol", "session"], "left").join(first, "symbol", "left")
    placed = placed.withColumn("bar_no", F.coalesce("bar_no", "_first")).drop("_first")
    scored = placed.join(later, ["symbol", "bar_no"], "left")
    ret = F.when(F.col("price") > 0, F.col("realized") / F.col("price") - 1.0)
    scored = scored.withColumns({"ret": ret, "score": signal_score("signal", "confidence")}).withColumn(
        "ok", F.col("ret").isNotNull() & (F.abs("ret") >= 1e-5))
    good = scored.where("ok")
    ic = rank_ic(good, "score", "ret", ["model"], ["symbol", "session"], 2).select(
        "model", F.coalesce("ic", F.lit(0.0)).alias("ic"))
    ok, directional = F.col("ok"), F.col("ok") & (F.col("score") != 0)
    hit = (F.signum("score") == F.signum("ret")).cast("double")
    stats = scored.groupBy("model").agg(
        F.first("n_dates").alias("n_dates"), F.count(F.lit(1)).alias("_rows"), F.count_if(ok).alias("lookback_n"),
        F.count_if(directional).alias("n_directional"),
        F.coalesce(F.avg(F.when(directional, hit)), F.lit(0.0)).alias("directional_accuracy"),
        F.avg(F.when(ok, F.col("score"))).alias("mean_pred"), F.stddev_pop(F.when(ok, F.col("score"))).alias("std_pred"))
    need = F.greatest(F.lit(min_lookback // 2), F.floor(F.col("_rows") / 2))
    valid = (F.col("n_dates") >= min_lookback) & (F.col("lookback_n") >= need)
    out = ["ic", "directional_accuracy", "n_directional", "lookback_n", "mean_pred", "std_pred"]
    return stats.join(ic, "model", "left").select("model", *[F.when(valid, F.col(c)).alias(c) for c in out])


def collapse_restatements(log: DataFrame, order: Sequence[str] = ("date",), bucket: str = "date",
                          size: int = CHUNK_ROWS) -> DataFrame:
    """Drop a record whose bar_date (price where absent) repeats the previous record of its model and symbol."""
    keys = ["model", "symbol"]
    d = number_rows(log.where("model is not null and symbol is not null and date is not null"), keys, order, bucket)
    ident = F.coalesce(F.col("bar_date").cast("string"), F.col("price").cast("string"))
    d = chunked(d.withColumn("_id", ident), halo=1, size=size)
    d = own_rows(d.withColumn("_prev", F.lag("_id").over(chunk_window(keys))))
    return d.where("_id is null or _prev is null or _id != _prev").drop("_id", "_prev", "bar_no")


def daily_mean_scores(log: DataFrame) -> DataFrame:
    return log.groupBy("date", "model").agg(F.avg(signal_score("signal", "confidence")).alias("mean_score"))


def today_mean_scores(predictions: DataFrame) -> DataFrame:
    return predictions.where("signal is not null").groupBy("model").agg(
        F.avg(signal_score("signal", "confidence")).alias("today_score"))


def signal_drift(log: DataFrame, today_scores: DataFrame, today: str, window_days: int = DRIFT_DAYS) -> DataFrame:
    """(model, drifted): today and the previous session both far from the trailing baseline."""
    t = F.lit(today).cast("date")
    recent = log.where((F.col("date") >= F.date_sub(t, window_days)) & (F.col("date") < t))
    means = daily_mean_scores(recent)
    last = means.groupBy("model").agg(F.max("date").alias("_last"))
    m = means.join(last, "model")
    base = F.when(F.col("date") != F.col("_last"), F.col("mean_score"))
    stats = m.groupBy("model").agg(
        F.count(base).alias("n_baseline"), F.avg(base).alias("mu"), F.stddev_pop(base).alias("sigma"),
        F.max(F.when(F.col("date") == F.col("_last"), F.col("mean_score"))).alias("previous_score"))
    j = today_scores.join(stats, "model", "left")

    def shifted(score: str):
        gap = F.abs(F.col(score) - F.col("mu"))
        return (gap > DRIFT_SIGMA * F.col("sigma")) & (gap > DRIFT_ABS)

    usable = (F.col("n_baseline") >= MIN_DRIFT_OBS) & (F.col("sigma") > 0)
    drifted = F.coalesce(usable & shifted("today_score") & shifted("previous_score"), F.lit(False))
    return j.withColumn("drifted", drifted)


def consensus(predictions: DataFrame, at_least: int = 2) -> DataFrame:
    """Symbols on whose direction at least two models agree, dearest first."""
    votes = predictions.where("signal in ('BUY', 'SELL')").groupBy("symbol", "signal").agg(
        F.count(F.lit(1)).alias("votes"), F.max("price").alias("price")).where(F.col("votes") >= at_least)
    return votes.orderBy("signal", F.col("price").desc(), "symbol")


def retrain_runs(ic_history: DataFrame, run: int = RETRAIN_RUN, date: str = "computed_at") -> DataFrame:
    """(model, longest_run, retrain): longest stretch of consecutive dates with negative IC."""
    w = Window.partitionBy("model").orderBy(date)  # one row per model and trading day
    h = ic_history.withColumn("_neg", F.coalesce(F.col("ic") < 0, F.lit(False))).withColumn(
        "_breaks", F.sum((~F.col("_neg")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = h.groupBy("model", "_breaks").agg(F.count_if("_neg").alias("_len"))
    return runs.groupBy("model").agg(F.max("_len").alias("longest_run"), (F.max("_len") >= run).alias("retrain"))
