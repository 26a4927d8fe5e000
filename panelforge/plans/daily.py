"""Daily job: monitor the log, signal, hold or rank the book, record what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import book, monitor, quality, signals
from panelforge.operators.xsec import BookConfig
from panelforge.sources import logs


@dataclass
class DailyOutput:
    stale: DataFrame
    realized: DataFrame
    predictions: DataFrame
    book: DataFrame
    drift: DataFrame
    new_records: DataFrame
    documents: DataFrame


def run_daily(scored: DataFrame, bars: DataFrame, log: DataFrame, last_book: DataFrame, registry: DataFrame,
              universe: DataFrame, today: str, config: BookConfig, model: str = "daily_predictor",
              sectors: DataFrame | None = None, max_age_days: int = 90) -> DailyOutput:
    """scored: symbol, ts, bar_no, close, pred, beta per bar; the state is the log and the last book."""
    live = signals.live_regressor(scored).withColumn("model", F.lit(model)).withColumn(
        "date", F.lit(today).cast("date")).withColumnRenamed("ts", "bar_date")
    beta = scored.groupBy("symbol").agg(F.max_by("beta", "bar_no").alias("beta"))
    scores = live.join(beta, "symbol").select("symbol", F.col("predicted_return").alias("score"), "beta", "price")
    held = book.live_book(last_book, scores, universe, config, today, sectors)
    drift = monitor.signal_drift(monitor.collapse_restatements(log), monitor.today_mean_scores(live), today)
    weights = held.select(F.lit(today).cast("date").alias("date"), "as_of", "symbol", "weight", "beta", "rebalanced")
    return DailyOutput(
        quality.stale_models(registry, today, max_age_days), monitor.realized_ic(log, bars, today), live, held, drift,
        logs.unrecorded(live, log), logs.daily_documents(live, weights))
