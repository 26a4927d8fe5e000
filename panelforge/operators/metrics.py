"""Performance, forecast and classification metrics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import annual_sharpe, ols_beta, per_period_sharpe, sortino
from panelforge.operators.ranks import average_rank, group_ranks, largest_group
from panelforge.operators.timeaxis import CHUNK_ROWS, chunk_window, chunked, number_rows, own_rows, running
from panelforge.schema import EPS, IC_HORIZONS, TRADING_DAYS
from panelforge.session import materialize

MIN_IC_NAMES = 20
MIN_TRAIN_IC_NAMES = 5
MIN_BETA_OBS = 30


# ---- equity curves -------------------------------------------------------------

def daily_last(df: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Last non-null value of each day."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.max_by(value, ts).alias(value))


def equity_summary(curve: DataFrame, keys: Sequence[str], equity: str = "equity", order: str = "i",
                   size: int = CHUNK_ROWS) -> DataFrame:
    """Sharpe, Sortino, drawdown and total return of each equity curve (order = 0-based row number)."""
    c = curve.select(*keys, F.col(order).cast("long").alias("bar_no"), F.col(equity).alias("eq"))
    c = running(c, {"peak": ("max", "eq")}, keys, size)
    prev = F.lag("eq").over(chunk_window(keys))
    c = own_rows(chunked(c, halo=1, size=size).withColumn("r", F.try_divide("eq", prev) - 1))
    dd = (F.col("eq") - F.col("peak")) / (F.col("peak") + EPS)
    start, end = F.min_by("eq", "bar_no"), F.max_by("eq", "bar_no")
    return c.groupBy(*keys).agg(
        end.alias("final_equity"), ((end / start - 1) * 100).alias("total_return_pct"),
        annual_sharpe("r").alias("daily_sharpe"), sortino("r").alias("daily_sortino"),
        (F.min(dd) * 100).alias("max_drawdown_pct"))


def trade_summary(pnl: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hit rate, profit factor (NULL without losses) and number of closing trades."""
    p = F.col("pnl")
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))
    closed = pnl.where(p.isNotNull())
    return closed.groupBy(*keys).agg(
        F.count(p).alias("n_round_trades"), F.avg((p > 0).cast("double")).alias("hit_rate"),
        F.when(loss > 0, gain / loss).alias("profit_factor"), gain.alias("gross_profit"), loss.alias("gross_loss"))


def benchmark_comparison(returns: DataFrame, bench: DataFrame, keys: Sequence[str], ret: str, date: str = "ts",
                         equity: str | None = None) -> DataFrame:
    """Benchmark return, information ratio and, with `equity`, alpha: the strategy's total return less the benchmark's.

    Benchmark days without a strategy return count as 0.  A constant excess return has the ratio 0.
    bench: date, bench_close, bench_ret (NULL on the first day).
    """
    total = (F.max_by("bench_close", date) / F.min_by("bench_close", date) - 1) * 100
    b = F.col("bench_ret")
    whole = bench.agg(total.alias("benchmark_return_pct"), F.count(b).alias("_n"), F.sum(b).alias("_b"), F.sum(b * b).alias("_bb"))
    # Days without a strategy return enter through the benchmark's moments on the other days, so no grid of names and
    # dates is built; where there are none, the deviation is that of the joined days itself.
    j = returns.join(bench.select(date, "bench_ret"), date, "left")
    excess = F.when(b.isNotNull(), F.coalesce(F.col(ret), F.lit(0.0)) - b)
    shared = F.when(excess.isNotNull(), b)
    own = j.groupBy(*keys).agg(
        F.count(excess).alias("_n1"), F.coalesce(F.avg(excess), F.lit(0.0)).alias("_m1"),
        F.coalesce(F.var_pop(excess), F.lit(0.0)).alias("_v1"), F.coalesce(F.sum(shared), F.lit(0.0)).alias("_b1"),
        F.coalesce(F.sum(shared * shared), F.lit(0.0)).alias("_bb1"),
        *([] if equity is None else [((F.max_by(equity, date) / F.min_by(equity, date) - 1) * 100).alias("_own")]))
    s = own.join(F.broadcast(whole))  # one row
    n1, m1, n = F.col("_n1"), F.col("_m1"), F.col("_n")
    n2 = n - n1
    m2 = F.when(n2 > 0, -(F.col("_b") - F.col("_b1")) / n2).otherwise(0.0)
    squares2 = F.when(n2 > 0, F.greatest(F.col("_bb") - F.col("_bb1") - n2 * m2 * m2, F.lit(0.0))).otherwise(0.0)
    mean = (n1 * m1 + n2 * m2) / n
    squares = n1 * F.col("_v1") + squares2 + n1 * n2 / n * (m1 - m2) * (m1 - m2)
    # Rounding alone may leave a deviation where there is none.
    sd = F.sqrt(squares / (n - 1))
    ratio = F.when((n > 1) & (sd > 1e-12 * F.greatest(F.abs(mean), F.lit(1e-12))), mean / sd * math.sqrt(TRADING_DAYS)).otherwise(F.lit(0.0))
    alpha = [] if equity is None else [(F.col("_own") - F.col("benchmark_return_pct")).alias("alpha_pct")]
    return s.select(*keys, "benchmark_return_pct", *alpha, ratio.alias("information_ratio"))


def book_beta(daily: DataFrame, bench: DataFrame, keys: Sequence[str] = ("config",), date: str = "ts") -> DataFrame:
    j = daily.join(bench.select(date, "bench_ret"), date)
    return j.groupBy(*keys).agg(ols_beta("book_ret", "bench_ret", MIN_BETA_OBS).alias("beta"))


def return_moments(df: DataFrame, r: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviations, population skewness and non-excess kurtosis."""
    return df.groupBy(*keys).agg(
        F.count(r).alias("t"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd1"), F.stddev_pop(r).alias("sd0"),
        F.skewness(r).alias("skew"), (F.kurtosis(r) + 3.0).alias("kurt"), per_period_sharpe(r).alias("sr"))


# ---- rank correlations ----------------------------------------------------------

def forward_returns(df: DataFrame, horizons: Sequence[int] = IC_HORIZONS, keys: Sequence[str] = ("symbol",),
                    size: int = CHUNK_ROWS) -> DataFrame:
    """Add fwd_{h}: close h bars ahead over close, minus one."""
    w = chunk_window(keys)
    cols = {f"fwd_{h}": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1 for h in horizons}
    return own_rows(chunked(df, ahead=max(horizons), size=size).withColumns(cols))


def rank_ic(df: DataFrame, x: str, y: str, by: Sequence[str], spread: Sequence[str], min_names: int) -> DataFrame:
    """(by, n, ic): Spearman correlation per group; NULL when thin or constant."""
    pairs = df.select(*by, *spread, F.col(x).alias("_x"), F.col(y).alias("_y")).where(
        "_x is not null and _y is not null")
    largest = largest_group(pairs, by)
    rx = group_ranks(pairs, by, "_x", spread, largest=largest).withColumn("_rx", average_rank()).drop("n", "less", "eq")
    ry = group_ranks(rx, by, "_y", spread, largest=largest).withColumn("_ry", average_rank())
    flat = (F.stddev_pop("_x") < 1e-12) | (F.stddev_pop("_y") < 1e-12)
    ic = F.when((F.count(F.lit(1)) >= min_names) & ~flat, F.corr("_rx", "_ry"))
    return ry.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ic.alias("ic"))


def cross_sectional_ic(df: DataFrame, pred: str, fwd: str, date: str = "ts", min_names: int = MIN_IC_NAMES,
                       extra: Sequence[str] = ()) -> DataFrame:
    return rank_ic(df, pred, fwd, [*extra, date], ["symbol"], min_names)


def pooled_ic(df: DataFrame, x: str, y: str, spread: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Spearman over all rows together, ranked in ranges rather than in one task."""
    return rank_ic(df, x, y, [], spread, 2)


def ic_summary(ics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, ratio, annualised ratio, t statistic and share positive of per-date ICs."""
    sd = F.stddev_samp("ic")
    ratio = F.when(sd > 0, F.avg("ic") / sd)
    n = F.count("ic")
    return ics.groupBy(*keys).agg(
        n.alias("n_dates"), F.when(n >= 2, F.avg("ic")).alias("mean_ic"), sd.alias("std_ic"), ratio.alias("ic_ir"),
        (ratio * math.sqrt(TRADING_DAYS)).alias("ann_ic_ir"), (ratio * F.sqrt(n)).alias("t_stat"),
        F.when(n >= 2, F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double")))).alias("pct_positive"))


def dated_forward_returns(df: DataFrame, horizons: Sequence[int] = IC_HORIZONS, keep: Sequence[str] = (), date: str = "ts") -> DataFrame:
    """(date, symbol, keep, horizon, fwd): return to the h-th next date of the whole frame; NULL if the symbol has no row there."""
    dates = number_rows(df.select(date).distinct(), keys=(), order=(date,), bucket=f"year({date})", out="_i")
    placed = df.select(date, "symbol", "close", *keep).join(F.broadcast(dates), date)  # one row per calendar date
    later = placed.select("symbol", F.col("_i").alias("_j"), F.col("close").alias("_later"))
    asked = placed.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("_j", F.col("_i") + F.col("horizon"))
    return asked.join(later, ["symbol", "_j"], "left").select(
        date, "symbol", *keep, "horizon", (F.try_divide(F.col("_later"), F.col("close")) - 1).alias("fwd"))


def ic_decay(df: DataFrame, pred: str = "pred", horizons: Sequence[int] = IC_HORIZONS, min_names: int = MIN_IC_NAMES) -> DataFrame:
    """IC summary per horizon in dates; the horizons are ranked as separate groups of one job."""
    stacked = dated_forward_returns(df, horizons, [pred])
    ics = cross_sectional_ic(stacked, pred, "fwd", min_names=min_names, extra=["horizon"])
    return ic_summary(ics, ["horizon"]).withColumn("overlapping", F.col("horizon") > 1)


def names_coverage(df: DataFrame, pred: str = "pred", date: str = "ts", min_names: int = MIN_IC_NAMES) -> DataFrame:
    per_date = df.groupBy(date).agg(F.count(pred).alias("n"))
    return per_date.agg(F.count(F.lit(1)).alias("n_dates"), F.avg("n").alias("mean_n_names"),
                        F.count_if(F.col("n") < min_names).alias("n_dates_below_min_names"))


def forecast_metrics(df: DataFrame, pred: str, actual: str, spread: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Pooled IC (0 when undefined), directional accuracy, R2 and mean absolute error."""
    d = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    d = materialize(d.select(*dict.fromkeys([pred, actual, *[c for c in spread if c in d.columns]])), "forecasts")  # several passes follow
    err = F.col(actual) - F.col(pred)
    sst = F.var_pop(actual) * F.count(F.lit(1))
    row = d.agg(F.avg((F.signum(pred) == F.signum(actual)).cast("double")).alias("dir_acc"),
                F.when(sst > 0, 1.0 - F.sum(err * err) / sst).alias("r2"), F.avg(F.abs(err)).alias("mae"))
    ic = pooled_ic(d, pred, actual, spread).select(F.coalesce("ic", F.lit(0.0)).alias("ic"), F.col("n").alias("n"))
    return row.join(F.broadcast(ic))  # one row each


def train_ic(df: DataFrame, pred: str, actual: str, date: str = "ts") -> DataFrame:
    s = ic_summary(cross_sectional_ic(df, pred, actual, date, MIN_TRAIN_IC_NAMES))
    return s.select(F.col("mean_ic").alias("cs_ic"), F.col("ic_ir").alias("cs_ic_ir"), F.col("n_dates").alias("cs_n_dates"))


# ---- classification ----------------------------------------------------------------

def classifier_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy and macro-F1 over the classes that occur; built from the confusion counts."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    sides = cells.select("c", F.inline(F.array(
        F.struct(F.col("y").alias("cls"), F.lit(1).alias("is_y"), (F.col("y") == F.col("p")).cast("int").alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).alias("is_y"), F.lit(0).alias("hit")))))
    per_class = sides.groupBy("cls").agg(F.sum(F.col("c") * F.col("hit")).alias("tp"), F.sum("c").alias("both"),
                                         F.sum(F.col("c") * F.col("is_y")).alias("n"))
    # both = predicted + actual of the class, so F1 = 2 tp / both.
    return per_class.agg((F.sum("tp") / F.sum("n")).alias("accuracy"),
                         F.avg(2.0 * F.col("tp") / F.col("both")).alias("macro_f1"), F.sum("n").alias("n"))


def class_weights(df: DataFrame, label: str, kind: str = "sqrt", classes: int = 3) -> DataFrame:
    """Attach sample weights none / sqrt / inverse to the class frequency."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    everything = Window.partitionBy(F.lit(0))  # at most `classes` rows
    inverse = F.sum("_c").over(everything) / (F.lit(float(classes)) * F.col("_c"))
    weight = {"none": F.lit(1.0), "sqrt": F.sqrt(inverse), "inverse": inverse}[kind]
    table = counts.select(label, F.col("_c").alias("class_count"), weight.alias("weight"))
    return df.join(F.broadcast(table), label)  # one row per class


# ---- run summaries -------------------------------------------------------------------

def strategy_summary(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means per strategy and per (strategy, symbol) in one pass."""
    r = runs.rollup("strategy", "symbol").agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics], F.countDistinct("symbol").alias("n_symbols"))
    return r.where("strategy is not null")


def sensitivity_summary(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}"))]
    return runs.groupBy(*keys).agg(*aggs)
