"""Evaluation, monitoring and streaming (inventory A, O, Z)."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from panelforge import session
from panelforge.catalog.base import (
    SQL_LOG, SQL_PANEL, SQL_SCORE, bars, benchmark, cols_sql, out, panel, prediction_log, query, r_sql,
    raw_bars, reversal_panel, table,
)
from panelforge.catalog.xsec_queries import (
    GRID, SQL_DAILY, SQL_GRID, SQL_LEDGER, SQL_TRADES, grid_daily, ledger, rankic_sql,
)
from panelforge.catalog.base import SQL_TICKS
from panelforge.functions import stats
from panelforge.operators import book as bk
from panelforge.operators import extensions, metrics, monitor, overfit, xsec
from panelforge.operators.scans import realized_pnl
from panelforge.operators.timeaxis import number_rows
from panelforge.streaming import jobs

SQL_BOOKS = f"{SQL_PANEL}, {SQL_GRID}, {SQL_DAILY}"


def flagship(spark, sf):
    """Monthly reversal book on small tables: ranks, weights, drift, costs, equity."""
    session.apply_runtime_conf(spark)
    p = session.materialize(reversal_panel(number_rows(raw_bars(spark, sf, "month")), None), "entry_panel")
    return bk.run_book(p, [xsec.BookConfig(0.2, 1, min_names=5, use_beta=False)]).select(
        "ts", "gross_ret", "turnover", "cost", "borrow", "book_ret", "equity", "n_held").orderBy("ts")


# ---- return series ------------------------------------------------------------------

_EQ = ["daily_sharpe", "daily_sortino", "max_drawdown_pct", "total_return_pct"]


@query("a01_equity_summary", f"""WITH {SQL_PANEL}, c AS (SELECT symbol, ts, close AS eq, close / lag(close) OVER w - 1 AS r, max(close) OVER u AS peak FROM panel1
    WINDOW w AS (PARTITION BY symbol ORDER BY ts), u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT symbol, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END AS daily_sharpe,
    CASE WHEN sum(least(r, 0)) < 0 THEN avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(252) ELSE 0 END AS daily_sortino,
    min((eq - peak) / (peak + 1e-12)) * 100 AS max_drawdown_pct, (arg_max(eq, ts) / arg_min(eq, ts) - 1) * 100 AS total_return_pct FROM c GROUP BY symbol)
  SELECT symbol, {cols_sql(_EQ, 5)} FROM s""")
def equity_summary(spark, sf):
    """Sharpe, Sortino, drawdown and total return (A1-A3), each symbol's price as its equity."""
    p = number_rows(panel(spark, sf).drop("bar_no"))
    return out(metrics.equity_summary(p, ["symbol"], "close", "bar_no"), ["symbol"], _EQ, 5)


@query("a01_config_sharpe", f"WITH {SQL_BOOKS} SELECT config, {r_sql('avg(book_ret) / stddev_samp(book_ret)', 'sr')}, {r_sql('avg(book_ret) / stddev_samp(book_ret) * sqrt(252)', 'ann', 5)} FROM daily GROUP BY config")
def config_sharpe(spark, sf):
    g = grid_daily(spark, sf).groupBy("config").agg(stats.per_period_sharpe("book_ret").alias("sr"), stats.annual_sharpe("book_ret").alias("ann"))
    return g.selectExpr("config", "IF(round(sr, 6) = 0, 0D, round(sr, 6)) AS sr", "IF(round(ann, 5) = 0, 0D, round(ann, 5)) AS ann")


@query("a04_trade_summary", f"""WITH RECURSIVE {SQL_TICKS}, {SQL_TRADES} {SQL_LEDGER} SELECT symbol, count(pnl) AS n_round_trades, {r_sql('avg((pnl > 0)::INT)', 'hit_rate')},
  {r_sql('CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) END', 'profit_factor')}
  FROM led WHERE pnl IS NOT NULL GROUP BY symbol""")
def trade_summary(spark, sf):
    return out(metrics.trade_summary(realized_pnl(ledger(spark, sf)), ["symbol"]), ["symbol", "n_round_trades"], ["hit_rate", "profit_factor"])


SQL_BNEXT = """bn AS (SELECT ts, close AS bc, lead(close) OVER (ORDER BY ts) / close - 1 AS br FROM bench0)"""


def next_benchmark(spark, sf):
    """Benchmark close and the return from each date to the next."""
    b = number_rows(benchmark(spark, sf), keys=())
    nxt = b.select((F.col("bar_no") - 1).alias("bar_no"), F.col("close").alias("_n"))
    return b.join(nxt, "bar_no", "left").select("ts", F.col("close").alias("bench_close"), (F.col("_n") / F.col("close") - 1).alias("bench_ret"))


_CMP = ["benchmark_return_pct", "alpha_pct", "information_ratio"]


@query("a05_benchmark_comparison", f"""WITH {SQL_BOOKS}, {SQL_BNEXT}, c AS (SELECT config, (arg_max(equity, ts) / arg_min(equity, ts) - 1) * 100 AS own FROM daily GROUP BY config),
  j AS (SELECT c.config, c.own, bn.*, d.book_ret FROM bn CROSS JOIN c LEFT JOIN daily d ON d.config = c.config AND d.ts = bn.ts),
  e AS (SELECT config, (arg_max(bc, ts) / arg_min(bc, ts) - 1) * 100 AS benchmark_return_pct, max(own) - (arg_max(bc, ts) / arg_min(bc, ts) - 1) * 100 AS alpha_pct,
    avg(coalesce(book_ret, 0) - br) / stddev_samp(coalesce(book_ret, 0) - br) * sqrt(252) AS information_ratio FROM j GROUP BY config)
  SELECT config, {cols_sql(_CMP[:1] + _CMP[2:], 4)}, {r_sql('sign(alpha_pct) * ln(1 + abs(alpha_pct))', 'log_alpha', 4)} FROM e""")
def benchmark_comparison(spark, sf):
    """Alpha and information ratio of every variant (A5)."""
    r = metrics.benchmark_comparison(grid_daily(spark, sf), next_benchmark(spark, sf), ["config"], "book_ret", equity="equity")
    # On the logarithm, as the synthetic books' equity spans hundreds of magnitudes.
    r = r.withColumn("log_alpha", F.signum("alpha_pct") * F.log1p(F.abs("alpha_pct")))
    return out(r, ["config"], ["benchmark_return_pct", "information_ratio", "log_alpha"], 4)


SQL_BETA = """betas AS (SELECT config, CASE WHEN count(br) >= 30 AND var_samp(br) > 0 THEN covar_samp(br, book_ret) / var_samp(br) END AS beta
  FROM daily JOIN bn USING (ts) WHERE br IS NOT NULL AND book_ret IS NOT NULL GROUP BY config)"""


@query("a06_book_beta", f"WITH {SQL_BOOKS}, {SQL_BNEXT}, {SQL_BETA} SELECT config, {r_sql('beta')} FROM betas")
def book_beta(spark, sf):
    """Realised beta of every variant on the benchmark."""
    return out(metrics.book_beta(grid_daily(spark, sf), next_benchmark(spark, sf)), ["config"], ["beta"])


@query("a22_beta_gap", f"WITH {SQL_BOOKS}, {SQL_BNEXT}, {SQL_BETA}, x AS (SELECT config, avg(ex_ante_beta) AS e FROM daily GROUP BY 1) SELECT config, {r_sql('beta - e', 'gap')} FROM betas JOIN x USING (config)")
def beta_gap(spark, sf):
    d = grid_daily(spark, sf)
    j = metrics.book_beta(d, next_benchmark(spark, sf)).join(bk.book_diagnostics(d), "config")
    return out(j.withColumn("gap", F.col("beta") - F.col("mean_ex_ante_beta")), ["config"], ["gap"])


SQL_MOM = """mo0 AS (SELECT config, config_no, book_ret AS r, avg(book_ret) OVER (PARTITION BY config) AS m, stddev_pop(book_ret) OVER (PARTITION BY config) AS s FROM daily),
  mom AS (SELECT config, config_no, count(*) AS t, avg(r) AS mean, max(s) AS sd0, stddev_samp(r) AS sd1, avg(power((r - m) / s, 3)) AS skew, avg(power((r - m) / s, 4)) AS kurt,
    avg(r) / stddev_samp(r) AS sr FROM mo0 GROUP BY 1, 2)"""


@query("a07_return_moments", f"WITH {SQL_BOOKS}, {SQL_MOM} SELECT config, t, {cols_sql(['mean', 'sd0', 'sd1', 'skew', 'kurt', 'sr'], 5)} FROM mom")
def moments(spark, sf):
    return out(metrics.return_moments(grid_daily(spark, sf), "book_ret", ["config"]), ["config", "t"], ["mean", "sd0", "sd1", "skew", "kurt", "sr"], 5)


_N = len(GRID)
_Z = (1 - stats.EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / _N) + stats.EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (_N * math.e))
SQL_DSR = f"""tv AS (SELECT var_samp(sr) AS trial_var FROM mom), best AS (SELECT mom.*, trial_var, sqrt(trial_var) * {_Z!r}::DOUBLE AS sr0 FROM mom, tv ORDER BY sr DESC, config_no LIMIT 1),
  dsr AS (SELECT *, (sr - sr0) * sqrt(t - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM best)"""


@query("a09_deflated_sharpe", f"WITH {SQL_BOOKS}, {SQL_MOM}, {SQL_DSR} SELECT config, {cols_sql(['sr', 'sr0', 'trial_var', 'z'], 5)} FROM dsr")
def deflated(spark, sf):
    """Best variant, expected best under no skill and the deflation statistic."""
    b = overfit.best_trial(grid_daily(spark, sf), "config", "config_no", "book_ret", _N)
    return out(b, ["config"], ["sr", "sr0", "trial_var", "z"], 5)


SQL_PBO = """pb0 AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY i) - 1 AS pa, count(*) OVER (PARTITION BY config) AS tt FROM daily),
  pb1 AS (SELECT config_no, book_ret, CASE WHEN pa < (tt % 16) * (tt // 16 + 1) THEN pa // (tt // 16 + 1) ELSE (tt % 16) + (pa - (tt % 16) * (tt // 16 + 1)) // (tt // 16) END AS blk FROM pb0),
  pb2 AS (SELECT config_no, blk, sum(book_ret) AS s, count(*) AS c FROM pb1 GROUP BY 1, 2), mk AS (SELECT m AS mask FROM range(0, 65536) t(m) WHERE bit_count(m) = 8),
  pb3 AS (SELECT mask, config_no, sum(s) FILTER ((mask >> blk) & 1 = 1) / sum(c) FILTER ((mask >> blk) & 1 = 1) AS ins, sum(s) FILTER ((mask >> blk) & 1 = 0) / sum(c) FILTER ((mask >> blk) & 1 = 0) AS oos
    FROM mk, pb2 GROUP BY 1, 2), pb4 AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY oos, config_no) AS rk, row_number() OVER (PARTITION BY mask ORDER BY ins DESC, config_no) AS best, count(*) OVER (PARTITION BY mask) AS n FROM pb3),
  lg AS (SELECT mask, config_no, ln((rk / (n + 1.0::DOUBLE)) / (1 - rk / (n + 1.0::DOUBLE))) AS logit FROM pb4 WHERE best = 1)"""


def _logits(spark, sf):
    d = grid_daily(spark, sf)
    n = d.agg(F.countDistinct("i")).first()[0]
    return overfit.overfit_logits(d, "config", "config_no", "i", "book_ret", n)


@query("a10_overfit_probability", f"WITH {SQL_BOOKS}, {SQL_PBO} SELECT count(*) AS n_combinations, {r_sql('avg((logit < 0)::INT)', 'pbo')} FROM lg")
def overfit_probability(spark, sf):
    return out(overfit.overfit_probability(_logits(spark, sf)), ["n_combinations"], ["pbo"])


@query("a10_overfit_logits", f"WITH {SQL_BOOKS}, {SQL_PBO} SELECT CAST(mask AS INT) AS mask, {r_sql('logit')} FROM lg")
def overfit_logits(spark, sf):
    """Logit per symmetric split (M6)."""
    return out(_logits(spark, sf), ["mask"], ["logit"])


@query("a10_logits_in_sql", f"WITH {SQL_BOOKS}, {SQL_PBO} SELECT CAST(mask AS INT) AS mask, {r_sql('logit')} FROM lg")
def logits_in_sql(spark, sf):
    """The same splits, ranked by the table function over a partitioned and ordered table (2.15)."""
    d = grid_daily(spark, sf)
    n = d.agg(F.countDistinct("i")).first()[0]
    means = overfit.split_means(d, "config", "config_no", "i", "book_ret", n).select("mask", "_cfg.*", "is_mean", "oos_mean")
    extensions.register_functions(spark)
    return out(spark.sql("SELECT * FROM split_logit(TABLE(SELECT * FROM {means}) PARTITION BY mask ORDER BY (oos_mean, config_no))",
                         means=means), ["mask"], ["logit"])


@query("a11_gate_verdict", f"""WITH {SQL_BOOKS}, {SQL_MOM}, {SQL_DSR}, {SQL_BNEXT}, {SQL_BETA} SELECT config, {r_sql('beta', digits=5)},
  CASE WHEN beta IS NULL THEN 'beta undefined' WHEN abs(beta) >= 0.1 THEN 'beta outside limit' WHEN z < {NormalDist().inv_cdf(0.95)!r} THEN 'no significant edge' ELSE 'significant neutral edge' END AS verdict,
  beta IS NOT NULL AND abs(beta) < 0.1 AND z >= {NormalDist().inv_cdf(0.95)!r} AS passed FROM dsr JOIN betas USING (config)""")
def gate_verdict(spark, sf):
    d = grid_daily(spark, sf)
    v = overfit.evaluate_grid(d, metrics.book_beta(d, next_benchmark(spark, sf)), None, _N)
    return out(v, ["config", "verdict", "passed"], ["beta"], 5)


@query("a12_forecast_metrics", f"""WITH {SQL_PANEL}, one AS (SELECT 1 AS g, * FROM panel1 WHERE ret IS NOT NULL), {rankic_sql('pred', 'ret', 'g', 'one', 2)},
  m AS (SELECT avg((sign(pred) = sign(ret))::INT) AS dir_acc, 1 - sum((ret - pred) * (ret - pred)) / (var_pop(ret) * count(*)) AS r2, avg(abs(ret - pred)) AS mae FROM one)
  SELECT n, {cols_sql(['ic', 'dir_acc', 'r2', 'mae'], 5)} FROM m, ics""")
def forecast_metrics(spark, sf):
    return out(metrics.forecast_metrics(panel(spark, sf), "pred", "ret"), ["n"], ["ic", "dir_acc", "r2", "mae"], 5)


SQL_CLS = SQL_PANEL + """, cls AS (SELECT symbol, ts, CASE WHEN ret > 0.1 THEN 2 WHEN ret < -0.1 THEN 0 ELSE 1 END AS y, CASE WHEN pred > 0.1 THEN 2 WHEN pred < -0.1 THEN 0 ELSE 1 END AS p FROM panel1 WHERE ret IS NOT NULL)"""


def classes(spark, sf):
    from panelforge.functions.scalars import discretize
    return panel(spark, sf).where("ret is not null").select("symbol", "ts", discretize("ret", 0.1, -0.1).alias("y"), discretize("pred", 0.1, -0.1).alias("p"))


@query("a13_classifier_metrics", f"""WITH {SQL_CLS}, k AS (SELECT UNNEST([0, 1, 2]) AS c), f AS (SELECT c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y = c) + count(*) FILTER (p = c) AS b FROM cls, k GROUP BY c)
  SELECT (SELECT count(*) FROM cls) AS n, {r_sql('(SELECT avg((y = p)::INT) FROM cls)', 'accuracy')}, {r_sql('avg(2.0::DOUBLE * tp / b)', 'macro_f1')} FROM f""")
def classifier_metrics(spark, sf):
    return out(metrics.classifier_metrics(classes(spark, sf), "y", "p"), ["n"], ["accuracy", "macro_f1"])


@query("a14_class_weights", f"""WITH {SQL_CLS} SELECT y, count(*) AS class_count, {r_sql('sqrt((SELECT count(*) FROM cls) / (3.0::DOUBLE * count(*)))', 'weight')} FROM cls GROUP BY y""")
def class_weights(spark, sf):
    w = metrics.class_weights(classes(spark, sf), "y", "sqrt")
    return out(w.groupBy("y").agg(F.max("class_count").alias("class_count"), F.max("weight").alias("weight")), ["y", "class_count"], ["weight"])


@query("a16_daily_mean_scores", f"WITH {SQL_LOG} SELECT date, model, {r_sql(f'avg({SQL_SCORE})', 'mean_score')} FROM log GROUP BY date, model")
def daily_mean_scores(spark, sf):
    return out(monitor.daily_mean_scores(prediction_log(spark, sf)), ["date", "model"], ["mean_score"])


@query("a17_today_mean_scores", f"WITH {SQL_LOG} SELECT model, {r_sql(f'avg({SQL_SCORE})', 'today_score')} FROM log WHERE date = DATE '2024-01-30' GROUP BY model")
def today_scores(spark, sf):
    return out(monitor.today_mean_scores(prediction_log(spark, sf).where("date = DATE'2024-01-30'")), ["model"], ["today_score"])


@query("a18_consensus", f"""WITH {SQL_LOG}, t AS (SELECT symbol, model, date, arg_max(signal, event_id) AS signal, arg_max(price, event_id) AS price FROM log WHERE date = DATE '2024-01-15' GROUP BY ALL)
  SELECT symbol, signal, count(*) AS votes, {r_sql('max(price)', 'price')} FROM t WHERE signal <> 'HOLD' GROUP BY 1, 2 HAVING count(*) >= 2""")
def consensus(spark, sf):
    from panelforge.operators.quality import keep_one
    day = prediction_log(spark, sf).where("date = DATE'2024-01-15'").select("symbol", "model", "signal", "price", "event_id")
    return out(monitor.consensus(keep_one(day, ["symbol", "model"], "event_id")), ["symbol", "signal", "votes"], ["price"])


@query("a19_strategy_summary", """SELECT o_orderpriority AS strategy, CAST(o_custkey AS VARCHAR) AS symbol, count(DISTINCT o_custkey) AS n_symbols,
  round(avg(o_totalprice), 4) AS mean_total FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_custkey))""")
def strategy_summary(spark, sf):
    runs = table(spark, sf, "orders").selectExpr("o_orderpriority AS strategy", "CAST(o_custkey AS STRING) AS symbol", "o_totalprice AS total")
    return out(metrics.strategy_summary(runs, ["total"]), ["strategy", "symbol", "n_symbols"], ["mean_total"], 4)


@query("a20_sensitivity_summary", f"WITH {SQL_BOOKS}, s AS (SELECT config, avg(turnover) AS t, avg(book_ret) AS b FROM daily GROUP BY 1) SELECT {r_sql('avg(t)', 'mean_t')}, {r_sql('stddev_samp(t)', 'std_t')}, {r_sql('avg(b)', 'mean_b')}, {r_sql('stddev_samp(b)', 'std_b')} FROM s")
def sensitivity(spark, sf):
    s = grid_daily(spark, sf).groupBy("config").agg(F.avg("turnover").alias("t"), F.avg("book_ret").alias("b"))
    return out(metrics.sensitivity_summary(s, ["t", "b"]), [], ["mean_t", "std_t", "mean_b", "std_b"])


# ---- monitoring --------------------------------------------------------------------------

_IC = ["ic", "directional_accuracy", "mean_pred", "std_pred"]
SQL_PRICES = """px AS (SELECT symbol, date AS ts, arg_max(price, event_id) AS close FROM log WHERE isodow(date) < 6 GROUP BY 1, 2),
  pxn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM px)"""


def log_bars(spark, sf):
    """Weekday closes of each symbol, taken from the log's own prices."""
    l = prediction_log(spark, sf).where("weekday(date) < 5")
    return number_rows(l.groupBy("symbol", F.col("date").alias("ts")).agg(F.max_by("price", "event_id").alias("close")), bucket="trunc(ts, 'month')")


@query("o01_realized_ic", f"""WITH {SQL_LOG}, {SQL_PRICES}, u AS (SELECT * FROM log WHERE date <= DATE '2024-01-30' - 4),
  r AS (SELECT u.*, coalesce((SELECT max(ts) FROM pxn WHERE pxn.symbol = u.symbol AND pxn.ts <= u.date), u.date) AS session FROM u),
  d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY model, symbol, session ORDER BY date, event_id) = 1),
  k AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY session DESC) AS dr FROM d), nd AS (SELECT model, count(DISTINCT session) AS n_dates FROM d GROUP BY 1),
  s AS (SELECT k.model, k.symbol, k.session, {SQL_SCORE} AS score, b.close / k.price - 1 AS ret FROM k LEFT JOIN pxn a ON a.symbol = k.symbol AND a.ts = k.session
    LEFT JOIN (SELECT symbol, min(bar_no) AS b0 FROM pxn GROUP BY symbol) f ON f.symbol = k.symbol
    LEFT JOIN pxn b ON b.symbol = k.symbol AND b.bar_no = coalesce(a.bar_no, f.b0) + 3 WHERE dr <= 15),
  ok AS (SELECT * FROM s WHERE ret IS NOT NULL AND abs(ret) >= 1e-5), {rankic_sql('score', 'ret', 'model', 'ok', 2)},
  st AS (SELECT model, count(*) AS rows_, count(*) FILTER (ret IS NOT NULL AND abs(ret) >= 1e-5) AS lookback_n FROM s GROUP BY 1),
  ag AS (SELECT model, count(*) FILTER (score <> 0) AS n_directional, avg((sign(score) = sign(ret))::INT) FILTER (score <> 0) AS directional_accuracy, avg(score) AS mean_pred, stddev_pop(score) AS std_pred FROM ok GROUP BY 1),
  f AS (SELECT st.model, n_dates >= 15 AND lookback_n >= greatest(7, rows_ // 2) AS good, lookback_n, n_directional, coalesce(ic, 0) AS ic, directional_accuracy, mean_pred, std_pred
    FROM st JOIN nd USING (model) LEFT JOIN ag USING (model) LEFT JOIN ics USING (model))
  SELECT model, CASE WHEN good THEN lookback_n END AS lookback_n, CASE WHEN good THEN n_directional END AS n_directional, {', '.join(r_sql(f'CASE WHEN good THEN {c} END', c) for c in _IC)} FROM f""")
def realized_ic(spark, sf):
    """Scorecard per model over its latest 15 sessions."""
    r = monitor.realized_ic(prediction_log(spark, sf).drop("ts"), log_bars(spark, sf), "2024-01-30", min_lookback=15, tie=["event_id"])
    return out(r, ["model", "lookback_n", "n_directional"], _IC)


@query("o02_signal_drift", f"""WITH {SQL_LOG}, o AS (SELECT *, lag(bar_date) OVER (PARTITION BY model, symbol ORDER BY date, event_id) AS p FROM log),
  c AS (SELECT * FROM o WHERE p IS NULL OR p <> bar_date), d AS (SELECT date, model, avg({SQL_SCORE}) AS ms FROM c WHERE date >= DATE '2024-01-30' - 30 AND date < DATE '2024-01-30' GROUP BY 1, 2),
  l AS (SELECT *, max(date) OVER (PARTITION BY model) AS ld FROM d), s AS (SELECT model, count(*) FILTER (date <> ld) AS n, avg(ms) FILTER (date <> ld) AS mu, stddev_pop(ms) FILTER (date <> ld) AS sg, max(ms) FILTER (date = ld) AS prev FROM l GROUP BY 1),
  t AS (SELECT model, avg({SQL_SCORE}) AS ts_ FROM log WHERE date = DATE '2024-01-30' GROUP BY 1)
  SELECT model, n AS n_baseline, {r_sql('mu')}, {r_sql('sg', 'sigma')}, coalesce(n >= 10 AND sg > 0 AND abs(ts_ - mu) > 2 * sg AND abs(ts_ - mu) > 0.002 AND abs(prev - mu) > 2 * sg AND abs(prev - mu) > 0.002, false) AS drifted FROM t LEFT JOIN s USING (model)""")
def signal_drift(spark, sf):
    log = prediction_log(spark, sf)
    today = monitor.today_mean_scores(log.where("date = DATE'2024-01-30'"))
    d = monitor.signal_drift(monitor.collapse_restatements(log, ("date", "event_id")), today, "2024-01-30")
    return out(d, ["model", "n_baseline", "drifted"], ["mu", "sigma"])


@query("o03_fetch_plan", f"WITH {SQL_LOG} SELECT symbol, min(date) - 10 AS start, max(date) + 16 AS \"end\", count(DISTINCT date) AS n_dates FROM log GROUP BY symbol")
def fetch_plan(spark, sf):
    """One price range per symbol."""
    return monitor.fetch_plan(prediction_log(spark, sf))


@query("o06_retrain_trigger", f"""WITH {SQL_PANEL}, {rankic_sql('pred', 'ret')}, h AS (SELECT 'm' AS model, ts, coalesce(ic < 0, false) AS neg, sum(CASE WHEN coalesce(ic < 0, false) THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS g FROM ics),
  r AS (SELECT model, g, count(*) FILTER (neg) AS n FROM h GROUP BY 1, 2) SELECT model, max(n) AS longest_run, max(n) >= 10 AS retrain FROM r GROUP BY model""")
def retrain_trigger(spark, sf):
    ics = metrics.cross_sectional_ic(panel(spark, sf), "pred", "ret").select(F.lit("m").alias("model"), F.col("ts").alias("computed_at"), "ic")
    return monitor.retrain_runs(ics)


# ---- streams -------------------------------------------------------------------------------

def event_ticks(spark, sf):
    e = jobs.file_stream(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id")


LOG_KEYS = ["symbol", "model", "bar_date"]


def event_batches(spark, sf, batches: int = 4):
    """The events as a stream of several batches in the order of time: their file cut by days and read one part at a time."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min("event_id").isNull().alias("none")).first()
    path = session.new_path(spark, "event_files")
    part = F.lit(0) if span["none"] or span["lo"] == span["hi"] else F.least(F.lit(batches - 1), F.floor(
        (F.unix_micros("ts") - F.unix_micros(F.lit(span["lo"]))) / ((F.unix_micros(F.lit(span["hi"])) - F.unix_micros(F.lit(span["lo"]))) / batches)))
    for i in range(batches):  # one after the other, as the stream takes files by age
        e.where(part == i).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return jobs.file_stream(spark, path, "events", 1)


def event_records(spark, sf):
    return event_batches(spark, sf).select(F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("model"),
                                           F.to_date("ts").alias("bar_date"), "ts", "event_id")


@query("z01_stream_bars", f"""WITH e AS (SELECT *, date_trunc('hour', ts) AS h, max(ts) OVER () AS m FROM events), b AS (SELECT event_type AS symbol, h, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, count(*) AS n_ticks FROM e WHERE h + INTERVAL 1 HOUR <= date_trunc('milliseconds', m) - INTERVAL 10 MINUTE GROUP BY 1, 2)
  SELECT symbol, CAST(h AS VARCHAR) AS ts, n_ticks, {cols_sql(['open', 'high', 'low', 'close'])} FROM b""")
def stream_bars(spark, sf):
    """Hourly bars from the event stream, closed windows only."""
    b = jobs.run_to_table(jobs.tick_bars(event_ticks(spark, sf), "1 hour", "10 minutes", ["event_id"]), spark, "stream_bars")
    return out(b.withColumn("ts", F.col("ts").cast("string")), ["symbol", "ts", "n_ticks"], ["open", "high", "low", "close"])


@query("z02_stream_dedupe", "SELECT CAST(user_id AS VARCHAR) AS symbol, event_type AS model, CAST(ts AS DATE) AS bar_date, CAST(1 AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_dedupe(spark, sf):
    """First record per (symbol, model, bar date) of the stream, in several batches, by state within the watermark."""
    d = jobs.run_to_table(jobs.first_records(event_records(spark, sf), LOG_KEYS, "ts", "31 days"), spark, "stream_log")
    return d.groupBy("symbol", "model", "bar_date").agg(F.count(F.lit(1)).alias("n"))


@query("s15_stream_log", """SELECT CAST(user_id AS VARCHAR) AS symbol, event_type AS model, CAST(CAST(ts AS DATE) AS VARCHAR) AS bar_date, min(event_id) AS event_id, CAST(1 AS BIGINT) AS n
  FROM events GROUP BY 1, 2, 3""")
def stream_log(spark, sf):
    """The same log kept by its sink: every batch runs twice, and a key is logged once whatever batch it comes in."""
    log = jobs.KeyedLog(spark, session.new_path(spark, "keyed_log"), "events", "symbol string, model string, bar_date date, ts timestamp, event_id bigint", LOG_KEYS, "event_id")

    def twice(batch, number):
        log(batch, number)
        log(batch, number)

    jobs.run_batches(event_records(spark, sf), spark, "keyed_log", twice)
    d = log.read().groupBy("symbol", "model", F.col("bar_date").cast("string").alias("bar_date"))
    return d.agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))


@query("z03_stream_book", """WITH e AS (SELECT event_type AS symbol, ts, event_id, value, CASE WHEN event_id % 997 = 0 THEN 0.1::DOUBLE + (event_id % 7) / 100.0::DOUBLE END AS target FROM events),
  s AS (SELECT symbol, arg_max(value, (ts, event_id)) AS last, arg_max(target, (ts, event_id)) FILTER (target IS NOT NULL) AS target,
  arg_max(value, (ts, event_id)) FILTER (target IS NOT NULL) AS at_target FROM e GROUP BY 1)
  SELECT symbol, round(coalesce(target, 0.2::DOUBLE) * (last / coalesce(at_target, 50)), 6) AS weight, round(last, 6) AS price FROM s""")
def stream_book(spark, sf):
    """A held book as state: carried by price batches, set anew by rows with a target."""
    held = table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct().select("symbol", F.lit(0.2).alias("weight"), F.lit(50.0).alias("price"))
    e = event_batches(spark, sf)
    target = F.when(F.col("event_id") % 997 == 0, 0.1 + (F.col("event_id") % 7) / 100.0)
    rows = e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), target.alias("target"))
    changes = jobs.BatchFolders(spark, session.new_path(spark, "book_changes"), "book", jobs.BOOK)
    jobs.run_batches(jobs.held_book(rows, held), spark, "stream_book", changes, mode="update")
    return out(jobs.current_book(changes.read(), held), ["symbol"], ["weight", "price"])


@query("z04_stream_gap_alarms", """WITH e AS (SELECT event_type || CAST(user_id % 40 AS VARCHAR) AS symbol, ts, max(ts) OVER () AS top FROM events),
  g AS (SELECT symbol, ts AS p, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS n, date_trunc('milliseconds', top) - INTERVAL 10 MINUTE AS mark FROM e)
  SELECT symbol, CAST(p AS VARCHAR) AS from_ts, CAST(n AS VARCHAR) AS to_ts FROM g
  WHERE n - p > INTERVAL 7200 SECOND OR n IS NULL AND date_trunc('milliseconds', p) + INTERVAL 7200 SECOND < mark""")
def stream_gaps(spark, sf):
    """Silences of more than two hours; those that last until the end are open alarms."""
    ticks = event_batches(spark, sf).select(F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("symbol"), "ts")
    alarms = jobs.BatchFolders(spark, session.new_path(spark, "alarms"), "gaps", jobs.ALARMS)
    jobs.run_batches(jobs.silence_alarms(ticks, 7200, "10 minutes"), spark, "stream_gaps", alarms, mode="update")
    return jobs.settled_alarms(alarms.read()).select("symbol", F.col("from_ts").cast("string").alias("from_ts"), F.col("to_ts").cast("string").alias("to_ts"))


@query("z05_stream_restatement", f"""SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS ts, {r_sql('arg_max(value, ts)', 'close')} FROM events GROUP BY 1, 2""")
def stream_restatement(spark, sf):
    """Every event restates its symbol's bar of the day; the last arrival stays."""
    e = jobs.file_stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").cast("timestamp").alias("ts"), F.lit("1d").alias("interval"),
        F.col("value").alias("close"), F.col("ts").cast("timestamp").alias("fetched_at"))
    path = session.new_path(spark, "restated")
    jobs.run_batches(e, spark, "restate", jobs.restate_bars(spark, path))
    return out(spark.read.parquet(path).withColumn("ts", F.to_date("ts")), ["symbol", "ts"], ["close"])
