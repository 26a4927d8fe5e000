"""Features, rolling primitives and recurrences (inventory F and T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.base import (
    SQL_BARS, SQL_BENCH, SQL_PANEL, bars, benchmark, cols_sql, features, out, panel, query, r_sql, table,
)
from panelforge.operators import features as feats
from panelforge.operators.ewm import ewm_means, span_alpha, with_blocks
from panelforge.operators.metrics import daily_last
from panelforge.operators.rolling import block_roll
from panelforge.operators.scans import holding_filter
from panelforge.operators.signals import execution_lag, regressor_confidence
from panelforge.operators.timeaxis import (
    chunk_window, chunked, number_rows, own_rows, roll_max, roll_mean, roll_min, roll_quantile, roll_std, running,
)
from panelforge.operators.book import atr_pct, vol_scale
from panelforge.schema import FEATURE_COLS, ZSCORE_COLS

_EMA = "list_reduce(list(({x})::DOUBLE) OVER u, lambda y, x: {a} * x + (1 - {a}) * y)"


def _ema(x: str, a: str) -> str:
    return _EMA.format(x=x, a=a)


def _full(agg: str, x: str, k: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {k} THEN {agg}({x}) {frame} END"


def _z20(x: str) -> str:
    return f"({x} - {_full('avg', x, 20)}) / ({_full('stddev_samp', x, 20)} + 1e-12)"


def _z252(x: str) -> str:
    return (f"CASE WHEN count({x}) OVER z >= 60 THEN ({x} - avg({x}) OVER z) / (stddev_samp({x}) OVER z + 1e-12) END")


A14 = "(1.0::DOUBLE/14)"
SQL_FEATURES = SQL_BARS + ", " + SQL_BENCH + f""", f1 AS (SELECT x.*, k.b1, k.b5,
    lag(x.close) OVER w AS pc, x.close - lag(x.close) OVER w AS d,
    x.high - lag(x.high) OVER w AS up, lag(x.low) OVER w - x.low AS dn, lag(x.close, 12) OVER w AS c12,
    x.close / lag(x.close) OVER w - 1 AS ret_1d, x.close / lag(x.close, 5) OVER w - 1 AS ret_5d,
    x.close / lag(x.close, 10) OVER w - 1 AS ret_10d, x.close / lag(x.close, 21) OVER w - 1 AS ret_21d,
    lead(x.close, 3) OVER w / x.close - 1 AS fwd_ret_1d, x.close * x.volume AS dv
  FROM bars x LEFT JOIN bench k USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
f2 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0::DOUBLE END AS pdm,
    CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0::DOUBLE END AS ndm,
    greatest(coalesce(d, 0), 0) AS gain, greatest(coalesce(-d, 0), 0) AS loss,
    ((close - low) - (high - close)) / (high - low + 1e-12) * volume AS clvv,
    sign(coalesce(d, 0)) * volume AS sv, volume * ret_1d AS vr FROM f1),
f3 AS (SELECT *, {_full('stddev_samp', 'ret_1d', 20)} AS vol_20d, {_full('stddev_samp', 'ret_1d', 63)} AS vol63,
    {_full('avg', 'close', 10)} AS sma10, {_full('avg', 'close', 20)} AS sma20, {_full('avg', 'close', 50)} AS sma50,
    {_full('stddev_samp', 'close', 20)} AS sd20, {_full('avg', 'gain', 14)} AS g14, {_full('avg', 'loss', 14)} AS l14,
    {_full('avg', 'tr', 14)} AS atr, 100 * (close - {_full('min', 'low', 14)})
      / ({_full('max', 'high', 14)} - {_full('min', 'low', 14)} + 1e-12) AS stoch_k,
    {_full('avg', 'volume', 5)} AS v5, {_full('avg', 'volume', 20)} AS v20,
    CASE WHEN vr IS NOT NULL THEN sum(vr) OVER u END AS vpt, sum(clvv) OVER u AS ad, sum(sv) OVER u AS obv,
    {_ema('close', '(2.0::DOUBLE/13)')} AS e12, {_ema('close', '(2.0::DOUBLE/27)')} AS e26,
    {_ema('tr', A14)} AS wtr, {_ema('pdm', A14)} AS wp, {_ema('ndm', A14)} AS wn
  FROM f2 WINDOW u AS (PARTITION BY symbol ORDER BY ts)),
f4 AS (SELECT *, e12 - e26 AS macd, 100 * wp / (wtr + 1e-12) AS pdi, 100 * wn / (wtr + 1e-12) AS ndi FROM f3),
f5 AS (SELECT *, 100 * abs(pdi - ndi) / (pdi + ndi + 1e-12) AS dx FROM f4),
f6 AS (SELECT *, {_ema('macd', '(2.0::DOUBLE/10)')} AS macd_signal, {_ema('dx', A14)} AS adx_14,
    (sma10 - sma20) / (close + 1e-12) AS ma_spread_10_20, (sma20 - sma50) / (close + 1e-12) AS ma_spread_20_50,
    100 - 100 / (1 + g14 / (l14 + 1e-12)) AS rsi_14, (close - sma20) / (sma20 + 1e-12) AS price_vs_sma20,
    (close - sma50) / (sma50 + 1e-12) AS price_vs_sma50, 4 * sd20 / (close + 1e-12) AS bb_width,
    (close - (sma20 - 2 * sd20)) / (4 * sd20 + 1e-12) AS bb_position, {_full('avg', 'stoch_k', 3)} AS stoch_d,
    (close - c12) / (c12 + 1e-12) AS roc_12, atr / (close + 1e-12) AS atr_normalized,
    vol_20d / (vol63 + 1e-12) AS vol_regime, v5 / (v20 + 1e-12) AS rel_volume, (high - low) / (close + 1e-12) AS hl_ratio,
    {_z20('dv')} AS turnover_z, abs(ret_1d) / (dv + 1e-12) AS amihud_illiq, (open - pc) / (pc + 1e-12) AS gap,
    {_z20('vpt')} AS vpt_normalized, {_z20('ad')} AS ad_normalized, {_z20('obv')} AS obv_normalized,
    ret_1d - b1 AS ret_1d_vs_spy, ret_5d - b5 AS ret_5d_vs_spy
  FROM f5 WINDOW u AS (PARTITION BY symbol ORDER BY ts)),
f7 AS (SELECT symbol, ts, bar_no, close, {', '.join(c for c in FEATURE_COLS if c not in ZSCORE_COLS)}, fwd_ret_1d,
    vol_20d AS raw_vol, ret_1d AS raw_ret, {', '.join(f'{_z252(c)} AS {c}' for c in ZSCORE_COLS)}
  FROM f6 WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
feats AS (SELECT * FROM f7 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURE_COLS)})"""

_GROUPS = {
    "f01_returns": ["ret_1d", "ret_5d", "ret_10d", "ret_21d"],
    "f05_vol_20d": ["vol_20d"],
    "f06_benchmark_relative": ["ret_1d_vs_spy", "ret_5d_vs_spy"],
    "f08_ma_spreads": ["ma_spread_10_20", "ma_spread_20_50"],
    "f10_macd": ["macd", "macd_signal"],
    "f12_rsi": ["rsi_14"],
    "f13_price_vs_sma": ["price_vs_sma20", "price_vs_sma50"],
    "f15_bollinger": ["bb_width", "bb_position"],
    "f17_stochastic": ["stoch_k", "stoch_d"],
    "f19_roc": ["roc_12"],
    "f20_atr": ["atr_normalized"],
    "f21_adx": ["adx_14"],
    "f22_vol_regime": ["vol_regime"],
    "f23_volume_shape": ["rel_volume", "hl_ratio"],
    "f25_liquidity": ["turnover_z", "amihud_illiq"],
    "f27_gap": ["gap"],
    "f28_cumulative_flow": ["vpt_normalized", "ad_normalized", "obv_normalized"],
    "f31_forward_label": ["fwd_ret_1d"],
}


def _feature_query(cols):
    return lambda spark, sf: out(features(spark, sf), ["symbol", "ts"], cols, 5)


for _name, _cols in _GROUPS.items():
    query(_name, f"WITH {SQL_FEATURES} SELECT symbol, ts, {cols_sql(_cols, 5)} FROM feats")(_feature_query(_cols))


@query("f32_feature_contract", f"""WITH {SQL_FEATURES} SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts,
  {', '.join(r_sql(f'avg({c})', c, 5) for c in FEATURE_COLS)} FROM feats GROUP BY symbol""")
def feature_contract(spark, sf):
    """All 30 contract columns after warm-up, averaged per symbol."""
    g = features(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), *[F.avg(c).alias(c) for c in FEATURE_COLS])
    return out(g, ["symbol", "n_rows", "first_ts"], FEATURE_COLS, 5)


@query("f34_sequences", f"""WITH {SQL_BARS}, s AS (SELECT symbol, ts, list([close, volume]) OVER w AS seq FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT symbol, ts, len(seq) AS n, {r_sql('seq[1][1]', 'oldest_close', 9)}, {r_sql('seq[10][2]', 'newest_volume', 9)},
  {r_sql('list_sum(list_transform(seq, lambda v: v[1]))', 'sum_close', 5)} FROM s WHERE len(seq) = 10""")
def lookback_sequences(spark, sf):
    s = feats.sequences(bars(spark, sf), ["close", "volume"], 10)
    s = s.selectExpr("symbol", "ts", "CAST(size(seq) AS BIGINT) AS n", "seq[0][0] AS oldest_close", "seq[9][1] AS newest_volume",
                     "aggregate(seq, 0D, (a, v) -> a + v[0]) AS sum_close")
    s = s.withColumns({c: F.round(c, 9) for c in ("oldest_close", "newest_volume")})
    return out(s, ["symbol", "ts", "n", "oldest_close", "newest_volume"], ["sum_close"], 5)


@query("f35_flat_state", f"""WITH {SQL_BARS}, s AS (SELECT symbol, list(volume ORDER BY ts) AS v FROM bars GROUP BY symbol),
  t AS (SELECT symbol, v[greatest(len(v) - 399, 1):] AS v FROM s)
  SELECT symbol, CAST(400 AS BIGINT) AS n, list_sum(v) AS total, CAST(400 - len(v) AS BIGINT) AS padding FROM t""")
def flat_state(spark, sf):
    """Window state of the last 400 bars per symbol, zero-padded at the tail."""
    b = bars(spark, sf)
    last = b.groupBy("symbol").agg(F.max("bar_no").alias("_last"))
    recent = b.join(last, "symbol").where("bar_no > _last - 400").groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("bar_no", "volume"))).alias("s"))
    flat = feats.flat_state(F.transform("s", lambda x: F.array(x["volume"])), 400, 1)
    return recent.select("symbol", flat.alias("v"), F.size("s").alias("_k")).selectExpr(
        "symbol", "CAST(size(v) AS BIGINT) AS n", "aggregate(v, 0D, (a, x) -> a + x) AS total",
        "CAST(400 - _k AS BIGINT) AS padding")


# ---- rolling and recursive primitives ------------------------------------------

@query("t01_lag_diff", f"""WITH {SQL_BARS} SELECT symbol, ts, {r_sql('lag(close) OVER w', 'prev_close', 9)},
  {r_sql('close - lag(close) OVER w', 'diff', 9)}, {r_sql('close / lag(close) OVER w - 1', 'pct_change')} FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def lag_diff(spark, sf):
    w = chunk_window()
    d = own_rows(chunked(bars(spark, sf), halo=1).withColumns({
        "prev_close": F.lag("close").over(w), "diff": F.col("close") - F.lag("close").over(w),
        "pct_change": F.try_divide("close", F.lag("close").over(w)) - 1}))
    return d.selectExpr("symbol", "ts", "round(prev_close, 9) AS prev_close",
                        "IF(round(diff, 9) = 0, 0D, round(diff, 9)) AS diff",
                        "IF(round(pct_change, 6) = 0, 0D, round(pct_change, 6)) AS pct_change")


@query("t02_lead", f"""WITH {SQL_BARS} SELECT symbol, ts,
  {', '.join(r_sql(f'lead(close, {h}) OVER w / close - 1', f'fwd_{h}') for h in (1, 2, 3, 5, 10))} FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def lead(spark, sf):
    from panelforge.operators.metrics import forward_returns
    return out(forward_returns(bars(spark, sf)), ["symbol", "ts"], [f"fwd_{h}" for h in (1, 2, 3, 5, 10)])


_STATS = {"m": "avg", "sd": "stddev_samp", "lo": "min", "hi": "max"}


@query("t03_rolling_stats", f"""WITH {SQL_BARS} SELECT symbol, ts,
  {', '.join(r_sql(f"CASE WHEN count(close) OVER f >= 10 THEN {a}(close) OVER f END", n, 9 if n in ("lo", "hi") else 5) for n, a in _STATS.items())}
  FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark, sf):
    d = block_roll(chunked(bars(spark, sf), halo=62), 63, {
        "m": ("mean", "close", 10), "sd": ("std", "close", 10), "lo": ("min", "close", 10), "hi": ("max", "close", 10)})
    d = own_rows(d).withColumns({c: F.round(c, 9) for c in ("lo", "hi")})
    return out(d, ["symbol", "ts", "lo", "hi"], ["m", "sd"], 5)


@query("t03_short_frames", f"""WITH {SQL_BARS} SELECT symbol, ts,
  {', '.join(r_sql(_full(a, 'volume', 5), n, 4) for n, a in _STATS.items())} FROM bars""")
def short_frames(spark, sf):
    w, v = chunk_window(), F.col("volume")
    d = own_rows(chunked(bars(spark, sf), halo=4).withColumns({
        "m": roll_mean(v, w, 5), "sd": roll_std(v, w, 5), "lo": roll_min(v, w, 5), "hi": roll_max(v, w, 5)}))
    return out(d, ["symbol", "ts"], list(_STATS), 4)


@query("t04_rolling_quantile", f"""WITH {SQL_PANEL} SELECT symbol, ts, {r_sql('''CASE WHEN count(abs(pred)) OVER f >= 20
  THEN quantile_cont(abs(pred), 0.7) OVER f END''', 'thr')} FROM panel1
  WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def rolling_quantile(spark, sf):
    p = number_rows(panel(spark, sf).drop("bar_no"))
    d = chunked(p, halo=60).withColumn("thr", roll_quantile(F.abs("pred"), 0.7, chunk_window(), 60, 20))
    return out(own_rows(d), ["symbol", "ts"], ["thr"])


@query("t05_rolling_beta", f"WITH {SQL_PANEL} SELECT symbol, ts, {r_sql('beta')} FROM panel1")
def rolling_beta(spark, sf):
    return out(panel(spark, sf), ["symbol", "ts"], ["beta"])


@query("t06_cumulative", f"""WITH {SQL_PANEL} SELECT symbol, ts,
  {r_sql('CASE WHEN ret IS NOT NULL THEN sum(ret) OVER u END', 'cum_ret')},
  {r_sql('CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER u END', 'growth')},
  {r_sql('max(close) OVER u', 'peak', 9)}, {r_sql('(close - max(close) OVER u) / (max(close) OVER u + 1e-12)', 'drawdown')}
  FROM panel1 WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def cumulative(spark, sf):
    """Running sum, product and maximum with drawdown."""
    p = number_rows(panel(spark, sf).drop("bar_no")).withColumn("g", 1 + F.col("ret"))
    r = running(p, {"cum_ret": ("sum", "ret"), "growth": ("product", "g"), "peak": ("max", "close")})
    r = r.withColumn("drawdown", (F.col("close") - F.col("peak")) / (F.col("peak") + 1e-12))
    return r.selectExpr("symbol", "ts", *[
        f"IF(round({c}, {d}) = 0, 0D, round({c}, {d})) AS {c}"
        for c, d in (("cum_ret", 6), ("growth", 6), ("peak", 9), ("drawdown", 6))])


@query("t09_exponential_means", f"""WITH {SQL_BARS} SELECT symbol, ts, {r_sql(_ema('close', '(2.0::DOUBLE/13)'), 'ema12', 3)},
  {r_sql(_ema('close', '(2.0::DOUBLE/27)'), 'ema26', 3)}, {r_sql(_ema('volume', '(1.0::DOUBLE/14)'), 'wilder14', 3)}
  FROM bars WINDOW u AS (PARTITION BY symbol ORDER BY ts)""")
def exponential_means(spark, sf):
    d = with_blocks(chunked(bars(spark, sf), halo=600))
    d = ewm_means(d, {"ema12": ("close", span_alpha(12)), "ema26": ("close", span_alpha(26)), "wilder14": ("volume", 1 / 14)})
    return out(own_rows(d), ["symbol", "ts"], ["ema12", "ema26", "wilder14"], 3)


@query("t10_trailing_percentile", f"""WITH {SQL_PANEL}, s AS (SELECT symbol, ts, abs(pred) AS a, list(abs(pred)) OVER (
  PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS w FROM panel1)
  SELECT symbol, ts, {r_sql('''CASE WHEN len(w) < 2 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda v: v <= a))::DOUBLE / len(w) END''', 'confidence')} FROM s""")
def trailing_percentile(spark, sf):
    p = number_rows(panel(spark, sf).drop("bar_no"))
    return out(regressor_confidence(p), ["symbol", "ts"], ["confidence"])


@query("t11_atr_barrier", f"""WITH {SQL_BARS}, t AS (SELECT *, lag(close) OVER w AS pc,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)), a AS (SELECT *, {_full('avg', 'tr', 14)} AS atr FROM t)
  SELECT symbol, ts, {r_sql('''CASE WHEN lag(atr) OVER w / pc IS NOT NULL THEN
    greatest(least(lag(atr) OVER w / pc, 0.10), 0.005) END''', 'atr_pct')} FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def atr_barrier(spark, sf):
    return out(atr_pct(bars(spark, sf)), ["symbol", "ts"], ["atr_pct"])


@query("t12_vol_scale", f"""WITH {SQL_BARS}, t AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars),
  a AS (SELECT *, {_full('stddev_samp', 'r', 20)} AS sd FROM t)
  SELECT symbol, ts, {r_sql('''CASE WHEN lag(sd) OVER w IS NOT NULL THEN
    greatest(least(2.0::DOUBLE / (lag(sd) OVER w * sqrt(252)), 3.0), 0.25) END''', 'vol_scale')} FROM a
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def vol_scaling(spark, sf):
    return out(vol_scale(bars(spark, sf), 2.0), ["symbol", "ts"], ["vol_scale"])


@query("t13_daily_last", f"""SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS day,
  {r_sql('arg_max(value, ts)', 'value')} FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def last_of_day(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("symbol"), "ts", "value")
    return out(daily_last(e, "value", ["symbol"]), ["symbol", "day"], ["value"])


@query("t14_names_per_date", f"""WITH {SQL_BARS} SELECT symbol, ts, count(*) OVER (PARTITION BY ts) AS n_names FROM bars""")
def names_per_date(spark, sf):
    b = bars(spark, sf)
    return b.join(b.groupBy("ts").agg(F.count(F.lit(1)).alias("n_names")), "ts").select("symbol", "ts", "n_names")


@query("t15_holding_period", f"""WITH RECURSIVE {SQL_PANEL}, s AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i,
  CASE WHEN pred > 0.2 THEN 1 WHEN pred < -0.2 THEN -1 ELSE 0 END AS sig FROM panel1),
  h AS (SELECT symbol, i, ts, sig::DOUBLE AS position, CASE WHEN sig <> 0 THEN 0 ELSE 99 END AS age FROM s WHERE i = 1
  UNION ALL SELECT s.symbol, s.i, s.ts,
    CASE WHEN sign(s.sig) <> sign(h.position) AND (h.position = 0 OR h.age + 1 >= 5) THEN s.sig::DOUBLE ELSE h.position END,
    CASE WHEN sign(s.sig) <> sign(h.position) AND (h.position = 0 OR h.age + 1 >= 5) AND s.sig <> 0 THEN 0 ELSE h.age + 1 END
  FROM h JOIN s ON s.symbol = h.symbol AND s.i = h.i + 1)
  SELECT symbol, ts, position FROM h""")
def holding_period(spark, sf):
    p = number_rows(panel(spark, sf).drop("bar_no")).withColumn(
        "sig", F.when(F.col("pred") > 0.2, 1.0).when(F.col("pred") < -0.2, -1.0).otherwise(0.0))
    return holding_filter(p, "sig", 5).select("symbol", "ts", "position")


@query("t16_execution_lag", f"""WITH {SQL_PANEL} SELECT symbol, ts, coalesce(lag(sign(pred)) OVER
  (PARTITION BY symbol ORDER BY ts), 0)::DOUBLE AS position FROM panel1""")
def one_bar_lag(spark, sf):
    p = number_rows(panel(spark, sf).drop("bar_no")).withColumn("s", F.signum("pred"))
    return execution_lag(p, "s").selectExpr("symbol", "ts", "IF(position = 0, 0D, position) AS position")


@query("m02_class_labels", f"""WITH {SQL_FEATURES} SELECT symbol, ts, CASE WHEN fwd_ret_1d > raw_vol * sqrt(3) * 0.5::DOUBLE THEN 2
  WHEN fwd_ret_1d < -(raw_vol * sqrt(3) * 0.5::DOUBLE) THEN 0 ELSE 1 END AS label FROM feats WHERE fwd_ret_1d IS NOT NULL""")
def class_labels(spark, sf):
    return feats.class_labels(features(spark, sf)).select("symbol", "ts", "label")


@query("o05_feature_redundancy", f"""WITH {SQL_FEATURES}, c AS (SELECT
  {', '.join(f"corr({a}, {b}) AS {a}__{b}" for i, a in enumerate(FEATURE_COLS) for b in FEATURE_COLS[i + 1:])} FROM feats),
  u AS (UNPIVOT c ON COLUMNS(*) INTO NAME pair VALUE corr)
  SELECT split_part(pair, '__', 1) AS a, split_part(pair, '__', 2) AS b, {r_sql('corr', digits=5)} FROM u""")
def feature_redundancy(spark, sf):
    return out(feats.feature_correlations(features(spark, sf)), ["a", "b"], ["corr"], 5)
