"""Registry of runnable queries and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge import session
from panelforge.operators import features as feats
from panelforge.operators.timeaxis import chunk_window, chunked, dealt, lagged_return, number_rows, own_rows
from panelforge.sources.bars import ticks_to_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            session.apply_runtime_conf(spark)
            return fn(spark, sf)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# ---- shared inputs, staged as written tables ---------------------------------

_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build an input once per application and read it back from the shared folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        path = session.new_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def forget_stages() -> None:
    _STAGED.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


TICK_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as trades of a supplier's stock."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        *TICK_ORDER, "l_returnflag", "l_discount", "l_tax")


def raw_bars(spark: SparkSession, sf: str, unit: str = "week") -> DataFrame:
    return ticks_to_bars(ticks(spark, sf), unit, TICK_ORDER)


def bars(spark: SparkSession, sf: str, unit: str = "week") -> DataFrame:
    return staged(spark, sf, f"bars_{unit}", lambda: number_rows(raw_bars(spark, sf, unit)))


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return feats.equal_weight_benchmark(bars(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "features",
                  lambda: feats.daily_features(bars(spark, sf), benchmark(spark, sf)))


def reversal_panel(bars_df: DataFrame, bench: DataFrame | None) -> DataFrame:
    """ts, symbol, bar_no, close, pred (five-bar reversal), ret (next bar) and trailing beta."""
    w = chunk_window()
    c = F.col("close")
    df = bars_df.select("symbol", "ts", "bar_no", "close")
    if bench is not None:
        df = df.join(F.broadcast(feats.benchmark_returns(bench).select("ts", "bench_ret_1d")), "ts", "left")  # one row per date
    df = dealt(chunked(df, halo=feats.BETA_WINDOW + 1, ahead=1), bars_df.count()).withColumns({
        "_r": lagged_return(c, w, 1), "pred": -lagged_return(c, w, 5),
        "ret": F.try_divide(F.lead(c).over(w), c) - 1})
    if bench is not None:
        df = feats.rolling_beta(df, "_r", "bench_ret_1d", "beta").drop("bench_ret_1d")
    return own_rows(df).withColumnRenamed("_r", "ret_1d").where("pred is not null")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "panel", lambda: reversal_panel(bars(spark, sf), benchmark(spark, sf)))


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    """symbol -> sector: a supplier's nation."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("symbol"), F.col("n_name").alias("sector"))


def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a prediction log: one record per event."""
    e = table(spark, sf, "events")
    v = F.col("value")
    return e.select(
        F.to_date("ts").alias("date"), F.to_date("ts").alias("bar_date"), F.col("user_id").cast("string").alias("symbol"),
        F.col("event_type").alias("model"),
        F.when(v > 30, "BUY").when(v < 10, "SELL").otherwise("HOLD").alias("signal"),
        (v / 100.0).alias("confidence"), (v + 1.0).alias("price"), F.col("event_id"), F.col("ts"))


# ---- the same inputs as SQL text ----------------------------------------------

SQL_TICKS = """ticks AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts,
  l_extendedprice / l_quantity AS price, l_quantity AS volume, * FROM lineitem)"""
SQL_BARS0 = SQL_TICKS + """, bars0 AS (SELECT symbol, CAST(date_trunc('week', ts) AS DATE) AS ts,
  first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
  max(price) AS high, min(price) AS low,
  last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
  sum(volume) AS volume FROM ticks GROUP BY ALL)"""
SQL_BARS = SQL_BARS0 + """, bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM bars0)"""
SQL_BENCH = """bench0 AS (SELECT ts, avg(close) AS close FROM bars GROUP BY ts),
bench AS (SELECT ts, close, close / lag(close) OVER (ORDER BY ts) - 1 AS b1,
  close / lag(close, 5) OVER (ORDER BY ts) - 1 AS b5 FROM bench0)"""
SQL_PANEL = SQL_BARS + ", " + SQL_BENCH + """, rets AS (SELECT b.*, close0 / lag(close0) OVER w - 1 AS ret_1d,
  -(close0 / lag(close0, 5) OVER w - 1) AS pred, lead(close0) OVER w / close0 - 1 AS ret, b1
  FROM (SELECT x.symbol, x.ts, x.bar_no, x.close AS close0, x.close, k.b1 FROM bars x LEFT JOIN bench k USING (ts)) b
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
panel AS (SELECT symbol, ts, bar_no, close, pred, ret, ret_1d,
  CASE WHEN count(CASE WHEN ret_1d IS NOT NULL AND b1 IS NOT NULL THEN 1 END) OVER f >= 60 AND count(b1) OVER f >= 60
       AND var_samp(b1) OVER f > 0
  THEN covar_samp(b1, ret_1d) OVER f / var_samp(b1) OVER f END AS beta FROM rets
  WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)),
panel1 AS (SELECT * FROM panel WHERE pred IS NOT NULL)"""
SQL_LOG = """log AS (SELECT CAST(ts AS DATE) AS date, CAST(ts AS DATE) AS bar_date, CAST(user_id AS VARCHAR) AS symbol,
  event_type AS model, CASE WHEN value > 30 THEN 'BUY' WHEN value < 10 THEN 'SELL' ELSE 'HOLD' END AS signal,
  value / 100.0::DOUBLE AS confidence, value + 1.0::DOUBLE AS price, event_id, ts FROM events)"""
SQL_SCORE = "CASE signal WHEN 'BUY' THEN confidence WHEN 'SELL' THEN -confidence ELSE 0.0::DOUBLE END"


def r_sql(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded output column with negative zero folded, as SQL."""
    r = f"round({expr}, {digits})"
    return f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END AS {name or expr}"


def cols_sql(names: list[str], digits: int = 6) -> str:
    return ", ".join(r_sql(n, digits=digits) for n in names)


def out(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Keys as they are, values rounded for comparison."""
    return df.selectExpr(*keys, *[
        f"IF(round({v}, {digits}) = 0, 0D, round({v}, {digits})) AS {v}" for v in values])
