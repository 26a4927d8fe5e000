"""The 30-column feature contract, labels, sequences and the cross-sectional panel."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from panelforge.functions.scalars import discretize
from panelforge.operators.ewm import memory_rows, span_alpha
from panelforge.operators.feature_arrays import WILDER, feature_batches
from panelforge.operators.rolling import block_roll
from panelforge.operators.timeaxis import (
    CHUNK_ROWS, CURRENT, chunk_window, chunked, dealt, lagged_return, number_rows, own_rows, trailing,
)
from panelforge.schema import BAR_VALUE_COLS, FEATURE_COLS, HORIZON, LABEL, ZSCORE_WINDOW

# Longest look-back of any feature: two chained Wilder means, or two chained
# exponential means under the z-score window.
HALO = max(
    2 * memory_rows(WILDER) + 2,
    memory_rows(span_alpha(26)) + memory_rows(span_alpha(9)) + ZSCORE_WINDOW,
)
BETA_WINDOW, BETA_MIN_PERIODS = 126, 60


def benchmark_returns(benchmark: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """(ts, bench_ret_1d, bench_ret_5d) of one benchmark series (ts, close)."""
    w = chunk_window(())
    numbered = number_rows(benchmark.select("ts", "close"), keys=())
    c = F.col("close")
    return trailing(numbered, {"bench_ret_1d": lagged_return(c, w, 1), "bench_ret_5d": lagged_return(c, w, 5)},
                    halo=5, size=size).select("ts", "bench_ret_1d", "bench_ret_5d")


def equal_weight_benchmark(bars: DataFrame) -> DataFrame:
    """Mean close over the symbols present on each date."""
    return bars.groupBy("ts").agg(F.avg("close").alias("close"))


def daily_features(bars: DataFrame, benchmark: DataFrame | None = None, benchmark_symbol: str | None = None,
                   size: int = CHUNK_ROWS, drop_warmup: bool = True) -> DataFrame:
    """Causal features of every symbol: one exchange by (symbol, chunk), one sort, then numpy over whole chunks.

    bars: symbol, ts, bar_no, open, high, low, close, volume (gap-filled).
    benchmark: ts, close; without it (and for the benchmark itself) the relative
    returns are 0.  Adds `raw_vol` and `raw_ret`, which the z-scores replace, and
    the forward-return label.  Prices and volumes that are not finite count as missing.
    """
    base = bars.select("symbol", "ts", "bar_no", *[F.col(c).cast("double").alias(c) for c in BAR_VALUE_COLS])
    if benchmark is None:
        base = base.withColumns({"_b1": F.lit(0.0), "_b5": F.lit(0.0), "_rel": F.lit(False)})
    else:
        b = benchmark_returns(benchmark, size).withColumnsRenamed({"bench_ret_1d": "_b1", "bench_ret_5d": "_b5"})
        base = base.join(F.broadcast(b), "ts", "left").withColumn(  # one row per date
            "_rel", F.lit(True) if benchmark_symbol is None else F.col("symbol") != benchmark_symbol)
    df = dealt(chunked(base, halo=HALO, ahead=HORIZON, size=size), bars.count()).drop("_pos")
    kinds = df.schema
    schema = StructType([kinds["symbol"], kinds["ts"], kinds["bar_no"], kinds["close"],
                         *[StructField(c, DoubleType()) for c in (*FEATURE_COLS, "raw_vol", "raw_ret", LABEL)]])
    names = to_arrow_schema(schema)
    return df.sortWithinPartitions("symbol", "_chunk", "bar_no").mapInArrow(lambda parts: feature_batches(parts, names, drop_warmup), schema)


def class_labels(features: DataFrame, vol_mult: float = 0.5) -> DataFrame:
    """3-class label with a volatility-scaled band around zero (raw 20-bar volatility)."""
    band = F.col("raw_vol") * F.lit(math.sqrt(HORIZON)) * F.lit(float(vol_mult))
    return features.where(F.col(LABEL).isNotNull()).withColumn("label", discretize(LABEL, band, -band))


def panel_returns(features: DataFrame, benchmark: DataFrame | None = None, size: int = CHUNK_ROWS) -> DataFrame:
    """Add the next-bar return `ret` and trailing `beta` over the rows that survived warm-up."""
    rows = features.count()
    df = number_rows(features.drop("bar_no"))
    if benchmark is None:
        df = df.withColumn("bench_ret_1d", F.lit(None).cast("double"))
    else:
        df = df.join(F.broadcast(benchmark_returns(benchmark, size).select("ts", "bench_ret_1d")), "ts", "left")  # one row per date
    w = chunk_window()
    cl = F.col("close")
    df = dealt(chunked(df, halo=BETA_WINDOW + 1, ahead=1, size=size), rows).withColumns({
        "_r": lagged_return(cl, w, 1), "ret": F.try_divide(F.lead(cl).over(w), cl) - 1})
    return own_rows(rolling_beta(df, "_r", "bench_ret_1d", "beta")).drop("_r", "bench_ret_1d")


def rolling_beta(df: DataFrame, y: str, x: str, out: str, window: int = BETA_WINDOW,
                 min_periods: int = BETA_MIN_PERIODS) -> DataFrame:
    """Trailing slope of y on x; the covariance uses complete pairs, the variance every x."""
    df = block_roll(df, window, {"_cov": ("cov", (y, x), min_periods), "_var": ("var", x, min_periods)})
    return df.withColumn(out, F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var"))).drop("_cov", "_var")


def sequences(df: DataFrame, cols: list[str], lookback: int, size: int = CHUNK_ROWS) -> DataFrame:
    """(symbol, ts, seq): the last `lookback` rows of `cols`, oldest first, never crossing symbols."""
    w = chunk_window().rowsBetween(-(lookback - 1), CURRENT)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w)
    out = trailing(df, {"seq": rows}, halo=lookback - 1, size=size)
    return out.where(F.size("seq") == lookback)


def flat_state(seq: str | Column, lookback: int, width: int) -> Column:
    """Row-major flattening of up to `lookback` rows, zero-padded at the tail."""
    s = F.col(seq) if isinstance(seq, str) else seq
    flat = F.flatten(F.slice(s, F.greatest(F.size(s) - lookback + 1, F.lit(1)), F.lit(lookback)))
    return F.concat(flat, F.array_repeat(F.lit(0.0), F.lit(lookback * width) - F.size(flat)))


def redundant_pairs(features: DataFrame, cols: list[str] = FEATURE_COLS, limit: float = 0.98) -> DataFrame:
    """Feature pairs whose absolute correlation exceeds `limit`; one aggregate over the table."""
    return feature_correlations(features, cols).where(F.abs("corr") > limit)


def feature_correlations(features: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """(a, b, corr) for every pair of columns.

    The moments are summed by the executors; what returns is one small matrix of
    fixed size.
    """
    vectors = VectorAssembler(inputCols=cols, outputCol="_v").transform(features.na.drop(subset=cols)).select("_v")
    m = Correlation.corr(vectors, "_v").head()[0].toArray()
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if j > i]
    return features.sparkSession.createDataFrame(rows, "a string, b string, corr double")
