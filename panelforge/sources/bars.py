"""Readers that produce long bar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelforge import schema
from panelforge.functions.scalars import all_of, is_intraday, us_session
from panelforge.operators import quality

CAPITALISED = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}

# Fixed field names of the landed daily payload.
PAYLOAD_SERIES = "Time Series (Daily)"
PAYLOAD_FIELDS = {"1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. volume": "volume"}


def ticks_to_bars(ticks: DataFrame, unit: str, tick_order: Sequence[str], symbol: str | Column = "symbol",
                  time: str = "ts", price: str | Column = "price", volume: str | Column = "volume") -> DataFrame:
    """OHLCV bars per calendar unit; partial aggregates combine before the shuffle."""
    order = F.struct(*tick_order)
    p = F.col(price) if isinstance(price, str) else price
    v = F.col(volume) if isinstance(volume, str) else volume
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    return ticks.groupBy(s.alias("symbol"), F.to_date(F.date_trunc(unit, time)).alias("ts")).agg(
        F.min_by(p, order).alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        F.max_by(p, order).alias("close"),
        F.sum(v).alias("volume"),
    )


def lower_case_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in CAPITALISED.items() if k in df.columns})


def read_csv_bars(spark: SparkSession, path: str, symbol: str | Column | None = None,
                  interval: str = "1d", many: bool = False) -> DataFrame:
    """CSV bars with header timestamp,open,high,low,close,volume; naive times are UTC.

    Intraday intervals keep the regular session only.  The symbol is the file
    stem unless given.  many: files hold many symbols, in a first column `symbol`, so
    that there are as many files as the bytes ask for, not one for each symbol.
    """
    fields = schema.CSV_BARS if not many else StructType([StructField("symbol", StringType()), *schema.CSV_BARS.fields])
    raw = spark.read.schema(fields).option("header", True).csv(path)
    stem = F.col("symbol") if many else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1)
    sym = stem if symbol is None else (F.lit(symbol) if isinstance(symbol, str) else symbol)
    df = raw.select(sym.alias("symbol"), F.to_timestamp("timestamp").alias("ts"), F.lit(interval).alias("interval"),
                    *schema.BAR_VALUE_COLS)
    return df.where(us_session("ts")) if is_intraday(interval) else df


def read_payload_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                      symbol: Column | None = None) -> DataFrame:
    """Landed daily payload files ({series: {date: {field: text}}}), one symbol per file, by default its name."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    text = spark.read.text(path, wholetext=True).withColumn("symbol", stem if symbol is None else symbol)
    return parse_payload(text, "value", start, end)


def read_payload_lines(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Landed payloads of many symbols in one file: a JSON line {symbol, body} for each document, which is `body`, unchanged."""
    return parse_payload(spark.read.schema("symbol string, body string").json(path), "body", start, end)


def parse_payload(df: DataFrame, body: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Explode payload documents in column `body` into bar rows; `symbol` is kept."""
    doc = F.from_json(body, "map<string,map<string,map<string,string>>>")
    days = df.select("symbol", F.explode(F.try_element_at(doc, F.lit(PAYLOAD_SERIES))).alias("day", "v"))
    ts = F.try_to_date(F.col("day"), "yyyy-MM-dd")
    out = days.select("symbol", ts.alias("ts"),
                      *[F.col("v")[k].try_cast("double").alias(c) for k, c in PAYLOAD_FIELDS.items()])
    return out.where(all_of([
        F.col("ts").isNotNull(),
        None if start is None else F.col("ts") >= F.lit(start).cast("date"),
        None if end is None else F.col("ts") <= F.lit(end).cast("date"),
    ]))


def read_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, interval: str | None = None,
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Range scan of the stored bars; every predicate reaches the scan."""
    return scan_range(spark.read.parquet(path), symbols, interval, start, end)


def scan_range(bars: DataFrame, symbols: Sequence[str] | None = None, interval: str | None = None,
               start: str | None = None, end: str | None = None) -> DataFrame:
    kind = bars.schema["ts"].dataType
    return bars.where(all_of([
        None if symbols is None else F.col("symbol").isin(*symbols),
        None if interval is None else F.col("interval") == interval,
        None if start is None else F.col("ts") >= F.lit(start).cast(kind),
        None if end is None else F.col("ts") <= F.lit(end).cast(kind),
    ]))


def save_clustered(bars: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Store bars as a catalog table that is bucketed by symbol, sorted by (symbol, ts), with a Bloom filter on symbol.

    Joins and groupings by symbol read the buckets as they lie, without an exchange.  A scan of one symbol opens one bucket, and
    skips row groups by the range of symbols they hold or by the filter.  Each bucket is one file, or several if its rows
    are many: a hot symbol doesn't end up in one task.
    """
    bucket = F.pmod(F.hash("symbol"), F.lit(buckets))  # as the writer computes it
    dealt = bars.withColumn("_b", bucket).hint("rebalance", F.col("_b")).sortWithinPartitions("_b", "symbol", "ts").drop("_b")
    writer = (dealt.write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "ts")
              .option("parquet.bloom.filter.enabled#symbol", "true").option("parquet.bloom.filter.adaptive.enabled", "true"))
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return bars.sparkSession.table(table)


def merge_chunks(*parts: DataFrame) -> DataFrame:
    """Concatenate fetched chunks; where they overlap the earliest chunk wins."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    return quality.keep_one(union, ["symbol", "ts"], "_part", latest=False).drop("_part")
