"""Structured Streaming jobs over ticks, prediction records and prices.

State lives in the state store of the query, so a query that stops goes on from its checkpoint with the same state.  Rows
are reduced inside tasks before they are shuffled to their key, so a hot symbol sends a few rows per task.  Sinks write
one folder for each query and batch, and a batch that runs again replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelforge.operators.quality import keep_one
from panelforge.session import new_path
from panelforge.sources.tables import upsert

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of one table's parquet files in a folder, in the order of their age."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        # A folder of files, taken a few at a time.
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parquet")
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """Process what is available and return the appended output.  A call with the path of an earlier one goes on from there."""
    path = path or new_path(spark, name)
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, spark: SparkSession, name: str, apply: Callable[[DataFrame, int], None], path: str | None = None,
                mode: str = "append") -> None:
    """Hand what is available to `apply`, batch by batch.  A call with the path of an earlier one goes on from there."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", f"{path or new_path(spark, name)}-state")
         .trigger(availableNow=True).start())
    q.awaitTermination()


class BatchFolders:
    """A sink and its table: one folder for each query and batch, which a replayed batch overwrites.

    Several queries may share a path under different names; nothing is ever appended to a folder.
    """

    def __init__(self, spark: SparkSession, path: str, query: str, ddl: str):
        self.spark, self.path, self.query, self.ddl = spark, path.rstrip("/"), query, ddl

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/query={self.query}/batch={batch}")

    def read(self) -> DataFrame:
        """All rows, with `query` and `batch`; empty before the first batch."""
        return self.spark.read.schema(f"{self.ddl}, query string, batch bigint").option("basePath", self.path).parquet(self.path) if self._there() else (
            self.spark.createDataFrame([], f"{self.ddl}, query string, batch bigint"))

    def _there(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)


class KeyedLog(BatchFolders):
    """An append-only log with one record for each key, whatever batches bring.

    Of a batch's records of one key the first by `order` stays.  A key that another batch or query has logged is left out,
    however late it comes: a record that no watermark would let through is logged if, and only if, its key is new.
    """

    def __init__(self, spark: SparkSession, path: str, query: str, ddl: str, keys: Sequence[str], order: str):
        super().__init__(spark, path, query, ddl)
        self.keys, self.order = list(keys), order

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rest = [c for c in rows.columns if c not in self.keys]
        first = rows.groupBy(*self.keys).agg(F.min(F.struct(self.order, *[c for c in rest if c != self.order])).alias("_r")).select(*self.keys, "_r.*")
        logged = self.read().where((F.col("query") != self.query) | (F.col("batch") != batch)).select(*self.keys).distinct()
        same = [first[k].eqNullSafe(logged[k]) for k in self.keys]
        super().__call__(first.join(logged, same, "left_anti").select(*rows.columns), batch)


def tick_bars(ticks: DataFrame, width: str, delay: str, tie: Sequence[str] = ()) -> DataFrame:
    """Tumbling OHLCV bars (symbol, ts, price, volume), emitted once the watermark passes them."""
    order = F.struct("ts", *tie)
    bars = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_ticks"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_ticks")


def first_records(log: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """One record per key within the watermark: a bar already predicted is not logged twice."""
    return log.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def _keyed(stream: DataFrame, name: str, processor: StatefulProcessor, ddl: str, time_mode: str, initial=None) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream.groupBy(name).transformWithStateInPandas(processor, ddl, "Update", time_mode, initial)


# ---- silence ---------------------------------------------------------------------------

ALARMS = "symbol string, from_ts timestamp, to_ts timestamp"


def _slots(seconds: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """First and last tick of every symbol and slot: a silence longer than a slot lies between two of them."""
    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.dropna()
            slot = f["ts"].astype("datetime64[us]").astype("int64") // int(seconds * 1_000_000)
            yield f.groupby([f["symbol"], slot.rename("slot")])["ts"].agg(["min", "max"]).reset_index().rename(
                columns={"min": "lo", "max": "ts"})[["symbol", "lo", "ts"]]
    return reduce


class SilenceWatch(StatefulProcessor):
    """Per symbol: the last tick, and a timer at which its silence becomes an alarm.

    A tick after a silence longer than the limit gives (from_ts, to_ts).  If event time passes the limit with no tick, the
    timer gives (from_ts, NULL): so silence alone raises an alarm, also that of a symbol that never comes back.  Ticks at or
    before the last one are late: they raise and change nothing.
    """

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ts timestamp")

    def _due(self, ts: pd.Timestamp) -> int:
        # The first millisecond after the limit.
        return int(ts.value // 1_000_000 + self.seconds * 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = pd.concat(list(rows)).sort_values(["lo", "ts"])  # one row for each task and slot
        before = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        last, found = before, []
        for lo, hi in zip(spans["lo"], spans["ts"]):
            if last is not None and (lo - last).total_seconds() > self.seconds:
                found.append((key[0], last, lo))
            last = hi if last is None else max(last, hi)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.last.update((last.to_pydatetime(),))
            self.handle.registerTimer(self._due(last))
        yield pd.DataFrame(found, columns=["symbol", "from_ts", "to_ts"]).astype({"from_ts": "datetime64[us]", "to_ts": "datetime64[us]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self.last.get()[0])
        if self._due(last) == expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame({"symbol": [key[0]], "from_ts": pd.Series([last], dtype="datetime64[us]"), "to_ts": pd.Series([pd.NaT], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def silence_alarms(ticks: DataFrame, limit_seconds: float, delay: str) -> DataFrame:
    """Alarms (symbol, from_ts, to_ts) of a tick stream (symbol, ts); to_ts is NULL while the silence lasts.

    delay: how far event time stays behind the latest tick of all symbols.  Ticks that come later than that are dropped.
    """
    spans = ticks.select("symbol", F.col("ts").cast("timestamp").alias("ts")).mapInPandas(_slots(limit_seconds), "symbol string, lo timestamp, ts timestamp")
    return _keyed(spans.withWatermark("ts", delay), "symbol", SilenceWatch(limit_seconds), ALARMS, "EventTime")


def settled_alarms(alarms: DataFrame) -> DataFrame:
    """One row for each silence: the open alarm goes once the tick that ended it is known."""
    return alarms.groupBy("symbol", "from_ts").agg(F.min("to_ts").alias("to_ts"))


def restate_bars(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """Batch sink for late restatements: the latest arrival of a bar replaces it."""
    def apply(batch: DataFrame, _: int) -> None:
        upsert(spark, path, "bar_data", batch, recency="fetched_at")
    return apply


# ---- a held book -------------------------------------------------------------------------

BOOK = "symbol string, ts timestamp, weight double, price double"


def _latest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's rows of one symbol: the latest that sets a target, and the latest with a price."""
    kept: pd.DataFrame | None = None
    for f in frames:
        f = f.dropna(subset=["symbol", "ts"])
        f = f[f["price"].notna() & (f["price"] != 0) | f["target"].notna()]
        f = f if kept is None else pd.concat([kept, f])
        f = f.sort_values(["ts", "seq"], kind="stable")
        priced = f[f["price"].notna() & (f["price"] != 0)].groupby("symbol", as_index=False).tail(1)
        target = f[f["target"].notna()].groupby("symbol", as_index=False).tail(1)
        kept = pd.concat([priced, target]).drop_duplicates(["symbol", "ts", "seq"])
    if kept is not None:
        yield kept


class BookKeeper(StatefulProcessor):
    """Per symbol: weight, the price it was last carried to, and when.

    A price carries the weight by its return; without a price so far it only becomes the reference.  A row with a target
    sets the weight from then on, at that row's price (or, if it has none, at the next one).  Rows not after the last are late and
    change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ts timestamp, seq bigint, weight double, price double")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        self.held.update((None, None, None if pd.isna(r["weight"]) else float(r["weight"]), None if pd.isna(r["price"]) or r["price"] == 0 else float(r["price"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, seq, weight, price = self.held.get() if self.held.exists() else (None, None, None, None)
        new = pd.concat(list(rows)).sort_values(["ts", "seq"])  # two rows for each task
        if ts is not None:
            at = pd.Timestamp(ts)
            new = new[(new["ts"] > at) | ((new["ts"] == at) & (new["seq"] > seq))]
        for t, n, target, p in zip(new["ts"], new["seq"], new["target"], new["price"]):
            known = not pd.isna(p) and p != 0
            if not pd.isna(target):
                weight, price = float(target), None
            elif known and price and weight is not None:
                weight *= p / price
            price = float(p) if known else price
            ts, seq = t.to_pydatetime(), int(n)
        if len(new):
            self.held.update((ts, seq, weight, price))
            yield pd.DataFrame({"symbol": [key[0]], "ts": pd.Series([ts], dtype="datetime64[us]"), "weight": pd.Series([weight], dtype="float64"),
                                "price": pd.Series([price], dtype="float64")})

    def close(self) -> None:
        pass


def held_book(prices: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """The positions (symbol, ts, weight, price) that change with each batch of a stream (symbol, ts, seq, price, target).

    seq orders rows of one symbol and time.  target: a new weight, NULL where the row is a price alone; so a book that is ranked
    anew on schedule comes as rows of the same stream.  book: symbol, weight, price held at the start; used when the query first
    starts, while a query that goes on has its own state.
    """
    rows = prices.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias(
        "price"), F.col("target").cast("double").alias("target"))
    start = None if book is None else book.select("symbol", "weight", "price").groupBy("symbol")
    return _keyed(rows.mapInPandas(_latest, rows.schema), "symbol", BookKeeper(), BOOK, "None", start)


def current_book(changes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """symbol, weight, price now: each symbol's last change, else its place in the book at the start."""
    last = keep_one(changes, ["symbol"], F.struct("batch")).select("symbol", "weight", "price")
    if start is None:
        return last
    return last.unionByName(start.select("symbol", "weight", "price").join(last, "symbol", "left_anti"))
