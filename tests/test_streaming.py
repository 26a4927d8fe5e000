"""Streams over several batches: state after a restart, replayed batches, late rows, silence."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelforge.streaming import jobs

START = datetime(2024, 3, 4, 9)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


@pytest.fixture
def files(spark, tmp_path):
    """Appends a file to a folder, and reads the folder as a stream of one file a batch."""
    def add(rows, ddl):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/t.parquet")

    def stream():
        return jobs.file_stream(spark, f"{tmp_path}/in", "t", 1)

    return add, stream, str(tmp_path)


PRICES = "symbol string, ts timestamp, seq long, price double, target double"


def test_book_survives_a_restart(spark, files):
    add, stream, path = files
    held = spark.createDataFrame([("a", 0.5, 10.0), ("b", -0.5, None), ("c", 0.1, 7.0)], "symbol string, weight double, price double")
    sink = jobs.BatchFolders(spark, f"{path}/changes", "book", jobs.BOOK)

    def go():
        jobs.run_batches(jobs.held_book(stream(), held), spark, "book", sink, f"{path}/book", "update")
        return {r.symbol: (r.weight and round(r.weight, 9), r.price) for r in jobs.current_book(sink.read(), held).collect()}

    add([("a", at(0), 1, 11.0, None), ("a", at(1), 2, 12.0, None), ("b", at(1), 1, 20.0, None)], PRICES)
    add([("a", at(2), 3, 0.0, None), ("a", at(3), 4, None, None), ("b", at(2), 2, 25.0, None), ("d", at(2), 1, 4.0, None)], PRICES)
    # a: by its return; b: its first price is a reference; c: no price; d: not held.
    assert go() == {"a": (0.6, 12.0), "b": (-0.625, 25.0), "c": (0.1, 7.0), "d": (None, 4.0)}
    add([("a", at(4), 5, 18.0, None), ("a", at(0.5), 9, 99.0, None)], PRICES)  # the second is late
    add([("d", at(5), 2, 5.0, 0.3), ("d", at(6), 3, 6.0, None), ("b", at(5), 3, None, 0.2), ("b", at(6), 4, 50.0, None)], PRICES)
    want = {"a": (0.9, 18.0), "b": (0.2, 50.0), "c": (0.1, 7.0), "d": (0.36, 6.0)}
    assert go() == want  # a new query on the same checkpoint
    assert go() == want and sink.read().select("batch").distinct().count() == 4


def test_book_of_one_batch_equals_that_of_many(spark, files):
    add, stream, path = files
    rows = [("hot" if i % 3 else f"s{i % 5}", at(i), i, 50.0 + i % 11, 0.1 if i % 40 == 39 else None) for i in range(200)]
    held = spark.createDataFrame([("hot", 0.5, 50.0)], "symbol string, weight double, price double")
    for i in range(0, 200, 50):
        add(rows[i:i + 50], PRICES)
    found = []
    for name, s in (("many", stream()), ("one", spark.readStream.schema(PRICES).parquet(f"{path}/in/t.parquet"))):
        sink = jobs.BatchFolders(spark, f"{path}/{name}", "book", jobs.BOOK)
        jobs.run_batches(jobs.held_book(s, held), spark, name, sink, mode="update")
        found.append({r.symbol: (round(r.weight, 9), r.price) for r in jobs.current_book(sink.read(), held).where("weight is not null").collect()})
    assert found[0] == found[1] and "hot" in found[0]


def test_silence_is_an_alarm(spark, files):
    add, stream, path = files
    ticks = "symbol string, ts timestamp"
    sink = jobs.BatchFolders(spark, f"{path}/alarms", "gaps", jobs.ALARMS)

    def go():
        jobs.run_batches(jobs.silence_alarms(stream(), 600, "1 minute"), spark, "gaps", sink, f"{path}/gaps", "update")
        return {(r.symbol, r.from_ts, r.to_ts) for r in jobs.settled_alarms(sink.read()).collect()}

    add([("a", at(0)), ("a", at(8)), ("b", at(0)), ("c", at(3)), (None, at(3)), ("a", None)], ticks)
    assert go() == set()
    add([("a", at(16)), ("b", at(9)), ("b", at(9))], ticks)
    # c has been silent for more than ten minutes of event time, though no tick of its own says so.
    assert go() == {("c", at(3), None)}
    add([("a", at(25)), ("b", at(20)), ("c", at(24.5))], ticks)
    assert go() == {("c", at(3), at(24.5)), ("b", at(9), at(20))}
    add([("b", at(15)), ("a", at(25.5))], ticks)  # behind the watermark: dropped
    add([("a", at(60))], ticks)
    # The end: a and b stop, and only a speaks again.
    assert go() == {("c", at(3), at(24.5)), ("b", at(9), at(20)), ("b", at(20), None), ("c", at(24.5), None), ("a", at(25.5), at(60))}


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    ddl = "symbol string, bar_date date, ts timestamp, v int"
    log = jobs.KeyedLog(spark, f"{tmp_path}/log", "q", ddl, ["symbol", "bar_date"], "ts")
    day = START.date()
    first = spark.createDataFrame([("a", day, at(5), 1), ("a", day, at(2), 2), (None, day, at(1), 3)], ddl)
    log(first, 0)
    log(first, 0)
    late = spark.createDataFrame([("a", day, at(0), 4), ("b", day, at(-99999), 5), (None, day, at(0), 6)], ddl)
    log(late, 1)
    log(late, 1)
    other = jobs.KeyedLog(spark, f"{tmp_path}/log", "other", ddl, ["symbol", "bar_date"], "ts")
    other(late, 0)
    # The first of a batch by time; keys of another batch or query stay out; a late key that is new is logged.
    assert {(r.symbol, r.v, r.query, r.batch) for r in log.read().collect()} == {("a", 2, "q", 0), (None, 3, "q", 0), ("b", 5, "q", 1)}
    assert jobs.KeyedLog(spark, f"{tmp_path}/none", "q", ddl, ["symbol"], "ts").read().count() == 0


def test_first_records_across_a_restart(spark, files):
    add, stream, path = files
    ddl = "symbol string, ts timestamp"

    def go():
        return sorted(r.symbol for r in jobs.run_to_table(jobs.first_records(stream(), ["symbol"], "ts", "10 minutes"), spark, "first", f"{path}/first").collect())

    add([("a", at(0)), ("a", at(1)), ("b", at(1))], ddl)
    assert go() == ["a", "b"]
    add([("a", at(9)), ("c", at(9))], ddl)
    assert go() == ["a", "b", "c"]
    add([("d", at(60))], ddl)
    go()
    add([("e", at(30)), ("a", at(61))], ddl)  # e is behind the watermark; a's state is over
    assert go() == ["a", "a", "b", "c", "d"]


def test_bars_wait_for_the_watermark(spark, files):
    add, stream, path = files
    ddl = "symbol string, ts timestamp, price double, volume double"

    def go():
        bars = jobs.run_to_table(jobs.tick_bars(stream(), "10 minutes", "5 minutes"), spark, "bars", f"{path}/bars")
        return {(r.symbol, r.ts, r.open, r.high, r.low, r.close, r.n_ticks) for r in bars.collect()}

    add([("a", at(1), 10.0, 1.0), ("a", at(9), 12.0, 1.0)], ddl)
    assert go() == set()
    add([("a", at(2), 15.0, 1.0), ("a", at(13), 9.0, 1.0)], ddl)  # the first is late, but within the delay
    assert go() == set()
    add([("a", at(26), 8.0, 1.0)], ddl)
    assert go() == {("a", at(0), 10.0, 15.0, 10.0, 12.0, 3), ("a", at(10), 9.0, 9.0, 9.0, 9.0, 1)}
    add([("a", at(3), 99.0, 1.0)], ddl)
    assert len(go()) == 2


def test_restated_bars_keep_the_latest(spark, files):
    add, stream, path = files
    ddl = "symbol string, ts timestamp, interval string, close double, fetched_at timestamp"
    for minute, close in ((1, 5.0), (3, 6.0), (2, 7.0)):
        add([("a", at(0), "1d", close, at(minute)), ("b", at(minute), "1d", close, at(minute))], ddl)
    jobs.run_batches(stream(), spark, "restate", jobs.restate_bars(spark, f"{path}/table"))
    got = spark.read.parquet(f"{path}/table")
    assert got.where("symbol = 'a'").select("close").collect()[0][0] == 7.0 and got.where(F.col("symbol") == "b").count() == 3
