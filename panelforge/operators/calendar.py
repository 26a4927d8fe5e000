"""A trading calendar with holidays: elapsed sessions, session offsets, and the latest session as of a day.

The calendar is a table of days with running counts, so each question is an equi-join on a day or on a session's number.
Its size is the span of days it covers, which is checked, so it may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import parse_date

#: Days a calendar may cover: more than two centuries, a few megabytes.
MOST_DAYS = 80_000


@dataclass(frozen=True)
class Calendar:
    """days: day, open (a session), before (sessions before the day).  sessions: no (from 0), session."""

    days: DataFrame
    sessions: DataFrame


def trading_calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> Calendar:
    """Weekdays from start to end, both included, without the days of `holidays` (a column `day`; NULLs and repeats don't matter)."""
    span = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    if not 0 < span <= MOST_DAYS:
        raise ValueError(f"a calendar covers 1 to {MOST_DAYS} days, not {span}")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    closed = F.weekday("day") > 4
    if holidays is not None:
        off = holidays.select(F.to_date("day").alias("day")).distinct().withColumn("_off", F.lit(True))
        days = days.join(off, "day", "left")
        closed = closed | F.col("_off").isNotNull()
    days = days.select("day", (~closed).alias("open"))
    before = F.sum(F.col("open").cast("int")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))  # `span` rows
    days = days.withColumn("before", F.coalesce(before, F.lit(0)).cast("int"))
    return Calendar(days, days.where("open").select(F.col("before").alias("no"), F.col("day").alias("session")))


def _on(df: DataFrame, calendar: Calendar, day: str | Column, tag: str) -> DataFrame:
    """Adds _before_<tag> and _open_<tag> of a day; NULL for days that the calendar doesn't cover."""
    own = calendar.days.select(F.col("day").alias(f"_day_{tag}"), F.col("before").alias(f"_before_{tag}"), F.col("open").cast("int").alias(f"_open_{tag}"))
    at = F.to_date(F.col(day) if isinstance(day, str) else day)
    return df.withColumn(f"_at_{tag}", at).join(F.broadcast(own), F.col(f"_at_{tag}") == F.col(f"_day_{tag}"), "left").drop(f"_at_{tag}", f"_day_{tag}")


def _without(df: DataFrame, *tags: str) -> DataFrame:
    return df.drop(*[f"_{c}_{t}" for t in tags for c in ("before", "open")])


def elapsed_sessions(df: DataFrame, calendar: Calendar, start: str | Column, end: str | Column, out: str = "elapsed") -> DataFrame:
    """Sessions in [start, end); negative, over (end, start], when end precedes start.  NULL outside the calendar."""
    d = _on(_on(df, calendar, start, "a"), calendar, end, "b")
    a, b = F.col("_before_a"), F.col("_before_b")
    backward = -((a + F.col("_open_a")) - (b + F.col("_open_b")))
    later = F.to_date(F.col(end) if isinstance(end, str) else end) >= F.to_date(F.col(start) if isinstance(start, str) else start)
    return _without(d.withColumn(out, F.when(later, b - a).otherwise(backward).cast("int")), "a", "b")


def shift_sessions(df: DataFrame, calendar: Calendar, day: str | Column, n: int, out: str = "shifted") -> DataFrame:
    """The day n sessions on; a day without a session counts from the session behind the move.  NULL outside the calendar."""
    d = _on(df, calendar, day, "d")
    last = F.col("_before_d") + F.col("_open_d") - 1
    d = d.withColumn("_no", (last if n >= 0 else F.col("_before_d")) + F.lit(n))
    s = calendar.sessions.select(F.col("no").alias("_s"), F.col("session").alias(out))
    return _without(d.join(F.broadcast(s), F.col("_no") == F.col("_s"), "left").drop("_no", "_s"), "d")


def session_as_of(df: DataFrame, calendar: Calendar, day: str | Column, out: str = "session") -> DataFrame:
    """The latest session on or before a day."""
    return shift_sessions(df, calendar, day, 0, out)


def shifted_day(calendar: Calendar, day: str, n: int) -> date | None:
    """One day, shifted."""
    one = calendar.days.sparkSession.range(1).select(F.lit(day).cast("date").alias("d"))
    return shift_sessions(one, calendar, "d", n, "s").first()["s"]


def rebalance_due_on(df: DataFrame, calendar: Calendar, last: str, today: str, every: int, out: str = "due") -> DataFrame:
    """Whether `every` sessions have passed since the last book; TRUE without a previous book that can be dated."""
    if every <= 1:
        return df.withColumn(out, F.lit(True))
    text = df.schema[last].dataType.simpleString() == "string"
    d = elapsed_sessions(df.withColumn("_last", parse_date(last) if text else F.to_date(last)), calendar, "_last", today, "_elapsed")
    return d.withColumn(out, F.coalesce(F.col("_elapsed") >= every, F.lit(True))).drop("_last", "_elapsed")
