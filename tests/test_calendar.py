import datetime as dt

import numpy as np
import pytest

from panelforge.operators import calendar as cal
from panelforge.operators.quality import cache_report

D = dt.date


@pytest.fixture(scope="module")
def holidays():
    return [D(2024, 1, 1), D(2024, 7, 4), D(2024, 12, 25), D(2024, 3, 30)]  # the last is a Saturday


def test_elapsed_and_shifted_sessions_are_numpys(spark, holidays):
    c = cal.trading_calendar(spark, "2023-12-01", "2025-02-01", spark.createDataFrame([(h,) for h in [*holidays, holidays[0], None]], "day date"))
    days = [D(2023, 12, 20) + dt.timedelta(i) for i in range(0, 380, 3)]
    df = spark.createDataFrame([(a, b) for a in days[::7] for b in days], "a date, b date")
    off = np.array(holidays, "datetime64[D]")
    for r in cal.elapsed_sessions(df, c, "a", "b").collect():
        want = np.busday_count(r.a, r.b, holidays=off) if r.b >= r.a else -np.busday_count(r.b + dt.timedelta(1), r.a + dt.timedelta(1), holidays=off)
        assert r.elapsed == want, r
    for n in (0, 1, 5, -1, -5):
        for r in cal.shift_sessions(df.select("b").distinct(), c, "b", n).collect():
            assert r.shifted == np.busday_offset(r.b, n, roll="backward" if n >= 0 else "forward", holidays=off).astype(object), (n, r)


def test_a_holiday_moves_due_dates_and_freshness(spark, holidays):
    plain = cal.trading_calendar(spark, "2024-01-01", "2024-12-31")
    off = cal.trading_calendar(spark, "2024-01-01", "2024-12-31", spark.createDataFrame([(h,) for h in holidays], "day date"))
    books = spark.createDataFrame([("2024-07-01", D(2024, 7, 8)), (None, D(2024, 7, 8)), ("soon", D(2024, 7, 8)), ("2019-01-01", D(2024, 7, 8))], "last string, today date")
    due = lambda c: [r.due for r in cal.rebalance_due_on(books, c, "last", "today", 5).collect()]
    assert due(plain) == [True] * 4 and due(off) == [False, True, True, True]  # the last is outside the calendar: not dated
    bars = spark.createDataFrame([("a", D(2024, 7, 1)), ("a", D(2024, 1, 2)), ("b", D(2024, 7, 2)), ("b", D(2024, 1, 9))], "symbol string, ts date")
    fresh = lambda c: {r.symbol: (r.fresh, r.covers) for r in cache_report(bars, "2024-01-01", "2024-07-08", 4, 5, 1, c).collect()}
    assert fresh(plain) == {"a": (False, True), "b": (True, False)} and fresh(off) == {"a": (True, True), "b": (True, False)}


def test_size_is_checked_and_joins_are_broadcast(spark):
    with pytest.raises(ValueError):
        cal.trading_calendar(spark, "1500-01-01", "2024-01-01")
    c = cal.trading_calendar(spark, "2024-01-01", "2024-12-31")
    df = cal.elapsed_sessions(spark.range(5).selectExpr("date_add(date'2024-02-01', CAST(id AS INT)) AS a", "date_add(date'2024-03-01', CAST(id AS INT)) AS b"), c, "a", "b")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert cal.elapsed_sessions(df.drop("elapsed").limit(0), c, "a", "b").count() == 0
