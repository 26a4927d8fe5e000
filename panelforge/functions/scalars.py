"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.schema import CLASS_NAMES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and both infinities become NULL, so that they are skipped and never compare."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clip(c: str | Column, low: float, high: float) -> Column:
    """Clamp, keeping NULL as NULL (`least`/`greatest` alone would turn it into a bound)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low))))


def all_of(predicates: list[Column | None]) -> Column:
    """Conjunction of the predicates that were given; TRUE when none were."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


# ---- labels, signals and scores --------------------------------------------

def discretize(ret: str | Column, pos: float | Column, neg: float | Column) -> Column:
    """Forward return -> 0 SELL / 1 HOLD / 2 BUY; thresholds may vary per row."""
    pos = pos if isinstance(pos, Column) else F.lit(float(pos))
    neg = neg if isinstance(neg, Column) else F.lit(float(neg))
    r = col(ret)
    return F.when(r > pos, 2).when(r < neg, 0).otherwise(1)


def signal_score(signal: str | Column, confidence: str | Column) -> Column:
    s = col(signal)
    return F.when(s == "BUY", col(confidence)).when(s == "SELL", -col(confidence)).otherwise(F.lit(0.0))


def signal_number(name: str | Column) -> Column:
    s = col(name)
    return F.when(s == "BUY", 1).when(s == "SELL", -1).when(s == "HOLD", 0)


def signal_name(number: str | Column) -> Column:
    n = col(number)
    return F.when(n > 0, "BUY").when(n < 0, "SELL").when(n == 0, "HOLD")


def q_spread(hold: Column, long: Column, short: Column) -> Column:
    return F.greatest(hold, long, short) - F.least(hold, long, short)


def q_gate(hold: str | Column, long: str | Column, short: str | Column,
           min_spread: float, min_advantage: float) -> Column:
    """BUY/SELL only when the action values are decisive: wide spread and a clear lead over holding."""
    h, lo, sh = col(hold), col(long), col(short)
    top = F.greatest(h, lo, sh)
    decisive = q_spread(h, lo, sh) >= F.lit(float(min_spread))
    lead = F.lit(float(min_advantage))
    return (
        F.when(decisive & (lo == top) & (lo - h > lead), "BUY")
        .when(decisive & (sh == top) & (sh - h > lead), "SELL")
        .otherwise("HOLD")
    )


def q_confidence(hold: str | Column, long: str | Column, short: str | Column) -> Column:
    return clip((q_spread(col(hold), col(long), col(short)) + 1.0) / 2.0, 0.0, 1.0)


def align_classes(proba: str | Column, classes: str | Column, n: int = 3) -> Column:
    """Spread probabilities given in the model's class order over classes 0..n-1."""
    p, c = col(proba), col(classes)
    return F.array(*[
        F.coalesce(F.try_element_at(p, F.nullif(F.array_position(c, F.lit(i)).cast("int"), F.lit(0))), F.lit(0.0))
        for i in range(n)
    ])


def blend(first: str | Column, second: str | Column, alpha: float) -> Column:
    return F.zip_with(col(first), col(second),
                      lambda a, b: F.lit(float(alpha)) * a + F.lit(1.0 - float(alpha)) * b)


def argmax(arr: str | Column) -> Column:
    """0-based index of the first maximum."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def class_decision(proba: str | Column, threshold: float | Column) -> Column:
    """Name of the most likely class, demoted to HOLD when its probability is too low."""
    p = col(proba)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    name = F.element_at(F.array(*[F.lit(n) for n in CLASS_NAMES]), argmax(p) + 1)
    return F.when((name != "HOLD") & (F.array_max(p) < thr), "HOLD").otherwise(name)


def logit(w: str | Column, floor: float = 1e-6) -> Column:
    c = clip(w, floor, 1.0 - floor)
    return F.log(c / (F.lit(1.0) - c))


# ---- calendar ---------------------------------------------------------------

def _weekdays_before(d: Column) -> Column:
    """Monday-Friday days in [1970-01-05, d); a Monday epoch makes this a closed form."""
    days = F.datediff(d, F.lit("1970-01-05").cast("date"))
    weeks = F.floor(days / 7)
    return weeks * 5 + F.least(days - weeks * 7, F.lit(5))


def business_days(start: str | Column, end: str | Column) -> Column:
    """Weekdays in [start, end), negative when end precedes start."""
    a, b = col(start), col(end)
    forward = _weekdays_before(b) - _weekdays_before(a)
    # Going backwards the count covers (end, start]: the excluded end point swaps sides.
    backward = -(_weekdays_before(F.date_add(a, 1)) - _weekdays_before(F.date_add(b, 1)))
    return F.when(b >= a, forward).otherwise(backward).cast("int")


def add_business_days(d: str | Column, n: int) -> Column:
    """Move n weekdays; a weekend start counts from the nearest weekday behind the move."""
    c = col(d)
    wd = F.weekday(c)
    if n >= 0:
        anchor = F.when(wd > 4, F.date_sub(c, (wd - 4).cast("int"))).otherwise(c)
    else:
        anchor = F.when(wd > 4, F.date_add(c, (F.lit(7) - wd).cast("int"))).otherwise(c)
    awd = F.weekday(anchor)
    pos = awd + F.lit(n)
    weeks = F.floor(pos / 5)
    return F.date_add(anchor, (weeks * 7 + (pos - weeks * 5) - awd).cast("int"))


def parse_date(c: str | Column) -> Column:
    return F.try_to_date(col(c), "yyyy-MM-dd")


def iso_timestamp(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")


def us_session(ts: str | Column, zone: str = "America/New_York") -> Column:
    """TRUE inside the regular session: 09:30 inclusive to 16:00 exclusive, local time."""
    clock = F.date_format(F.from_utc_timestamp(col(ts), zone), "HH:mm")
    return (clock >= "09:30") & (clock < "16:00")


def is_intraday(interval: str) -> bool:
    return interval.endswith(("m", "h"))


def csv_list(c: str | Column) -> Column:
    """'aapl, msft,,' -> ['AAPL','MSFT']"""
    parts = F.transform(F.split(col(c), ","), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: x != "")
