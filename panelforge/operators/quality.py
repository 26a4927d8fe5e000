"""Ingest standardisation and data-quality gates over long bar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.calendar import Calendar, shifted_day
from panelforge.functions.scalars import add_business_days, finite, us_session
from panelforge.operators.timeaxis import FIRST, forward_fill
from panelforge.schema import BAR_VALUE_COLS, FEATURE_COLS, HORIZON, PRICE_COLS, require_columns

# Fixed tolerances of the ingest gates.
MAX_FILL_FRACTION = 0.10
MAX_GAP_DAYS = 5
STALE_TOLERANCE = 4
COVERAGE_TOLERANCE = 5
MIN_CACHED_ROWS = 50
MAX_DROPPED_FRACTION = 0.10


class UniverseError(ValueError):
    """Too much of the universe, or all of it, failed a gate."""


def require_bar_columns(bars: DataFrame) -> DataFrame:
    return require_columns(bars, BAR_VALUE_COLS)


def regular_session(bars: DataFrame) -> DataFrame:
    return bars.where(us_session("ts"))


def add_spread(bars: DataFrame) -> DataFrame:
    """Two basis points of the close, at least one cent."""
    return bars.withColumn("spread", F.greatest(F.col("close") * F.lit(0.0002), F.lit(0.01)))


def keep_one(df: DataFrame, keys: Sequence[str], by: str | Column, latest: bool = True) -> DataFrame:
    """One row per key: the one with the largest (or smallest) `by`.

    Written as an aggregate, so copies of a key shrink before the shuffle.
    """
    order = F.col(by) if isinstance(by, str) else by
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def trim_leading(bars: DataFrame) -> DataFrame:
    """Drop each symbol's rows before its first row carrying any price."""
    priced = F.coalesce(*PRICE_COLS).isNotNull()
    first = bars.where(priced).groupBy("symbol").agg(F.min("ts").alias("_first"))
    return bars.join(first, "symbol").where("ts >= _first").drop("_first")


def needs_fill() -> Column:
    missing = F.lit(False)
    for c in BAR_VALUE_COLS:
        missing = missing | F.col(c).isNull()
    return missing


def fill_report(trimmed: DataFrame) -> DataFrame:
    """Rows and rows needing a fill per symbol, with the accept/reject verdict."""
    frac = F.avg(needs_fill().cast("double"))
    return trimmed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(needs_fill()).alias("n_missing"),
        frac.alias("fill_fraction"),
        (frac > F.lit(MAX_FILL_FRACTION)).alias("rejected"),
    )


def standardize(raw: DataFrame, arrival: str | Column, intraday: bool = False,
                bucket: str = "year(ts)") -> tuple[DataFrame, DataFrame]:
    """(clean bars with spread, rejected symbols with reason).

    Dedupe keep-last, optional session filter, trim to the first price, forward
    fill only, reject symbols that needed too many fills.
    """
    df = keep_one(require_bar_columns(raw), ["symbol", "ts"], arrival)
    if intraday:
        df = regular_session(df)
    df = df.withColumns({c: finite(c) for c in BAR_VALUE_COLS})
    trimmed = trim_leading(df)
    verdict = fill_report(trimmed)
    unpriced = df.select("symbol").distinct().join(verdict.select("symbol"), "symbol", "left_anti")
    rejected = verdict.where("rejected").select(
        "symbol", F.format_string("%d of %d rows needed a fill", "n_missing", "n_rows").alias("reason")
    ).unionByName(unpriced.select("symbol", F.lit("no valid price rows").alias("reason")))
    kept = trimmed.join(verdict.where("not rejected").select("symbol"), "symbol", "left_semi")
    return add_spread(forward_fill(kept, BAR_VALUE_COLS, bucket=bucket)), rejected


def gap_report(bars: DataFrame, max_gap: int = MAX_GAP_DAYS) -> DataFrame:
    """Longest calendar gap between consecutive distinct days of each symbol."""
    days = bars.select("symbol", F.to_date("ts").alias("day")).distinct()
    # A bucket's gaps are between its own days; the step into a bucket is the gap
    # from the last day of the buckets before it.
    by_year = days.withColumn("_y", F.year("day"))
    inside = Window.partitionBy("symbol", "_y").orderBy("day")
    earlier = Window.partitionBy("symbol").orderBy("_y").rowsBetween(FIRST, -1)
    last_before = by_year.groupBy("symbol", "_y").agg(F.max("day").alias("_end")).select(
        "symbol", "_y", F.max("_end").over(earlier).alias("_before"))
    steps = by_year.withColumn("_prev", F.lag("day").over(inside)).join(last_before, ["symbol", "_y"]).select(
        "symbol", "day", F.coalesce("_prev", "_before").alias("from_day"))
    gap = F.datediff("day", "from_day")
    worst = steps.where("from_day is not null").groupBy("symbol").agg(
        F.max(gap).alias("max_gap"),
        F.max_by(F.struct("from_day", "day"), F.struct(gap, -F.datediff("day", F.lit("1970-01-01")))).alias("_at"))
    return worst.select("symbol", "max_gap", F.col("_at.from_day").alias("gap_start"),
                        F.col("_at.day").alias("gap_end"), (F.col("max_gap") > max_gap).alias("rejected"))


def cache_report(bars: DataFrame, start: str, end: str, stale: int = STALE_TOLERANCE,
                 coverage: int = COVERAGE_TOLERANCE, min_rows: int = MIN_CACHED_ROWS, calendar: Calendar | None = None) -> DataFrame:
    """Per symbol: rows held, freshness against `end`, coverage of `start`, and whether it can be served.

    Tolerances are weekdays, or sessions of a calendar.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    if calendar is None:
        oldest, latest = add_business_days(hi, -stale), add_business_days(lo, coverage)
    else:
        oldest, latest = (F.lit(shifted_day(calendar, d, n)) for d, n in ((end, -stale), (start, coverage)))
    r = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"),
                                   F.max("ts").alias("last_ts"))
    fresh = F.to_date("last_ts") >= oldest
    covers = F.to_date("first_ts") <= latest
    return r.withColumns({"fresh": fresh, "covers": covers}).withColumn(
        "serve", F.col("fresh") & F.col("covers") & (F.col("n_rows") >= min_rows))


def refetch_list(universe: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """Universe symbols whose cached bars cannot be served."""
    ok = cache_report(bars, start, end).where("serve").select("symbol")
    return universe.select("symbol").distinct().join(ok, "symbol", "left_anti")


def min_history(bars: DataFrame, n: int) -> DataFrame:
    enough = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return bars.join(enough.select("symbol"), "symbol", "left_semi")


def drop_ledger(universe: DataFrame, bars: DataFrame, features: DataFrame, min_bars: int) -> DataFrame:
    """(symbol, reason) for every universe symbol that does not reach the panel."""
    held = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    alive = features.select("symbol").distinct().withColumn("alive", F.lit(True))
    state = universe.select("symbol").distinct().join(held, "symbol", "left").join(alive, "symbol", "left")
    n = F.coalesce("n_bars", F.lit(0))
    reason = F.when(n < min_bars, F.format_string(f"insufficient bars (%d < {min_bars})", n)).when(
        F.col("alive").isNull(), F.lit("no rows survived feature warmup"))
    return state.select("symbol", reason.alias("reason")).where("reason is not null")


def check_universe(ledger: DataFrame, n_universe: int, max_fraction: float = MAX_DROPPED_FRACTION) -> None:
    dropped = ledger.count()
    if n_universe == 0 or dropped == n_universe:
        raise UniverseError("no symbol produced features")
    if dropped / n_universe > max_fraction:
        raise UniverseError(f"{dropped} of {n_universe} symbols dropped, above {max_fraction:.0%}")


def drop_incomplete(df: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols}).na.drop(subset=list(cols))


def zero_fill(df: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """Model-matrix clean: missing or infinite becomes 0."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in cols})


def sigma_clip(df: DataFrame, cols: Sequence[str], k: float = 5.0) -> DataFrame:
    """Zero-fill, then clamp each column to its mean plus or minus k population deviations."""
    clean = zero_fill(df, cols)
    stats = clean.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_st_{c}") for c in cols])
    joined = clean.join(F.broadcast(stats))  # one row
    bounded = {}
    for c in cols:
        m, s = F.col(f"_st_{c}.m"), F.col(f"_st_{c}.s")
        bounded[c] = F.when(s > 0, F.greatest(F.least(F.col(c), m + k * s), m - k * s)).otherwise(F.col(c))
    return joined.withColumns(bounded).drop(*[f"_st_{c}" for c in cols])


def out_of_sample(df: DataFrame, cutoffs: DataFrame, key: str, ts: str = "ts", embargo_days: int = HORIZON) -> DataFrame:
    """Keep rows strictly after their model's train_end plus an embargo; unknown cutoffs pass through."""
    cut = cutoffs.select(key, F.col("train_end").alias("_cut"))
    keep = F.col("_cut").isNull() | (F.col(ts) > F.date_add("_cut", embargo_days))
    return df.join(cut, key, "left").where(keep).drop("_cut")


def require_out_of_sample(kept: DataFrame) -> DataFrame:
    """The strict form: an empty result means the whole range was in-sample."""
    if kept.isEmpty():
        raise UniverseError("requested range is entirely in-sample")
    return kept


def stale_models(registry: DataFrame, as_of: str | Column, max_age_days: int) -> DataFrame:
    now = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    age = F.datediff(now, F.to_date("trained_at"))
    return registry.select("model_key", age.alias("age_days")).where(F.col("age_days") > max_age_days)
