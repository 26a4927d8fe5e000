"""Weight books over time, single-date books, drift, and trade-level projections."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import business_days, clip, finite, parse_date
from panelforge.operators.timeaxis import (
    CHUNK_ROWS, chunk_window, chunked, lagged_return, number_rows, own_rows, roll_mean, roll_std,
)
from panelforge.operators.xsec import BookConfig, grid_column, rank_panel, sector_neutralize, target_weights
from panelforge.schema import TRADING_DAYS

NET_EXPOSURE_WARN = 0.5
ATR_BOUNDS = (0.005, 0.10)
VOL_SCALE_BOUNDS = (0.25, 3.0)
#: Held rows of a task.  They are exchanged at a tenth of the size they are sorted at, so tasks are not sized by what is exchanged.
HELD_ROWS = 250_000


# ---- the book over a panel ----------------------------------------------------

def date_index(panel: DataFrame, date: str = "ts") -> DataFrame:
    """(date, i): the distinct dates numbered in order."""
    return number_rows(panel.select(date).distinct(), keys=(), order=(date,), bucket=f"year({date})", out="i")


def held_positions(panel: DataFrame, grid: Sequence[BookConfig], dates: DataFrame | None = None) -> DataFrame:
    """Every held (config, ts, symbol) with its drifting weight `w`, its `w0`, `ret` and `beta`.

    panel: ts, symbol, pred, ret[, beta].  A target set on a rebalance date lives
    until the next one, so positions are grown from the sparse targets; names
    without weight never appear.
    """
    dates = date_index(panel) if dates is None else dates
    if "beta" not in panel.columns:
        panel = panel.withColumn("beta", F.lit(None).cast("double"))
    target = target_weights(rank_panel(panel), grid, dates).select(
        "config", "rebalance", "symbol", F.col("i").alias("i0"), F.col("w").alias("w0"))
    days = target.withColumn("i", F.explode(F.sequence(F.col("i0"), F.col("i0") + F.col("rebalance") - 1)))
    # A variant holds two legs on every date at most.
    tasks = max(math.ceil(panel.count() * sum(min(2 * c.decile, 1.0) for c in grid) / HELD_ROWS), 1)
    place = ["ts", "symbol"]
    rows = days.join(F.broadcast(dates), "i").repartition(tasks, *place).join(
        panel.select("ts", "symbol", "ret", "beta").repartition(tasks, *place), place, "left").repartition(tasks, "config", "symbol", "i0")
    # At most `rebalance` rows per group.
    life = Window.partitionBy("config", "symbol", "i0").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.product(1.0 + F.coalesce(F.col("ret"), F.lit(0.0))).over(life)
    return rows.withColumn("w", F.col("w0") * F.coalesce(grown, F.lit(1.0)))


def turnover(positions: DataFrame) -> DataFrame:
    """(config, i, turnover): traded notional on rebalance dates, against the drifted book.

    New targets enter with +w0 and the value a block ended on leaves with a minus
    sign at the next block; each name's sum is its trade.
    """
    one_day = 1.0 + F.coalesce(F.col("ret"), F.lit(0.0))
    blocks = positions.groupBy("config", "rebalance", "symbol", "i0").agg(
        F.first("w0").alias("w0"), (F.first("w0") * F.product(one_day)).alias("end"))
    flows = blocks.select("config", "symbol", F.inline(F.array(
        F.struct(F.col("i0").alias("i"), F.col("w0").alias("flow")),
        F.struct((F.col("i0") + F.col("rebalance")).alias("i"), (-F.col("end")).alias("flow")))))
    trades = flows.groupBy("config", "i", "symbol").agg(F.abs(F.sum("flow")).alias("trade"))
    return trades.groupBy("config", "i").agg(F.sum("trade").alias("turnover"))


def run_book(panel: DataFrame, grid: Sequence[BookConfig]) -> DataFrame:
    """Daily series of every variant: returns, costs, exposures and equity."""
    dates = date_index(panel)
    held = held_positions(panel, grid, dates)
    w, zero = F.col("w"), F.lit(0.0)
    per_day = held.groupBy("config", "i").agg(
        F.sum(w * F.col("ret")).alias("gross_ret"), F.sum(F.greatest(-w, zero)).alias("short_notional"),
        F.sum(F.abs(w)).alias("gross_exposure"), F.sum(w).alias("net_exposure"),
        F.sum(w * F.col("beta")).alias("ex_ante_beta"), F.count_if(w != 0).alias("n_held"))
    frame = dates.select("ts", "i", F.inline(grid_column(grid)))
    df = frame.join(per_day, ["config", "i"], "left").join(turnover(held), ["config", "i"], "left").fillna(
        0.0, ["gross_ret", "short_notional", "gross_exposure", "net_exposure", "ex_ante_beta", "turnover"]).fillna(
        0, ["n_held"])
    cost = F.col("turnover") * F.col("cost_bps") / 1e4
    borrow = F.col("short_notional") * F.col("borrow_bps") / 1e4 / TRADING_DAYS
    df = df.withColumns({"cost": cost, "borrow": borrow}).withColumn(
        "book_ret", F.col("gross_ret") - F.col("cost") - F.col("borrow"))
    # One row per date and variant.
    curve = Window.partitionBy("config").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("equity", F.col("start_cash") * F.product(1.0 + F.col("book_ret")).over(curve)).select(
        "config", "config_no", "ts", "i", "gross_ret", "turnover", "cost", "borrow", "book_ret", "equity",
        "gross_exposure", "net_exposure", "short_notional", "ex_ante_beta", "n_held")


def book_diagnostics(daily: DataFrame) -> DataFrame:
    return daily.groupBy("config").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count_if(F.col("n_held") == 0).alias("n_flat_days"),
        F.avg("turnover").alias("mean_turnover"), F.avg("cost").alias("mean_cost"),
        F.avg("borrow").alias("mean_borrow_cost"), (F.sum("cost") + F.sum("borrow")).alias("total_cost_drag"),
        F.avg("gross_exposure").alias("mean_gross_exposure"), F.avg("net_exposure").alias("mean_net_exposure"),
        F.avg("ex_ante_beta").alias("mean_ex_ante_beta"))


# ---- single-date books ----------------------------------------------------------

def build_book(scores: DataFrame, config: BookConfig, sectors: DataFrame | None = None) -> DataFrame:
    """Target book of each date in `scores` (as_of, symbol, score[, beta, price]).

    The same ranking and sizing as the panel book.  Rows: as_of, symbol, weight, beta, price.
    """
    null = F.lit(None).cast("double")
    df = scores.select(
        F.col("as_of").alias("ts"), "symbol", finite("score").alias("pred"),
        *[F.col(c) if c in scores.columns else null.alias(c) for c in ("beta", "price")]).where("pred is not null")
    if sectors is not None:
        df = sector_neutralize(df, sectors)
    w = target_weights(rank_panel(df), [config])
    return w.select(F.col("ts").alias("as_of"), "symbol", F.col("w").alias("weight"), "beta",
                    F.when(F.col("price") != 0, F.col("price")).alias("price"), F.col("n").alias("n_ranked"))


def exposures(book: DataFrame, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """Gross, net, beta coverage; the ex-ante beta only when every held name has one."""
    w, b = F.col("weight"), finite("beta")
    coverage = F.count(b) / F.count(F.lit(1))
    return book.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_held"), F.sum(F.abs(w)).alias("gross_exposure"), F.sum(w).alias("net_exposure"),
        coverage.alias("beta_coverage"), F.when(coverage >= 1.0, F.sum(w * b)).alias("ex_ante_beta"),
        (F.abs(F.sum(w)) > NET_EXPOSURE_WARN).alias("net_exposure_warning"))


def flat_reasons(scores: DataFrame, book: DataFrame, config: BookConfig) -> DataFrame:
    """Why a date has no book: (as_of, n_ranked, reason)."""
    ranked = scores.groupBy("as_of").agg(F.count(finite("score")).alias("n_ranked"))
    flat = ranked.join(book.select("as_of").distinct(), "as_of", "left_anti")
    reason = F.when(F.col("n_ranked") == 0, "no scores").when(
        F.col("n_ranked") < config.min_names,
        F.format_string(f"cross-section of %d names is below min_names={config.min_names}", "n_ranked")
    ).otherwise("ranking produced no tradeable legs")
    return flat.withColumn("reason", reason)


def rebalance_due(last: str | Column, today: str | Column, every: int) -> Column:
    """TRUE without a (parsable) previous book or after `every` weekdays."""
    before = parse_date(last)
    now = F.col(today) if isinstance(today, str) else today
    if every <= 1:
        return F.lit(True)
    return F.coalesce(business_days(before, now) >= every, F.lit(True))


def drift_book(held: DataFrame, prices: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Carry weights by price return; a missing reference price is seeded, a stale weight kept.

    held: symbol, weight, price (the reference); prices: symbol, price_now.
    """
    p0, p1 = F.col("price"), F.when(F.col("price_now") != 0, F.col("price_now"))
    known = (p0.isNotNull()) & (p0 != 0) & p1.isNotNull()
    return held.join(prices.select(*keys, "price_now"), list(keys), "left").withColumns({
        "weight": F.when(known, F.col("weight") * (p1 / p0)).otherwise(F.col("weight")),
        "price": F.coalesce(p1, p0)}).drop("price_now")


def explode_book(books: DataFrame) -> DataFrame:
    """Book records (as_of, weights map, prices map) -> one row per held symbol."""
    return books.select("as_of", F.explode("weights").alias("symbol", "weight"), "prices").withColumn(
        "price", F.try_element_at("prices", "symbol")).drop("prices")


def collect_book(rows: DataFrame) -> DataFrame:
    """Held rows -> one record per date; a record is one book, bounded by the names held."""
    def to_map(v: str) -> Column:
        pairs = F.collect_list(F.when(F.col(v).isNotNull(), F.struct("symbol", v)))
        return F.map_from_entries(F.array_sort(pairs))
    return rows.groupBy("as_of").agg(to_map("weight").alias("weights"), to_map("price").alias("prices"))


def live_book(last: DataFrame, scores: DataFrame, universe: DataFrame, config: BookConfig, today: str,
              sectors: DataFrame | None = None) -> DataFrame:
    """Hold-or-rank: drift the previous book until a rebalance is due, else rank the universe.

    last: as_of, symbol, weight, price (one book, may be empty); scores: symbol,
    score, beta, price for today.
    """
    as_of = last.agg(F.max("as_of").cast("string").alias("last_as_of"))
    due = as_of.select(rebalance_due("last_as_of", F.lit(today).cast("date"), config.rebalance).alias("due"))
    now = scores.select("symbol", F.col("price").alias("price_now"))
    drifted = drift_book(last.select("as_of", "symbol", "weight", "price"), now).join(
        scores.select("symbol", "beta"), "symbol", "left").withColumn("rebalanced", F.lit(False))
    rankable = scores.join(universe.select("symbol"), "symbol", "left_semi").withColumn(
        "as_of", F.lit(today).cast("date"))
    fresh = build_book(rankable, config, sectors).withColumn("rebalanced", F.lit(True))
    cols = ["as_of", "symbol", "weight", "price", "beta", "rebalanced"]
    both = drifted.select(*cols).unionByName(fresh.select(*cols))
    return both.join(F.broadcast(due)).where("due = rebalanced").drop("due")  # `due` is one row


def leg_listing(book: DataFrame) -> DataFrame:
    """Book rows with their place in the leg: heaviest first, ties by symbol."""
    side = F.when(F.col("weight") > 0, "LONG").otherwise("SHORT")
    place = Window.partitionBy("as_of", "leg").orderBy(F.abs("weight").desc(), "symbol")
    return book.where("weight != 0").withColumn("leg", side).withColumn("place", F.row_number().over(place))


def book_text(book: DataFrame) -> DataFrame:
    """(as_of, text): a readable summary of each date's book."""
    price = F.when(F.col("price") > 0, F.concat(F.lit(" $"), F.format_number("price", 2))).otherwise("")
    line = F.concat(F.format_string("  %-6s%+7.2f%%", "symbol", F.col("weight") * 100), price)
    lines = leg_listing(book).withColumn("line", line).groupBy("as_of").agg(*[
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("leg") == leg, F.struct("place", "line")))), lambda s: s["line"]), "\n").alias(leg)
        for leg in ("LONG", "SHORT")])
    e = exposures(book)
    head = F.format_string("book as of %s, gross %.2f net %+.2f", F.col("as_of").cast("string"), "gross_exposure",
                           "net_exposure")
    return lines.join(e, "as_of").select("as_of", F.concat_ws(
        "\n", head, F.lit("LONG:"), "LONG", F.lit("SHORT:"), "SHORT").alias("text"))


# ---- execution projections ---------------------------------------------------------

def atr_pct(df: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Barrier width known before the bar: lagged ATR-14 over the previous close, clipped.

    df: symbol, bar_no, high, low, close.
    """
    w = chunk_window()
    pc = F.lag("close").over(w)
    d = chunked(df, halo=17, size=size).withColumn("_pc", pc).withColumn("_tr", F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))))
    d = d.withColumn("_atr", roll_mean(F.col("_tr"), w, 14))
    raw = F.try_divide(F.lag("_atr").over(w), F.col("_pc"))
    return own_rows(d.withColumn("atr_pct", clip(raw, *ATR_BOUNDS))).drop("_pc", "_tr", "_atr")


def vol_scale(df: DataFrame, target_annual: float, size: int = CHUNK_ROWS) -> DataFrame:
    """Position multiplier towards a constant annual volatility, from information one bar old."""
    w = chunk_window()
    d = chunked(df, halo=23, size=size).withColumn("_r", lagged_return(F.col("close"), w, 1))
    d = d.withColumn("_sd", roll_std(F.col("_r"), w, 20))
    annual = F.lag("_sd").over(w) * (TRADING_DAYS ** 0.5)
    return own_rows(d.withColumn("vol_scale", clip(F.try_divide(F.lit(float(target_annual)), annual),
                                                   *VOL_SCALE_BOUNDS))).drop("_r", "_sd")


def target_shares(signal: str | Column, equity: float | Column, price: str | Column, pct: float = 0.05,
                  cap: int = 2000, scale: Column | None = None) -> Column:
    """Whole shares towards zero for a fractional signal."""
    s = F.col(signal) if isinstance(signal, str) else signal
    p = F.col(price) if isinstance(price, str) else price
    e = equity if isinstance(equity, Column) else F.lit(float(equity))
    notional = e * pct * (F.lit(1.0) if scale is None else F.coalesce(scale, F.lit(1.0)))
    shares = F.least((notional / p).cast("bigint"), F.lit(cap))
    return (s * shares).cast("bigint")


def fills(df: DataFrame, slippage_bps: float = 1.0, commission: float = 0.00005, size: int = CHUNK_ROWS) -> DataFrame:
    """Trades implied by a target position per bar: price, commission and spread cost of each change.

    df: symbol, ts, bar_no, close, spread, position.
    """
    w = chunk_window()
    delta = F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))
    d = own_rows(chunked(df, halo=1, size=size).withColumn("delta", delta)).where("delta != 0")
    spr = F.greatest(F.col("spread"), F.lit(0.01))
    side = F.signum(F.col("delta").cast("double"))
    slip = F.col("close") * (slippage_bps / 1e4)
    return d.select(
        "symbol", "ts", "bar_no", F.when(side > 0, "BUY").otherwise("SELL").alias("side"),
        F.abs("delta").alias("shares"), (F.col("close") + side * (spr / 2.0 + slip)).alias("fill_price"),
        (F.abs("delta") * commission).alias("commission"), (F.abs("delta") * spr / 2.0).alias("spread_cost"))


def barrier_exits(df: DataFrame, horizon: int, stop: str | Column, target: str | Column,
                  size: int = CHUNK_ROWS) -> DataFrame:
    """Triple-barrier label of an entry at each bar with side `side` (+1/-1) at the close.

    The first of the next `horizon` bars beyond target or stop decides; otherwise
    the vertical barrier.  Entries without `horizon` later bars get NULLs unless a
    price barrier was hit.
    """
    w = chunk_window()
    ahead = F.collect_list("close").over(w.rowsBetween(1, horizon))
    d = own_rows(chunked(df, ahead=horizon, size=size).withColumn("_path", ahead))
    up = F.col(target) if isinstance(target, str) else target
    dn = F.col(stop) if isinstance(stop, str) else stop
    d = d.withColumns({"_up": up, "_dn": dn})
    gains = F.transform("_path", lambda p: (p - F.col("close")) / F.col("close") * F.col("side"))
    d = d.withColumn("_gain", gains)
    hits = F.transform("_gain", lambda g: (g > F.col("_up")) | (g < -F.col("_dn")))
    first = F.array_position(hits, F.lit(True)).cast("int")
    d = d.withColumn("_at", first)
    gain = F.try_element_at("_gain", F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.lit(horizon)))
    full = F.size("_path") == horizon
    reason = F.when(F.col("_at") > 0, F.when(gain > F.col("_up"), "take_profit").otherwise("stop_loss")).when(
        full, "max_holding")
    bars = F.when(F.col("_at") > 0, F.col("_at")).when(full, horizon)
    return d.withColumns({"exit_reason": reason, "exit_bars": bars, "exit_gain": F.when(reason.isNotNull(), gain)}
                         ).drop("_path", "_gain", "_at", "_up", "_dn")


def bars_ahead(entries: DataFrame, bars: DataFrame, horizon: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each entry with each of the `horizon` bars after it, as `ahead` (1 to horizon) and `close_ahead`.

    A range join by equal keys: bars lie in buckets as wide as the horizon, an entry looks into two of them at most.  The plan
    doesn't grow with the horizon, and a symbol's rows are dealt by its buckets.  Requires bar_no on both sides.
    """
    at = F.col("bar_no")
    own = [F.col(k) for k in keys]
    looks = entries.withColumn("_b", F.explode(F.sequence(F.floor((at + 1) / horizon), F.floor((at + horizon) / horizon))))
    later = bars.select(*own, F.col("bar_no").alias("_n"), F.col("close").alias("close_ahead"), F.floor(at / horizon).alias("_b"))
    pairs = looks.join(later, [*keys, "_b"]).withColumn("ahead", (F.col("_n") - at).cast("int"))
    return pairs.where(F.col("ahead").between(1, horizon)).drop("_b", "_n")


def entry_exits(entries: DataFrame, bars: DataFrame, horizon: int, stop: str | Column, target: str | Column,
                keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Triple-barrier exits of given entries, for horizons too long to carry a row's whole path.

    entries: keys, bar_no (one row each), close, side, and any other columns, which stay; the rules are those of `barrier_exits`.
    """
    gain = (F.col("close_ahead") - F.col("close")) / F.col("close") * F.col("side")
    up, dn = (F.col(x) if isinstance(x, str) else x for x in (target, stop))
    own = entries.withColumns({"_up": up, "_dn": dn})
    hit = (gain > F.col("_up")) | (gain < -F.col("_dn"))
    # Numbers only: they are summed up in a hash table as pairs come, while a struct would have all pairs sorted first.
    found = bars_ahead(own, bars, horizon, keys).groupBy(*keys, "bar_no").agg(
        F.min(F.when(hit, F.col("ahead"))).alias("_hit"), F.count(F.lit(1)).alias("_have"))
    full = F.col("_have") == horizon
    was_hit = F.col("_hit").isNotNull()
    d = own.join(found, [*keys, "bar_no"], "left").withColumn("exit_bars", F.when(was_hit, F.col("_hit")).when(full, horizon))
    exits = bars.select(*[F.col(k) for k in keys], F.col("bar_no").alias("_at"), F.col("close").alias("close_ahead"))
    d = d.withColumn("_at", F.col("bar_no") + F.col("exit_bars")).join(exits, [*keys, "_at"], "left")
    reason = F.when(was_hit, F.when(gain > F.col("_up"), "take_profit").otherwise("stop_loss")).when(full, "max_holding")
    return d.withColumns({"exit_reason": reason, "exit_gain": gain}).select(
        *entries.columns, "exit_reason", "exit_bars", "exit_gain")
