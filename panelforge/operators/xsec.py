"""Operators on one date's cross-section: normalisation, neutralisation, legs and weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.scalars import finite
from panelforge.operators.ranks import ROWS_PER_SORT, average_rank, group_ranks, largest_group
from panelforge.schema import CONFIG_GRID, CS_MODES, CS_SUFFIX, FEATURE_COLS, MIN_CS_NAMES

# Fixed thresholds of the book construction.
MIN_LEG_BETA = 0.1
MIN_BETA_COVERAGE = 0.8
MIN_SECTOR_NAMES = 4
CONVICTION_CAP = 2.0


def cross_sectional_normalize(panel: DataFrame, cols: Sequence[str] = FEATURE_COLS, date: str = "ts",
                              min_names: int = MIN_CS_NAMES, mode: str = "replace", name: str = "symbol", limit: int = ROWS_PER_SORT) -> DataFrame:
    """Each column's rank across its date, in [-1, 1]; NULL on dates with too few names.

    Dates that one task can hold are exchanged once, wide, and ranked column by column in numpy: a sort for each column would
    hold a copy of the wide rows each.  If there are larger ones, columns are ranked in long form, one date and column a
    group, which is cut as its size asks for.
    """
    if mode not in CS_MODES:
        raise ValueError(f"mode {mode!r} is not one of {CS_MODES}")
    if mode == "off":
        return panel
    if largest_group(panel, [date]) <= limit:
        return _ranked_dates(panel, list(cols), date, min_names, mode)
    entries = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_x")) for c in cols])
    long = panel.select(date, name, F.inline(entries)).where("_x is not null")
    ranked = group_ranks(long, [date, "_col"], "_x", spread=[name], limit=limit)
    ranked = ranked.withColumn("_r", 2.0 * average_rank() / F.col("n") - 1.0)
    wide = ranked.groupBy(date, name).agg(*[F.max(F.when(F.col("_col") == c, F.col("_r"))).alias(f"_r_{c}")
                                            for c in cols])
    sizes = panel.groupBy(date).agg(F.count(F.lit(1)).alias("_names"))
    out = panel.join(wide, [date, name], "left").join(sizes, date)
    wide_enough = F.col("_names") >= min_names
    target = {(c if mode == "replace" else c + CS_SUFFIX): F.when(wide_enough, F.col(f"_r_{c}")) for c in cols}
    if mode == "augment":
        target.update({c: F.when(wide_enough, F.col(c)) for c in cols})
    return out.withColumns(target).drop("_names", *[f"_r_{c}" for c in cols])


def _ranked_dates(panel: DataFrame, cols: list[str], date: str, min_names: int, mode: str) -> DataFrame:
    """Ranks of whole dates; the other columns pass through Arrow as they are."""
    kinds = {f.name: f.dataType for f in panel.schema.fields}
    suffix = "" if mode == "replace" else CS_SUFFIX
    kinds |= {c + suffix: T.DoubleType() for c in cols}

    def ranks(t: pa.Table) -> pa.Table:
        found = {name: t.column(name) for name in t.column_names}
        for c in cols:
            raw, place = found[c], np.full(t.num_rows, np.nan)
            known = raw.is_valid().to_numpy(zero_copy_only=False)
            if t.num_rows >= min_names and known.any():
                _, which, same = np.unique(raw.drop_null().to_numpy().astype(float), return_inverse=True, return_counts=True)
                place[known] = 2.0 * ((np.cumsum(same) - same)[which] + (same[which] + 1) / 2.0) / known.sum() - 1.0
            found[c + suffix] = pa.array(place, from_pandas=True)
            if mode == "augment" and t.num_rows < min_names:
                found[c] = pa.nulls(t.num_rows, raw.type)
        return pa.table({name: found[name] for name in kinds})

    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    return panel.groupBy(date).applyInArrow(ranks, schema)


def demean_target(panel: DataFrame, y: str, date: str = "ts", min_names: int = MIN_CS_NAMES) -> DataFrame:
    """Subtract each date's mean; dates with too few names are dropped."""
    means = panel.groupBy(date).agg(F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("_names")).where(
        F.col("_names") >= min_names)
    return panel.join(means, date).withColumn(y, F.col(y) - F.col("_mean")).drop("_mean", "_names")


def sector_neutralize(panel: DataFrame, sectors: DataFrame, pred: str = "pred", date: str = "ts",
                      min_names: int = MIN_SECTOR_NAMES) -> DataFrame:
    """Subtract the (date, sector) mean where the sector has enough live names.

    sectors: (symbol, sector), unique per symbol.  Names without a sector, thin
    sectors and NULL predictions pass through.
    """
    tagged = panel.join(sectors.select("symbol", "sector"), "symbol", "left")
    means = tagged.where("sector is not null").groupBy(date, "sector").agg(
        F.avg(pred).alias("_mean"), F.count(pred).alias("_live"))
    shift = F.when(F.col("_live") >= min_names, F.col("_mean")).otherwise(F.lit(0.0))
    return tagged.join(means, [date, "sector"], "left").withColumn(
        pred, F.col(pred) - F.coalesce(shift, F.lit(0.0))).drop("_mean", "_live", "sector")


@dataclass(frozen=True)
class BookConfig:
    """One book variant; a list of these is evaluated in one job."""

    decile: float = 0.1
    rebalance: int = 1
    gross: float = 1.0
    cost_bps: float = 5.0
    borrow_bps: float = 50.0
    min_names: int = 20
    start_cash: float = 100_000.0
    conviction: bool = False
    use_beta: bool = True

    @property
    def label(self) -> str:
        return f"d{self.decile:g}_r{self.rebalance}" + ("_conv" if self.conviction else "")


def config_grid(**fixed) -> list[BookConfig]:
    return [BookConfig(decile=d, rebalance=r, **fixed) for d, r in CONFIG_GRID]


def grid_column(grid: Sequence[BookConfig]) -> Column:
    """The grid as an array literal to explode: each row meets each variant without a join."""
    return F.array(*[
        F.struct(F.lit(c.label).alias("config"), F.lit(i).alias("config_no"),
                 *[F.lit(v).alias(k) for k, v in asdict(c).items()]) for i, c in enumerate(grid)])


def rank_panel(panel: DataFrame, pred: str = "pred", date: str = "ts") -> DataFrame:
    """Place of every finite prediction in its date (ties by symbol): columns n, pos."""
    return group_ranks(panel.withColumn(pred, finite(pred)), [date], pred, spread=["symbol"], tie=["symbol"])


def legs(ranked: DataFrame, grid: Sequence[BookConfig], dates: DataFrame | None = None, date: str = "ts",
         pred: str = "pred") -> DataFrame:
    """Members of both legs per variant: config columns, date, symbol, side, k, leg position.

    dates: optional (date, i); then a variant keeps only its rebalance dates.
    """
    widest = max(c.decile for c in grid)
    half = F.floor(F.col("n") / 2)
    reach = F.least(F.floor(F.col("n") * F.lit(widest)), half)
    edge = ranked.where(F.col("pos").isNotNull() & ((F.col("pos") < reach) | (F.col("pos") >= F.col("n") - reach)))
    if dates is not None:
        edge = edge.join(F.broadcast(dates), date)  # one row per date
    m = edge.select("*", F.inline(grid_column(grid))).withColumn(
        "k", F.least(F.floor(F.col("n") * F.col("decile")), half))
    side = F.when(F.col("pos") < F.col("k"), -1).when(F.col("pos") >= F.col("n") - F.col("k"), 1)
    m = m.withColumn("side", side).where("side is not null and n >= min_names and k >= 1")
    if dates is not None:
        m = m.where("i % rebalance = 0")
    return m.withColumn("leg_pos", F.when(F.col("side") > 0, F.col("pos") - (F.col("n") - F.col("k")))
                        .otherwise(F.col("pos")))


def date_medians(ranked: DataFrame, pred: str = "pred", date: str = "ts") -> DataFrame:
    """Median prediction per date, read off the ranks."""
    middle = F.col("pos").isin(-1) | (F.col("pos") == F.floor((F.col("n") - 1) / 2)) | (
        F.col("pos") == F.floor(F.col("n") / 2))
    return ranked.where(middle).groupBy(date).agg(F.avg(pred).alias("center"))


def target_weights(ranked: DataFrame, grid: Sequence[BookConfig], dates: DataFrame | None = None,
                   date: str = "ts", pred: str = "pred") -> DataFrame:
    """Non-zero weights of every variant: (config columns, date[, i], symbol, w).

    Leg notionals are equal, or solved so that the leg betas cancel where the beta
    coverage allows; a date whose solve is impossible stays flat.  `beta` must be a
    column of `ranked` unless no variant uses it.
    """
    if "beta" not in ranked.columns:
        ranked = ranked.withColumn("beta", F.lit(None).cast("double"))
    m = legs(ranked.withColumn("beta", finite("beta")), grid, dates, date, pred)
    by = ["config", date]
    up, down = F.col("side") > 0, F.col("side") < 0
    mid = (F.col("leg_pos") == F.floor((F.col("k") - 1) / 2)) | (F.col("leg_pos") == F.floor(F.col("k") / 2))
    has = F.col("beta").isNotNull().cast("double")
    stats = m.groupBy(*by).agg(
        F.avg(F.when(up, has)).alias("_cl"), F.avg(F.when(down, has)).alias("_cs"),
        F.avg(F.when(up, F.col("beta"))).alias("_bl"), F.avg(F.when(down, F.col("beta"))).alias("_bs"),
        F.avg(F.when(up & mid, F.col(pred))).alias("_ml"), F.avg(F.when(down & mid, F.col(pred))).alias("_ms"))
    m = m.join(F.broadcast(stats), by)  # one row per date and variant; the legs' rows stay where they are

    def thin(c: str) -> Column:
        return (F.col(c) > 0) & (F.col(c) < MIN_BETA_COVERAGE)

    equal = F.col("gross") / 2.0
    solvable = (F.col("_bl") > MIN_LEG_BETA) & (F.col("_bs") > MIN_LEG_BETA)
    other = F.when(up, F.col("_bs")).otherwise(F.col("_bl"))
    notional = F.when(~F.col("use_beta") | thin("_cl") | thin("_cs"), equal).when(
        solvable, F.col("gross") * other / (F.col("_bl") + F.col("_bs")))
    m = m.withColumn("notional", notional).where("notional is not null")
    share = F.lit(1.0) / F.col("k")
    if any(c.conviction for c in grid):
        # Leg members lie on one side of the median, so the median distance of a
        # leg is the distance of its median member.
        m = m.join(date_medians(ranked, pred, date), date)
        med = F.abs(F.when(up, F.col("_ml")).otherwise(F.col("_ms")) - F.col("center"))
        m = m.withColumn("_med", med).withColumn("_score", F.greatest(F.least(
            F.abs(F.col(pred) - F.col("center")), F.col("_med") * CONVICTION_CAP), F.col("_med") / CONVICTION_CAP))
        totals = m.groupBy(*by, "side").agg(F.sum("_score").alias("_total"))
        m = m.join(totals, [*by, "side"])
        share = F.when(F.col("conviction") & (F.col("_med") > 0), F.col("_score") / F.col("_total")).otherwise(share)
    m = m.withColumn("w", F.col("side") * F.col("notional") * share)
    helpers = ["_cl", "_cs", "_bl", "_bs", "_ml", "_ms", "_med", "_score", "_total", "center", "leg_pos", "notional"]
    return m.drop(*helpers)
