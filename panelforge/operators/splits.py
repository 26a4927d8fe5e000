"""Leakage-safe splits on global dates and walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.timeaxis import number_rows
from panelforge.schema import HORIZON


class SplitError(ValueError):
    """Not enough dates for the requested split and embargo."""


def _indexed_dates(df: DataFrame, date: str) -> DataFrame:
    dates = number_rows(df.select(date).distinct(), keys=(), order=(date,), bucket=f"year({date})", out="_i")
    # One row per date.
    return dates.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))


def date_roles(df: DataFrame, date: str = "ts", train_frac: float = 0.8, train_end: str | None = None,
               embargo: int = HORIZON, val_frac: float | None = None) -> DataFrame:
    """(date, role) with role train / val / test; embargoed dates are left out.

    The cut is a position among the distinct dates (or the first date >= train_end);
    `embargo` dates after it, and before a validation slice, belong to no side.
    """
    d = _indexed_dates(df, date)
    if train_end is None:
        d = d.withColumn("_cut", F.floor(F.col("_n") * F.lit(train_frac)))
    else:
        before = F.count_if(F.col(date) < F.lit(train_end).cast("date")).over(Window.partitionBy(F.lit(0)))
        d = d.withColumn("_cut", before)
    i, cut = F.col("_i"), F.col("_cut")
    if val_frac is None:
        role = F.when(i < cut, "train")
    else:
        val_start = cut - F.greatest(F.floor(cut * F.lit(val_frac)), F.lit(1))
        role = F.when(i < val_start - embargo, "train").when((i >= val_start) & (i < cut), "val")
    role = F.coalesce(role, F.when(i >= cut + embargo, "test"))
    return d.withColumn("role", role).where("role is not null").select(date, "role")


def split_panel(df: DataFrame, date: str = "ts", **how) -> DataFrame:
    """Rows with their role; every symbol shares the same boundary dates."""
    return df.join(date_roles(df, date, **how), date)


def split_bounds(roles: DataFrame, date: str = "ts") -> DataFrame:
    """First and last date per role, and the cutoff to record: the day before testing starts."""
    b = roles.groupBy("role").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"),
                                  F.countDistinct(date).alias("n_dates"))
    return b.withColumn("recorded_train_end", F.when(F.col("role") == "test", F.date_sub("first_date", 1)))


def check_split(bounds: DataFrame) -> None:
    roles = {r["role"] for r in bounds.select("role").collect()}  # at most three rows
    if not {"train", "test"} <= roles:
        raise SplitError(f"split produced only {sorted(roles)}")


@dataclass(frozen=True)
class FoldConfig:
    train: int = 504
    test: int = 63
    step: int = 21
    embargo: int = HORIZON
    alpha: float = 10.0

    @property
    def length(self) -> int:
        return self.train + self.embargo + self.test


def fold_starts(df: DataFrame, cfg: FoldConfig) -> DataFrame:
    """(symbol, fold, start): every complete fold of each symbol; bar_no numbers the usable rows."""
    n = df.groupBy("symbol").agg((F.max("bar_no") + 1).alias("_n")).where(F.col("_n") >= cfg.length)
    last = F.floor((F.col("_n") - cfg.length) / cfg.step)
    return n.select("symbol", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("fold")).withColumn(
        "start", F.col("fold") * cfg.step)


def fold_rows(df: DataFrame, cfg: FoldConfig) -> DataFrame:
    """Rows labelled with every fold they serve: fold, offset in the fold, role train / embargo / test.

    Each row computes its own fold numbers; the fold table only confirms them.
    """
    b = F.col("bar_no")
    first = F.greatest(F.ceil((b - cfg.length + 1) / cfg.step), F.lit(0)).cast("bigint")
    tagged = df.withColumn("fold", F.explode(F.sequence(first, F.floor(b / cfg.step)))).withColumn(
        "offset", b - F.col("fold") * cfg.step).where(F.col("offset") < cfg.length)
    role = F.when(F.col("offset") < cfg.train, "train").when(
        F.col("offset") < cfg.train + cfg.embargo, "embargo").otherwise("test")
    complete = fold_starts(df, cfg).select("symbol", "fold")
    return tagged.join(complete, ["symbol", "fold"], "left_semi").withColumn("role", role)


def fold_bounds(df: DataFrame, cfg: FoldConfig, date: str = "ts") -> DataFrame:
    """Date bounds of every fold from its four boundary rows."""
    edges = {"train_start": 0, "train_end": cfg.train - 1, "test_start": cfg.train + cfg.embargo,
             "test_end": cfg.length - 1}
    marks = fold_starts(df, cfg).select("symbol", "fold", F.inline(F.array(*[
        F.struct(F.lit(k).alias("edge"), (F.col("start") + v).alias("bar_no")) for k, v in edges.items()])))
    hit = marks.join(df.select("symbol", "bar_no", date), ["symbol", "bar_no"])
    return hit.groupBy("symbol", "fold").agg(*[F.max(F.when(F.col("edge") == k, F.col(date))).alias(k) for k in edges])
