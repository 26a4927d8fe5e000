"""Panel evaluation: bars -> features -> scores -> books over the grid -> verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import book, metrics, overfit, quality, xsec
from panelforge.operators.features import daily_features, panel_returns
from panelforge.operators.models import LinearModel
from panelforge.schema import HORIZON
from panelforge.session import materialize

MIN_PANEL_BARS = 250


@dataclass
class PanelReport:
    daily: DataFrame
    diagnostics: DataFrame
    ic: DataFrame
    pooled_ic: DataFrame
    coverage: DataFrame
    verdict: DataFrame
    dropped: DataFrame


def build_panel(bars: DataFrame, benchmark: DataFrame, model: LinearModel, cs_mode: str = "off",
                min_bars: int = MIN_PANEL_BARS, benchmark_symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored panel, dropped symbols); both are written tables, the features are computed once."""
    universe = bars.select("symbol").distinct()
    usable = quality.min_history(bars, min_bars)
    feats = materialize(daily_features(usable, benchmark, benchmark_symbol), "features")
    dropped = materialize(quality.drop_ledger(universe, bars, feats, min_bars), "dropped")
    quality.check_universe(dropped, universe.count())
    rets = panel_returns(feats, benchmark).select("symbol", "ts", "ret", "beta")
    ready = feats if cs_mode == "off" else xsec.cross_sectional_normalize(feats, mode=cs_mode).na.drop(subset=model.cols)
    scored = model.score(ready).select("symbol", "ts", "close", "pred").join(rets, ["symbol", "ts"])
    panel = materialize(scored, "panel")
    if not panel.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise quality.UniverseError("duplicate (symbol, ts) in the panel")
    return panel, dropped


def evaluate(panel: DataFrame, benchmark_returns: DataFrame, dropped: DataFrame, sectors: DataFrame | None = None,
             grid: list[xsec.BookConfig] | None = None) -> PanelReport:
    """benchmark_returns: ts, bench_ret (the return a book earns from ts to the next bar)."""
    grid = grid or xsec.config_grid()
    book_panel = panel if sectors is None else xsec.sector_neutralize(panel, sectors)
    daily = materialize(book.run_book(book_panel, grid), "daily")
    n_obs = daily.agg(F.countDistinct("i")).first()[0]
    logits = overfit.overfit_logits(daily, "config", "config_no", "i", "book_ret", n_obs) if n_obs >= 8 else None
    verdict = overfit.evaluate_grid(daily, metrics.book_beta(daily, benchmark_returns), logits, len(grid))
    fwd = metrics.dated_forward_returns(panel, [HORIZON], ["pred"])
    return PanelReport(daily, book.book_diagnostics(daily), metrics.ic_decay(panel),
                       metrics.pooled_ic(fwd, "pred", "fwd"), metrics.names_coverage(panel), verdict, dropped)
