"""Statistics as aggregate or column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.scalars import col
from panelforge.schema import TRADING_DAYS

EULER_GAMMA = 0.5772156649015329


def per_period_sharpe(r: str | Column) -> Column:
    sd = F.stddev_samp(col(r))
    return F.when(sd > 0, F.avg(col(r)) / sd).otherwise(F.lit(0.0))


def annual_sharpe(r: str | Column) -> Column:
    return per_period_sharpe(r) * math.sqrt(TRADING_DAYS)


def sortino(r: str | Column, target: float = 0.0) -> Column:
    """Annualised; the downside deviation is taken over every observation."""
    short = F.least(col(r) - F.lit(float(target)), F.lit(0.0))
    dd = F.sqrt(F.avg(short * short))
    return F.when(dd > 0, F.avg(col(r)) / dd * math.sqrt(TRADING_DAYS)).otherwise(F.lit(0.0))


def ols_beta(y: str | Column, x: str | Column, min_obs: int) -> Column:
    """Slope of y on x over complete pairs; NULL when short or when x does not vary."""
    both = col(y).isNotNull() & col(x).isNotNull()
    xv, yv = F.when(both, col(x)), F.when(both, col(y))
    var = F.var_samp(xv)
    return F.when((F.count(xv) >= min_obs) & (var > 0), F.covar_samp(xv, yv) / var)


def expected_max_sharpe(trial_var: str | Column, n_trials: int) -> Column:
    """Expected best Sharpe of n skill-less trials; the two normal quantiles are constants of n."""
    if n_trials < 2:
        return F.lit(0.0)
    norm = NormalDist()
    z = (1.0 - EULER_GAMMA) * norm.inv_cdf(1.0 - 1.0 / n_trials) + EULER_GAMMA * norm.inv_cdf(
        1.0 - 1.0 / (n_trials * math.e)
    )
    v = col(trial_var)
    return F.when(v > 0, F.sqrt(v) * z).otherwise(F.lit(0.0))


def normal_cdf(x: str | Column) -> Column:
    """Standard normal CDF to double precision from built-ins.

    Central range: the Maclaurin series of erf, whose terms are folded with
    Horner's rule.  Tails: the continued fraction of the Mills ratio.
    """
    z = F.greatest(F.least(col(x), F.lit(38.0)), F.lit(-38.0))
    z = F.when(col(x).isNotNull(), z)
    square = z * z
    series = F.lit(1.0)
    for n in range(70, 0, -1):
        # 1 + z^2/3 (1 + z^2/5 (1 + ...)), innermost term first
        series = F.lit(1.0) + square / float(2 * n + 1) * series
    density = F.exp(square / -2.0) / math.sqrt(2.0 * math.pi)
    centre = F.lit(0.5) + z * density * series
    far = F.greatest(F.abs(z), F.lit(1.0))
    frac = far
    for n in range(60, 0, -1):
        frac = far + F.lit(float(n)) / frac
    tail = density / frac
    return F.when(F.abs(z) <= 4.0, centre).when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def bit_count_subsets(bits: int, size: int) -> Column:
    """Array of every bitmask over `bits` positions with exactly `size` set."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda m: F.bit_count(m) == size)
