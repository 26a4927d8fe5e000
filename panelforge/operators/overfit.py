"""Multiple-testing corrections: deflated Sharpe, overfitting probability and the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.scalars import clip, logit
from panelforge.functions.stats import bit_count_subsets, expected_max_sharpe, normal_cdf
from panelforge.operators.metrics import return_moments
from panelforge.operators.timeaxis import number_rows

DSR_THRESHOLD, BETA_LIMIT = 0.95, 0.1
MAX_SPLITS = 16


def deflated_sharpe(moments: DataFrame, n_trials: int, trial_var: str = "trial_var") -> DataFrame:
    """Add sr0, z, dsr, p_value to rows of `return_moments` that carry the trial variance."""
    sr0 = expected_max_sharpe(trial_var, n_trials)
    d = moments.withColumn("sr0", sr0)
    denom = 1.0 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1.0) / 4.0 * F.col("sr") * F.col("sr")
    z = (F.col("sr") - F.col("sr0")) * F.sqrt(F.col("t") - 1.0) / F.sqrt(denom)
    usable = (F.col("t") >= 4) & (F.col("sd0") > 0) & (denom > 0)
    d = d.withColumn("z", F.when(usable, z))
    few = F.col("t") < 4
    return d.withColumns({
        "sr": F.when(few, 0.0).otherwise(F.col("sr")), "sr0": F.when(few, 0.0).otherwise(F.col("sr0")),
        "dsr": F.coalesce(normal_cdf("z"), F.lit(0.0))}).withColumn("p_value", 1.0 - F.col("dsr"))


def best_trial(perf: DataFrame, config: str, order: str, r: str, n_trials: int, keys: Sequence[str] = ()) -> DataFrame:
    """Deflated Sharpe of the best of the trials (first on ties); trial variance over all of them.

    perf: keys, config, order (the trial's place in its grid), r (per-period return).
    """
    trials = return_moments(perf, r, [*keys, config, order])
    # Equal settings may differ in the last digits of their sums.
    pick = F.max_by(F.struct(*trials.columns), F.struct(F.round("sr", 12), -F.col(order)))
    # One row per trial here.
    best = trials.groupBy(*keys).agg(
        pick.alias("_b"), F.coalesce(F.var_samp("sr"), F.lit(0.0)).alias("trial_var"), F.count(F.lit(1)).alias("n_trials"))
    cols = [c for c in trials.columns if c not in keys]
    return deflated_sharpe(best.select(*keys, *[F.col(f"_b.{c}") for c in cols], "trial_var", "n_trials"), n_trials)


def block_sums(perf: DataFrame, config: str, obs: str, value: str, n_obs: int, bucket: str | None = None) -> tuple[DataFrame, int]:
    """Sum and count of each config over S nearly equal consecutive blocks of observations."""
    splits = min(MAX_SPLITS, n_obs - n_obs % 2)
    splits -= splits % 2
    if n_obs < 8 or splits < 4:
        raise ValueError(f"insufficient observations for the overfitting estimate ({n_obs})")
    small, longer = divmod(n_obs, splits)
    cut = longer * (small + 1)
    places = number_rows(perf.select(obs).distinct(), keys=(), order=(obs,), bucket=bucket or f"floor({obs} / 100000)",
                         out="_at")
    at = F.col("_at")
    block = F.when(at < cut, F.floor(at / (small + 1))).otherwise(longer + F.floor((at - cut) / small)).cast("int")
    b = perf.join(places, obs).groupBy(config, block.alias("block")).agg(
        F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    return b, splits


def split_means(perf: DataFrame, config: str, order: str, obs: str, value: str, n_obs: int,
                bucket: str | None = None) -> DataFrame:
    """Mean in and out of sample of every config (`_cfg`: order and config) in every symmetric split.

    Combinations are bitmasks exploded from an array literal; each config carries
    its few block sums as arrays, so nothing but the small summary is replicated.
    """
    blocks, splits = block_sums(perf.withColumn("_cfg", F.struct(order, config)), "_cfg", obs, value, n_obs, bucket)
    per_config = blocks.groupBy("_cfg").agg(F.array_sort(F.collect_list(F.struct("block", "s", "c"))).alias("b"))
    combos = per_config.select("_cfg", "b", F.explode(bit_count_subsets(splits, splits // 2)).alias("mask"))

    def mean(inside: int):
        part = F.filter("b", lambda x: F.getbit(F.col("mask"), x["block"]) == inside)
        total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["s"])
        n = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["c"])
        return total / n

    return combos.select("_cfg", "mask", mean(1).alias("is_mean"), mean(0).alias("oos_mean"))


def overfit_logits(perf: DataFrame, config: str, order: str, obs: str, value: str, n_obs: int,
                   bucket: str | None = None) -> DataFrame:
    """One row per symmetric split: the in-sample best config and its out-of-sample logit."""
    scored = split_means(perf, config, order, obs, value, n_obs, bucket)
    rank = F.row_number().over(Window.partitionBy("mask").orderBy("oos_mean", "_cfg"))
    best = scored.withColumn("oos_rank", rank).groupBy("mask").agg(
        F.max_by(F.struct("_cfg", "oos_rank"), F.struct("is_mean", -F.col(f"_cfg.{order}"))).alias("b"),
        F.count(F.lit(1)).alias("n_configs"))
    w = clip(F.col("b.oos_rank") / (F.col("n_configs") + 1), 1e-6, 1 - 1e-6)
    return best.select("mask", F.col(f"b._cfg.{config}").alias("best"), "n_configs", logit(w).alias("logit"))


def overfit_probability(logits: DataFrame) -> DataFrame:
    return logits.agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_combinations"))


def gate(summary: DataFrame) -> DataFrame:
    """Verdict of one-row-per-winner summaries carrying beta and dsr."""
    beta, dsr = F.col("beta"), F.col("dsr")
    verdict = (
        F.when(beta.isNull(), "beta undefined")
        .when(F.abs(beta) >= BETA_LIMIT, "beta outside limit")
        .when(dsr < DSR_THRESHOLD, "no significant edge")
        .otherwise("significant neutral edge"))
    return summary.withColumn("verdict", verdict).withColumn(
        "passed", beta.isNotNull() & (F.abs(beta) < BETA_LIMIT) & (dsr >= DSR_THRESHOLD))


def evaluate_grid(daily: DataFrame, betas: DataFrame, logits: DataFrame | None, n_trials: int) -> DataFrame:
    """Winner of the grid with its deflated Sharpe, realised beta, PBO and verdict."""
    best = best_trial(daily, "config", "config_no", "book_ret", n_trials)
    out = best.join(betas, "config", "left")
    if logits is not None:
        out = out.join(F.broadcast(overfit_probability(logits)))  # one row
    return gate(out)
