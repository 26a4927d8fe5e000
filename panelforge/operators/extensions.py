"""Where a user's own code enters: scorers and decisions by name, models that are no expression, a table function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.scans import holding_filter
from panelforge.operators.signals import execution_lag, predictor_signal, quantile_decision

MODEL_BYTES = 256 << 20  # the largest model that is broadcast

Scorer = Callable[[DataFrame], DataFrame]  # adds `pred`
Decision = Callable[[DataFrame], DataFrame]  # adds `signal` to a frame with `pred`, rows numbered by `bar_no`
SCORERS: dict[str, Scorer] = {"stored": lambda df: df}
DECISIONS: dict[str, Decision] = {
    "threshold": predictor_signal,
    "conviction": lambda df: predictor_signal(df, conviction=True),
    "quantile": lambda df: quantile_decision(df, "pred"),
}


def register_scorer(name: str, scorer: Scorer) -> None:
    SCORERS[name] = scorer


def register_decision(name: str, decision: Decision) -> None:
    DECISIONS[name] = decision


def _applied(df: DataFrame, step: str | Callable, known: dict[str, Callable], adds: str) -> DataFrame:
    if isinstance(step, str) and step not in known:
        raise ValueError(f"unknown name {step!r}; registered: {', '.join(sorted(known))}")
    got = (known[step] if isinstance(step, str) else step)(df)
    lost = [c for c in (*df.columns, adds) if c not in got.columns]
    if lost:
        raise ValueError(f"{step!r} returns no column {', '.join(lost)}")
    return got


def score(df: DataFrame, scorer: str | Scorer) -> DataFrame:
    """Apply a scorer by name; it must keep the columns of its input and return `pred`."""
    return _applied(df, scorer, SCORERS, "pred")


def decide(df: DataFrame, decision: str | Decision) -> DataFrame:
    """Apply a decision by name; it must keep the columns of its input and return `signal`."""
    return _applied(df, decision, DECISIONS, "signal")


def positions(df: DataFrame, scorer: str | Scorer, decision: str | Decision = "threshold", holding: int = 5) -> DataFrame:
    """Score, decide, hold and lag with steps given by name or as functions.  Requires bar_no."""
    return execution_lag(holding_filter(decide(score(df, scorer), decision), "signal", holding, out="_held"), "_held").drop("_held")


def function_scorer(predict: Callable[[np.ndarray], np.ndarray], cols: Sequence[str], out: str = "pred", missing: str = "zero",
                    classes: int | None = None, max_bytes: int = MODEL_BYTES) -> Scorer:
    """A scorer from a fitted model's own function over a matrix of rows by `cols`.

    The function is sent to the workers once, by broadcast, after a check of its size; only `cols` pass through Arrow.
    missing: what a feature that is NULL, NaN or infinite does: "zero" puts 0 in its place, "null" leaves the row's
    score NULL and doesn't show the row to the model, "raise" fails.  With `classes` the function gives as many columns
    and the score is an array.  A score that isn't finite becomes NULL; for an array, as a whole.
    """
    if missing not in ("zero", "null", "raise"):
        raise ValueError(f"missing is 'zero', 'null' or 'raise', not {missing!r}")
    packed = cloudpickle.dumps(predict)
    if len(packed) > max_bytes:
        raise ValueError(f"the model takes {len(packed):,} bytes, more than the {max_bytes:,} that are broadcast")
    cols = list(cols)

    def scorer(df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(packed)

        @F.pandas_udf("double" if classes is None else "array<double>")
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = cloudpickle.loads(shared.value)
            for rows in batches:
                x = rows.to_numpy(dtype=float, na_value=np.nan)
                known = np.isfinite(x)
                use = known.all(axis=1)
                if missing == "raise" and not use.all():
                    raise ValueError("a feature is missing")
                if missing == "zero":
                    x, use = np.where(known, x, 0.0), np.ones(len(x), bool)
                y = np.full((len(x), classes or 1), np.nan)
                if use.any():
                    y[use] = np.asarray(model(x[use]), float).reshape(-1, classes or 1)
                good = np.isfinite(y).all(axis=1)
                found = y[:, 0] if classes is None else list(y)
                yield pd.Series([v if ok else None for v, ok in zip(found, good, strict=True)],
                                dtype="Float64" if classes is None else object)

        return df.withColumn(out, run(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])))

    return scorer


class SplitLogit:
    """Best variant in sample of each split and its logit out of sample, from a table with columns mask, config,
    config_no, is_mean and oos_mean, partitioned by mask and ordered by (oos_mean, config_no).

    Rows pass one at a time; nothing but the best so far is kept.  A NULL mean is the lowest; ties go to the smaller
    config_no.
    """

    def __init__(self) -> None:
        self._n, self._best = 0, None

    def eval(self, row: Row) -> None:
        self._n += 1
        inside = row["is_mean"]
        key = (inside is not None, inside or 0.0, -row["config_no"])
        if self._best is None or key > self._best[0]:
            self._best = key, row["mask"], row["config"], self._n

    def terminate(self) -> Iterator[tuple]:
        if self._best is not None:
            _, mask, config, rank = self._best
            w = rank / (self._n + 1)
            yield mask, config, self._n, math.log(w / (1 - w))


def register_functions(spark: SparkSession) -> None:
    """Make `split_logit(TABLE(...) PARTITION BY mask ORDER BY (oos_mean, config_no))` known to SQL."""
    spark.udtf.register("split_logit", F.udtf(SplitLogit, returnType="mask int, best string, n_configs bigint, logit double"))
