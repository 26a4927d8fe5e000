"""Scaling, fitting and scoring of forecast models on long panels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from panelforge.operators.metrics import class_weights
from panelforge.operators.ranks import column_quantiles, exact_quantiles
from panelforge.operators.signals import trailing_thresholds
from panelforge.operators.splits import FoldConfig
from panelforge.operators.timeaxis import number_rows
from panelforge.schema import FALLBACK_QUANTILE, FALLBACK_WINDOW, SWEEP_QUANTILES, SWEEP_WINDOWS
from panelforge.session import materialize

CLIP = 5.0
ENET_L1_RATIOS = [0.1, 0.5, 0.9]
#: Rows of a task of a boosted fit, at most; it holds them binned, at about 200 bytes each.
BOOST_ROWS = 2_000_000


# ---- scalers ------------------------------------------------------------------------

def robust_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, center, scale): median and interquartile range, exact and interpolated.

    All columns share the passes of one wide table; NULLs count as 0, as in the model matrix.  A zero range scales by 1.
    """
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    q = column_quantiles(filled, cols, [0.25, 0.5, 0.75])
    wide = q.groupBy("feature").agg(*[F.max(F.when(F.col("q") == v, F.col("value"))).alias(n)
                                      for v, n in ((0.25, "lo"), (0.5, "center"), (0.75, "hi"))])
    spread = F.col("hi") - F.col("lo")
    return wide.select("feature", "center", F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


def zscore_fit(df: DataFrame, cols: Sequence[str], fit_end: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(feature, center, scale) over each symbol's first `fit_end` rows, shared by all symbols; needs bar_no."""
    warm = df.where(F.col("bar_no") < fit_end)
    row = warm.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.m").alias("center"),
                                 F.when(F.col(f"{c}.s") > 0, F.col(f"{c}.s")).otherwise(1.0).alias("scale")) for c in cols])
    return row.select(F.inline(entries))


def scale_params(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The scaler as numbers: one row per feature."""
    return {r["feature"]: (r["center"], r["scale"]) for r in scaler.collect()}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]], clip: float | None = CLIP) -> DataFrame:
    scaled = {}
    for c, (m, s) in params.items():
        z = f"(coalesce({c}, 0D) - {m!r}D) / {s!r}D"
        scaled[c] = F.expr(z if clip is None else f"greatest(least({z}, {clip}D), -{clip}D)")
    return df.withColumns(scaled)


# ---- estimators -----------------------------------------------------------------------

@dataclass
class LinearModel:
    """What a served linear model needs; scoring is a projection."""

    cols: list[str]
    coef: list[float]
    intercept: float
    scaler: dict[str, tuple[float, float]]

    def score(self, df: DataFrame, out: str = "pred") -> DataFrame:
        terms = [f"{self.intercept!r}D"]
        for c, b in zip(self.cols, self.coef):
            m, s = self.scaler[c]
            terms.append(f"{b!r}D * greatest(least((coalesce({c}, 0D) - {m!r}D) / {s!r}D, {CLIP}D), -{CLIP}D)")
        return df.selectExpr("*", f"{' + '.join(terms)} AS {out}")


def fit_ridge(train: DataFrame, cols: Sequence[str], y: str, alpha: float = 10.0,
              params: dict[str, tuple[float, float]] | None = None) -> LinearModel:
    """Penalised least squares |y - Xb|^2 + alpha |b|^2 on robust-scaled, clipped features.

    The normal equations are accumulated by the executors, in one pass.  `params` is a frozen scaler; by default it is
    fitted here.
    """
    cols = list(cols)
    params = params or scale_params(robust_fit(train, cols))
    moments = block_moments(train.where(F.col(y).isNotNull()), cols, y, params)
    if not moments:
        return LinearModel(cols, [0.0] * len(cols), None, params)
    cov, cross, mean, my, n = _centred(moments[0])
    # Without a penalty, columns may be combinations of others: the shortest solution is taken.
    b = np.linalg.lstsq(n * cov + alpha * np.eye(len(cols)), n * cross, rcond=None)[0]
    return LinearModel(cols, [float(v) for v in b], float(my - mean @ b), params)


def scaled_columns(batch: pa.RecordBatch, cols: Sequence[str], params: dict[str, tuple[float, float]]) -> np.ndarray:
    """The matrix of `apply_scaler`, a row for each column: NULLs count as 0 before scaling, and NaN is the greatest of all."""
    out = np.empty((len(cols), batch.num_rows))
    for z, c in zip(out, cols):
        m, s = params[c]
        x = batch.column(c)
        np.clip(((x.fill_null(0.0) if x.null_count else x).to_numpy() - m) / s, -CLIP, CLIP, out=z)
        z[np.isnan(z)] = CLIP
    return out


def block_moments(df: DataFrame, cols: Sequence[str], y: str, params: dict[str, tuple[float, float]], block: str | None = None
                  ) -> dict[int, np.ndarray]:
    """Per block the matrix of sums of products of (1, scaled cols, y); the executors add up, one matrix per block comes back.

    Without `block` there is one, numbered 0.
    """
    names, number = [*cols, y], "_moment_block"
    width = len(names) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            m = np.vstack([np.ones(batch.num_rows), scaled_columns(batch, cols, params), batch.column(y).to_numpy()[None, :]])
            of = batch.column(number).to_numpy()
            for k in np.unique(of):
                own = m if (of == k).all() else m[:, of == k]
                sums[int(k)] = sums.get(int(k), 0) + own @ own.T
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width * width, k)), pa.array(np.arange(width * width), pa.int32()), pa.array(m.ravel())],
                                             names=["block", "place", "v"])

    rows = df.select((F.lit(0) if block is None else F.col(block)).cast("long").alias(number), *[F.col(c).cast("double").alias(c) for c in names])
    total = rows.mapInArrow(partial, "block long, place int, v double").groupBy("block", "place").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in total.collect():  # blocks * (features + 2)^2 numbers
        out.setdefault(r["block"], np.zeros(width * width))[r["place"]] = r["v"]
    return {k: v.reshape(width, width) for k, v in out.items()}


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Covariance of the features, with y, means, mean of y, count."""
    n, mean = m[0, 0], m[0, 1:-1] / m[0, 0]
    my = m[0, -1] / n
    return m[1:-1, 1:-1] / n - np.outer(mean, mean), m[1:-1, -1] / n - mean * my, mean, my, n


def elastic_path(m: np.ndarray, penalties: Sequence[float], ratio: float, rounds: int = 1000, tol: float = 1e-9) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) for falling penalties, by coordinate descent on the moments, each started from the last.

    Minimises |y - Xb - c|^2 / 2n + penalty * (ratio |b|_1 + (1 - ratio) / 2 |b|^2).
    """
    cov, cross, mean, my, _ = _centred(m)
    b, out = np.zeros(len(cross)), []
    for penalty in penalties:
        for _ in range(rounds):
            moved = 0.0
            for j in range(len(b)):
                r = cross[j] - cov[j] @ b + cov[j, j] * b[j]
                new = np.sign(r) * max(abs(r) - penalty * ratio, 0.0) / max(cov[j, j] + penalty * (1 - ratio), 1e-300)
                moved, b[j] = max(moved, abs(new - b[j])), new
            if moved <= tol:
                break
        out.append((b.copy(), float(my - mean @ b)))
    return out


def _squared_error(m: np.ndarray, b: np.ndarray, c: float) -> float:
    w = np.array([-c, *-b, 1.0])
    return float(w @ m @ w / m[0, 0])


def fit_elastic_net(train: DataFrame, cols: Sequence[str], y: str, date: str = "ts", folds: int = 3,
                    n_alphas: int = 20, l1_ratios: Sequence[float] = ENET_L1_RATIOS) -> tuple[LinearModel, dict]:
    """Elastic net with penalty and mixing chosen on expanding date folds of the training rows.

    Every fold, penalty and mixing is solved from the moments of a few blocks of dates, so the rows are read once.
    Penalties fall geometrically from the least that zeroes all coefficients to a thousandth of it.  The folds
    hold equal numbers of dates at the end; the dates left over join the first block, which is only ever fitted on.
    """
    cols = list(cols)
    params = scale_params(robust_fit(train, cols))
    labelled = train.where(F.col(y).isNotNull())
    dates = number_rows(labelled.select(date).distinct(), keys=(), order=(date,), bucket=f"year({date})", out="_i")
    total = dates.count()
    width = max(total // (folds + 1), 1)
    block = F.greatest(F.floor((F.col("_i") - (total - folds * width)) / width) + 1, F.lit(0)).cast("long")
    moments = block_moments(labelled.join(dates, date).withColumn("_block", block), cols, y, params, "_block")
    ordered = [moments[k] for k in sorted(moments)]
    whole = sum(ordered)
    _, cross, *_ = _centred(whole)
    best = None
    for ratio in l1_ratios:
        top = float(np.abs(cross).max()) / ratio or 1.0
        path = [top * 10 ** (-3 * k / max(n_alphas - 1, 1)) for k in range(n_alphas)]
        errors = np.zeros(n_alphas)
        for f in range(1, len(ordered)):
            fitted = elastic_path(sum(ordered[:f]), path, ratio)
            errors += [_squared_error(ordered[f], b, c) for b, c in fitted]
        k = int(errors.argmin())
        if best is None or errors[k] < best[0]:
            best = (errors[k], ratio, k, path)
    _, ratio, k, path = best
    b, c = elastic_path(whole, path[:k + 1], ratio)[-1]
    return LinearModel(cols, [float(v) for v in b], c, params), {"regParam": path[k], "l1_ratio": ratio}


@dataclass
class ScaledModel:
    """A fitted estimator and the scaler its features pass first; NULLs count as 0 before scaling."""

    model: object
    cols: list[str]
    scaler: dict[str, tuple[float, float]]

    def arrays(self, df: DataFrame, out: str) -> DataFrame:
        """Features scaled and clipped, as an array beside the row's own columns; scaled in numpy."""
        n, passed = len(self.cols), df.columns
        own = {c: f"_z{i}" for i, c in enumerate(self.cols)}
        params = {z: self.scaler[c] for c, z in own.items()}

        def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = scaled_columns(batch, list(params), params)
                a = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(z.T).ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], a], names=[*passed, out])

        copies = df.withColumns({z: F.col(c).cast("double") for c, z in own.items()})
        return copies.mapInArrow(scale, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))

    def vectors(self, df: DataFrame) -> DataFrame:
        """Features scaled and clipped as a vector beside the row's own columns."""
        return self.arrays(df, "_a").withColumn("_x", array_to_vector("_a")).drop("_a")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.vectors(df))


def _fitted(train: DataFrame, cols: Sequence[str], beside: Sequence[str], make) -> ScaledModel:
    """make(data) fits on a table of `_x`, the scaled, clipped features, and the columns beside; it is written once, as fits read it several times."""
    out = ScaledModel(None, list(cols), scale_params(robust_fit(train, list(cols))))
    # The features themselves are not passed on beside the array.
    names = {c: f"_f{i}" for i, c in enumerate(cols)}
    plain = ScaledModel(None, list(names.values()), {names[c]: v for c, v in out.scaler.items()})
    rows = train.select(*beside, *[F.col(c).alias(n) for c, n in names.items()])
    data = materialize(plain.arrays(rows, "_a").select(*beside, "_a"), "scaled_rows")
    out.model = make(data.select(array_to_vector("_a").alias("_x"), *beside))
    return out


def _for_rounds(d: DataFrame) -> DataFrame:
    """Rows of a fit that passes over them thousands of times: as many tasks as run at once, or a multiple where those would be large.

    Every pass starts each task twice, so more tasks than cores cost time in every pass.  So do tasks of unequal size: parts are
    put together only where that leaves them about equal.
    """
    cores = d.sparkSession.sparkContext.defaultParallelism
    tasks, parts = cores * max(math.ceil(d.count() / (BOOST_ROWS * cores)), 1), d.rdd.getNumPartitions()
    return d.coalesce(tasks) if parts >= tasks and (parts % tasks == 0 or parts > 8 * tasks) else d.repartition(tasks)


def fit_boosted(train: DataFrame, cols: Sequence[str], y: str, max_iter: int = 300) -> ScaledModel:
    est = GBTRegressor(featuresCol="_x", labelCol=y, maxIter=max_iter, maxDepth=3, stepSize=0.1,
                       subsamplingRate=0.85, minInstancesPerNode=5, seed=42)
    return _fitted(train.where(F.col(y).isNotNull()), cols, [y], lambda d: est.fit(_for_rounds(d)))


def fit_logistic(train: DataFrame, cols: Sequence[str], label: str, weighting: str = "none", inverse_penalty: float = 1.0) -> ScaledModel:
    """The penalty is 1 / (inverse_penalty * total weight), as the estimator's loss is a weighted mean."""
    weighted = class_weights(train, label, weighting)

    def make(d: DataFrame):
        n = d.agg(F.sum("weight")).first()[0] or 1.0
        return LogisticRegression(featuresCol="_x", labelCol=label, weightCol="weight", family="multinomial",
                                  regParam=1.0 / (inverse_penalty * n), maxIter=100).fit(d)

    return _fitted(weighted, cols, [label, "weight"], make)


def fit_forest(train: DataFrame, cols: Sequence[str], label: str, weighting: str = "sqrt", trees: int = 200) -> ScaledModel:
    est = RandomForestClassifier(featuresCol="_x", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=5, seed=42)
    return _fitted(class_weights(train, label, weighting), cols, [label, "weight"], est.fit)


@dataclass
class OneAgainstRest:
    """A boosted binary model for each class; a class's score is its model's probability over the sum of all."""

    models: list[object]
    scaled: ScaledModel

    def score(self, df: DataFrame, out: str = "proba") -> DataFrame:
        """Add `out`: scores by class, which sum to 1.  Classes that training never saw score 0."""
        d = self.scaled.vectors(df)
        raw = []
        for k, m in enumerate(self.models):
            if m is None:
                raw.append(F.lit(0.0))
                continue
            own = {"rawPredictionCol": f"_raw{k}", "probabilityCol": f"_p{k}", "predictionCol": f"_y{k}"}
            d = m.transform(d, {m.getParam(name): c for name, c in own.items()}).withColumn(f"_p{k}", vector_to_array(f"_p{k}")[1]).drop(f"_raw{k}", f"_y{k}")
            raw.append(F.col(f"_p{k}"))
        total = raw[0]
        for x in raw[1:]:
            total = total + x
        proba = F.array(*[F.when(total > 0, x / total).otherwise(1.0 / len(raw)) for x in raw])
        return d.withColumn(out, proba).drop("_x", *[f"_p{k}" for k in range(len(raw))])


def fit_boosted_classes(train: DataFrame, cols: Sequence[str], label: str, weighting: str = "none", classes: int = 3, rounds: int = 200,
                        depth: int = 4, rate: float = 0.03) -> OneAgainstRest:
    """Boosted trees for several classes, each against the rest, on the scaled features and with the class weights of all classes.

    Rows with a NULL label take no part.  The scaled rows are written once for all fits.
    """
    base = ScaledModel(None, list(cols), scale_params(robust_fit(train.where(F.col(label).isNotNull()), list(cols))))
    weighted = class_weights(train.where(F.col(label).isNotNull()), label, weighting)
    data = base.arrays(weighted, "_a").select(F.col(label).cast("int").alias("_label"), "weight", "_a")
    data = _for_rounds(materialize(data, "class_rows"))
    seen = {r["_label"] for r in data.select("_label").distinct().limit(classes + 1).collect()}

    def one(k: int):
        if k not in seen:
            return None
        est = GBTClassifier(featuresCol="_x", labelCol="_is", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate,
                            subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=2, seed=42)
        return est.fit(data.select(array_to_vector("_a").alias("_x"), "weight", (F.col("_label") == k).cast("double").alias("_is")))

    # The fits are independent, and most of a round is waiting for its small jobs.
    with ThreadPool(classes) as pool:
        return OneAgainstRest(pool.map(inheritable_thread_target(train.sparkSession)(one), range(classes)), base)


def score_regressor(model: ScaledModel, df: DataFrame, out: str = "pred") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out).drop("_x")


def score_classifier(model: ScaledModel, df: DataFrame, out: str = "proba") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")).drop("_x", "rawPrediction", "probability", "prediction")


# ---- per-fold fits ----------------------------------------------------------------------

def ridge_solve(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Closed form with an unpenalised intercept."""
    mx, my = x.mean(axis=0), y.mean()
    xc = x - mx
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - my))
    return b, float(my - mx @ b)


def _fit_window(x: np.ndarray, y: np.ndarray, n_train: int, alpha: float) -> np.ndarray:
    """Scale and fit on the first n_train rows, predict every row of the window."""
    lo, mid, hi = np.percentile(x[:n_train], [25, 50, 75], axis=0)
    scale = np.where(hi > lo, hi - lo, 1.0)
    z = np.clip((x - mid) / scale, -CLIP, CLIP)
    b, c = ridge_solve(z[:n_train], y[:n_train], alpha)
    return z @ b + c


def _fit_folds(x: np.ndarray, y: np.ndarray, n_train: int, alpha: float) -> np.ndarray:
    """`_fit_window` of many windows at once: x is (folds, rows, features), y and the result (folds, rows)."""
    lo, mid, hi = np.percentile(x[:, :n_train], [25, 50, 75], axis=1)[:, :, None, :]
    z = np.clip((x - mid) / np.where(hi > lo, hi - lo, 1.0), -CLIP, CLIP)
    zt, yt = z[:, :n_train], y[:, :n_train]
    mz, my = zt.mean(axis=1), yt.mean(axis=1)
    zc = (zt - mz[:, None, :]).transpose(0, 2, 1)
    b = np.linalg.solve(zc @ zc.transpose(0, 2, 1) + alpha * np.eye(x.shape[2]), zc @ (yt - my[:, None])[:, :, None])
    return (z @ b)[:, :, 0] + (my - (mz[:, None, :] @ b)[:, 0, 0])[:, None]


def _over_folds(df: DataFrame, cols: Sequence[str], y: str, cfg: FoldConfig, finish, fields: str, per_task: int = 16) -> DataFrame:
    """(symbol, *fields) that finish(folds, bar numbers, forecasts, y) makes of the folds of a group, all (folds, rows) but the first.

    A task receives the rows of `per_task` neighbouring folds once, instead of
    each fold's rows separately; its size is bounded by the fold geometry.
    """
    cols = list(cols)
    b = F.col("bar_no")
    stride = cfg.step * per_task
    reach = cfg.step * (per_task - 1) + cfg.length
    first = F.greatest(F.ceil((b - reach + 1) / stride), F.lit(0)).cast("bigint")
    data = df.select("symbol", "bar_no", F.col(y).alias("y"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    tasks = data.withColumn("_task", F.explode(F.sequence(first, F.floor(b / stride))))
    names = ["symbol", *[f.split()[0] for f in fields.split(", ")]]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, task = key
        found = min((len(pdf) - cfg.length) // cfg.step + 1, per_task)
        if found < 1:
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values("bar_no")

        def windows(a: np.ndarray) -> np.ndarray:
            return sliding_window_view(a, cfg.length, axis=0)[::cfg.step][:found]

        bars, yy = windows(pdf["bar_no"].to_numpy()), windows(pdf["y"].to_numpy(float))
        x = windows(pdf[cols].to_numpy(float)).transpose(0, 2, 1)
        folds = int(task) * per_task + np.arange(found)
        return pd.DataFrame({"symbol": symbol, **finish(folds, bars, _fit_folds(x, yy, cfg.train, cfg.alpha), yy)})

    return tasks.groupBy("symbol", "_task").applyInPandas(run, f"symbol string, {fields}")


def fold_predictions(df: DataFrame, cols: Sequence[str], y: str, cfg: FoldConfig, per_task: int = 16) -> DataFrame:
    """(symbol, fold, bar_no, offset, pred, y): out-of-sample and warm-up forecasts of every fold."""
    def finish(folds: np.ndarray, bars: np.ndarray, pred: np.ndarray, yy: np.ndarray) -> dict:
        return {"fold": np.repeat(folds, cfg.length), "bar_no": bars.ravel(), "offset": np.tile(np.arange(cfg.length), len(folds)),
                "pred": pred.ravel(), "y": yy.ravel()}

    return _over_folds(df, cols, y, cfg, finish, "fold bigint, bar_no bigint, offset bigint, pred double, y double", per_task)


def _rank_correlations(x: np.ndarray, y: np.ndarray, active: np.ndarray, min_rows: int) -> np.ndarray:
    """Spearman of the active rows by fold and setting, 0 where undefined; x, y are (folds, rows), active (folds, settings, rows)."""
    a = active.astype(float)
    n = a.sum(axis=2)

    def centred_ranks(v: np.ndarray) -> np.ndarray:
        below, same = v[:, None, :] < v[:, :, None], v[:, None, :] == v[:, :, None]
        # Twice the average rank, so that sums are of whole numbers.
        twice = a @ (2.0 * below + same).transpose(0, 2, 1) + 1
        return (twice - (n + 1)[:, :, None]) * a

    rx, ry = centred_ranks(x), centred_ranks(y)
    mean = (a @ x[:, :, None])[:, :, 0] / np.maximum(n, 1)
    sd = np.sqrt((((x[:, None, :] - mean[:, :, None]) ** 2) * a).sum(axis=2) / np.maximum(n, 1))
    moves = (ry != 0).any(axis=2)
    defined = (n >= min_rows) & (sd >= 1e-12) & moves
    norm = np.sqrt((rx * rx).sum(axis=2) * (ry * ry).sum(axis=2))
    return np.where(defined & (norm > 0), (rx * ry).sum(axis=2) / np.where(norm > 0, norm, 1.0), 0.0)


def fold_scores(df: DataFrame, cols: Sequence[str], y: str, cfg: FoldConfig) -> DataFrame:
    """(symbol, fold, n, ic, dir_acc): IC and directional accuracy on each fold's test rows.

    A fold is scored where it is fitted, so its forecasts are neither written nor exchanged.
    """
    def finish(folds: np.ndarray, bars: np.ndarray, pred: np.ndarray, yy: np.ndarray) -> dict:
        p, t = pred[:, cfg.train + cfg.embargo:], yy[:, cfg.train + cfg.embargo:]
        ic = _rank_correlations(p, t, np.ones((len(folds), 1, cfg.test), bool), 2)[:, 0]
        return {"fold": folds, "n": cfg.test, "ic": ic, "dir_acc": (np.sign(p) == np.sign(t)).mean(axis=1)}

    return _over_folds(df, cols, y, cfg, finish, "fold bigint, n bigint, ic double, dir_acc double")


def config_ic_matrix(df: DataFrame, cols: Sequence[str], y: str, cfg: FoldConfig, quantiles: Sequence[float] = SWEEP_QUANTILES,
                     windows: Sequence[int] = SWEEP_WINDOWS, min_active: int = 5) -> DataFrame:
    """(symbol, fold, config_no, quantile, window, ic) of every fold and decision setting.

    A fold and setting with too few active rows scores 0.  Folds are scored where they are fitted.
    """
    settings = [(float(q), int(k)) for q in quantiles for k in windows]
    tested = cfg.train + cfg.embargo

    def finish(folds: np.ndarray, bars: np.ndarray, pred: np.ndarray, yy: np.ndarray) -> dict:
        p, t = pred[:, tested:], yy[:, tested:]
        thr = {k: trailing_thresholds(np.abs(pred), k, quantiles, start=tested) for k in windows}
        fires = np.stack([np.abs(p) > thr[k][:, :, list(quantiles).index(q)] for q, k in settings], axis=1) & (p != 0)[:, None, :]
        n = len(folds)
        return {"fold": np.repeat(folds, len(settings)), "config_no": np.tile(np.arange(len(settings)), n),
                "quantile": np.tile([q for q, _ in settings], n), "window": np.tile([k for _, k in settings], n),
                "ic": _rank_correlations(p, t, fires, min_active).ravel()}

    return _over_folds(df, cols, y, cfg, finish, "fold bigint, config_no int, quantile double, window int, ic double")


def sweep(matrix: DataFrame) -> DataFrame:
    """Setting with the best median IC over folds (first on ties), or the fallback when none is positive."""
    med = exact_quantiles(matrix, "ic", [0.5], ["config_no", "quantile", "window"]).withColumnRenamed("value", "median_ic")
    best = med.agg(F.max_by(F.struct("quantile", "window"), F.struct("median_ic", -F.col("config_no"))).alias("b"),
                   F.max("median_ic").alias("median_ic"))
    good = F.col("median_ic") > 0
    return best.select(F.when(good, F.col("b.quantile")).otherwise(FALLBACK_QUANTILE).alias("quantile"),
                       F.when(good, F.col("b.window")).otherwise(FALLBACK_WINDOW).alias("window"), "median_ic")


def in_session_fit(df: DataFrame, cols: Sequence[str], y: str, alpha: float = 10.0, embargo: int = 3) -> DataFrame:
    """80/20 fit per symbol with an embargo; rows before the test part predict 0.  Needs bar_no.

    The fit is a set of sums per symbol: only its cross products leave the executors'
    partial aggregates, and they are solved one small matrix per symbol.
    """
    cols = list(cols)
    n = df.groupBy("symbol").agg((F.max("bar_no") + 1).alias("_n"))
    d = df.join(n, "symbol").withColumn("_split", F.floor(F.col("_n") * 0.8))
    train = d.where((F.col("bar_no") < F.col("_split")) & F.col(y).isNotNull())
    filled = train.select("symbol", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    q = column_quantiles(filled, cols, [0.25, 0.5, 0.75], ["symbol"])
    params = q.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("@", "feature", F.col("q").cast("string")), "value"))).alias("_p"))

    def z(c: str) -> Column:
        lo, mid, hi = (F.col("_p")[f"{c}@{v}"] for v in ("0.25", "0.5", "0.75"))
        s = F.when(hi > lo, hi - lo).otherwise(1.0)
        return F.greatest(F.least((F.coalesce(F.col(c), F.lit(0.0)) - mid) / s, F.lit(CLIP)), F.lit(-CLIP))

    scaled = d.join(params, "symbol", "left").withColumns({f"_z_{c}": z(c) for c in cols}).drop("_p")
    used = (F.col("bar_no") < F.col("_split")) & F.col(y).isNotNull()
    k, names = len(cols), [*[f"_z_{c}" for c in cols], y]
    cross = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = scaled.where(used).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(a) for a in names]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in cross]).alias("cov"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            coef = []
            for count, means, cov in zip(pdf["n"], pdf["means"], pdf["cov"]):
                m = np.zeros((k + 1, k + 1))
                m[np.triu_indices(k + 1)] = cov
                m = (m + np.triu(m, 1).T) * count
                b = np.linalg.solve(m[:k, :k] + alpha * np.eye(k), m[:k, k])
                coef.append([*b, means[k] - np.dot(means[:k], b)])
            yield pd.DataFrame({"symbol": pdf["symbol"], "coef": coef})

    models = sums.mapInPandas(solve, "symbol string, coef array<double>")
    pred = F.col("coef")[k]
    for i, c in enumerate(cols):
        pred = pred + F.col("coef")[i] * F.col(f"_z_{c}")
    tested = F.col("bar_no") >= F.col("_split") + embargo
    return scaled.join(models, "symbol", "left").withColumn("pred", F.when(tested, F.coalesce(pred, F.lit(0.0))).otherwise(0.0)).drop(
        "_n", "_split", "coef", *[f"_z_{c}" for c in cols])
