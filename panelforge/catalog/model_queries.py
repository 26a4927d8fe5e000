"""Signals, splits, models (inventory G, L, M5-M8)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from panelforge.catalog.base import (
    ORACLES, SQL_BARS, SQL_PANEL, SQL_TICKS, bars, cols_sql, features, out, panel, query, r_sql, staged, table, ticks,
)
from panelforge.catalog.eval_queries import SQL_PBO
from panelforge.catalog.feature_queries import SQL_FEATURES
from panelforge.functions import scalars as sc
from panelforge.functions.stats import EULER_GAMMA
from panelforge.operators import features as feats
from panelforge.operators import extensions, metrics, models, signals, splits, xsec
from panelforge.operators.timeaxis import number_rows
from panelforge.plans import eval_report
from panelforge.schema import FEATURE_COLS, LABEL, SWEEP_QUANTILES, SWEEP_WINDOWS

_X = ["rsi_14", "adx_14"]
FOLD = splits.FoldConfig(train=100, test=21, step=7)


def numbered_panel(spark, sf):
    return number_rows(panel(spark, sf).drop("bar_no"))


_THR = """thr AS (SELECT *, CASE WHEN count(pred) OVER f >= {m} THEN quantile_cont(abs(pred), {q}) OVER f END AS t FROM panel1
  WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING))"""


# ---- signals -----------------------------------------------------------------------

@query("g01_predictor_signal", f"""WITH {SQL_PANEL}, {_THR.format(m=20, q=0.7, w=60)}
  SELECT symbol, ts, CASE WHEN abs(pred) > t THEN CAST(sign(pred) AS INT) ELSE 0 END AS signal FROM thr""")
def predictor_signal(spark, sf):
    return signals.predictor_signal(numbered_panel(spark, sf)).select("symbol", "ts", "signal")


@query("g01_conviction_signal", f"""WITH {SQL_PANEL}, {_THR.format(m=20, q=0.6, w=40)}
  SELECT symbol, ts, {r_sql('CASE WHEN abs(pred) > t THEN sign(pred) * least(abs(pred) / (2 * t), 1) ELSE 0 END', 'signal')} FROM thr""")
def conviction_signal(spark, sf):
    return out(signals.predictor_signal(numbered_panel(spark, sf), quantile=0.6, window=40, conviction=True), ["symbol", "ts"], ["signal"])


@query("g02_quantile_decision", f"""WITH {SQL_PANEL}, {_THR.format(m=1, q=0.7, w=63)}
  SELECT symbol, ts, CASE WHEN abs(pred) >= t THEN CAST(sign(pred) AS INT) ELSE 0 END AS signal FROM thr""")
def quantile_decision(spark, sf):
    return signals.quantile_decision(numbered_panel(spark, sf), "pred").select("symbol", "ts", "signal")


SQL_PROBA = SQL_TICKS + """, pr AS (SELECT l_orderkey, l_linenumber, l_partkey, symbol, [l_discount * 5, l_tax * 5, 1 - l_discount * 5 - l_tax * 5] AS p,
  [2, 0, 1] AS classes FROM ticks)"""
_ID = ["l_orderkey", "l_linenumber", "l_partkey", "symbol"]


def proba(spark, sf):
    d, t = F.col("l_discount") * 5, F.col("l_tax") * 5
    return ticks(spark, sf).select(*_ID, F.array(d, t, 1 - d - t).alias("p"), F.array(F.lit(2), F.lit(0), F.lit(1)).alias("classes"))


@query("g03_threshold_decision", f"""WITH {SQL_PROBA}, s AS (SELECT *, classes[list_position(p, list_max(p))] - 1 AS score FROM pr)
  SELECT {', '.join(_ID)}, CAST(CASE WHEN list_max(p) < 0.55 THEN 0 ELSE sign(score) END AS INT) AS signal, score::DOUBLE AS score FROM s""")
def threshold_decision(spark, sf):
    """Class scores through the model's own class order (G9), then the confidence threshold."""
    s = proba(spark, sf).withColumn("score", signals.class_scores("p", "classes"))
    return s.select(*_ID, signals.threshold_decision("score", "p").alias("signal"), "score")


SQL_GATE = """CASE WHEN greatest(p[1], p[2], p[3]) - least(p[1], p[2], p[3]) >= 0.3 AND p[2] = greatest(p[1], p[2], p[3]) AND p[2] - p[1] > 0.1 THEN 'BUY'
  WHEN greatest(p[1], p[2], p[3]) - least(p[1], p[2], p[3]) >= 0.3 AND p[3] = greatest(p[1], p[2], p[3]) AND p[3] - p[1] > 0.1 THEN 'SELL' ELSE 'HOLD' END"""


@query("g04_action_values", f"""WITH {SQL_PROBA} SELECT {', '.join(_ID)}, {SQL_GATE} AS gate,
  CASE {SQL_GATE} WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS signal,
  {r_sql('least(greatest((greatest(p[1], p[2], p[3]) - least(p[1], p[2], p[3]) + 1) / 2, 0), 1)', 'confidence')} FROM pr""")
def action_values(spark, sf):
    """Gate, decision and confidence over action values."""
    p = F.col("p")
    q = proba(spark, sf).select(*_ID, sc.q_gate(p[0], p[1], p[2], 0.3, 0.1).alias("gate"), signals.q_decision("p", 0.3, 0.1).alias("signal"),
                                sc.q_confidence(p[0], p[1], p[2]).alias("confidence"))
    return out(q, [*_ID, "gate", "signal"], ["confidence"])


@query("g05_strategy_positions", f"""WITH RECURSIVE {SQL_PANEL}, {_THR.format(m=20, q=0.7, w=60)},
  s AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, CASE WHEN abs(pred) > t THEN sign(pred) ELSE 0 END::INT AS sig FROM thr),
  h AS (SELECT symbol, i, ts, sig::DOUBLE AS pos, CASE WHEN sig <> 0 THEN 0 ELSE 99 END AS age FROM s WHERE i = 1 UNION ALL
    SELECT s.symbol, s.i, s.ts, CASE WHEN sign(s.sig) <> sign(h.pos) AND (h.pos = 0 OR h.age + 1 >= 5) THEN s.sig::DOUBLE ELSE h.pos END,
      CASE WHEN sign(s.sig) <> sign(h.pos) AND (h.pos = 0 OR h.age + 1 >= 5) AND s.sig <> 0 THEN 0 ELSE h.age + 1 END
    FROM h JOIN s ON s.symbol = h.symbol AND s.i = h.i + 1)
  SELECT symbol, ts, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY i), 0) AS position FROM h""")
def strategy_positions(spark, sf):
    """Score, decide, hold, lag."""
    return signals.strategy_positions(numbered_panel(spark, sf)).select("symbol", "ts", "position")


# A scorer of a user's own, known by its name: forecasts that grow ever more slowly, as a function over a matrix.
_DAMPED = extensions.function_scorer(lambda x: x[:, 0] / (1 + abs(x[:, 0])), ["pred"], "pred", missing="null")


@query("g05_named_strategy", f"""WITH RECURSIVE {SQL_PANEL.replace("panel1 AS (SELECT * FROM panel", "panel1 AS (SELECT * REPLACE (pred / (1 + abs(pred)) AS pred) FROM panel")}, {_THR.format(m=1, q=0.7, w=63)},
  s AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, CASE WHEN abs(pred) >= t THEN sign(pred) ELSE 0 END::INT AS sig FROM thr),
  h AS (SELECT symbol, i, ts, sig::DOUBLE AS pos, CASE WHEN sig <> 0 THEN 0 ELSE 99 END AS age FROM s WHERE i = 1 UNION ALL
    SELECT s.symbol, s.i, s.ts, CASE WHEN sign(s.sig) <> sign(h.pos) AND (h.pos = 0 OR h.age + 1 >= 3) THEN s.sig::DOUBLE ELSE h.pos END,
      CASE WHEN sign(s.sig) <> sign(h.pos) AND (h.pos = 0 OR h.age + 1 >= 3) AND s.sig <> 0 THEN 0 ELSE h.age + 1 END
    FROM h JOIN s ON s.symbol = h.symbol AND s.i = h.i + 1)
  SELECT symbol, ts, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY i), 0) AS position FROM h""")
def named_strategy(spark, sf):
    """Score by a registered function, decide by name, hold, lag (2.15)."""
    extensions.register_scorer("damped", _DAMPED)
    return extensions.positions(numbered_panel(spark, sf), "damped", "quantile", holding=3).select("symbol", "ts", "position")


@query("g07_live_regressor", f"""WITH {SQL_PANEL}, {_THR.format(m=20, q=0.7, w=60)}, c AS (SELECT *, list(abs(pred)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS w,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM thr)
  SELECT symbol, ts, CASE WHEN abs(pred) > t THEN CASE WHEN pred > 0 THEN 'BUY' ELSE 'SELL' END ELSE 'HOLD' END AS signal,
  {r_sql('len(list_filter(w, lambda v: v <= abs(pred)))::DOUBLE / len(w)', 'confidence')}, {r_sql('pred', 'predicted_return')} FROM c WHERE rn = 1""")
def live_regressor(spark, sf):
    return out(signals.live_regressor(numbered_panel(spark, sf)), ["symbol", "ts", "signal"], ["confidence", "predicted_return"])


@query("g08_live_classifier", f"""WITH {SQL_PROBA} SELECT {', '.join(_ID)}, CASE WHEN list_max(p) < 0.6 THEN 'HOLD' ELSE ['SELL', 'HOLD', 'BUY'][list_position(p, list_max(p))] END AS signal,
  {r_sql('list_max(p)', 'confidence')}, NULL::VARCHAR AS error FROM pr""")
def live_classifier(spark, sf):
    """Signal and confidence per row; malformed rows would carry an error."""
    return out(signals.live_classifier(proba(spark, sf), "p", 0.6), [*_ID, "signal", "error"], ["confidence"])


@query("m07_probability_blend", f"""WITH {SQL_PROBA}, a AS (SELECT *, [p[2], p[3], p[1]] AS aligned FROM pr),
  b AS (SELECT *, [0.7::DOUBLE * aligned[i] + 0.3::DOUBLE * p[i] FOR i IN [1, 2, 3]] AS bl FROM a)
  SELECT {', '.join(_ID)}, {', '.join(r_sql(f'bl[{i + 1}]', f'b{i}') for i in range(3))},
  CASE WHEN round(list_max(bl), 9) < 0.6 THEN 'HOLD' ELSE ['SELL', 'HOLD', 'BUY'][list_position(list_transform(bl, lambda v: round(v, 9)), round(list_max(bl), 9))] END AS signal FROM b""")
def probability_blend(spark, sf):
    """Class realignment, blend, argmax and threshold."""
    b = proba(spark, sf).withColumn("bl", sc.blend(sc.align_classes("p", "classes"), "p", 0.7))
    b = b.withColumn("rb", F.transform("bl", lambda v: F.round(v, 9)))
    b = b.select(*_ID, *[F.col("bl")[i].alias(f"b{i}") for i in range(3)], sc.class_decision("rb", 0.6).alias("signal"))
    return out(b, [*_ID, "signal"], ["b0", "b1", "b2"])


# ---- splits -------------------------------------------------------------------------

SQL_DATES = """d0 AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM panel1)),
  roles AS (SELECT ts, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i >= floor(n * 0.8::DOUBLE) + 3 THEN 'test' END AS role FROM d0)"""


@query("l01_global_split", f"WITH {SQL_PANEL}, {SQL_DATES} SELECT symbol, ts, role FROM panel1 JOIN roles USING (ts) WHERE role IS NOT NULL")
def global_split(spark, sf):
    return splits.split_panel(panel(spark, sf)).select("symbol", "ts", "role")


@query("l01_split_bounds", f"""WITH {SQL_PANEL}, d0 AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM panel1)),
  c AS (SELECT count(*) FILTER (ts < DATE '2000-01-01') AS cut FROM d0), roles AS (SELECT ts, CASE WHEN i < cut THEN 'train' WHEN i >= cut + 3 THEN 'test' END AS role FROM d0, c)
  SELECT role, min(ts) AS first_date, max(ts) AS last_date, count(*) AS n_dates, CASE WHEN role = 'test' THEN min(ts) - 1 END AS recorded_train_end
  FROM roles WHERE role IS NOT NULL GROUP BY role""")
def split_bounds(spark, sf):
    return splits.split_bounds(splits.date_roles(panel(spark, sf), train_end="2000-01-01"))


@query("l02_three_way_split", f"""WITH {SQL_PANEL}, d0 AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM panel1)),
  c AS (SELECT *, floor(n * 0.8::DOUBLE) AS cut FROM d0), v AS (SELECT *, cut - greatest(floor(cut * 0.15::DOUBLE), 1) AS vs FROM c),
  r AS (SELECT ts, CASE WHEN i < vs - 3 THEN 'train' WHEN i >= vs AND i < cut THEN 'val' WHEN i >= cut + 3 THEN 'test' END AS role FROM v)
  SELECT role, min(ts) AS first_date, max(ts) AS last_date, count(*) AS n FROM r JOIN panel1 USING (ts) WHERE role IS NOT NULL GROUP BY role""")
def three_way_split(spark, sf):
    s = splits.split_panel(panel(spark, sf), val_frac=0.15)
    return s.groupBy("role").agg(F.min("ts").alias("first_date"), F.max("ts").alias("last_date"), F.count(F.lit(1)).alias("n"))


SQL_FOLDS = f"""pn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS b, count(*) OVER (PARTITION BY symbol) AS n FROM panel1),
  fo AS (SELECT DISTINCT symbol, n, UNNEST(range(0, CASE WHEN n >= {FOLD.length} THEN (n - {FOLD.length}) // {FOLD.step} + 1 ELSE 0 END)) AS fold FROM pn),
  fr AS (SELECT f.symbol, f.fold, p.ts, p.b - f.fold * {FOLD.step} AS off, p.pred, p.ret, p.ret_1d, p.close FROM fo f JOIN pn p ON p.symbol = f.symbol
    AND p.b >= f.fold * {FOLD.step} AND p.b < f.fold * {FOLD.step} + {FOLD.length})"""


@query("l03_walk_forward_folds", f"""WITH {SQL_PANEL}, {SQL_FOLDS} SELECT symbol, fold, min(ts) AS train_start, max(ts) FILTER (off = {FOLD.train - 1}) AS train_end,
  max(ts) FILTER (off = {FOLD.train + 3}) AS test_start, max(ts) AS test_end FROM fr GROUP BY symbol, fold""")
def walk_forward_folds(spark, sf):
    return splits.fold_bounds(numbered_panel(spark, sf), FOLD)


@query("l03_fold_roles", f"""WITH {SQL_PANEL}, {SQL_FOLDS} SELECT symbol, CASE WHEN off < {FOLD.train} THEN 'train' WHEN off < {FOLD.train + 3} THEN 'embargo' ELSE 'test' END AS role,
  count(*) AS n, count(DISTINCT fold) AS n_folds FROM fr GROUP BY 1, 2""")
def fold_roles(spark, sf):
    r = splits.fold_rows(numbered_panel(spark, sf), FOLD)
    return r.groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("n_folds"))


# ---- fold fits: one feature, so that the solution has a closed form in SQL ---------------

SQL_FIT = f"""{SQL_FOLDS}, use AS (SELECT * FROM fr WHERE ret IS NOT NULL), sc AS (SELECT symbol, fold, median(pred) FILTER (off < {FOLD.train}) AS m,
    quantile_cont(pred, 0.75) FILTER (off < {FOLD.train}) - quantile_cont(pred, 0.25) FILTER (off < {FOLD.train}) AS s FROM fr GROUP BY 1, 2),
  z AS (SELECT f.*, greatest(least((pred - m) / s, 5), -5) AS z FROM fr f JOIN sc USING (symbol, fold)),
  co AS (SELECT symbol, fold, covar_pop(z, y) * count(*) / (var_pop(z) * count(*) + 10) AS b, avg(z) AS mz, avg(y) AS my
    FROM (SELECT *, ret AS y FROM z) WHERE off < {FOLD.train} GROUP BY 1, 2),
  fp AS (SELECT z.*, my + b * (z - mz) AS p FROM z JOIN co USING (symbol, fold))"""
# The label of a symbol's last row is unknown, so folds are cut on the labelled rows.
SQL_LABELLED = SQL_PANEL.replace("panel1 AS (SELECT * FROM panel WHERE pred IS NOT NULL)", "panel1 AS (SELECT * FROM panel WHERE pred IS NOT NULL AND ret IS NOT NULL)")


def labelled_panel(spark, sf):
    return number_rows(panel(spark, sf).drop("bar_no").where("ret is not null"))


def fold_ics(spark, sf):
    return staged(spark, sf, "fold_ics", lambda: models.config_ic_matrix(labelled_panel(spark, sf), ["pred"], "ret", FOLD, _Q, _W))


def _fold_ic(x: str, y: str) -> str:
    return f"""CASE WHEN stddev_pop({x}) >= 1e-12 AND stddev_pop({y}) > 0 THEN corr(rx, ry) ELSE 0 END"""


@query("l04_fold_scores", f"""WITH {SQL_LABELLED}, {SQL_FIT}, k AS (SELECT *, rank() OVER (PARTITION BY symbol, fold ORDER BY p) + (count(*) OVER (PARTITION BY symbol, fold, p) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY symbol, fold ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, fold, ret) - 1) / 2.0::DOUBLE AS ry FROM fp WHERE off >= {FOLD.train + 3})
  SELECT symbol, fold, count(*) AS n, {r_sql(_fold_ic('p', 'ret'), 'ic', 5)}, {r_sql('avg((sign(p) = sign(ret))::INT)', 'dir_acc', 5)} FROM k GROUP BY symbol, fold""")
def fold_scores(spark, sf):
    """Scale, ridge, IC and directional accuracy of every walk-forward fold."""
    return out(models.fold_scores(labelled_panel(spark, sf), ["pred"], "ret", FOLD), ["symbol", "fold", "n"], ["ic", "dir_acc"], 5)


_Q, _W = SWEEP_QUANTILES, SWEEP_WINDOWS


def _matrix_sql() -> str:
    ts = []
    for w in _W:
        for q in _Q:
            ts.append(f"CASE WHEN count(p) OVER f{w} >= 20 THEN quantile_cont(abs(p), {q}) OVER f{w} END AS t_{round(q * 100)}_{w}")
    wins = ", ".join(f"f{w} AS (PARTITION BY symbol, fold ORDER BY off ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in _W)
    opts = ", ".join("{'config_no': %d, 'quantile': %s::DOUBLE, 'win': %d, 't': t_%d_%d}" % (i * len(_W) + j, q, w, round(q * 100), w)
                     for i, q in enumerate(_Q) for j, w in enumerate(_W))
    return f"""{SQL_FIT}, th AS (SELECT *, {', '.join(ts)} FROM fp WINDOW {wins}),
  op AS (SELECT symbol, fold, p, ret, UNNEST([{opts}], recursive := true) FROM th WHERE off >= {FOLD.train + 3}),
  rk AS (SELECT *, rank() OVER (PARTITION BY symbol, fold, config_no ORDER BY p) + (count(*) OVER (PARTITION BY symbol, fold, config_no, p) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY symbol, fold, config_no ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, fold, config_no, ret) - 1) / 2.0::DOUBLE AS ry FROM op WHERE abs(p) > t AND p <> 0),
  ci AS (SELECT symbol, fold, config_no, CASE WHEN count(*) >= 5 THEN {_fold_ic('p', 'ret')} ELSE 0 END AS ic FROM rk GROUP BY ALL),
  mx AS (SELECT o.symbol, o.fold, o.config_no, o.quantile, o.win, coalesce(ic, 0) AS ic FROM (SELECT DISTINCT symbol, fold, config_no, quantile, win FROM op) o LEFT JOIN ci USING (symbol, fold, config_no))"""


@query("l05_config_ic_matrix", f"WITH {SQL_LABELLED}, {_matrix_sql()} SELECT symbol, fold, config_no, quantile, CAST(win AS INT) AS window, {r_sql('ic', digits=5)} FROM mx")
def config_ic_matrix(spark, sf):
    return out(fold_ics(spark, sf), ["symbol", "fold", "config_no", "quantile", "window"], ["ic"], 5)


@query("l06_parameter_sweep", f"""WITH {SQL_LABELLED}, {_matrix_sql()}, md AS (SELECT config_no, quantile, win, median(ic) AS m FROM mx GROUP BY ALL),
  b AS (SELECT * FROM md ORDER BY m DESC, config_no LIMIT 1)
  SELECT CASE WHEN m > 0 THEN quantile ELSE 0.7::DOUBLE END AS quantile, CAST(CASE WHEN m > 0 THEN win ELSE 60 END AS INT) AS window, {r_sql('m', 'median_ic', 5)} FROM b""")
def parameter_sweep(spark, sf):
    return out(models.sweep(fold_ics(spark, sf)), ["quantile", "window"], ["median_ic"], 5)


# ---- scalers and models ------------------------------------------------------------------

@query("l07_robust_scaler", f"""WITH {SQL_FEATURES}, q AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, median({c}) AS center, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS scale FROM feats" for c in FEATURE_COLS)})
  SELECT feature, {r_sql('center', digits=5)}, {r_sql('scale', digits=5)} FROM q""")
def robust_scaler(spark, sf):
    return out(models.robust_fit(features(spark, sf), FEATURE_COLS), ["feature"], ["center", "scale"], 5)


_SCALED = ", ".join(f"greatest(least(({c} - (SELECT median({c}) FROM feats)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM feats), 5), -5) AS {c}" for c in _X)


@query("l07_scaled_features", f"WITH {SQL_FEATURES}, z AS (SELECT symbol, ts, {_SCALED} FROM feats) SELECT symbol, ts, {cols_sql(_X, 5)} FROM z")
def scaled_features(spark, sf):
    f = features(spark, sf)
    return out(models.apply_scaler(f, models.scale_params(models.robust_fit(f, _X))), ["symbol", "ts"], _X, 5)


# Two features: the ridge solution is Cramer's rule on the centred moments.
@query("l08_ridge", f"""WITH {SQL_FEATURES}, z AS (SELECT symbol, ts, fwd_ret_1d AS y, {_SCALED} FROM feats),
  s AS (SELECT count(*) AS n, avg({_X[0]}) AS m1, avg({_X[1]}) AS m2, avg(y) AS my, var_pop({_X[0]}) * count(*) + 10 AS a, var_pop({_X[1]}) * count(*) + 10 AS d,
    covar_pop({_X[0]}, {_X[1]}) * count(*) AS b, covar_pop({_X[0]}, y) * count(*) AS u, covar_pop({_X[1]}, y) * count(*) AS v FROM z WHERE y IS NOT NULL),
  w AS (SELECT *, (u * d - b * v) / (a * d - b * b) AS w1, (a * v - b * u) / (a * d - b * b) AS w2 FROM s)
  SELECT symbol, ts, {r_sql(f'my + w1 * ({_X[0]} - m1) + w2 * ({_X[1]} - m2)', 'pred', 5)} FROM z, w""")
def ridge(spark, sf):
    """Distributed normal equations, then scoring as a projection."""
    f = features(spark, sf)
    # The scaler of this query is fitted on every row, labelled or not.
    model = models.fit_ridge(f, _X, LABEL, params=models.scale_params(models.robust_fit(f, _X)))
    return out(model.score(f), ["symbol", "ts"], ["pred"], 5)


def _as_function(m: models.LinearModel):
    centre, scale = np.array([m.scaler[c] for c in m.cols]).T
    coef, intercept, clip = np.array(m.coef), m.intercept, models.CLIP
    return lambda x: np.clip((x - centre) / scale, -clip, clip) @ coef + intercept


@query("l13_function_scoring", ORACLES["l08_ridge"])
def function_scoring(spark, sf):
    """The ridge model as an opaque function, broadcast and applied to Arrow batches."""
    f = features(spark, sf)
    model = models.fit_ridge(f, _X, LABEL, params=models.scale_params(models.robust_fit(f, _X)))
    return out(extensions.function_scorer(_as_function(model), _X)(f), ["symbol", "ts"], ["pred"], 5)


def _split(spark, sf):
    return staged(spark, sf, "split_features", lambda: splits.split_panel(feats.class_labels(features(spark, sf))))


@query("l08_ridge_full_contract")
def ridge_full(spark, sf):
    """All 30 features: fit on train dates, score test dates, forecast metrics."""
    s = _split(spark, sf)
    m = models.fit_ridge(s.where("role = 'train'"), FEATURE_COLS, LABEL)
    return metrics.forecast_metrics(m.score(s.where("role = 'test'")), "pred", LABEL)


@query("l09_elastic_net")
def elastic_net(spark, sf):
    s = _split(spark, sf)
    m, chosen = models.fit_elastic_net(s.where("role = 'train'"), FEATURE_COLS, LABEL)
    return metrics.forecast_metrics(m.score(s.where("role = 'test'")), "pred", LABEL)


@query("l10_boosted_trees")
def boosted(spark, sf):
    s = _split(spark, sf)
    m = models.fit_boosted(s.where("role = 'train'"), FEATURE_COLS, LABEL)
    return metrics.forecast_metrics(models.score_regressor(m, s.where("role = 'test'")), "pred", LABEL)


@query("l10_forest_classifier")
def forest(spark, sf):
    s = _split(spark, sf)
    m = models.fit_forest(s.where("role = 'train'"), FEATURE_COLS, "label")
    scored = models.score_classifier(m, s.where("role = 'test'"))
    return metrics.classifier_metrics(scored.withColumn("p", sc.argmax("proba")), "label", "p")


@query("l10_boosted_classes", f"""WITH {SQL_FEATURES}, d0 AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM feats WHERE fwd_ret_1d IS NOT NULL)),
  r AS (SELECT ts FROM d0 WHERE i >= floor(n * 0.8::DOUBLE) + 3)
  SELECT CASE WHEN fwd_ret_1d > 0.01 THEN 2 WHEN fwd_ret_1d < -0.01 THEN 0 ELSE 1 END AS label, count(*) AS n, CAST(0 AS BIGINT) AS n_out_of_bounds
  FROM feats JOIN r USING (ts) WHERE fwd_ret_1d IS NOT NULL GROUP BY 1""")
def boosted_classes(spark, sf):
    """Three-class scores of the test rows: how many there are of each class, and that each row's are bounded and sum to 1."""
    s = _split(spark, sf).drop("label").withColumn("label", F.when(F.col(LABEL) > 0.01, 2).when(F.col(LABEL) < -0.01, 0).otherwise(1))
    m = models.fit_boosted_classes(s.where("role = 'train'"), FEATURE_COLS, "label", "sqrt")
    p = m.score(s.where("role = 'test'"))
    bad = F.exists("proba", lambda x: x.isNull() | (x < 0) | (x > 1)) | (F.abs(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9) | (F.size("proba") != 3)
    return p.groupBy("label").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_out_of_bounds"))


@query("l11_multinomial_logistic")
def logistic(spark, sf):
    s = _split(spark, sf)
    m = models.fit_logistic(s.where("role = 'train'"), FEATURE_COLS, "label", "sqrt")
    scored = models.score_classifier(m, s.where("role = 'test'"))
    return metrics.classifier_metrics(scored.withColumn("p", sc.argmax("proba")), "label", "p")


@query("l12_pooled_dataset", f"""WITH {SQL_FEATURES}, y AS (SELECT *, fwd_ret_1d - avg(fwd_ret_1d) OVER (PARTITION BY ts) AS yd, count(*) OVER (PARTITION BY ts) AS names FROM feats WHERE fwd_ret_1d IS NOT NULL),
  k AS (SELECT * FROM y WHERE names >= 5), d0 AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM k)),
  r AS (SELECT ts, CASE WHEN i < floor(n * 0.8::DOUBLE) THEN 'train' WHEN i >= floor(n * 0.8::DOUBLE) + 3 THEN 'test' END AS role FROM d0)
  SELECT symbol, ts, role, {r_sql('yd', 'y', 5)}, {r_sql('raw_vol', digits=5)} FROM k JOIN r USING (ts) WHERE role IS NOT NULL""")
def pooled_dataset(spark, sf):
    """Features, demeaned target, raw volatility and role on global dates."""
    f = features(spark, sf).where(F.col(LABEL).isNotNull()).withColumn("y", F.col(LABEL))
    return out(splits.split_panel(xsec.demean_target(f, "y")), ["symbol", "ts", "role"], ["y", "raw_vol"], 5)


@query("l14_warmup_zscore", f"""WITH {SQL_BARS}, s AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ('close', 'volume'))} FROM bars WHERE bar_no < 252)
  SELECT symbol, ts, {', '.join(r_sql(f'({c} - m_{c}) / s_{c}', c) for c in ('close', 'volume'))} FROM bars, s""")
def warmup_zscore(spark, sf):
    b = bars(spark, sf)
    params = models.scale_params(models.zscore_fit(b, ["close", "volume"], 252))
    return out(models.apply_scaler(b, params, clip=None), ["symbol", "ts"], ["close", "volume"])


@query("l15_in_session_fit", f"""WITH {SQL_LABELLED}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS b, floor(count(*) OVER (PARTITION BY symbol) * 0.8::DOUBLE) AS sp FROM panel1),
  sc AS (SELECT symbol, median(pred) AS m, quantile_cont(pred, 0.75) - quantile_cont(pred, 0.25) AS s FROM p WHERE b < sp GROUP BY 1),
  z AS (SELECT p.*, greatest(least((pred - m) / s, 5), -5) AS z FROM p JOIN sc USING (symbol)),
  co AS (SELECT symbol, covar_pop(z, ret) * count(*) / (var_pop(z) * count(*) + 10) AS w, avg(z) AS mz, avg(ret) AS my FROM z WHERE b < sp GROUP BY 1)
  SELECT symbol, ts, {r_sql('CASE WHEN b >= sp + 3 THEN my + w * (z - mz) ELSE 0 END', 'fit', 5)} FROM z JOIN co USING (symbol)""")
def in_session(spark, sf):
    """Per-symbol 80/20 fit with embargo, predicting the suffix only."""
    p = number_rows(panel(spark, sf).drop("bar_no").where("ret is not null")).withColumnRenamed("pred", "x")
    return out(models.in_session_fit(p, ["x"], "ret").withColumnRenamed("pred", "fit"), ["symbol", "ts"], ["fit"], 5)


@query("l16_panel_assembly", f"""WITH {SQL_FEATURES}, n AS (SELECT *, lead(close) OVER w / close - 1 AS ret FROM feats WINDOW w AS (PARTITION BY symbol ORDER BY ts))
  SELECT symbol, ts, {r_sql('0.01::DOUBLE * greatest(least(ret_5d, 5), -5) + 0.02::DOUBLE * greatest(least(macd, 5), -5)', 'pred', 5)}, {r_sql('ret', digits=5)}, {r_sql('close', digits=9)} FROM n""")
def panel_assembly(spark, sf):
    """Features of the survivors scored by a linear model, with next-bar returns on surviving rows."""
    f = features(spark, sf)
    model = models.LinearModel(["ret_5d", "macd"], [0.01, 0.02], 0.0, {"ret_5d": (0.0, 1.0), "macd": (0.0, 1.0)})
    p = model.score(feats.panel_returns(f))
    return p.selectExpr("symbol", "ts", "IF(round(pred, 5) = 0, 0D, round(pred, 5)) AS pred", "IF(round(ret, 5) = 0, 0D, round(ret, 5)) AS ret", "round(close, 9) AS close")


_NT = len(_Q) * len(_W)
_Z17 = (1 - EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / _NT) + EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (_NT * math.e))


def _trials_sql(rows: str = "panel1") -> str:
    ts = ", ".join(f"CASE WHEN count(pred) OVER f{w} >= 20 THEN quantile_cont(abs(pred), {q}) OVER f{w} END AS t_{round(q * 100)}_{w}" for w in _W for q in _Q)
    wins = ", ".join(f"f{w} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in _W)
    opts = ", ".join("{'config_no': %d, 'config': 'q%g_w%d', 't': t_%d_%d}" % (i * len(_W) + j, q, w, round(q * 100), w)
                     for i, q in enumerate(_Q) for j, w in enumerate(_W))
    return f"""th AS (SELECT *, {ts} FROM {rows} WINDOW {wins}), op AS (SELECT symbol, i, pred, ret, UNNEST([{opts}], recursive := true) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM th)),
  sg AS (SELECT symbol, i, ret, config, config_no, CASE WHEN abs(pred) > t THEN sign(pred) ELSE 0 END::DOUBLE AS sig FROM op),
  ho AS (SELECT symbol, config_no, i, sig AS position, CASE WHEN sig <> 0 THEN 0 ELSE 99 END AS age FROM sg WHERE i = 1
    UNION ALL SELECT sg.symbol, sg.config_no, sg.i,
      CASE WHEN sign(sg.sig) <> sign(ho.position) AND (ho.position = 0 OR ho.age + 1 >= 5) THEN sg.sig ELSE ho.position END,
      CASE WHEN sign(sg.sig) <> sign(ho.position) AND (ho.position = 0 OR ho.age + 1 >= 5) AND sg.sig <> 0 THEN 0 ELSE ho.age + 1 END
    FROM ho JOIN sg ON sg.symbol = ho.symbol AND sg.config_no = ho.config_no AND sg.i = ho.i + 1),
  rr AS (SELECT sg.symbol, sg.config, sg.config_no, coalesce(ho.position, 0) * sg.ret AS r FROM sg LEFT JOIN ho
    ON ho.symbol = sg.symbol AND ho.config_no = sg.config_no AND ho.i = sg.i - 1 WHERE sg.ret IS NOT NULL),
  r1 AS (SELECT *, avg(r) OVER g AS m, stddev_pop(r) OVER g AS s FROM rr WINDOW g AS (PARTITION BY symbol, config_no)),
  mo AS (SELECT symbol, config, config_no, count(*) AS t, max(s) AS sd0, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) ELSE 0 END AS sr,
    avg(power((r - m) / nullif(s, 0), 3)) AS skew, avg(power((r - m) / nullif(s, 0), 4)) AS kurt FROM r1 GROUP BY 1, 2, 3),
  be AS (SELECT *, var_samp(sr) OVER (PARTITION BY symbol) AS tv, row_number() OVER (PARTITION BY symbol ORDER BY round(sr, 12) DESC, config_no) AS rk FROM mo),
  ds AS (SELECT symbol, config, t, sr, sqrt(tv) * {_Z17!r}::DOUBLE AS sr0, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS den, sd0 FROM be WHERE rk = 1)"""


@query("l17_deflated_by_symbol", f"""WITH RECURSIVE {SQL_PANEL}, {_trials_sql()} SELECT symbol, config, t, {r_sql('sr', digits=5)}, {r_sql('sr0', digits=5)},
  {r_sql('CASE WHEN den > 0 AND sd0 > 0 THEN (sr - sr0) * sqrt(t - 1) / sqrt(den) END', 'z', 5)} FROM ds""")
def deflated_by_symbol(spark, sf):
    """Every (quantile, window) setting per symbol, the best one deflated."""
    d = eval_report.deflated_by_symbol(numbered_panel(spark, sf), min_rows=1, quantiles=_Q, windows=_W)
    return out(d, ["symbol", "config", "t"], ["sr", "sr0", "z"], 5)



# Where each symbol's model stopped learning: late for some suppliers, early for most, unknown for those in debt.
_MIN_ROWS = 200


@query("l17_out_of_sample", f"""WITH RECURSIVE {SQL_PANEL}, cu AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol,
    CASE WHEN s_acctbal > 5000 THEN DATE '1999-01-01' WHEN s_acctbal > 0 THEN DATE '1996-01-01' END AS train_end FROM supplier),
  pt AS (SELECT panel1.* FROM panel1 LEFT JOIN cu USING (symbol) WHERE train_end IS NULL OR ts > train_end + 3),
  pk AS (SELECT * FROM pt WHERE symbol IN (SELECT symbol FROM pt GROUP BY symbol HAVING count(*) >= {_MIN_ROWS})), {_trials_sql("pk")}
  SELECT symbol, config, t, {r_sql('sr', digits=5)}, {r_sql('sr0', digits=5)},
  {r_sql('CASE WHEN den > 0 AND sd0 > 0 THEN (sr - sr0) * sqrt(t - 1) / sqrt(den) END', 'z', 5)} FROM ds""")
def deflated_out_of_sample(spark, sf):
    """As above, after the rows that the symbol's model has seen are gone and short symbols with them."""
    cut = table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS symbol", "CASE WHEN s_acctbal > 5000 THEN DATE'1999-01-01' WHEN s_acctbal > 0 THEN DATE'1996-01-01' END AS train_end")
    d = eval_report.deflated_by_symbol(numbered_panel(spark, sf), _MIN_ROWS, cut, quantiles=_Q, windows=_W)
    return out(d, ["symbol", "config", "t"], ["sr", "sr0", "z"], 5)


@query("l17_fold_overfit", f"""WITH {SQL_LABELLED}, {_matrix_sql()},
  daily AS (SELECT CAST(config_no AS VARCHAR) AS config, config_no, ic AS book_ret, dense_rank() OVER (ORDER BY symbol, fold) AS i FROM mx), {SQL_PBO}
  SELECT CAST(mask AS INT) AS mask, {r_sql('logit')} FROM lg""")
def fold_overfit(spark, sf):
    """Splits of the folds: is the setting with the best IC on one half of them above the median on the other?"""
    return out(eval_report.fold_overfit(fold_ics(spark, sf)), ["mask"], ["logit"])