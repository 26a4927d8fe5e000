"""Cross-section, books and joins (inventory X, B, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.base import (
    SQL_BARS, SQL_BENCH, SQL_LOG, SQL_PANEL, bars, benchmark, cols_sql, features, out, panel, prediction_log, query,
    r_sql, sectors, staged, table, ticks,
)
from panelforge.catalog.feature_queries import SQL_FEATURES
from panelforge.operators import book as bk
from panelforge.operators import features as feats
from panelforge.operators import metrics, monitor, xsec
from panelforge.operators.scans import realized_pnl
from panelforge.operators.timeaxis import number_rows
from panelforge.schema import CONFIG_GRID, CS_SUFFIX, FEATURE_COLS

_CS = FEATURE_COLS

SQL_SECTORS = """sectors AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, n_name AS sector FROM supplier
  JOIN nation ON s_nationkey = n_nationkey)"""


def _rank01(c: str, part: str = "ts") -> str:
    return (f"2.0::DOUBLE * CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, {c} IS NULL ORDER BY {c}) "
            f"+ (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY {part}) END - 1")


def _cs_sql(mode: str) -> str:
    cols = []
    for c in _CS:
        cols.append(r_sql(f"CASE WHEN names >= 5 THEN {_rank01(c)} END", c if mode == "replace" else c + CS_SUFFIX))
        if mode == "augment":
            cols.append(r_sql(f"CASE WHEN names >= 5 THEN {c} END", c, 5))
    return (f"WITH {SQL_FEATURES}, n AS (SELECT *, count(*) OVER (PARTITION BY ts) AS names FROM feats) "
            f"SELECT symbol, ts, {', '.join(cols)} FROM n")


@query("x01_cross_sectional_rank", _cs_sql("replace"))
def cs_replace(spark, sf):
    df = xsec.cross_sectional_normalize(features(spark, sf).select("symbol", "ts", *_CS), _CS)
    return out(df, ["symbol", "ts"], _CS)


@query("x01_cross_sectional_augment", _cs_sql("augment"))
def cs_augment(spark, sf):
    df = xsec.cross_sectional_normalize(features(spark, sf).select("symbol", "ts", *_CS), _CS, mode="augment")
    return df.selectExpr("symbol", "ts", *[f"IF(round({c}, 5) = 0, 0D, round({c}, 5)) AS {c}" for c in _CS],
                         *[f"IF(round({c}_cs, 6) = 0, 0D, round({c}_cs, 6)) AS {c}_cs" for c in _CS])


@query("x02_demeaned_target", f"""WITH {SQL_PANEL}, n AS (SELECT *, count(*) OVER (PARTITION BY ts) AS names,
  avg(ret) OVER (PARTITION BY ts) AS m FROM panel1) SELECT symbol, ts, {r_sql('ret - m', 'y')} FROM n WHERE names >= 5""")
def demeaned_target(spark, sf):
    df = xsec.demean_target(panel(spark, sf).withColumnRenamed("ret", "y"), "y")
    return out(df, ["symbol", "ts"], ["y"])


@query("x03_sector_neutral", f"""WITH {SQL_PANEL}, {SQL_SECTORS} SELECT p.symbol, p.ts, {r_sql('''pred - CASE WHEN sector IS NOT NULL
  AND count(pred) OVER g >= 4 THEN avg(pred) OVER g ELSE 0 END''', 'pred')} FROM panel1 p LEFT JOIN sectors USING (symbol)
  WINDOW g AS (PARTITION BY ts, sector)""")
def sector_neutral(spark, sf):
    return out(xsec.sector_neutralize(panel(spark, sf), sectors(spark, sf)), ["symbol", "ts"], ["pred"])


def weights_sql(decile: float, gross: float = 1.0, min_names: int = 20, beta: bool = True, conviction: bool = False,
                source: str = "panel1", name: str = "w") -> str:
    """CTEs producing non-zero weights (symbol, ts, w) of one variant from `source`."""
    k = f"least(CAST(floor(n * {decile}::DOUBLE) AS BIGINT), n // 2)"
    share = "1.0::DOUBLE / k"
    if conviction:
        share = "CASE WHEN med > 0 THEN score / sum(score) OVER (PARTITION BY ts, side) ELSE 1.0::DOUBLE / k END"
    notional = f"""CASE WHEN NOT {beta} OR (cl > 0 AND cl < 0.8) OR (cs > 0 AND cs < 0.8) THEN {gross}::DOUBLE / 2
      WHEN bl > 0.1 AND bs > 0.1 THEN {gross}::DOUBLE * CASE WHEN side > 0 THEN bs ELSE bl END / (bl + bs) END"""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY pred, symbol) - 1 AS pos,
    count(*) OVER (PARTITION BY ts) AS n, median(pred) OVER (PARTITION BY ts) AS center FROM {source} WHERE pred IS NOT NULL),
  {name}_l AS (SELECT *, {k} AS k, CASE WHEN pos < {k} THEN -1 WHEN pos >= n - {k} THEN 1 END AS side
    FROM {name}_r WHERE n >= {min_names}),
  {name}_s AS (SELECT *, avg(CASE WHEN side = 1 THEN (beta IS NOT NULL)::INT END) OVER (PARTITION BY ts) AS cl,
    avg(CASE WHEN side = -1 THEN (beta IS NOT NULL)::INT END) OVER (PARTITION BY ts) AS cs,
    avg(CASE WHEN side = 1 THEN beta END) OVER (PARTITION BY ts) AS bl,
    avg(CASE WHEN side = -1 THEN beta END) OVER (PARTITION BY ts) AS bs,
    median(abs(pred - center)) OVER (PARTITION BY ts, side) AS med FROM {name}_l WHERE side IS NOT NULL AND k >= 1),
  {name}_c AS (SELECT *, {notional} AS notional, greatest(least(abs(pred - center), med * 2), med / 2) AS score FROM {name}_s),
  {name} AS (SELECT *, side * notional * {share} AS w FROM {name}_c WHERE notional IS NOT NULL)"""


def _weights(spark, sf, config):
    return out(xsec.target_weights(xsec.rank_panel(panel(spark, sf)), [config]), ["symbol", "ts"], ["w"])


@query("x04_rank_weights_dollar_neutral", f"WITH {SQL_PANEL}, {weights_sql(0.2, beta=False)} SELECT symbol, ts, {r_sql('w')} FROM w")
def weights_dollar(spark, sf):
    return _weights(spark, sf, xsec.BookConfig(0.2, use_beta=False))


@query("x04_rank_weights_beta_neutral", f"WITH {SQL_PANEL}, {weights_sql(0.1)} SELECT symbol, ts, {r_sql('w')} FROM w")
def weights_beta(spark, sf):
    return _weights(spark, sf, xsec.BookConfig(0.1))


@query("x05_conviction_weights", f"WITH {SQL_PANEL}, {weights_sql(0.2, conviction=True)} SELECT symbol, ts, {r_sql('w')} FROM w")
def weights_conviction(spark, sf):
    return _weights(spark, sf, xsec.BookConfig(0.2, conviction=True))


SQL_RANKIC = """{name}_p AS (SELECT {by}, {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{name}_k AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry FROM {name}_p),
{name} AS (SELECT {by}, count(*) AS n, CASE WHEN count(*) >= {min_names} AND stddev_pop(x) >= 1e-12 AND stddev_pop(y) >= 1e-12
  THEN corr(rx, ry) END AS ic FROM {name}_k GROUP BY {by})"""


def rankic_sql(x: str, y: str, by: str = "ts", source: str = "panel1", min_names: int = 20, name: str = "ics") -> str:
    return SQL_RANKIC.format(x=x, y=y, by=by, source=source, min_names=min_names, name=name)


@query("x06_cross_sectional_ic", f"WITH {SQL_PANEL}, {rankic_sql('pred', 'ret')} SELECT ts, n, {r_sql('ic')} FROM ics")
def per_date_ic(spark, sf):
    return out(metrics.cross_sectional_ic(panel(spark, sf), "pred", "ret"), ["ts", "n"], ["ic"])


@query("x07_pooled_ic", f"""WITH {SQL_PANEL}, one AS (SELECT 1 AS g, * FROM panel1), {rankic_sql('pred', 'ret', 'g', 'one', 2)}
  SELECT n, {r_sql('ic')} FROM ics""")
def pooled(spark, sf):
    return out(metrics.pooled_ic(panel(spark, sf), "pred", "ret"), ["n"], ["ic"])


_IC_STATS = ["mean_ic", "std_ic", "ic_ir", "ann_ic_ir", "t_stat", "pct_positive"]
SQL_IC_STATS = """count(ic) AS n_dates, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic) / stddev_samp(ic) AS ic_ir,
  avg(ic) / stddev_samp(ic) * sqrt(252) AS ann_ic_ir, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t_stat,
  avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE WHEN ic <= 0 THEN 0 END) AS pct_positive"""


@query("x08_ic_summary", f"""WITH {SQL_PANEL}, {rankic_sql('pred', 'ret')}, s AS (SELECT {SQL_IC_STATS} FROM ics)
  SELECT n_dates, {cols_sql(_IC_STATS)} FROM s""")
def ic_summary(spark, sf):
    return out(metrics.ic_summary(metrics.cross_sectional_ic(panel(spark, sf), "pred", "ret")), ["n_dates"], _IC_STATS)


@query("x09_ic_decay", f"""WITH {SQL_PANEL}, dx AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM panel1)),
  px AS (SELECT p.*, dx.i FROM panel1 p JOIN dx USING (ts)),
  f AS (SELECT a.ts, a.symbol, a.pred, h.h, b.close / a.close - 1 AS fwd FROM px a CROSS JOIN (SELECT UNNEST([1, 2, 3, 5, 10]) AS h) h
    LEFT JOIN px b ON b.symbol = a.symbol AND b.i = a.i + h.h),
  {rankic_sql('pred', 'fwd', 'h, ts', 'f')}, s AS (SELECT h AS horizon, {SQL_IC_STATS} FROM ics GROUP BY h)
  SELECT horizon, n_dates, horizon > 1 AS overlapping, {cols_sql(_IC_STATS)} FROM s""")
def ic_decay(spark, sf):
    return out(metrics.ic_decay(panel(spark, sf)), ["horizon", "n_dates", "overlapping"], _IC_STATS)


@query("x10_train_ic", f"""WITH {SQL_PANEL}, {rankic_sql('pred', 'ret', min_names=5)}, s AS (SELECT {SQL_IC_STATS} FROM ics)
  SELECT {r_sql('mean_ic', 'cs_ic')}, {r_sql('ic_ir', 'cs_ic_ir')}, n_dates AS cs_n_dates FROM s""")
def train_ic(spark, sf):
    return out(metrics.train_ic(panel(spark, sf), "pred", "ret"), ["cs_n_dates"], ["cs_ic", "cs_ic_ir"])


@query("x11_names_coverage", f"""WITH {SQL_PANEL}, d AS (SELECT ts, count(pred) AS n FROM panel1 GROUP BY ts)
  SELECT count(*) AS n_dates, {r_sql('avg(n)', 'mean_n_names')}, count(*) FILTER (n < 20) AS n_dates_below_min_names FROM d""")
def coverage(spark, sf):
    return out(metrics.names_coverage(panel(spark, sf)), ["n_dates", "n_dates_below_min_names"], ["mean_n_names"])


# ---- books ------------------------------------------------------------------------

def book_sql(decile: float, r: int, beta: bool = True, name: str = "bk", conviction: bool = False) -> str:
    """Dense date-by-symbol version of one variant: daily series `{name}`."""
    w = weights_sql(decile, beta=beta, name=f"{name}_w", conviction=conviction)
    return f"""{w}, {name}_d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM panel1)),
  {name}_y AS (SELECT DISTINCT symbol FROM panel1),
  {name}_g AS (SELECT d.ts, d.i, d.i // {r} AS block, y.symbol, p.ret, p.beta,
      CASE WHEN d.i % {r} = 0 THEN coalesce(w.w, 0) END AS w00
    FROM {name}_d d CROSS JOIN {name}_y y LEFT JOIN panel1 p ON p.ts = d.ts AND p.symbol = y.symbol
    LEFT JOIN {name}_w w ON w.ts = d.ts AND w.symbol = y.symbol),
  {name}_h AS (SELECT *, max(w00) OVER (PARTITION BY symbol, block) * coalesce(product(1 + coalesce(ret, 0)) OVER (
      PARTITION BY symbol, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS w FROM {name}_g),
  {name}_t AS (SELECT *, CASE WHEN i % {r} = 0 THEN abs(w - coalesce(lag(w * (1 + coalesce(ret, 0))) OVER (
      PARTITION BY symbol ORDER BY i), 0)) ELSE 0 END AS trade FROM {name}_h),
  {name}_a AS (SELECT ts, i, coalesce(sum(w * ret), 0) AS gross_ret, sum(trade) AS turnover, sum(greatest(-w, 0)) AS short_notional,
      sum(abs(w)) AS gross_exposure, sum(w) AS net_exposure, coalesce(sum(w * beta), 0) AS ex_ante_beta,
      count(*) FILTER (w <> 0) AS n_held FROM {name}_t GROUP BY ts, i),
  {name}_c AS (SELECT *, turnover * 5 / 1e4 AS cost, short_notional * 50 / 1e4 / 252 AS borrow,
      gross_ret - turnover * 5 / 1e4 - short_notional * 50 / 1e4 / 252 AS book_ret FROM {name}_a),
  {name} AS (SELECT 'd{decile:g}_r{r}' AS config, *, 100000.0::DOUBLE * product(1 + book_ret) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS equity FROM {name}_c)"""


_DAILY = ["gross_ret", "turnover", "cost", "borrow", "book_ret", "gross_exposure", "net_exposure", "ex_ante_beta"]
GRID = xsec.config_grid()
SQL_GRID = ", ".join(book_sql(d, r, name=f"b{i}") for i, (d, r) in enumerate(CONFIG_GRID))
SQL_DAILY = f"daily AS ({' UNION ALL '.join(f'SELECT {i} AS config_no, * FROM b{i}' for i in range(len(CONFIG_GRID)))})"


def grid_daily(spark, sf):
    return staged(spark, sf, "grid_daily", lambda: bk.run_book(panel(spark, sf), GRID))


@query("b01_drifting_book", f"""WITH {SQL_PANEL}, {book_sql(0.2, 5)} SELECT ts, n_held, {cols_sql(_DAILY)}, {r_sql('ln(abs(equity))', 'log_equity')} FROM bk""")
def drifting_book(spark, sf):
    """Hold-and-drift book with costs, borrow and equity."""
    d = bk.run_book(panel(spark, sf), [xsec.BookConfig(0.2, 5)])
    return d.selectExpr("ts", "n_held", *[f"IF(round({c}, 6) = 0, 0D, round({c}, 6)) AS {c}" for c in _DAILY],
                        "round(ln(abs(equity)), 6) AS log_equity")


@query("b01_held_weights", f"""WITH {SQL_PANEL}, {book_sql(0.1, 10)} SELECT ts, symbol, {r_sql('w')} FROM bk_h WHERE w <> 0""")
def held_weights(spark, sf):
    p = bk.held_positions(panel(spark, sf), [xsec.BookConfig(0.1, 10)])
    return out(p.where("w <> 0"), ["ts", "symbol"], ["w"])


_DIAG = ["mean_turnover", "mean_cost", "mean_borrow_cost", "total_cost_drag", "mean_gross_exposure", "mean_net_exposure",
         "mean_ex_ante_beta"]
SQL_DIAG = """diag AS (SELECT config, count(*) AS n_dates, count(*) FILTER (n_held = 0) AS n_flat_days, avg(turnover) AS mean_turnover,
  avg(cost) AS mean_cost, avg(borrow) AS mean_borrow_cost, sum(cost) + sum(borrow) AS total_cost_drag,
  avg(gross_exposure) AS mean_gross_exposure, avg(net_exposure) AS mean_net_exposure, avg(ex_ante_beta) AS mean_ex_ante_beta
  FROM daily GROUP BY config)"""


@query("b04_book_diagnostics", f"WITH {SQL_PANEL}, {SQL_GRID}, {SQL_DAILY}, {SQL_DIAG} SELECT config, n_dates, n_flat_days, {cols_sql(_DIAG)} FROM diag")
def diagnostics(spark, sf):
    return out(bk.book_diagnostics(grid_daily(spark, sf)), ["config", "n_dates", "n_flat_days"], _DIAG)


@query("b05_config_grid", f"WITH {SQL_PANEL}, {SQL_GRID}, {SQL_DAILY} SELECT config, ts, {r_sql('book_ret')}, {r_sql('turnover')} FROM daily")
def config_grid(spark, sf):
    return out(grid_daily(spark, sf), ["config", "ts"], ["book_ret", "turnover"])


SQL_NEUTRAL = f"""{SQL_SECTORS}, neutral AS (SELECT p.* REPLACE (pred - CASE WHEN sector IS NOT NULL AND count(pred) OVER g >= 4
  THEN avg(pred) OVER g ELSE 0 END AS pred) FROM panel1 p LEFT JOIN sectors USING (symbol) WINDOW g AS (PARTITION BY ts, sector))"""


@query("b06_single_date_book", f"""WITH {SQL_PANEL}, {SQL_NEUTRAL}, {weights_sql(0.2, source='neutral')}
  SELECT ts AS as_of, symbol, n AS n_ranked, {r_sql('w', 'weight')}, {r_sql('close', 'price', 9)} FROM w""")
def single_date_book(spark, sf):
    """Sector-neutral book of every date, as the live job builds it."""
    s = panel(spark, sf).selectExpr("ts AS as_of", "symbol", "pred AS score", "beta", "close AS price")
    b = bk.build_book(s, xsec.BookConfig(0.2), sectors(spark, sf))
    return b.selectExpr("as_of", "symbol", "n_ranked", "round(weight, 6) AS weight", "round(price, 9) AS price")


@query("b06_flat_reasons", f"""WITH {SQL_PANEL} SELECT ts AS as_of, count(pred) AS n_ranked,
  printf('cross-section of %d names is below min_names=80', count(pred)) AS reason FROM panel1 GROUP BY ts HAVING count(pred) < 80""")
def flat_reasons(spark, sf):
    """Why dates have no book."""
    cfg = xsec.BookConfig(0.2, 1, min_names=80, use_beta=False)
    scores = panel(spark, sf).selectExpr("ts AS as_of", "symbol", "pred AS score")
    return bk.flat_reasons(scores, bk.build_book(scores, cfg), cfg)


@query("b07_exposures", f"""WITH {SQL_PANEL}, {weights_sql(0.2)}, e AS (SELECT ts AS as_of, count(*) AS n_held, sum(abs(w)) AS gross_exposure,
  sum(w) AS net_exposure, count(beta)::DOUBLE / count(*) AS beta_coverage,
  CASE WHEN count(beta) = count(*) THEN sum(w * beta) END AS ex_ante_beta, abs(sum(w)) > 0.5 AS net_exposure_warning FROM w GROUP BY ts)
  SELECT as_of, n_held, net_exposure_warning, {cols_sql(['gross_exposure', 'net_exposure', 'beta_coverage', 'ex_ante_beta'])} FROM e""")
def exposures(spark, sf):
    w = xsec.target_weights(xsec.rank_panel(panel(spark, sf)), [xsec.BookConfig(0.2)])
    e = bk.exposures(w.selectExpr("ts AS as_of", "symbol", "w AS weight", "beta"))
    return out(e, ["as_of", "n_held", "net_exposure_warning"], ["gross_exposure", "net_exposure", "beta_coverage", "ex_ante_beta"])


@query("b08_rebalance_due", """WITH o AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1)
  SELECT o_custkey, CAST((SELECT count(*) FROM range(a, b, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6) AS INT) AS elapsed,
  (SELECT count(*) FROM range(a, b, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6) >= 500 AS due FROM o""")
def rebalance_due(spark, sf):
    from panelforge.functions.scalars import business_days
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return o.select("o_custkey", business_days("a", "b").alias("elapsed"),
                    bk.rebalance_due(F.col("a").cast("string"), "b", 500).alias("due"))


@query("b09_drift_book", f"""WITH {SQL_PANEL}, {weights_sql(0.2)}, held AS (SELECT ts, symbol, w AS weight, close AS price FROM w),
  nxt AS (SELECT symbol, ts AS ts1, lag(ts) OVER (ORDER BY ts) AS ts0, close FROM (SELECT * FROM panel1)),
  d AS (SELECT DISTINCT ts FROM panel1), dd AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS ts1 FROM d)
  SELECT h.ts, h.symbol, {r_sql('CASE WHEN p.close IS NOT NULL THEN weight * (p.close / price) ELSE weight END', 'weight')},
  {r_sql('coalesce(p.close, price)', 'price', 9)} FROM held h JOIN dd USING (ts) LEFT JOIN panel1 p ON p.ts = dd.ts1 AND p.symbol = h.symbol""")
def drift(spark, sf):
    """Every date's book carried to the next date's prices."""
    p = panel(spark, sf)
    dates = bk.date_index(p)
    nxt = dates.select(F.col("ts").alias("ts1"), (F.col("i") - 1).alias("i"))
    w = xsec.target_weights(xsec.rank_panel(p), [xsec.BookConfig(0.2)]).selectExpr("ts", "symbol", "w AS weight", "close AS price")
    prices = p.select("ts", "symbol", F.col("close").alias("price_now")).withColumnRenamed("ts", "ts1").join(nxt, "ts1").join(
        dates, "i").select("ts", "symbol", "price_now")
    d = bk.drift_book(w, prices, ["ts", "symbol"])
    return d.selectExpr("ts", "symbol", "round(weight, 6) AS weight", "round(price, 9) AS price")


@query("b09_book_records", f"""WITH {SQL_PANEL}, {weights_sql(0.2)} SELECT ts AS as_of, count(*) AS n_held,
  {r_sql('sum(w)', 'net')}, string_agg(symbol, ',' ORDER BY symbol) AS names FROM w GROUP BY ts""")
def book_records(spark, sf):
    """Rows to map records and back."""
    w = xsec.target_weights(xsec.rank_panel(panel(spark, sf)), [xsec.BookConfig(0.2)])
    rec = bk.collect_book(w.selectExpr("ts AS as_of", "symbol", "w AS weight", "close AS price"))
    back = bk.explode_book(rec)
    g = back.groupBy("as_of").agg(F.count(F.lit(1)).alias("n_held"), F.sum("weight").alias("net"),
                                  F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("names"))
    return out(g, ["as_of", "n_held", "names"], ["net"])


@query("b10_live_book", f"""WITH {SQL_PANEL}, last AS (SELECT * FROM panel1 WHERE ts = (SELECT max(ts) FROM panel1)),
  {SQL_SECTORS}, live AS (SELECT p.* REPLACE (pred - CASE WHEN sector IS NOT NULL AND count(pred) OVER g >= 4
  THEN avg(pred) OVER g ELSE 0 END AS pred) FROM last p JOIN sectors USING (symbol) WINDOW g AS (PARTITION BY ts, sector)),
  {weights_sql(0.2, source='live')} SELECT symbol, {r_sql('w', 'weight')}, true AS rebalanced FROM w""")
def live_book(spark, sf):
    """Hold-or-rank on the last date against a book from ten bars before."""
    p = panel(spark, sf)
    dates = bk.date_index(p)
    ends = dates.agg(F.max("i").alias("m"))
    tail = dates.join(F.broadcast(ends)).where("i = m or i = m - 10")  # one-row bound
    rows = p.join(tail, "ts")
    old = bk.build_book(rows.where("i < m").selectExpr("ts AS as_of", "symbol", "pred AS score", "beta", "close AS price"),
                        xsec.BookConfig(0.2))
    now = rows.where("i = m").selectExpr("symbol", "pred AS score", "beta", "close AS price", "ts")
    today = table(spark, sf, "lineitem").agg(F.max("l_shipdate")).first()[0].date().isoformat()
    live = bk.live_book(old, now, sectors(spark, sf), xsec.BookConfig(0.2, 10), today, sectors(spark, sf))
    return out(live, ["symbol", "rebalanced"], ["weight"])


@query("b10_live_book_hold", f"""WITH {SQL_PANEL}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () - 1 AS m FROM (SELECT DISTINCT ts FROM panel1)),
  o AS (SELECT p.* FROM panel1 p JOIN d USING (ts) WHERE i = m - 10), now AS (SELECT p.symbol, p.close AS c1 FROM panel1 p JOIN d USING (ts) WHERE i = m),
  {weights_sql(0.2, source='o')} SELECT symbol, {r_sql('CASE WHEN c1 <> 0 AND w.close <> 0 THEN w * (c1 / w.close) ELSE w END', 'weight')}, false AS rebalanced
  FROM w LEFT JOIN now USING (symbol)""")
def live_book_hold(spark, sf):
    """The same book while no rebalance is due: the one from ten bars before, carried by the prices since."""
    p = panel(spark, sf)
    dates = bk.date_index(p)
    tail = dates.join(F.broadcast(dates.agg(F.max("i").alias("m")))).where("i = m or i = m - 10")  # one-row bound
    rows = p.join(tail, "ts")
    old = bk.build_book(rows.where("i < m").selectExpr("ts AS as_of", "symbol", "pred AS score", "beta", "close AS price"), xsec.BookConfig(0.2))
    now = rows.where("i = m").selectExpr("symbol", "pred AS score", "beta", "close AS price", "ts")
    today = table(spark, sf, "lineitem").agg(F.max("l_shipdate")).first()[0].date().isoformat()
    live = bk.live_book(old, now, sectors(spark, sf), xsec.BookConfig(0.2, 60), today, sectors(spark, sf))
    return out(live, ["symbol", "rebalanced"], ["weight"])


@query("b11_leg_listing", f"""WITH {SQL_PANEL}, {weights_sql(0.2, conviction=True)} SELECT ts AS as_of, symbol,
  CASE WHEN w > 0 THEN 'LONG' ELSE 'SHORT' END AS leg,
  CAST(row_number() OVER (PARTITION BY ts, w > 0 ORDER BY round(abs(w), 9) DESC, symbol) AS INT) AS place FROM w""")
def leg_listing(spark, sf):
    w = xsec.target_weights(xsec.rank_panel(panel(spark, sf)), [xsec.BookConfig(0.2, conviction=True)])
    return bk.leg_listing(w.selectExpr("ts AS as_of", "symbol", "round(w, 9) AS weight")).select(
        "as_of", "symbol", "leg", "place")


@query("b11_book_text")
def book_text(spark, sf):
    s = panel(spark, sf).selectExpr("ts AS as_of", "symbol", "pred AS score", "beta", "close AS price")
    return bk.book_text(bk.build_book(s, xsec.BookConfig(0.2)))


SQL_TRADES = """trades AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS seq,
  ts, CASE WHEN l_returnflag = 'R' THEN 'SELL' WHEN l_discount > 0.05 THEN 'SELL' ELSE 'BUY' END AS side, volume AS shares, price AS fill_price,
  volume * 0.01::DOUBLE AS commission FROM ticks)"""


def ledger(spark, sf):
    t = ticks(spark, sf).withColumn("side", F.when((F.col("l_returnflag") == "R") | (F.col("l_discount") > 0.05), "SELL").otherwise("BUY"))
    t = number_rows(t, order=("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"), bucket="struct(l_shipdate, floor(l_orderkey / 100000))")
    return t.selectExpr("symbol", "bar_no", "ts", "side", "volume AS shares", "price AS fill_price", "volume * 0.01D AS commission")


SQL_LEDGER = """, tr AS (SELECT *, CASE side WHEN 'BUY' THEN shares ELSE -shares END AS sg FROM trades),
  led AS (SELECT symbol, seq, sg AS pos, fill_price AS e, commission / shares AS c, NULL::DOUBLE AS pnl FROM tr WHERE seq = 1
  UNION ALL SELECT t.symbol, t.seq, l.pos + t.sg,
    CASE WHEN l.pos = 0 THEN t.fill_price WHEN sign(l.pos) = sign(t.sg) THEN (l.e * abs(l.pos) + t.fill_price * t.shares) / (abs(l.pos) + t.shares)
      WHEN l.pos + t.sg = 0 THEN 0 WHEN sign(l.pos + t.sg) <> sign(l.pos) THEN t.fill_price ELSE l.e END,
    CASE WHEN l.pos = 0 THEN t.commission / t.shares WHEN sign(l.pos) = sign(t.sg) THEN (l.c * abs(l.pos) + t.commission) / (abs(l.pos) + t.shares)
      WHEN l.pos + t.sg = 0 THEN 0 WHEN sign(l.pos + t.sg) <> sign(l.pos) THEN t.commission / t.shares ELSE l.c END,
    CASE WHEN l.pos <> 0 AND sign(l.pos) <> sign(t.sg) THEN (t.fill_price - l.e) * sign(l.pos) * least(abs(l.pos), t.shares)
      - (l.c + t.commission / t.shares) * least(abs(l.pos), t.shares) END
  FROM led l JOIN tr t ON t.symbol = l.symbol AND t.seq = l.seq + 1)"""


def _sql_ledger() -> str:
    from panelforge.catalog.base import SQL_TICKS
    return f"WITH RECURSIVE {SQL_TICKS}, {SQL_TRADES} {SQL_LEDGER}"


@query("b12_realized_pnl", f"{_sql_ledger()} SELECT symbol, seq, pos AS position, {r_sql('pnl + 1e-9', 'pnl', 4)} FROM led")
def realized(spark, sf):
    p = realized_pnl(ledger(spark, sf))
    # A nudge settles exact decimal ties the same way in both engines.
    p = p.selectExpr("symbol", "bar_no + 1 AS seq", "position", "pnl + 1e-9D AS pnl")
    return out(p, ["symbol", "seq", "position"], ["pnl"], 4)


@query("b13_fills", f"""WITH {SQL_BARS}, p AS (SELECT *, greatest(close * 0.0002::DOUBLE, 0.01) AS spread,
  CAST(sign(close - open) AS BIGINT) * 100 AS position FROM bars),
  q AS (SELECT *, position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0) AS delta FROM p)
  SELECT symbol, ts, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS shares,
  close + sign(delta) * (greatest(spread, 0.01) / 2 + close * 0.0001::DOUBLE) AS fill_price,
  abs(delta) * 0.00005::DOUBLE AS commission, abs(delta) * greatest(spread, 0.01) / 2 AS spread_cost FROM q WHERE delta <> 0""")
def fills(spark, sf):
    from panelforge.operators.quality import add_spread
    b = add_spread(bars(spark, sf)).withColumn("position", F.signum(F.col("close") - F.col("open")).cast("bigint") * 100)
    return bk.fills(b).drop("bar_no")


@query("b14_triple_barrier", f"""WITH {SQL_PANEL}, e AS (SELECT symbol, bar_no, ts, close, CASE WHEN pred > 0 THEN 1 ELSE -1 END AS side FROM panel1),
  m AS (SELECT e.*, f.bar_no - e.bar_no AS n, (f.close - e.close) / e.close * e.side AS g FROM e JOIN panel1 f ON f.symbol = e.symbol
    AND f.bar_no > e.bar_no AND f.bar_no <= e.bar_no + 5),
  h AS (SELECT symbol, ts, min(n) FILTER (g > 0.3 OR g < -0.2) AS hit, count(*) AS have FROM m GROUP BY ALL),
  x AS (SELECT e.symbol, e.ts, coalesce(h.hit, CASE WHEN h.have = 5 THEN 5 END) AS n, h.hit FROM e LEFT JOIN h USING (symbol, ts))
  SELECT x.symbol, x.ts, CASE WHEN x.hit IS NOT NULL THEN CASE WHEN m.g > 0.3 THEN 'take_profit' ELSE 'stop_loss' END
    WHEN x.n IS NOT NULL THEN 'max_holding' END AS exit_reason, CAST(x.n AS INT) AS exit_bars, {r_sql('m.g', 'exit_gain')}
  FROM x LEFT JOIN m ON m.symbol = x.symbol AND m.ts = x.ts AND m.n = x.n""")
def triple_barrier(spark, sf):
    p = panel(spark, sf).withColumn("side", F.when(F.col("pred") > 0, 1).otherwise(-1))
    p = number_rows(p.drop("bar_no"))
    return out(bk.barrier_exits(p, 5, F.lit(0.2), F.lit(0.3)), ["symbol", "ts", "exit_reason", "exit_bars"], ["exit_gain"])


@query("b14_long_exits", f"""WITH {SQL_PANEL}, e AS (SELECT symbol, bar_no, ts, close, CASE WHEN pred > 0 THEN 1 ELSE -1 END AS side FROM panel1 WHERE abs(pred) > 0.8),
  m AS (SELECT e.*, f.bar_no - e.bar_no AS n, (f.close - e.close) / e.close * e.side AS g FROM e JOIN panel1 f ON f.symbol = e.symbol
    AND f.bar_no > e.bar_no AND f.bar_no <= e.bar_no + 250),
  h AS (SELECT symbol, ts, min(n) FILTER (g > 1.5 OR g < -0.9) AS hit, count(*) AS have FROM m GROUP BY ALL),
  x AS (SELECT e.symbol, e.ts, coalesce(h.hit, CASE WHEN h.have = 250 THEN 250 END) AS n, h.hit FROM e LEFT JOIN h USING (symbol, ts))
  SELECT x.symbol, x.ts, CASE WHEN x.hit IS NOT NULL THEN CASE WHEN m.g > 1.5 THEN 'take_profit' ELSE 'stop_loss' END
    WHEN x.n IS NOT NULL THEN 'max_holding' END AS exit_reason, CAST(x.n AS INT) AS exit_bars, {r_sql('m.g', 'exit_gain')}
  FROM x LEFT JOIN m ON m.symbol = x.symbol AND m.ts = x.ts AND m.n = x.n""")
def long_exits(spark, sf):
    """Exits of strong forecasts within 250 bars, by a join of bar buckets."""
    p = panel(spark, sf).select("symbol", "bar_no", "ts", "close", "pred")
    e = p.where(F.abs("pred") > 0.8).withColumn("side", F.when(F.col("pred") > 0, 1).otherwise(-1))
    return out(bk.entry_exits(e, p, 250, F.lit(0.9), F.lit(1.5)), ["symbol", "ts", "exit_reason", "exit_bars"], ["exit_gain"])


@query("b15_position_size", f"""WITH {SQL_PANEL} SELECT symbol, ts, CAST(trunc(greatest(least(pred * 5, 1), -1)
  * least(CAST(trunc(1000000 * 0.05::DOUBLE / close) AS BIGINT), 40)) AS BIGINT) AS shares FROM panel1""")
def position_size(spark, sf):
    from panelforge.operators.signals import clip_signal
    return panel(spark, sf).select("symbol", "ts", bk.target_shares(
        clip_signal(F.col("pred") * 5), 1_000_000.0, "close", 0.05, 40).alias("shares"))


# ---- joins ----------------------------------------------------------------------

@query("j01_benchmark_join", f"WITH {SQL_BARS}, {SQL_BENCH} SELECT x.symbol, x.ts, {r_sql('b1')}, {r_sql('b5')} FROM bars x LEFT JOIN bench USING (ts)")
def benchmark_join(spark, sf):
    r = feats.benchmark_returns(benchmark(spark, sf)).withColumnsRenamed({"bench_ret_1d": "b1", "bench_ret_5d": "b5"})
    return out(bars(spark, sf).join(r, "ts", "left"), ["symbol", "ts"], ["b1", "b5"])


@query("j02_outer_alignment", f"""WITH {SQL_BARS}, d AS (SELECT DISTINCT ts FROM bars), y AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY 1)
  SELECT y.symbol, count(*) AS n_dates, count(b.close) AS n_present, count(*) - count(b.close) AS n_absent FROM d JOIN y ON d.ts BETWEEN lo AND hi
  LEFT JOIN bars b ON b.ts = d.ts AND b.symbol = y.symbol GROUP BY 1""")
def outer_alignment(spark, sf):
    """Dates of the panel a symbol has no bar on, without building the dense grid."""
    b = bars(spark, sf)
    dates = bk.date_index(b)
    placed = b.join(dates, "ts").groupBy("symbol").agg(
        (F.max("i") - F.min("i") + 1).alias("n_dates"), F.count("close").alias("n_present"))
    return placed.withColumn("n_absent", F.col("n_dates") - F.col("n_present"))


@query("j04_pred_return_pairs", f"WITH {SQL_PANEL} SELECT ts, count(*) AS n, {r_sql('avg(pred * ret)', 'cov0')} FROM panel1 WHERE ret IS NOT NULL GROUP BY ts")
def pred_return_pairs(spark, sf):
    """Prediction and return frames aligned on (ts, symbol), complete pairs only."""
    p = panel(spark, sf)
    j = p.select("ts", "symbol", "pred").join(p.select("ts", "symbol", "ret"), ["ts", "symbol"], "left").na.drop(subset=["pred", "ret"])
    return out(j.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pred") * F.col("ret")).alias("cov0")), ["ts", "n"], ["cov0"])


@query("j06_sector_lookup", f"""WITH {SQL_BARS}, {SQL_SECTORS} SELECT sector, count(*) AS n_bars, count(DISTINCT symbol) AS n_symbols
  FROM bars LEFT JOIN sectors USING (symbol) GROUP BY sector""")
def sector_lookup(spark, sf):
    return bars(spark, sf).join(sectors(spark, sf), "symbol", "left").groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_bars"), F.countDistinct("symbol").alias("n_symbols"))


@query("j08_universe_semi_join", f"""WITH {SQL_BARS}, u AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_acctbal > 0)
  SELECT symbol, count(*) AS n FROM bars SEMI JOIN u USING (symbol) GROUP BY symbol""")
def universe(spark, sf):
    u = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return bars(spark, sf).join(u, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("j09_session_as_of", f"""WITH {SQL_LOG}, s AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS session FROM log WHERE isodow(ts) < 6)
  SELECT l.event_id, l.date, (SELECT max(session) FROM s WHERE s.symbol = l.symbol AND s.session <= l.date) AS session FROM log l""")
def session_as_of(spark, sf):
    log = prediction_log(spark, sf)
    sessions = log.where("weekday(ts) < 5").select("symbol", F.to_date("ts").alias("ts")).distinct()
    return monitor.resolve_sessions(log.select("symbol", "date", "event_id"), sessions).select("event_id", "date", "session")


@query("j10_forward_bar", f"""WITH {SQL_BARS} SELECT a.symbol, a.ts, b.ts AS realized_ts, {r_sql('b.close / a.close - 1', 'realized')}
  FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.bar_no = a.bar_no + 3""")
def forward_bar(spark, sf):
    b = bars(spark, sf)
    later = b.select("symbol", (F.col("bar_no") - 3).alias("bar_no"), F.col("ts").alias("realized_ts"), F.col("close").alias("c3"))
    j = b.join(later, ["symbol", "bar_no"]).withColumn("realized", F.col("c3") / F.col("close") - 1)
    return out(j, ["symbol", "ts", "realized_ts"], ["realized"])
