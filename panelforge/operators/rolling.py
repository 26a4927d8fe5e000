"""Trailing-window statistics at constant cost per row.

A sliding SQL frame recomputes its aggregate from every row it covers, so a
252-row z-score costs 252 updates per row and column.  Here the chunk is cut in
blocks as long as the window: the window ending at position q of a block is the
first q+1 rows of that block plus the last rows of the block before.  Both parts
come from growing frames, and are merged by the usual pairwise formulas for
counts, means, squared deviations, extremes and co-moments.  There is no
subtraction of running totals, so a large value leaves no trace once it has left
the window.

Use it on frames prepared by `timeaxis.chunked` with a halo of at least k-1 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Aggregates each statistic is merged from; {x} and {y} are column expressions.
_PARTS = {
    "mean": ("n", "avg"), "std": ("n", "avg", "var"), "var": ("n", "avg", "var"),
    "min": ("n", "min"), "max": ("n", "max"), "cov": ("n", "avg", "avg2", "cov"),
    "plain_mean": ("n", "sum"), "plain_std": ("n", "sum", "sq"),
}
_SQL = {
    "n": "count({x})", "avg": "avg({x})", "var": "var_pop({x})", "min": "min({x})", "max": "max({x})",
    "sum": "sum({x})", "sq": "sum({x} * {x})", "avg2": "avg({y})", "cov": "covar_pop({x}, {y})",
}


def block_roll(df: DataFrame, k: int, specs: dict[str, tuple], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add window statistics over the last k rows; all specs share two sorts and no shuffle.

    specs: {out: (kind, column, min_periods)} or {out: ("cov", (x, y), min_periods)}
    with kind in mean / std / var / min / max / cov.  cov counts complete pairs.
    plain_mean and plain_std use sums of values and squares: cheaper, and right
    for series whose mean is not many orders of magnitude above their deviation.
    """
    parts = {_id(part, x): (part, x) for kind, x, _ in specs.values() for part in _PARTS[kind]}
    axis = f"PARTITION BY {', '.join([*keys, '_chunk'])}"
    block = f"{axis}, _wb"
    tail = f"OVER ({block} ORDER BY _pos DESC ROWS UNBOUNDED PRECEDING)"
    head = f"OVER ({block} ORDER BY _pos ROWS UNBOUNDED PRECEDING)"
    df = df.selectExpr("*", f"floor(_pos / {k}) AS _wb", f"CAST(_pos % {k} AS INT) AS _wq")
    df = df.selectExpr("*", *[f"{_aggregate(*p)} {tail} AS _t{i}" for i, p in parts.items()])
    kept = [c for c in df.columns if not c.startswith("_t_")]
    df = df.selectExpr(
        *kept,
        *[f"{_aggregate(*p)} {head} AS _h{i}" for i, p in parts.items()],
        *[f"IF(_wq < {k - 1}, lag(_t{i}, {k - 1}) OVER ({axis} ORDER BY _wb, _pos), NULL) AS _e{i}" for i in parts])
    kept = [c for c in kept if c not in ("_wb", "_wq")]
    # Merge in two steps, so that counts and mean differences are computed once.
    steps = []
    for i, (part, _) in parts.items():
        if part == "n":
            steps += [f"_h{i}", f"coalesce(_e{i}, 0L) AS _e{i}", f"_h{i} + coalesce(_e{i}, 0L) AS _c{i}"]
        elif part in ("sum", "sq"):
            steps += [f"coalesce(_h{i}, 0D) AS _h{i}", f"coalesce(_e{i}, 0D) AS _e{i}"]
        else:
            steps += [f"_h{i}", f"_e{i}"]
            if part.startswith("avg"):
                steps.append(f"coalesce(_e{i} - _h{i}, 0D) AS _d{i}")
    df = df.selectExpr(*kept, *steps)
    return df.selectExpr(*kept, *[
        f"CASE WHEN _c{_id('n', x)} >= {m} THEN {_merge(kind, x)} END AS {out}" for out, (kind, x, m) in specs.items()])


def _id(part: str, x) -> str:
    return f"_{part}_{'__'.join(x) if isinstance(x, tuple) else x}"


def _aggregate(part: str, x) -> str:
    if isinstance(x, tuple):
        a, b = x
        return _SQL[part].format(x=f"IF({b} IS NOT NULL, {a}, NULL)", y=f"IF({a} IS NOT NULL, {b}, NULL)")
    return _SQL[part].format(x=x)


def _merge(kind: str, x) -> str:
    if kind in ("min", "max"):
        i = _id(kind, x)
        return f"{'least' if kind == 'min' else 'greatest'}(_h{i}, _e{i})"
    n, avg = _id("n", x), _id("avg", x)
    if kind.startswith("plain"):
        total = f"(_h{_id('sum', x)} + _e{_id('sum', x)})"
        if kind == "plain_mean":
            return f"{total} / _c{n}"
        squares = f"_h{_id('sq', x)} + _e{_id('sq', x)}"
        return f"IF(_c{n} > 1, sqrt(greatest({squares} - {total} * {total} / _c{n}, 0D) / (_c{n} - 1)), NULL)"
    if kind == "mean":
        return f"coalesce(_h{avg}, _e{avg}) + _d{avg} * _e{n} / _c{n}"
    part = _id("cov" if kind == "cov" else "var", x)
    other = _id("avg2", x) if kind == "cov" else avg
    inside = f"_h{n} * coalesce(_h{part}, 0D) + _e{n} * coalesce(_e{part}, 0D)"
    cross = f"_d{avg} * _d{other} * _h{n} * _e{n} / _c{n}"
    moment = f"IF(_c{n} > 1, ({inside} + {cross}) / (_c{n} - 1), NULL)"
    return f"sqrt({moment})" if kind == "std" else moment
