"""Recursive exponential means y[t] = a*x[t] + (1-a)*y[t-1], y[0] = x[0], without recursion.

Rows of a chunk are grouped into blocks of `BLOCK` rows.  Inside a block the mean
is a scaled running sum; a block inherits the value its predecessors ended on,
weighted by how far back they are.  Weights below 1e-17 of the newest term are
beyond double precision, so only the last few blocks matter, and for the same
reason `memory_rows` of halo make a chunk independent of the ones before it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

BLOCK = 128
NEGLIGIBLE = 1e-17


def memory_rows(alpha: float) -> int:
    """Rows after which an old value weighs less than double precision can show."""
    return math.ceil(math.log(NEGLIGIBLE) / math.log1p(-alpha))


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def with_blocks(df: DataFrame) -> DataFrame:
    """Add the block columns `_blk` and `_q` to a chunked frame."""
    return df.selectExpr("*", f"floor(_pos / {BLOCK}) AS _blk", f"CAST(_pos % {BLOCK} AS INT) AS _q")


def chunk_axis(keys: tuple[str, ...] = ("symbol",)) -> str:
    """Partition and order of a chunk, as SQL.

    Same row order as `_pos` alone; naming the block lets the block sums and every
    other window of the chunk share one sort.
    """
    return f"PARTITION BY {', '.join([*keys, '_chunk'])} ORDER BY _blk, _pos"


def ewm_means(df: DataFrame, specs: dict[str, tuple[str, float]], keys: tuple[str, ...] = ("symbol",),
              extra: list[str] = ()) -> DataFrame:
    """Add exponential means to a frame prepared by `chunked` and `with_blocks`.

    specs: {out: (column, alpha)}, columns free of NULLs (gaps are filled at ingest).
    `extra` are further window expressions to evaluate in the same pass.
    """
    axis = chunk_axis(keys)
    block = f"OVER (PARTITION BY {', '.join([*keys, '_chunk', '_blk'])} ORDER BY _pos ROWS UNBOUNDED PRECEDING)"
    kept = df.columns
    local, carried, final = [], [], []
    for out, (x, alpha) in specs.items():
        keep = 1.0 - alpha
        if -BLOCK * math.log(keep) > 600.0:
            raise ValueError(f"alpha {alpha} is too close to 1 for a block of {BLOCK} rows")
        grown = f"IF(_pos = 0, 1D, {alpha!r}D) * {x} * pow({1.0 / keep!r}D, _q)"
        local.append(f"sum({grown}) {block} * pow({keep!r}D, _q) AS _l_{out}")
        terms = [f"_l_{out}"]
        for j in range(1, math.ceil(memory_rows(alpha) / BLOCK) + 1):
            terms.append(f"coalesce(lag(_l_{out}, {j * BLOCK}) OVER ({axis}), 0D) * {keep ** (j * BLOCK)!r}D")
        carried.append(f"IF(_q = {BLOCK - 1}, {' + '.join(terms)}, NULL) AS _e_{out}")
        inherited = f"last(_e_{out}, true) OVER ({axis} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        final.append(f"_l_{out} + pow({keep!r}D, _q + 1) * coalesce({inherited}, 0D) AS {out}")
    df = df.selectExpr("*", *local, *extra)
    named = [e.rsplit(" AS ", 1)[1] for e in extra]
    return df.selectExpr("*", *carried).selectExpr(*kept, *named, *final)
