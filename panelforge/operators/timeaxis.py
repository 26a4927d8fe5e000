"""The time axis of a panel, split so that no task ever holds one entity whole.

Everything that looks back in time is naturally "per symbol", and one symbol may
own a large share of all rows.  Work is therefore keyed by (symbol, chunk):

* `number_rows` gives each row its position in its symbol, using calendar
  buckets and a prefix sum of their counts;
* `chunked` cuts the numbered axis into chunks of `size` rows and sends the last
  `halo` rows of each chunk to the following one as well, so a trailing frame of
  up to `halo` rows sees the same values it would on the unsplit axis;
* `running` and `forward_fill` combine a within-chunk pass with the totals
  carried over from the chunks before it.

Carried state is one row per (symbol, chunk), so the windows over it are small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

CHUNK_ROWS = 16_384
#: Rows of a task that many windows pass over.  Their rows grow tenfold on the way, so tasks are not sized by what is exchanged.
TASK_ROWS = 100_000
FIRST, CURRENT = Window.unboundedPreceding, Window.currentRow


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def number_rows(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",),
                bucket: str = "year(ts)", out: str = "bar_no") -> DataFrame:
    """0-based position of each row within its key, by `order`.

    `bucket` is an expression that does not decrease along the leading order
    column; one (key, bucket) pair is the unit sorted in a task.
    """
    b = df.withColumn("_bkt", F.expr(bucket))
    by = [*keys, "_bkt"]
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(FIRST, -1)
    offsets = b.groupBy(*by).agg(F.count(F.lit(1)).alias("_cnt")).select(
        *by, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")
    )
    if not keys:
        # One row per bucket of the whole table: bounded by the calendar.
        offsets = F.broadcast(offsets)
    within = F.row_number().over(Window.partitionBy(*by).orderBy(*_order(order))) - 1
    return (
        b.withColumn("_rn", within)
        .join(offsets, by)
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_bkt", "_rn", "_off")
    )


def chunked(df: DataFrame, halo: int = 0, ahead: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Add `_chunk` and `_pos` (row position inside the chunk, halo included).

    `halo` rows before and `ahead` rows after a chunk are copied into it.
    """
    size = max(size, halo, ahead)
    own = F.floor(F.col("bar_no") / size)
    place = F.col("bar_no") % size
    if halo or ahead:
        into_next = F.when(place >= size - halo, own + 1)
        into_prev = F.when((place < ahead) & (own > 0), own - 1)
        df = df.withColumn("_chunk", F.explode(F.array_compact(F.array(own, into_next, into_prev))))
    else:
        df = df.withColumn("_chunk", own)
    start = F.greatest(F.col("_chunk") * size - halo, F.lit(0))
    return df.withColumn("_own", F.col("_chunk") == own).withColumn("_pos", F.col("bar_no") - start)


def dealt(df: DataFrame, rows: int, keys: Sequence[str] = ("symbol",), per_task: int = TASK_ROWS) -> DataFrame:
    """A chunked frame of about `rows` rows, its chunks dealt to as many tasks as hold `per_task` rows each, and to every core.

    Every window over (keys, _chunk) runs where its chunk lies, so a task's memory doesn't grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(math.ceil(rows / per_task), cores, 2), *keys, "_chunk")


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies and the helper columns."""
    return df.where("_own").drop("_chunk", "_own", "_pos")


def chunk_window(keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("bar_no",)) -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy(*order)


def trailing(df: DataFrame, exprs: dict[str, Column], halo: int, ahead: int = 0,
             size: int = CHUNK_ROWS) -> DataFrame:
    """Add window expressions over `chunk_window()` that reach at most `halo` rows back and `ahead` forward."""
    return own_rows(chunked(df, halo, ahead, size).withColumns(exprs))


# ---- frames with a minimum number of observations ----------------------------

def over_rows(agg: Column, x: Column, w: WindowSpec, k: int, min_periods: int | None = None,
              end: int = 0) -> Column:
    """`agg` over the k rows ending `-end` rows back; NULL below `min_periods` observations of x."""
    frame = w.rowsBetween(end - k + 1, end)
    need = k if min_periods is None else min_periods
    return F.when(F.count(x).over(frame) >= need, agg.over(frame))


def roll_mean(x: Column, w: WindowSpec, k: int, min_periods: int | None = None) -> Column:
    return over_rows(F.avg(x), x, w, k, min_periods)


def roll_std(x: Column, w: WindowSpec, k: int, min_periods: int | None = None) -> Column:
    return over_rows(F.stddev_samp(x), x, w, k, min_periods)


def roll_min(x: Column, w: WindowSpec, k: int, min_periods: int | None = None) -> Column:
    return over_rows(F.min(x), x, w, k, min_periods)


def roll_max(x: Column, w: WindowSpec, k: int, min_periods: int | None = None) -> Column:
    return over_rows(F.max(x), x, w, k, min_periods)


def roll_quantile(x: Column, q: float, w: WindowSpec, k: int, min_periods: int, shift: int = 1) -> Column:
    """Interpolated quantile of the k rows that end `shift` rows back."""
    return over_rows(F.percentile(x, F.lit(q)), x, w, k, min_periods, end=-shift)


def lagged_return(x: Column, w: WindowSpec, k: int) -> Column:
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


# ---- frames that reach back to the first row ---------------------------------

_RUNNING = {
    # kind: (aggregate, combine(carry, within))
    "sum": (F.sum, lambda carry, x: F.coalesce(carry, F.lit(0.0)) + x),
    "max": (F.max, lambda carry, x: F.greatest(carry, x)),
    "min": (F.min, lambda carry, x: F.least(carry, x)),
    "product": (F.product, lambda carry, x: F.coalesce(carry, F.lit(1.0)) * x),
}


def running(df: DataFrame, specs: dict[str, tuple[str, str]], keys: Sequence[str] = ("symbol",),
            size: int = CHUNK_ROWS) -> DataFrame:
    """Running sum / max / min / product from the first row; specs: {out: (kind, column)}.

    As in the cumulative functions of pandas, a NULL is skipped by the total and
    stays NULL at its own row.  Requires `bar_no`.
    """
    by = [*keys, "_chunk"]
    c = df.withColumn("_chunk", F.floor(F.col("bar_no") / size))
    so_far = chunk_window(keys).rowsBetween(FIRST, CURRENT)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(FIRST, -1)
    totals = c.groupBy(*by).agg(*[_RUNNING[kind][0](F.col(x)).alias(out) for out, (kind, x) in specs.items()])
    carry = totals.select(
        *by, *[_RUNNING[kind][0](F.col(out)).over(earlier).alias(f"_carry_{out}") for out, (kind, _) in specs.items()]
    )
    local = c.withColumns({out: _RUNNING[kind][0](F.col(x)).over(so_far) for out, (kind, x) in specs.items()})
    joined = local.join(carry, by)
    return joined.withColumns({
        out: F.when(F.col(x).isNotNull(), _RUNNING[kind][1](F.col(f"_carry_{out}"), F.col(out)))
        for out, (kind, x) in specs.items()
    }).drop("_chunk", *[f"_carry_{out}" for out in specs])


def forward_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("symbol",),
                 order: Sequence[str] = ("ts",), bucket: str = "year(ts)",
                 out: dict[str, str] | None = None) -> DataFrame:
    """Replace NULLs by the latest earlier value; never looks ahead.

    Fills inside a calendar bucket, then from the last value of the buckets before.
    """
    out = out or {}
    by = [*keys, "_bkt"]
    b = df.withColumn("_bkt", F.expr(bucket))
    at = F.struct(*_order(order))
    ends = b.groupBy(*by).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols]
    )
    earlier = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(FIRST, -1)
    carry = ends.select(*by, *[F.last(c, True).over(earlier).alias(f"_carry_{c}") for c in cols])
    so_far = Window.partitionBy(*by).orderBy(*_order(order)).rowsBetween(FIRST, CURRENT)
    filled = b.withColumns({f"_fill_{c}": F.last(c, True).over(so_far) for c in cols}).join(carry, by)
    return filled.withColumns({
        out.get(c, c): F.coalesce(F.col(f"_fill_{c}"), F.col(f"_carry_{c}")) for c in cols
    }).drop("_bkt", *[f"_fill_{c}" for c in cols], *[f"_carry_{c}" for c in cols])
