"""Exact ranks and quantiles of groups of any size.

Groups that one sort can hold are ranked by a window each.  Larger ones are cut: quantiles of a range become the ends of
up to CUTS + 1 smaller ranges, and any of those that is still too large is cut again, so there are as many as the group
needs.  A value frequent enough to fill a range is a range of its own; its rows are all tied and need neither sort nor
window.  Where ties are broken by another column, such a range is cut again by that column.  Exact counts of the ranges before
it give each range its offset.

Quantiles need no ranks: a sketch brackets each wanted place, exact counts check the bracket, and only the rows inside it are
sorted.  Those of a whole table are found bit by bit, from counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.session import materialize

ROWS_PER_SORT = 1_000_000
#: Of a table that is one group; so that it is sorted by more than one task.
ROWS_OF_ALL = 100_000
CUTS = 255
#: Rounds of cutting; each divides a range by a hundred or more, or moves its ties to the next part of their key.
ROUNDS = 6
_BITS = 10
#: Bits of a value that one pass over a whole table finds, and values of a place that are then counted one by one.
_STEP, _FEW = 16, 2_000
#: Rows whose bits are counted at a time.
_HELD = 65_536
#: Bytes of a text that are compared as one number.
_BYTES = 6


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _part(x: str, tie: Sequence[str], kind: T.DataType | None) -> Column:
    """What a range is cut by: its values, and then, part by part, the column that breaks their ties."""
    if not tie:
        return F.col(x)
    t = F.col(tie[0])
    if isinstance(kind, T.StringType):
        raw = F.substring(t.cast("binary"), F.lit(1) + (F.col("_part") - 1) * _BYTES, F.lit(_BYTES))
        number = F.conv(F.rpad(F.hex(raw), 2 * _BYTES, "0"), 16, 10).cast("double")
    else:
        number = F.when(F.col("_part") == 1, t.cast("double")).otherwise(F.lit(0.0))
    return F.when(F.col("_part") == 0, F.col(x)).otherwise(F.coalesce(number, F.lit(-1.0)))


def _ranges(df: DataFrame, keys: Sequence[str], x: str, tie: Sequence[str], limit: int) -> DataFrame:
    """Add `_rng`, which rises with the order, and `_tied`: all rows of the range have one value.  NULLs have -1."""
    by = [*keys, "_rng"]
    kind = df.schema[tie[0]].dataType if tie else None
    zero = F.when(F.col(x).isNull(), -1).otherwise(0).cast("long")
    r = df.withColumns({"_rng": zero, "_tied": F.lit(False), "_part": F.lit(0)})
    for _ in range(ROUNDS):
        sizes = r.where("_rng >= 0 and not _tied").groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
        big = materialize(sizes.where(F.col("_size") > limit).drop("_size"), "large_ranges")
        if big.isEmpty():
            break
        r = r.withColumn("_v", _part(x, tie, kind))
        points = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
        cuts = r.join(big, by, "left_semi").groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", points, 10_000)).alias("_cuts"))
        r = r.join(materialize(cuts, "range_cuts"), by, "left")
        below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))
        is_cut = F.coalesce(F.array_contains("_cuts", F.col("_v")), F.lit(False))
        below = F.when(F.col("_cuts").isNull(), 0).otherwise(below)
        number = F.when(F.col("_rng") < 0, F.col("_rng")).otherwise(F.col("_rng") * (1 << _BITS) + 2 * below + is_cut.cast("long"))
        ties = {"_part": F.col("_part") + is_cut.cast("int")} if tie else {"_tied": F.col("_tied") | is_cut}
        r = r.withColumns({"_rng": number, **ties}).drop("_v", "_cuts")
    return r.drop("_part")


def group_ranks(df: DataFrame, keys: Sequence[str], x: str, spread: Sequence[str] = (), tie: Sequence[str] = (),
                limit: int | None = None, largest: int | None = None) -> DataFrame:
    """Rank column x inside each group.

    Adds `n` (values of the group) and either `less` and `eq` (rows strictly below, rows equal) or, with `tie`, `pos`: the
    0-based place in the order (x, *tie).  NULLs take no part and get NULLs.  largest: rows of the largest group, where
    the caller knows it.  spread: columns that tell rows apart; not needed any more.
    """
    keys = list(keys)
    df = df.withColumn(x, F.col(x).cast("double"))
    valid = F.col(x).isNotNull()
    limit = limit or (ROWS_PER_SORT if keys else ROWS_OF_ALL)
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        order = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last(), *tie)
        n = F.count(x).over(Window.partitionBy(*keys))
        if tie:
            return df.withColumns({"pos": F.when(valid, F.row_number().over(order) - 1), "n": n})
        same = order.rangeBetween(Window.currentRow, Window.currentRow)
        return df.withColumns({"less": F.when(valid, F.rank().over(order) - 1), "eq": F.when(valid, F.count(F.lit(1)).over(same)), "n": n})
    df = materialize(df, "ranked_rows")  # several passes follow
    r = materialize(_ranges(df, keys, x, tie, limit), "ranges")
    by = [*keys, "_rng"]
    sizes = r.where("_rng >= 0").groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    # One row for each range of a group.
    before = Window.partitionBy(*keys).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"),
                           F.sum("_size").over(Window.partitionBy(*keys)).alias("n"))
    within = Window.partitionBy(*by).orderBy(x, *tie)
    apart = r.where("_rng >= 0 and not _tied")
    if tie:
        apart = apart.withColumn("pos", F.row_number().over(within) - 1).join(offsets, by).withColumn("pos", F.col("pos") + F.col("_off"))
        new = ["pos"]
    else:
        same = within.rangeBetween(Window.currentRow, Window.currentRow)
        apart = apart.withColumns({"less": F.rank().over(within) - 1, "eq": F.count(F.lit(1)).over(same)}).join(offsets, by).withColumn(
            "less", F.col("less") + F.col("_off"))
        new = ["less", "eq"]
    columns = [*df.columns, *new, "n"]
    out = apart.select(*columns)
    if not tie:
        tied = r.where("_rng >= 0 and _tied").join(offsets, by)
        out = out.union(tied.withColumns({"less": F.col("_off"), "eq": F.col("_size")}).select(*columns))
    totals = sizes.groupBy(*keys).agg(F.sum("_size").alias("n"))
    none = r.where("_rng < 0")
    none = none.join(totals, keys, "left") if keys else none.join(F.broadcast(totals))  # one row
    return out.union(none.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in new} | {"n": F.coalesce("n", F.lit(0))}).select(*columns))


def average_rank() -> Column:
    """Average-tie rank (1-based) from the columns of `group_ranks`."""
    return F.col("less") + (F.col("eq") + 1) / 2.0


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], keys: Sequence[str] = (), limit: int = 20_000) -> DataFrame:
    """Linear-interpolated quantiles of several columns in each group: rows (*keys, feature, q, value).

    NULLs take no part; a column without values has no row.  A group of up to `limit` rows is one exact aggregate.  In larger
    ones all columns share three passes over the rows, none of which moves a row that no quantile needs: a sketch for the
    bracket of each place, counts, and the values inside the brackets.  A whole table is passed over as often, only to count.
    """
    keys, rows = list(keys), df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])

    def exact(some: DataFrame) -> DataFrame:
        every = some.groupBy(*keys).agg(*[F.percentile(f"_v{i}", F.array(*map(F.lit, qs))).alias(f"_p{i}") for i in range(len(cols))])
        return every.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(q)).alias("q"), F.col(f"_p{i}")[k].alias("value"))
                                                      for i, c in enumerate(cols) for k, q in enumerate(qs)]))).where("value is not null")

    largest = largest_group(rows, keys)
    if largest <= limit:
        return exact(rows)
    if not keys:
        return _of_whole_table(rows, cols, qs)
    large = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys), "large_groups")
    return exact(rows.join(large, keys, "left_anti")).union(_bracketed(rows.join(large, keys, "left_semi"), cols, qs, keys, limit))


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles, NaN last."""
    bits = (x + 0.0).view(np.int64)  # -0.0 counts as 0.0
    return np.where(bits < 0, ~bits, bits ^ np.int64(-2**63)).view(np.uint64)


def _doubles(u: np.ndarray) -> np.ndarray:
    bits = u.astype(np.uint64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(-2**63), ~bits).view(np.float64)


def _counted(rows: DataFrame, wanted: dict[int, list[int]], depth: int, width: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Of the values of column i whose first `depth` bits are a wanted prefix: how many continue with which `width` bits, ascending.

    Tasks count; a task's counts are as many as there are prefixes and continuations, whatever its rows.
    """
    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _HELD:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray | Counter] = {}
        for t in many(batches):
            for i, prefixes in wanted.items():
                u = _ordered_bits(t.column(i).drop_null().to_numpy())
                head = u >> np.uint64(64 - depth) if depth else None
                for p in prefixes:
                    rest = u if head is None else u[head == np.uint64(p)]
                    rest = (rest >> np.uint64(64 - depth - width)) & np.uint64((1 << width) - 1)
                    if width <= _STEP:
                        n = np.bincount(rest.astype(np.int64), minlength=1 << width)
                        totals[i, p] = totals[i, p] + n if (i, p) in totals else n
                    else:  # few values are left
                        totals.setdefault((i, p), Counter()).update(rest.tolist())
        for (i, p), n in totals.items():
            found = np.flatnonzero(n) if width <= _STEP else np.array(sorted(n), np.uint64)
            if len(found):
                of = n[found] if width <= _STEP else np.array([n[int(v)] for v in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i), pa.int32()), pa.array(np.full(len(found), p, np.uint64).view(np.int64)),
                                                  pa.array(found.astype(np.uint64).view(np.int64)), pa.array(of, pa.int64())], names=["i", "p", "v", "n"])

    total = rows.mapInArrow(count, "i int, p long, v long, n long").groupBy("i", "p", "v").agg(F.sum("n").alias("n"))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in total.collect():  # at most 2^_STEP, or _FEW, for each prefix
        out.setdefault((r["i"], r["p"] % (1 << 64)), []).append((r["v"] % (1 << 64), r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def _of_whole_table(rows: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """column_quantiles of one group of any size: the bits of each wanted place are found from the first on, by counting.

    No row is sorted or exchanged.  Two or three passes leave a few values for each place, which are then counted one by one.
    """
    top = _counted(rows, {i: [0] for i in range(len(cols))}, 0, _STEP)
    size = {i: sum(n for _, n in counts) for (i, _), counts in top.items()}
    spots = {(i, q): q * (size[i] - 1) for i in size for q in qs}
    # Of each place: its column, the bits known so far, and its place among the values that have them.
    at = {(i, place): (0, place) for (i, _), spot in spots.items() for place in (math.floor(spot), math.ceil(spot))}
    depth, counts, width = 0, top, _STEP
    while True:
        left = 0
        for (i, place), (prefix, k) in at.items():
            for v, n in counts[i, prefix]:
                if k < n:
                    break
                k -= n
            at[i, place], left = ((prefix << width) | v, k), max(left, n)
        depth += width
        if depth == 64:
            break
        width = min(_STEP, 64 - depth) if left > _FEW else 64 - depth
        wanted: dict[int, list[int]] = {}
        for (i, _), (prefix, _) in at.items():
            if prefix not in wanted.setdefault(i, []):
                wanted[i].append(prefix)
        counts = _counted(rows, wanted, depth, width)
    value = {k: float(_doubles(np.array([prefix], np.uint64))[0]) for k, (prefix, _) in at.items()}
    found = []
    for (i, q), spot in spots.items():
        lower, upper = value[i, math.floor(spot)], value[i, math.ceil(spot)]
        found.append((cols[i], float(q), lower if lower == upper else lower + (upper - lower) * (spot - math.floor(spot))))
    return rows.sparkSession.createDataFrame(found, "feature string, q double, value double")


def _bracketed(rows: DataFrame, cols: Sequence[str], qs: Sequence[float], keys: list[str], limit: int) -> DataFrame:
    """column_quantiles of groups of more than `limit` rows, of which a column may still have fewer values.

    A bracket of more than `limit` values is narrowed by a sketch of its own.  `near` is at least two places of such a
    group, so a bracket holds the places on both sides of a quantile.
    """
    limit = max(limit, 64)  # a narrowed bracket still holds a few values around its place
    near = 2 / min(limit, 10_000)
    wanted = [(i, k) for i in range(len(cols)) for k in range(len(qs))]

    def beside(some: DataFrame) -> DataFrame:
        return rows.join(some, keys) if keys else rows.join(F.broadcast(some))  # one row

    def at(i: int, k: int, field: str) -> Column:
        return F.col("_b")[f"w{i}_{k}"][field]

    def inside(i: int, k: int) -> Column:
        x = F.col(f"_v{i}")
        return (x > at(i, k, "lo")) & (x < at(i, k, "hi"))  # the ends themselves may hold any number of ties

    def bracket(points: Column, place: int, q_lo: Column, q_hi: Column) -> Column:
        """Ends of a bracket; infinite where the places reach beyond the values."""
        lo = F.when(q_lo <= 0, F.lit(float("-inf"))).otherwise(points[place])
        hi = F.when(q_hi >= 1, F.lit(float("inf"))).otherwise(points[place + 1])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    ends = [min(1.0, max(0.0, q + d)) for q in qs for d in (-near, near)]
    sketch = rows.groupBy(*keys).agg(*[f(f"_v{i}") for i in range(len(cols)) for f in (
        lambda c: F.percentile_approx(c, ends, 10_000).alias(f"_s{c[2:]}"), lambda c: F.count(c).alias(f"_n{c[2:]}"))])

    def first_bracket(i: int, k: int) -> Column:
        few = F.col(f"_n{i}") <= limit  # all of them
        return bracket(F.col(f"_s{i}"), 2 * k, F.when(few, 0.0).otherwise(qs[k] - near), F.when(few, 1.0).otherwise(qs[k] + near)).alias(f"w{i}_{k}")

    first = sketch.select(*keys, F.struct(*[first_bracket(i, k) for i, k in wanted]).alias("_b"))
    brackets = materialize(first, "brackets")
    while True:
        counts = [F.count(f"_v{i}").alias(f"n{i}") for i in range(len(cols))]
        for i, k in wanted:
            # Values up to the lower end, and those between the ends.
            x = F.col(f"_v{i}")
            counts += [F.count_if(x <= at(i, k, "lo")).alias(f"l{i}_{k}"), F.count_if(inside(i, k)).alias(f"c{i}_{k}")]
        counted = materialize(beside(brackets).groupBy(*keys).agg(*counts, F.first("_b").alias("_b")), "bracket_counts")
        wide = [F.col(f"c{i}_{k}") for i, k in wanted]
        widest = counted.agg(F.max(F.greatest(*wide) if len(wide) > 1 else wide[0])).first()[0]
        if (widest or 0) <= limit:
            break
        # Places within each bracket; one that was narrow enough stays as it is.
        sketch = beside(counted).groupBy(*keys).agg(
            F.first(F.struct(*[c for c in counted.columns if c not in keys])).alias("_c"),
            *[F.percentile_approx(F.when(inside(i, k), F.col(f"_v{i}")), [j / 2_000 for j in range(2_001)], 10_000).alias(f"_s{i}_{k}") for i, k in wanted])
        sketch = sketch.select(*keys, "_c.*", *[f"_s{i}_{k}" for i, k in wanted])

        def narrowed(i: int, k: int) -> Column:
            spot = F.floor(qs[k] * (F.col(f"n{i}") - 1)) - F.col(f"l{i}_{k}")
            share = spot / F.col(f"c{i}_{k}") * 2_000
            s = F.col(f"_s{i}_{k}")
            margin = 1 + 3 * 2_000 / F.col(f"c{i}_{k}")  # three places, and the sketch's error
            lo, hi = F.floor(share - margin).cast("int"), F.ceil(share + margin).cast("int")
            new = F.struct(F.when(lo < 0, at(i, k, "lo")).otherwise(F.get(s, F.least(lo, F.lit(2_000)))).alias("lo"),
                           F.when(hi > 2_000, at(i, k, "hi")).otherwise(F.get(s, F.greatest(hi, F.lit(0)))).alias("hi"))
            return F.when((F.col(f"c{i}_{k}") <= limit) | s.isNull(), F.col("_b")[f"w{i}_{k}"]).otherwise(new)

        brackets = materialize(sketch.select(*keys, F.struct(*[narrowed(i, k).alias(f"w{i}_{k}") for i, k in wanted]).alias("_b")), "brackets")
    held = F.array(*[F.when(inside(i, k), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"_v{i}").alias("x"))) for i, k in wanted])
    values = beside(counted.select(*keys, "_b")).select(*keys, F.inline(F.filter(held, lambda s: s.isNotNull())))
    values = values.groupBy(*keys, "i", "k").agg(F.sort_array(F.collect_list("x")).alias("_xs"))  # `limit` values at most
    spots = counted.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(cols[i]).alias("feature"), F.lit(float(qs[k])).alias("q"), F.col(f"n{i}").alias("_n"),
        F.col(f"l{i}_{k}").alias("_up_to"), F.col(f"c{i}_{k}").alias("_inside"), at(i, k, "lo").alias("_lo"), at(i, k, "hi").alias("_hi")) for i, k in wanted]))).where("_n > 0")
    spot = F.col("q") * (F.col("_n") - 1)

    def statistic(place: Column) -> Column:
        i = place - F.col("_up_to")
        return F.when(i < 0, F.col("_lo")).when(i >= F.col("_inside"), F.col("_hi")).otherwise(F.get("_xs", i.cast("int")))

    lower, upper = statistic(F.floor(spot)), statistic(F.ceil(spot))
    found = spots.join(values, [*keys, "i", "k"], "left")
    return found.select(*keys, "feature", "q", (lower + (upper - lower) * (spot - F.floor(spot))).alias("value"))


def exact_quantiles(df: DataFrame, x: str, qs: Sequence[float], keys: Sequence[str] = (), limit: int = 20_000) -> DataFrame:
    """Linear-interpolated quantiles of one column per group: rows (*keys, q, value)."""
    return column_quantiles(df, [x], qs, keys, limit).select(*keys, "q", "value")
