"""The feature contract on the sorted rows of whole chunks, in numpy.

A task receives its chunks one after the other, sorted, and works on some tens of thousands of rows at a time: columns
are flat arrays, and a row's place in its chunk tells how far back it may look.  A frame that must be full is added up
over its k shifts, relative to its newest value, so that nothing outside the frame takes part and equal values give
exactly 0.  NULL is NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from panelforge.operators.ewm import memory_rows, span_alpha
from panelforge.schema import EPS, FEATURE_COLS, HORIZON, LABEL, ZSCORE_COLS, ZSCORE_MIN_PERIODS, ZSCORE_WINDOW

WILDER = 1.0 / 14.0
#: Rows worked on at a time, about; chunks are never cut.
HELD_ROWS = 32_768


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = HELD_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, place of each row in its group) of whole groups, from batches in which groups follow one another."""
    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            at = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= at[1:] != at[:-1]
        return np.flatnonzero(new)

    def placed(t: pa.Table, first: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        return t, np.arange(t.num_rows) - np.repeat(first, np.diff([*first, t.num_rows]))

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            first = starts(t)
            cut = int(first[-1])
            if cut:
                yield placed(t.slice(0, cut), first[:-1])
            held, n = t.slice(cut).to_batches(), 0  # the group that may go on
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows:
            yield placed(t, starts(t))


class Frames:
    """Look-backs over flat arrays of whole groups; `place` is a row's number in its group."""

    def __init__(self, place: np.ndarray) -> None:
        self.place, self.n = place, len(place)
        self._back: dict[int, np.ndarray] = {}
        # For long frames groups are laid out in blocks as long as the frame, the last one filled up.
        self.first = np.flatnonzero(place == 0)
        self.sizes = np.diff([*self.first, self.n])

    def _reaches(self, k: int) -> np.ndarray:
        """Of the rows from the k-th on: which have a row k before them in their group."""
        if k not in self._back:
            self._back[k] = self.place[k:] >= k
        return self._back[k]

    def lag(self, x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(self.n, np.nan)
        out[k:] = np.where(self._reaches(k), x[:-k], np.nan)
        return out

    def lead(self, x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(self.n, np.nan)
        out[:-k] = np.where(self._reaches(k), x[k:], np.nan)
        return out

    def _full(self, x: np.ndarray, k: int) -> np.ndarray:
        """x of the rows from the k-1-th on, NaN where the frame isn't full."""
        out = np.full(self.n, np.nan)
        out[k - 1:] = np.where(self._reaches(k - 1), x, np.nan) if k > 1 else x
        return out

    def extreme(self, x: np.ndarray, k: int, of: Callable) -> np.ndarray:
        if self.n < k:
            return np.full(self.n, np.nan)
        out = x[k - 1:].copy()
        for j in range(k - 1):
            of(out, x[j:self.n - k + 1 + j], out=out)
        return self._full(out, k)

    def _moments(self, step: Callable[[int, np.ndarray], np.ndarray], k: int, spread: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Mean, less the newest value, and deviation of frames; step(j, d) gives the value j rows back less the newest."""
        m, d = np.zeros(self.n - k + 1), np.zeros(self.n - k + 1)
        for j in range(1, k):
            d = step(j, d)
            m += d
        m /= k
        if not spread:
            return m, None
        squares, d = m * m, np.zeros(self.n - k + 1)
        for j in range(1, k):
            d = step(j, d)
            e = d - m
            e *= e
            squares += e
        squares /= k - 1
        return m, np.sqrt(squares, out=squares)

    def roll(self, x: np.ndarray, k: int, spread: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """Mean, or mean and sample deviation, of the last k rows; all must have a value."""
        if self.n < k:
            return (np.full(self.n, np.nan),) * 2 if spread else np.full(self.n, np.nan)
        newest = x[k - 1:]

        def step(j: int, d: np.ndarray) -> np.ndarray:
            return np.subtract(x[k - 1 - j:self.n - j], newest, out=d)

        m, s = self._moments(step, k, spread)
        mean = self._full(newest + m, k)
        return (mean, self._full(s, k)) if spread else mean

    def score_of_total(self, x: np.ndarray, k: int) -> np.ndarray:
        """Z-score of the running total of x among its last k values: only their differences count, so the total isn't formed."""
        if self.n < k:
            return np.full(self.n, np.nan)

        def step(j: int, d: np.ndarray) -> np.ndarray:
            return np.subtract(d, x[k - j:self.n + 1 - j], out=d)

        m, s = self._moments(step, k, True)
        oldest = x[:self.n - k + 1]  # without a value there is no total at its row
        return self._full(np.where(np.isnan(oldest), np.nan, -m / (s + EPS)), k)

    def ewm(self, x: np.ndarray, alpha: float) -> np.ndarray:
        """y[t] = alpha * x[t] + (1 - alpha) * y[t-1], from y[0] = x[0]: sums over 1, 2, 4, .. rows, all rows at once."""
        y = np.where(np.isnan(x), 0.0, x) * np.where(self.place == 0, 1.0, alpha)
        reach, longest, memory = 1, int(self.sizes.max(initial=0)), memory_rows(alpha)
        while reach < min(longest, memory):
            y[reach:] += np.where(self._reaches(reach), y[:-reach], 0.0) * (1.0 - alpha) ** reach
            reach *= 2
        return y

    def zscores(self, cols: dict[str, np.ndarray], k: int, least: int) -> dict[str, np.ndarray]:
        """Z-scores over the last k rows, of those that have a value, `least` of them at least.

        A frame is the head of one block and the tail of the one before, each summed from its own end.
        """
        blocks = -(-self.sizes // k)
        base = np.concatenate([[0], np.cumsum(blocks)])
        at = self.place + np.repeat(base[:-1] * k, self.sizes)
        shape = (int(base[-1]), k)

        def over(x: np.ndarray) -> np.ndarray:
            laid = np.zeros(shape)
            laid.ravel()[at] = x
            total = np.cumsum(laid, axis=1)
            tail = np.cumsum(laid[:, ::-1], axis=1)[:, ::-1]
            tail[base[1:] - 1] = 0.0  # of a group's last block, as the block after it is another group's
            total[1:, :-1] += tail[:-1, 1:]
            return total.ravel()[at]

        counts: dict[bytes, np.ndarray] = {}
        out = {}
        for name, x in cols.items():
            known = ~np.isnan(x)
            id_ = np.packbits(known).tobytes()  # many columns lack the same rows
            if id_ not in counts:
                counts[id_] = over(known)
            n, v = counts[id_], np.where(known, x, 0.0)
            total, squares = over(v), over(v * v)
            n = np.where((n >= least) & (n > 1), n, np.nan)
            deviation = np.sqrt(np.maximum(squares - total * total / n, 0.0) / (n - 1))
            out[name] = (x - total / n) / (deviation + EPS)
        return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """NULL where b is 0."""
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


def contract(place: np.ndarray, bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All features, `raw_vol`, `raw_ret` and the label of the rows of whole chunks.

    bars: open, high, low, close, volume, the benchmark's returns b1 and b5, and rel: whether they count.
    """
    f = Frames(place)
    open_, high, low, close, volume = (bars[c] for c in ("open", "high", "low", "close", "volume"))
    before = f.lag(close, 1)
    change = np.nan_to_num(close - before, nan=0.0, posinf=np.inf, neginf=-np.inf)
    up, down = high - f.lag(high, 1), f.lag(low, 1) - low
    ret = {k: _ratio(close, f.lag(close, k)) - 1 for k in (1, 5, 10, 21)}
    traded = close * volume
    true_range = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    # Exponential means.
    macd = f.ewm(close, span_alpha(12)) - f.ewm(close, span_alpha(26))
    wide = f.ewm(true_range, WILDER) + EPS
    plus = 100 * f.ewm(np.where((up > down) & (up > 0), up, 0.0), WILDER) / wide
    minus = 100 * f.ewm(np.where((down > up) & (down > 0), down, 0.0), WILDER) / wide
    adx = f.ewm(100 * np.abs(plus - minus) / (plus + minus + EPS), WILDER)
    # Frames that must be full.
    lowest, highest = f.extreme(low, 14, np.minimum), f.extreme(high, 14, np.maximum)
    gain, loss = f.roll(np.maximum(change, 0.0), 14), f.roll(np.maximum(-change, 0.0), 14)
    mean20, sd20 = f.roll(close, 20, spread=True)
    _, vol20 = f.roll(ret[1], 20, spread=True)
    _, vol63 = f.roll(ret[1], 63, spread=True)
    traded20, traded_sd = f.roll(traded, 20, spread=True)
    mean50 = f.roll(close, 50)
    stoch = 100 * (close - lowest) / (highest - lowest + EPS)
    bottom, width = mean20 - sd20 * 2, (mean20 + sd20 * 2) - (mean20 - sd20 * 2)
    pressure = ((close - low) - (high - close)) / (high - low + EPS) * volume
    back12 = f.lag(close, 12)
    out = {
        **{f"ret_{k}d": r for k, r in ret.items()}, "vol_20d": vol20,
        "ma_spread_10_20": (f.roll(close, 10) - mean20) / (close + EPS), "ma_spread_20_50": (mean20 - mean50) / (close + EPS),
        "macd": macd, "macd_signal": f.ewm(macd, span_alpha(9)), "rsi_14": 100 - 100 / (1 + gain / (loss + EPS)),
        "price_vs_sma20": (close - mean20) / (mean20 + EPS), "price_vs_sma50": (close - mean50) / (mean50 + EPS),
        "bb_width": width / (close + EPS), "bb_position": (close - bottom) / (width + EPS),
        "stoch_k": stoch, "stoch_d": f.roll(stoch, 3), "roc_12": (close - back12) / (back12 + EPS),
        "atr_normalized": f.roll(true_range, 14) / (close + EPS), "adx_14": adx, "vol_regime": vol20 / (vol63 + EPS),
        "rel_volume": f.roll(volume, 5) / (f.roll(volume, 20) + EPS), "hl_ratio": (high - low) / (close + EPS),
        "turnover_z": (traded - traded20) / (traded_sd + EPS), "amihud_illiq": np.abs(ret[1]) / (traded + EPS),
        "gap": (open_ - before) / (before + EPS), "vpt_normalized": f.score_of_total(volume * ret[1], 20),
        "ad_normalized": f.score_of_total(np.where(np.isnan(pressure), 0.0, pressure), 20),
        "obv_normalized": f.score_of_total(np.nan_to_num(np.sign(change) * volume), 20),
        "ret_1d_vs_spy": np.where(bars["rel"], ret[1] - bars["b1"], 0.0), "ret_5d_vs_spy": np.where(bars["rel"], ret[5] - bars["b5"], 0.0),
        "raw_vol": vol20, "raw_ret": ret[1], LABEL: _ratio(f.lead(close, HORIZON), close) - 1,
    }
    out |= f.zscores({c: out[c] for c in ZSCORE_COLS}, ZSCORE_WINDOW, ZSCORE_MIN_PERIODS)
    return out | {c: np.where(np.isfinite(out[c]), out[c], np.nan) for c in FEATURE_COLS}


def feature_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, drop_warmup: bool) -> Iterator[pa.RecordBatch]:
    """Own rows of chunks with all features; columns that aren't computed pass as they are."""
    def number(t: pa.Table, name: str) -> np.ndarray:
        x = t.column(name).to_numpy().astype(float)
        return np.where(np.isinf(x), np.nan, x)

    for t, place in whole_groups(batches, ["symbol", "_chunk"]):
        bars = {c.lstrip("_"): number(t, c) for c in ("open", "high", "low", "close", "volume", "_b1", "_b5")}
        with np.errstate(all="ignore"):
            found = contract(place, bars | {"rel": number(t, "_rel") == 1})
        use = t.column("_own").to_numpy().astype(bool)
        if drop_warmup:
            for c in FEATURE_COLS:
                use &= ~np.isnan(found[c])
        kept = t.select([n for n in schema.names if n not in found]).filter(pa.array(use))
        yield from pa.table([kept.column(n) if n not in found else pa.array(found[n][use], from_pandas=True) for n in schema.names],
                            names=schema.names).to_batches(max_chunksize=HELD_ROWS)
