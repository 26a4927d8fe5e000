"""Words of whole texts as 64-bit hashes, computed with numpy inside tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# ASCII white space: space, tab, line feed, vertical tab, form feed, return.
SPACES = b" \t\n\x0b\x0c\r"
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Hashes the words `[^\\x20\\x09-\\x0D]+` of lower-cased (A-Z) UTF-8 texts.

    A word's hash is a polynomial in an odd base modulo 2^64, finalised.  All words of a segment are hashed with a few
    array operations; a segment ends at white space, so memory follows the longest word, not the longest text.
    """

    def __init__(self, gaps: bytes = SPACES, prefixes: tuple[int, ...] = (), suffixes: tuple[int, ...] = ()) -> None:
        """gaps: the ASCII characters that part words; white space must be among them.

        With prefixes or suffixes (in bytes) a word has a row of hashes: its own, then those of its beginnings and
        ends, 0 where it isn't longer.
        """
        self.size, self.gaps, self.prefixes, self.suffixes = 0, gaps, prefixes, suffixes
        self.space = np.zeros(256, bool)
        self.space[list(gaps)] = True

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = n
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def _segment(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf = np.frombuffer(data, np.uint8)
        self._grow(len(buf) + 1)
        gap = np.ones(len(buf) + 2, bool)
        gap[1:-1] = self.space[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], out=total[1:])

        def of(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
            h = (total[b] - total[a]) * self.down[a]
            return mix64(h + ((b - a).astype(np.uint64) + np.uint64(kind << 40)) * np.uint64(0xD6E8FEB86659FD93))

        whole = of(start, end, 0)
        if not self.prefixes and not self.suffixes:
            return whole, start, end
        size, columns = end - start, [whole]
        for kind, k in [*((1, k) for k in self.prefixes), *((2, k) for k in self.suffixes)]:
            a, b = (start, np.minimum(start + k, end)) if kind == 1 else (np.maximum(end - k, start), end)
            columns.append(np.where(size > k, of(a, b, kind), np.uint64(0)))
        return np.stack(columns, axis=1), start, end

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end byte of each word of one lower-cased text (or of texts joined by white space)."""
        if len(data) <= 2 * _SEGMENT:
            return self._segment(data)
        parts, at = [], 0
        while at < len(data):
            stop = min(len(data), at + _SEGMENT)
            while stop < len(data) and data[stop] not in self.gaps:
                stop += 1
            h, s, e = self._segment(data[at:stop])
            parts.append((h, s + at, e + at))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def batches(self, texts: Iterable[str | None], spans: bool = False) -> Iterator[tuple]:
        """(index of the first text, word hashes, bounds) for runs of texts of about a megabyte.

        Words of the i-th text of a run are hashes[bounds[i]:bounds[i + 1]].  With spans, also the first byte of each
        word and the byte after it, counted from the start of its text.
        """
        run, size, first = [], 0, 0
        for i, t in enumerate(texts):
            raw = b"" if t is None else t.encode("utf-8", "surrogatepass").lower()
            run.append(raw)
            size += len(raw) + 1
            if size >= _SEGMENT:
                yield first, *self._run(run, spans)
                run, size, first = [], 0, i + 1
        if run:
            yield first, *self._run(run, spans)

    def _run(self, run: list[bytes], spans: bool) -> tuple:
        h, start, end = self.words(b"\n".join(run))
        offsets = np.cumsum([0] + [len(r) + 1 for r in run])
        bounds = np.searchsorted(start, offsets)
        if not spans:
            return h, bounds
        base = np.repeat(offsets[:-1], np.diff(bounds))
        return h, bounds, start - base, end - base


def split_words(text: str | None) -> list[bytes]:
    """The same words as byte strings."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def kept_in_worker(key, make):
    """An object that a Python worker keeps from task to task, such as a vocabulary and what is remembered about it.

    Spark reuses its Python workers; functions reach them anew with each task, so the object hangs on the interpreter.  A
    worker keeps one: that of the stage before goes when another stage asks for its own.
    """
    kept = sys.modules.setdefault("_panelforge_kept", types.ModuleType("_panelforge_kept")).__dict__.setdefault("kept", {})
    if key not in kept:
        if kept:
            kept.clear()
            give_back()
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Hand freed memory back to the system; allocators keep it otherwise, and the process's next step adds its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
