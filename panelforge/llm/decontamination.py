"""Operator 4: benchmark passages in documents by CGK embedding, bit-sampling LSH and exact edit verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelforge.llm.registry import query, table
from panelforge.llm.words import SPACES, WordHasher, kept_in_worker, mix64

#: White space and ASCII punctuation part words.
GAPS = bytes(i for i in range(128) if i in SPACES or not chr(i).isalnum())
#: Window sizes in words; an item has windows of the largest that is at most three quarters of it (four at least).
WIDTHS = (4, 8, 16)
#: Independent embeddings by width; the shortest items have few windows.  Tests hold the recall on items of each length
#: with the greatest number of edits, at even and odd places, against 0.95.
REPEATS = {4: 16, 8: 8, 16: 8}
#: Every word of a document starts a window, as every word of an item does.
STRIDE = 1
SAMPLES = 4
#: Items sent to the executors at once; more of them are searched in further passes over the documents.
MAX_ITEMS = 20_000
LEAK = "array<struct<item_id:bigint,start_word:int,end_word:int,start_byte:bigint,end_byte:bigint,edits:int>>"
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()),
                            ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("edits", pa.int32())]))


def width_of(words: int) -> int:
    """The width of the windows of an item of so many words; every item has at least two windows."""
    return max(x for x in WIDTHS if x == WIDTHS[0] or 4 * x <= 3 * words)


def sampled_steps(width: int, repeat: int) -> np.ndarray:
    """The steps of the walk whose symbols one repetition samples: one from each quarter of the 2 * width steps."""
    rng = np.random.default_rng(1000 * width + repeat)
    quarter = 2 * width // SAMPLES
    return np.arange(SAMPLES) * quarter + rng.integers(0, quarter, SAMPLES)


def cgk_keys(symbols: np.ndarray, starts: np.ndarray, width: int, repeat: int, halfway: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in `starts`, half-way and full keys of the windows of `width` symbols at `starts`.

    A window is embedded by a random walk of 2 * width steps: step t emits the symbol it stands on, and a random bit of
    (t, symbol) decides whether it moves on; past the window it emits padding.  Few edits of a window change few
    emitted symbols.  The key hashes the sampled ones.  With `halfway`, a filter of half-way keys, windows that don't
    pass it are left after half of the samples.
    """
    steps = sampled_steps(width, repeat)
    bits = mix64(symbols ^ np.uint64(0x9E3779B97F4A7C15 * (repeat + 1) & (1 << 64) - 1))
    at = starts.astype(np.int64)
    end = at + width
    here = np.arange(len(at))
    key = np.full(len(at), np.uint64(width * 131 + repeat))
    half, taken = key, 0
    for t in range(int(steps[-1]) + 1):
        if t == steps[taken]:
            emitted = np.where(at < end, symbols[at], np.uint64(0))
            key = mix64(key ^ emitted)
            taken += 1
            if taken == SAMPLES // 2:
                half = key
                if halfway is not None:
                    keep = np.flatnonzero(halfway[(key & np.uint64(len(halfway) - 1)).astype(np.int64)])
                    here, at, end, key, half = here[keep], at[keep], end[keep], key[keep], half[keep]
        if t < steps[-1]:
            at = at + ((bits[at] >> np.uint64(t)) & np.uint64(1)).astype(np.int64)
    return here, half, key


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least number of word edits that turn a stretch of text into the item, and that stretch; the earliest end wins."""

    def row_by_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        place = np.arange(len(b) + 1)
        d = np.zeros(len(b) + 1, np.int64) if free else place.copy()
        for i, x in enumerate(a):
            new = np.empty_like(d)
            new[0] = i + 1
            new[1:] = np.minimum(d[:-1] + (b != x), d[1:] + 1)
            d = np.minimum.accumulate(new - place) + place
        return d

    d = row_by_row(item, text, True)
    end = int(d.argmin())
    back = row_by_row(item[::-1], text[:end][::-1], False)
    return int(d[end]), end - int(back.argmin()), end


@dataclass
class Items:
    """Benchmark items prepared for the search."""

    ids: list
    words: list[np.ndarray]
    edit_share: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}  # each worker makes its own

    @cached_property
    def tables(self) -> list[tuple]:
        """(width, repeat, filters of half-way and full keys, keys, items, offsets) for every width and repetition."""
        tables = []
        by_width: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w in enumerate(self.words):
            width = width_of(len(w))
            by_width[width] += [(i, o) for o in range(len(w) - width + 1)]
        padded = np.concatenate([x for w in self.words for x in (w, np.zeros(2 * max(WIDTHS), np.uint64))]) if self.words else None
        first = np.cumsum([0] + [len(w) + 2 * max(WIDTHS) for w in self.words])
        for width, places in sorted(by_width.items()):
            item, offset = (np.array(x) for x in zip(*places, strict=True))
            for r in range(REPEATS[width]):
                _, half, key = cgk_keys(padded, first[item] + offset, width, r)
                order = np.argsort(key, kind="stable")
                size = 1 << int(np.clip(len(key) * 64, 1 << 16, 1 << 24)).bit_length()
                low, full = np.zeros(size, bool), np.zeros(size, bool)
                low[(half & np.uint64(size - 1)).astype(np.int64)] = True
                full[(key & np.uint64(size - 1)).astype(np.int64)] = True
                tables.append((width, r, low, full, key[order], item[order], offset[order]))
        return tables

    def candidates(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place where the item would start) of all windows that share a key with a window of an item."""
        found_item, found_at = [], []
        for width, r, low, full, keys, item, offset in self.tables:
            here, _, key = cgk_keys(symbols, starts, width, r, low)
            keep = full[(key & np.uint64(len(full) - 1)).astype(np.int64)]
            here, key = here[keep], key[keep]
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            n = hi - lo
            row = np.repeat(np.arange(len(n)), n)
            entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
            found_item.append(item[entry])
            found_at.append(starts[here[row]] - offset[entry])
        pairs = np.unique(np.stack([np.concatenate(found_item), np.concatenate(found_at)]), axis=1) if found_item else np.empty((2, 0), int)
        return pairs[0], pairs[1]

    def leaks(self, text: np.ndarray, items: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified matches of one text, from its candidates sorted by item and place."""
        out = []
        for i in np.unique(items):
            item = self.words[i]
            n = len(item)
            k = int(self.edit_share * n)
            mine, reach = [], -1
            for a in at[items == i]:
                if a <= reach:  # the stretch that was just held against the item covers this one
                    continue
                lo, hi = max(0, a - k), min(len(text), a + n + 2 * k)
                part = text[lo:hi]
                reach = a + k
                if np.isin(item, part).sum() < n - k:
                    continue
                edits, s, e = edit_match(item, part)
                if edits <= k:
                    mine.append((edits, lo + s, lo + e))
            taken: list[tuple[int, int, int]] = []
            for edits, s, e in sorted(mine):
                if all(e <= x or s >= y for _, x, y in taken):
                    taken.append((edits, s, e))
            out += [(int(i), s, e, edits) for edits, s, e in taken]
        return sorted(out, key=lambda x: (x[1], x[0]))


def _item_blocks(benchmark: DataFrame, id_col: str, text: str, min_words: int, edit_share: float, max_items: int) -> Iterator[Items]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-rows.count() // max_items))
    for block in range(blocks):
        hasher, ids, words = WordHasher(GAPS), [], []
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        for r in part.distinct().orderBy("id", "text").collect():  # about max_items rows
            h, _, _ = hasher.words(r["text"].encode("utf-8", "surrogatepass").lower())
            if len(h) >= min_words:
                ids.append(r["id"])
                words.append(h)
        if ids:
            yield Items(ids, words, edit_share)


def with_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, min_words: int = 5, text: str = "text",
               item_id: str = "item_id", item_text: str = "text", max_items: int = MAX_ITEMS) -> DataFrame:
    """Add `leaks` to every row: the benchmark items that its whole text holds with at most edit_share * n word edits.

    Words are lower-cased (A-Z) and parted by white space and ASCII punctuation; n is the item's number of words.  A
    leak has the item's id, its stretch in words and UTF-8 bytes, and the edits; stretches of one item don't overlap.
    Null texts have no leaks; null items and items of fewer than `min_words` words (too short to tell a leak from chance)
    take no part; equal items of one id count once.  An input column `leaks` is replaced.  No shuffle of the documents.
    """
    columns = [c for c in docs.columns if c != "leaks"]
    df = docs.select(*[docs[c] for c in columns]).withColumn("leaks", F.from_json(F.lit("[]"), LEAK))
    for items in _item_blocks(benchmark, item_id, item_text, min_words, edit_share, max_items):
        df = _search(df, docs.sparkSession.sparkContext.broadcast(items), text)
    return df


def _search(df: DataFrame, sent, text: str) -> DataFrame:
    columns, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kept_in_worker("item words", lambda: WordHasher(GAPS))
        items: Items = sent.value
        pad = np.zeros(2 * max(WIDTHS), np.uint64)
        for b in batches:
            texts = b.column(columns.index(text)).to_pylist()
            leaks = b.column(len(columns) - 1).to_pylist()
            for first, h, bounds, start, end in hasher.batches(texts, spans=True):
                parts, at, doc = [], 0, []
                origin = np.empty(len(bounds) - 1, np.int64)
                for d, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    origin[d] = at
                    parts += [h[x:y], pad]
                    at += y - x + len(pad)
                    doc.append(np.arange(origin[d], origin[d] + y - x, STRIDE))
                item, place = items.candidates(np.concatenate(parts), np.concatenate(doc))
                for d, x, y in zip(range(len(origin)), bounds, bounds[1:], strict=False):
                    # A stretch may begin up to the allowed edits before its text does.
                    mine = (place >= origin[d] - len(pad)) & (place < origin[d] + (y - x))
                    if not mine.any():
                        continue
                    leaks[first + d] += [
                        {"item_id": items.ids[i], "start_word": s, "end_word": e, "start_byte": int(start[x + s]),
                         "end_byte": int(end[x + e - 1]), "edits": edits}
                        for i, s, e, edits in items.leaks(h[x:y], item[mine], place[mine] - origin[d])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(leaks, _LEAK)], names=columns)

    return df.mapInArrow(run, StructType(schema.fields))


@query("op4_decontamination")
def op4(spark, sf):
    found = with_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
