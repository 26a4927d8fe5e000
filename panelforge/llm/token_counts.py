"""Operator 8: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.registry import query, table
from panelforge.llm.words import kept_in_worker

VOCABULARY = "byte_bpe_50k.json"
#: Distinct text units whose count a Python worker remembers; beyond it, it starts anew.
CACHE_UNITS = 2_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of a byte-level BPE vocabulary file without making ids.

    A unit's bytes form a doubly linked list.  A heap holds (rank, place) of each mergeable neighbour pair; the lowest
    rank is popped, its pair becomes one symbol, and the two new pairs go on the heap.  The count is the number of
    bytes less the number of merges.  An entry is stale if the pair at its place has changed since.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        raw = byte_symbols()
        ids = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = [0] * 256
        for c, b in raw.items():
            self.first[b] = ids[c]
        self.made = [ids[a + b] for a, b in merges]
        #: Rank of a neighbour pair, by left id << 20 | right id; the earlier of equal merges counts.
        self.rank = {ids[a] << 20 | ids[b]: r for r, (a, b) in reversed([*enumerate(merges)])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.inner_gap = regex.compile(r"\s \s").search
        #: Tokens of units that follow a space, without that space.
        self.known: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        left = n = len(word)
        if n < 2:
            return n
        rank, made = self.rank.get, self.made
        sym = [*map(self.first.__getitem__, word)]
        now = [rank(a << 20 | b) for a, b in zip(sym, sym[1:])]
        now.append(None)
        heap = [r * n + i for i, r in enumerate(now) if r is not None]
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            low = heappop(heap)
            i = low % n
            r = low // n
            if now[i] != r:
                continue
            sym[i] = s = made[r]
            left -= 1
            j = after[i]
            now[j] = now[i] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = now[i] = rank(s << 20 | sym[k])
                if r is not None:
                    heappush(heap, r * n + i)
            p = before[i]
            if p >= 0:
                r = now[p] = rank(sym[p] << 20 | s)
                if r is not None:
                    heappush(heap, r * n + p)
        return left

    def unit(self, text: str) -> int:
        """Tokens of a stretch of text that no pre-token crosses."""
        return sum([self.merged(w.encode("utf-8", "surrogatepass")) for w in self.find(text)])

    def plain(self, text: str) -> int:
        """A space that follows a non-space, or precedes one, always starts a pre-token, so text is cut there."""
        if self.inner_gap(text):
            return self.unit(text)
        head, *tail = text.split(" ")
        known = self.known
        counts = [*map(known.get, tail)]
        if None in counts:
            if len(known) >= CACHE_UNITS:
                known.clear()
            for i, n in enumerate(counts):
                if n is None:
                    counts[i] = n = self.unit(" " + tail[i])
                    if len(tail[i]) <= 64:
                        known[tail[i]] = n
        return self.unit(head) + sum(counts)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def token_counts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", limit: int = 512) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row; other columns stay.

    vocabulary: a byte-level BPE file of the tokenizers library, at the same place on every executor.  Special strings
    inside a text count as one token each.  A null or empty text has no bytes and no tokens.  Repeated rows are counted
    alike; input columns named like an output are replaced.  Narrow: no shuffle.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    new = ["n_bytes", "n_tokens", "over_limit"]
    df = docs.select(*[docs[c] for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(("merge counter", path), lambda: MergeCounter(path))
        for b in batches:
            texts = b.column(text).to_pylist()
            n = [counter.count(t) for t in texts]
            cols = [pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()),
                    pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*rest, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, n_bytes bigint, n_tokens bigint, over_limit boolean")


@query("op8_token_counts")
def op8(spark, sf):
    counted = token_counts(table(spark, sf, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
