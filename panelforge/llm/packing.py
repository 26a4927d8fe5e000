"""Operator 10: vector best-fit packing of token sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.registry import query, table
from panelforge.llm.words import kept_in_worker

RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
END_ID = 2
#: Short pieces that one task packs together; the number of such groups follows the number of pieces.
GROUP_PIECES = 8192
#: Distinct text units whose ids a Python worker remembers; beyond it, it starts anew.
CACHE_UNITS = 300_000


class Encoder:
    """Ids of byte_bpe_50k.json without special tokens added; special strings inside a text become their own id.

    The rank file holds the same vocabulary as the json file.  A pre-token never crosses a space that follows a
    non-space or precedes one, so texts are cut there and the ids of short units are remembered as bytes.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.cut = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
        self.inner_gap = re.compile(r"\s \s").search
        self.known: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if self.inner_gap(text):
            return self._raw(text)
        head, *tail = text.split(" ")
        known = self.known
        ids = [*map(known.get, tail)]
        if None in ids:
            if len(known) >= CACHE_UNITS:
                known.clear()
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = x = self._raw(" " + tail[i])
                    if len(tail[i]) <= 64:
                        known[tail[i]] = x
        return self._raw(head) + b"".join(ids)

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(SPECIAL[p].to_bytes(4, "little") if p in SPECIAL else self._plain(p)
                        for p in self.cut.split(text) if p)


def cut_pieces(docs: DataFrame, capacity: int = 1024, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with END_ID at its end.

    Documents of up to `capacity` ids are one piece.  Longer ones are cut into pieces of `capacity`, of which the first
    may be shorter.  A null or empty text has END_ID alone.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("encoder", path), lambda: Encoder(path))
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                total, at, piece = len(ids) // 4, 0, 0
                size = total % capacity or capacity
                while at < total:
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, piece, size = at + size, piece + 1, capacity
            cols = [[*c] for c in zip(*rows, strict=True)] or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                                                strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def vector_best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "dot") -> np.ndarray:
    """Bin number of every item; items are taken from the longest on.

    An item of n tokens asks for (n tokens, 1 document, n * n attention cost).  Of the open bins whose residual covers
    the demand in every dimension, rule "dot" takes the one with the least weighted dot product of demand and what
    would be left, "norm" the one with the least weighted norm of what would be left; both are measured in shares of
    the capacity.  Ties go to the older bin.  Without such a bin a new one is opened.
    """
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    residual = np.empty((3, max(len(lengths), 1)))
    share = weights / capacity**2
    # Open bins only: bins whose tokens are used up can take nothing, as every item has a token.
    alive, n_bins = np.empty(0, np.int64), 0
    smallest = lengths.min() if len(lengths) else 0
    for i in order:
        n = float(lengths[i])
        need = np.array([n, 1.0, n * n])
        left = residual[:, alive] - need[:, None]
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            rest = left[:, fits]
            score = (share * need) @ rest if rule == "dot" else share @ (rest * rest)
            b = alive[fits[int(score.argmin())]]
        else:
            b = n_bins
            n_bins += 1
            residual[:, b] = capacity
            alive = np.append(alive, b)
        residual[:, b] -= need
        out[i] = b
        if residual[0, b] < smallest or residual[1, b] < 1:
            alive = alive[alive != b]
    return out


def pack(pieces: DataFrame, capacity: int = 1024, max_documents: int = 1024, max_attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """Add sequence_id and offset (place in the sequence, gapless from 0) to pieces with a `length` of 1 to `capacity`.

    Every sequence holds at most `capacity` tokens, `max_documents` pieces and an attention cost (sum of squared
    lengths) of `max_attention`, capacity squared by default.  Full pieces are sequences of their own.  The rest is
    dealt by hash into groups of about GROUP_PIECES pieces, whose number follows the number of pieces, and each group is
    packed by itself; then the sequences of all groups that are left less than 7/8 full are dealt anew and packed once more.  A
    piece longer than the capacity raises ValueError.  Repeated rows are packed as often as they occur.
    """
    spark = pieces.sparkSession
    top = np.array([capacity, max_documents, max_attention or capacity**2], float)
    w = np.array(weights, float)
    columns = pieces.columns
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["length"] > capacity).any():
            raise ValueError("a piece is longer than the capacity")
        pdf = pdf.sort_values([c for c in columns if c != "length"], kind="stable").sort_values(
            "length", ascending=False, kind="stable").reset_index(drop=True)
        bins = vector_best_fit(pdf["length"].to_numpy(np.int64), top, w, rule)
        pdf["_bin"] = bins
        pdf = pdf.sort_values("_bin", kind="stable")
        pdf["offset"] = pdf.groupby("_bin")["length"].cumsum() - pdf["length"]
        pdf["_fill"] = pdf.groupby("_bin")["length"].transform("sum")
        return pdf[[*columns, "_group", "_bin", "offset", "_fill"]]

    def packed(df: DataFrame, salt: int) -> DataFrame:
        n = df.count()
        groups = max(1, -(-n // GROUP_PIECES))
        keyed = df.withColumn("_group", F.pmod(F.xxhash64(F.lit(salt), F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
        out = keyed.repartition(min(groups, 100_000), "_group").groupBy("_group").applyInPandas(
            group, f"{schema}, _group bigint, _bin bigint, offset bigint, _fill bigint")
        return session.materialize(out, "packed")

    pieces = session.materialize(pieces, "pieces")
    full = pieces.where(F.col("length") == capacity)
    first = packed(pieces.where(F.col("length") != capacity), 1)
    # Sequence ids: a group's bins are numbered within it; the three kinds are told apart by their remainder by 3.
    number = (F.col("_group") * (GROUP_PIECES * 64) + F.col("_bin")) * 3
    good = first.where(F.col("_fill") >= capacity * 7 // 8)
    again = packed(first.where(F.col("_fill") < capacity * 7 // 8).select(*columns), 2)
    out = [*columns, "sequence_id", "offset"]
    return (full.withColumns({"sequence_id": F.monotonically_increasing_id() * 3, "offset": F.lit(0).cast("long")}).select(*out)
            .union(good.withColumn("sequence_id", number + 1).select(*out))
            .union(again.withColumn("sequence_id", number + 2).select(*out)))


def pack_documents(docs: DataFrame, capacity: int = 1024, ranks: str | None = None, **options) -> DataFrame:
    """Pieces of all documents with their sequences; see cut_pieces and pack.

    Columns beside doc_id and text are not used.  Without documents the result is empty.
    """
    return pack(cut_pieces(docs, capacity, ranks), capacity, **options)


@query("op10_packing")
def op10(spark, sf):
    return pack_documents(table(spark, sf, "documents"))
