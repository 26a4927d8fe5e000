"""Operator 3: documents scored by the cross-entropy difference of two matched bigram models."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.registry import query, table
from panelforge.llm.words import WordHasher, kept_in_worker, mix64

#: (gram, document) rows that one task counts together; the number of parts follows the number of tokens.
PART_ROWS = 2_000_000
#: Rows a task holds before it sends them on.
FLUSH_ROWS = 750_000
#: Grams that make up 1 / HOT of all are so frequent that their counts are sent to all tasks; there are HOT at most.
HOT = 20_000
SKETCH_BITS = 14
_START = np.uint64(0x5851F42D4C957F2D)


def grams_of(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count): the contexts (last bit 0) and bigrams (last bit 1) of each text, in text order.

    Every word has the word before it as context, the first one a start symbol.
    """
    n = len(hashes)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    before = np.empty(n, np.uint64)
    before[1:] = hashes[:-1]
    before[bounds[:-1][sizes > 0]] = _START
    one = np.uint64(1)
    both = np.concatenate([mix64(before) & ~one, mix64(before * np.uint64(0x9FB21C651E98DF25) ^ mix64(hashes)) | one])
    text = np.concatenate([text, text])
    order = np.lexsort((both, text))
    both, text = both[order], text[order]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], both[at], np.diff([*at, len(both)])


def short_grams(gram: np.ndarray) -> bytes:
    """Grams cut to their low 48 bits: within a part, two are taken for one with probability 2^-48."""
    return np.ascontiguousarray(gram.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def whole_grams(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


@dataclass
class Frequent:
    """Counts of the frequent grams, sorted by gram."""

    gram: np.ndarray
    target: np.ndarray
    background: np.ndarray

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each gram is frequent, and its place."""
        if not len(self.gram):
            return np.zeros(len(gram), bool), np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        return self.gram[at] == gram, at


@dataclass
class Smoothing:
    """Both models' settings: `scale` brings background counts to the target's number of tokens."""

    prior: float
    vocabulary: float
    scale: float

    def terms(self, gram: np.ndarray, target: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What one occurrence of each gram adds to the target and background losses.

        p(w | u) = (c(u w) + prior / vocabulary) / (c(u) + prior): its logarithm is a term of the bigram less one of the context.
        """
        bigram = (gram & np.uint64(1)).astype(bool)
        extra = np.where(bigram, self.prior / self.vocabulary, self.prior)
        sign = np.where(bigram, -1.0, 1.0)
        return sign * np.log(target + extra), sign * np.log(self.scale * np.maximum(background, 0) + extra)


def _texts(docs: DataFrame, target: DataFrame, id_col: str, text: str, target_text: str) -> DataFrame:
    """Texts with `row`: a hash of id and text (63 bits) for documents, whatever order they come in, -1 for the target."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.select(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), F.col("doc_id").isNull(), "text").bitwiseAND(F.lit((1 << 63) - 1)).alias("row"), "doc_id", "text")
    return own.union(target.select(F.lit(-1).cast("long"), F.lit(None).cast("long"), F.col(target_text).cast("string")))


def _runs(batches: Iterator[pa.RecordBatch]):
    """(rows, doc ids, word hashes, bounds) of about a megabyte of text at a time."""
    hasher = kept_in_worker("words", WordHasher)
    for b in batches:
        row, doc = b.column("row").to_numpy(), b.column("doc_id")
        for first, hashes, bounds in hasher.batches(b.column("text").to_pylist()):
            size = len(bounds) - 1
            yield row[first:first + size], doc.slice(first, size), hashes, bounds


def _survey(texts: DataFrame) -> tuple[int, int, float, DataFrame]:
    """Tokens of the target and of the background, distinct words, and (gram, n) of grams that make up 1 / HOT of a run.

    Distinct words are counted by a sketch of 2^SKETCH_BITS registers over all words (error about 0.8 %).
    """

    hot = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(1 << SKETCH_BITS, np.int64)
        tokens = np.zeros(2, np.int64)
        for row, _, hashes, bounds in _runs(batches):
            h = np.unique(mix64(hashes))
            rank = 64 - np.frexp((h << np.uint64(SKETCH_BITS)).astype(np.float64))[1] + 1
            np.maximum.at(top, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.minimum(rank, 64 - SKETCH_BITS + 1))
            sizes = np.diff(bounds)
            tokens += [sizes[row < 0].sum(), sizes[row >= 0].sum()]
            _, gram, count = grams_of(hashes, bounds)
            total = pd.Series(count).groupby(gram).sum()
            total = total[total * hot >= 2 * len(hashes)]  # a context and a bigram for each word
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), 0, np.int32)), pa.array(total.index.to_numpy().view(np.int64)),
                                              pa.array(total.to_numpy().astype(np.int64))], names=["kind", "k", "n"])
        full = np.flatnonzero(top)
        kind = np.concatenate([np.full(len(full), 1, np.int32), np.full(2, 2, np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([full, [0, 1]])), pa.array(np.concatenate([top[full], tokens]))],
                                         names=["kind", "k", "n"])

    got = session.materialize(texts.mapInArrow(run, "kind int, k bigint, n bigint"), "survey")
    tokens = {r["k"]: r["n"] for r in got.where("kind = 2").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    m = 1 << SKETCH_BITS
    registers = got.where("kind = 1").groupBy("k").agg(F.max("n").alias("n")).agg(
        F.count("*").alias("c"), F.sum(F.pow(F.lit(2.0), -F.col("n"))).alias("s")).first()
    empty = m - registers["c"]
    distinct = 0.7213 / (1 + 1.079 / m) * m * m / ((registers["s"] or 0.0) + empty)
    if empty and distinct < 2.5 * m:
        distinct = m * np.log(m / empty)
    return tokens.get(0, 0), tokens.get(1, 0), float(distinct), got.where("kind = 0").select(F.col("k").alias("gram"), "n")


def _frequent(texts: DataFrame, candidates: DataFrame, grams: int) -> Frequent:
    """Exact counts of all grams that make up 2 / HOT of all or more, and of HOT grams at most.

    A gram is taken if the runs in which it makes up 1 / HOT hold so many of it that this is 1 / HOT of all; one that
    isn't has fewer than that in those runs and fewer in all the others together.
    """
    hot = candidates.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") * HOT >= grams).select("gram")
    keys = np.sort(np.array([r["gram"] for r in hot.collect()], np.int64).view(np.uint64))  # HOT rows at most
    empty = Frequent(keys, np.zeros(len(keys)), np.zeros(len(keys)))
    sent = texts.sparkSession.sparkContext.broadcast(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Frequent = sent.value
        sums = np.zeros((2, len(known.gram)))
        for row, _, hashes, bounds in _runs(batches):
            text, gram, count = grams_of(hashes, bounds)
            is_hot, at = known.find(gram)
            for k, chosen in enumerate((row[text] < 0, row[text] >= 0)):
                pick = is_hot & chosen
                sums[k] += np.bincount(at[pick], count[pick], len(known.gram)) if len(known.gram) else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known.gram))), pa.array(sums[0]), pa.array(sums[1])], names=["k", "t", "b"])

    if len(keys):
        for r in texts.mapInArrow(run, "k bigint, t double, b double").groupBy("k").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).collect():
            empty.target[r["k"]], empty.background[r["k"]] = r["t"], r["b"]
    return empty


def lm_scores(docs: DataFrame, target: DataFrame, prior: float = 10.0, id_col: str = "doc_id", text: str = "text",
              target_text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every document; the lower, the more like the target.

    Tokens are lower-cased words parted by ASCII white space.  The target model counts the texts of `target`, the
    background model those of all of `docs` but the one that is scored.  Both are bigram models with the same
    vocabulary, order and prior, and background counts are scaled to the target's number of tokens.  Losses are mean
    negative logarithms per token, score is their difference.  Null and texts without words have 0 tokens and null losses.
    Repeated rows are scored one by one, and a result doesn't hang on the order in which rows come.  Other columns are not used.

    (gram, document, count) rows are dealt by the gram's hash, packed into arrays; each part counts its grams and
    hands every document what they add to its losses.  Grams so frequent that they would fill a part are counted
    beforehand, at each task first, and their counts are sent to all tasks instead; their number is bounded.
    """
    spark = docs.sparkSession
    texts = _texts(docs, target, id_col, text, target_text)
    n_target, n_background, vocabulary, candidates = _survey(texts)
    parts = max(1, -(-(n_target + n_background) * 3 // (2 * PART_ROWS)))
    frequent = spark.sparkContext.broadcast(_frequent(texts, candidates, 2 * (n_target + n_background)))
    smooth = Smoothing(prior, max(vocabulary, 1.0), n_target / n_background if n_target and n_background else 1.0)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What frequent grams add."""
        hot: Frequent = frequent.value
        for row, doc, hashes, bounds in _runs(batches):
            t, g, c = grams_of(hashes, bounds)
            is_hot, at = hot.find(g)
            t, g, c, at = t[is_hot], g[is_hot], c[is_hot], at[is_hot]
            x, y = smooth.terms(g, hot.target[at], hot.background[at] - c) if len(at) else (at, at)
            own = pa.array(row >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row).filter(own), doc.filter(own), pa.array(np.diff(bounds)).filter(own),
                 pa.array(np.bincount(t, x * c, len(row)).astype(float)).filter(own), pa.array(np.bincount(t, y * c, len(row)).astype(float)).filter(own)],
                names=["row", "doc_id", "tokens", "t", "b"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows for each part: which of the block's documents, gram and count each row has.

        A row of its own, for a part below 0, says which documents a block holds.  Blocks are numbered within their task; `check`
        tells blocks apart that a task would make anew from rows in another order.
        """
        hot: Frequent = frequent.value
        first = TaskContext.get().partitionId() << 32
        held: dict[bool, list] = {False: [], True: []}  # of the target, of documents
        made = 0

        def flush(own: bool) -> pa.RecordBatch:
            nonlocal made
            rows, text, gram, count = zip(*held[own], strict=True)
            starts = np.cumsum([0, *map(len, rows)])
            text = np.concatenate([t + s for t, s in zip(text, starts)])
            gram, count, ids = np.concatenate(gram), np.concatenate(count), np.concatenate(rows)
            block, check = first + made, zlib.crc32(ids.tobytes())
            part = (mix64(gram) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out: list[tuple] = [(-1 - block % parts, block, check, own, ids.tobytes(), b"", b"")] if own else []
            for p in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[p]:cuts[p + 1]]
                out.append((int(p), block, check, own, text[mine].astype(np.uint32).tobytes(), short_grams(gram[mine]),
                            np.minimum(count[mine], 2**32 - 1).astype(np.uint32).tobytes()))
            made, held[own] = made + 1, []
            cols = [[*c] for c in zip(*out, strict=True)] or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                              names=["part", "block", "check", "own", "place", "gram", "count"])

        size = {False: 0, True: 0}
        for row, _, hashes, bounds in _runs(batches):
            t, g, c = grams_of(hashes, bounds)
            cold = ~hot.find(g)[0]
            own = bool(row[0] >= 0)
            if not ((row >= 0) == own).all():
                raise RuntimeError("a task reads documents or the target, not both")
            held[own].append((row, t[cold], g[cold], c[cold]))
            size[own] += int(cold.sum())
            if size[own] >= FLUSH_ROWS:
                yield flush(own)
                size[own] = 0
        for own, some in held.items():
            if some:
                yield flush(own)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        """What each block's documents get from one part; the lists of documents pass through."""
        none: list = [None] * len(pdf)
        if pdf["part"].iat[0] < 0:
            return pd.DataFrame({"block": pdf["block"], "check": pdf["check"], "ids": pdf["place"], "place": none, "t": none, "b": none})
        place = [np.frombuffer(x, np.uint32) for x in pdf["place"]]
        cuts = np.cumsum([0, *map(len, place)])
        gram = np.concatenate([whole_grams(x) for x in pdf["gram"]])
        count = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["count"]])
        distinct, at = np.unique(gram, return_inverse=True)
        sums = np.zeros((2, len(distinct)))
        for own, a, b in zip(pdf["own"], cuts, cuts[1:]):
            sums[int(own)] += np.bincount(at[a:b], count[a:b], len(distinct))
        out = []
        for own, block, check, where, a, b in zip(pdf["own"], pdf["block"], pdf["check"], place, cuts, cuts[1:]):
            if own:
                c, mine = count[a:b], at[a:b]
                x, y = smooth.terms(gram[a:b], sums[0][mine], sums[1][mine] - c)
                which, place_of = np.unique(where, return_inverse=True)
                out.append((block, check, None, which.tobytes(), *(np.bincount(place_of, v * c, len(which)).tobytes() for v in (x, y))))
        return pd.DataFrame(out, columns=["block", "check", "ids", "place", "t", "b"])

    def summed_up(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["check"].nunique() > 1 or pdf["ids"].count() != 1:
            raise RuntimeError("a block was made twice from rows in different orders; read the documents from a written table")
        row = np.frombuffer(pdf["ids"].dropna().iat[0], np.int64)
        t, b = np.zeros(len(row)), np.zeros(len(row))
        for place, x, y in zip(pdf["place"], pdf["t"], pdf["b"], strict=True):
            if place is not None:
                which = np.frombuffer(place, np.uint32)
                t[which] += np.frombuffer(x)
                b[which] += np.frombuffer(y)
        return pd.DataFrame({"row": row, "t": t, "b": b})

    blocks = texts.mapInArrow(dealt, "part bigint, block bigint, check bigint, own boolean, place binary, gram binary, count binary")
    cold = blocks.repartition(min(parts, 100_000), "part").groupBy("part").applyInPandas(
        counted, "block bigint, check bigint, ids binary, place binary, t binary, b binary")
    cold = cold.groupBy("block").applyInPandas(summed_up, "row bigint, t double, b double")
    hot = texts.mapInArrow(known, "row bigint, doc_id bigint, tokens bigint, t double, b double")
    both = hot.union(cold.select("row", F.lit(None).cast("long"), F.lit(None).cast("long"), "t", "b"))
    # Rows with equal id and text share a key and, each for itself, the same sums.
    summed = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("tokens").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"),
                                     F.count("tokens").alias("times"))
    summed = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    n = F.col("n_tokens") * F.col("times")
    return summed.select("doc_id", "n_tokens", F.when(n > 0, F.col("t") / n).alias("target_loss"), F.when(n > 0, F.col("b") / n).alias("background_loss"),
                         F.when(n > 0, (F.col("t") - F.col("b")) / n).alias("score"))


@query("op3_lm_scoring")
def op3(spark, sf):
    """Documents by how much they read like the conversations."""
    return lm_scores(table(spark, sf, "documents"), table(spark, sf, "conversations"))
