"""Operator 9: a convolutional text classifier in numpy, with thresholds calibrated by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.registry import query, table
from panelforge.llm.words import WordHasher, give_back, kept_in_worker

#: White space and ASCII punctuation part words.
GAPS = bytes(i for i in range(128) if not chr(i).isalnum())
#: A word's vector is the sum of those of the word, its beginnings and its ends (bytes).
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8, 10), (4, 6)
BUCKETS = 1 << 17
WIDTHS = (1, 2, 3)
#: Labelled rows fetched to fit on, of either label; the documented bound of the sample.
MAX_PER_LABEL = 2000
#: Bins of logits, in 1, and the greatest logit that has one.
BINS, MOST = 64, 32
_DRAWN = pa.schema([("toxic", pa.int32()), ("place", pa.int64()), ("hash", pa.int64()), ("text", pa.string())])


@dataclass
class TextCnn:
    """Hashed word embeddings, convolutions of several widths, max pooling over the text, and a logistic output.

    A word has a row of bucket ids: of itself and of its beginnings and ends; its vector is their sum.  Bucket 0 is padding; it and buckets that few training texts hold keep a zero vector.
    """

    dim: int = 12
    filters: int = 8
    seed: int = 7
    noise: float = 0.05
    scale: tuple[float, float] = (1.0, 0.0)
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, known: np.ndarray, odds: np.ndarray) -> None:
        """Small random values; the first dimension begins as each bucket's log odds, shared by the width-1 filters."""
        rng = np.random.default_rng(self.seed)
        e = rng.normal(0, self.noise, (BUCKETS, self.dim)).astype(np.float32)
        e[:, 0] = odds
        e[~known] = 0
        self.params = {"e": e, "out": rng.normal(0, 0.3, len(WIDTHS) * self.filters).astype(np.float32),
                       "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.params[f"w{w}"] = rng.normal(0, 0.5 / w, (w, self.dim, self.filters)).astype(np.float32)
            self.params[f"b{w}"] = np.zeros(self.filters, np.float32)
        self.params["w1"][0, 0] = np.abs(self.params["w1"][0, 0])
        self.params["out"][:self.filters] = np.abs(self.params["out"][:self.filters])

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        out = self.params["e"][ids[:, 0]]
        for k in range(1, ids.shape[1]):
            out += self.params["e"][ids[:, k]]
        return out

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Greatest value of every filter in each text; texts lie in ids one after another, each padded at its end."""
        out, tokens = [], self.vectors(ids)
        for w in WIDTHS:
            at = tokens @ self.params[f"w{w}"][0]
            for o in range(1, w):
                at[:-o] += tokens[o:] @ self.params[f"w{w}"][o]
            out.append(np.maximum.reduceat(at, starts, axis=0) + self.params[f"b{w}"])
        return np.maximum(np.concatenate(out, axis=1), 0)

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self.pooled(ids, starts) @ self.params["out"] + self.params["bias"]
        return self.scale[0] * z.astype(np.float64) + self.scale[1]

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01,
            keep: float = 0.9) -> None:
        """Adam over shuffled batches; both labels weigh the same; a share of the words is left out of each batch."""
        held = np.zeros((2, BUCKETS))
        for t, y in zip(texts, labels, strict=True):
            held[int(y), np.unique(t)] += 1
        known = held.sum(axis=0) >= 2
        known[0] = False
        rows = np.array([[(labels == 0).sum()], [(labels == 1).sum()]])
        logs = np.log((held + 0.5) / (rows + 1))
        n = held.sum(axis=0)
        self.start(known, (logs[1] - logs[0]) * n / (n + 3) / 3)
        rng = np.random.default_rng(self.seed + 1)
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                step += 1
                chosen = order[lo:lo + batch]
                ids, starts = join_texts([texts[i] for i in chosen])
                ids = np.where(rng.random(len(ids))[:, None] < keep, ids, 0)
                for k, g in self._gradients(ids, starts, labels[chosen], weight[chosen]).items():
                    m, v = moments[k]
                    if k == "e":  # only the rows that the batch touched
                        rows, g = g
                        m[rows] = 0.9 * m[rows] + 0.1 * g
                        v[rows] = 0.99 * v[rows] + 0.01 * g * g
                        self.params[k][rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-6)
                        continue
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                self.params["e"][~known] = 0

    def _gradients(self, ids, starts, labels, weight) -> dict:
        tokens, places = self.vectors(ids), {}
        pooled, grads = [], {}
        for w in WIDTHS:
            at = tokens @ self.params[f"w{w}"][0]
            for o in range(1, w):
                at[:-o] += tokens[o:] @ self.params[f"w{w}"][o]
            top = np.maximum.reduceat(at, starts, axis=0)
            same = at == np.repeat(top, np.diff([*starts, len(ids)]), axis=0)
            first = np.empty(top.shape, np.int64)
            for f in range(self.filters):
                hit = np.flatnonzero(same[:, f])
                first[:, f] = hit[np.searchsorted(hit, starts)]
            places[w] = first
            pooled.append(top + self.params[f"b{w}"])
        z = np.concatenate(pooled, axis=1)
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-(h @ self.params["out"] + self.params["bias"])))
        d = (weight * (p - labels) / len(labels)).astype(np.float32)
        grads["out"] = h.T @ d + 1e-4 * self.params["out"]
        grads["bias"] = np.array([d.sum()])
        dz = (d[:, None] * self.params["out"]) * (z > 0)
        rows, parts = [], []
        for n, w in enumerate(WIDTHS):
            dw = dz[:, n * self.filters:(n + 1) * self.filters]
            grads[f"b{w}"] = dw.sum(axis=0)
            g = np.zeros_like(self.params[f"w{w}"])
            for o in range(w):
                at = np.minimum(places[w] + o, len(ids) - 1)
                got = tokens[at]  # text, filter, dim
                g[o] = np.einsum("tfd,tf->df", got, dw)
                part = (dw[:, :, None] * self.params[f"w{w}"][o].T[None]).reshape(-1, self.dim)
                for k in range(ids.shape[1]):
                    rows.append(ids[at, k].ravel())
                    parts.append(part)
            grads[f"w{w}"] = g
        rows, parts = np.concatenate(rows), np.concatenate(parts)
        unique, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(unique), self.dim), np.float32)
        np.add.at(total, inverse, parts)
        grads["e"] = (unique, total)
        return grads


def join_texts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of texts one after another, each followed by padding for the widest window."""
    pad = np.zeros((max(WIDTHS) - 1, 1 + len(PREFIXES) + len(SUFFIXES)), np.int32)
    lengths = np.array([len(t) + len(pad) for t in texts])
    return np.concatenate([x for t in texts for x in (t, pad)]), np.cumsum(lengths) - lengths


def buckets(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == 0, 0, (hashes % np.uint64(BUCKETS - 1)).astype(np.int32) + 1).astype(np.int32)


@dataclass
class ToxicityModel:
    net: TextCnn | None
    thresholds: dict[str, float]
    constant: float = 0.0


def best_threshold(score: np.ndarray, label: np.ndarray, least: int = 15, weight: np.ndarray | None = None,
                   rows: np.ndarray | None = None) -> float:
    """The threshold of highest F1, in the middle between two scores; 0.5 where either label has few rows.

    An entry may stand for several `rows` (one by default) and weigh more or less than they do.
    """
    rows = np.ones(len(score)) if rows is None else rows
    weight = rows if weight is None else weight
    if (rows * label).sum() < least or (rows * (1 - label)).sum() < least:
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum((weight * label)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * label).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def platt(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over logits, by Newton steps on the weighted loss with Platt's targets."""
    ones, zeros = (weight * label).sum(), (weight * (1 - label)).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    w, x = weight / weight.sum(), np.stack([z, np.ones(len(z))], axis=1)
    loss = lambda t: (w * (np.logaddexp(0, x @ t) - target * (x @ t))).sum() + 5e-4 * (t[0] - 1) ** 2
    t = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ t)))
        slope = x.T @ (w * (p - target)) + np.array([1e-3 * (t[0] - 1), 0])
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9]), slope)
        while loss(t - step) > loss(t) and np.abs(step).max() > 1e-9:
            step = step / 2
        t = t - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(t[0], 0.05)), float(t[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL, id_col: str = "doc_id",
                 text: str = "text", lang: str = "lang") -> ToxicityModel:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0.

    Of each label the `max_per_label` rows with the lowest hash of their id are drawn; a fifth of them is kept from the
    fit.  All labelled rows outside the fit, drawn or not, calibrate the scores and, by language, the thresholds; they
    weigh as much as all labelled rows of their label (and language), so the draw does not change the labels' shares.
    An id counts once: it is toxic if any of its labels says so, and its document is the one of the least hash.  Null
    labels and rows without a document take no part; a null text is an empty one.  Without rows of both labels the score
    is a constant (1 if all are toxic, else 0).  Fewer than 200 drawn rows are all fitted on: scores then stay uncalibrated and every
    language has the threshold 0.5.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        "id is not null and toxic in (0, 1) and crc32(cast(cast(id as string) as binary)) % 5 <> 0").groupBy("id").agg(
        F.max("toxic").alias("toxic"))
    drawn = [usable.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(max_per_label) for v in (0, 1)]
    sample = F.broadcast(drawn[0].union(drawn[1]))  # two times max_per_label rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(GAPS, PREFIXES, SUFFIXES)
        for b in batches:
            ids = []
            for _, h, bounds in hasher.batches(b.column("text").to_pylist()):
                ids += [buckets(h[x:y]).tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("place"), pa.array(ids, pa.binary())],
                                             names=["toxic", "place", "ids"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The row of the least hash of each drawn id in a partition, so that rows of one id don't gather."""
        kept: dict[int, dict] = {}
        for b in batches:
            places, hashes = b.column("place").to_pylist(), b.column("hash").to_pylist()
            for i, (place, h) in enumerate(zip(places, hashes, strict=True)):
                if place not in kept or h < kept[place]["hash"]:
                    kept[place] = b.slice(i, 1).to_pylist()[0]
        rows = list(kept.values())
        for at in range(0, len(rows), 100):
            yield pa.RecordBatch.from_pylist(rows[at:at + 100], schema=_DRAWN)

    one = (_documents(docs, id_col, text, lang).join(sample, "id").select("toxic", F.xxhash64("id").alias("place"), "hash", "text")
           .mapInArrow(least, "toxic int, place bigint, hash bigint, text string")
           .groupBy("place").agg(F.min(F.struct("hash", "toxic", "text")).alias("m")).select("m.toxic", "place", "m.text"))
    got = one.mapInArrow(run, "toxic int, place bigint, ids binary").toArrow()
    label, place = (got.column(c).to_numpy().astype(np.int64) for c in ("toxic", "place"))
    if len(set(label)) < 2:
        return ToxicityModel(None, {}, float(label.mean()) if len(label) else 0.0)
    aside = (place % 5 == 0) if len(place) >= 200 else np.zeros(len(place), bool)
    chosen = np.argsort(place, kind="stable")
    chosen = chosen[~aside[chosen]]
    net = TextCnn()
    # The texts are views of what was received, and gone before the next job: the driver's memory is small.
    net.fit([np.frombuffer(got.column("ids")[int(i)].as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES) + len(SUFFIXES)) for i in chosen],
            label[chosen])
    del got
    give_back()
    if not aside.any():
        return ToxicityModel(net, {})
    bins = _labelled_logits(docs, usable, net, place[chosen].tolist(), id_col, text, lang)
    z, y, out, rows = bins["bin"].to_numpy() / BINS, bins["toxic"].to_numpy(np.int64), bins["outside"].to_numpy(float), bins["n"].to_numpy(float)
    if len(set(y[out > 0])) < 2:
        return ToxicityModel(net, {})

    def weights(chosen: np.ndarray) -> np.ndarray:
        """Weights of the chosen bins' rows outside the fit, with the sum over each label that all its rows have."""
        w = out * chosen
        for v in (0, 1):
            w[y == v] *= (rows * chosen)[y == v].sum() / max(1.0, w[y == v].sum())
        return w

    # The classes weighed the same in the fit; scores are brought back to the shares of all labelled rows.
    net.scale = platt(z, y, weights(np.ones(len(z), bool)))
    score = 1 / (1 + np.exp(-(net.scale[0] * z + net.scale[1])))
    spoken = bins["lang"].to_numpy()
    thresholds = {}
    for name in sorted({x for x in spoken if x is not None}):
        mine = (spoken == name) & (out > 0)
        thresholds[name] = best_threshold(score[mine], y[mine], weight=weights(spoken == name)[mine], rows=out[mine])
    return ToxicityModel(net, thresholds)


def _documents(docs: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    """id, lang and text of the rows that a label may be for, and the hash that chooses among rows of one id."""
    return (docs.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
            .where("id is not null and crc32(cast(cast(id as string) as binary)) % 5 <> 0").withColumn("hash", F.xxhash64("text", "lang")))


def _labelled_logits(docs: DataFrame, usable: DataFrame, net: TextCnn, fitted: list[int], id_col: str, text: str, lang: str):
    """All labelled rows, counted by language, label and bin of their logit: `n`, and `outside`, those not fitted on.

    Logits are found before the join, so that no text is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kept_in_worker("toxicity hasher", lambda: WordHasher(GAPS, PREFIXES, SUFFIXES))
        for b in batches:
            z = []
            for _, h, bounds in hasher.batches(b.column("text").to_pylist()):
                found = buckets(h)
                z.append(sent.value.logits(*join_texts([found[x:y] for x, y in zip(bounds, bounds[1:], strict=False)])))
            binned = np.clip(np.rint(np.concatenate(z) * BINS), -MOST * BINS, MOST * BINS) if z else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), b.column("lang"), pa.array(binned.astype(np.int32))],
                                             names=["id", "hash", "lang", "bin"])

    rows = _documents(docs, id_col, text, lang)
    # Rows of one id meet as one row of each partition, before the join.
    binned = (rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hash bigint, lang string, bin int")
              .groupBy("id").agg(F.min(F.struct("hash", "lang", "bin")).alias("m")).select("id", "m.lang", "m.bin"))
    mine = docs.sparkSession.createDataFrame([(x,) for x in sorted(set(fitted))], "place long")  # a draw's rows at most
    return (binned.join(usable, "id").withColumn("place", F.xxhash64("id")).join(F.broadcast(mine.withColumn("fit", F.lit(1))), "place", "left")
            .groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n"), F.count(F.when(F.col("fit").isNull(), 1)).alias("outside"))
            .orderBy("lang", "toxic", "bin").toPandas())  # bins of each label and language


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text", lang: str = "lang"
                   ) -> DataFrame:
    """Add toxic_score (0 to 1), toxic_threshold and is_toxic to every row, from its whole text.

    The language chooses the threshold (0.5 for one that had too few labelled rows, or null) and never moves the score.  A
    null or empty text has the score of no words.  Input columns named like an output are replaced.  No shuffle.
    """
    new = ["toxic_score", "toxic_threshold", "is_toxic"]
    df = docs.select(*[docs[c] for c in docs.columns if c not in new])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the layer sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value.net
        if net is not None:
            hasher = kept_in_worker("toxicity hasher", lambda: WordHasher(GAPS, PREFIXES, SUFFIXES))
        for b in batches:
            scores = []
            if net is None:
                scores = [sent.value.constant] * b.num_rows
            else:
                for _, h, bounds in hasher.batches(b.column(text).to_pylist()):
                    found = buckets(h)
                    ids, starts = join_texts([found[x:y] for x, y in zip(bounds, bounds[1:], strict=False)])
                    scores += (1 / (1 + np.exp(-net.logits(ids, starts)))).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "toxic_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    scored = df.mapInArrow(run, f"{schema}, toxic_score double")
    threshold = F.lit(0.5)
    if lang in df.columns:
        for name, t in model.thresholds.items():
            threshold = F.when(F.col(lang) == name, F.lit(t)).otherwise(threshold)
    return scored.withColumn("toxic_threshold", threshold).withColumn("is_toxic", F.col("toxic_score") >= F.col("toxic_threshold"))


def toxicity_model(spark: SparkSession, sf: str) -> ToxicityModel:
    return fit_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_toxicity")
def op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    scored = score_toxicity(docs, toxicity_model(spark, sf))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
                         F.col("toxic_threshold").alias("lang_threshold"))
