"""Operator 11: how far the sources of a language diverge in their use of terms, by a frequent-pattern tree of term rows.

The divergence of two sources sums |p - q| over all kept terms of their language, most of which one of the two hardly uses.
With z the p of a term that a source doesn't have, the sum of sources a and b is

    V * |z_a - z_b|  +  what the terms of a alone change  +  the same of b  +  corrections for terms that both have.

The first three parts follow from histograms of counts.  The last needs the pairs of sources of every term: a term is a row
of (source, count), sources in one order, the most widely used first.  Rows are inserted into a frequent-pattern tree; rows
with a common beginning share its path, and a node's multiplicity is the number of terms below it, so a pair of a node and
one of its ancestors is corrected once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.registry import query, table

MIN_DOCUMENTS = 30
TOP_TERMS = 50
#: Distinct terms that a task counts before it sends them on, and pair sums that it holds.
HELD_TERMS = 250_000
HELD_PAIRS = 1_000_000
_SEGMENT = 1 << 20
#: Bytes of terms, A-Z lower-cased, all others as spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_words(text: str | None) -> dict[bytes, int]:
    """Occurrences of the matches of [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+, only A-Z lower-cased, as UTF-8."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD)
    found: dict[bytes, int] = {}
    at = 0
    while at < len(raw):
        stop = raw.find(b" ", at + _SEGMENT)
        stop = len(raw) if stop < 0 else stop
        for w in raw[at:stop].split():
            found[w] = found.get(w, 0) + 1
        at = stop
    return found


def _partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), summed over runs of documents within each task."""
    schema = "lang string, source string, term string, n bigint, d bigint"
    names = ["lang", "source", "term", "n", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = 1 << 64  # n in the low bits, d above
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in held.items():
                terms, values = [*counts], [*counts.values()]
                for i in range(0, len(terms), 100_000):
                    part, v = pa.array(terms[i:i + 100_000], pa.binary()).cast(pa.string()), values[i:i + 100_000]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), part, pa.array(
                        [x & one - 1 for x in v], pa.int64()), pa.array([x >> 64 for x in v], pa.int64())], names=names)
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts = held.setdefault((lang, source), {})
                before = len(counts)
                for w, k in count_words(text).items():
                    counts[w] = counts.get(w, 0) + one + k
                size += len(counts) - before
                if size >= HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, schema)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact; 0 where there are no terms."""
    whole = (count + 5).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    over = F.call_function("div", whole, F.greatest(total + 5 * terms, F.lit(1)).cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + over.cast("long")).otherwise(F.lit(0).cast("long"))


def pair_rows(lang, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(low), pa.string()), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                                       pa.array(value, pa.int64())], names=["lang", "low", "high", "value"])


class PatternTree:
    """A frequent-pattern tree whose rows come sorted, so that all but the path of the latest row is complete.

    Items are (source number, count, p, z) with rising source numbers.  When a node is complete, its pairs with its
    ancestors are corrected, as often as there are rows below it.
    """

    def __init__(self) -> None:
        self.path: list[tuple[int, int, int, int]] = []
        self.times: list[int] = []
        self.nodes = self.held = 0
        self.numbers, self.ps, self.zs = (np.empty(16, np.int64) for _ in range(3))
        self.low: list[np.ndarray] = []
        self.high: list[int] = []
        self.value: list[np.ndarray] = []

    def insert(self, items: list[tuple[int, int, int, int]], times: int) -> None:
        shared = 0
        for a, b in zip(self.path, items):
            if a[:2] != b[:2]:
                break
            shared += 1
        self.close(shared)
        if len(items) > len(self.numbers):
            self.numbers, self.ps, self.zs = (np.resize(x, 2 * len(items)) for x in (self.numbers, self.ps, self.zs))
        for item in items[shared:]:
            k = len(self.path)
            self.numbers[k], self.ps[k], self.zs[k] = item[0], item[2], item[3]
            self.path.append(item)
            self.times.append(0)
        if items:
            self.times[-1] += times

    def close(self, depth: int) -> None:
        """Completes the nodes of the path below `depth`."""
        while len(self.path) > depth:
            number, _, p, z = self.path.pop()
            times, k = self.times.pop(), len(self.path)
            if k:
                self.times[-1] += times
                ps, zs = self.ps[:k], self.zs[:k]
                self.low.append(self.numbers[:k].copy())
                self.high.append(number)
                self.value.append(times * (np.abs(ps - p) - np.abs(ps - z) - np.abs(zs - p) + np.abs(zs - z)))
                self.held += k
            self.nodes += 1

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The corrections so far, one for each pair; they are forgotten."""
        if not self.low:
            none = np.empty(0, np.int64)
            return none, none, none
        low = np.concatenate(self.low)
        high = np.repeat(np.array(self.high, np.int64), [*map(len, self.low)])
        keys, place = np.unique(low << 31 | high, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate(self.value))
        self.low, self.high, self.value, self.held = [], [], [], 0
        return keys >> 31, keys & (1 << 31) - 1, total


def _common_terms(rows: DataFrame) -> DataFrame:
    """lang, low, high, value: the corrections for terms that both sources have; rows: lang, items, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now = PatternTree(), None
        for b in batches:
            langs, every, times = (c.to_pylist() for c in b.columns)
            for lang, items, n in zip(langs, every, times, strict=True):
                if lang != now or tree.held >= HELD_PAIRS:
                    if lang != now:
                        tree.close(0)
                    yield pair_rows(now, *tree.take())
                    now = lang
                tree.insert([(x["o"], x["c"], x["p"], x["z"]) for x in items], n)
        tree.close(0)
        yield pair_rows(now, *tree.take())

    ordered = rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")
    return ordered.mapInArrow(run, "lang string, low int, high int, value bigint")


def _own_terms(groups: DataFrame) -> DataFrame:
    """The other parts, for every pair; groups: lang, o, z, v, counts (p and number of terms), all (z by o)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a, z, every = r["o"], r["z"], np.array(r["all"], np.int64)
                # |p - x| summed over the terms of a, for the z of every source as x.
                counts = np.array(sorted((c["p"], c["m"]) for c in r["counts"] or []), np.int64).reshape(-1, 2)
                ps, m = counts[:, 0], counts[:, 1]
                below_m = np.concatenate([[0], np.cumsum(m)])
                below_s = np.concatenate([[0], np.cumsum(m * ps)])
                i = np.searchsorted(ps, every)
                off = every * (2 * below_m[i] - below_m[-1]) + below_s[-1] - 2 * below_s[i]
                gap = np.abs(every - z)
                numbers = np.arange(len(every))
                value = off - below_m[-1] * gap + np.where(numbers > a, r["v"] * gap, 0)
                other = numbers != a
                yield pair_rows(r["lang"], np.minimum(numbers, a)[other], np.maximum(numbers, a)[other], value[other])

    return groups.select("lang", "o", "z", "v", "counts", "all").mapInArrow(run, "lang string, low int, high int, value bigint")


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and by which terms.

    docs: text, lang, source; null values are ''.  Other columns are not used; every row is a document of its own, so rows
    that repeat count as often as they occur.  Terms, p, both parts, ranks and ties: see the contract of the query; all is
    exact.  A language without kept terms gives pairs of value 0.  Without documents the result is empty.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    by_term = _partial_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = by_term.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("by_source"), F.sum("n").alias("of_lang"),
                                               F.sum("d").alias("d")).where(F.col("d") >= min_documents).drop("d")
    kept = session.materialize(kept, "kept_terms")  # a row's list holds the sources of one language
    single = kept.select("lang", "term", "of_lang", F.explode("by_source").alias("s")).select("lang", "term", "of_lang", "s.*")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total"))
    sums = single.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    zero = {c: 0 for c in ("v", "lang_total", "total", "terms")}
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(zero)
    place = Window.partitionBy("lang").orderBy(F.col("terms").desc(), "source")  # one row for each source
    groups = groups.withColumns({"o": F.row_number().over(place) - 1, "z": _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))})
    groups = session.materialize(groups.drop("terms"), "source_groups")
    counts = single.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "o", "z", F.col("n").alias("c"), _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        _share(F.col("of_lang"), F.col("lang_total"), F.col("v")).alias("q"))
    counts = session.materialize(counts, "kept_counts")

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = counts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    rows = counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("o", "c", "p", "z"))).alias("items"))
    rows = session.materialize(rows.groupBy("lang", "items").agg(F.count("*").alias("times")), "term_rows")
    # Of one source's terms there are few distinct counts: their sum is bounded by its occurrences.
    histogram = counts.groupBy("lang", "o", "p").agg(F.count("*").alias("m")).groupBy("lang", "o").agg(F.collect_list(F.struct("p", "m")).alias("counts"))
    every = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "z"))), lambda x: x["z"]).alias("all"))
    own = _own_terms(groups.select("lang", "o", "z", "v").join(histogram, ["lang", "o"], "left").join(every, "lang"))
    pairs = own.union(_common_terms(rows)).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("low").alias("o"), F.col("high").alias("other")), F.struct(
        F.col("high").alias("o"), F.col("low").alias("other")))).alias("x")).select("lang", "value", "x.*")
    named = both.join(groups.select("lang", "o", "source"), ["lang", "o"]).join(
        groups.select("lang", F.col("o").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.union(terms)


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS nl FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(nl) AS tl FROM kept GROUP BY lang),
n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS t FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(t.t, 0) + 5 * v.v)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (k.nl + 5)) // (v.tl + 5 * v.v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50"""


@query("op11_source_divergence", OP11_SQL)
def op11(spark, sf):
    return source_divergence(table(spark, sf, "documents"))
