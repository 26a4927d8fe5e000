"""Operator 2: exact and near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is its lower-cased words.  Two lines are near if one word edit (a word replaced, added or left out) turns one into
the other and both have at least `min_words` words.  A line goes if the same line, or a near one, occurs earlier.

Near lines m and m or m + 1 words long share their first or their last floor(m / 2) words.  A first pass puts every distinct line
into the four groups of the halves that it could share; only in groups that hold a possible partner are deletion
variants emitted, one for each word of the other half.  Lines that differ in place p share the variant without p, so the
earliest of a variant stands for all; a line that is one word longer than another has a variant that equals the other.
Each such pair is verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.registry import query, table

MIN_WORDS = 8
#: Word hashes are cut to so many bits, so that their sums over a line can't overflow.
BITS = 40


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[ \\t\\x0B\\f\\r]+"), lambda w: w != "")


def _small(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << BITS) - 1))


def _half_keys(words: Column, n: Column, min_words: int) -> Column:
    """(group, long) for the halves that a near line could share; long: the line would be the longer of the two."""
    def group(short: Column, long: bool) -> list[Column]:
        h = F.floor(short / 2).cast("int")
        halves = (F.slice(words, 1, h), F.slice(words, n - h + 1, h))
        return [F.struct(F.xxhash64(F.lit(side), short, half).alias("g"), F.lit(long).alias("long"), F.lit(side).alias("side"))
                for side, half in enumerate(halves)]

    none = F.array().cast("array<struct<g:bigint,long:boolean,side:int>>")
    return F.concat(F.when(n >= min_words, F.array(*group(n, False))).otherwise(none),
                    F.when(n > min_words, F.array(*group(n - 1, True))).otherwise(none))


def _documents(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


def _near_lines(docs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """h1, h2 of distinct lines that have a near line before them."""
    groups = lines.where(F.size("halves") > 0).select("h1", "h2", "first", F.explode("halves").alias("half")).select("h1", "h2", "first", "half.*")
    # A group matters if it holds a shorter line and another one.
    open_groups = groups.groupBy("g").agg(F.count("*").alias("c"), F.min("long").alias("l")).where("c > 1 and not l").select("g")
    members = session.materialize(groups.join(open_groups, "g", "left_semi"), "open_groups")
    # The words of those lines, from the documents where they come first.
    wanted = members.select("h1", "h2", "first").distinct().select("h1", "h2", F.col("first.id").alias("doc_id"), F.col("first.th").alias(
        "th"), F.col("first.line").alias("line"))
    where = wanted.groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines"))  # a document's lines at most
    one = _documents(docs, "doc_id", "text")
    texts = one.join(where, one["doc_id"].eqNullSafe(where["doc_id"]) & (one["th"] == where["th"])).select(
        F.explode(F.transform("lines", lambda i: F.get(F.split("text", "\n"), i))).alias("line"))
    words = texts.select(_words(F.col("line")).alias("words")).select(F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("line"), "words").alias("h2"), "words")
    words = session.materialize(words.dropDuplicates(["h1", "h2"]), "line_words")
    w = members.join(words, ["h1", "h2"]).withColumn("n", F.size("words"))
    # Where the half that isn't shared begins, and its words with their places.
    short = F.when(F.col("long"), F.col("n") - 1).otherwise(F.col("n"))
    h = F.floor(short / 2).cast("int")
    rest = F.when(F.col("side") == 0, F.slice("words", h + 1, F.col("n") - h)).otherwise(F.slice("words", 1, F.col("n") - h))
    w = w.withColumns({"rest": rest, "shift": F.when(F.col("side") == 0, h).otherwise(0)})
    id_of = F.struct("first", "h1", "h2").alias("who")
    # Places matter for a replaced word; what is left of the sum over places, without place p, is the variant.
    placed = F.transform("rest", lambda x, i: _small(F.xxhash64(i, x)))
    total = F.aggregate("placed", F.lit(0).cast("long"), lambda a, x: a + x)
    replaced = w.where(~F.col("long")).withColumn("placed", placed).withColumn("total", total).select(
        "g", id_of, F.posexplode("placed").alias("p", "x"), "total").select("g", "who", "p", (F.col("total") - F.col("x")).alias("variant"))
    replaced = session.materialize(replaced, "replaced")
    first = replaced.groupBy("g", "p", "variant").agg(F.min("who").alias("before"), F.count("*").alias("c")).where("c > 1")
    pairs = replaced.join(first, ["g", "p", "variant"]).where("who <> before").select("before", F.col("who").alias("after"))
    # For an added word places shift, so this sum is over words alone.
    bare = F.transform("rest", lambda x: _small(F.xxhash64(x)))
    summed = w.withColumn("placed", bare).withColumn("total", total)
    shorter = summed.where(~F.col("long")).select("g", F.col("total").alias("variant"), id_of)
    longer = summed.where("long").select("g", id_of, F.explode(F.array_distinct("placed")).alias("x"), "total").select(
        "g", (F.col("total") - F.col("x")).alias("variant"), F.col("who").alias("other"))
    added = longer.join(shorter, ["g", "variant"]).select(F.least("who", "other").alias("before"), F.greatest("who", "other").alias("after"))
    pairs = session.materialize(pairs.union(added).distinct(), "line_pairs")
    a = words.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("words").alias("a"))
    b = words.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("words").alias("b"))
    both = pairs.select(F.col("before.h1").alias("a1"), F.col("before.h2").alias("a2"), F.col("after.h1").alias("b1"),
                        F.col("after.h2").alias("b2")).join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    return both.where(one_word_edit(F.col("a"), F.col("b"))).select(F.col("b1").alias("h1"), F.col("b2").alias("h2")).distinct()


def one_word_edit(a: Column, b: Column) -> Column:
    """Whether at most one word edit turns one array of words into the other."""
    differing = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))
    longer = F.when(F.size(a) > F.size(b), a).otherwise(b)
    shorter = F.when(F.size(a) > F.size(b), b).otherwise(a)
    # The first place at which they part; zip_with pads the shorter array with nulls.
    part = F.array_position(F.zip_with(shorter, longer, lambda x, y: F.coalesce(x != y, F.lit(True))), True).cast("int")
    without = F.concat(F.slice(longer, 1, part - 1), F.slice(longer, part + 1, F.size(longer)))
    return F.when(F.size(a) == F.size(b), differing <= 1).when(
        F.abs(F.size(a) - F.size(b)) == 1, without == shorter).otherwise(False)


def line_decisions(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_lines, kept (line numbers from 0, sorted) of every row with a text that isn't null.

    Lines are parted by \\n, their words by other ASCII white space.  Lines without words always stay.  Documents are
    ordered by id (null last), then by the hash of the text, lines by their place.  Rows with equal id and text are one
    document, and get one row.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = F.size("words")
    texts = _documents(docs, "doc_id", "text").where("text is not null")
    occurrences = texts.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select(
        "doc_id", "th", "line", _words(F.col("raw")).alias("words")).where(n > 0).select(
        "doc_id", "th", "line", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("line"), "words").alias("h2"),
        _half_keys(F.col("words"), n, min_words).alias("halves"))
    at = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "th", "line")
    # Only distinct lines are written; what a document needs besides them is read off its text again.
    lines = session.materialize(occurrences.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.first("halves").alias("halves")), "lines")
    gone = session.materialize(_near_lines(docs, lines, min_words), "near_lines")
    stay = lines.select("h1", "h2", "first").join(gone, ["h1", "h2"], "left_anti").select(
        F.col("first.id").alias("doc_id"), F.col("first.th").alias("th"), F.col("first.line").alias("line"))
    kept = stay.groupBy("doc_id", "th").agg(F.collect_set("line").alias("kept"))
    blank = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(~x.rlike("[^ \t\x0B\f\r]"), i)), lambda i: i.isNotNull())
    sizes = texts.select("doc_id", "th", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), blank.alias("blank")).dropDuplicates(["doc_id", "th"])
    return sizes.join(kept, sizes["doc_id"].eqNullSafe(kept["doc_id"]) & (sizes["th"] == kept["th"]), "left").select(
        sizes["doc_id"], sizes["th"], "n_lines", F.sort_array(F.concat("blank", F.coalesce("kept", F.array().cast("array<int>")))).alias("kept"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the lines of their text that repeat an earlier line, or are near one, left out.

    Columns and rows stay; a text all of whose lines go becomes empty, a null text stays null.
    """
    decided = line_decisions(docs, min_words, id_col, text).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("n_lines").alias("__n"), F.col("kept").alias("__kept"))
    keyed = docs.withColumn("__key", F.xxhash64(F.col(text).cast("string")))
    joined = keyed.join(decided, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left")
    whole = F.col("__kept").isNull() | (F.size("__kept") == F.col("__n"))
    parts = F.split(F.col(text).cast("string"), "\n")
    cleaned = F.when(F.col(text).isNull() | whole, F.col(text)).otherwise(
        F.array_join(F.transform("__kept", lambda i: F.get(parts, i)), "\n"))
    return joined.withColumn(text, cleaned).select(*docs.columns)


OP2_SQL = r"""WITH occ AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line,
  list_filter(regexp_split_to_array(lower(ls[i]), '[ \t\x0B\f\r]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), generate_series(1, len(ls)) g(i)),
lines AS (SELECT words, len(words) AS n, min((doc_id, line)) AS first FROM occ WHERE len(words) > 0 GROUP BY words),
variants AS (SELECT words, n, first, p, list_concat(words[1:p - 1], words[p + 1:]) AS v
  FROM lines, generate_series(1, n) g(p) WHERE n >= 8),
pairs AS (SELECT b.words FROM variants a JOIN variants b ON a.n = b.n AND a.p = b.p AND a.v = b.v AND a.first < b.first
  UNION SELECT CASE WHEN a.first < b.first THEN b.words ELSE a.words END FROM variants a JOIN lines b ON a.v = b.words AND b.n >= 8),
stay AS (SELECT first FROM lines WHERE words NOT IN (SELECT words FROM pairs)),
d AS (SELECT o.doc_id, o.line, len(o.words) > 0 AND s.first IS NULL AS gone
  FROM occ o LEFT JOIN stay s ON s.first = (o.doc_id, o.line))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (NOT gone) AS BIGINT) AS n_kept,
  coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (gone), '') AS dropped_lines FROM d GROUP BY doc_id"""


@query("op2_line_dedup", OP2_SQL)
def op2(spark, sf):
    """A row for every document with a text: how many lines it has and keeps, and which go."""
    d = line_decisions(table(spark, sf, "documents"))
    every = F.transform(F.sequence(F.lit(0), F.col("n_lines") - 1), lambda i: i.cast("int"))
    return d.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"),
                    F.array_join(F.array_except(every, "kept"), ",").alias("dropped_lines"))
