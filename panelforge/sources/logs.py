"""Append-only JSON-lines logs and nested output documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge import schema
from panelforge.operators.quality import keep_one


def read_jsonl(spark: SparkSession, path: str, fields: T.StructType = schema.PREDICTION_LOG) -> DataFrame:
    """Log rows; blank and malformed lines are skipped."""
    return spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path)


def parse_lines(lines: DataFrame, fields: T.StructType, column: str = "value") -> DataFrame:
    """Parsed rows with `malformed`, so that skipped lines can be counted."""
    tagged = T.StructType([*fields.fields, T.StructField("_bad", T.StringType(), True)])
    parsed = F.from_json(column, tagged, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    text = lines.where(F.trim(F.col(column)) != "")
    return text.select(parsed.alias("r"), F.col(column)).select("r.*", column).withColumn(
        "malformed", F.col("_bad").isNotNull()).drop("_bad")


def latest_by_key(log: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last record per key in log order."""
    return keep_one(log, keys, seq)


def unrecorded(predictions: DataFrame, log: DataFrame, seq: Sequence[str] = ("date", "bar_date")) -> DataFrame:
    """Predictions whose bar is not the one last recorded for their symbol and model.

    seq: the order of the log; records of one day tie on the date alone.  Records without a bar_date don't count.
    """
    dated = log.where("bar_date is not null and symbol is not null and model is not null")
    last = dated.groupBy("symbol", "model").agg(F.max_by("bar_date", F.struct(*seq)).alias("bar_date"))
    usable = predictions.where("signal is not null").withColumn("bar_date", F.coalesce("bar_date", "date"))
    return usable.join(last, ["symbol", "model", "bar_date"], "left_anti")


def append_predictions(predictions: DataFrame, log: DataFrame, path: str) -> None:
    fields = schema.PREDICTION_LOG.fieldNames()
    unrecorded(predictions, log).select(*fields).write.mode("append").json(path)


def last_book(books: DataFrame, seq: str = "date") -> DataFrame:
    """Most recent book record of the log."""
    return books.where("as_of is not null").agg(F.max_by(F.struct(*books.columns), seq).alias("r")).where(
        "r is not null").select("r.*")


def append_book(book: DataFrame, path: str) -> None:
    book.select(*schema.BOOK_LOG.fieldNames()).write.mode("append").json(path)


def book_summary(books: DataFrame) -> DataFrame:
    """One row per date: when the book was ranked, whether that was today, and what it holds."""
    w = F.col("weight")
    return books.groupBy("date").agg(F.max("as_of").cast("string").alias("as_of"), F.max("rebalanced").alias("rebalanced"), F.struct(
        F.count_if(w > 0).alias("n_long"), F.count_if(w < 0).alias("n_short"), F.sum(F.abs(w)).alias("gross_exposure"), F.sum(w).alias("net_exposure"),
        F.when(F.count("beta") == F.count(F.lit(1)), F.sum(w * F.col("beta"))).alias("ex_ante_beta")).alias("diagnostics"))


def daily_documents(predictions: DataFrame, books: DataFrame) -> DataFrame:
    """One JSON document per symbol and date: its model predictions, its weight, and the portfolio of the date.

    predictions: date, symbol, model, signal, confidence, price; books: date, symbol, weight[, as_of, rebalanced, beta].
    Documents are per symbol, so no single row holds the whole universe; what they say of the portfolio is its date's
    summary, and NULL on dates without a book.
    """
    for c, kind in (("as_of", "date"), ("rebalanced", "boolean"), ("beta", "double")):
        if c not in books.columns:
            books = books.withColumn(c, F.lit(None).cast(kind))
    by_model = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct("signal", "confidence")))))
    per_symbol = predictions.groupBy("date", "symbol").agg(F.max("price").alias("price"), by_model.alias("predictions"))
    j = per_symbol.join(books.select("date", "symbol", "weight"), ["date", "symbol"], "left").join(book_summary(books), "date", "left")
    portfolio = F.when(F.col("diagnostics").isNotNull(), F.struct("as_of", "rebalanced", "weight", "diagnostics"))
    return j.select("date", "symbol", F.to_json(F.struct(
        F.col("date").cast("string").alias("date"), "symbol", "price", "predictions", "weight", portfolio.alias("portfolio"))).alias("document"))


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result sink: parquet, json or csv with header."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def union_universe(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct symbols of two lists (symbol, place), in order of first appearance."""
    both = first.select("symbol", F.lit(0).alias("_l"), "place").unionByName(
        second.select("symbol", F.lit(1).alias("_l"), "place"))
    return both.groupBy("symbol").agg(F.min(F.struct("_l", "place")).alias("at")).select(
        "symbol", F.col("at._l").alias("list_no"), F.col("at.place").alias("place"))


def sector_dimension(nested: DataFrame, column: str = "sectors") -> DataFrame:
    """Map of sector -> symbols, flattened to (symbol, sector)."""
    return nested.select(F.explode(column).alias("sector", "_s")).select(F.explode("_s").alias("symbol"), "sector")


def duplicated_symbols(dimension: DataFrame) -> DataFrame:
    return dimension.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
