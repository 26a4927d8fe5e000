"""A training-data pipeline over `documents`; each stage calls one operator of panelforge.llm.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of documents, except
the last, which returns the packed pieces.  Null texts are empty ones.  Rows may repeat; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge import session
from panelforge.llm.decontamination import with_leaks
from panelforge.llm.line_dedup import drop_repeated_lines
from panelforge.llm.minhash_dedup import near_duplicates
from panelforge.llm.packing import pack_documents
from panelforge.llm.toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LEFT: dict[str, list[str]] = {}
#: Rows in an Arrow batch: stages carry whole rows, and a batch is held by the executor and by its Python worker.
BATCH_ROWS = 1000


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the intermediate tables of the one before it, whose result has been written by now."""
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        app = spark.sparkContext.applicationId
        session.remove(spark, _LEFT.pop(app, []))
        with session.scratch() as paths:
            out = work(spark, docs, sf_dir)
        _LEFT[app] = paths
        return out

    return stage


def _carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator needs, and the whole row beside them, so that no other column can clash with its own."""
    return docs.select(*columns, F.struct(*docs.columns).alias("original"))


def _has_words() -> Column:
    return F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go.  The fit reads the labels of sf_dir."""
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return score_toxicity(_carried(docs, "text", "lang"), model).where(~F.col("is_toxic")).select("original.*")


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or are one word edit from it, go; n_chars follows.

    Documents that had words and keep none go with their lines.
    """
    cleaned = drop_repeated_lines(_carried(docs, "doc_id", "text").withColumn("had", _has_words())).where(~F.col("had") | _has_words())
    length = F.when(F.col("text").isNull(), F.col("original.n_chars")).otherwise(F.char_length("text")).cast("long")
    new = {"text": F.col("text"), "n_chars": length}
    return cleaned.select(*[new.get(c, F.col(f"original.`{c}`")).alias(c) for c in docs.columns])


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; shingles of five words, similarity 0.8.

    Of rows that share that id, the one with the least hash of its text stays; documents without words all stay.
    """
    # Components are found on row numbers, so repeated and null ids need no rule there; the id decides who stays.
    rows = session.materialize(_carried(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    group = rows.select("row", "doc_id", F.xxhash64("text").alias("hash")).join(
        found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    first = group.groupBy("component_id").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "row")).alias("m")).select(F.col("m.row").alias("row"))
    return rows.join(first, "row", "left_semi").select("original.*")


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item with at most a fifth of its words edited go."""
    found = with_leaks(_carried(docs, "text"), _table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select("original.*")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences."""
    return pack_documents(docs, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("packing", packing)]

#: A fitted model, hashing and packing can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; every stage's result is written and read again before the next."""
    session.apply_runtime_conf(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
