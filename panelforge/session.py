"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  Anything sized to the cluster (executors,
# memory, shuffle partitions) is left to spark-submit.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "panelforge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> None:
    """Pin the settings results depend on, for sessions this package did not build."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def named_dir(spark: SparkSession) -> str | None:
    """The folder in spark.checkpoint.dir, or else the one the context was given, if there is one."""
    sc = spark.sparkContext
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; there is no default, since a local one loses data on a cluster."""
    named = named_dir(spark)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of the tables that `materialize` writes inside, for `remove` once nothing reads them any more."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        _SCRATCH.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table.

    Later branches scan columnar files instead of recomputing their inputs, and a
    lost executor costs one scan rather than the whole lineage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    writer = df.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
