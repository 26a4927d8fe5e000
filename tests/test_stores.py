"""How stored tables lie on disk, and what scans and joins of them do."""

import datetime as dt
import os

from pyspark.sql import functions as F

from panelforge.sources import bars as src
from panelforge.sources import tables

DDL = "symbol string, ts timestamp, interval string, close double"


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_an_upsert_writes_one_file_for_a_small_month(spark, tmp_path):
    path = f"{tmp_path}/bars"
    rows = [(f"s{i % 40}", dt.datetime(2024, 1 + i % 6, 1 + i // 40 % 28), "1d", float(i)) for i in range(3000)]
    tables.upsert(spark, path, "bar_data", spark.createDataFrame(rows, DDL).repartition(8))
    assert len(files(path)) == 6
    new = [("s1", dt.datetime(2024, 3, 2), "1d", -1.0), ("zz", dt.datetime(2024, 3, 3), "1d", -2.0)]
    before = set(files(path))
    tables.upsert(spark, path, "bar_data", spark.createDataFrame(new, DDL))
    assert len(files(path)) == 6 and len(before & set(files(path))) == 5  # the other months are as they were
    got = {(r.symbol, r.ts, r.interval): r.close for r in tables.stored(spark, path, "bar_data").collect()}
    want = {}
    for s, t, i, c in [*rows, *new]:
        want[s, t, i] = max(c, want.get((s, t, i), c)) if c >= 0 else c
    assert got == want  # '1d' stays a text, so its rows meet their stored ones


def test_new_rows_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, i + 1), "1d", 1.0) for i in range(20)], DDL)
    tables.upsert(spark, f"{tmp_path}/t", "bar_data", rows)
    tables.upsert(spark, f"{tmp_path}/t", "bar_data", rows.mapInPandas(counted, DDL))
    assert seen.value == 20


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_clustered_bars(spark, tmp_path):
    n, names = 400_000, 400
    bars = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % names).cast("string"))).alias("symbol"),
        (F.lit(dt.datetime(2000, 1, 1)).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), F.rand(1).alias("close"))
    spark.conf.set("parquet.block.size", 256 * 1024)
    try:
        t = src.save_clustered(bars, "clustered_test", 8, f"{tmp_path}/t")
    finally:
        spark.conf.unset("parquet.block.size")
    one = src.scan_range(t, ["s7"])
    plan = plan_of(one)
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,s7)]" in plan and one.count() == bars.where("symbol = 's7'").count()
    bucket = t.where(F.pmod(F.hash("symbol"), F.lit(8)) == F.pmod(F.hash(F.lit("s7")), F.lit(8))).count()
    assert rows_scanned(one) < bucket / 2  # of the bucket's row groups only some are read
    assert src.scan_range(t, ["s7x"]).count() == 0
    other = src.save_clustered(bars.select("symbol", "ts", (F.col("close") * 2).alias("twice")), "clustered_other", 8, f"{tmp_path}/u")
    both = t.join(other.hint("merge"), ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("twice") - 2 * F.col("close")).alias("d"))
    # Keys beside the bucket's are left to the join itself.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        assert "Exchange" not in plan_of(both)
        got = both.agg(F.sum("n").alias("n"), F.sum("d").alias("d")).first()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert got.n == n and got.d == 0
    for name in ("clustered_test", "clustered_other"):
        spark.sql(f"DROP TABLE {name}")
