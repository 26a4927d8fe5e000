"""What an upsert leaves on disk and moves."""

import datetime as dt
import os

from pyspark.sql import functions as F

from panelforge.session import shared_dir
from panelforge.sources import tables

DDL = "symbol string, ts date, feature_set string, a double, b double"


def rows_of(spark, n, add=0.0):
    return spark.createDataFrame([(f"s{i}", dt.date(2024, 1 + i % 2, 3), "v1", i + add, None) for i in range(n)], DDL)


def found(spark, path):
    got = tables.unpack_features(tables.stored(spark, path, "features"), ["a", "b"], "v1").collect()
    assert all(r.b is None for r in got)
    return {r.symbol: r.a for r in got}


def test_packed_rows_are_replaced_and_nothing_is_left_aside(spark, tmp_path, monkeypatch):
    path, moved = f"{tmp_path}/f", []
    one = tables._one_per_key
    monkeypatch.setattr(tables, "_one_per_key", lambda rows, *how: moved.append(rows.columns) or one(rows, *how))

    def pack(df):
        return tables.as_json(df, ["a", "b"])

    tables.upsert(spark, path, "features", rows_of(spark, 10), pack=pack)
    assert found(spark, path) == {f"s{i}": float(i) for i in range(10)}
    # All stored rows of January are replaced: they aren't moved, and numbers are, not text.
    tables.upsert(spark, path, "features", rows_of(spark, 10, 100.0).where("month(ts) = 1"), pack=pack)
    want = {f"s{i}": i + (0.0 if i % 2 else 100.0) for i in range(10)}
    assert found(spark, path) == want and all("features_json" not in c and "_gen" not in c for c in moved)
    # One of February is, the others stay.
    tables.upsert(spark, path, "features", rows_of(spark, 2, 200.0).where("month(ts) = 2"), pack=pack)
    assert found(spark, path) == want | {"s1": 201.0} and "_gen" in moved[-1]
    left = os.listdir(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    assert not [n for n in left if n.startswith(("new_features", "upsert_features"))]


def test_a_missing_key_is_replaced_too(spark, tmp_path):
    path = f"{tmp_path}/f"
    rows = rows_of(spark, 4).withColumn("symbol", F.when(F.col("a") != 2, F.col("symbol")))
    for add in (0.0, 50.0):
        tables.upsert(spark, path, "features", rows.withColumn("a", F.col("a") + add), pack=lambda df: tables.as_json(df, ["a", "b"]))
    assert found(spark, path) == {"s0": 50.0, "s1": 51.0, None: 52.0, "s3": 53.0}
