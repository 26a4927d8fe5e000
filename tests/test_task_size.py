"""Work of a task stays bounded, however large the table is."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelforge.operators import features as feats
from panelforge.operators.timeaxis import chunk_window, chunked, dealt


def bars(n_symbols, n):
    rng = np.random.default_rng(3)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, (n_symbols, n)), axis=1)).ravel()
    return pd.DataFrame({"symbol": np.repeat([f"s{i}" for i in range(n_symbols)], n), "bar_no": np.tile(np.arange(n), n_symbols),
                         "ts": np.tile(pd.date_range("2020-01-01", periods=n).date, n_symbols), "open": close, "high": close * 1.01,
                         "low": close * 0.99, "close": close, "volume": 1000.0})


def test_chunks_are_dealt_by_their_rows(spark):
    b = spark.createDataFrame(bars(20, 50))
    d = dealt(chunked(b, halo=5), b.count(), per_task=100).withColumn("c", F.lag("close").over(chunk_window()))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert ", 10), REPARTITION_BY_NUM" in plan  # not as many as the exchanged bytes ask for
    assert "ENSURE_REQUIREMENTS" not in plan  # and the windows need no other exchange


def test_features_are_dealt_by_their_rows(spark):
    b = spark.createDataFrame(bars(4, 60))
    plan = feats.daily_features(b, feats.equal_weight_benchmark(b))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [symbol" in plan
