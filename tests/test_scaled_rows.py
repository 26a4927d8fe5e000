"""Rows that estimators read: scaled in numpy as in SQL, written once, dealt evenly."""

import numpy as np

from panelforge.operators import models

PARAMS = {"a": (1.0, 2.0), "b": (0.0, 0.5)}


def rows(spark):
    return spark.sql("SELECT id, IF(id % 7 = 0, NULL, CAST(id AS DOUBLE)) AS a, IF(id = 3, double('nan'), id % 5 - 2D) AS b, CAST(id % 3 AS INT) AS label FROM range(60)")


def test_arrays_equal_the_scaler(spark):
    got = {r.id: r.z for r in models.ScaledModel(None, ["a", "b"], PARAMS).arrays(rows(spark), "z").collect()}
    want = {r.id: [r.a, r.b] for r in models.apply_scaler(rows(spark), PARAMS).collect()}
    assert got == want and got[3][1] == models.CLIP and got[0][0] == -0.5


def test_estimators_read_rows_that_are_written_once(spark, monkeypatch):
    written, write = [], models.materialize
    monkeypatch.setattr(models, "materialize", lambda d, name: written.append((name, d.columns)) or write(d, name))
    m = models.fit_forest(rows(spark).where("id <> 3"), ["a", "b"], "label", trees=3)
    assert written == [("scaled_rows", ["label", "weight", "_a"])]
    assert models.score_classifier(m, rows(spark)).where("size(proba) = 3").count() == 60


def test_rounds_run_on_even_parts(spark):
    cores = spark.sparkContext.defaultParallelism
    d = models._for_rounds(spark.range(1200, numPartitions=cores + 3))
    sizes = d.rdd.glom().map(len).collect()
    assert len(sizes) == cores and max(sizes) < 1.3 * np.mean(sizes)
