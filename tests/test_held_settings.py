"""All settings of a symbol are held in one pass."""

import numpy as np
import pandas as pd

from panelforge.plans.eval_report import decision_trials


def panel(n, seed=2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(s, i, float(np.round(rng.normal(), 2)), float(rng.normal())) for s in "ab" for i in range(n)],
                        columns=["symbol", "bar_no", "pred", "ret"])


def test_settings_cross_chunks_and_make_no_rows_before_they_are_held(spark):
    df = spark.createDataFrame(panel(200))
    one, many = (decision_trials(df, quantiles=[0.6, 0.8], windows=[25, 40], size=n) for n in (1000, 45))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("FlatMapGroupsInPandas") > plan.index("Generate")  # the settings are exploded above the scan
    one, many = (d.toPandas().sort_values(["symbol", "config_no", "bar_no"], ignore_index=True) for d in (one, many))
    pd.testing.assert_frame_equal(one, many)
    assert len(one) == 2 * 200 * 4 and one["r"].abs().sum() > 0
