"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelforge import catalog  # noqa: E402
from panelforge.catalog import base  # noqa: E402
from panelforge.session import get_session  # noqa: E402

# Inputs that later queries share; each is timed on its own.
STAGES = {
    "stage_bars": lambda spark, sf: base.bars(spark, sf),
    "stage_features": lambda spark, sf: base.features(spark, sf),
    "stage_panel": lambda spark, sf: base.panel(spark, sf),
}
HEADLINE = [
    "t03_rolling_stats", "t04_rolling_quantile", "t06_cumulative", "t09_exponential_means", "t15_holding_period",
    "f32_feature_contract", "x01_cross_sectional_rank", "x03_sector_neutral", "x04_rank_weights_beta_neutral",
    "x06_cross_sectional_ic", "x07_pooled_ic", "x09_ic_decay", "b01_drifting_book", "b05_config_grid",
    "b12_realized_pnl", "b14_triple_barrier", "a01_equity_summary", "a09_deflated_sharpe", "a10_overfit_probability",
    "g01_predictor_signal", "l04_fold_scores", "l07_robust_scaler", "l08_ridge_full_contract", "o01_realized_ic",
    "s05_bar_upsert", "z01_stream_bars",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1m"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    took: dict[str, float] = {}
    for name in [*STAGES, *HEADLINE]:
        fn = STAGES.get(name) or catalog.QUERIES[name]
        start = time.time()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
