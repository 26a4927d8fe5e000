"""Training: pooled dataset -> global split -> sweep -> fit -> metrics -> registry row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import metrics, models, quality, splits, xsec
from panelforge.operators.features import daily_features
from panelforge.operators.timeaxis import number_rows
from panelforge.schema import LABEL, model_inputs
from panelforge.session import materialize
from panelforge.sources import tables


@dataclass
class TrainingResult:
    model: models.LinearModel
    train_metrics: DataFrame
    test_metrics: DataFrame
    cross_sectional: DataFrame
    bounds: DataFrame


def build_dataset(bars: DataFrame, benchmark: DataFrame | None, cs_mode: str = "off", demean: bool = False,
                  min_rows: int = 50, **split) -> DataFrame:
    """Features with target `y`, raw volatility and split role, embargoed on global dates."""
    feats = daily_features(bars, benchmark).where(F.col(LABEL).isNotNull())
    df = quality.min_history(materialize(feats, "train_features"), min_rows).withColumn("y", F.col(LABEL))
    if cs_mode != "off":
        df = xsec.cross_sectional_normalize(df, mode=cs_mode).na.drop(subset=model_inputs(cs_mode))
    if demean:
        df = xsec.demean_target(df, "y")
    return materialize(splits.split_panel(materialize(df, "train_panel"), **split), "train_split")


def train(dataset: DataFrame, cs_mode: str = "off", kind: str = "ridge", alpha: float = 10.0) -> TrainingResult:
    bounds = splits.split_bounds(dataset.select("ts", "role").distinct())
    splits.check_split(bounds)
    cols = model_inputs(cs_mode)
    fit_rows, test = dataset.where("role = 'train'"), dataset.where("role = 'test'")
    model = models.fit_ridge(fit_rows, cols, "y", alpha) if kind == "ridge" else models.fit_elastic_net(fit_rows, cols, "y")[0]
    scored_train, scored_test = model.score(fit_rows), model.score(test)
    return TrainingResult(model, metrics.forecast_metrics(scored_train, "pred", "y"),
                          metrics.forecast_metrics(scored_test, "pred", "y"),
                          metrics.train_ic(scored_test, "pred", "y"), bounds)


def sweep_parameters(features: DataFrame, cols: list[str], cfg: splits.FoldConfig = splits.FoldConfig()) -> DataFrame:
    """Best decision quantile and window over the walk-forward folds of every symbol."""
    usable = number_rows(features.where(F.col(LABEL).isNotNull()).drop("bar_no"))
    return models.sweep(materialize(models.config_ic_matrix(usable, cols, LABEL, cfg), "fold_ics"))


def register(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Registry with the new models appended as the only active version of their keys."""
    new = tables.next_versions(registry, rows).withColumn("is_active", F.lit(True))
    return tables.deactivate_older(registry, new).unionByName(new, allowMissingColumns=True)
