"""Training, scoring and forecasting of all models of a panel in one call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import naive_baselines, temporal_split
from ..session import materialize
from .audit import error_metrics
from .compiled import compile_model, compiled_forecast
from .models import FittedModel, fit_boosted_trees, fit_ridge, prediction_frame
from .scenario import naive_future_paths


def train_score_all(
    features: DataFrame,
    *,
    ids: Sequence[str],
    entity: str,
    region: str,
    year: str,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    rounds: int,
    split_year: int,
    future: DataFrame | None = None,
    path: Sequence[str] = (),
    exogenous_lags: Sequence[str] = (),
) -> tuple[dict[str, FittedModel], DataFrame, DataFrame]:
    """Baselines and fitted models over the three splits, and their metrics by group.

    With ``future`` (covariates per entity, ``path`` and year) the predictions also hold a split "forecast": the baselines'
    paths and every fitted model, compiled, in a closed loop that is one plan. Metrics are of the historical splits.
    """
    rows = materialize(temporal_split(features.filter(F.col(target).isNotNull()), year))
    train = rows.filter(F.col("split") == "train")
    models = {m.name: m for m in (fit_ridge(train, target, numeric, categorical), fit_boosted_trees(train, target, numeric, rounds=rounds))}
    parts = [
        prediction_frame(rows, ids, target, column, name)
        for name, column in naive_baselines(f"{target}_lag1", f"{target}_lag2").items()
    ]
    parts += [prediction_frame(m.predict(rows, "_p"), ids, target, "_p", name) for name, m in models.items()]
    predictions = reduce(lambda a, b: a.unionByName(b), parts)
    historical = predictions
    if future is not None:
        ahead = [
            compiled_forecast(
                compile_model(m), features, future, entity=entity, path=path, year=year, target=target, exogenous_lags=exogenous_lags
            ).withColumn("model_name", F.lit(name))
            for name, m in models.items()
        ]
        naive = naive_future_paths(features.select(entity, year, target), future, [entity, *path], entity, year, target)
        ahead += [
            naive.select(entity, *path, year, F.col(name).alias("predicted"), F.lit(name).alias("model_name"))
            for name in ("baseline_last_observed", "baseline_recent_trend")
        ]
        stacked = reduce(lambda a, b: a.unionByName(b), ahead).withColumns({"split": F.lit("forecast"), "actual": F.lit(None).cast("double")})
        predictions = predictions.unionByName(stacked, allowMissingColumns=True)
    metrics = error_metrics(
        historical, ["model_name", "split"], entity=entity, region=region, year=year, actual="actual", predicted="predicted", split_year=split_year
    )
    return models, predictions, metrics
