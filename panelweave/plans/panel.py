"""The panel chain: derive, fall back, index, impute, lag, describe."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import calendar_trend_features, row_mean, with_optional
from ..operators.windows import (
    composite_indices,
    first_value_log,
    group_mean,
    impute_short_gaps,
    lag_features,
)
from . import specs


def time_use_adjustments(metrics: Sequence[str]) -> dict[str, Column]:
    """Modelled adjustment per time-use metric from the z-score columns of the panel.

    A missing z makes the adjustment missing, except in the row mean of the screen metrics.
    """
    out: dict[str, Column] = {}
    for m in metrics:
        if m in specs.SCREEN_ADJUSTMENTS:
            out[m] = F.lit(specs.SCREEN_ADJUSTMENTS[m]) * row_mean(["attention_z", "prevalence_z"])
        elif m in specs.TIME_USE_ADJUSTMENTS:
            out[m] = reduce(lambda a, b: a + b, [F.lit(w) * F.col(z) for z, w in specs.TIME_USE_ADJUSTMENTS[m].items()])
    return out


def exposure_panel(
    panel: DataFrame, year: str, required: Mapping[str, str], components: Mapping[str, Sequence[tuple[str, float]]] = specs.INDEX_COMPONENTS
) -> DataFrame:
    """All indices with modes and component lists, then any required column that is still absent."""
    out = composite_indices(panel, components, year)
    return with_optional(out, {c: (t, None) for c, t in required.items()})


def feature_panel(
    panel: DataFrame,
    entity: str,
    year: str,
    *,
    impute: Sequence[str],
    lagged: Sequence[str],
    target: str,
    stock: str,
    break_year: int,
) -> DataFrame:
    """Imputed, lagged and described panel: what the models read."""
    out = impute_short_gaps(panel, impute, entity, year)
    out = lag_features(out, lagged, entity, year)
    out = group_mean(out, target, [entity], "history_mean_target", bounded=True)
    out = first_value_log(out, stock, entity, year, "log_stock_baseline")
    return calendar_trend_features(out, year, break_year)
