"""Occupation–task–activity–skill dataset: a chain of keyed left joins over text tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import rollup_join, two_pass_join
from ..operators.sets import keep_one


def task_dataset(
    entities: DataFrame,
    tasks: DataFrame,
    activities: DataFrame,
    rollups: Mapping[str, DataFrame],
    *,
    key: str,
    order: str,
    eligible: str,
    task_id: str,
    text_key: str,
    activity: str,
) -> DataFrame:
    """Eligible entities (first row per key) × tasks × activities × text roll-ups, in no order: a sink sorts.

    Activities match by (key, task id) first and by (key, task text) where that fails.
    """
    chosen = keep_one(entities.filter(F.col(eligible) & F.col(key).isNotNull()), [key], [order])
    rows = chosen.join(tasks, key, "left")
    rows = two_pass_join(
        rows, activities, first_keys=[key, task_id], second_keys=[key, text_key], values=[activity]
    )
    return rollup_join(rows, rollups, key)
