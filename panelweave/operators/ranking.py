"""Sorting, top-k and short previews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col


def sort_nulls_last(df: DataFrame, columns: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*[as_col(c).asc_nulls_last() for c in columns])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group. Spark trims to k per task before it shuffles."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ranked)).filter(F.col(rank) <= k)


def direction_rankings(
    df: DataFrame, keys: Sequence[str], difference: str, name: str, *, tolerance: float, k: int = 5
) -> DataFrame:
    """Three lists per slice: largest rises, largest falls, closest to zero; ties by name."""
    present = df.filter(F.col(difference).isNotNull())
    lists = [
        ("upward", F.col(difference) > tolerance, F.col(difference).desc()),
        ("downward", F.col(difference) < -tolerance, F.col(difference).asc()),
        ("closest", F.lit(True), F.abs(difference).asc()),
    ]
    parts = [
        top_per_group(present.filter(cond), keys, [order, F.col(name).asc()], k).withColumn("ranking_group", F.lit(label))
        for label, cond, order in lists
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def top_global(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Top-k report: each task keeps k rows, then one merge of those."""
    return df.orderBy(*order).limit(k)


def top_both_ends(df: DataFrame, value: str, tie: str, k: int = 5) -> DataFrame:
    """The k largest positive and the k largest negative values."""
    up = top_global(df.filter(F.col(value) > 0), [F.col(value).desc(), F.col(tie)], k).withColumn("side", F.lit("positive"))
    down = top_global(df.filter(F.col(value) < 0), [F.col(value).asc(), F.col(tie)], k).withColumn("side", F.lit("negative"))
    return up.unionByName(down)


def preview_with_overflow(df: DataFrame, keys: Sequence[str], code: str, limit: int = 15) -> DataFrame:
    """First codes in order, then how many more there are; "none" if there is no code.

    Distinct codes are counted distributed and only the first ``limit`` are gathered.
    """
    distinct = df.select(*keys, code).distinct()
    heads = top_per_group(distinct, keys, [F.col(code).asc_nulls_last()], limit, "_rank")
    shown = heads.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(code)), ", ").alias("_head"))
    counts = distinct.groupBy(*keys).agg(F.count(code).alias("n_codes"))
    more = F.when(
        F.col("n_codes") > limit, F.concat(F.lit(", ... (+"), (F.col("n_codes") - limit).cast("string"), F.lit(" more)"))
    ).otherwise(F.lit(""))
    text = F.when(F.col("n_codes") == 0, F.lit("none")).otherwise(F.concat(F.col("_head"), more))
    return counts.join(shown, list(keys), "left").select(*keys, "n_codes", text.alias("preview"))
