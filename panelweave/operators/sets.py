"""Unions, distinct rows, keyed deduplication and set comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def keep_one(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], *, last: bool = False) -> DataFrame:
    """One row per key by an explicit order.

    ``row_number() = 1`` is limited per task before the shuffle, so a hot key does not travel.
    """
    direction = [as_col(o).desc_nulls_last() if last else as_col(o).asc_nulls_last() for o in order]
    ranked = Window.partitionBy(*[as_col(k) for k in keys]).orderBy(*direction)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def keep_one_blank_keys(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """As ``keep_one`` where a missing key part equals a blank one."""
    return keep_one(df, [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], order)


def set_difference(sides: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Ids that are not in every side, with one presence column per side.

    One union and one aggregate, whatever the number of sides.
    """
    stacked = union_by_name([df.select(key).withColumn("_side", F.lit(name)) for name, df in sides.items()])
    seen = stacked.groupBy(key).agg(*[F.max(F.col("_side") == name).alias(f"in_{name}") for name in sides])
    everywhere = reduce(lambda a, b: a & b, [F.col(f"in_{name}") for name in sides])
    return seen.filter(~everywhere)


def covers_all(df: DataFrame, keys: Sequence[str], value: str, required: Sequence[object]) -> DataFrame:
    """Per key: are all required values present? Only the required values are ever gathered."""
    wanted = F.array(*[F.lit(v) for v in required])
    hit = F.collect_set(F.when(F.col(value).isin(*required), F.col(value)))
    return df.groupBy(*keys).agg((F.size(F.array_except(wanted, hit)) == 0).alias("is_complete"))


def append_total_rows(df: DataFrame, totals: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Stack total rows, labelled with constants, under entity rows."""
    labelled = totals.withColumns({name: F.lit(v) for name, v in constants.items()})
    return df.unionByName(labelled, allowMissingColumns=True)


def horizons_available(df: DataFrame, year: str, wanted: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Requested years that exist, else all that exist, sorted. A calendar bounds the array."""
    seen = F.array_sort(F.collect_set(year))
    asked = F.array_intersect(F.array(*[F.lit(int(w)) for w in sorted(wanted)]), seen)
    return df.groupBy(*keys).agg(F.when(F.size(asked) > 0, asked).otherwise(seen).alias("horizons"))
