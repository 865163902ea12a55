"""Table-wide order statistics without a single-task window.

A window without a partition sends the table to one task. For positions of all rows they are
range-partitioned by the order column, as many ranges as the session has shuffle
partitions, and written; each range is summed, the range totals are accumulated,
and the exact position inside each range comes from a window per range. A median needs
none of that: a sketch brackets it and a second scan counts inside the bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def positions(df: DataFrame, order: str, *, by: Sequence[str] = (), weight: str | None = None, name: str = "before") -> DataFrame:
    """Add ``name``: the weight (default: the number) of rows strictly before this one.

    ``order`` must be unique within ``by``. Callers with ties aggregate them first and pass their number as ``weight``, so
    no tied group ever meets in one window. The ranges are written down, so that they are the same in both branches.
    """
    by = list(by)
    ranged = materialize(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    amount = F.col(weight) if weight else F.lit(1)
    totals = ranged.groupBy(*by, "_range").agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(offsets, [*by, "_range"])
    return joined.withColumn(name, F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_range", "_offset")


def value_ranks(df: DataFrame, value: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct present value: ``n_equal``, ``before`` and the average-tie ``rank``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_equal"))
    ranked = positions(counts, value, by=by, weight="n_equal")
    return ranked.withColumn("rank", F.col("before") + (F.col("n_equal") + 1) / F.lit(2.0))


ACCURACY = 10_000  # of the sketch: it places a value within one part in so many of its rank


def exact_median(df: DataFrame, value: str, *, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """Exact median of the present values, one row per group, by two scans and no sort or shuffle of the rows.

    A mergeable quantile sketch of bounded size first gives two values with the middle ranks between them. The second scan
    counts the rows below the first one and, per distinct value, those between the two: about four in ``ACCURACY`` and what
    ties with them, combined in each task. The middle is looked up among these by running counts. That the ranks do lie
    between is checked, so a wrong sketch is an error and never a wrong median. Rows of a missing group have no result;
    a table without present values has a missing median.
    """
    by, margin = list(by), 2.0 / ACCURACY
    rows = df.filter(F.col(value).isNotNull()).dropna(subset=by).select(*by, F.col(value).alias("_v"))
    marks = F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], ACCURACY)
    sketch = rows.groupBy(*by).agg(marks.alias("_m"), F.count(F.lit(1)).alias("_n"))
    if by:
        # written, so that its size is known: few groups are broadcast, and no task gets all rows of a group to sort
        placed = rows.join(materialize(sketch), by)
    else:
        whole = sketch.select(F.struct("_m", "_n").alias("s")).scalar()
        placed = rows.withColumn("_s", whole).select("_v", "_s.*")
    low, high = F.get("_m", F.lit(0)), F.get("_m", F.lit(1))
    # rows below all meet in one missing value, whose count comes first
    inside = F.when(F.col("_v") >= low, F.col("_v"))
    counts = placed.filter(F.col("_v") <= high).groupBy(*by, inside.alias("_v"), "_n").agg(F.count(F.lit(1)).alias("_equal"))
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_equal").over(upto))
    covers = lambda at: (F.col("_upto") - F.col("_equal") <= at) & (at < F.col("_upto"))
    first, second = covers(F.floor((F.col("_n") - 1) / 2)), covers(F.floor(F.col("_n") / 2))
    picked = ranked.groupBy(*by).agg(
        F.max(F.when(first, F.col("_v"))).alias("_low"), F.max(F.when(second, F.col("_v"))).alias("_high"), F.max("_n").alias("_n")
    )
    middle = (F.col("_low") + F.col("_high")) / F.lit(2.0)
    missed = F.col("_n").isNotNull() & middle.isNull()
    checked = F.when(missed, F.raise_error(F.lit("the sketch does not hold the middle rank"))).otherwise(middle)
    return picked.select(*by, checked.alias(name))


def percentile_rank(df: DataFrame, value: str, *, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Average-tie rank over the number of present values; missing is 0.5, as is a lone value."""
    by, name = list(by), name or f"{value}_pct_rank"
    ranks = value_ranks(df, value, by=by)
    if by:
        sizes = df.groupBy(*by).agg(F.count(value).alias("_n"))
        ranks = ranks.join(sizes, by)
        n: Column = F.col("_n")
    else:
        n = df.agg(F.count(value)).scalar()
    share = F.when(n > 1, F.col("rank") / n)
    # few distinct values make a small table, which is broadcast once it is written and its size known; missing values stay out
    ranks = materialize(ranks.select(*by, value, F.coalesce(share, F.lit(0.5)).alias(name)))
    present = df.filter(F.col(value).isNotNull()).join(ranks, [*by, value]).select(*df.columns, name)
    return present.unionByName(df.filter(F.col(value).isNull()).withColumn(name, F.lit(0.5)))


def percentile_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Percentile ranks of several columns, as (keys, one rank per column).

    The columns are ranked together in long form, so the plan does not grow with their number.
    ``keys`` identify a row.
    """
    long = df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], "_feature", "_value")
    sizes = long.groupBy("_feature").agg(F.count("_value").alias("_n"))
    ranks = value_ranks(long, "_value", by=["_feature"]).join(sizes, "_feature")
    ranks = ranks.select("_feature", "_value", F.when(F.col("_n") > 1, F.col("rank") / F.col("_n")).alias("_share"))
    ranked = long.filter(F.col("_value").isNotNull()).join(ranks, ["_feature", "_value"]).select(*keys, "_feature", F.coalesce("_share", F.lit(0.5)).alias("_share"))
    cells = ranked.unionByName(long.filter(F.col("_value").isNull()).select(*keys, "_feature", F.lit(0.5).alias("_share")))
    return cells.groupBy(*keys).agg(*[F.max(F.when(F.col("_feature") == c, F.col("_share"))).alias(c) for c in columns])


def factorize(df: DataFrame, label: str, order: str, *, name: str) -> DataFrame:
    """Labels numbered 0, 1, … by first appearance in ``order``; a missing label is -1."""
    firsts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("_first"))
    codes = positions(firsts, "_first", name=name).select(label, F.col(name).cast("int").alias(name))
    labelled = df.filter(F.col(label).isNotNull()).join(codes, label).select(*df.columns, name)
    return labelled.unionByName(df.filter(F.col(label).isNull()).withColumn(name, F.lit(-1)))
