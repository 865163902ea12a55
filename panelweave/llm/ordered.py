"""Running totals over a whole ordered table without putting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, width


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a running total (up to and including the row) of every expression of ``sums`` in the given order.

    The rows are range-partitioned by ``order`` and written; only one total per partition meets in the small window that
    adds up the partitions, so its size is the session's number of partitions. ``order`` should have no ties.
    """
    ranged = df.withColumns({f"_{name}": value for name, value in sums.items()}).repartitionByRange(width(df.sparkSession), *order)
    placed = keep(ranged.withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(f"_{name}").alias(f"_{name}_all") for name in sums])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{name}_all").over(before), F.lit(0)).alias(f"_{name}_before") for name in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(totals, "_part")
    return joined.select(*df.columns, *[(F.sum(f"_{name}").over(inside) + F.col(f"_{name}_before")).alias(name) for name in sums])
