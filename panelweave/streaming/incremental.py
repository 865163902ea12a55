"""Incremental batches: keyed upsert, distinct append, backfill plan, partition replacement.

The inputs arrive in batches; each function is idempotent, so a batch may be replayed
after a failure. For streaming queries ``foreach_batch_upsert`` is the same upsert, and
``foreach_batch_accumulate`` adds up aggregates, both on hash-bucketed state with a manifest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import keep_one, union_by_name
from ..session import materialize
from ..sources.snapshots import BUCKET, SnapshotTable, State, merge_into_buckets


def upsert_keep_last(current: DataFrame | None, batch: DataFrame, keys: Sequence[str], *, order: Sequence[str] = ()) -> DataFrame:
    """The newest row per key: the batch beats what is stored, ``order`` decides inside a batch."""
    new = batch.withColumn("_age", F.lit(1))
    if current is None:
        stacked = new
    else:
        stacked = union_by_name([current.withColumn("_age", F.lit(0)), new])
    return keep_one(stacked, keys, ["_age", *order], last=True).drop("_age")


def append_distinct(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    return (batch if current is None else union_by_name([current, batch])).distinct()


def backfill_plan(
    loaded: DataFrame, key: str, year: str, entity: str, *, keys: Sequence[object], years: Sequence[int], expected: int
) -> DataFrame:
    """The (key, year) cells still to load: those with fewer than the expected entities.

    The grid is the exploded product of two literal lists, on one row per wanted key.
    """
    spark = loaded.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias(key))
    grid = grid.withColumn(year, F.explode(F.array(*[F.lit(int(y)) for y in years])))
    complete = loaded.groupBy(key, year).agg(F.count_distinct(entity).alias("_n")).filter(F.col("_n") >= expected)
    return grid.join(complete.select(key, year), [key, year], "left_anti")


def replace_partition(current: DataFrame, replacement: DataFrame, condition: Column) -> DataFrame:
    """Rows outside the condition stay, those inside give way to the replacement."""
    return current.filter(~F.coalesce(condition, F.lit(False))).unionByName(replacement, allowMissingColumns=True)


def _is_new(state: State | None, base: str, batch_id: int) -> bool:
    """Whether the batch is the next one; a batch that the state already holds is not, a later one is an error."""
    done = -1 if state is None else int(state.notes["batch"])
    if batch_id > done + 1:
        raise FileNotFoundError(f"batch {batch_id}: the state under {base} ends with batch {done}")
    return batch_id == done + 1


def foreach_batch_upsert(base: str, keys: Sequence[str], order: Sequence[str], *, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``writeStream.foreachBatch`` function that keeps the newest row per key in hash buckets under ``base``.

    A batch reads and writes the buckets of its own keys only; the others keep their files. The commit notes the batch, so a
    batch that is replayed after its commit changes nothing, one that died before leaves the former state, and one whose
    forerunner was not committed is an error: going on would lose keys. ``stored_state`` reads the result.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        table = SnapshotTable(batch.sparkSession, base)
        if _is_new(table.state(), base, batch_id):
            newest = lambda rows: keep_one(rows, [BUCKET, *keys], ["_age", *order], last=True)
            merge_into_buckets(table, batch, keys, newest, buckets=buckets, notes={"batch": batch_id})
            table.vacuum()

    return apply


def foreach_batch_accumulate(
    base: str,
    keys: Sequence[str],
    partials: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame, Sequence[str]], DataFrame],
    *,
    buckets: int = 64,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that adds every batch's aggregates to stored ones, in hash buckets as the upsert does.

    ``partials`` reduces a batch to rows per key whose columns merge; ``merge(rows, keys)`` adds such rows up per key. Each
    batch counts once, replays included, and its rows are read once: the state is as long as the number of keys.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        table = SnapshotTable(batch.sparkSession, base)
        if _is_new(table.state(), base, batch_id):
            add = lambda rows: merge(rows.drop("_age"), [BUCKET, *keys])
            merge_into_buckets(table, materialize(partials(batch)), keys, add, buckets=buckets, notes={"batch": batch_id})
            table.vacuum()

    return apply


def stored_state(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows as of the last committed batch; None before the first one."""
    return SnapshotTable(spark, base).read()
