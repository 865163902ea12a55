"""Snapshot tables: atomic swaps, untouched files, replays, killed and rival writers; bucketed state built on them."""

from __future__ import annotations

import json
import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from panelweave.operators import aggregate as A
from panelweave.sources import snapshots as SN
from panelweave.streaming import incremental as INC

SPLITS = "split string, v int"


def files(folder):
    """Data files with their time of change."""
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet")}


def test_a_partition_is_swapped_and_the_others_keep_their_files(spark, tmp_path):
    table = SN.SnapshotTable(spark, f"{tmp_path}/t")
    frame = lambda rows, schema=SPLITS: spark.createDataFrame(rows, schema)
    assert table.read() is None
    SN.replace_partitions(table, frame([("train", 1), ("forecast", 2), ("forecast", 3), (None, 4), ("a/b=c", 5)]), ["split"])
    before, before_rows = files(tmp_path), table.state()
    reader = table.read()  # planned on the former state
    SN.replace_partitions(table, frame([("forecast", 9, "m")], SPLITS + ", model string"), ["split"])
    assert rows_of(table.read(), "split", "v", "model") == sorted([("train", 1, None), ("forecast", 9, "m"), (None, 4, None), ("a/b=c", 5, None)], key=repr)
    assert before.items() <= files(tmp_path).items() and len(files(tmp_path)) == len(before) + 1
    assert rows_of(reader, "v") == [(1,), (2,), (3,), (4,), (5,)] and rows_of(table.read(before_rows), "v") == rows_of(reader, "v")
    assert rows_of(SN.read_partitions(table, ["split"], [(None,), ("train",)]), "v") == [(1,), (4,)]
    opened = SN.read_partitions(table, ["split"], [("train",)]).inputFiles()
    assert len(opened) == 1


def test_a_partition_without_new_rows_can_go(spark, tmp_path):
    table = SN.SnapshotTable(spark, f"{tmp_path}/t")
    SN.replace_partitions(table, spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], SPLITS), ["split"])
    gone = spark.createDataFrame([("a",), ("b",)], "split string")
    SN.replace_partitions(table, spark.createDataFrame([("b", 5)], SPLITS), ["split"], also=gone)
    assert rows_of(table.read()) == [("b", 5), ("c", 3)]
    SN.replace_partitions(table, spark.createDataFrame([], SPLITS), ["split"], also=spark.createDataFrame([("b",), ("c",)], "split string"))
    assert rows_of(table.read()) == [] and table.read().columns == ["split", "v"]


def test_a_writer_that_dies_leaves_the_former_state(spark, tmp_path):
    table = SN.SnapshotTable(spark, f"{tmp_path}/t")
    SN.replace_partitions(table, spark.createDataFrame([("a", 1)], SPLITS), ["split"])
    broken = spark.createDataFrame([("a", 2), ("b", 3)], SPLITS).withColumn("v", F.when(F.col("split") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        SN.replace_partitions(table, broken, ["split"])
    orphan = table.write(spark.createDataFrame([("a", 7)], SPLITS), SN.partition_unit(["split"]))  # written, never committed
    assert rows_of(table.read()) == [("a", 1)] and table.state().version == 0
    table.vacuum()
    assert rows_of(table.read()) == [("a", 1)]
    assert not any(os.path.exists(f"{table.base}/{p}") for p in orphan.values()) and len(files(tmp_path)) == 1


def test_of_two_writers_one_is_refused(spark, tmp_path):
    table = SN.SnapshotTable(spark, f"{tmp_path}/t")
    SN.replace_partitions(table, spark.createDataFrame([("a", 1)], SPLITS), ["split"])
    former = table.state()
    first, second = (table.write(spark.createDataFrame([("a", v)], SPLITS), SN.partition_unit(["split"])) for v in (2, 3))
    table.commit(former, first, former.schema)
    with pytest.raises(SN.ConflictError):
        table.commit(former, second, former.schema)
    assert rows_of(table.read()) == [("a", 2)]
    assert sorted(os.listdir(f"{table.base}/manifests"))[-1] == "00000001.json" or not [n for n in os.listdir(f"{table.base}/manifests") if n.endswith(".tmp")]


def test_a_column_keeps_its_type(spark, tmp_path):
    table = SN.SnapshotTable(spark, f"{tmp_path}/t")
    SN.replace_partitions(table, spark.createDataFrame([("a", 1)], SPLITS), ["split"])
    with pytest.raises(TypeError, match="v is int in the table and string in the rows"):
        SN.replace_partitions(table, spark.createDataFrame([("a", "x")], "split string, v string"), ["split"])
    assert rows_of(table.read()) == [("a", 1)]


# --- buckets --------------------------------------------------------------------------------------


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    base = f"{tmp_path}/s"
    apply = INC.foreach_batch_upsert(base, ["k"], ["n"], buckets=8)
    apply(spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("n")), 0)
    former, before = SN.SnapshotTable(spark, base).state(), files(tmp_path)
    assert len(former.units) == 8 and len(before) == 8
    apply(spark.createDataFrame([("k17", 5), ("k17", 4)], "k string, n int"), 1)
    state = SN.SnapshotTable(spark, base).state()
    assert sum(state.units[u] != former.units[u] for u in state.units) == 1
    assert before.items() <= files(tmp_path).items() and len(files(tmp_path)) == 9
    got = dict(rows_of(INC.stored_state(spark, base), "k", "n"))
    assert len(got) == 200 and got["k17"] == 5 and sum(got.values()) == 5


def test_replays_change_nothing_and_gaps_are_errors(spark, tmp_path):
    base = f"{tmp_path}/s"
    apply = INC.foreach_batch_upsert(base, ["k"], ["n"], buckets=4)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, n int")
    with pytest.raises(FileNotFoundError, match="ends with batch -1"):
        apply(batch(("a", 1)), 1)
    apply(batch(("a", 1), ("b", 2)), 0)
    apply(batch(("a", 3), (None, 4)), 1)
    state = SN.SnapshotTable(spark, base).state()
    apply(batch(("a", 3), (None, 4)), 1)
    apply(batch(("a", 99)), 0)
    assert SN.SnapshotTable(spark, base).state() == state
    assert rows_of(INC.stored_state(spark, base), "k", "n") == sorted([("a", 3), ("b", 2), (None, 4)], key=repr)
    with pytest.raises(FileNotFoundError, match="ends with batch 1"):
        apply(batch(("a", 1)), 3)
    apply(batch(), 2)  # an empty batch counts
    assert SN.SnapshotTable(spark, base).state().notes["batch"] == 2 and INC.stored_state(spark, base).count() == 3


def test_a_killed_batch_leaves_the_former_state(spark, tmp_path):
    base = f"{tmp_path}/s"
    apply = INC.foreach_batch_upsert(base, ["k"], ["n"], buckets=4)
    apply(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), 0)
    dying = spark.createDataFrame([("a", 5), ("c", 6)], "k string, n int").withColumn("n", F.when(F.col("k") == "c", F.raise_error(F.lit("killed"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        apply(dying, 1)
    assert rows_of(INC.stored_state(spark, base), "k", "n") == [("a", 1), ("b", 2)]
    apply(spark.createDataFrame([("a", 5), ("c", 6)], "k string, n int"), 1)
    assert rows_of(INC.stored_state(spark, base), "k", "n") == [("a", 5), ("b", 2), ("c", 6)]


def test_lost_files_are_an_error_and_old_ones_go(spark, tmp_path):
    base = tmp_path / "s"
    apply = INC.foreach_batch_upsert(str(base), ["k"], ["n"], buckets=2)
    for n in range(6):
        apply(spark.createDataFrame([("a", n), ("b", n)], "k string, n int"), n)
    table = SN.SnapshotTable(spark, str(base))
    assert len(os.listdir(base / "manifests")) - sum(n.startswith(".") for n in os.listdir(base / "manifests")) == SN.KEPT
    live = {p for v in (4, 5) for p in json.loads((base / f"manifests/{v:08d}.json").read_text())["units"].values()}
    assert {os.path.relpath(os.path.dirname(f), base) for f in files(base)} == live
    for f in files(base):
        os.unlink(f)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST|NOT_FOUND"):
        for p in table.state().units.values():
            os.rename(base / p, base / f"{p}-away")
        apply(spark.createDataFrame([("a", 7)], "k string, n int"), 6)


def test_the_number_of_buckets_is_fixed(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1)], "k string, n int")
    INC.foreach_batch_upsert(f"{tmp_path}/s", ["k"], ["n"], buckets=4)(batch, 0)
    with pytest.raises(ValueError, match="has 4 buckets, not 8"):
        INC.foreach_batch_upsert(f"{tmp_path}/s", ["k"], ["n"], buckets=8)(batch, 1)


def test_merging_a_batch_is_one_shuffle(spark, tmp_path):
    """The rows are dealt to buckets once; the window over the keys needs no further exchange."""
    plans = []
    table = SN.SnapshotTable(spark, f"{tmp_path}/s")
    newest = lambda rows: (plans.append(SN_keep(rows)), plans[-1])[1]
    SN.merge_into_buckets(table, spark.range(50).select("id", F.lit(1).alias("n")), ["id"], newest, buckets=4)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def SN_keep(rows):
    from panelweave.operators.sets import keep_one

    return keep_one(rows, [SN.BUCKET, "id"], ["_age", "n"], last=True)


def test_accumulated_moments_equal_one_pass(spark, tmp_path):
    rows = [(f"k{i % 5}" if i % 11 else None, 1e6 * (i % 5) + (i * 37 % 101) / 7 if i % 13 else None, 1.0 + i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, x double, w double").withColumn("batch", F.pmod(F.xxhash64("x", "k"), F.lit(3)))
    partials = lambda batch: A.moment_states(batch, ["k"], ["x"], "w")
    apply = INC.foreach_batch_accumulate(f"{tmp_path}/m", ["k"], partials, lambda s, by: A.merge_moments(s, by, ["x"]), buckets=4)
    for n in (0, 0, 1, 2, 1):
        apply(df.filter(F.col("batch") == n).drop("batch"), n)
    got = {r.k: r for r in A.finish_moments(INC.stored_state(spark, f"{tmp_path}/m"), ["k"], ["x"]).collect()}
    want = {r.k: r for r in A.weighted_mean_ci(df, ["k"], ["x"], "w").collect()}
    assert set(got) == set(want) and len(got) == 6
    for k, r in want.items():
        assert got[k].sample_size == r.sample_size and got[k].x == pytest.approx(r.x, rel=1e-12) and got[k].x_se == pytest.approx(r.x_se, rel=1e-7)
