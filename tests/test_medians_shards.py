"""Medians by sketch narrowing and documents dealt to files of limited size."""

from __future__ import annotations

import json
import os
import random
import statistics

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from panelweave.operators import ordering as O
from panelweave.plans import publish as PB

SHAPES = {
    "uniform": lambda d: d.random(),
    "ties": lambda d: float(d.randrange(7)),
    "one value": lambda d: 5.0,
    "heavy tail": lambda d: d.paretovariate(0.4),
    "two heaps": lambda d: d.choice([-1e12, 1e12]) + d.random(),
    "hot middle": lambda d: 0.0 if d.random() < 0.9 else d.uniform(-1, 1),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_exact_medians_of_groups(spark, monkeypatch, shape):
    """A coarse sketch, so that the second scan has to narrow; odd, even and tiny groups, missing values and groups."""
    draw = random.Random(shape)
    rows = [(f"g{k}", SHAPES[shape](draw)) for k, n in enumerate((1, 2, 3, 10, 501, 20_000)) for _ in range(n)]
    rows += [("g3", None), ("empty", None), (None, 7.0)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    want = {g: statistics.median(x for h, x in rows if h == g and x is not None) for g in {r[0] for r in rows} - {"empty", None}}
    for accuracy in (20, 10_000):
        monkeypatch.setattr(O, "ACCURACY", accuracy)
        assert {r.g: r.median for r in O.exact_median(df, "x", by=["g"]).collect()} == want
        assert O.exact_median(df, "x", name="m").first().m == statistics.median(x for _, x in rows if x is not None)
    assert [r.median for r in O.exact_median(df.filter("false"), "x").collect()] == [None] and O.exact_median(df.filter("false"), "x", by=["g"]).collect() == []


def test_a_median_is_two_scans_without_a_sort_of_the_rows(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for by in ([], ["g"]):
        plan = O.exact_median(df, "x", by=by)._jdf.queryExecution().sparkPlan().toString()
        assert "RangePartitioning" not in plan and "rangepartitioning" not in plan
        executed = O.exact_median(df, "x", by=by)
        executed.collect()
        text = executed._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in text.split("Initial Plan")[0]
    assert O.exact_median(df, "x", by=["g"]).filter("g = 0").first().median == statistics.median(range(0, 1000, 3))


def test_a_sketch_that_misses_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    real = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, _, a: real(c, [0.9, 0.95], a))
    with pytest.raises(Exception, match="does not hold the middle rank"):
        O.exact_median(df, "x").collect()


def documents(spark, sizes):
    rows = [(k, "x" * (n - 1)) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "id int, document string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_file_stays_below_the_limit(spark, tmp_path, seed):
    draw, limit = random.Random(seed), 1000
    sizes = [draw.choice([draw.randint(1, 120), draw.randint(1, 499), draw.randint(501, 999)]) for _ in range(400)]
    docs = documents(spark, sizes)
    PB.write_shards(docs, "id", f"{tmp_path}/out", limit=limit)
    manifest = [json.loads(line) for f in os.listdir(tmp_path / "out/manifest") if f.endswith(".json") for line in open(tmp_path / "out/manifest" / f)]
    found = {}
    for folder in os.listdir(tmp_path / "out/files"):
        if folder.startswith("shard="):
            files = [f for f in os.listdir(tmp_path / "out/files" / folder) if f.startswith("part-")]
            assert len(files) == 1
            found[folder.removeprefix("shard=")] = os.path.getsize(tmp_path / "out/files" / folder / files[0])
    assert found == {m["shard"]: m["bytes"] for m in manifest} and max(found.values()) < limit
    assert sum(m["n_entities"] for m in manifest) == 400 and sum(found.values()) == sum(sizes)
    assert len(found) <= 2 * sum(sizes) / (limit / 2) + 2
    shards = {r.id: r.shard for r in PB.assign_shards(docs, "id", limit=limit).collect()}
    assert sorted(shards) == list(range(400))
    parts = [shards[k] for k in sorted(shards) if shards[k].startswith("part")]
    assert parts == sorted(parts)  # in the order of the entities


def test_multibyte_documents_are_measured_in_bytes(spark):
    docs = spark.createDataFrame([(1, "é" * 30), (2, "🙂" * 10)], "id int, document string")
    assert rows_of(PB.assign_shards(docs, "id", limit=200), "id", "bytes") == [(1, 61), (2, 41)]


def test_a_document_that_reaches_the_limit_alone_is_an_error(spark):
    with pytest.raises(Exception, match="a document alone reaches the limit of 100 bytes: 1"):
        PB.assign_shards(documents(spark, [5, 100]), "id", limit=100).collect()
    assert PB.assign_shards(documents(spark, [5, 99]), "id", limit=100).count() == 2
    assert PB.FILE_LIMIT == 50 * 1024 * 1024


def test_groups_of_a_median_are_not_gathered(spark):
    """Few groups are broadcast as soon as the plan is made, so no task sorts all rows of a group."""
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    plan = O.exact_median(df, "x", by=["g"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
