"""Compiled models: equal to the ML pipeline, to the loop over the years, and to a plain walk over the trees."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelweave.operators.windows import lag_features, temporal_split
from panelweave.plans import compiled as K
from panelweave.plans import models as M
from panelweave.session import materialize

NUMERIC = ["level_lag1", "level_rolling3", "share", "watch"]


@pytest.fixture(scope="module")
def rows(spark, town_panel):
    return temporal_split(lag_features(town_panel, ["level"], "entity", "year"), "year").cache()


@pytest.fixture(scope="module")
def models(rows):
    train = rows.filter("split = 'train'")
    return {
        "ridge": M.fit_ridge(train, "level", NUMERIC, ["region", "entity"]),
        "boosted": M.fit_boosted_trees(train, "level", NUMERIC, rounds=7, depth=3, leaf=1),
        "forest": M.fit_random_forest(train, "level", NUMERIC, trees=5, depth=4, leaf=1),
        "stumpless": M.fit_boosted_trees(train, "level", NUMERIC, rounds=2, depth=3, leaf=1000),  # no split is allowed
    }


def strange(rows):
    """Rows with missing numbers, a missing and an unseen category, and values far outside the train rows."""
    return rows.withColumns(
        {
            "share": F.when(F.col("year") % 3 != 0, F.col("share") * 100),
            "level_lag1": F.when(F.col("year") % 4 != 1, -F.col("level_lag1")),
            "region": F.when(F.col("entity") != "K1", F.when(F.col("year") % 2 == 0, "Elsewhere").otherwise(F.col("region"))),
        }
    )


@pytest.mark.parametrize("name", ["ridge", "boosted", "forest", "stumpless"])
def test_compiled_scores_equal_the_pipelines(rows, models, name):
    compiled = K.compile_model(models[name])
    for table in (rows, strange(rows)):
        both = K.compiled_predict(compiled, models[name].predict(table, "p"), "q")
        assert both.columns == [*table.columns, "p", "q"]
        got = both.select("p", "q").collect()
        assert len(got) == 27 and all(r.p == pytest.approx(r.q, abs=1e-9) for r in got)
    if name != "ridge":
        assert not any(stage.startswith("BatchEvalPython") for stage in both._jdf.queryExecution().executedPlan().toString().split())


@pytest.mark.parametrize("name", ["boosted", "forest", "stumpless"])
def test_rows_descend_the_node_table(rows, models, name):
    compiled = K.compile_model(models[name])
    nodes = compiled.nodes.collect()
    by_place = {(r.tree, r.node): r for r in nodes}
    assert len(by_place) == len(nodes) and {r.tree for r in nodes} == set(range(compiled.trees))
    scored = {(r.entity, r.year): r.q for r in K.descend(strange(rows), ["entity", "year"], compiled, "q").collect()}
    for r in strange(rows).collect():
        x = [compiled.medians[c] if r[c] is None else r[c] for c in compiled.features]
        total = 0.0
        for tree in range(compiled.trees):
            node = by_place[tree, 0]
            while node.feature >= 0:
                node = by_place[tree, node.left if x[node.feature] <= node.threshold else node.right]
            total += node.weight * node.value
        assert scored[r.entity, r.year] == pytest.approx(total, abs=1e-9)


def test_descending_shuffles_rows_and_not_tokens(spark, rows, models):
    """One shuffle, of the rows, however deep the trees are and however small a table Spark would broadcast by itself."""
    compiled = K.compile_model(models["forest"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = K.descend(materialize(rows), ["entity", "year"], compiled, "q")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert compiled.depth > 1 and plan.count("BroadcastHashJoin") == compiled.depth + 1
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["boosted", "forest", "stumpless"])
@pytest.mark.parametrize("most", [K.CELLS_AT_MOST, 40])
def test_cells_score_like_their_rows(rows, models, monkeypatch, name, most):
    """On a cut, beside it, missing, infinite and NaN; places in one column or, when there is no room, in several."""
    monkeypatch.setattr(K, "CELLS_AT_MOST", most)
    compiled = K.compile_model(models[name])
    cuts = [c for f in compiled.cuts for c in f] or [0.0]
    odd = [*cuts, *[c + 1e-9 for c in cuts], None, float("inf"), float("-inf"), float("nan")]
    names = NUMERIC
    made = [(i, *[odd[(i * (3 * k + 1) + k) % len(odd)] for k in range(len(names))]) for i in range(3 * len(odd))]
    table = rows.sparkSession.createDataFrame(made, "id int, " + ", ".join(f"{c} double" for c in names))
    wanted = {r.id: r.q for r in K.descend(table, ["id"], compiled, "q").collect()}
    assert {r.id: r.q for r in K.descend_by_cell(table, ["id"], compiled, "q").collect()} == pytest.approx(wanted, abs=1e-9)
    assert {r.id: r.q for r in K.compiled_predict(compiled, table, "q").collect()} == pytest.approx(wanted, abs=1e-9)
    assert (len(compiled.place(table)[1]) > 1) == (most == 40 and name != "stumpless")


def test_rows_of_a_cell_are_scored_once(rows, models):
    """Ten rows that differ, but by no cut, are one cell: the trees are walked once for all of them, not once for each."""
    compiled = K.compile_model(models["boosted"])
    one = rows.filter("entity = 'K1' AND year = 2020").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9))))
    near = one.withColumn("watch", F.col("watch") + F.col("n") * 1e-7)
    seen = []

    def score(cells, keys):
        seen.append(cells.count())
        return K.descend(cells, keys, compiled, "q")

    assert near.select("watch").distinct().count() == 10
    assert len({r.q for r in K.by_cell(compiled, near, score, "q").collect()}) == 1 and seen == [1]


def test_boosting_sees_bins_and_learns_as_from_rows(spark, monkeypatch):
    """Spark's learner gets one weighted row per combination of bins, and grows the trees that it grows on the rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    seen = []

    class Watched(GBTRegressor):
        def _fit(self, dataset):
            seen.append(dataset.count())
            return super()._fit(dataset)

    a, b, h = F.col("id") % 5, F.floor(F.col("id") / 7) % 4, F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    made = materialize(spark.range(3000).select("id", a.alias("a"), F.when(b != 3, b).alias("b"), (h * h).alias("c"), (a * 3 + b * b + a * b + h).alias("y")))
    plain = GBTRegressor(featuresCol="v", labelCol="y", predictionCol="p", stepSize=0.3, maxDepth=3, maxIter=8, minInstancesPerNode=4, seed=1)
    ready = VectorAssembler(inputCols=["a", "m"], outputCol="v").transform(made.withColumn("m", F.coalesce("b", F.lit(1.0))))
    wanted = {r.id: r.p for r in plain.fit(ready).transform(ready).collect()}
    monkeypatch.setattr(M, "GBTRegressor", Watched)
    how = {"rounds": 8, "rate": 0.3, "depth": 3, "seed": 1}
    got = M.fit_boosted_trees(made, "y", ["a", "b"], **how)
    assert seen == [15] and {r.id: r.q for r in got.predict(made, "q").collect()} == pytest.approx(wanted, abs=1e-9)
    # a thousand values are 32 bins: 15 * 32 combinations, and the trees do better than without the column
    more = M.fit_boosted_trees(made, "y", ["a", "b", "c"], **how)
    assert 15 * 16 < seen[1] <= 15 * 32
    assert M.boosting_losses(more, made, "y")[-1] < M.boosting_losses(got, made, "y")[-1]


def test_places_and_bin_values(spark):
    values = [None, -1.0, 0.0, -0.0, 0.5, 2.0, 2.5, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    got = {r.id: (r.p, r.q) for r in M.places(df, {"p": (F.coalesce("x", F.lit(9.0)), [-1.0, 0.0, 2.0]), "q": (F.col("x"), [])}).collect()}
    assert [got[i] for i in range(len(values))] == [(p, 0) for p in (0, 3, 2, 2, 1, 1, 0, 0, 3, 4)]
    many = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(7.0).alias("c"))
    bins = M.bin_values(many, ["a", "b", "c"], 32)
    assert len(bins["a"]) == 32 and bins["b"] == [0.0, 1.0, 2.0] and bins["c"] == [7.0] and M.bin_values(many.limit(0), ["a"], 32) == {"a": []}


def test_the_node_table_is_written_once(models):
    """Its readers scan one table; before, each of them joined the files of nodes and weights again."""
    nodes = K.compile_model(models["forest"]).nodes
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and len(nodes.inputFiles()) >= 1


def test_a_repeated_key_is_scored_once_for_all_its_rows(rows, models):
    """Keys may repeat or be missing: the sum goes over all rows of a key, as a group of the key holds them."""
    compiled = K.compile_model(models["boosted"])
    one = {r.year: r.q for r in K.descend(rows.filter("entity = 'K1'"), ["entity", "year"], compiled, "q").collect()}
    twice = rows.filter("entity = 'K1'").withColumn("entity", F.lit(None).cast("string"))
    got = K.descend(twice.unionAll(twice), ["entity", "year"], compiled, "q").collect()
    assert len(got) == len(one) and all(r.entity is None and r.q == pytest.approx(2 * one[r.year], abs=1e-9) for r in got)


def future_of(panel, years):
    last = panel.filter("year = 2024").drop("year", "level", "load")
    grid = last.withColumn("year", F.explode(F.sequence(F.lit(2023), F.lit(2024 + years))))
    grid = grid.withColumn("scenario", F.explode(F.array(F.lit("low"), F.lit("high"))))
    grid = grid.withColumn("share", F.when(F.col("scenario") == "high", 5.0 + F.col("year") % 3).otherwise(-5.0))
    return grid.filter("NOT (entity = 'K2' AND scenario = 'low' AND year = 2026)")  # a path with a hole


@pytest.mark.parametrize("name", ["ridge", "boosted"])
def test_one_fold_equals_the_loop_over_the_years(spark, rows, town_panel, models, name):
    history = town_panel.withColumn("level", F.when(~((F.col("entity") == "K3") & (F.col("year") > 2017)), F.col("level")))
    future = future_of(town_panel, 4)
    how = {"entity": "entity", "path": ["scenario"], "year": "year", "target": "level"}
    loop = M.recursive_forecast(models[name].predict, history, future, **how)
    fold = K.compiled_forecast(K.compile_model(models[name]), history, future, **how)
    a, b = ({(r.entity, r.scenario, r.year): r.predicted for r in out.collect()} for out in (loop, fold))
    assert set(a) == set(b) and len(a) == 2 * 4 * 2 - 1 + 2 * 6  # K3 is known until 2017 only; the grid starts in 2023
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) and 5 <= b[k] <= 150 for k in a)


def test_forecast_reads_lagged_covariates(spark, town_panel, rows):
    train = lag_features(rows, ["share"], "entity", "year", lags=(1, 2), rolling=None).filter("split = 'train'")
    model = M.fit_ridge(train, "level", ["level_lag2", "level_lag3", "share_lag1", "history_mean_target", "year_index"][:3])
    how = {"entity": "entity", "path": ["scenario"], "year": "year", "target": "level", "exogenous_lags": ["share"]}
    loop = M.recursive_forecast(model.predict, town_panel, future_of(town_panel, 3), **how)
    fold = K.compiled_forecast(K.compile_model(model), town_panel, future_of(town_panel, 3), **how)
    a, b = ({(r.entity, r.scenario, r.year): r.predicted for r in out.collect()} for out in (loop, fold))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_a_forecast_is_one_plan(spark, town_panel, models):
    """No job while the plan is built, however many years; the trees are read once, as a subquery."""
    compiled = K.compile_model(models["boosted"])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        plans = [
            K.compiled_forecast(compiled, town_panel, future_of(town_panel, n), entity="entity", path=["scenario"], year="year", target="level")
            for n in (2, 36)
        ]
        assert tracker.getJobIdsForGroup("building") in ([], ())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sizes = [p._jdf.queryExecution().sparkPlan().toString().count("Join") for p in plans]
    assert sizes[0] == sizes[1]
    assert plans[1].count() == 3 * 2 * 36 - 1


def test_other_models_have_no_compiled_form(spark, rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    parts = [VectorAssembler(inputCols=["share__x"], outputCol="_features"), DecisionTreeRegressor(featuresCol="_features", labelCol="level", predictionCol="_prediction")]
    stats = M.fit_stats(rows, ["share"])
    fitted = Pipeline(stages=parts).fit(rows.withColumn("share__x", F.col("share")))
    with pytest.raises(TypeError):
        K.compile_model(M.FittedModel("tree", stats, {}, fitted, False))
