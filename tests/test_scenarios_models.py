from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from panelweave.operators.windows import lag_features, temporal_split
from panelweave.plans import audit as AU
from panelweave.plans import models as M
from panelweave.plans import projection as PR
from panelweave.plans import scenario as SC
from panelweave.plans import specs

INDEX = ["remote_work_exposure_index", "digital_distraction_index", "in_person_social_index"]


def index_panel(panel):
    return panel.select(
        "entity", "name", "region", "year", "level", "stock", F.col("share").alias(INDEX[0]), F.col("load").alias(INDEX[1]),
        F.col("meet").alias(INDEX[2]), F.col("share").alias("remote_work_share_state_year"),
    )


def paths(panel, end, scenarios=tuple(specs.SCENARIOS)):
    p = index_panel(panel)
    share = "remote_work_share_state_year"
    anchor = SC.baseline_anchor(p, "entity", "year", slopes=INDEX, logit_slopes=[share], growth=["stock"])
    anchor = SC.override_scales(anchor, [*INDEX, share])
    last = p.agg(F.max("year")).scalar()
    return SC.scenario_covariates(anchor, last, end, list(scenarios), additive=INDEX, share=share, compound=["stock"])


def test_factor_signs():
    assert PR.scenario_factor("A") < 0 < PR.scenario_factor("C")
    with pytest.raises(ValueError, match="unknown scenario code"):
        PR.scenario_factor("Z")


def test_shift_saturates_and_shares_stay_bounded(spark, town_panel):
    out = paths(town_panel, 2060).filter("entity = 'K1'")
    got = {(r.scenario_name, r.year): r for r in out.collect()}
    assert {y for _, y in got} == set(range(2024, 2061))
    shift = [got[("remote_work_dominant", y)][INDEX[0]] - got[("baseline_continuation", y)][INDEX[0]] for y in range(2024, 2061)]
    steps = np.diff(shift)
    assert shift[0] == 0 and all(a > b > 0 for a, b in zip(steps, steps[1:])) and steps[-1] < 0.01
    assert all(0 <= r.remote_work_share_state_year <= 1 for r in got.values())
    assert got[("baseline_continuation", 2024)].covariate_status == "observed_anchor"


def test_paths_equal_the_step_by_step_rule(spark, town_panel):
    end, k_end = 2034, 10
    anchor = SC.baseline_anchor(index_panel(town_panel), "entity", "year", slopes=INDEX, logit_slopes=["remote_work_share_state_year"], growth=["stock"])
    start = SC.override_scales(anchor, [*INDEX, "remote_work_share_state_year"]).filter("entity = 'K2'").first()
    final = paths(town_panel, end, ["remote_work_dominant"]).filter(f"entity = 'K2' AND year = {end}").first()
    v, s, pop = start[INDEX[0]], start.remote_work_share_state_year, start.stock
    scale = start[f"scenario_scale_{INDEX[0]}"]
    clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    for k in range(k_end):
        v += start[f"{INDEX[0]}_baseline_slope"] + 0.03 * scale * 0.92**k
        z = math.log(clip(s) / (1 - clip(s))) + start["remote_work_share_state_year_logit_slope"]
        s = clip(1 / (1 + math.exp(-z)) + 0.004 * start["scenario_scale_remote_work_share_state_year"] * 0.92**k)
        pop *= 1 + start.stock_baseline_growth
    assert final[INDEX[0]] == pytest.approx(v) and final.remote_work_share_state_year == pytest.approx(s) and final.stock == pytest.approx(pop)


def test_entities_differ_under_a_scaled_scenario(spark, town_panel):
    out = paths(town_panel, 2040).filter("year = 2040")
    base = {r.entity: r[INDEX[0]] for r in out.filter("scenario_name = 'baseline_continuation'").collect()}
    moved = {r.entity: r[INDEX[0]] for r in out.filter("scenario_name = 'remote_work_dominant'").collect()}
    assert len({round(moved[e] - base[e], 9) for e in base}) > 1
    assert all(moved[e] >= base[e] for e in base)


def test_unknown_scenario_is_the_baseline_and_user_values_count():
    assert SC.growth_overrides("nothing") == {}
    assert SC.growth_overrides("in_person_revival") == specs.SCENARIOS["in_person_revival"][1]
    assert SC.growth_overrides("user_defined", user={"remote_work_exposure": 0.5, "x": 1}) == {INDEX[0]: 0.5}


def test_births_and_bands(spark):
    df = spark.createDataFrame([(60.0, 2000.0, 100.0)], "rate double, women double, births double")
    row = df.select(PR.events_from_rate("rate", "women").alias("b"), *[c.alias(n) for n, c in PR.uncertainty_bands("births", {"uncertainty_multiplier_low": 0.8, "uncertainty_multiplier_high": 1.2}).items()]).first()
    assert (row.b, row.births_low, row.births_mid, row.births_high) == (120.0, 80.0, 100.0, 120.0)


def test_trend_projection_years_and_columns(spark):
    rows = [(e, y, 50.0 + b + y - 2020, 1.5) for e, b in (("a", 0.0), ("b", 5.0)) for y in (2020, 2021, 2022)]
    df = spark.createDataFrame(rows, "e string, year int, gfr double, tfr double")
    out = PR.trend_projection(df, "e", "year", "gfr", "tfr", 2025, ["C"])
    assert {r.year for r in out.collect()} == {2023, 2024, 2025}
    first = out.filter("e = 'a' AND year = 2023").first()
    assert first.baseline_rate == pytest.approx(53.0) and first.adjusted_rate == pytest.approx(53.0 * (1 + PR.scenario_factor("C")))
    assert first.projected_second_rate == pytest.approx(first.adjusted_rate * 1.5 / 52.0)


def test_component_projection_keeps_models_apart(spark):
    history = spark.createDataFrame([("a", 2023, 990.0, 9.9, 0.0), ("a", 2024, 1000.0, 10.0, 20.0)], "e string, year int, pop double, deaths double, net double")
    rows = [(m, "s", "a", y, 20.0, 1000.0) for m in ("m1", "m2") for y in (2025, 2026)]
    f = spark.createDataFrame(rows, "model string, sc string, e string, year int, rate double, women double")
    out = PR.component_projection(f, history, entity="e", year="year", scenario=["model", "sc"], rate="rate", base="women", stock="pop", deaths="deaths", net="net", end_year=2025)
    assert rows_of(out, "model", "year", "stock_next") == [("m1", 2025, 1030.0), ("m2", 2025, 1030.0)]


def test_reference_rows_have_no_mechanism_and_identity_holds(spark):
    rows = [("e", 2030, "reference_path", 10.0), ("e", 2030, "digital_distraction_crowds_out", 12.0), ("f", 2030, "reference_path", 14.0), ("f", 2030, "digital_distraction_crowds_out", 15.0)]
    df = spark.createDataFrame(rows, "e string, y int, scenario string, screen_leisure_minutes_broad_state_year double")
    terms = [t for t in specs.ADJUSTMENT_TERMS if t[1].startswith("screen") and t[0].startswith("digital")]
    out = SC.mechanism_contributions(df, ["e", "y"], "scenario", "reference_path", terms)
    got = {(r.e, r.scenario): r for r in out.collect()}
    assert got[("e", "reference_path")].scenario_adjustment == 0 and got[("e", "reference_path")].main_driver == "observed state trend"
    moved = got[("e", "digital_distraction_crowds_out")]
    assert moved.scenario_adjustment == pytest.approx(-0.24 * 2.0 / 2.0) and moved.main_driver == "screen leisure"
    rec = SC.bounded_paths(out.withColumn("ref", F.lit(5.05)), "ref", "scenario_adjustment").withColumnRenamed("ref", "reference_path")
    assert {r.scenario_path for r in rec.filter("bounded_flag").collect()} == {5.0}
    bad = AU.consistency_checks(rec.withColumn("model", F.lit("m")), coverage_keys=["model", "scenario", "y"], entity="e", expected=2, required=["scenario_path"])
    assert bad.count() == 0


def scored_panel(panel):
    return temporal_split(lag_features(panel, ["level"], "entity", "year"), "year")


def test_ridge_equals_the_closed_form(spark, town_panel):
    rows = scored_panel(town_panel)
    train = rows.filter("split = 'train'")
    numeric = ["level_lag1", "share", "watch"]
    model = M.fit_ridge(train, "level", numeric, ["region"])
    data = rows.orderBy("entity", "year").toPandas()
    t = data[data.split == "train"]
    x = t[numeric].fillna(t[numeric].median())
    mean, sd = x.mean(), x.std(ddof=0).replace(0, 1)

    def design(d):
        z = ((d[numeric].fillna(t[numeric].median()) - mean) / sd).to_numpy()
        return np.column_stack([z, *[(d.region == g).to_numpy(float) for g in sorted(t.region.unique())]])

    a = design(t)
    centre, y0 = a.mean(axis=0), t.level.mean()
    w = np.linalg.solve((a - centre).T @ (a - centre) + np.eye(a.shape[1]), (a - centre).T @ (t.level - y0).to_numpy())
    want = y0 + (design(data) - centre) @ w
    got = model.predict(rows, "p").orderBy("entity", "year").toPandas().p.to_numpy()
    assert np.allclose(got, want, atol=1e-6)
    unseen = model.predict(rows.limit(1).withColumn("region", F.lit("Elsewhere")), "p").first().p
    assert math.isfinite(unseen)


def test_trees_score_and_forest_runs(spark, town_panel):
    rows = scored_panel(town_panel)
    train = rows.filter("split = 'train'")
    for model in (M.fit_boosted_trees(train, "level", ["level_lag1", "share"], rounds=3), M.fit_random_forest(train, "level", ["level_lag1", "share"], trees=3)):
        got = [r.p for r in model.predict(rows, "p").collect()]
        assert len(got) == 27 and all(50 < v < 70 for v in got)


def test_loss_falls_and_a_saved_model_scores_alike(spark, town_panel, tmp_path):
    rows = scored_panel(town_panel)
    train = rows.filter("split = 'train'")
    trees = M.fit_boosted_trees(train, "level", ["level_lag1", "share"], rounds=12)
    losses = M.boosting_losses(trees, train, "level")
    assert len(losses) == 12 and losses[-1] < losses[0]
    for model in (trees, M.fit_ridge(train, "level", ["level_lag1", "share"], ["region"])):
        model.save(f"{tmp_path}/{model.name}")
        again = M.FittedModel.load(f"{tmp_path}/{model.name}")
        assert again.features == model.features
        assert rows_of(again.predict(rows, "p"), "entity", "year", "p") == rows_of(model.predict(rows, "p"), "entity", "year", "p")


def test_fitted_ridge_runs_in_the_closed_loop_for_36_years(spark, town_panel):
    rows = scored_panel(town_panel)
    model = M.fit_ridge(rows.filter("split = 'train'"), "level", ["level_lag1", "level_lag2", "share"], ["region"])
    out = M.recursive_forecast(model.predict, town_panel, future_of(town_panel, 36), entity="entity", path=["scenario"], year="year", target="level")
    got = {(r.entity, r.scenario, r.year): r.predicted for r in out.collect()}
    assert len(got) == 3 * 2 * 36 and all(5 <= v <= 150 for v in got.values())
    assert got["K1", "low", 2060] != got["K1", "high", 2060]


def future_of(panel, years=5):
    last = panel.filter("year = 2024").drop("year", "level")
    grid = last.withColumn("year", F.explode(F.array(*[F.lit(2024 + k) for k in range(years + 1)])))
    return grid.withColumn("scenario", F.explode(F.array(F.lit("low"), F.lit("high")))).withColumn("share", F.when(F.col("scenario") == "high", 5.0).otherwise(-5.0))


def test_forecasts_stay_in_bounds_and_both_forms_agree(spark, town_panel):
    future = future_of(town_panel)
    score = lambda df, c: df.withColumn(c, M.linear_score({"level_lag1": 0.7, "level_lag2": 0.2, "share": 30.0}, 5.0))
    step = M.recursive_forecast(score, town_panel, future, entity="entity", path=["scenario"], year="year", target="level")
    fold = M.linear_recursive_forecast(
        town_panel, future, entity="entity", path=["scenario"], year="year", target="level", lags=[0.7, 0.2, 0.0], rolling=0.0,
        exogenous=F.lit(5.0) + F.lit(30.0) * F.col("share"),
    )
    a = {(r.entity, r.scenario, r.year): r.predicted for r in step.collect()}
    b = {(r.entity, r.scenario, r.year): r.predicted for r in fold.collect()}
    assert set(a) == set(b) and {y for *_, y in a} == set(range(2025, 2030))
    assert all(a[k] == pytest.approx(b[k]) and 5 <= a[k] <= 150 for k in a)


def test_naive_paths(spark, town_panel):
    out = SC.naive_future_paths(town_panel, future_of(town_panel).drop("level"), ["entity", "scenario"], "entity", "year", "level")
    rows = out.filter("entity = 'K1' AND scenario = 'low'").orderBy("year").collect()
    hist = {r.year: r.level for r in town_panel.filter("entity = 'K1'").collect()}
    step = hist[2024] - hist[2023]
    assert [r.year for r in rows] == list(range(2025, 2030))
    assert all(r.baseline_last_observed == hist[2024] for r in rows)
    assert [r.baseline_recent_trend for r in rows] == pytest.approx([hist[2024] + k * step for k in range(1, 6)])


def test_importance_of_an_unused_feature_is_zero(spark, town_panel):
    rows = town_panel.withColumn("id", F.col("year") * 100 + F.substring("entity", 2, 1).cast("int"))
    score = lambda df, c: df.withColumn(c, F.col("level") + (F.col("share") - 0.25) * 10)
    got = dict(rows_of(M.permutation_importance(rows, score, ["share", "watch"], "level", "id"), "feature", "importance_value"))
    assert got["watch"] == pytest.approx(0.0, abs=1e-12) and abs(got["share"]) < 5


def test_local_contributions(spark, town_panel):
    score = lambda df, c: df.withColumn(c, F.lit(2.0) * F.col("share") - F.col("load"))
    out = M.local_perturbation(town_panel, town_panel, score, ["share", "load"], ["entity", "year"], name="m", place="name", year="year")
    data = town_panel.toPandas()
    own = data[(data.entity == "K3") & (data.year == 2024)].share.iloc[0]
    row = out.filter("entity = 'K3' AND year = 2024 AND feature = 'share'").first()
    assert row.contribution == pytest.approx(2 * (own - data.share.median()))
    assert {r.importance_rank for r in out.collect()} == {1, 2}


def test_local_contribution_of_a_category_uses_its_mode(spark, town_panel):
    score = lambda df, c: df.withColumn(c, F.when(F.col("region") == "inland", 3.0).otherwise(1.0) + F.col("share"))
    out = M.local_perturbation(
        town_panel, town_panel, score, ["share", "region"], ["entity", "year"], name="m", place="name", year="year", categorical=["region"]
    )
    got = {(r.entity, round(r.contribution, 9)) for r in out.filter("feature = 'region'").collect()}
    assert got == {("K1", 2.0), ("K2", 0.0), ("K3", 0.0)}


def test_profile(spark, town_panel):
    df = lag_features(town_panel, ["level"], "entity", "year", lags=(1,), rolling=None).select("entity", "level", "level_lag1")
    got = rows_of(M.column_profile(df, {"level": "modelled value"}))
    assert ("level_lag1", "double", "lagged feature", 24) in got and ("level", "double", "modelled value", 27) in got
    numeric, cats = M.feature_columns(df.withColumn("empty", F.lit(None).cast("double")), ["level", "empty", "absent", "level"], ["entity", "x"])
    assert (numeric, cats) == (["level"], ["entity"])


def test_noisy_later_years_are_no_error(spark):
    """Trees fit the train rows and miss later, independent values by more than their spread; trees off their own train rows are an error."""
    from panelweave.bindings.modelling import checked_errors

    rows = [("tree_gradient_boosting", "train", float(i), i + 0.1) for i in range(4)]
    rows += [("tree_gradient_boosting", "validation", a, p) for a, p in ((1.0, 9.0), (2.0, -9.0))]
    schema = "model_name string, split string, actual double, predicted double"
    got = checked_errors(spark.createDataFrame(rows, schema), ["tree_gradient_boosting"])
    assert rows_of(got, "split", "n", "rmse") == [("train", 4, None), ("validation", 2, None)]
    off = spark.createDataFrame([(m, s, a, 3.0 - 3 * a) for m, s, a, _ in rows[:4]], schema)
    with pytest.raises(Exception, match="not sound on train"):
        checked_errors(off, ["tree_gradient_boosting"]).collect()
