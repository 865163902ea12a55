from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from panelweave.functions import columns as C
from panelweave.operators import aggregate as A
from panelweave.operators import joins as J
from panelweave.operators import ranking as R
from panelweave.operators import sets as S
from panelweave.plans import audit as AU
from panelweave.plans import specs


def test_baseline_literal(spark):
    rows = [("01", 2018, 0.04, 24.0), ("01", 2019, 0.06, 25.0), ("01", 2021, 0.12, 20.0)]
    df = spark.createDataFrame(rows, "e string, year int, share double, commute double")
    out = J.baseline_deltas(df, "e", "year", (2018, 2019), rising={"share": "growth"}, falling={"commute": "savings"})
    row = out.withColumn("round_trip", F.col("share") * F.col("commute") * 2).filter("year = 2021").first()
    assert (round(row.growth, 9), round(row.savings, 9), round(row.round_trip, 9)) == (0.07, 4.5, 4.8)


def test_null_safe_join_matches_missing_to_missing(spark):
    left = spark.createDataFrame([(None,), ("a",)], "k string")
    right = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert rows_of(J.null_safe_join(left, right, ["k"])) == sorted([(None, 1), (None, 2), ("a", 3)], key=repr)


def test_two_pass_keeps_every_left_row(spark):
    left = spark.createDataFrame([(1, "A", "T1"), (2, "A", "T2"), (3, "A", None), (4, "B", "T1")], "id int, k string, text string")
    right = spark.createDataFrame([(1, "A", "X", "d1"), (1, "A", "Y", "d2"), (9, "A", "T2", "d3")], "id int, k string, text string, d string")
    out = J.two_pass_join(left, right, first_keys=["k", "id"], second_keys=["k", "text"], values=["d"])
    assert rows_of(out, "id", "d", "matched_by") == sorted(
        [(1, "d1", "id"), (1, "d2", "id"), (2, "d3", "text"), (3, None, None), (4, None, None)], key=repr
    )


def test_two_pass_reads_the_left_rows_once(spark, tmp_path):
    """One scan of the left rows and one per set of partners; missing keys, map columns and missing values change no row."""
    rows = [(1, "A", "T1"), (2, "A", "T2"), (2, "A", "T2"), (3, None, "T1"), (None, "A", "T2"), (None, None, None), (5, "A", "T5"), (6, "B", None)]
    spark.createDataFrame(rows, "id int, k string, text string").withColumn("m", F.create_map(F.lit("x"), F.col("id"))).write.parquet(f"{tmp_path}/l")
    partners = [(1, "A", "X", "d1"), (1, "A", "X", "d1"), (9, "A", "T2", "d3"), (8, "A", "T2", "d4"), (7, "A", "T5", None), (None, "A", "T1", "d5"), (6, "B", "Z", None)]
    spark.createDataFrame(partners, "id int, k string, text string, d string").write.parquet(f"{tmp_path}/r")
    left, right = spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")
    out = J.two_pass_join(left, right, first_keys=["k", "id"], second_keys=["k", "text"], values=["d"])
    assert out.columns == ["id", "k", "text", "m", "d", "matched_by"]
    assert rows_of(out, "id", "k", "d", "matched_by") == sorted(
        [(1, "A", "d1", "id"), *[(2, "A", "d3", "text"), (2, "A", "d4", "text")] * 2, (3, None, None, None), (None, "A", "d3", "text"),
         (None, "A", "d4", "text"), (None, None, None, None), (5, "A", None, None), (6, "B", None, "id")], key=repr
    )
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 3


def test_panels_base_wins_and_empty_frames_are_passed_over(spark):
    a = spark.createDataFrame([("x", 1, 10)], "e string, t int, v int")
    b = spark.createDataFrame([("x", 1, 99, 5)], "e string, t int, v int, w int")
    assert rows_of(J.left_join_panels([a.limit(0), None, a, b], ["e", "t"])) == [("x", 1, 10, 5)]
    with pytest.raises(ValueError, match="key \\('x', 1\\) occurs 2 times"):
        J.assert_unique(a.union(a), ["e", "t"], "acs")


def test_region_proxy_literals(spark):
    region = spark.createDataFrame([("South", 2020, 15.4), ("West", 2020, 12.6), ("West", 2021, 14.0)], "region string, year int, m double")
    national = spark.createDataFrame([(2020, 14.0)], "year int, m double")
    out = J.rescaled_region_proxy(region, national, region="region", year="year", value="m", anchor=25.0, name="p")
    assert [(r.region, r.year, round(r.p, 9)) for r in out.orderBy("region", "year").collect()] == [
        ("South", 2020, 27.5), ("West", 2020, 22.5), ("West", 2021, 25.0),
    ]


def test_hierarchy_fallback_and_pooled_status(spark):
    panel = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", "W"), ("d", "S")], "e string, g string").withColumn("t", F.lit(1))
    fine = spark.createDataFrame([("a", 1, 5.0, 6.0, False), ("d", 1, None, 8.0, True)], "e string, t int, m double, m_pooled double, is_pooled_estimate boolean")
    middle = spark.createDataFrame([("S", 1, 7.0)], "g string, t int, m double")
    coarse = spark.createDataFrame([(1, None)], "t int, m double")
    out = J.hierarchy_fallback_join(
        panel, fine, middle, coarse, entity="e", group="g", year="t", metrics=["m"], adjustments={"m": F.lit(0.5)}, pooled={"m": "m_pooled"}
    )
    assert rows_of(out, "e", "m", "m_status") == [("a", 5.0, "observed"), ("b", 7.5, "modeled"), ("c", None, "missing"), ("d", 8.0, "imputed")]


def test_activity_means_and_interval(spark):
    rows = [("120308", 30.0), ("120303", 45.0), ("120307", 20.0), ("120101", 15.0)]
    df = spark.createDataFrame(rows, "code string, minutes double").withColumns({"w": F.lit(1.0), "y": F.lit(2020)})
    flags = C.classify_code("code", None, prefixes=specs.ACTIVITY_PREFIXES, exact=specs.ACTIVITY_EXACT, tiers=specs.ACTIVITY_TIERS)
    df = df.withColumns({"narrow": C.masked("minutes", flags["is_digital_media_narrow"]), "broad": C.masked("minutes", flags["is_screen_leisure_broad"])})
    row = A.weighted_mean_ci(df, ["y"], ["narrow", "broad"], "w").first()
    assert (row.narrow, row.broad, row.sample_size) == (7.5, 23.75, 4)
    var = sum((x - 7.5) ** 2 for x in (30, 0, 0, 0)) / 4
    assert row.narrow_se == pytest.approx(math.sqrt(var / 4))
    assert row.narrow_ci_high - row.narrow == pytest.approx(1.96 * row.narrow_se)


def test_interval_is_stable_far_from_zero_and_exact_for_constants(spark):
    rows = [("a", 1e9 + i, 1.0 + i % 3) for i in range(100)] + [("b", 5.0, 2.0), ("b", 5.0, 1.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double")
    out = {r.k: r for r in A.weighted_mean_ci(df, ["k"], ["x"], "w").collect()}
    near = A.weighted_mean_ci(df.filter("k = 'a'"), ["k"], ["x"], "w").first()
    w = [1.0 + i % 3 for i in range(100)]
    mu = sum(wi * i for i, wi in enumerate(w)) / sum(w)
    var = sum(wi * (i - mu) ** 2 for i, wi in enumerate(w)) / sum(w)
    neff = sum(w) ** 2 / sum(wi * wi for wi in w)
    assert out["a"].x == pytest.approx(1e9 + mu, abs=1e-5)
    assert out["a"].x_se == pytest.approx(math.sqrt(var / neff), rel=1e-6)
    assert near.x_se == pytest.approx(math.sqrt(var / neff), rel=1e-6) and near.x == pytest.approx(1e9 + mu, abs=1e-5)
    assert (out["b"].x, out["c"].x, out["c"].x_se) == (5.0, None, None) and out["b"].x_se == pytest.approx(0.0, abs=1e-6)


def test_partials_in_batches_equal_one_pass(spark):
    rows = [("k" if i % 3 else None, float(i % 7) if i % 5 else None, float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x double, w double")
    m = [A.Measure("mean", F.col("x")), A.Measure("sub", F.col("x"), F.col("x") > 2)]
    parts = [A.panel_partials(df.filter(c), ["k"], "w", m) for c in ("w < 1", "w >= 1")]
    merged = rows_of(A.finish_partials(parts, ["k"], ["mean", "sub"]))
    assert merged == rows_of(A.subpopulation_panel(df.dropna(subset=["k"]), ["k"], "w", m))


def test_sum_of_an_all_missing_group_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, x double")
    assert rows_of(df.groupBy("k").agg(A.sum_or_zero("x").alias("s"))) == [("a", 0.0), ("b", 2.0)]


def test_weighted_distribution_is_a_sorted_share_map(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 3.0), ("g", None, 5.0), ("z", "a", 0.0)], "k string, c string, w double")
    assert {r.k: r.distribution for r in A.weighted_distribution(df, ["k"], "c", "w").collect()} == {"g": {"a": 0.75, "b": 0.25}}


def test_text_rollups(spark):
    rows = [("k", "Reading", "Level", "2"), ("k", "Reading", "Imp", "3"), ("k", "Reading", "Imp", "3"), ("k", "Art", None, None)]
    df = spark.createDataFrame(rows, "k string, el string, sc string, v string")
    assert rows_of(A.two_level_text(df, ["k"], "el", "sc", "v", "s")) == [("k", "Art; Reading (Imp=3, Level=2)")]
    assert rows_of(A.two_level_text(df, ["k"], "el", None, None, "s")) == [("k", "Art; Reading")]


def test_metrics_against_definitions(spark):
    rows = [("m", "test", "a", "S", 2019, 10.0, 11.0), ("m", "test", "a", "S", 2021, 12.0, 11.0), ("m", "test", "b", "W", 2021, 0.0, 2.0), ("m", "test", "b", "W", 2021, None, 1.0)]
    df = spark.createDataFrame(rows, "model string, split string, e string, g string, year int, y double, p double")
    out = {(r.group_type, r.group_name): r for r in AU.error_metrics(df, ["model", "split"], entity="e", region="g", year="year", actual="y", predicted="p", split_year=2020).collect()}
    total = out[("overall", "all")]
    assert (total.n_obs, round(total.rmse, 9), round(total.mae, 9)) == (3, round(math.sqrt(2.0), 9), round(4 / 3, 9))
    assert total.mape == pytest.approx((0.1 + 1 / 12) / 2)
    mean = 22 / 3
    assert total.r_squared == pytest.approx(1 - 6 / sum((y - mean) ** 2 for y in (10, 12, 0)))
    assert out[("entity", "b")].r_squared is None and out[("period", "before")].n_obs == 1 and ("region", "W") in out
    assert len(out) == 1 + 2 + 2 + 2


def test_rankings_match_the_rule(spark):
    rows = [("m", n, d) for n, d in [("A", 0.2), ("B", 0.2), ("C", -0.3), ("D", 0.01), ("E", None), ("F", 0.06), ("G", 1.0), ("H", 0.5), ("I", 0.4)]]
    df = spark.createDataFrame(rows, "m string, n string, d double")
    out = rows_of(R.direction_rankings(df, ["m"], "d", "n", tolerance=0.05), "ranking_group", "rank", "n")
    assert [n for g, _, n in out if g == "upward"] == ["G", "H", "I", "A", "B"]
    assert [n for g, _, n in out if g == "downward"] == ["C"]
    assert [n for g, _, n in out if g == "closest"] == ["D", "F", "A", "B", "C"]


def test_preview(spark):
    df = spark.createDataFrame([("k", f"{i:02d}") for i in range(5)] + [("k", "00"), ("n", None)], "k string, c string")
    assert rows_of(R.preview_with_overflow(df, ["k"], "c", limit=3)) == [("k", 5, "00, 01, 02, ... (+2 more)"), ("n", 0, "none")]


def test_keep_one_and_blank_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("", 4, "q")], "k string, i int, v string")
    assert rows_of(S.keep_one(df, ["k"], ["i"], last=True), "k", "v") == sorted([("a", "y"), (None, "z"), ("", "q")], key=repr)
    assert rows_of(S.keep_one_blank_keys(df, ["k"], ["i"]), "v") == [("x",), ("z",)]


def test_hot_key_keeps_results_whole(spark):
    """A third of the rows under one key: every operator that groups by it still sees all of them."""
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        F.col("id"), (F.col("id") % 97).cast("double").alias("x"), F.lit(1.0).alias("w"),
    )
    hot = A.weighted_mean_ci(df, ["k"], ["x"], "w").filter("k = 'hot'").first()
    assert hot.sample_size == n // 3
    assert S.keep_one(df, ["k"], ["id"], last=True).filter("k = 'hot'").first().id == n - 3
    assert R.top_per_group(df, ["k"], [F.col("id").desc()], 4).filter("k = 'hot'").count() == 4
    matched = J.match_report(df.select("k"), df.select("k").distinct(), "k").filter("k = 'hot'").first()
    assert (matched.left_rows, matched.status) == (n // 3, "matched")


def test_a_doubled_key_in_a_joined_panel_is_an_error(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    twice = spark.createDataFrame([("a", 5), ("a", 6)], "k string, y int")
    with pytest.raises(ValueError, match="a joined panel: key .*'a'.* occurs 2 times"):
        J.left_join_panels([base, twice], ["k"])


def test_the_interval_keeps_its_digits_far_from_zero(spark):
    values = [1e9, 1e9 + 0.1, 1e9 + 0.2, 1e9 + 0.3]
    df = spark.createDataFrame([("g", v, 1.0) for v in values], "k string, x double, w double")
    row = A.weighted_mean_ci(df, ["k"], ["x"], "w").first()
    sd = (sum((v - sum(values) / 4) ** 2 for v in values) / 4) ** 0.5
    assert row.x == pytest.approx(1e9 + 0.15, abs=1e-6) and row.x_se == pytest.approx(sd / 2, rel=1e-6)
    grains = A.multi_grain(df.withColumn("r", F.lit("q")), [A.Grain("fine", ("r", "k")), A.Grain("coarse", ("r",))], ["x"], "w").collect()
    assert all(r.x_se == pytest.approx(sd / 2, rel=1e-6) for r in grains)


def two_pass(rows):
    """Weighted mean, its error and effective size in exact rationals."""
    rows = [(Fraction(x), Fraction(w)) for x, w in rows if x is not None and w is not None]
    total = sum(w for _, w in rows)
    mean = sum(w * x for x, w in rows) / total
    spread = sum(w * (x - mean) ** 2 for x, w in rows) / total
    effective = max(total**2 / sum(w * w for _, w in rows), 1)
    return float(mean), math.sqrt(spread / effective)


@pytest.mark.parametrize(("distance", "spread", "weights"), [
    (1e6, 1.0, (1.0, 60.0)), (1e6, 1.0, (1e4, 3e6)), (1e6, 1e-3, (100.0, 5e5)), (3e4, 2e4, (1.0, 50.0)), (0.0, 1e5, (1e-7, 3e-7)), (1e8, 50.0, (0.0, 1.0)),
])
def test_moments_keep_their_digits_at_any_distance(spark, distance, spread, weights):
    """Groups a million spreads apart, weights of any scale that depend on the values: mean and error right to 1e-6."""
    draw = random.Random(int(distance) + 7)
    data = []
    for g in range(4):
        for _ in range(200):
            x = (g - 1) * distance * spread + spread * draw.expovariate(1.0)
            w = weights[0] + (weights[1] - weights[0]) * draw.random() * (0.5 if x > g * distance * spread else 1.0)
            data.append((f"g{g}", draw.choice("pq"), None if draw.random() < 0.05 else x, None if draw.random() < 0.05 else w))
    df = spark.createDataFrame(data, "k string, half string, x double, w double").repartition(7)
    one = {r.k: r for r in A.weighted_mean_ci(df, ["k"], ["x"], "w").collect()}
    halves = [A.moment_states(df.filter(F.col("half") == h), ["k"], ["x"], "w") for h in "pq"]
    merged = {r.k: r for r in A.finish_moments(A.merge_moments(halves[0].unionByName(halves[1]), ["k"], ["x"]), ["k"], ["x"]).collect()}
    for k in one:
        mean, error = two_pass([(x, w) for key, _, x, w in data if key == k])
        for got in (one[k], merged[k]):
            assert got.sample_size == 200 and abs(got.x - mean) <= 1e-6 * error * 200**0.5 and got.x_se == pytest.approx(error, rel=1e-6)
    whole = A.finish_moments(A.merge_moments(halves[0].unionByName(halves[1]).withColumn("all", F.lit(1)), ["all"], ["x"]), ["all"], ["x"]).first()
    mean, error = two_pass([(x, w) for _, _, x, w in data])
    assert whole.sample_size == 800 and whole.x_se == pytest.approx(error, rel=1e-6)


def test_interval_needs_one_scan(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"), F.lit(2.0).alias("w"), (F.col("id") * 2.5).alias("y")).write.parquet(f"{tmp_path}/t")
    plan = A.weighted_mean_ci(spark.read.parquet(f"{tmp_path}/t"), ["k"], ["x", "y"], "w")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan and "Subquery" not in plan
