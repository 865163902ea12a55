"""Queries of the feature panel, model, recursion and explanation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..plans import compiled as K
from ..plans import models as M
from ..plans import panel as P
from ..plans import training as T
from ..session import materialize
from .base import BASE, GAPPED, GEO, customer_panel, gaps, query, rounded, sql, table
from .projecting import COVP, NAIVE, SCENARIO_CTES, SHARE, SHORT, covariates, rsql, scenario_frame
from .windowing import IMPUTE

NUMERIC = ["rate_lag1", "rate_lag2", "rate_rolling3", SHORT["rs"], SHORT["sl"], SHORT["ip"], "n_orders", "year_index", "post_break"]


def features(spark, sf_dir):
    return P.feature_panel(
        covariates(spark, sf_dir), "entity", "year", impute=["rate"], lagged=["rate", SHORT["rs"]], target="rate", stock="n_orders", break_year=1999
    )


def coefficients() -> dict[str, float]:
    """A fixed linear model, so that scores have an exact SQL twin."""
    return {"rate_lag1": 0.6, "rate_lag2": 0.2, SHORT["rs"]: 8.0, SHORT["sl"]: -0.02, "year_index": 0.05}


INTERCEPT = 12.0


def fixed_score(df, column):
    ready = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in coefficients()})
    return ready.withColumn(column, M.linear_score(coefficients(), INTERCEPT))


FEAT = """feat AS (SELECT *, lag(rate, 1) OVER (PARTITION BY entity ORDER BY year) AS rate_lag1, lag(rate, 2) OVER (PARTITION BY entity ORDER BY year) AS rate_lag2,
     year - (SELECT min(year) FROM covp) AS year_index FROM covp)"""
SCORE_SQL = "12.0 + 0.6 * coalesce(rate_lag1, 0) + 0.2 * coalesce(rate_lag2, 0) + 8.0 * rs - 0.02 * sl + 0.05 * year_index"


@query(
    "feature_panel",
    sql(
        """SELECT g.entity, g.year, i.f AS price_g, lag(i.f) OVER w AS price_g_lag1, avg(i.f) OVER (PARTITION BY g.entity ORDER BY g.year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS price_g_rolling3,
                  avg(i.f) OVER (PARTITION BY g.entity) AS history_mean_target, ln(first_value(n_orders) OVER w) AS log_stock_baseline, g.year - 1995 AS year_index,
                  CASE WHEN g.year >= 1999 THEN 1 ELSE 0 END AS post_break FROM gaps g JOIN imp i ON g.entity = i.entity AND g.year = i.year WINDOW w AS (PARTITION BY g.entity ORDER BY g.year)""",
        *GAPPED, IMPUTE, doubles="price_g price_g_lag1 price_g_rolling3 history_mean_target log_stock_baseline",
    ),
)
def feature_panel(spark, sf_dir):
    out = P.feature_panel(
        gaps(spark, sf_dir), "entity", "year", impute=["price_g"], lagged=["price_g"], target="price_g", stock="n_orders", break_year=1999
    )
    return rounded(
        out.select(
            "entity", "year", "price_g", "price_g_lag1", "price_g_rolling3", "history_mean_target", "log_stock_baseline", "year_index", "post_break"
        )
    )


@query(
    "column_profile",
    sql(
        """SELECT * FROM (VALUES ('entity', 'string', 'derived'), ('year', 'int', 'derived'), ('price_g', 'double', 'modelled value'),
             ('price_g_lag1', 'double', 'lagged feature'), ('price_g_imputed_flag', 'int', 'marks imputed rows')) v(column_name, dtype, description)
           JOIN (SELECT unnest(['entity', 'year', 'price_g', 'price_g_lag1', 'price_g_imputed_flag']) AS column_name,
                        unnest([count(entity), count(year), count(f), count(l), count(*)]) AS n_present FROM (SELECT *, lag(f) OVER (PARTITION BY entity ORDER BY year) AS l FROM imp)) USING (column_name)""",
        *GAPPED, IMPUTE,
    ),
)
def column_profile(spark, sf_dir):
    out = P.feature_panel(
        gaps(spark, sf_dir), "entity", "year", impute=["price_g"], lagged=["price_g"], target="price_g", stock="n_orders", break_year=1999
    )
    return M.column_profile(out.select("entity", "year", "price_g", "price_g_lag1", "price_g_imputed_flag"), {"price_g": "modelled value"})


@query(
    "stored_stats_transform",
    """WITH s AS (SELECT median(x) AS med FROM (SELECT CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS x FROM lineitem)),
            f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END, med) AS x FROM lineitem, s)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) + 0.0 AS x_std, 0.0::DOUBLE AS flat_std FROM f""",
)
def stored_stats_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("x"),
        F.lit(3.0).alias("flat"),
    )
    stats = M.fit_stats(rows, ["x", "flat"])
    new = M.apply_stats(stats)
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in new.items()]), 6)


@query(
    "batch_score",
    sql(f"SELECT entity, year, 'fixed_linear' AS model_name, CASE WHEN year >= 2001 THEN 'test' WHEN year = 2000 THEN 'validation' ELSE 'train' END AS split, rate AS actual, {SCORE_SQL} AS predicted FROM feat",
        GEO, BASE[1], COVP, FEAT, doubles="actual predicted", digits=6),
)
def batch_score(spark, sf_dir):
    rows = fixed_score(W.temporal_split(features(spark, sf_dir), "year"), "_p")
    return rounded(M.prediction_frame(rows, ["entity", "year"], "rate", "_p", "fixed_linear"), 6)


# The closed form of ridge in SQL: centred normal equations of the standardised numbers and the indicators, solved by Gauss-Jordan
# elimination, one unknown per step of a recursive CTE (the matrix is positive definite, so no pivot is sought).
RIDGE_X = ["rate_lag1", "rate_lag2", "rate_rolling3", "rs", "sl", "ip", "n_orders", "year_index", "post_break"]
RIDGE = (
    """full_rows AS (SELECT *, avg(rate) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rate_rolling3,
         CASE WHEN year >= 1999 THEN 1 ELSE 0 END AS post_break, CASE WHEN year >= 2001 THEN 'test' WHEN year = 2000 THEN 'validation' ELSE 'train' END AS split FROM feat)""",
    "middle AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in RIDGE_X) + " FROM full_rows WHERE split = 'train')",
    "filled AS (SELECT r.entity, r.region, r.year, r.split, r.rate, " + ", ".join(f"coalesce(r.{c}, m.{c})::DOUBLE AS {c}" for c in RIDGE_X) + " FROM full_rows r, middle m)",
    "moments AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in RIDGE_X) + ", avg(rate) AS y0, count(*) AS n FROM filled WHERE split = 'train')",
    "groups AS (SELECT list(DISTINCT entity ORDER BY entity) AS es, list(DISTINCT region ORDER BY region) AS gs FROM filled WHERE split = 'train')",
    "design AS (SELECT entity, region, year, split, rate, list_concat([" + ", ".join(f"({c} - m_{c}) / s_{c}" for c in RIDGE_X)
    + "], list_concat(list_transform(es, lambda e: (e = entity)::INT::DOUBLE), list_transform(gs, lambda g: (g = region)::INT::DOUBLE))) AS x FROM filled, moments, groups)",
    "cells AS (SELECT entity, year, rate, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM design WHERE split = 'train')",
    "centre AS (SELECT i, avg(v) AS c FROM cells GROUP BY i)",
    "gram AS (SELECT a.i, b.i AS j, sum((a.v - ca.c) * (b.v - cb.c)) + CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END AS q FROM cells a JOIN cells b ON a.entity = b.entity AND a.year = b.year"
    " JOIN centre ca ON ca.i = a.i JOIN centre cb ON cb.i = b.i GROUP BY a.i, b.i)",
    "side AS (SELECT i, sum((v - c) * (rate - y0)) AS q FROM cells JOIN centre USING (i), moments GROUP BY i)",
    "lines AS (SELECT g.i, list_append(list(g.q ORDER BY g.j), any_value(s.q)) AS line FROM gram g JOIN side s ON s.i = g.i GROUP BY g.i)",
    "solve(k, m) AS (SELECT 0, list(line ORDER BY i) FROM lines UNION ALL SELECT k + 1, list_transform(m, lambda line, i: list_transform(line, lambda v, j:"
    " CASE WHEN i = k + 1 THEN v / m[k + 1][k + 1] ELSE v - line[k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM solve WHERE k < len(m))",
    "weights AS (SELECT list_transform(m, lambda line: line[len(line)]) AS w FROM solve WHERE k = len(m))",
    "offset_of AS (SELECT list(c ORDER BY i) AS c FROM centre)",
    "ridge AS (SELECT entity, region, year, split, rate AS actual, y0 + list_sum(list_transform(x, lambda v, i: (v - c[i]) * w[i])) AS predicted FROM design, moments, weights, offset_of)",
)


@query(
    "ridge_model",
    rsql("SELECT entity, region, year, 'statistical_ridge' AS model_name, split, actual, predicted FROM ridge", GEO, BASE[1], COVP, FEAT, *RIDGE, doubles="actual predicted", digits=5),
)
def ridge_model(spark, sf_dir):
    rows = materialize(W.temporal_split(features(spark, sf_dir), "year"))
    model = M.fit_ridge(rows.filter("split = 'train'"), "rate", NUMERIC, ["entity", "region"])
    return rounded(M.prediction_frame(model.predict(rows, "_p"), ["entity", "region", "year"], "rate", "_p", model.name), 5)


def scored_twice(model, rows, ids, target):
    """Per split: rows, the target's spread, and how many rows the node table scores like the pipeline does.

    A model that does not beat the mean of the train rows on every split, or whose trees score otherwise in their
    relational form, is an error.
    """
    compiled = K.compile_model(model)
    by_join = K.descend_by_cell(rows, ids, compiled, "_q")
    both = K.compiled_predict(compiled, model.predict(rows, "_p"), "_r").join(by_join, ids)
    mean = rows.filter("split = 'train'").agg(F.avg(target)).scalar()
    same = lambda c: F.abs(F.col(c) - F.col("_p")) <= 1e-9 * F.abs("_p") + 1e-9
    square = lambda x: F.avg(F.pow(x - F.col(target), F.lit(2.0)))
    out = both.withColumn("_mean", mean).groupBy("split").agg(
        F.count("_p").alias("n"), F.stddev_pop(target).alias("spread"), F.count_if(same("_q")).alias("n_equal_by_join"),
        F.count_if(same("_r")).alias("n_equal_by_expression"), (square(F.col("_p")) < square(F.col("_mean"))).alias("_better"),
    )
    checked = F.when(F.col("_better"), F.lit(model.name)).otherwise(F.raise_error(F.concat(F.lit("no better than the mean on "), "split")))
    return out.select(checked.alias("model_name"), "split", "n", "spread", "n_equal_by_join", "n_equal_by_expression")


ROUNDS = 250
REVENUE_SPLITS = """WITH p AS (SELECT *, CASE WHEN year >= 2001 THEN 'test' WHEN year = 2000 THEN 'validation' ELSE 'train' END AS split FROM
              (SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY 1, 2))"""
REVENUE_INPUTS = ["revenue_lag1", "revenue_lag2", "revenue_rolling3", "n_orders", "n_orders_lag1", "year"]


def revenue_rows(spark, sf_dir):
    p = W.lag_features(customer_panel(spark, sf_dir), ["revenue", "n_orders"], "customer", "year")
    return materialize(W.temporal_split(p, "year"))


@query(
    "gbt_model",
    f"""{REVENUE_SPLITS}
       SELECT 'tree_gradient_boosting' AS model_name, split, count(*) AS n, round(stddev_pop(revenue), 4) + 0.0 AS spread, count(revenue) AS n_equal_by_join,
              count(revenue) AS n_equal_by_expression, 250 AS rounds FROM p GROUP BY split""",
)
def gbt_model(spark, sf_dir):
    """Customer x year revenue from its own lags and order counts by 250 rounds; ``boosted_node_table`` is trained in SQL too.

    The loss of the train rows must fall over every fifth of the rounds, and the error be below that of the train mean.
    """
    rows = revenue_rows(spark, sf_dir)
    train = rows.filter("split = 'train'")
    model = M.fit_boosted_trees(train, "revenue", REVENUE_INPUTS, rounds=ROUNDS)
    losses = M.boosting_losses(model, train, "revenue")
    if not all(a > b for a, b in zip(losses[:: ROUNDS // 5], losses[ROUNDS // 5 :: ROUNDS // 5])):
        raise ArithmeticError("the train loss does not fall")
    return rounded(scored_twice(model, rows, ["customer", "year"], "revenue").withColumn("rounds", F.lit(len(losses))))


@query(
    "random_forest_model",
    f"""{REVENUE_SPLITS}
       SELECT 'tree_random_forest' AS model_name, split, count(*) AS n, round(stddev_pop(revenue), 4) + 0.0 AS spread, count(revenue) AS n_equal_by_join,
              count(revenue) AS n_equal_by_expression, 100 AS trees FROM p GROUP BY split""",
)
def random_forest_model(spark, sf_dir):
    """As ``gbt_model``, with a forest of 100 trees."""
    rows = revenue_rows(spark, sf_dir)
    model = M.fit_random_forest(rows.filter("split = 'train'"), "revenue", REVENUE_INPUTS)
    out = scored_twice(model, rows, ["customer", "year"], "revenue")
    return rounded(out.withColumn("trees", F.lit(model.pipeline.stages[-1].getNumTrees)))


# The twin trains the same trees: least squares on the residuals, splits at the middle between neighbouring values that occur in
# the train rows, four rows at least in a child, and scores every row with them.
BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE, BOOST_LEAF = 6, 2, 0.3, 4
BOOST_X = ["n_orders", "year", "nation"]


def boost_sql() -> str:
    ctes = [
        """p0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS f, CASE WHEN year >= 2001 THEN 'test' WHEN year = 2000 THEN 'validation' ELSE 'train' END AS split FROM
          (SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders, any_value(c_nationkey) AS nation,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))""",
        f"""cuts AS MATERIALIZED (SELECT feature, v, (v + lead(v) OVER (PARTITION BY feature ORDER BY v)) / 2.0 AS cut FROM
          (SELECT DISTINCT unnest(range({len(BOOST_X)})) AS feature, unnest([{', '.join(f'{x}::BIGINT' for x in BOOST_X)}]) AS v FROM p0 WHERE split = 'train'))""",
    ]
    for r in range(BOOST_ROUNDS):
        ctes.append(f"t{r}_0 AS MATERIALIZED (SELECT *, 0 AS node, {'y' if r == 0 else '2 * (y - f)'} AS t FROM p{r})")
        for level in range(BOOST_DEPTH):
            ctes.append(
                f"""b{r}_{level} AS MATERIALIZED (SELECT node, feature, cut FROM (SELECT c.node, c.feature, k.cut, row_number() OVER (PARTITION BY c.node ORDER BY
                     c.s * c.s / c.n + (c.sa - c.s) * (c.sa - c.s) / (c.na - c.n) DESC, c.feature, k.cut) AS place FROM
                  (SELECT node, feature, v, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER a AS na, sum(s) OVER a AS sa FROM
                    (SELECT node, feature, v, count(*) AS n, sum(t) AS s FROM
                      (SELECT node, t, unnest(range({len(BOOST_X)})) AS feature, unnest([{', '.join(f'{x}::BIGINT' for x in BOOST_X)}]) AS v FROM t{r}_{level} WHERE split = 'train') GROUP BY ALL)
                   WINDOW w AS (PARTITION BY node, feature ORDER BY v), a AS (PARTITION BY node, feature)) c
                  JOIN cuts k ON k.feature = c.feature AND k.v = c.v WHERE c.n >= {BOOST_LEAF} AND c.na - c.n >= {BOOST_LEAF}) WHERE place = 1)"""
            )
            ctes.append(
                f"""t{r}_{level + 1} AS MATERIALIZED (SELECT t.* REPLACE (CASE WHEN b.node IS NULL THEN -t.node ELSE 2 * t.node + 1 +
                     ([{', '.join(f't.{x}' for x in BOOST_X)}][b.feature + 1] > b.cut)::INT END AS node) FROM t{r}_{level} t LEFT JOIN b{r}_{level} b ON b.node = t.node)"""
            )
        last = f"t{r}_{BOOST_DEPTH}"
        ctes.append(f"v{r} AS MATERIALIZED (SELECT node, avg(t) AS value FROM {last} WHERE split = 'train' GROUP BY node)")
        ctes.append(
            f"p{r + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (node, t) REPLACE (t.f + {1.0 if r == 0 else BOOST_RATE} * v.value AS f) FROM {last} t JOIN v{r} v ON v.node = t.node)"
        )
    body = f"SELECT customer, year, split, f AS by_join, f AS by_expression FROM p{BOOST_ROUNDS}"
    return sql(body, *ctes, doubles="by_join by_expression", digits=5)


@query("boosted_node_table", boost_sql())
def boosted_node_table(spark, sf_dir):
    """A boosted ensemble on customer x year rows, scored row by row from its node table; SQL trains and scores the same trees."""
    home = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"))
    rows = customer_panel(spark, sf_dir).withColumn("y", F.col("revenue") / 1000).join(home, "customer")
    rows = materialize(W.temporal_split(rows, "year").select("customer", "year", "split", "n_orders", "nation", "y"))
    train = rows.filter("split = 'train'")
    model = M.fit_boosted_trees(train, "y", BOOST_X, rounds=BOOST_ROUNDS, depth=BOOST_DEPTH, rate=BOOST_RATE, leaf=BOOST_LEAF)
    compiled = K.compile_model(model)
    by_join = K.descend(rows, ["customer", "year"], compiled, "by_join")
    both = K.compiled_predict(compiled, rows, "by_expression").join(by_join, ["customer", "year"])
    return rounded(both.select("customer", "year", "split", "by_join", "by_expression"), 5)


@query(
    "feature_columns",
    sql(
        """SELECT 'price_g' AS column_name, 'numeric' AS kind FROM gaps HAVING count(price_g) > 0 UNION ALL SELECT 'n_orders', 'numeric' FROM gaps HAVING count(n_orders) > 0
           UNION ALL SELECT 'nothing', 'numeric' FROM gaps HAVING count(NULL) > 0 UNION ALL SELECT 'region', 'categorical' FROM gaps HAVING count(*) > 0""",
        *GAPPED,
    ),
)
def feature_columns(spark, sf_dir):
    """Numeric candidates with a value: not the text, the absent or the empty column."""
    rows = gaps(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    numeric, categorical = M.feature_columns(rows, ["price_g", "n_orders", "nothing", "entity_name", "absent", "price_g"], ["region", "absent"])
    found = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical]
    return spark.createDataFrame(found, "column_name string, kind string")


START = """start AS (SELECT entity, arg_max(rate, year) AS y1, max(rate) FILTER (WHERE k = 2) AS y2, max(rate) FILTER (WHERE k = 3) AS y3, min(year) AS first_year, greatest(max(year), 2000) AS last_year, sum(rate) AS total, count(rate) AS n FROM
     (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k FROM covp) GROUP BY entity)"""


def ridge_term(i: int, column: str, value: str) -> str:
    return f"((coalesce({value}, md.{column}) - mo.m_{column}) / mo.s_{column} - oc.c[{i}]) * wt.w[{i}]"


AHEAD = {"rs": "c.rs", "sl": "c.sl", "ip": "c.ip", "n_orders": "c.n_orders", "year_index": "c.year - s.first_year", "post_break": "1"}
RIDGE_AHEAD = (
    START,
    "given AS (SELECT c.entity, c.scenario_name, c.year, mo.y0 + "
    + " + ".join(ridge_term(RIDGE_X.index(c) + 1, c, v) for c, v in AHEAD.items())
    + f" + list_sum(list_transform(range(1, len(gr.es) + 1), lambda k: ((gr.es[k] = c.entity)::INT - oc.c[{len(RIDGE_X)} + k]) * wt.w[{len(RIDGE_X)} + k]))"
    + f" + list_sum(list_transform(range(1, len(gr.gs) + 1), lambda k: ((gr.gs[k] = c.region)::INT - oc.c[{len(RIDGE_X)} + len(gr.es) + k]) * wt.w[{len(RIDGE_X)} + len(gr.es) + k]))"
    + " AS base FROM cov c JOIN start s ON s.entity = c.entity, moments mo, middle md, weights wt, offset_of oc, groups gr)",
    "fr(entity, scenario_name, year, p, y2, y3) AS (SELECT g.entity, g.scenario_name, s.last_year, s.y1, s.y2, s.y3 FROM (SELECT DISTINCT entity, scenario_name FROM cov) g JOIN start s ON g.entity = s.entity"
    " UNION ALL SELECT f.entity, f.scenario_name, g.year, least(greatest(g.base + "
    + " + ".join(ridge_term(i, c, v) for i, (c, v) in enumerate({"rate_lag1": "f.p", "rate_lag2": "f.y2", "rate_rolling3": "(f.p + f.y2 + f.y3) / 3"}.items(), start=1))
    + ", 5), 150), f.p, f.y2 FROM fr f JOIN given g ON g.entity = f.entity AND g.scenario_name = f.scenario_name AND g.year = f.year + 1, moments mo, middle md, weights wt, offset_of oc)",
    "ahead AS (SELECT f.entity, f.scenario_name, CAST(f.year AS INTEGER) AS year, f.p AS predicted FROM fr f JOIN start s ON s.entity = f.entity WHERE f.year > s.last_year)",
)


def future_covariates(cov):
    return cov.withColumn("post_break", F.lit(1)).select("entity", "region", "scenario_name", "year", "n_orders", "post_break", *SHORT.values())


@query(
    "fitted_recursive_forecast",
    rsql("SELECT entity, scenario_name, year, predicted FROM ahead", *SCENARIO_CTES, FEAT, *RIDGE, *RIDGE_AHEAD, doubles="predicted", digits=5),
)
def fitted_recursive_forecast(spark, sf_dir):
    """A ridge fitted to the panel, compiled, folded over 36 years in one plan; SQL fits it and recurs over the years."""
    _, cov = scenario_frame(spark, sf_dir)
    rows = materialize(W.temporal_split(features(spark, sf_dir), "year"))
    model = K.compile_model(M.fit_ridge(rows.filter("split = 'train'"), "rate", NUMERIC, ["entity", "region"]))
    out = K.compiled_forecast(model, rows, future_covariates(cov), entity="entity", path=["scenario_name"], year="year", target="rate")
    return rounded(out.withColumn("year", F.col("year").cast("int")), 5)


NAIVE_SPLITS = """scored AS (
    SELECT 'baseline_last_observed' AS model_name, split, rate, rate_lag1 AS p FROM full_rows UNION ALL
    SELECT 'baseline_recent_trend', split, rate, rate_lag1 + coalesce(rate_lag1 - rate_lag2, 0) FROM full_rows UNION ALL
    SELECT 'statistical_ridge', split, actual, predicted FROM ridge)"""


def checked_errors(predictions, fitted):
    """Per model and split: rows, error and mean prediction. What no data excuse is an error.

    Boosting by least squares never leaves the train rows further off than their own mean does, and a closed loop keeps
    its bounds. How far off later years are depends on the data: noise makes it larger than the target's spread.
    """
    gap = F.pow(F.col("predicted") - F.col("actual"), F.lit(2.0))
    trees, ahead = F.col("model_name") == "tree_gradient_boosting", F.col("split") == "forecast"
    out = predictions.groupBy("model_name", "split").agg(
        F.count("predicted").alias("n"), F.sqrt(F.avg(gap)).alias("_rmse"), F.avg("predicted").alias("_mean"), F.stddev_pop("actual").alias("_spread"),
        F.min("predicted").alias("_low"), F.max("predicted").alias("_high"), F.count_distinct(F.round("predicted", 6)).alias("_paths"),
    )
    within = F.col("_low").between(5, 150) & F.col("_high").between(5, 150) & (F.col("_paths") > 1)
    close = F.col("_rmse") <= F.col("_spread") * (1 + 1e-9) + 1e-9
    sound = F.when(ahead & F.col("model_name").isin(*fitted), within).when(trees & (F.col("split") == "train"), close).otherwise(F.lit(True))
    checked = F.when(sound, F.col("model_name")).otherwise(F.raise_error(F.format_string("%s is not sound on %s: error %s, spread %s", "model_name", "split", "_rmse", "_spread")))
    return out.select(checked.alias("model_name"), "split", "n", F.when(~trees & ~ahead, F.col("_rmse")).alias("rmse"), F.when(ahead & ~trees, F.col("_mean")).alias("mean_forecast"))


@query(
    "train_score_all",
    rsql(
        """SELECT model_name, split, count(p) AS n, sqrt(avg(pow(p - rate, 2))) AS rmse, NULL::DOUBLE AS mean_forecast FROM scored GROUP BY model_name, split
           UNION ALL SELECT 'tree_gradient_boosting', split, count(*), NULL, NULL FROM full_rows GROUP BY split
           UNION ALL SELECT model, 'forecast', count(*), NULL, avg(predicted) FROM naive GROUP BY model
           UNION ALL SELECT 'statistical_ridge', 'forecast', count(*), NULL, avg(predicted) FROM ahead
           UNION ALL SELECT 'tree_gradient_boosting', 'forecast', count(*), NULL, NULL FROM ahead""",
        *SCENARIO_CTES, NAIVE, FEAT, *RIDGE, *RIDGE_AHEAD, NAIVE_SPLITS, doubles="rmse mean_forecast",
    ),
)
def train_score_all(spark, sf_dir):
    """Errors of baselines and ridge per split, and forecasts of every model and scenario for 36 years.

    It is an error if the trees are further off the train rows than their mean, or if a fitted model's forecasts leave their
    bounds or are the same in all scenarios.
    """
    _, cov = scenario_frame(spark, sf_dir)
    models, predictions, _ = T.train_score_all(
        features(spark, sf_dir), ids=["entity", "region", "year"], entity="entity", region="region", year="year", target="rate",
        numeric=NUMERIC, categorical=["entity", "region"], rounds=ROUNDS, split_year=1999, future=future_covariates(cov), path=["scenario_name"],
    )
    return rounded(checked_errors(predictions, models))


LAGS, ROLLING = [0.5, 0.2, 0.1], 0.15


def exogenous():
    return F.lit(2.0) + F.lit(6.0) * F.col(SHARE) + F.lit(-0.01) * F.col(SHORT["sl"])


RECURSE = START


def recurse_sql(score: str, extra: str = "", step: str = "") -> str:
    return f"""fc(entity, scenario_name, year, p, y1, y2, y3{extra}) AS (
      SELECT c.entity, c.scenario_name, s.last_year, s.y1, s.y1, s.y2, s.y3{step.split('||')[0] if step else ''} FROM (SELECT DISTINCT entity, scenario_name FROM cov) c JOIN start s ON c.entity = s.entity
      UNION ALL
      SELECT f.entity, f.scenario_name, c.year, {score}, {score}, f.y1, f.y2{step.split('||')[1] if step else ''}
      FROM fc f JOIN cov c ON c.entity = f.entity AND c.scenario_name = f.scenario_name AND c.year = f.year + 1)"""


LINEAR_STEP = "least(greatest(2.0 + 6.0 * c.rs - 0.01 * c.sl + 0.5 * f.y1 + 0.2 * f.y2 + 0.1 * f.y3 + 0.15 * (f.y1 + f.y2 + f.y3) / 3, 5), 150)"


@query(
    "linear_recursive_forecast",
    rsql("SELECT entity, scenario_name, CAST(year AS INTEGER) AS year, p AS predicted FROM fc JOIN (SELECT entity AS e, last_year FROM start) ON e = entity WHERE year > last_year", *SCENARIO_CTES, RECURSE, recurse_sql(LINEAR_STEP), doubles="predicted", digits=6),
)
def linear_recursive_forecast(spark, sf_dir):
    p, cov = scenario_frame(spark, sf_dir)
    out = M.linear_recursive_forecast(
        p, cov, entity="entity", path=["scenario_name"], year="year", target="rate", lags=LAGS, rolling=ROLLING, exogenous=exogenous()
    )
    return rounded(out, 6)


ANY_STEP = "least(greatest(12.0 + 0.6 * f.y1 + 0.2 * f.y2 + 8.0 * c.rs - 0.02 * c.sl + 0.05 * (c.year - f.first_year), 5), 150)"


@query(
    "recursive_model_forecast",
    rsql(
        "SELECT entity, scenario_name, CAST(year AS INTEGER) AS year, p AS predicted FROM fc JOIN (SELECT entity AS e, last_year FROM start) ON e = entity WHERE year > last_year", *SCENARIO_CTES, RECURSE,
        recurse_sql(ANY_STEP, ", first_year", ", s.first_year||, f.first_year"), doubles="predicted", digits=6,
    ),
)
def recursive_model_forecast(spark, sf_dir):
    """Year by year with a scorer that could be any model; here linear, so that SQL can follow it."""
    p, cov = scenario_frame(spark, sf_dir)
    future = cov.select("entity", "scenario_name", "year", *SHORT.values())
    out = M.recursive_forecast(fixed_score, p, future, entity="entity", path=["scenario_name"], year="year", target="rate", exogenous_lags=[SHORT["sl"]])
    return rounded(out, 6)


COLUMN = {"rate_lag1": "rate_lag1", "rate_lag2": "rate_lag2", SHORT["rs"]: "rs", SHORT["sl"]: "sl", "year_index": "year_index"}
PERMUTED = list(coefficients())
SCORE_TERMS = " + ".join(
    f"{w} * coalesce(CASE WHEN f.feature = '{name}' THEN sh.v ELSE b.{COLUMN[name]} END, 0)" for name, w in coefficients().items()
)
OWN_VALUE = "CASE feature " + " ".join(f"WHEN '{name}' THEN {column}::DOUBLE" for name, column in COLUMN.items()) + " END"


@query(
    "permutation_importance",
    sql(
        f"""SELECT feature, sqrt(avg(pow(p - rate, 2))) - (SELECT sqrt(avg(pow({SCORE_SQL} - rate, 2))) FROM ids) AS importance_value, 'permutation_rmse_delta' AS importance_type FROM (
            SELECT f.feature, b.rate, 12.0 + {SCORE_TERMS} AS p
            FROM (SELECT *, row_number() OVER (ORDER BY id) AS place FROM ids) b, (SELECT unnest({PERMUTED}) AS feature) f
            JOIN (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY h) AS place FROM (
              SELECT feature, {OWN_VALUE} AS v,
                     CAST('0x' || substr(md5(feature || '|' || id || '|42'), 1, 13) AS BIGINT) AS h FROM ids, (SELECT unnest({PERMUTED}) AS feature))) sh
              ON sh.feature = f.feature AND sh.place = b.place) GROUP BY feature""",
        GEO, BASE[1], COVP, FEAT, "ids AS (SELECT *, nk * 10000 + year AS id FROM feat WHERE year >= 2001)", doubles="importance_value", digits=6,
    ),
)
def permutation_importance(spark, sf_dir):
    """Every feature of the scored model, on the rows of the test split."""
    rows = W.temporal_split(features(spark, sf_dir), "year").filter("split = 'test'")
    rows = materialize(rows.withColumn("id", F.col("nk") * 10000 + F.col("year")))
    return rounded(M.permutation_importance(rows, fixed_score, PERMUTED, "rate", "id"), 6)


def lp_sql() -> str:
    parts = []
    for i, (f, c) in enumerate(COLUMN.items()):
        x = f"({SCORE_SQL}) - ({SCORE_SQL.replace(c, f'(SELECT median({c}) FROM feat)')})"
        family = "state_trend_history" if f == "year_index" else "other"
        bucket = f[-1] if "_lag" in f else "current"
        parts.append(
            f"SELECT entity, year, region, entity_name, {SCORE_SQL} AS predicted, '{f}' AS feature, '{family}' AS feature_family, '{bucket}' AS temporal_bucket, {i} AS o, {x} AS contribution FROM feat"
        )
    return " UNION ALL ".join(parts)


@query(
    "local_perturbation",
    sql(
        """SELECT entity, year, 'fixed_linear' AS model_name, predicted, feature, feature_family, temporal_bucket, contribution,
               CASE WHEN contribution >= 0 THEN 'positive' ELSE 'negative' END AS direction, CAST(row_number() OVER (PARTITION BY entity, year ORDER BY abs(contribution) DESC, o) AS INTEGER) AS importance_rank,
               entity_name || ' ' || year || ': ' || feature_family || CASE WHEN contribution >= 0 THEN ' raises' ELSE ' lowers' END || ' the projected rate by about ' || printf('%.2f', abs(contribution)) || '.' AS plain_english FROM lp""",
        GEO, BASE[1], COVP, FEAT, f"lp AS ({lp_sql()})", doubles="predicted contribution", digits=6,
    ),
)
def local_perturbation(spark, sf_dir):
    rows = materialize(features(spark, sf_dir))
    out = M.local_perturbation(
        rows, rows, fixed_score, PERMUTED, ["entity", "year"], name="fixed_linear", place="entity_name", year="year"
    )
    return rounded(out, 6)
