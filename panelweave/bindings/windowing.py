"""Queries of the ordered operators, sorting, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import ranking as R
from ..operators import sets as S
from ..operators import windows as W
from ..plans import panel as P
from ..plans import specs
from ..session import materialize
from .base import (
    BASE, CUSTOMERS, GAPPED, GEO, customer_panel, gaps, panel, query, rounded, sql, table,
)
from .joining import EVENTS, SCENARIO_ROWS, priority_rows, yearly_events

CW = "OVER (PARTITION BY customer ORDER BY year)"


def z_sql(x: str, part: str = "PARTITION BY year") -> str:
    return (
        f"CASE WHEN stddev_pop({x}) OVER ({part}) = 0 THEN 0.0 ELSE ({x} - avg({x}) OVER ({part})) / stddev_pop({x}) OVER ({part}) END"
    )


@query(
    "zscore_by_period",
    sql(
        f"SELECT customer, year, {z_sql('revenue')} AS revenue_z, {z_sql('flat')} AS flat_z FROM (SELECT *, CASE WHEN customer % 2 = 0 THEN 1.0::DOUBLE END AS flat FROM customer_panel)",
        CUSTOMERS, doubles="revenue_z flat_z",
    ),
)
def zscore_by_period(spark, sf_dir):
    rows = customer_panel(spark, sf_dir).withColumn("flat", F.when(F.col("customer") % 2 == 0, F.lit(1.0)))
    out = W.zscore_by_period(rows, {"revenue": "revenue_z", "flat": "flat_z"}, "year")
    return rounded(out.select("customer", "year", "revenue_z", "flat_z"))


@query(
    "zscore_or_zero",
    sql(
        f"SELECT entity, year, {z_sql('price_g')} AS price_z, 0.0::DOUBLE AS absent_z, 0.0::DOUBLE AS empty_z FROM gaps",
        *GAPPED, doubles="price_z",
    ),
)
def zscore_or_zero(spark, sf_dir):
    out = materialize(gaps(spark, sf_dir)).withColumn("empty", F.lit(None).cast("double"))
    for column, name in [("price_g", "price_z"), ("absent", "absent_z"), ("empty", "empty_z")]:
        out = W.zscore_or_zero(out, column, "year", name)
    return rounded(out.select("entity", "year", "price_z", "absent_z", "empty_z"))


# panel columns in the roles of the index components
ROLES = {
    "price_g": "remote_work_share_state_year",
    "balance_g": "work_at_home_minutes_state_year",
    "share_g": "screen_leisure_minutes_broad_state_year",
    "open_share": "in_person_social_minutes_state_year",
    "low_share": "search_interest_online_dating_state_year",
    "urgent_share": "care_burden_minutes_state_year",
    "balance": "mean_commute_minutes_state_year",
}


def role_panel(spark, sf_dir):
    g = gaps(spark, sf_dir)
    return g.select(
        "entity", "entity_name", "region", "nk", "year", "n_orders", "price", *[F.col(c).alias(r) for c, r in ROLES.items()],
    ).withColumns(
        {
            "remote_work_share_state_year_status": F.when(F.col("remote_work_share_state_year").isNotNull(), "observed").otherwise("missing"),
            "work_at_home_minutes_state_year_status": F.when(F.col("work_at_home_minutes_state_year").isNotNull(), "imputed").otherwise("modeled"),
        }
    )


def index_sql(parts: list[tuple[str, float]]) -> str:
    """Weighted mean of z-scores over the panel column of each role."""
    column = {r: c for c, r in ROLES.items()}
    used = [(column[c], w) for c, w in parts if c in column]
    top = " + ".join(f"coalesce({z_sql(c)}, 0) * {w}" for c, w in used)
    return f"({top}) / {sum(w for _, w in used)}" if used else "CAST(NULL AS DOUBLE)"


INDEX_SELECT = ", ".join(f"{index_sql(p)} AS {i}" for i, p in specs.INDEX_COMPONENTS.items())
MODE_SQL = """CASE WHEN price_g IS NOT NULL THEN 'observed' WHEN balance_g IS NOT NULL THEN 'imputed' ELSE 'modeled' END"""


@query(
    "composite_index",
    sql(
        f"""SELECT entity, year, {INDEX_SELECT}, {MODE_SQL} AS remote_work_exposure_index_mode,
              'remote_work_share_state_year, work_at_home_minutes_state_year' AS remote_work_exposure_index_components,
              'missing' AS digital_access_index_mode, '' AS digital_access_index_components, 'modeled' AS digital_distraction_index_mode FROM gaps""",
        *GAPPED, doubles=" ".join(specs.EXPOSURE_INDICES),
    ),
)
def composite_index(spark, sf_dir):
    required = {**{i: "double" for i in specs.EXPOSURE_INDICES}}
    out = P.exposure_panel(materialize(role_panel(spark, sf_dir)), "year", required)
    return rounded(
        out.select(
            "entity", "year", *specs.EXPOSURE_INDICES, "remote_work_exposure_index_mode", "remote_work_exposure_index_components",
            "digital_access_index_mode", "digital_access_index_components", "digital_distraction_index_mode",
        )
    )


@query(
    "status_precedence",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' OR l_linestatus = 'O' THEN 'observed'
              WHEN l_returnflag = 'R' THEN 'imputed' WHEN l_quantity > 25 THEN 'modeled' ELSE 'missing' END AS status FROM lineitem""",
)
def status_precedence(spark, sf_dir):
    a = C.recode("l_returnflag", {"A": "observed", "R": "imputed"})
    b = C.recode("l_linestatus", {"O": "observed"})
    c = F.when(F.col("l_quantity") > 25, "modeled").otherwise("unheard of")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", W.status_precedence([a, b, c]).alias("status")
    )


@query(
    "lag_features",
    sql(
        f"SELECT customer, year, lag(revenue, 1) {CW} AS revenue_lag1, lag(revenue, 2) {CW} AS revenue_lag2, lag(revenue, 3) {CW} AS revenue_lag3 FROM customer_panel",
        CUSTOMERS, doubles="revenue_lag1 revenue_lag2 revenue_lag3",
    ),
)
def lag_features(spark, sf_dir):
    out = W.lag_features(customer_panel(spark, sf_dir), ["revenue"], "customer", "year", rolling=None)
    return rounded(out.drop("n_orders", "revenue"))


@query(
    "rolling_prior_mean",
    sql(
        "SELECT customer, year, avg(revenue) OVER (PARTITION BY customer ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS revenue_rolling3 FROM customer_panel",
        CUSTOMERS, doubles="revenue_rolling3", digits=3,
    ),
)
def rolling_prior_mean(spark, sf_dir):
    out = W.lag_features(customer_panel(spark, sf_dir), ["revenue"], "customer", "year", lags=())
    return rounded(out.select("customer", "year", "revenue_rolling3"), 3)


@query(
    "centered_rolling_mean",
    sql(
        """SELECT entity, year, avg(price_g) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS price_g_pooled,
                  n_orders < 85 AS is_pooled_estimate FROM gaps""",
        *GAPPED, doubles="price_g_pooled",
    ),
)
def centered_rolling_mean(spark, sf_dir):
    out = W.centered_mean(gaps(spark, sf_dir), ["price_g"], "entity", "year", size="n_orders", threshold=85)
    return rounded(out.select("entity", "year", "price_g_pooled", "is_pooled_estimate"))


@query(
    "growth_rate",
    sql(
        """SELECT entity, year, f / nullif(lag(f) OVER (PARTITION BY entity ORDER BY year), 0) - 1 AS growth FROM
           (SELECT *, last_value(price_g IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM gaps)""",
        *GAPPED, doubles="growth", digits=6,
    ),
)
def growth_rate(spark, sf_dir):
    return rounded(W.growth_rate(gaps(spark, sf_dir), "price_g", "entity", "year", "growth").select("entity", "year", "growth"), 6)


@query(
    "group_mean_broadcast",
    sql("SELECT customer, year, avg(revenue) OVER (PARTITION BY customer) AS history_mean, avg(n_orders) OVER (PARTITION BY year) AS year_mean FROM customer_panel",
        CUSTOMERS, doubles="history_mean year_mean", digits=7),
)
def group_mean_broadcast(spark, sf_dir):
    out = W.group_mean(customer_panel(spark, sf_dir), "revenue", ["customer"], "history_mean", bounded=True)
    return rounded(W.group_mean(out, "n_orders", ["year"], "year_mean").drop("n_orders", "revenue"), 7)


@query(
    "first_value_log",
    sql(
        """SELECT entity, year, ln(nullif(first_value(price_g IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)) AS log_first
           FROM gaps""",
        *GAPPED, doubles="log_first", digits=6,
    ),
)
def first_value_log(spark, sf_dir):
    return rounded(W.first_value_log(gaps(spark, sf_dir), "price_g", "entity", "year", "log_first").select("entity", "year", "log_first"), 6)


def both_ways(x: str) -> str:
    return (
        f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({x} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


@query("ffill_bfill", sql(f"SELECT entity, year, {both_ways('price_g')} AS price_g, {both_ways('share_g')} AS share_g FROM gaps", *GAPPED, doubles="price_g share_g"))
def ffill_bfill(spark, sf_dir):
    out = W.ffill_bfill(gaps(spark, sf_dir), ["price_g", "share_g"], "entity", "year")
    return rounded(out.select("entity", "year", "price_g", "share_g"))


@query(
    "group_series_fill",
    sql(
        """SELECT entity, year, coalesce(last_value(price_g IGNORE NULLS) OVER (PARTITION BY region ORDER BY entity, year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              first_value(price_g IGNORE NULLS) OVER (PARTITION BY region ORDER BY entity, year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price_g
           FROM gaps""",
        *GAPPED, doubles="price_g",
    ),
)
def group_series_fill(spark, sf_dir):
    out = W.group_series_fill(materialize(gaps(spark, sf_dir)), "price_g", "region", "entity", "year")
    return rounded(out.select("entity", "year", "price_g"))


IMPUTE = """rn AS (SELECT entity, year, nk, region, price_g, balance_g, share_g, n_orders, row_number() OVER (PARTITION BY entity ORDER BY year) AS r FROM gaps),
  nb AS (SELECT a.entity, a.year, a.r, a.price_g AS x,
           (SELECT max(b.r) FROM rn b WHERE b.entity = a.entity AND b.r < a.r AND b.price_g IS NOT NULL) AS pr,
           (SELECT min(b.r) FROM rn b WHERE b.entity = a.entity AND b.r > a.r AND b.price_g IS NOT NULL) AS nr FROM rn a),
  vv AS (SELECT nb.*, p.price_g AS pv, q.price_g AS qv FROM nb LEFT JOIN rn p ON p.entity = nb.entity AND p.r = nb.pr
         LEFT JOIN rn q ON q.entity = nb.entity AND q.r = nb.nr),
  imp AS (SELECT entity, year, x, CASE WHEN x IS NOT NULL THEN x WHEN pr IS NULL THEN NULL
           WHEN nr IS NULL THEN CASE WHEN r - pr <= 2 THEN pv END
           WHEN r - pr <= 4 THEN pv + (qv - pv) * least(r - pr, 2) / (nr - pr) END AS f FROM vv)"""


@query(
    "impute_short_gaps",
    sql(
        """SELECT entity, year, f AS price_g, CASE WHEN x IS NULL AND f IS NOT NULL THEN 1 ELSE 0 END AS price_g_imputed_flag,
                  CASE WHEN x IS NULL AND f IS NULL THEN 1 ELSE 0 END AS price_g_long_gap_flag FROM imp""",
        *GAPPED, IMPUTE, doubles="price_g",
    ),
)
def impute_short_gaps(spark, sf_dir):
    out = W.impute_short_gaps(gaps(spark, sf_dir), ["price_g"], "entity", "year")
    return rounded(out.select("entity", "year", "price_g", "price_g_imputed_flag", "price_g_long_gap_flag"))


@query(
    "recent_tail_mean",
    sql(
        """SELECT entity, avg(price_g) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k FROM gaps WHERE price_g IS NOT NULL)
           WHERE k <= 3 GROUP BY entity""",
        *GAPPED, doubles="recent",
    ),
)
def recent_tail_mean(spark, sf_dir):
    return rounded(W.recent_mean(gaps(spark, sf_dir), "price_g", "entity", "year", 3, "recent"))


@query(
    "fallback_quality_cascade",
    sql(
        """SELECT g.entity, g.year, greatest(coalesce(price_g, t.recent, CASE WHEN region <> 'AFRICA' THEN rp END, 25.0), 150000) AS price_g,
                  CASE WHEN price_g > 0 THEN 'observed' WHEN t.recent IS NOT NULL THEN 'entity_smoothed'
                       WHEN region <> 'AFRICA' AND rp IS NOT NULL THEN 'region_fallback' ELSE 'national_fallback' END AS price_g_quality
           FROM (SELECT *, avg(price_g) OVER (PARTITION BY region, year) AS rp FROM gaps) g
           LEFT JOIN (SELECT entity, avg(price_g) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k FROM gaps WHERE price_g IS NOT NULL)
             WHERE k <= 3 GROUP BY entity) t ON g.entity = t.entity""",
        *GAPPED, doubles="price_g",
    ),
)
def fallback_quality_cascade(spark, sf_dir):
    g = materialize(gaps(spark, sf_dir))
    g = W.attach_group_stats(g, ["region", "year"], {"rp": F.avg("price_g")})
    g = g.withColumn("proxy", F.when(F.col("region") != "AFRICA", F.col("rp")))
    out = W.quality_cascade(g, "price_g", "entity", "year", fallback="proxy", constant=25.0, floor=150000)
    return rounded(out.select("entity", "year", "price_g", "price_g_quality"))


FILL_SQL = f"""f0 AS (SELECT entity, year, CASE WHEN region <> 'EUROPE' THEN region END AS region, CASE WHEN year <> 1999 OR region = 'ASIA' THEN price_g END AS x FROM gaps
                   WHERE true),
  f1 AS (SELECT entity, year, region, {both_ways('x')} AS x FROM f0),
  f2 AS (SELECT entity, year, region, coalesce(x, CASE WHEN region IS NOT NULL THEN avg(x) OVER (PARTITION BY region, year) END) AS x FROM f1),
  f3 AS (SELECT entity, year, region, coalesce(x, avg(x) OVER (PARTITION BY year)) AS x FROM f2),
  f4 AS (SELECT entity, year, region, coalesce(x, avg(x) OVER ()) AS x FROM f3)"""


@query("fill_cascade", sql("SELECT entity, year, coalesce(x, 25.0) AS x, 25.0::DOUBLE AS y FROM f4", *GAPPED, FILL_SQL, doubles="x"))
def fill_cascade(spark, sf_dir):
    g = materialize(gaps(spark, sf_dir)).select(
        "entity", "year", F.when(F.col("region") != "EUROPE", F.col("region")).alias("region"),
        F.when((F.col("year") != 1999) | (F.col("region") == "ASIA"), F.col("price_g")).alias("x"),
        F.lit(None).cast("double").alias("y"),
    )
    out = W.fill_cascade(g, ["x", "y"], entity="entity", group="region", year="year", constants={"x": 25.0, "y": 25.0})
    return rounded(out.select("entity", "year", "x", "y"))


@query(
    "percentile_rank_avg",
    """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS x FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN x IS NULL THEN 0.5 ELSE
              (rank() OVER (PARTITION BY x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(x) OVER () END, 8) + 0.0 AS pct_rank FROM q""",
)
def percentile_rank_avg(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("x")
    )
    return rounded(O.percentile_rank(rows, "x", name="pct_rank").drop("x"), 8)


def rank_sql(x: str) -> str:
    return f"coalesce(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER () END, 0.5)"


@query(
    "mean_rank_scale",
    f"""SELECT c_custkey AS customer, round(least(greatest(0.8 + 0.45 * ({rank_sql('c_acctbal')} + 1 - {rank_sql('k')}) / 2, 0.8), 1.25), 8) + 0.0 AS scale
        FROM (SELECT *, c_nationkey % 7 AS k FROM customer)""",
)
def mean_rank_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), "c_acctbal", (F.col("c_nationkey") % 7).alias("k"))
    out = W.mean_ranks(rows, ["customer"], {"component": (["c_acctbal", "k", "absent"], ["k"])})
    return rounded(out.select("customer", W.bounded_scale("component", 0.8, 1.25).alias("scale")), 8)


def recent_sql(n: int, value: str = "value") -> str:
    return f"""(SELECT entity, feature, year, {value}, row_number() OVER (PARTITION BY entity, feature ORDER BY year DESC) AS k FROM long WHERE {value} IS NOT NULL)
               WHERE k <= {n}"""


LONG = "long AS (SELECT entity, year, unnest(['price_g', 'share_g']) AS feature, unnest([price_g, share_g]) AS value FROM gaps)"


@query(
    "recent_slope",
    sql(f"SELECT entity, feature, CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(value, year), 0) ELSE 0 END AS slope, count(*) AS n_points FROM {recent_sql(5)} GROUP BY ALL",
        *GAPPED, LONG, doubles="slope", digits=5),
)
def recent_slope(spark, sf_dir):
    return rounded(W.recent_slopes(gaps(spark, sf_dir), ["price_g", "share_g"], "entity", "year"), 5)


@query(
    "recent_logit_slope",
    sql(
        f"""SELECT entity, feature, CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(ln(p / (1 - p)), year), 0) ELSE 0 END AS slope, count(*) AS n_points
            FROM (SELECT *, least(greatest(value, 0.0001), 0.9999) AS p FROM {recent_sql(5)}) WHERE feature = 'share_g' GROUP BY ALL""",
        *GAPPED, LONG, doubles="slope", digits=6,
    ),
)
def recent_logit_slope(spark, sf_dir):
    return rounded(W.recent_slopes(gaps(spark, sf_dir), ["share_g"], "entity", "year", logit_scale=True), 6)


@query(
    "recent_growth_mean",
    sql(
        """SELECT c.entity, 'price_g' AS feature, coalesce(g, 0) AS growth FROM (SELECT DISTINCT entity FROM gaps WHERE price_g IS NOT NULL) c LEFT JOIN
           (SELECT entity, avg(rate) AS g FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k FROM
              (SELECT entity, year, price_g / lag(price_g) OVER (PARTITION BY entity ORDER BY year) - 1 AS rate FROM gaps WHERE price_g IS NOT NULL) WHERE rate IS NOT NULL)
            WHERE k <= 4 GROUP BY entity) r ON c.entity = r.entity""",
        *GAPPED, doubles="growth", digits=6,
    ),
)
def recent_growth_mean(spark, sf_dir):
    return rounded(W.recent_growth(materialize(gaps(spark, sf_dir)), ["price_g"], "entity", "year"), 6)


@query(
    "ols_trend",
    sql(
        """SELECT customer, regr_slope(revenue, year) AS slope, regr_intercept(revenue, year) / 1000000 AS intercept_millions, regr_r2(revenue, year) AS r_squared,
                  count(DISTINCT year) AS n_years FROM customer_panel GROUP BY customer HAVING count(DISTINCT year) >= 3""",
        CUSTOMERS, doubles="slope intercept_millions r_squared", digits=4,
    ),
)
def ols_trend(spark, sf_dir):
    out = W.ols_trend(customer_panel(spark, sf_dir), ["customer"], "revenue", "year")
    return rounded(out.withColumn("intercept_millions", F.col("intercept") / 1000000).drop("intercept"))


@query(
    "last_row_per_group",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""",
)
def last_row_per_group(spark, sf_dir):
    return W.last_row_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "recent_rates_with_default",
    sql(
        """SELECT entity, coalesce(avg(share_g), 0.008) AS baseline_share_g, CASE WHEN count(share_g) > 0 THEN 'observed_recent_average' ELSE 'extrapolated_default' END AS share_g_assumption,
                  coalesce(avg(price_g), 0) AS baseline_price_g, CASE WHEN count(price_g) > 0 THEN 'observed_recent_average' ELSE 'extrapolated_default' END AS price_g_assumption
           FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k FROM gaps) WHERE k <= 5 GROUP BY entity""",
        *GAPPED, doubles="baseline_share_g baseline_price_g",
    ),
)
def recent_rates_with_default(spark, sf_dir):
    return rounded(W.recent_rates(gaps(spark, sf_dir), {"share_g": specs.DEFAULT_DEATH_RATE, "price_g": 0.0}, "entity", "year"))


@query(
    "rank_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY abs(l_quantity - 25) DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS importance_rank FROM lineitem""",
)
def rank_first(spark, sf_dir):
    rank = W.rank_first(["l_orderkey"], F.col("l_quantity") - 25, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", rank.alias("importance_rank"))


@query(
    "temporal_split",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), r AS (SELECT y, row_number() OVER (ORDER BY y) AS k, count(*) OVER () AS n FROM y)
       SELECT o_orderkey, CASE WHEN k > n - greatest(n // 5, 1) THEN 'test' WHEN k > n - 2 * greatest(n // 5, 1) THEN 'validation' ELSE 'train' END AS split
       FROM orders JOIN r ON y = year(o_orderdate)""",
)
def temporal_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return W.temporal_split(rows, "year").drop("year")


@query(
    "argmax_column_label",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN greatest(abs(l_discount), abs(l_tax)) <= 1e-10 THEN 'none'
              WHEN abs(l_discount) >= abs(l_tax) THEN 'discount' ELSE 'tax' END AS driver FROM lineitem""",
)
def argmax_column_label(spark, sf_dir):
    label = W.argmax_label({"l_discount": "discount", "l_tax": "tax"}, "none")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", label.alias("driver"))


@query(
    "naive_and_trend_baseline",
    sql(
        "SELECT customer, year, l1 AS baseline_last_observed, l1 + coalesce(l1 - l2, 0) AS baseline_recent_trend FROM (SELECT *, lag(revenue) "
        + f"{CW} AS l1, lag(revenue, 2) {CW} AS l2 FROM customer_panel)",
        CUSTOMERS, doubles="baseline_last_observed baseline_recent_trend",
    ),
)
def naive_and_trend_baseline(spark, sf_dir):
    out = W.lag_features(customer_panel(spark, sf_dir), ["revenue"], "customer", "year", lags=(1, 2), rolling=None)
    out = out.withColumns(W.naive_baselines("revenue_lag1", "revenue_lag2"))
    return rounded(out.select("customer", "year", "baseline_last_observed", "baseline_recent_trend"))


STOCK = """rates AS (SELECT entity, any_value(nk) AS nk, 100000.0::DOUBLE / 3 AS p0, 0.008::DOUBLE AS d, any_value(nk) / 7000.0 AS m FROM panel GROUP BY entity),
  walk(entity, year, now, births, d, m) AS (
    SELECT p.entity, p.year, r.p0, p.n_orders::DOUBLE, r.d, r.m::DOUBLE FROM panel p JOIN rates r ON p.entity = r.entity WHERE p.year = 1995
    UNION ALL
    SELECT w.entity, p.year, w.now + w.births - w.now * w.d + w.now * w.m, p.n_orders::DOUBLE, w.d, w.m
    FROM walk w JOIN panel p ON p.entity = w.entity AND p.year = w.year + 1)"""


@query(
    "stock_flow_accounting",
    "WITH RECURSIVE " + ", ".join([*BASE, STOCK]) + """ SELECT entity, year, round(now, 7) + 0.0 AS stock_current, round(now * d, 7) + 0.0 AS projected_deaths,
        round(now * m, 7) + 0.0 AS projected_net, round(now + births - now * d + now * m, 7) + 0.0 AS stock_next FROM walk""",
)
def stock_flow_accounting(spark, sf_dir):
    flows = panel(spark, sf_dir).select(
        "entity", "year", F.col("n_orders").cast("double").alias("births"), (F.lit(100000.0) / 3).alias("p0"), F.lit(0.008).alias("d"),
        (F.col("nk") / F.lit(7000.0)).alias("m"),
    )
    out = W.stock_flow(flows, ["entity"], "year", stock="p0", births="births", death_rate="d", net_rate="m")
    return rounded(out.select("entity", "year", "stock_current", "projected_deaths", "projected_net", "stock_next"), 7)


@query(
    "zscore_scale_by_reference",
    sql(
        """SELECT s.entity, s.year, s.scenario, (s.path - r.path) / coalesce(nullif((SELECT stddev_pop(path) FROM sc WHERE scenario = '1-URGENT'), 0), 1) AS scaled
           FROM sc s LEFT JOIN (SELECT * FROM sc WHERE scenario = '1-URGENT') r ON s.entity = r.entity AND s.year = r.year""",
        GEO, SCENARIO_ROWS, doubles="scaled",
    ),
)
def zscore_scale_by_reference(spark, sf_dir):
    rows = priority_rows(spark, sf_dir)
    scale = W.reference_scales(rows, "scenario", "1-URGENT", ["path"]).getField("path")
    out = J.against_reference(rows, ["entity", "year"], "scenario", "1-URGENT", ["path"])
    return rounded(out.select("entity", "year", "scenario", (F.col("delta_path") / scale).alias("scaled")))


@query(
    "normalize_by_max_abs",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN greatest(l_discount, l_tax) = 0 THEN 0 ELSE l_discount / greatest(l_discount, l_tax) END, 4) + 0.0 AS l_discount_normalized,
              round(CASE WHEN greatest(l_discount, l_tax) = 0 THEN 0 ELSE l_tax / greatest(l_discount, l_tax) END, 4) + 0.0 AS l_tax_normalized FROM lineitem""",
)
def normalize_by_max_abs(spark, sf_dir):
    new = W.normalize_by_max_abs(["l_discount", "l_tax"])
    return rounded(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in new.items()])
    )


@query(
    "ramped_adjustment",
    sql(
        """SELECT entity, year, least(greatest((urgent_share - 0.2) * 300 * greatest(year - 1996, 0) / 4.0, -8), 8) AS adjustment FROM panel""",
        *BASE, doubles="adjustment",
    ),
)
def ramped_adjustment(spark, sf_dir):
    raw = (F.col("urgent_share") - 0.2) * 300
    return rounded(panel(spark, sf_dir).select("entity", "year", W.ramped_adjustment(raw, "year", 1996, 2000).alias("adjustment")))


# --- sorting and top-k ----------------------------------------------------------------------------


@query("sort_nulls_last", "SELECT doc_id, nullif(lang, 'en') AS lang, source FROM documents ORDER BY lang NULLS LAST, source NULLS LAST, doc_id")
def sort_nulls_last(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("en")).alias("lang"), "source")
    return R.sort_nulls_last(rows, ["lang", "source", "doc_id"])


@query(
    "ranked_groups_topk",
    sql(
        """SELECT * FROM (
             SELECT year, entity, entity_name, d, CAST(row_number() OVER (PARTITION BY year ORDER BY d DESC, entity_name) AS INTEGER) AS rank, 'upward' AS ranking_group FROM q WHERE d > 5000
             UNION ALL SELECT year, entity, entity_name, d, CAST(row_number() OVER (PARTITION BY year ORDER BY d, entity_name) AS INTEGER), 'downward' FROM q WHERE d < -5000
             UNION ALL SELECT year, entity, entity_name, d, CAST(row_number() OVER (PARTITION BY year ORDER BY abs(d), entity_name) AS INTEGER), 'closest' FROM q) WHERE rank <= 5""",
        *GAPPED, "q AS (SELECT year, entity, entity_name, price_g - 250000 AS d FROM gaps WHERE price_g IS NOT NULL)", doubles="d",
    ),
)
def ranked_groups_topk(spark, sf_dir):
    rows = materialize(gaps(spark, sf_dir)).select("year", "entity", "entity_name", (F.col("price_g") - 250000).alias("d"))
    return rounded(R.direction_rankings(rows, ["year"], "d", "entity_name", tolerance=5000))


@query(
    "topk_global",
    """(SELECT event_id, value - 20 AS v, 'positive' AS side FROM events WHERE value > 20 ORDER BY v DESC, event_id LIMIT 5)
       UNION ALL (SELECT event_id, value - 20 AS v, 'negative' FROM events WHERE value < 20 ORDER BY v, event_id LIMIT 5)""",
)
def topk_global(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 20).alias("v"))
    return R.top_both_ends(rows, "v", "event_id")


@query(
    "preview_with_overflow",
    """WITH d AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 7 <> 0),
            n AS (SELECT s_suppkey, p_brand, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_brand) AS k, count(p_brand) OVER (PARTITION BY s_suppkey) AS n
                  FROM supplier LEFT JOIN d ON s_suppkey = l_suppkey)
       SELECT s_suppkey, n AS n_codes, CASE WHEN n = 0 THEN 'none' ELSE string_agg(p_brand, ', ' ORDER BY p_brand) FILTER (WHERE k <= 15)
              || CASE WHEN n > 15 THEN ', ... (+' || (n - 15) || ' more)' ELSE '' END END AS preview FROM n GROUP BY s_suppkey, n""",
)
def preview_with_overflow(spark, sf_dir):
    """Every line is read; the key of some suppliers is masked, so that they stay without a code."""
    key = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("key")
    lines = table(spark, sf_dir, "lineitem").select(key, "l_partkey").distinct().join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = table(spark, sf_dir, "supplier").join(lines.select("key", "p_brand"), F.col("s_suppkey") == F.col("key"), "left")
    return R.preview_with_overflow(pairs, ["s_suppkey"], "p_brand")


@query("sort_locale", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_mktsegment, c_name")
def sort_locale(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.orderBy(F.collate("c_mktsegment", "UNICODE"), F.collate("c_name", "UNICODE"))


@query(
    "available_horizons",
    """WITH y AS (SELECT o_custkey, list_sort(list_distinct(list(CAST(year(o_orderdate) AS INTEGER)))) AS seen FROM orders GROUP BY 1)
       SELECT o_custkey, array_to_string(CASE WHEN len(list_intersect([1996, 2000, 2005], seen)) > 0 THEN list_sort(list_intersect([1996, 2000, 2005], seen)) ELSE seen END, ',') AS horizons FROM y""",
)
def available_horizons(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    out = S.horizons_available(rows, "year", [2005, 1996, 2000], ["o_custkey"])
    return out.withColumn("horizons", F.array_join(F.col("horizons").cast("array<string>"), ","))


# --- sets -----------------------------------------------------------------------------------------


@query(
    "union_by_name",
    sql(
        """SELECT entity, year, price, NULL::BIGINT AS n_events FROM panel UNION ALL SELECT entity, year, NULL, n_events FROM ev""",
        *BASE, EVENTS, doubles="price",
    ),
)
def union_by_name(spark, sf_dir):
    a = panel(spark, sf_dir).select("entity", "year", "price")
    return rounded(S.union_by_name([a, yearly_events(spark, sf_dir).select("year", "n_events", "entity")]))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def distinct_rows(spark, sf_dir):
    return S.distinct_values(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


@query(
    "dedupe_keep_first_last",
    """SELECT user_id, event_type, event_id, value, side FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, 'first' AS side FROM events
         UNION ALL SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC), 'last' FROM events) WHERE k = 1""",
)
def dedupe_keep_first_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    keys = ["user_id", "event_type"]
    first = S.keep_one(rows, keys, ["event_id"]).withColumn("side", F.lit("first"))
    return first.unionByName(S.keep_one(rows, keys, ["event_id"], last=True).withColumn("side", F.lit("last")))


@query(
    "dedupe_composite_key",
    """SELECT event_id, user_id, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id, coalesce(t, '') ORDER BY event_id) AS k FROM
         (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '' ELSE event_type END AS t FROM events)) WHERE k = 1""",
)
def dedupe_composite_key(spark, sf_dir):
    t = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", t.alias("t"))
    return S.keep_one_blank_keys(rows, ["user_id", "t"], ["event_id"])


@query(
    "set_difference_ids",
    """WITH a AS (SELECT DISTINCT doc_id AS id FROM documents), b AS (SELECT DISTINCT doc_id AS id FROM labels), c AS (SELECT DISTINCT page_id AS id FROM pages),
            u AS (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c),
            f AS (SELECT id, id IN (SELECT id FROM a) AS in_documents, id IN (SELECT id FROM b) AS in_labels, id IN (SELECT id FROM c) AS in_pages FROM u)
       SELECT * FROM f WHERE NOT (in_documents AND in_labels AND in_pages)""",
)
def set_difference_ids(spark, sf_dir):
    sides = {
        "documents": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")),
        "labels": table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")),
        "pages": table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")),
    }
    return S.set_difference(sides, "id")


@query(
    "is_superset",
    "SELECT o_custkey, bool_or(year(o_orderdate) = 1996) AND bool_or(year(o_orderdate) = 1998) AND bool_or(year(o_orderdate) = 2001) AS is_complete FROM orders GROUP BY 1",
)
def is_superset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return S.covers_all(rows, ["o_custkey"], "year", [1996, 1998, 2001])


@query(
    "append_total_rows",
    sql(
        """SELECT entity, entity_name, year, n_orders, NULL::DOUBLE AS regional_interest FROM panel
           UNION ALL SELECT '00T', 'All nations', year, CAST(sum(n_orders) AS BIGINT), 100.0 FROM panel GROUP BY year""",
        *BASE,
    ),
)
def append_total_rows(spark, sf_dir):
    rows = panel(spark, sf_dir).select("entity", "entity_name", "year", "n_orders", F.lit(None).cast("double").alias("regional_interest"))
    totals = rows.groupBy("year").agg(F.sum("n_orders").alias("n_orders"))
    return S.append_total_rows(rows, totals, {"entity": "00T", "entity_name": "All nations", "regional_interest": 100.0})


