"""Queries of the scenario, projection and forecast-audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as J
from ..operators import ranking as R
from ..operators import windows as W
from ..plans import audit as AU
from ..plans import projection as PR
from ..plans import publish as PB
from ..plans import scenario as SC
from ..plans import specs
from ..session import materialize
from .aggregating import BANDS, band_rate_table
from .base import BASE, CUSTOMERS, END, GAPPED, GEO, LAST, cents, customer_panel, gaps, panel, query, rounded, scratch, sql, table

SHORT = {
    "rs": "remote_work_share_state_year",
    "mc": "mean_commute_minutes_state_year",
    "sl": "screen_leisure_minutes_broad_state_year",
    "dm": "digital_media_minutes_narrow_state_year",
    "ip": "in_person_social_minutes_state_year",
    "sd": "search_interest_online_dating_state_year",
    "hw": "household_work_minutes_state_year",
    "uc": "unpaid_care_minutes_state_year",
}
MOVED = ["sl", "dm", "ip", "sd", "hw", "uc", "mc"]
ADDITIVE = [SHORT[c] for c in MOVED]
SHARE = SHORT["rs"]
PUBLIC = list(specs.PUBLIC_SCENARIOS)
LOW, HIGH = 50.0, 75.0


def covariates(spark, sf_dir):
    """The nation × year panel in the roles of the scenario inputs."""
    roles = {
        "rate": F.col("price") / 4000,
        SHORT["rs"]: F.col("urgent_share"),
        SHORT["mc"]: F.col("urgent_share") * 30 + 20,
        SHORT["sl"]: F.col("balance") / 50,
        SHORT["dm"]: F.col("low_share") * 40,
        SHORT["ip"]: F.col("low_share") * 60,
        SHORT["sd"]: F.col("open_share") * 50,
        SHORT["hw"]: F.col("price") / 4000,
        SHORT["uc"]: F.col("balance") / 100,
    }
    return panel(spark, sf_dir).select(
        "entity", "entity_name", "region", "nk", "year", "n_orders", *[c.alias(n) for n, c in roles.items()]
    )


COVP = """covp AS (SELECT entity, entity_name, region, nk, year, n_orders, price / 4000 AS rate, urgent_share AS rs, urgent_share * 30 + 20 AS mc,
    balance / 50 AS sl, low_share * 40 AS dm, low_share * 60 AS ip, open_share * 50 AS sd, price / 4000 AS hw, balance / 100 AS uc FROM panel)"""

ANCHOR = (
    """anch AS (SELECT entity, any_value(entity_name) AS entity_name, any_value(region) AS region, any_value(nk) AS nk, arg_max(n_orders, year) AS n0, arg_max(rs, year) AS rs0,
      regr_slope(ln(greatest(least(rs, 0.9999), 0.0001) / (1 - greatest(least(rs, 0.9999), 0.0001))), year) FILTER (WHERE k <= 5) AS rs_m, """
    + ", ".join(f"arg_max({c}, year) AS {c}0, regr_slope({c}, year) FILTER (WHERE k <= 5) AS {c}_m" for c in MOVED)
    + """, avg(g) FILTER (WHERE k <= 4) AS n_g FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k,
           n_orders * 1.0 / lag(n_orders) OVER (PARTITION BY entity ORDER BY year) - 1 AS g FROM covp) GROUP BY entity)"""
)


def values_sql(name: str, names: list[str], columns: dict[str, str]) -> str:
    rows = []
    for n in names:
        inc = {**SC.growth_overrides(n), **specs.MEASURE_INCREMENTS.get(n, {})}
        label = specs.SCENARIOS[n][0]
        rows.append("('" + n + "', '" + label + "', " + ", ".join(f"{float(inc.get(c, 0.0))}::DOUBLE" for c in columns.values()) + ")")
    return f"{name}(scenario_name, scenario_label, " + ", ".join(f"i_{c}" for c in columns) + ") AS (VALUES " + ", ".join(rows) + ")"


SCEN = values_sql("scen", PUBLIC, SHORT)
SHARE_WALK = f"""share_walk(entity, scenario_name, k, s) AS (
    SELECT entity, scenario_name, 0, rs0 FROM anch, scen
    UNION ALL
    SELECT w.entity, w.scenario_name, w.k + 1, least(greatest(1 / (1 + exp(-(ln(greatest(least(w.s, 0.9999), 0.0001) / (1 - greatest(least(w.s, 0.9999), 0.0001))) + a.rs_m)))
             + sc.i_rs * pow(0.92, w.k), 0.0001), 0.9999)
    FROM share_walk w JOIN anch a ON a.entity = w.entity JOIN scen sc ON sc.scenario_name = w.scenario_name WHERE w.k < {END - 2001})"""
WALK = (
    "walk(entity, scenario_name, k, " + ", ".join(MOVED) + ") AS (SELECT entity, scenario_name, 0, " + ", ".join(f"{c}0" for c in MOVED)
    + " FROM anch, scen UNION ALL SELECT w.entity, w.scenario_name, w.k + 1, "
    + ", ".join(f"w.{c} + a.{c}_m + sc.i_{c} * pow(0.92, w.k)" for c in MOVED)
    + f" FROM walk w JOIN anch a ON a.entity = w.entity JOIN scen sc ON sc.scenario_name = w.scenario_name WHERE w.k < {END - 2001})"
)
COV = """cov AS (SELECT w.entity, a.entity_name, a.region, a.nk, w.scenario_name, 2001 + w.k AS year, w.k, s.s AS rs, """ + ", ".join(f"w.{c}" for c in MOVED) + """,
      w.hw + w.uc AS cb, s.s * w.mc * 2 AS saved, a.n0 * pow(1 + a.n_g, w.k) AS n_orders
    FROM walk w JOIN share_walk s ON s.entity = w.entity AND s.scenario_name = w.scenario_name AND s.k = w.k JOIN anch a ON a.entity = w.entity)"""
SCENARIO_CTES = (GEO, BASE[1], COVP, ANCHOR, SCEN, SHARE_WALK, WALK, COV)


def rsql(body: str, *ctes: str, doubles: str = "", digits: int = 4) -> str:
    """As ``sql`` with recursive CTEs."""
    return sql(body, *ctes, doubles=doubles, digits=digits).replace("WITH ", "WITH RECURSIVE ", 1)


def anchor_of(p):
    return SC.baseline_anchor(p, "entity", "year", slopes=ADDITIVE, logit_slopes=[SHARE], growth=["n_orders"])


def scenario_frame(spark, sf_dir, scaled: bool = False):
    p = materialize(covariates(spark, sf_dir))
    a = anchor_of(p)
    if scaled:
        a = SC.override_scales(a, [*ADDITIVE, SHARE])
    last = p.agg(F.max("year")).scalar()
    out = SC.scenario_covariates(a, last, END, PUBLIC, additive=ADDITIVE, share=SHARE, compound=["n_orders"])
    out = SC.derived_identities(out, SHARE, SHORT["mc"], [SHORT["hw"], SHORT["uc"]], "care_burden_minutes_state_year")
    return p, out


@query(
    "scenario_overrides_dim",
    sql(
        "SELECT entity, scenario_name, scenario_label, scenario_input_type, feature, annual_increment FROM (SELECT DISTINCT entity FROM geo), ov",
        GEO,
        "ov(scenario_name, scenario_label, scenario_input_type, feature, annual_increment) AS (VALUES "
        + ", ".join(
            f"('{n}', '{specs.SCENARIOS[n][0]}', '{'user_defined' if n == 'user_defined' else 'template'}', '{c}', "
            f"{float(SC.growth_overrides(n, user={'remote_work_exposure': 0.07, 'unknown': 1.0}).get(c, 0.0))}::DOUBLE)"
            for n in specs.SCENARIOS for c in specs.EXPOSURE_INDICES
        )
        + ")",
    ),
)
def scenario_overrides_dim(spark, sf_dir):
    entities = panel(spark, sf_dir).select("entity").distinct()
    return SC.scenario_overrides(
        entities, list(specs.SCENARIOS), specs.EXPOSURE_INDICES, user={"remote_work_exposure": 0.07, "unknown": 1.0}
    )


@query(
    "additive_decay_paths",
    rsql(
        "SELECT entity, scenario_name, year, " + ", ".join(f"{c} AS {SHORT[c]}" for c in ["sl", "ip", "sd"])
        + ", CASE WHEN k > 0 THEN 'user_specified_scenario_assumption' ELSE 'observed_anchor' END AS covariate_status FROM cov",
        *SCENARIO_CTES, doubles=" ".join(SHORT[c] for c in ["sl", "ip", "sd"]), digits=6,
    ),
)
def additive_decay_paths(spark, sf_dir):
    _, out = scenario_frame(spark, sf_dir)
    return rounded(out.select("entity", "scenario_name", "year", *[SHORT[c] for c in ["sl", "ip", "sd"]], "covariate_status"), 6)


@query("bounded_share_path", rsql(f"SELECT entity, scenario_name, 2001 + k AS year, s AS {SHARE} FROM share_walk", *SCENARIO_CTES[:6], doubles=SHARE, digits=6))
def bounded_share_path(spark, sf_dir):
    _, out = scenario_frame(spark, sf_dir)
    return rounded(out.select("entity", "scenario_name", "year", SHARE), 6)


@query("compound_growth_path", rsql("SELECT entity, scenario_name, year, n_orders FROM cov", *SCENARIO_CTES, doubles="n_orders", digits=5))
def compound_growth_path(spark, sf_dir):
    _, out = scenario_frame(spark, sf_dir)
    return rounded(out.select("entity", "scenario_name", "year", "n_orders"), 5)


@query(
    "derived_identity_columns",
    rsql(
        "SELECT entity, scenario_name, year, rs * mc AS time_saved_one_way, rs * mc * 2 AS time_saved_roundtrip, cb AS care_burden_minutes_state_year FROM cov",
        *SCENARIO_CTES, doubles="time_saved_one_way time_saved_roundtrip care_burden_minutes_state_year", digits=6,
    ),
)
def derived_identity_columns(spark, sf_dir):
    _, out = scenario_frame(spark, sf_dir)
    return rounded(
        out.select("entity", "scenario_name", "year", "time_saved_one_way", "time_saved_roundtrip", "care_burden_minutes_state_year"), 6
    )


@query(
    "baseline_anchor",
    sql(
        "SELECT entity, n0 AS n_orders, n_g AS n_orders_baseline_growth, rs_m AS remote_work_share_state_year_logit_slope, "
        + ", ".join(f"{c}0 AS {SHORT[c]}, {c}_m AS {SHORT[c]}_baseline_slope" for c in MOVED) + " FROM anch",
        GEO, BASE[1], COVP, ANCHOR,
        doubles="n_orders_baseline_growth remote_work_share_state_year_logit_slope " + " ".join(f"{SHORT[c]} {SHORT[c]}_baseline_slope" for c in MOVED),
        digits=6,
    ),
)
def baseline_anchor(spark, sf_dir):
    a = anchor_of(materialize(covariates(spark, sf_dir)))
    return rounded(
        a.select(
            "entity", "n_orders", "n_orders_baseline_growth", F.col(f"{SHARE}_logit_slope"),
            *[F.col(f"{SHORT[c]}{suffix}") for c in MOVED for suffix in ("", "_baseline_slope")],
        ),
        6,
    )


def pr(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count(*) OVER ()"


@query(
    "override_scales",
    sql(
        f"""SELECT entity, 1.0::DOUBLE AS scale_mc, least(greatest(0.7 + 0.6 * {pr('rs0')}, 0.7), 1.3) AS scale_care
            FROM anch""",
        GEO, BASE[1], COVP, ANCHOR, doubles="scale_care", digits=8,
    ),
)
def override_scales(spark, sf_dir):
    """Scales of the care columns from the share's rank; a column without a rule keeps 1."""
    a = anchor_of(materialize(covariates(spark, sf_dir)))
    out = SC.override_scales(a, [SHORT["hw"], "unscaled_column"])
    return rounded(
        out.select("entity", F.col("scenario_scale_unscaled_column").alias("scale_mc"), F.col(f"scenario_scale_{SHORT['hw']}").alias("scale_care")), 8
    )


# --- rates, bands, stock ---------------------------------------------------------------------------

NUDGE = 3.14159e-7  # rates of small counts are simple fractions; this moves them off the ties of rounding, on both sides

FACTORS = "factors(scenario_code, factor) AS (VALUES " + ", ".join(f"('{c}', {PR.scenario_factor(c)}::DOUBLE)" for c in PR.CODES) + ")"
TREND = """fit AS (SELECT entity, regr_slope(rate, year - 2000) AS b, regr_intercept(rate, year - 2000) AS a, arg_max(second, year) FILTER (WHERE second IS NOT NULL) / arg_max(rate, year) FILTER (WHERE second IS NOT NULL) AS ratio
    FROM (SELECT entity, year, price / 4000 AS rate, CASE WHEN year < 2001 OR nk % 2 = 0 THEN balance / 100 END AS second FROM panel) GROUP BY entity HAVING count(DISTINCT year) >= 3)"""


@query("scenario_factor", sql("SELECT entity, year, scenario_code, price * (1 + factor) AS adjusted FROM panel, factors", *BASE, FACTORS, doubles="adjusted"))
def scenario_factor(spark, sf_dir):
    rows = PR.explode_factors(panel(spark, sf_dir).select("entity", "year", "price"))
    return rounded(rows.select("entity", "year", "scenario_code", (F.col("price") * (F.lit(1.0) + F.col("factor"))).alias("adjusted")))


@query(
    "trend_projection_grid",
    sql(
        """SELECT entity, CAST(y AS INTEGER) AS year, scenario_code, a + b * (y - 2000) AS baseline_rate, greatest(0, (a + b * (y - 2000)) * (1 + factor)) AS adjusted_rate,
                  greatest(0, (a + b * (y - 2000)) * (1 + factor)) * ratio AS projected_second_rate
           FROM fit, factors, (SELECT unnest(range(2002, 2038)) AS y)""",
        *BASE, TREND, FACTORS, doubles="baseline_rate adjusted_rate projected_second_rate", digits=5,
    ),
)
def trend_projection_grid(spark, sf_dir):
    rates = panel(spark, sf_dir).select(
        "entity", "year", (F.col("price") / 4000).alias("rate"),
        F.when((F.col("year") < 2001) | (F.col("nk") % 2 == 0), F.col("balance") / 100).alias("second"),
    )
    return rounded(PR.trend_projection(materialize(rates), "entity", "year", "rate", "second", END), 5)


@query(
    "banded_projection_grid",
    sql(
        f"""SELECT f.entity, f.band, CAST(y AS INTEGER) AS year, scenario_code, a + b * (y - 2000) + {NUDGE} AS baseline_rate,
                  greatest(0, (a + b * (y - 2000)) * (1 + factor)) + {NUDGE} AS adjusted_rate, round(n0 * pow(1 + g, y - 2001), 3) AS denominator,
                  round(greatest(0, (a + b * (y - 2000)) * (1 + factor)) / 1000 * n0 * pow(1 + g, y - 2001), 3) AS projected_events
           FROM (SELECT entity, band, regr_slope(1000.0 * events / n, year - 2000) AS b, regr_intercept(1000.0 * events / n, year - 2000) AS a FROM bands GROUP BY ALL HAVING count(DISTINCT year) >= 3) f
           JOIN (SELECT entity, band, arg_max(n, year) AS n0, coalesce(avg(g) FILTER (WHERE k <= 3), 0) AS g FROM
                  (SELECT *, n * 1.0 / lag(n) OVER (PARTITION BY entity, band ORDER BY year) - 1 AS g, row_number() OVER (PARTITION BY entity, band ORDER BY year DESC) AS k FROM bands) GROUP BY ALL) d
             ON f.entity = d.entity AND f.band = d.band, factors, (SELECT unnest(range(2002, 2038)) AS y)""",
        GEO, BANDS, FACTORS, doubles="baseline_rate adjusted_rate denominator projected_events", digits=5,
    ),
)
def banded_projection_grid(spark, sf_dir):
    rates = materialize(band_rate_table(spark, sf_dir))
    size = rates.select("entity", "year", "band", "n")
    out = PR.banded_projection(rates, size, "entity", "band", "year", "rate", "n", END)
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("denominator", "projected_events")} | {c: F.col(c) + F.lit(NUDGE) for c in ("baseline_rate", "adjusted_rate")}), 5)


@query(
    "events_from_rate",
    sql(
        """SELECT p.entity, p.year, price / 4000 / 1000 * n_orders AS events, b.banded FROM panel p JOIN
           (SELECT entity, year, CASE WHEN count(*) FILTER (WHERE band <> '35-39') = 4 THEN sum(CASE WHEN band <> '35-39' THEN 1000.0 * events / n / 1000 * n END) END AS banded FROM bands GROUP BY ALL) b ON p.entity = b.entity AND p.year = b.year""",
        *BASE, BANDS, doubles="events banded",
    ),
)
def events_from_rate(spark, sf_dir):
    rate = band_rate_table(spark, sf_dir)
    names = {b: b.replace("-", "_") for b in list(specs.BAND_WIDTHS)[:4]}
    pick = lambda b, c: F.max(F.when(F.col("band") == b, F.col(c)))
    wide = rate.groupBy("entity", "year").agg(
        *[pick(b, "rate").alias(f"predicted_rate_{n}") for b, n in names.items()],
        *[pick(b, "n").alias(f"base_{n}") for b, n in names.items()],
        pick("35-39", "rate").alias("predicted_rate_unpaired"),
    )
    out = wide.withColumn("banded", PR.events_from_bands(wide, "predicted_rate_", "base_")).select("entity", "year", "banded")
    p = panel(spark, sf_dir).select("entity", "year", PR.events_from_rate(F.col("price") / 4000, "n_orders").alias("events"))
    return rounded(p.join(out, ["entity", "year"]))


@query(
    "uncertainty_bands",
    sql("SELECT entity, year, revenue * 0.5 AS revenue_low, revenue * 1.0 AS revenue_mid, revenue * 1.5 AS revenue_high FROM panel", *BASE, doubles="revenue_low revenue_mid revenue_high"),
)
def uncertainty_bands(spark, sf_dir):
    new = PR.uncertainty_bands("revenue")
    return rounded(panel(spark, sf_dir).select("entity", "year", *[c.alias(n) for n, c in new.items()]))


NAIVE = """ends AS (SELECT entity, max(year) AS last_year, arg_max(rate, year) AS r0, coalesce(arg_max(rate, year) - max(prev) FILTER (WHERE k = 1), 0) AS step FROM
      (SELECT *, lag(rate) OVER (PARTITION BY entity ORDER BY year) AS prev, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k FROM covp) GROUP BY entity),
   lastp AS (SELECT c.* FROM covp c JOIN ends e ON c.entity = e.entity AND c.year = e.last_year),
   naive AS (SELECT c.entity, c.scenario_name, c.year, m.model,
             CASE WHEN m.model = 'baseline_last_observed' THEN r0 ELSE r0 + (c.year - greatest(e.last_year, 2000)) * step END AS predicted
      FROM cov c JOIN ends e ON c.entity = e.entity, (VALUES ('baseline_last_observed'), ('baseline_recent_trend')) m(model) WHERE c.year > e.last_year)"""


def naive_paths(p, cov):
    wide = SC.naive_future_paths(
        p.select("entity", "year", "rate"), cov.drop("rate"), ["entity", "scenario_name"], "entity", "year", "rate"
    )
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in ("baseline_last_observed", "baseline_recent_trend")])
    return wide.select(
        *[c for c in wide.columns if not c.startswith("baseline_last") and not c.startswith("baseline_recent")], F.inline(models)
    )


@query("naive_future_paths", rsql("SELECT entity, scenario_name, year, model, predicted FROM naive", *SCENARIO_CTES, NAIVE, doubles="predicted", digits=6))
def naive_future_paths(spark, sf_dir):
    p, cov = scenario_frame(spark, sf_dir)
    return rounded(naive_paths(p, cov).select("entity", "scenario_name", "year", "model", "predicted"), 6)


@query(
    "component_projection",
    rsql(
        """SELECT model, scenario_name, entity, year, now AS stock_current, births AS projected_births, now * d AS projected_deaths, now * m AS projected_net, now + births - now * d + now * m AS stock_next,
                  death_rate_assumption, 'observed_recent_average' AS net_rate_assumption FROM pop""",
        *SCENARIO_CTES, NAIVE,
        """stock AS (SELECT entity, arg_max(p0, year) AS p0, coalesce(arg_max(d, year), avg(d) FILTER (WHERE k <= 5), 0.008) AS d, arg_max(m, year) AS m,
               CASE WHEN count(d) FILTER (WHERE k <= 5) > 0 THEN 'observed_recent_average' ELSE 'extrapolated_default' END AS death_rate_assumption FROM
             (SELECT entity, year, n_orders * 100.0 AS p0, CASE WHEN nk % 3 = 0 AND year < 2001 THEN NULL WHEN nk % 5 = 0 THEN NULL ELSE year % 10 * 0.001 + 0.005 END AS d, nk * 0.0005 AS m,
                     row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS k FROM covp) GROUP BY entity)""",
        f"""pop(model, scenario_name, entity, year, now, births, d, m, death_rate_assumption) AS (
            SELECT n.model, n.scenario_name, n.entity, n.year, s.p0::DOUBLE, n.predicted / 1000 * c.n_orders, s.d::DOUBLE, s.m::DOUBLE, s.death_rate_assumption
            FROM naive n JOIN stock s ON n.entity = s.entity JOIN cov c ON c.entity = n.entity AND c.scenario_name = n.scenario_name AND c.year = n.year JOIN ends e ON e.entity = n.entity WHERE n.year = greatest(e.last_year, 2000) + 1
            UNION ALL
            SELECT p.model, p.scenario_name, p.entity, n.year, p.now + p.births - p.now * p.d + p.now * p.m, n.predicted / 1000 * c.n_orders, p.d, p.m, p.death_rate_assumption
            FROM pop p JOIN naive n ON n.model = p.model AND n.scenario_name = p.scenario_name AND n.entity = p.entity AND n.year = p.year + 1
            JOIN cov c ON c.entity = n.entity AND c.scenario_name = n.scenario_name AND c.year = n.year WHERE n.year <= 2037)""",
        doubles="stock_current projected_births projected_deaths projected_net stock_next", digits=4,
    ),
)
def component_projection(spark, sf_dir):
    p, cov = scenario_frame(spark, sf_dir)
    forecasts = naive_paths(p, cov)
    death = (
        F.when((F.col("nk") % 3 == 0) & (F.col("year") < 2001), None).when(F.col("nk") % 5 == 0, None)
        .otherwise(F.col("year") % 10 * 0.001 + 0.005)
    )
    size = F.col("n_orders") * 100.0
    history = p.select("entity", "year", size.alias("stock"), (death * size).alias("deaths"), (F.col("nk") * 0.0005 * size).alias("net"))
    out = PR.component_projection(
        forecasts, history, entity="entity", year="year", scenario=["model", "scenario_name"], rate="predicted", base="n_orders",
        stock="stock", deaths="deaths", net="net", end_year=END,
    )
    return rounded(out)


# --- contributions, records ------------------------------------------------------------------------

LONG_OF = {**{c: SHORT[c] for c in SHORT}, "cb": "care_burden_minutes_state_year"}
COLUMN_OF = {v: k for k, v in LONG_OF.items()}


def mechanism_sql() -> str:
    parts = []
    for m in specs.MECHANISMS:
        terms = [
            f"CASE WHEN c.scenario = '{s}' THEN {sign * theta} * (c.{COLUMN_OF[col]} - r.{COLUMN_OF[col]}) / sd.{COLUMN_OF[col]} ELSE 0 END"
            for s, col, theta, sign, mech in specs.ADJUSTMENT_TERMS if mech == m
        ]
        if m == "mechanism_remote_work_flexibility":
            terms.append(f"CASE WHEN c.scenario = 'remote_work_saves_time' THEN {specs.REMOTE_BETA} * (c.rs - r.rs) * r.mc * 2 / sd.saved ELSE 0 END")
        parts.append(f"({' + '.join(terms)}) AS {m}")
    return ", ".join(parts)


NAMES = ["rs", "sl", "dm", "ip", "sd", "cb", "saved"]
PUB = "pub(scenario_name, scenario) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in specs.PUBLIC_SCENARIOS.items()) + ")"
MECH = (
    "cs AS (SELECT cov.*, scenario FROM cov JOIN pub ON cov.scenario_name = pub.scenario_name)",
    "sd AS (SELECT " + ", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}" for c in NAMES) + " FROM cs WHERE scenario = 'reference_path')",
    f"mech0 AS (SELECT c.entity, c.year, c.scenario, {mechanism_sql()} FROM cs c JOIN (SELECT * FROM cs WHERE scenario = 'reference_path') r ON c.entity = r.entity AND c.year = r.year, sd)",
    "mech AS (SELECT *, " + " + ".join(specs.MECHANISMS) + " AS scenario_adjustment, CASE WHEN greatest("
    + ", ".join(f"abs({m})" for m in specs.MECHANISMS) + ") <= 1e-10 THEN 'observed state trend' "
    + " ".join(
        f"WHEN abs({m}) = greatest({', '.join(f'abs({o})' for o in specs.MECHANISMS)}) THEN '{label}'" for m, label in specs.MECHANISMS.items()
    )
    + " END AS main_driver FROM mech0)",
)
MECH_CTES = (*SCENARIO_CTES, PUB, *MECH)


def mechanism_frame(spark, sf_dir):
    p, cov = scenario_frame(spark, sf_dir)
    cov = materialize(cov.withColumn("scenario", C.recode("scenario_name", specs.PUBLIC_SCENARIOS)))
    remote = ("remote_work_saves_time", SHARE, SHORT["mc"], "time_saved_roundtrip", specs.REMOTE_BETA, "mechanism_remote_work_flexibility")
    return p, cov, SC.mechanism_contributions(
        cov, ["entity", "year"], "scenario", "reference_path", specs.ADJUSTMENT_TERMS, remote=remote
    )


MECH_NAMES = " ".join(specs.MECHANISMS)


@query(
    "mechanism_contributions",
    rsql(f"SELECT entity, year, scenario, {', '.join(specs.MECHANISMS)}, scenario_adjustment, main_driver FROM mech", *MECH_CTES,
         doubles=MECH_NAMES + " scenario_adjustment", digits=6),
)
def mechanism_contributions(spark, sf_dir):
    _, _, out = mechanism_frame(spark, sf_dir)
    return rounded(out.select("entity", "year", "scenario", *specs.MECHANISMS, "scenario_adjustment", "main_driver"), 6)


def bounded(x: str) -> str:
    return f"least(greatest({x}, {LOW}), {HIGH})"


RECORDS = f"""rec AS (SELECT CASE WHEN a.nk % 2 = 1 THEN 'msa' ELSE 'state' END AS geography_type, a.entity, a.entity_name, a.region, n.model, m.scenario, n.year,
      {bounded('n.predicted')} AS reference_path, {bounded(f"{bounded('n.predicted')} + m.scenario_adjustment")} AS scenario_path,
      {bounded(f"{bounded('n.predicted')} + m.scenario_adjustment")} - {bounded('n.predicted')} AS scenario_difference,
      {bounded(f"{bounded('n.predicted')} + m.scenario_adjustment")} <> {bounded('n.predicted')} + m.scenario_adjustment AS bounded_flag, m.main_driver, {', '.join('m.' + m for m in specs.MECHANISMS)}
    FROM mech m JOIN (SELECT * FROM naive WHERE scenario_name = 'baseline_continuation') n ON m.entity = n.entity AND m.year = n.year JOIN anch a ON a.entity = m.entity)"""
REC_CTES = (*MECH_CTES, NAIVE, RECORDS)


def records(spark, sf_dir):
    """Forecast records: geography × model × scenario × year with both paths and the difference."""
    p, cov, mech = mechanism_frame(spark, sf_dir)
    reference = cov.filter("scenario = 'reference_path'").select("entity", "scenario_name", "year")
    paths = naive_paths(p, reference).select("entity", "year", "model", C.clip("predicted", LOW, HIGH).alias("reference_path"))
    kind = F.when(F.col("nk") % 2 == 1, "msa").otherwise("state")
    joined = mech.select(
        kind.alias("geography_type"), "entity", "entity_name", "region", "year", "scenario", "scenario_adjustment", "main_driver",
        *specs.MECHANISMS,
    ).join(paths, ["entity", "year"])
    return SC.bounded_paths(joined, "reference_path", "scenario_adjustment", LOW, HIGH)


PATHS = "reference_path scenario_path scenario_difference"


@query(
    "bounded_scenario_path",
    rsql("SELECT geography_type, entity, model, scenario, year, reference_path, scenario_path, scenario_difference, bounded_flag, main_driver FROM rec", *REC_CTES, doubles=PATHS, digits=6),
)
def bounded_scenario_path(spark, sf_dir):
    return rounded(
        records(spark, sf_dir).select(
            "geography_type", "entity", "model", "scenario", "year", "reference_path", "scenario_path", "scenario_difference", "bounded_flag", "main_driver"
        ),
        6,
    )


@query(
    "scenario_compare",
    rsql(
        """SELECT entity, model, year, a.scenario_path AS scenario_path_a, b.scenario_path AS scenario_path_b, a.scenario_path - b.scenario_path AS scenario_path_a_minus_b
           FROM rec a JOIN rec b USING (entity, model, year) WHERE a.scenario = 'remote_work_saves_time' AND b.scenario = 'digital_distraction_crowds_out'""",
        *REC_CTES, doubles="scenario_path_a scenario_path_b scenario_path_a_minus_b", digits=6,
    ),
)
def scenario_compare(spark, sf_dir):
    out = SC.compare_scenarios(
        records(spark, sf_dir), ["entity", "model", "year"], "scenario", "remote_work_saves_time", "digital_distraction_crowds_out", ["scenario_path"]
    )
    return rounded(out, 6)


@query(
    "path_series",
    rsql(
        f"""SELECT DISTINCT r.entity, r.model, r.scenario, c.year, c.rate AS value, 'observed' AS kind FROM rec r JOIN lastp c ON r.entity = c.entity
           UNION ALL SELECT entity, model, scenario, year, scenario_path, 'forecast' FROM rec WHERE year <= {END}""",
        *REC_CTES, doubles="value", digits=6,
    ),
)
def path_series(spark, sf_dir):
    r = materialize(records(spark, sf_dir))
    history = covariates(spark, sf_dir).select("entity", "year", "rate")
    return rounded(SC.path_series(history, r, "entity", "year", "rate", "scenario_path", END, keys=["model", "scenario"]), 6)


@query(
    "projected_change",
    rsql(
        """SELECT r.entity, model, scenario, r.year, scenario_path - c.rate AS projected_change, (scenario_path - c.rate) / c.rate AS projected_change_share
           FROM rec r LEFT JOIN lastp c ON r.entity = c.entity""",
        *REC_CTES, doubles="projected_change projected_change_share", digits=6,
    ),
)
def projected_change(spark, sf_dir):
    out = SC.projected_change(records(spark, sf_dir), covariates(spark, sf_dir), "entity", "year", "rate", "scenario_path")
    return rounded(out.select("entity", "model", "scenario", "year", "projected_change", "projected_change_share"), 6)


DELTAS = {"remote": 0.01, "distraction": 0.005, "online": -0.002, "inPerson": 0.004, "care": 0.003}


def profile_sql(part: str) -> str:
    return "CASE scenario " + " ".join(f"WHEN '{s}' THEN {p[part]}" for s, p in specs.SLIDER_PROFILES.items()) + " ELSE 1.0 END"


@query(
    "slider_adjustment",
    rsql(
        f"""SELECT entity, model, scenario, year, CASE WHEN scenario = 'reference_path' THEN 0 ELSE least(greatest(raw * greatest(year - 2002, 0) / {END - 2002}.0, -8), 8) END AS adjustment FROM (
            SELECT r.*, 44 * {DELTAS['remote']} * (1 + l.rs * 4) * {profile_sql('remote')} - 34 * {DELTAS['distraction']} * (1 + l.ip / 200) * {profile_sql('distraction')}
             + 28 * {DELTAS['online']} * (0.9 + l.sd / 200) * {profile_sql('online')} + 26 * {DELTAS['inPerson']} * (0.9 + least(0.5, abs(l.dm / 1000) * 18)) * {profile_sql('inPerson')}
             - 40 * {DELTAS['care']} * (1 + l.rs * 3) * {profile_sql('care')} AS raw FROM rec r JOIN lastp l ON l.entity = r.entity)""",
        *REC_CTES, doubles="adjustment", digits=10,
    ),
)
def slider_adjustment(spark, sf_dir):
    last = J.latest_rows(covariates(spark, sf_dir), ["entity"], ["year"]).select("entity", *SHORT.values())
    rows = records(spark, sf_dir).join(last, "entity")
    raw = SC.slider_raw_adjustment(
        "scenario", DELTAS, share=F.col(SHARE), dating=F.col(SHORT["sd"]), growth=F.col(SHORT["dm"]) / 1000, genai=F.col(SHORT["ip"])
    )
    return rounded(rows.select("entity", "model", "scenario", "year", W.ramped_adjustment(raw, "year", 2002, END).alias("adjustment")), 10)


def added_sql() -> dict[str, str]:
    d = DELTAS
    s = "(1 + l.rs * 3)"
    return {
        "mechanism_remote_work_flexibility": f"{profile_sql('remote')} * (15 * {d['remote']} * {s} + 8 * {d['inPerson']})",
        "mechanism_digital_distraction": f"{profile_sql('distraction')} * (-14 * {d['distraction']})",
        "mechanism_online_matching": f"{profile_sql('online')} * (12 * ({d['online']}))",
        "mechanism_in_person_social": f"{profile_sql('inPerson')} * (11 * {d['inPerson']} - 3 * {d['distraction']})",
        "mechanism_care_burden": f"{profile_sql('care')} * (-16 * {d['care']} - 4 * {d['remote']})",
    }


@query(
    "mechanism_with_user_deltas",
    rsql(
        "SELECT r.entity, model, scenario, r.year, " + ", ".join(f"r.{m} + CASE WHEN scenario = 'reference_path' THEN 0 ELSE {x} END AS {m}" for m, x in added_sql().items())
        + " FROM rec r JOIN lastp l ON l.entity = r.entity",
        *REC_CTES, doubles=MECH_NAMES, digits=6,
    ),
)
def mechanism_with_user_deltas(spark, sf_dir):
    last = J.latest_rows(covariates(spark, sf_dir), ["entity"], ["year"]).select("entity", SHARE)
    rows = records(spark, sf_dir).join(last, "entity")
    new = SC.slider_mechanisms("scenario", DELTAS, F.col(SHARE))
    return rounded(rows.withColumns(new).select("entity", "model", "scenario", "year", *specs.MECHANISMS), 6)


# --- audits ----------------------------------------------------------------------------------------

BR = f"(reference_path >= {HIGH} - 0.001 OR reference_path <= {LOW} + 0.001)"
BS = f"(scenario_path >= {HIGH} - 0.001 OR scenario_path <= {LOW} + 0.001)"
ONE = "CASE WHEN {0} THEN 1.0::DOUBLE ELSE 0.0 END"


def share(cond: str) -> str:
    return f"avg({ONE.format(cond)})"


@query(
    "bound_share",
    rsql(
        f"""SELECT *, c + f AS bound_share, c + f >= 0.25 AS bounded_heavily FROM (SELECT model, {share(f'reference_path >= {HIGH} - 0.001')} AS c, {share(f'reference_path <= {LOW} + 0.001')} AS f
            FROM rec WHERE scenario = 'reference_path' GROUP BY model)""".replace("SELECT *, c", "SELECT model, c AS bound_share_ceiling, f AS bound_share_floor, c"),
        *REC_CTES, doubles="bound_share bound_share_ceiling bound_share_floor", digits=6,
    ),
)
def bound_share(spark, sf_dir):
    r = records(spark, sf_dir).filter("scenario = 'reference_path'")
    return rounded(AU.bound_share(r, ["model"], "reference_path", low=LOW, high=HIGH), 6)


@query(
    "bound_share_by_model_year",
    rsql(
        f"""SELECT geography_type, model, year, count(*) AS n_rows, count(*) FILTER (WHERE {BR}) AS bounded_reference, count(*) FILTER (WHERE {BS}) AS bounded_scenario,
               {share(BR)} AS share_bounded_reference, {share(BS)} AS share_bounded_scenario FROM rec GROUP BY ALL""",
        *REC_CTES, doubles="share_bounded_reference share_bounded_scenario", digits=6,
    ),
)
def bound_share_by_model_year(spark, sf_dir):
    return rounded(AU.bound_share_by_year(records(spark, sf_dir), ["geography_type", "model", "year"], low=LOW, high=HIGH), 6)


@query(
    "bound_share_by_scenario_year",
    rsql(
        f"""SELECT model, scenario, year, {share(BR)} AS share_reference_bounded, {share(BS)} AS share_scenario_bounded, {share(f'scenario_difference = 0 AND {BR} AND {BS}')} AS share_zero_due_to_bound
            FROM rec GROUP BY ALL""",
        *REC_CTES, doubles="share_reference_bounded share_scenario_bounded share_zero_due_to_bound", digits=6,
    ),
)
def bound_share_by_scenario_year(spark, sf_dir):
    return rounded(AU.bound_share_by_scenario(records(spark, sf_dir), ["model", "scenario", "year"], low=LOW, high=HIGH), 6)


@query(
    "nonzero_effect_audit",
    rsql(
        """SELECT model, scenario, year, count(*) AS n_rows, count(d) AS nonmissing, count(*) FILTER (WHERE abs(d) > 1e-12) AS nonzero_1e12, count(*) FILTER (WHERE abs(d) > 1e-8) AS nonzero_1e8,
             count(*) FILTER (WHERE abs(d) > 1e-6) AS nonzero_1e6, count(*) FILTER (WHERE round(abs(d), 3) > 0) AS visible_nonzero_3dp, min(d) AS min_difference, avg(d) AS mean_difference, max(d) AS max_difference,
             count(*) FILTER (WHERE d > 0) AS positive, count(*) FILTER (WHERE d < 0) AS negative, count(*) FILTER (WHERE d = 0) AS zero, count(*) FILTER (WHERE abs(d) < 0.05) AS near_zero
           FROM (SELECT *, scenario_difference AS d FROM rec) GROUP BY model, scenario, year""",
        *REC_CTES, doubles="min_difference mean_difference max_difference", digits=6,
    ),
)
def nonzero_effect_audit(spark, sf_dir):
    return rounded(AU.nonzero_effects(records(spark, sf_dir), ["model", "scenario", "year"], "scenario_difference", tolerance=0.05), 6)


@query(
    "nonzero_survival_by_bound",
    rsql(
        f"""SELECT model, scenario, year, count(*) AS n_rows, count(*) FILTER (WHERE NOT {BR} AND NOT {BS}) AS unbounded_rows,
              avg(CASE WHEN abs(scenario_difference) > 1e-12 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE NOT {BR} AND NOT {BS}) AS share_nonzero_among_unbounded,
              {share(f'abs(scenario_difference) <= 1e-12 AND reference_path <= {LOW} + 0.001 AND scenario_path <= {LOW} + 0.001')} AS share_zero_both_floor,
              {share(f'abs(scenario_difference) <= 1e-12 AND ((reference_path <= {LOW} + 0.001 AND scenario_path <= {LOW} + 0.001) OR (reference_path >= {HIGH} - 0.001 AND scenario_path >= {HIGH} - 0.001))')} AS share_zero_both_bound
            FROM rec GROUP BY model, scenario, year""",
        *REC_CTES, doubles="share_nonzero_among_unbounded share_zero_both_floor share_zero_both_bound", digits=6,
    ),
)
def nonzero_survival_by_bound(spark, sf_dir):
    return rounded(AU.nonzero_survival(records(spark, sf_dir), ["model", "scenario", "year"], low=LOW, high=HIGH), 6)


INPUTS = ["mechanism_remote_work_flexibility", "mechanism_digital_distraction", "mechanism_care_burden"]


@query(
    "scenario_diagnostics",
    rsql(
        f"""SELECT * EXCLUDE (earlier), CASE WHEN scenario = 'remote_work_saves_time' AND earlier < -0.01 THEN 'a former model gave the opposite sign' WHEN share_below_005 >= 0.8 AND input_change < 0.05 THEN 'inputs barely change' WHEN share_below_005 >= 0.8 AND input_dispersion < 0.02 THEN 'inputs move alike everywhere'
                 WHEN share_below_005 >= 0.8 THEN 'adjustment is modest' ELSE 'inputs vary enough for a visible spread' END AS diagnostic_reason FROM (
            SELECT model, scenario, year, min(d) AS min_difference, max(d) AS max_difference, avg(d) AS mean_difference, stddev_pop(d) AS std_difference,
               count(DISTINCT round(d, 3)) AS distinct_3dp, count(*) FILTER (WHERE d > 0.05) AS positive_entities, count(*) FILTER (WHERE d < -0.05) AS negative_entities, count(*) FILTER (WHERE abs(d) < 0.05) AS near_zero_entities,
               {share('abs(d) < 0.05')} AS share_below_005, {share('abs(d) < 0.10')} AS share_below_010, {share('abs(d) < 0.50')} AS share_below_050,
               avg(({' + '.join(f'abs({m})' for m in INPUTS)}) / 3) AS input_change, ({' + '.join(f'stddev_pop({m})' for m in INPUTS)}) / 3 AS input_dispersion,
               avg(CASE WHEN model = 'baseline_recent_trend' THEN -d END) AS earlier
            FROM (SELECT *, scenario_difference AS d FROM rec) GROUP BY model, scenario, year)""",
        *REC_CTES, doubles="min_difference max_difference mean_difference std_difference share_below_005 share_below_010 share_below_050 input_change input_dispersion", digits=6,
    ),
)
def scenario_diagnostics(spark, sf_dir):
    """The former model's effect is the turned difference of one model; the other has none."""
    rows = records(spark, sf_dir).withColumn("earlier", F.when(F.col("model") == "baseline_recent_trend", -F.col("scenario_difference")))
    out = AU.scenario_diagnostics(
        rows, ["model", "scenario", "year"], "scenario_difference", INPUTS, earlier="earlier", revised=F.col("scenario") == "remote_work_saves_time"
    )
    return rounded(out, 6)


@query(
    "audit_summary",
    rsql(
        """SELECT count(*) AS n_rows, count(d) AS n_present, min(d) AS min_difference, max(d) AS max_difference, avg(d) AS mean_difference, stddev_pop(d) AS std_difference, count(DISTINCT round(d, 3)) AS distinct_3dp,
              count(*) FILTER (WHERE d > 0.05) AS positive, count(*) FILTER (WHERE d < -0.05) AS negative, count(*) FILTER (WHERE abs(d) <= 0.05) AS near_zero
           FROM (SELECT scenario_difference AS d FROM rec WHERE scenario = 'remote_work_saves_time' AND year = 2005)""",
        *REC_CTES, doubles="min_difference max_difference mean_difference std_difference", digits=6,
    ),
)
def audit_summary(spark, sf_dir):
    rows = C.slice_filter(records(spark, sf_dir), scenario="remote_work_saves_time", year=2005, model="all")
    return rounded(AU.audit_summary(rows, "scenario_difference", tolerance=0.05), 6)


METRICS = """scored AS (SELECT entity, region, year, model, rate AS actual, CASE model WHEN 'baseline_last_observed' THEN l1 ELSE l1 + coalesce(l1 - l2, 0) END AS predicted,
      CASE WHEN year >= 2001 THEN 'test' WHEN year = 2000 THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT *, lag(rate) OVER (PARTITION BY entity ORDER BY year) AS l1, lag(rate, 2) OVER (PARTITION BY entity ORDER BY year) AS l2 FROM covp),
         (VALUES ('baseline_last_observed'), ('baseline_recent_trend')) m(model)),
  met AS (SELECT model, split, CASE WHEN grouping(entity) = 0 THEN 'entity' WHEN grouping(region) = 0 THEN 'region' WHEN grouping(period) = 0 THEN 'period' ELSE 'overall' END AS group_type,
      coalesce(CASE WHEN grouping(entity) = 0 THEN entity END, CASE WHEN grouping(region) = 0 THEN region END, CASE WHEN grouping(period) = 0 THEN period END, 'all') AS group_name,
      sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(predicted - actual)) AS mae, avg(abs((predicted - actual) / nullif(actual, 0))) AS mape,
      CASE WHEN count(*) > 1 THEN 1 - sum((predicted - actual) * (predicted - actual)) / nullif(var_pop(actual) * count(*), 0) END AS r_squared, count(*) AS n_obs
    FROM (SELECT *, CASE WHEN year < 1999 THEN 'before' ELSE 'after' END AS period FROM scored WHERE predicted IS NOT NULL AND actual IS NOT NULL)
    GROUP BY GROUPING SETS ((model, split), (model, split, entity), (model, split, region), (model, split, period)))"""


def naive_predictions(spark, sf_dir):
    p = materialize(covariates(spark, sf_dir).select("entity", "region", "year", "rate"))
    lagged = W.temporal_split(W.lag_features(p, ["rate"], "entity", "year", lags=(1, 2), rolling=None), "year")
    models = W.naive_baselines("rate_lag1", "rate_lag2")
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), c.alias("predicted")) for m, c in models.items()])
    return lagged.select("entity", "region", "year", "split", F.col("rate").alias("actual"), F.inline(pairs))


def metric_table(spark, sf_dir):
    return AU.error_metrics(
        naive_predictions(spark, sf_dir), ["model", "split"], entity="entity", region="region", year="year", actual="actual",
        predicted="predicted", split_year=1999,
    )


@query("error_metrics_grouping_sets", sql("SELECT * FROM met", GEO, BASE[1], COVP, METRICS, doubles="rmse mae mape r_squared", digits=5))
def error_metrics_grouping_sets(spark, sf_dir):
    return rounded(metric_table(spark, sf_dir), 5)


@query(
    "metrics_pivot",
    sql(
        "SELECT model, " + ", ".join(f"max({v}) FILTER (WHERE split = '{s}') AS {s}_{v}" for s in ("validation", "test") for v in ("rmse", "mae", "r_squared"))
        + " FROM met WHERE group_type = 'overall' GROUP BY model",
        GEO, BASE[1], COVP, METRICS, doubles="validation_rmse validation_mae validation_r_squared test_rmse test_mae test_r_squared", digits=5,
    ),
)
def metrics_pivot(spark, sf_dir):
    overall = metric_table(spark, sf_dir).filter("group_type = 'overall'")
    return rounded(AU.metrics_side_by_side(overall, "model", "split", ["validation", "test"], ["rmse", "mae", "r_squared"]), 5)


@query(
    "mean_abs_error_topn",
    sql(
        "SELECT entity, avg(abs(predicted - actual)) AS mean_abs_error FROM scored WHERE predicted IS NOT NULL GROUP BY entity ORDER BY 2 DESC, 1 LIMIT 15",
        GEO, BASE[1], COVP, METRICS, doubles="mean_abs_error", digits=6,
    ),
)
def mean_abs_error_topn(spark, sf_dir):
    return rounded(AU.mean_abs_error_top(naive_predictions(spark, sf_dir), "entity", "actual", "predicted"), 6)


RELY = f"""rel AS (SELECT geography_type, model, count(*) AS n_rows, {share(f'reference_path <= {LOW} + 0.001')} AS reference_lower_share, {share(f'reference_path >= {HIGH} - 0.001')} AS reference_upper_share,
      {share(BS)} AS scenario_bound_share, {share(f'scenario_difference = 0 AND {BR} AND {BS}')} AS same_bound_zero_share, 1.0::DOUBLE AS coverage_share FROM rec GROUP BY ALL),
  peak AS (SELECT geography_type, model, s AS peak_bound_share, year AS peak_bound_year FROM (SELECT *, row_number() OVER (PARTITION BY geography_type, model ORDER BY s DESC, year) AS k FROM
      (SELECT geography_type, model, year, {share(BR)} AS s FROM rec GROUP BY ALL)) WHERE k = 1)"""


@query(
    "model_reliability_table",
    rsql(
        """SELECT r.*, p.peak_bound_share, p.peak_bound_year, m.rmse AS test_rmse, m.r_squared AS test_r_squared, reference_lower_share + reference_upper_share AS reference_bound_share,
              coalesce(m.r_squared <= 0, false) AS negative_test_r2, CASE WHEN reference_lower_share + reference_upper_share > 0.2 OR coalesce(m.r_squared <= 0, false) THEN 'USE CAUTION' ELSE 'AVAILABLE' END AS status
           FROM rel r JOIN peak p USING (geography_type, model) LEFT JOIN (SELECT * FROM met WHERE split = 'test' AND group_type = 'overall') m ON r.model = m.model""",
        *REC_CTES, METRICS, RELY,
        doubles="reference_lower_share reference_upper_share scenario_bound_share same_bound_zero_share coverage_share peak_bound_share test_rmse test_r_squared reference_bound_share", digits=5,
    ),
)
def model_reliability_table(spark, sf_dir):
    metrics = metric_table(spark, sf_dir).filter("split = 'test' AND group_type = 'overall'")
    return rounded(
        AU.reliability_table(records(spark, sf_dir), metrics, geography="geography_type", model="model", year="year", low=LOW, high=HIGH), 5
    )


@query(
    "attach_reliability",
    rsql(
        f"""SELECT b.model, b.c AS bound_share_ceiling, b.f AS bound_share_floor, b.c + b.f AS bound_share, b.c + b.f >= 0.25 AS bounded_heavily, m.r_squared AS test_r_squared,
               NOT (b.c + b.f >= 0.25) AND coalesce(m.r_squared > 0, true) AS reliable,
               CASE WHEN b.c + b.f >= 0.25 THEN 'most forecasts sit on a bound, so scenario differences are suppressed' WHEN NOT coalesce(m.r_squared > 0, true) THEN 'held-out fit is weak' ELSE 'usable benchmark' END AS performance_note
            FROM (SELECT model, {share(f'reference_path >= {HIGH} - 0.001')} AS c, {share(f'reference_path <= {LOW} + 0.001')} AS f FROM rec GROUP BY model) b
            LEFT JOIN (SELECT * FROM met WHERE split = 'test' AND group_type = 'overall') m ON b.model = m.model""",
        *REC_CTES, METRICS, doubles="bound_share_ceiling bound_share_floor bound_share test_r_squared", digits=5,
    ),
)
def attach_reliability(spark, sf_dir):
    r = materialize(records(spark, sf_dir))
    metrics = metric_table(spark, sf_dir).filter("split = 'test' AND group_type = 'overall'")
    models = r.select("model").distinct()
    return rounded(AU.attach_reliability(models, AU.bound_share(r, ["model"], "reference_path", low=LOW, high=HIGH), metrics, "model"), 5)


@query(
    "impact_direction_summary",
    rsql(
        """SELECT *, CASE WHEN mean_difference > tolerance THEN 'raises' WHEN mean_difference < -tolerance THEN 'lowers' ELSE 'stays close' END AS direction FROM (
           SELECT geography_type, model, scenario, year, avg(d) AS mean_difference, count(*) FILTER (WHERE d > t) AS n_above, count(*) FILTER (WHERE d < -t) AS n_below, count(*) FILTER (WHERE abs(d) <= t) AS n_near, max(t) AS tolerance
           FROM (SELECT *, scenario_difference AS d, CASE WHEN geography_type = 'msa' THEN 0.005::DOUBLE ELSE 0.05 END AS t FROM rec) GROUP BY geography_type, model, scenario, year)""",
        *REC_CTES, doubles="mean_difference tolerance", digits=6,
    ),
)
def impact_direction_summary(spark, sf_dir):
    return rounded(AU.impact_direction(records(spark, sf_dir), ["geography_type", "model", "scenario", "year"], "scenario_difference", "geography_type"), 6)


@query(
    "consistency_checks",
    rsql(
        """SELECT 'coverage' AS rule, concat_ws('|', model, scenario, year) AS detail, count(DISTINCT entity) AS n FROM broken GROUP BY model, scenario, year HAVING count(DISTINCT entity) <> 25
           UNION ALL SELECT 'missing', 'main_driver', count(*) FILTER (WHERE main_driver IS NULL) FROM broken HAVING count(*) FILTER (WHERE main_driver IS NULL) > 0
           UNION ALL SELECT 'missing', 'scenario_path', count(*) FILTER (WHERE scenario_path IS NULL) FROM broken HAVING count(*) FILTER (WHERE scenario_path IS NULL) > 0
           UNION ALL SELECT 'identity', concat_ws('|', model, scenario, year), count(*) FROM broken WHERE abs((scenario_path - reference_path) - scenario_difference) > 1e-8 GROUP BY model, scenario, year""",
        *REC_CTES,
        """broken AS (SELECT entity, model, scenario, year, reference_path, scenario_path, CASE WHEN entity = '11' THEN scenario_difference + 1 ELSE scenario_difference END AS scenario_difference,
              CASE WHEN entity <> '07' THEN main_driver END AS main_driver FROM rec WHERE NOT (entity = '03' AND year = 2004))""",
    ),
)
def consistency_checks(spark, sf_dir):
    """Records with planted faults: a lost cell, a wrong difference, a missing driver; every one is reported."""
    r = materialize(records(spark, sf_dir))
    planted = r.filter("NOT (entity = '03' AND year = 2004)").withColumns(
        {
            "scenario_difference": F.when(F.col("entity") == "11", F.col("scenario_difference") + 1).otherwise(F.col("scenario_difference")),
            "main_driver": F.when(F.col("entity") != "07", F.col("main_driver")),
        }
    )
    expected = table(spark, sf_dir, "nation").count()
    return AU.consistency_checks(
        planted, coverage_keys=["model", "scenario", "year"], entity="entity", expected=expected, required=["main_driver", "scenario_path"]
    )


@query(
    "value_domain",
    rsql(
        """SELECT scenario, year, min(d) = max(d) AS is_constant, CASE WHEN min(d) = max(d) THEN min(d) END AS constant_value, -greatest(max(abs(d)), 0.001) AS zmin, greatest(max(abs(d)), 0.001) AS zmax, 'difference' AS outcome
           FROM (SELECT *, scenario_difference AS d FROM rec) GROUP BY scenario, year
           UNION ALL SELECT scenario, year, min(d) = max(d), CASE WHEN min(d) = max(d) THEN min(d) END, CASE WHEN min(d) = max(d) THEN min(d) - greatest(0.001, abs(min(d)) * 0.001) ELSE min(d) END,
             CASE WHEN min(d) = max(d) THEN max(d) + greatest(0.001, abs(min(d)) * 0.001) ELSE max(d) END, 'path' FROM (SELECT *, scenario_path AS d FROM rec) GROUP BY scenario, year""",
        *REC_CTES, doubles="constant_value zmin zmax", digits=6,
    ),
)
def value_domain(spark, sf_dir):
    r = materialize(records(spark, sf_dir))
    keys = ["scenario", "year"]
    a = AU.value_domain(r, keys, "scenario_difference", symmetric=True).withColumn("outcome", F.lit("difference"))
    return rounded(a.unionByName(AU.value_domain(r, keys, "scenario_path", symmetric=False).withColumn("outcome", F.lit("path"))), 6)


@query(
    "filter_funnel",
    rsql(
        """SELECT count(*) AS rows_loaded, count(*) FILTER (WHERE model = 'baseline_recent_trend') AS after_model, count(*) FILTER (WHERE model = 'baseline_recent_trend' AND year >= 2004) AS after_year,
              count(*) FILTER (WHERE model = 'baseline_recent_trend' AND year >= 2004 AND region = 'ASIA') AS after_region,
              count(scenario_difference) FILTER (WHERE model = 'baseline_recent_trend' AND year >= 2004 AND region = 'ASIA') AS n_effects,
              min(scenario_difference) FILTER (WHERE model = 'baseline_recent_trend' AND year >= 2004 AND region = 'ASIA') AS effect_min,
              avg(scenario_difference) FILTER (WHERE model = 'baseline_recent_trend' AND year >= 2004 AND region = 'ASIA') AS effect_mean,
              max(scenario_difference) FILTER (WHERE model = 'baseline_recent_trend' AND year >= 2004 AND region = 'ASIA') AS effect_max FROM rec""",
        *REC_CTES, doubles="effect_min effect_mean effect_max", digits=6,
    ),
)
def filter_funnel(spark, sf_dir):
    steps = [("model", F.col("model") == "baseline_recent_trend"), ("year", F.col("year") >= 2004), ("region", F.col("region") == "ASIA")]
    return rounded(AU.filter_funnel(records(spark, sf_dir), steps, "scenario_difference"), 6)


@query(
    "abs_contribution_by_bucket",
    rsql(
        "SELECT mechanism, sum(abs(x)) AS abs_contribution, sum(x) AS net_contribution FROM (SELECT unnest(["
        + ", ".join(f"'{m}'" for m in specs.MECHANISMS) + "]) AS mechanism, unnest([" + ", ".join(specs.MECHANISMS) + "]) AS x FROM rec) GROUP BY mechanism",
        *REC_CTES, doubles="abs_contribution net_contribution", digits=5,
    ),
)
def abs_contribution_by_bucket(spark, sf_dir):
    from ..operators.aggregate import unpivot

    long = unpivot(records(spark, sf_dir), ["entity"], list(specs.MECHANISMS), "name", "x")
    return rounded(AU.contribution_by_bucket(long, F.col("name"), "mechanism", "x"), 5)


@query(
    "preferred_else_first",
    rsql(
        """SELECT geography_type, year, arg_min(model, CASE WHEN model = 'baseline_recent_trend' THEN 0 ELSE 1 END) FILTER (WHERE ok) AS chosen FROM
           (SELECT geography_type, year, model, avg(scenario_difference) > -0.02 AS ok FROM rec WHERE scenario = 'digital_distraction_crowds_out' GROUP BY ALL) GROUP BY geography_type, year""",
        *REC_CTES,
    ),
)
def preferred_else_first(spark, sf_dir):
    r = records(spark, sf_dir).filter("scenario = 'digital_distraction_crowds_out'")
    options = r.groupBy("geography_type", "year", "model").agg((F.avg("scenario_difference") > -0.02).alias("ok"))
    return AU.preferred_else_first(options, ["geography_type", "year"], "model", "model", "ok", "baseline_recent_trend")


@query(
    "scenario_rankings",
    rsql(
        """SELECT * FROM (
             SELECT model, scenario, entity, d, CAST(row_number() OVER (PARTITION BY model, scenario ORDER BY d DESC, entity_name) AS INTEGER) AS rank, 'upward' AS ranking_group FROM q WHERE d > 0.05
             UNION ALL SELECT model, scenario, entity, d, CAST(row_number() OVER (PARTITION BY model, scenario ORDER BY d, entity_name) AS INTEGER), 'downward' FROM q WHERE d < -0.05
             UNION ALL SELECT model, scenario, entity, d, CAST(row_number() OVER (PARTITION BY model, scenario ORDER BY abs(d), entity_name) AS INTEGER), 'closest' FROM q) WHERE rank <= 5""",
        *REC_CTES, "q AS (SELECT model, scenario, entity, entity_name, round(scenario_difference, 6) + 0.0 AS d FROM rec WHERE year = 2005 AND scenario <> 'reference_path')", doubles="d", digits=6,
    ),
)
def scenario_rankings(spark, sf_dir):
    r = records(spark, sf_dir).filter("year = 2005 AND scenario <> 'reference_path'")
    rows = rounded(r.select("model", "scenario", "entity", "entity_name", F.col("scenario_difference").alias("d")), 6)
    return R.direction_rankings(materialize(rows), ["model", "scenario"], "d", "entity_name", tolerance=0.05).drop("entity_name")


# --- documents -------------------------------------------------------------------------------------


@query(
    "entity_documents",
    sql(
        """SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS entity, n_name, g.latest_year, g.latest_price, coalesce(len(g.s), 0) AS n_points, coalesce(array_to_string(g.s, ','), '') AS points
           FROM nation LEFT JOIN (SELECT entity, max(year) FILTER (WHERE price_g IS NOT NULL) AS latest_year, round(arg_max(price_g, year) FILTER (WHERE price_g IS NOT NULL), 4) + 0.0 AS latest_price,
             list(year || ':' || n_orders ORDER BY year) AS s FROM gaps WHERE nk % 6 <> 5 GROUP BY entity) g ON g.entity = lpad(CAST(n_nationkey AS VARCHAR), 2, '0')""",
        *GAPPED,
    ),
)
def entity_documents(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").select(C.pad_code("n_nationkey", 2).alias("entity"), "n_name")
    # some nations have no panel rows and must stay
    p = gaps(spark, sf_dir).withColumn("entity", F.when(F.col("nk") % 6 != 5, F.col("entity")))
    docs = PB.entity_documents(dim, p, "entity", "year", ["price_g"], ["n_orders", "price_g"], ["n_name"])
    points = F.transform("series", lambda s: F.concat(s["year"].cast("string"), F.lit(":"), s["n_orders"].cast("string")))
    return rounded(
        docs.select(
            "entity", "n_name", F.col("latest.price_g_year").alias("latest_year"), F.col("latest.price_g").alias("latest_price"),
            F.size("series").cast("long").alias("n_points"), F.array_join(points, ",").alias("points"),
        )
    )


SHARD_BYTES = 48 << 10  # small here, so that every scale of the test tables makes several files


@query(
    "sharded_documents",
    sql(
        f"""SELECT format('part-{{:06d}}', shard) AS shard, min(customer) AS first_entity, max(customer) AS last_entity, count(*) AS n_entities, sum(bytes)::BIGINT AS bytes, sum(bytes)::BIGINT AS file_bytes,
              count(*) AS n_lines FROM (SELECT *, ((sum(bytes) OVER (ORDER BY customer) - bytes) // ({SHARD_BYTES} - max(bytes) OVER ()))::BIGINT AS shard FROM texts) GROUP BY shard""",
        CUSTOMERS,
        """texts AS (SELECT customer, (strlen('{"customer":' || customer || ',"latest":{"revenue":' || arg_max(cents, year) || ',"revenue_year":' || max(year) || '},"series":['
              || string_agg('{"year":' || year || ',"n_orders":' || n_orders || ',"revenue":' || cents || '}', ',' ORDER BY year) || ']}') + 1)::BIGINT AS bytes
            FROM (SELECT *, CAST(round(revenue * 100) AS BIGINT) AS cents FROM customer_panel) GROUP BY customer)""",
    ),
)
def sharded_documents(spark, sf_dir):
    """A document per customer, dealt to files below a limit; the manifest against the files as they were written."""
    p = customer_panel(spark, sf_dir).withColumn("revenue", cents("revenue"))
    dim = p.select("customer").distinct()
    docs = materialize(PB.documents_json(PB.entity_documents(dim, p, "customer", "year", ["revenue"], ["n_orders", "revenue"]), "customer"))
    path = scratch(spark, "shards")
    PB.write_shards(docs, "customer", path, limit=SHARD_BYTES)
    lines = spark.read.schema("value string, shard string").text(f"{path}/files")
    files = lines.groupBy("shard").agg(F.max("_metadata.file_size").alias("file_bytes"), F.count(F.lit(1)).alias("n_lines"), F.count_distinct("_metadata.file_path").alias("n_files"))
    manifest = spark.read.schema("shard string, first_entity bigint, last_entity bigint, n_entities bigint, bytes bigint").json(f"{path}/manifest")
    small = (F.col("n_files") == 1) & (F.col("file_bytes") < SHARD_BYTES)
    checked = F.when(small, F.col("file_bytes")).otherwise(F.raise_error(F.concat(F.lit("too large or split: "), "shard")))
    return manifest.join(files, "shard", "full").select("shard", "first_entity", "last_entity", "n_entities", "bytes", checked.alias("file_bytes"), "n_lines")
