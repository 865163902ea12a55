"""Queries of the weighted and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import aggregate as A
from ..operators import windows as W
from ..plans import specs
from ..session import materialize
from .base import BASE, GAPPED, GEO, MICRO, gaps, geo, micro, cents, panel, query, rounded, sql, table
from .columns import CODED, FLAG_SQL, activity_flags, coded_lines

LINES = (GEO, MICRO)


@query(
    "weighted_mean",
    """SELECT l_suppkey, round(sum(l_quantity * x) / nullif(sum(CASE WHEN x IS NOT NULL THEN l_quantity END), 0), 4) + 0.0 AS mean_price
       FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS x FROM lineitem) GROUP BY l_suppkey""",
)
def weighted_mean(spark, sf_dir):
    x = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    out = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(A.weighted_mean(x, "l_quantity").alias("mean_price"))
    return rounded(out)


@query(
    "weighted_share",
    """SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) + 0.0 AS accepted_share
       FROM lineitem GROUP BY l_suppkey""",
)
def weighted_share(spark, sf_dir):
    share = A.weighted_share(F.col("l_returnflag") == "A", "l_quantity")
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(share.alias("accepted_share")), 6)


def ci_sql(keys: str, source: str, x: str, w: str, name: str = "x") -> str:
    """Two-pass mean, standard error and interval."""
    joined = " AND ".join(f"t.{k} IS NOT DISTINCT FROM m.{k}" for k in keys.split(", "))
    return f"""SELECT {keys}, n AS sample_size, mu AS {name}, sqrt(v / greatest(neff, 1)) AS {name}_se,
        mu - 1.96 * sqrt(v / greatest(neff, 1)) AS {name}_ci_low, mu + 1.96 * sqrt(v / greatest(neff, 1)) AS {name}_ci_high
      FROM (SELECT {", ".join("t." + k for k in keys.split(", "))}, any_value(m.n) AS n, any_value(m.mu) AS mu, any_value(m.neff) AS neff,
                   sum(t.{w} * (t.{x} - m.mu) * (t.{x} - m.mu)) / sum(CASE WHEN t.{x} IS NOT NULL THEN t.{w} END) AS v
            FROM {source} t JOIN (SELECT {keys}, count(*) AS n, sum({w} * {x}) / sum(CASE WHEN {x} IS NOT NULL THEN {w} END) AS mu,
                     pow(sum(CASE WHEN {x} IS NOT NULL THEN {w} END), 2) / sum(CASE WHEN {x} IS NOT NULL THEN {w} * {w} END) AS neff
                   FROM {source} GROUP BY {keys}) m ON {joined} GROUP BY {", ".join("t." + k for k in keys.split(", "))})"""


@query(
    "weighted_mean_ci",
    sql(
        ci_sql("entity, year", "micro", "l_extendedprice", "l_quantity", "price"),
        *LINES, doubles="price price_se price_ci_low price_ci_high",
    ),
)
def weighted_mean_ci(spark, sf_dir):
    lines = micro(spark, sf_dir).select("entity", "year", F.col("l_extendedprice").alias("price"), "l_quantity")
    return rounded(A.weighted_mean_ci(lines, ["entity", "year"], ["price"], "l_quantity"))


@query(
    "weighted_distribution",
    """WITH c AS (SELECT l_suppkey, nullif(l_returnflag, 'N') AS f, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
            s AS (SELECT *, w / sum(w) OVER (PARTITION BY l_suppkey) AS share FROM c)
       SELECT l_suppkey, string_agg(f || '=' || printf('%.4f', round(share, 4)), ',' ORDER BY f) AS shares FROM s GROUP BY l_suppkey""",
)
def weighted_distribution(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("f", F.nullif(F.col("l_returnflag"), F.lit("N")))
    out = A.weighted_distribution(lines, ["l_suppkey"], "f", "l_quantity", "m")
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", F.round(e["value"], 4))))
    return out.select("l_suppkey", F.array_join(pairs, ",").alias("shares"))


def measures():
    """Ten measures, each with its own sub-population."""
    flag = lambda c: C.flag_number(c)
    building, urgent = F.col("segment") == "BUILDING", F.col("o_orderpriority") == "1-URGENT"
    x = F.col("l_extendedprice")
    return [
        A.Measure("price_all", x),
        A.Measure("price_building", x, building),
        A.Measure("price_urgent", x, urgent),
        A.Measure("discount_urgent", F.col("l_discount"), urgent),
        A.Measure("accepted_share", flag(F.col("l_returnflag") == "A")),
        A.Measure("open_share_building", flag(F.col("l_linestatus") == "O"), building),
        A.Measure("large_share_urgent", flag(F.col("l_quantity") >= 40), urgent),
        A.Measure("tax_mid", F.col("l_tax"), F.col("l_quantity").between(18, 34)),
        A.Measure("urgent_share", flag(urgent)),
        A.Measure("price_not_returned", F.when(F.col("l_returnflag") != "R", x)),
    ]


def sub_sql(keys: str) -> str:
    w = "l_quantity"

    def mean(x: str, where: str = "true") -> str:
        return f"sum({w} * {x}) FILTER (WHERE {where} AND {x} IS NOT NULL) / nullif(sum({w}) FILTER (WHERE {where} AND {x} IS NOT NULL), 0)"

    def one(cond: str) -> str:
        return f"(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0 END)"

    b, u = "segment = 'BUILDING'", "o_orderpriority = '1-URGENT'"
    parts = {
        "price_all": mean("l_extendedprice"),
        "price_building": mean("l_extendedprice", b),
        "price_urgent": mean("l_extendedprice", u),
        "discount_urgent": mean("l_discount", u),
        "accepted_share": mean(one("l_returnflag = 'A'")),
        "open_share_building": mean(one("l_linestatus = 'O'"), b),
        "large_share_urgent": mean(one("l_quantity >= 40"), u),
        "tax_mid": mean("l_tax", "l_quantity BETWEEN 18 AND 34"),
        "urgent_share": mean(one(u)),
        "price_not_returned": mean("(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END)"),
    }
    return f"SELECT {keys}, count(*) AS sample_size, " + ", ".join(f"{e} AS {n}" for n, e in parts.items()) + f" FROM micro GROUP BY {keys}"


SUB_NAMES = "price_all price_building price_urgent discount_urgent accepted_share open_share_building large_share_urgent tax_mid urgent_share price_not_returned"


@query("subpopulation_panel", sql(sub_sql("entity, year"), *LINES, doubles=SUB_NAMES))
def subpopulation_panel(spark, sf_dir):
    return rounded(A.subpopulation_panel(micro(spark, sf_dir), ["entity", "year"], "l_quantity", measures()))


@query("partial_final_panel", sql(sub_sql("entity, year"), *LINES, doubles=SUB_NAMES))
def partial_final_panel(spark, sf_dir):
    """Three batches accumulated apart, then merged: the whole table once."""
    lines = micro(spark, sf_dir)
    batches = [lines.filter("year <= 1996"), lines.filter("year BETWEEN 1997 AND 1999"), lines.filter("year >= 2000")]
    partials = [A.panel_partials(b, ["entity", "year"], "l_quantity", measures()) for b in batches]
    return rounded(A.finish_partials(partials, ["entity", "year"], [m.name for m in measures()]))


@query(
    "exposure_weighted_panel",
    sql(
        """SELECT entity, year, count(*) AS sample_size,
             sum(l_quantity * r) / nullif(sum(CASE WHEN r IS NOT NULL THEN l_quantity END), 0) AS remote_share,
             sum(CASE WHEN r = 1 THEN l_quantity * h END) / nullif(sum(CASE WHEN r = 1 AND h IS NOT NULL THEN l_quantity END), 0) AS hours_among_remote,
             CAST(sum(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_discount AS DECIMAL(9,2))) AS DOUBLE) / sum(l_quantity) AS exposure_before,
             CAST(sum(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_tax AS DECIMAL(9,2))) AS DOUBLE) / sum(l_quantity) AS exposure_after,
             sum(CASE WHEN r IS NOT NULL THEN l_quantity ELSE 0 END) / sum(l_quantity) AS coverage_share
           FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.0 END AS r, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS h FROM micro)
           GROUP BY entity, year""",
        *LINES, doubles="remote_share hours_among_remote exposure_before exposure_after coverage_share", digits=6,
    ),
)
def exposure_weighted_panel(spark, sf_dir):
    remote = C.two_source_flag("l_returnflag", ("A", "R"), F.lit(None).cast("string"), ("", ""))
    rows = micro(spark, sf_dir).withColumns(
        {
            "r": remote, "h": C.below_sentinel("l_linenumber", 7),
            **{c: F.col(c).cast("decimal(9,2)") for c in ("l_quantity", "l_discount", "l_tax")},
        }
    )
    m = [
        A.Measure("remote_share", F.col("r")),
        A.Measure("hours_among_remote", F.col("h"), F.col("r") == 1),
        A.Measure("exposure_before", F.col("l_discount")),
        A.Measure("exposure_after", F.col("l_tax")),
        A.Measure("coverage_share", C.flag_number(F.col("r").isNotNull())),
    ]
    return rounded(A.subpopulation_panel(rows, ["entity", "year"], "l_quantity", m), 6)


DEMO = "demo AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'Female' WHEN 'R' THEN 'Male' END AS sex, CASE WHEN l_quantity BETWEEN 15 AND 24 THEN '15-24' WHEN l_quantity BETWEEN 25 AND 34 THEN '25-34' WHEN l_quantity BETWEEN 35 AND 44 THEN '35-44' WHEN l_quantity BETWEEN 45 AND 54 THEN '45-54' END AS age_group FROM micro)"


@query(
    "demographic_panel",
    sql(
        """SELECT entity, year, sex, age_group, count(*) AS sample_size,
                  sum(l_extendedprice * CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0 END) / sum(l_extendedprice) AS open_rate,
                  sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS mean_discount FROM demo GROUP BY entity, year, sex, age_group""",
        *LINES, DEMO, doubles="open_rate mean_discount", digits=6,
    ),
)
def demographic_panel(spark, sf_dir):
    rows = micro(spark, sf_dir).withColumns(
        {"sex": C.recode("l_returnflag", {"A": "Female", "R": "Male"}), "age_group": C.bin_ranges("l_quantity", specs.AGE_GROUPS)}
    )
    m = [A.Measure("open_rate", C.flag_number(F.col("l_linestatus") == "O")), A.Measure("mean_discount", F.col("l_discount"))]
    return rounded(A.subpopulation_panel(rows, ["entity", "year", "sex", "age_group"], "l_extendedprice", m), 6)


@query(
    "period_mean",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_discount * 100 / 100.0), 6) + 0.0 AS share FROM lineitem GROUP BY 1",
)
def period_mean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(A.period_mean(lines, F.year("l_shipdate"), F.col("l_discount") * 100, "share", percent=True), 6)


@query(
    "group_sum_zero",
    """SELECT l_returnflag, l_linestatus, coalesce(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0)::DOUBLE AS total
       FROM lineitem GROUP BY ALL""",
)
def group_sum_zero(spark, sf_dir):
    x = F.when(F.col("l_returnflag") == "A", cents("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((A.sum_or_zero(x) / F.lit(100.0)).alias("total"))


PERSON_MEASURES = {
    "screen_minutes": "is_screen_leisure_broad", "social_minutes": "is_socializing", "work_minutes": "is_work", "care_minutes": "is_unpaid_care",
}


@query(
    "event_to_person_rollup",
    sql(
        "SELECT o_orderkey, o_custkey, segment, geography_mode, "
        + ", ".join(f"s.{n}" for n in PERSON_MEASURES)
        + """ FROM (SELECT o_orderkey, o_custkey, c_mktsegment AS segment, 'entity_and_region_available' AS geography_mode FROM orders
                    LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0) p
              LEFT JOIN (SELECT l_orderkey, """
        + ", ".join(f"sum(CASE WHEN {FLAG_SQL[f]} THEN l_quantity ELSE 0 END) AS {n}" for n, f in PERSON_MEASURES.items())
        + " FROM coded GROUP BY 1) s ON p.o_orderkey = s.l_orderkey",
        CODED, doubles=" ".join(PERSON_MEASURES),
    ),
)
def event_to_person_rollup(spark, sf_dir):
    events = coded_lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    flags = activity_flags()
    persons = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    places = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("o_custkey"), F.col("c_mktsegment").alias("segment")
    )
    m = {n: C.masked("l_quantity", flags[f]) for n, f in PERSON_MEASURES.items()}
    return rounded(A.event_to_person(events, persons, places, case="o_orderkey", person_keys=["o_custkey"], measures=m))


RESP = """resp AS (SELECT region, entity, year, balance, s.minutes, o_totalprice AS weight FROM geo
           LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS minutes FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey)"""


def respondents(spark, sf_dir):
    minutes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("minutes"))
    return geo(spark, sf_dir).join(minutes, "o_orderkey", "left").select(
        "region", "entity", "year", "balance", "minutes", F.col("o_totalprice").alias("weight")
    )


def grain_sql(keys: str, grain: str, threshold: int | None) -> str:
    inner = ci_sql(keys, "resp", "minutes", "weight", "minutes")
    blank = f"CASE WHEN sample_size >= {threshold} THEN {{0}} END" if threshold else "{0}"
    status = f"CASE WHEN sample_size >= {threshold} THEN 'observed' ELSE 'pooled_or_modeled_required' END" if threshold else "'observed'"
    warning = f"CASE WHEN sample_size >= {threshold} THEN '' ELSE 'cell below the minimum sample; estimates hidden' END" if threshold else "''"
    dims = ", ".join(k if k in keys.split(", ") else f"NULL AS {k}" for k in ("year", "region", "entity"))
    cols = ", ".join(f"{blank.format(c)} AS {c}" for c in ("minutes", "minutes_se", "minutes_ci_low", "minutes_ci_high"))
    return f"SELECT {dims}, sample_size, {cols}, '{grain}' AS geography_type, {status} AS estimate_status, {warning} AS quality_warning FROM ({inner})"


GRAINS = [
    A.Grain("national", ("year",)),
    A.Grain("region", ("year", "region"), present=("region",)),
    A.Grain("state", ("year", "region", "entity"), present=("entity",), threshold=85),
]
CI_NAMES = "minutes minutes_se minutes_ci_low minutes_ci_high"


@query(
    "multi_grain_aggregate",
    sql(
        " UNION ALL ".join(
            [grain_sql("year", "national", None), grain_sql("year, region", "region", None), grain_sql("year, region, entity", "state", 85)]
        ),
        GEO, RESP, doubles=CI_NAMES,
    ),
)
def multi_grain_aggregate(spark, sf_dir):
    return rounded(A.multi_grain(respondents(spark, sf_dir), GRAINS, ["minutes"], "weight"))


@query("small_cell_suppression", sql(grain_sql("year, region, entity", "state", 85).replace("'state' AS geography_type, ", ""), GEO, RESP, doubles=CI_NAMES))
def small_cell_suppression(spark, sf_dir):
    fine = A.weighted_mean_ci(respondents(spark, sf_dir), ["year", "region", "entity"], ["minutes"], "weight")
    return rounded(A.suppress_small_cells(fine, ["minutes"], 85))


@query(
    "rate_per_thousand",
    sql(
        """SELECT o.entity, o.year, o.n AS events, p.n_orders, 1000.0 * o.n / p.n_orders AS rate
           FROM (SELECT entity, year, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM geo GROUP BY ALL) o
           LEFT JOIN panel p ON o.entity = p.entity AND o.year = p.year""",
        *BASE, doubles="rate",
    ),
)
def rate_per_thousand(spark, sf_dir):
    events = geo(spark, sf_dir).select("entity", "year", (F.col("o_orderstatus") == "F").cast("int").alias("events"))
    base = panel(spark, sf_dir).select("entity", "year", "n_orders")
    return rounded(A.rate_per_thousand(events, base, ["entity", "year"], "events", "n_orders", "rate"))


BAND_OF = {"1-URGENT": "15-19", "2-HIGH": "20-24", "3-MEDIUM": "25-29", "4-NOT SPECIFIED": "30-34", "5-LOW": "35-39"}
BANDS = "bands AS (SELECT entity, year, CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{b}'" for p, b in BAND_OF.items()) + """ END AS band,
          count(*) FILTER (WHERE o_orderstatus = 'F') AS events, count(*) AS n FROM geo GROUP BY ALL)"""


def bands(spark, sf_dir):
    return geo(spark, sf_dir).select(
        "entity", "year", C.recode("o_orderpriority", BAND_OF).alias("band"), (F.col("o_orderstatus") == "F").cast("int").alias("event")
    )


def band_rate_table(spark, sf_dir):
    b = bands(spark, sf_dir)
    size = b.groupBy("entity", "year", "band").agg(F.count(F.lit(1)).alias("n"))
    return A.band_rates(b, size, ["entity", "year"], "band", "event", "n", "rate")


@query(
    "banded_rate_sum",
    sql("SELECT entity, year, sum(events * 1.0 / n * 5) AS total_rate FROM bands GROUP BY ALL", GEO, BANDS, doubles="total_rate"),
)
def banded_rate_sum(spark, sf_dir):
    return rounded(A.banded_rate_sum(band_rate_table(spark, sf_dir), ["entity", "year"], "band", "rate", specs.BAND_WIDTHS, "total_rate"))


@query(
    "keyword_basket_mean",
    """WITH e AS (SELECT user_id % 25 AS entity, CAST(day(ts) AS INTEGER) AS period, event_type AS keyword,
                         (value / 100.0) * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x FROM events),
            b AS (SELECT entity, period, avg(x) FILTER (WHERE keyword IN ('click', 'view')) AS attention,
                         avg(x) FILTER (WHERE keyword = 'purchase') AS buying, avg(x) FILTER (WHERE keyword IN ('signup', 'nothing')) AS joining
                  FROM e GROUP BY ALL)
       SELECT entity, period, round(attention, 9) + 0.0 AS attention, round(buying, 9) + 0.0 AS buying, round(joining, 9) + 0.0 AS joining,
              round(list_avg([attention, buying, joining]), 9) + 0.0 AS composite FROM b""",
)
def keyword_basket_mean(spark, sf_dir):
    x = F.col("value") / 100.0 * F.get_json_object("props", "$.k").try_cast("double")
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 25).alias("entity"), F.dayofmonth(F.col("ts").cast("date")).alias("period"), "event_type", x.alias("x")
    )
    baskets = {"attention": ["click", "view"], "buying": ["purchase"], "joining": ["signup", "nothing"]}
    return rounded(A.keyword_baskets(e, ["entity", "period"], "event_type", F.col("x"), baskets, "composite"), 9)


@query(
    "global_zscore_mean",
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((l_quantity - mq) / sq + (l_discount - md) / sd + 0) / 3, 4) + 0.0 AS index FROM lineitem, s""",
)
def global_zscore_mean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(3.0))
    out = A.global_zscore_mean(lines, ["l_quantity", "l_discount", "constant"], "index")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "index"))


@query(
    "sample_weighted_yearly_mean",
    sql("SELECT year, sum(share_g * n_orders) / sum(n_orders) AS share FROM gaps WHERE share_g IS NOT NULL GROUP BY year", *GAPPED, doubles="share", digits=6),
)
def sample_weighted_yearly_mean(spark, sf_dir):
    return rounded(A.sample_weighted_mean(gaps(spark, sf_dir), ["year"], "share_g", "n_orders", "share"), 6)


@query(
    "total_and_growth",
    sql(
        """SELECT year, total, total / lag(total) OVER (ORDER BY year) - 1 AS growth FROM
           (SELECT year, sum(CAST(revenue AS DECIMAL(18,2)))::DOUBLE AS total FROM panel GROUP BY year)""",
        *BASE, doubles="total growth",
    ),
)
def total_and_growth(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("revenue", cents("revenue"))
    out = W.total_and_growth(rows, "year", "revenue")
    return rounded(out.withColumn("total", F.col("total") / F.lit(100.0)))


@query(
    "pivot_mean",
    sql(
        "SELECT entity, year, "
        + ", ".join(f"avg(1000.0 * events / n) FILTER (WHERE band = '{b}') AS rate_{b.replace('-', '_')}" for b in specs.BAND_WIDTHS)
        + " FROM bands GROUP BY ALL",
        GEO, BANDS, doubles=" ".join(f"rate_{b.replace('-', '_')}" for b in specs.BAND_WIDTHS),
    ),
)
def pivot_mean(spark, sf_dir):
    rates = band_rate_table(spark, sf_dir)
    return rounded(A.pivot_mean(rates, ["entity", "year"], "band", "rate", list(specs.BAND_WIDTHS), "rate_"))


@query(
    "source_quality_summary",
    """SELECT event_type AS source, arg_min(props, event_id) AS props, arg_min(user_id, event_id) AS first_user,
              CAST(max(month(ts)) AS INTEGER) AS latest_year, round(median(value), 4) + 0.0 AS median_sample_size FROM events GROUP BY 1""",
)
def source_quality_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), "event_id", "props", F.col("user_id").alias("first_user"),
        F.month(F.col("ts").cast("date")).alias("year"), "value",
    )
    return rounded(A.source_quality(e, "source", "event_id", first=["props", "first_user"], year="year", size="value"))


@query(
    "latest_nonnull",
    sql(
        "SELECT entity, max(year) FILTER (WHERE price_g IS NOT NULL) AS latest_year, arg_max(price_g, year) FILTER (WHERE price_g IS NOT NULL) AS latest_value FROM gaps GROUP BY entity",
        *GAPPED, doubles="latest_value",
    ),
)
def latest_nonnull(spark, sf_dir):
    year, value = A.latest_nonnull("price_g", "year")
    return rounded(gaps(spark, sf_dir).groupBy("entity").agg(year.alias("latest_year"), value.alias("latest_value")))


LATEST_SQL = """u AS (SELECT entity, year, unnest(['price_g', 'balance_g', 'share_g']) AS metric, unnest([price_g, balance_g, share_g]) AS value,
                CASE WHEN nk % 3 = 0 THEN 1 ELSE 0 END AS late FROM gaps),
       y AS (SELECT metric, year, avg(value) AS v, count(*) AS n FROM u WHERE value IS NOT NULL AND NOT (metric = 'share_g' AND year > 1999) GROUP BY ALL)"""


def late_gaps(spark, sf_dir):
    return gaps(spark, sf_dir).withColumn("share_g", F.when(F.col("year") <= 1999, F.col("share_g")))


@query(
    "latest_year_mean",
    sql(
        "SELECT metric, max(year) AS latest_year, arg_max(v, year) AS latest_value, arg_max(n, year) AS n_entities FROM y GROUP BY metric",
        *GAPPED, LATEST_SQL, doubles="latest_value",
    ),
)
def latest_year_mean(spark, sf_dir):
    return rounded(A.latest_year_means(late_gaps(spark, sf_dir), "year", ["price_g", "balance_g", "share_g"]))


@query(
    "kpi_summary",
    sql(
        """SELECT y.metric, coalesce(CASE WHEN y.metric = 'price_g' THEN 2001 END, max(y.year)) AS latest_year,
                  coalesce(CASE WHEN y.metric = 'price_g' THEN (SELECT sum(revenue) / sum(n_orders) FROM panel WHERE year = 2001) END, arg_max(v, y.year)) AS latest_value,
                  CASE WHEN y.metric = 'price_g' THEN 'national' ELSE 'entity_mean' END AS source_level FROM y GROUP BY y.metric""",
        *GAPPED, LATEST_SQL, doubles="latest_value",
    ),
)
def kpi_summary(spark, sf_dir):
    rows = materialize(late_gaps(spark, sf_dir))
    national = rows.groupBy("year").agg(C.safe_ratio(F.sum("revenue"), F.sum("n_orders")).alias("price_g"))
    return rounded(A.kpi_table(national, rows, "year", ["price_g", "balance_g", "share_g"]))


@query("value_counts", "SELECT nullif(source, 'web') AS source, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.nullif(F.col("source"), F.lit("web")).alias("source"))
    return A.value_counts(rows, "source")


@query(
    "ordered_distinct_labels",
    """WITH f AS (SELECT user_id, nullif(nullif(event_type, 'error'), 'view') AS v, min(event_id) AS i FROM events GROUP BY ALL)
       SELECT user_id, coalesce(string_agg(CASE v WHEN 'click' THEN 'mouse click' WHEN 'signup' THEN 'new user' ELSE v END, ', ' ORDER BY i), 'nothing known') AS labels
       FROM f GROUP BY user_id""",
)
def ordered_distinct_labels(spark, sf_dir):
    v = F.nullif(F.nullif(F.col("event_type"), F.lit("error")), F.lit("view"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", v.alias("v"))
    return A.ordered_labels(
        rows, ["user_id"], "v", "event_id", {"click": "mouse click", "signup": "new user"}, empty="nothing known", name="labels"
    )


@query(
    "two_level_string_agg",
    """WITH r AS (SELECT l_suppkey, p_type AS el, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS sc,
                         regexp_replace(printf('%.2f', CAST(p_size % 5 AS DOUBLE) / 2), '\\.?0+$', '') AS v
                  FROM lineitem JOIN part ON l_partkey = p_partkey),
            p AS (SELECT DISTINCT l_suppkey, el, sc, CASE WHEN sc IS NOT NULL THEN v END AS v FROM r),
            e AS (SELECT l_suppkey, el, string_agg(sc || '=' || v, ', ' ORDER BY sc, v) FILTER (WHERE sc IS NOT NULL) AS s FROM p GROUP BY ALL)
       SELECT l_suppkey, string_agg(CASE WHEN s IS NULL THEN el ELSE el || ' (' || s || ')' END, '; ' ORDER BY CASE WHEN s IS NULL THEN el ELSE el || ' (' || s || ')' END) AS skills
       FROM e GROUP BY l_suppkey""",
)
def two_level_string_agg(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("el"), X.format_value((F.col("p_size") % 5) / 2).alias("v")
    )
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_suppkey", "el", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("sc"), "v"
    )
    return A.two_level_text(rows, ["l_suppkey"], "el", "sc", "v", "skills")


@query(
    "flagged_label_agg",
    """WITH r AS (SELECT DISTINCT l_suppkey, CASE WHEN p_type <> split_part(p_brand, '#', 1) THEN p_type || ' (' || split_part(p_brand, '#', 1) || ')' ELSE p_type END
                  || CASE WHEN p_size > 40 AND p_retailprice > 1500 THEN ' [hot, in-demand]' WHEN p_size > 40 THEN ' [hot]' WHEN p_retailprice > 1500 THEN ' [in-demand]' ELSE '' END AS t
                  FROM lineitem JOIN part ON l_partkey = p_partkey)
       SELECT l_suppkey, string_agg(t, '; ' ORDER BY t) AS software FROM r GROUP BY l_suppkey""",
)
def flagged_label_agg(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("kind", F.split_part(F.col("p_brand"), F.lit("#"), F.lit(1)))
    label = A.flagged_label("p_type", "kind", {"hot": F.col("p_size") > 40, "in-demand": F.col("p_retailprice") > 1500})
    return A.joined_sorted(rows.select("l_suppkey", label.alias("t")), ["l_suppkey"], "t", "software")


@query(
    "count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT CASE WHEN l_quantity > 49 THEN l_suppkey END) AS n_filtered,
              count(CASE WHEN l_discount > 0 THEN 1 END) AS n_discounted FROM lineitem GROUP BY 1""",
)
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("n_suppliers"),
        F.count_distinct(F.when(F.col("l_quantity") > 49, F.col("l_suppkey"))).alias("n_filtered"),
        F.count(F.when(F.col("l_discount") > 0, 1)).alias("n_discounted"),
    )


@query(
    "yearly_mean_of_share",
    sql(
        """SELECT region, avg(urgent_share) FILTER (WHERE year = 1996) AS baseline, arg_max(m, year) AS latest, arg_max(m, year) - avg(urgent_share) FILTER (WHERE year = 1996) AS gap
           FROM (SELECT *, avg(urgent_share) OVER (PARTITION BY region, year) AS m FROM panel) GROUP BY region""",
        *BASE, doubles="baseline latest gap", digits=6,
    ),
)
def yearly_mean_of_share(spark, sf_dir):
    yearly = panel(spark, sf_dir).groupBy("region", "year").agg(F.avg("urgent_share").alias("m"))
    baseline, latest = F.max(F.when(F.col("year") == 1996, F.col("m"))), F.max_by("m", "year")
    return rounded(yearly.groupBy("region").agg(baseline.alias("baseline"), latest.alias("latest"), (latest - baseline).alias("gap")), 6)


