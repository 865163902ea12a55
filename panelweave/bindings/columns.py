"""Queries of the projection, cast and predicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import ordering
from ..plans import specs
from .base import BASE, GAPPED, GEO, gaps, geo, money_sum, panel, query, rounded, sql, table


@query(
    "coerce_numeric",
    """SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS brand_number, TRY_CAST(p_name AS DOUBLE) AS name_number,
              TRY_CAST(p_retailprice AS DOUBLE) AS price FROM part""",
)
def coerce_numeric(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        C.numeric(F.substring("p_brand", 7, 10)).alias("brand_number"),
        C.numeric("p_name").alias("name_number"),
        C.numeric(F.col("p_retailprice").cast("string")).alias("price"),
    )


@query(
    "normalize_entity_year",
    sql(
        """SELECT entity, year, region, CASE WHEN year = 1998 THEN 'year with a break' ELSE '' END AS year_warning,
                  count(*) AS n FROM geo GROUP BY ALL""",
        GEO,
    ),
)
def normalize_entity_year(spark, sf_dir):
    raw = geo(spark, sf_dir).select(F.col("nk").cast("string").alias("entity"), F.col("year").cast("string").alias("year"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        C.pad_code("n_nationkey", 2).alias("entity"), F.col("r_name").alias("region")
    )
    out = C.normalize_entity_year(raw, "entity", "year", regions=dim, flagged_year=1998, warning="year with a break")
    return out.groupBy("entity", "year", "region", "year_warning").agg(F.count(F.lit(1)).alias("n"))


@query(
    "recode_map",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' END AS strict,
              CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE l_returnflag END AS lenient,
              count(*) AS n FROM lineitem GROUP BY ALL""",
)
def recode_map(spark, sf_dir):
    labels = {"A": "Accepted", "R": "Returned"}
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            C.recode("l_returnflag", labels).alias("strict"), C.recode("l_returnflag", labels, keep_unmapped=True).alias("lenient")
        )
        .groupBy("strict", "lenient")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "bin_range_labels",
    """SELECT p_partkey, CASE WHEN p_size BETWEEN 15 AND 24 THEN '15-24' WHEN p_size BETWEEN 25 AND 34 THEN '25-34'
              WHEN p_size BETWEEN 35 AND 44 THEN '35-44' WHEN p_size BETWEEN 45 AND 54 THEN '45-54' END AS age_group FROM part""",
)
def bin_range_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.bin_ranges("p_size", specs.AGE_GROUPS).alias("age_group"))


@query(
    "bin_select_default",
    """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 25 AND l_discount > 0.05 THEN 'discounted'
                   WHEN l_quantity >= 40 THEN 'large' ELSE 'unknown' END AS size_class, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def bin_select_default(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    label = C.bin_conditions([(q < 10, "small"), ((q < 25) & (d > 0.05), "discounted"), (q >= 40, "large")], "unknown")
    return table(spark, sf_dir, "lineitem").groupBy(label.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "indicator_flags",
    """SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS n_flagged,
              count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 20) AS n_middle,
              count(*) FILTER (WHERE nullif(l_returnflag, 'N') <> 'A') AS n_other, count(*) AS n
       FROM lineitem GROUP BY l_linestatus""",
)
def indicator_flags(spark, sf_dir):
    maybe = F.nullif(F.col("l_returnflag"), F.lit("N"))
    flags = {
        "n_flagged": C.flag(F.col("l_returnflag").isin("A", "R")),
        "n_middle": C.flag(F.col("l_quantity").between(10, 20)),
        "n_other": C.flag(maybe != "A"),
    }
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        *[F.count_if(c).alias(n) for n, c in flags.items()], F.count(F.lit(1)).alias("n")
    )


CODES = ["120308", "120303", "120307", "120101", "050101", "180501", "020101", "030101", "040201", "120201"]
CODE_SQL = (
    "list_extract([" + ", ".join(f"'{c}'" for c in CODES) + "], CAST((l_partkey + l_linenumber) % 10 + 1 AS INTEGER))"
)


def coded_lines(spark, sf_dir):
    """Lines as an activity log: an activity code by part and line number, minutes = quantity."""
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), ((F.col("l_partkey") + F.col("l_linenumber")) % 10 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").withColumn("code", code)


def activity_flags():
    return C.classify_code(
        "code", None, prefixes=specs.ACTIVITY_PREFIXES, exact=specs.ACTIVITY_EXACT, tiers=specs.ACTIVITY_TIERS
    )


FLAG_SQL = {
    "is_socializing": "(code LIKE '1201%' OR code LIKE '1202%')",
    "is_work": "code LIKE '05%'",
    "is_commuting": "code LIKE '1805%'",
    "is_digital_media_narrow": "code = '120308'",
    "is_screen_leisure_broad": "code IN ('120303', '120307', '120308')",
    "is_household_work": "substr(code, 1, 2) = '02'",
    "is_unpaid_care": "substr(code, 1, 2) IN ('03', '04')",
}
CODED = f"coded AS (SELECT *, {CODE_SQL} AS code FROM lineitem)"


@query(
    "classify_code_prefix",
    sql(
        "SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in FLAG_SQL.items())
        + " FROM coded GROUP BY l_returnflag",
        CODED,
    ),
)
def classify_code_prefix(spark, sf_dir):
    return coded_lines(spark, sf_dir).groupBy("l_returnflag").agg(
        *[F.count_if(c).alias(n) for n, c in activity_flags().items()]
    )


@query(
    "masked_measures",
    sql(
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        + ", ".join(f"CASE WHEN {FLAG_SQL[f]} THEN l_quantity ELSE 0 END AS {n}" for n, f in
                    [("screen_minutes", "is_screen_leisure_broad"), ("social_minutes", "is_socializing"), ("care_minutes", "is_unpaid_care")])
        + ", CASE WHEN code LIKE '05%' AND l_linenumber IN (1) THEN l_quantity ELSE 0 END AS work_at_home_minutes FROM coded",
        CODED, doubles="screen_minutes social_minutes care_minutes work_at_home_minutes",
    ),
)
def masked_measures(spark, sf_dir):
    f = activity_flags()
    home = f["is_work"] & F.col("l_linenumber").isin(*specs.AT_HOME_PLACES)
    return rounded(
        coded_lines(spark, sf_dir).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            C.masked("l_quantity", f["is_screen_leisure_broad"]).alias("screen_minutes"),
            C.masked("l_quantity", f["is_socializing"]).alias("social_minutes"),
            C.masked("l_quantity", f["is_unpaid_care"]).alias("care_minutes"),
            C.masked("l_quantity", home).alias("work_at_home_minutes"),
        )
    )


@query(
    "window_filter_prefer_source",
    """WITH k AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus FROM orders
                  WHERE year(o_orderdate) BETWEEN 1996 AND 1999)
       SELECT * FROM k WHERE o_orderstatus = 'F' OR NOT EXISTS (SELECT 1 FROM k WHERE o_orderstatus = 'F')""",
)
def window_filter_prefer_source(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderstatus")
    return C.window_prefer_source(rows, "year", 1996, 1999, "o_orderstatus", "F")


@query(
    "coverage_guard",
    """SELECT CAST(min(year(o_orderdate)) AS INTEGER) AS min_year, CAST(max(year(o_orderdate)) AS INTEGER) AS max_year,
              count(DISTINCT year(o_orderdate)) AS n_years, bool_or(year(o_orderdate) >= 2000) AS has_modern_years FROM orders""",
)
def coverage_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    C.assert_year_coverage(rows, "year", 2000)
    return C.year_coverage(rows, "year", 2000)


@query(
    "safe_ratio",
    sql(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax / nullif(l_discount, 0) AS tax_per_discount FROM lineitem""",
        doubles="tax_per_discount",
    ),
)
def safe_ratio(spark, sf_dir):
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.safe_ratio("l_tax", "l_discount").alias("tax_per_discount")
        )
    )


# quantity classes that stand in for the commuting bins, as (column, low, high)
BINS = list(zip(specs.COMMUTE_MIDPOINTS, [1, 5, 9, 13, 17, 21, 25, 29, 33, 37, 41, 46], [4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 45, 50]))


@query(
    "binned_midpoint_mean",
    sql(
        "SELECT l_suppkey, (" + " + ".join(f"count(*) FILTER (WHERE l_quantity BETWEEN {lo} AND {hi}) * {specs.COMMUTE_MIDPOINTS[c]}" for c, lo, hi in BINS)
        + ") / count(*) AS mean_minutes, CAST(count(*) FILTER (WHERE l_quantity BETWEEN 41 AND 50) AS DOUBLE) / count(*) AS long_share"
        + " FROM lineitem GROUP BY l_suppkey",
        doubles="mean_minutes long_share",
    ),
)
def binned_midpoint_mean(spark, sf_dir):
    q = F.col("l_quantity")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).cast("string").alias("total"),
        *[F.count_if(q.between(lo, hi)).cast("string").alias(c) for c, lo, hi in BINS],
    )
    long_share = C.safe_ratio(C.row_sum([C.numeric("B08303_013E"), C.numeric("B08303_014E")]), C.numeric("total"))
    return rounded(
        counts.select("l_suppkey", C.midpoint_mean(counts, "total", specs.COMMUTE_MIDPOINTS).alias("mean_minutes"), long_share.alias("long_share"))
    )


@query(
    "mean_of_rates_index",
    sql("SELECT entity, year, (urgent_share + share_g + (1 - low_share)) / 3 AS access_index FROM gaps", *GAPPED, doubles="access_index"),
)
def mean_of_rates_index(spark, sf_dir):
    return rounded(
        gaps(spark, sf_dir).select("entity", "year", C.rates_index("urgent_share", "share_g", "low_share").alias("access_index"))
    )


@query(
    "row_mean_skipna",
    sql("SELECT entity, year, list_avg([price_g, balance_g, share_g]) AS row_mean FROM gaps", *GAPPED, doubles="row_mean"),
)
def row_mean_skipna(spark, sf_dir):
    return rounded(gaps(spark, sf_dir).select("entity", "year", C.row_mean(["price_g", "balance_g", "share_g"]).alias("row_mean")))


@query(
    "row_sum_skipna",
    sql(
        """SELECT entity, year, coalesce(price_g, 0) + coalesce(balance_g, 0) AS row_sum,
                  CASE WHEN price_g IS NOT NULL OR balance_g IS NOT NULL THEN coalesce(price_g, 0) + coalesce(balance_g, 0) END AS row_sum_min1
           FROM gaps""",
        *GAPPED, doubles="row_sum row_sum_min1",
    ),
)
def row_sum_skipna(spark, sf_dir):
    pair = ["price_g", "balance_g"]
    return rounded(
        gaps(spark, sf_dir).select("entity", "year", C.row_sum(pair).alias("row_sum"), C.row_sum(pair, min_count=1).alias("row_sum_min1"))
    )


@query(
    "constant_metadata",
    """SELECT doc_id, 'prose' AS measurement_concept, false AS is_representative,
              CASE WHEN upper(lang) = 'EN' THEN 'market' ELSE 'other' END AS geography_level,
              CASE WHEN source IS NOT NULL THEN 'sourced' END AS measurement_type FROM documents""",
)
def constant_metadata(spark, sf_dir):
    out = C.with_constants(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source"),
        {"measurement_concept": "prose", "is_representative": False},
    )
    return out.withColumns(
        {
            "geography_level": F.when(F.upper("lang") == "EN", "market").otherwise("other"),
            "measurement_type": F.when(F.col("source").isNotNull(), "sourced"),
        }
    ).drop("lang", "source")


@query(
    "coalesce_prefer",
    sql("SELECT entity, year, coalesce(price_g, balance_g) AS chosen FROM gaps", *GAPPED, doubles="chosen"),
)
def coalesce_prefer(spark, sf_dir):
    return rounded(gaps(spark, sf_dir).select("entity", "year", C.prefer(["price_g", "balance_g"]).alias("chosen")))


@query(
    "provenance_label",
    sql(
        """SELECT entity, year, coalesce(price_g, balance_g, share_g) AS value,
                  CASE WHEN price_g IS NOT NULL THEN 'first' WHEN balance_g IS NOT NULL THEN 'second'
                       WHEN share_g IS NOT NULL THEN 'third' ELSE 'missing' END AS source_used FROM gaps""",
        *GAPPED, doubles="value",
    ),
)
def provenance_label(spark, sf_dir):
    value, label = C.cascade([("price_g", "first"), ("balance_g", "second"), ("share_g", "third")], "missing")
    return rounded(gaps(spark, sf_dir).select("entity", "year", value.alias("value"), label.alias("source_used")))


@query(
    "two_source_flag",
    """WITH f AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE WHEN l_returnflag = 'R' THEN 0.0
                             WHEN l_linestatus = 'O' THEN 1.0 WHEN l_linestatus = 'F' AND l_quantity > 10 THEN 0.0 END AS flag,
                        CASE WHEN l_quantity < 45 THEN l_quantity END AS hours FROM lineitem)
       SELECT flag, CASE WHEN flag IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS observed, count(*) AS n, count(hours) AS n_hours
       FROM f GROUP BY ALL""",
)
def two_source_flag(spark, sf_dir):
    second = F.when((F.col("l_linestatus") == "O") | (F.col("l_quantity") > 10), F.col("l_linestatus"))
    rows = table(spark, sf_dir, "lineitem").select(
        C.two_source_flag("l_returnflag", ("A", "R"), second, ("O", "F")).alias("flag"),
        C.below_sentinel("l_quantity", 45).alias("hours"),
    )
    return rows.groupBy("flag", C.flag_number(F.col("flag").isNotNull()).alias("observed")).agg(
        F.count(F.lit(1)).alias("n"), F.count("hours").alias("n_hours")
    )


@query(
    "clip_bounds",
    sql(
        """SELECT entity, year, least(greatest(price_g, 150000), 250000) AS both_sides, greatest(balance_g, 4500) AS below FROM gaps"""
        .replace("least(greatest(price_g, 150000), 250000)", "CASE WHEN price_g IS NOT NULL THEN least(greatest(price_g, 150000), 250000) END")
        .replace("greatest(balance_g, 4500)", "CASE WHEN balance_g IS NOT NULL THEN greatest(balance_g, 4500) END"),
        *GAPPED, doubles="both_sides below",
    ),
)
def clip_bounds(spark, sf_dir):
    return rounded(
        gaps(spark, sf_dir).select(
            "entity", "year", C.clip("price_g", 150000, 250000).alias("both_sides"), C.clip("balance_g", low=4500).alias("below")
        )
    )


@query(
    "inverse_features",
    sql(
        "SELECT entity, year, urgent_share AS urgent_raw, 1 - open_share AS open_share_inverse, -balance AS balance_inverse FROM panel",
        *BASE, doubles="urgent_raw open_share_inverse balance_inverse",
    ),
)
def inverse_features(spark, sf_dir):
    out = C.inverse_features(
        panel(spark, sf_dir), one_minus=["open_share", "absent"], negated=["balance"], renames={"urgent_share": "urgent_raw"}
    )
    return rounded(out.select("entity", "year", "urgent_raw", "open_share_inverse", "balance_inverse"))


@query(
    "optional_column_default",
    sql("SELECT entity, year, n_orders, CAST(NULL AS DOUBLE) AS online_rate, 'unknown' AS note FROM panel", *BASE),
)
def optional_column_default(spark, sf_dir):
    out = C.with_optional(
        panel(spark, sf_dir).select("entity", "year", "n_orders"),
        {"n_orders": ("bigint", 0), "online_rate": ("double", None), "note": ("string", "unknown")},
    )
    return out.select("entity", "year", "n_orders", "online_rate", "note")


@query(
    "calendar_trend_features",
    """WITH c AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
            m AS (SELECT min(year) AS y0 FROM c)
       SELECT o_orderkey, year, year - y0 AS year_index, (year - y0) * (year - y0) AS year_index_sq,
              CASE WHEN year >= 1999 THEN 1 ELSE 0 END AS post_break,
              CASE WHEN year >= 1999 THEN year - 1999 ELSE 0 END AS post_break_trend FROM c, m""",
)
def calendar_trend_features(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return C.calendar_trend_features(rows, "year", 1999)


@query(
    "factorize_first_seen",
    """WITH f AS (SELECT event_id, nullif(event_type, 'error') AS label FROM events),
            o AS (SELECT label, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM f WHERE label IS NOT NULL GROUP BY label)
       SELECT event_id, f.label, CAST(coalesce(code, -1) AS INTEGER) AS code FROM f LEFT JOIN o ON f.label = o.label""",
)
def factorize_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("label"))
    return ordering.factorize(rows, "label", "event_id", name="code")


@query(
    "alias_resolve",
    """SELECT CASE event_type WHEN 'signup' THEN 'registration' WHEN 'view' THEN 'impression' ELSE event_type END AS event, count(*) AS n
       FROM events GROUP BY 1""",
)
def alias_resolve(spark, sf_dir):
    name = C.resolve_alias("event_type", {"signup": "registration", "view": "impression"})
    return table(spark, sf_dir, "events").groupBy(name.alias("event")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "slice_filter",
    sql(
        """SELECT entity, year, n_orders, price FROM panel WHERE region IN ('ASIA', 'EUROPE') AND year <= 1999""",
        *BASE, doubles="price",
    ),
)
def slice_filter(spark, sf_dir):
    out = C.slice_filter(panel(spark, sf_dir), upto={"year": 1999}, region=["ASIA", "EUROPE"], entity="all")
    return rounded(out.select("entity", "year", "n_orders", "price"))


@query(
    "rename_long_labels",
    """SELECT l_orderkey AS respondent, l_linenumber AS activity, l_partkey AS part, l_quantity AS time_alone_minutes,
              l_suppkey AS place, l_extendedprice AS weight FROM lineitem""",
)
def rename_long_labels(spark, sf_dir):
    names = {
        "l_orderkey": "respondent", "l_linenumber": "activity", "l_partkey": "part", "l_quantity": "time_alone_minutes",
        "l_suppkey": "place", "l_extendedprice": "weight", "another_layout": "weight",
    }
    out = table(spark, sf_dir, "lineitem").withColumnsRenamed(names)
    return out.select("respondent", "activity", "part", "time_alone_minutes", "place", "weight")


@query(
    "finite_or_default",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0 THEN round(ln(l_discount), 4) + 0.0 END AS finite_or_null,
              CASE WHEN l_discount > 0 THEN round(ln(l_discount), 4) + 0.0 ELSE 0 END AS finite_or_zero FROM lineitem""",
)
def finite_or_default(spark, sf_dir):
    raw = F.when(F.col("l_discount") > 0, F.ln("l_discount")).otherwise(F.lit(float("-inf")))
    raw = F.when(F.col("l_linenumber") == 7, F.when(F.col("l_discount") > 0, raw).otherwise(F.lit(float("nan")))).otherwise(raw)
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            C.finite_or(raw).alias("finite_or_null"), C.finite_or(raw, 0.0).alias("finite_or_zero"),
        )
    )


@query(
    "normalize_records",
    sql(
        """SELECT 'state' AS geography_type, entity AS geography_id, entity_name AS geography_name, year, price AS reference_path,
                  price_g AS scenario_path, coalesce(price_g - price, balance) AS scenario_difference FROM gaps
           UNION ALL
           SELECT 'msa', CAST(o_custkey AS VARCHAR), 'Customer ' || o_custkey, year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE),
                  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * 2, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
           FROM geo WHERE segment <> 'BUILDING' GROUP BY o_custkey, year""",
        *GAPPED, doubles="reference_path scenario_path scenario_difference",
    ),
)
def normalize_records(spark, sf_dir):
    states = gaps(spark, sf_dir).select(
        F.col("nk").cast("string").alias("state_fips"), F.col("entity_name").alias("state_name"), "year",
        F.col("price").alias("reference_path"), F.col("price_g").alias("scenario_path"), F.col("balance").alias("scenario_difference"),
    )
    total = money_sum("o_totalprice")
    key = F.when(F.col("segment") != "BUILDING", F.col("o_custkey").cast("string")).otherwise("")
    metros = geo(spark, sf_dir).groupBy(key.alias("cbsa_code"), "o_custkey", "year").agg(
        total.alias("reference_path"), (total * 2).cast("string").alias("scenario_path")
    ).withColumn("msa_name", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")))
    return rounded(
        C.normalize_records(
            [(states, "state"), (metros, "msa")],
            id_fields={"state": ["geography_id", "state_fips"], "msa": ["geography_id", "cbsa_code", "msa_id"]},
            name_fields={"state": ["geography_name", "state_name"], "msa": ["geography_name", "msa_name"]},
            id_width={"state": 2},
            passthrough=["year"],
        )
    )
