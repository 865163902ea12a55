"""Queries of the scalar text, date, format, JSON, map and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators.windows import lag_features, recent_mean
from ..plans import specs
from ..session import materialize
from .base import BASE, GAPPED, gaps, panel, query, rounded, sql, table

WS = f"[{X.LOW_WHITE}{X.HIGH_WHITE}]"  # the same characters as one plain class


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_clean(x: str) -> str:
    squeezed = f"regexp_replace({sql_strip(x)}, '{WS}+', ' ', 'g')"
    return f"CASE WHEN {squeezed} <> '' AND lower({squeezed}) <> 'nan' THEN {squeezed} END"


@query("normalize_label", f"SELECT doc_id, regexp_replace(lower({sql_strip('text')}), '[^a-z0-9]+', '', 'g') AS label FROM documents")
def normalize_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_label("text").alias("label"))


@query(
    "normalize_code",
    """SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR)
                             ELSE CAST(p_retailprice AS VARCHAR) END AS price_code, p_brand AS brand_code FROM part""",
)
def normalize_code(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.normalize_number_code("p_retailprice").alias("price_code"),
        X.normalize_code(F.concat(F.lit("  "), F.col("p_brand"), F.lit("\t"))).alias("brand_code"),
    )


@query("make_key", "SELECT page_id, nullif(regexp_replace(upper(url), '[^A-Z0-9]+', '', 'g'), '') AS key FROM pages")
def make_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.make_key("url").alias("key"))


@query("clean_text", f"SELECT doc_id, {sql_clean('text')} AS clean FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text("text").alias("clean"))


@query(
    "make_text_key",
    f"""WITH c AS (SELECT doc_id, {sql_clean('text')} AS clean FROM documents)
        SELECT doc_id, nullif(regexp_replace(upper(replace(clean, 'ß', 'SS')), '[^A-Z0-9]+', '', 'g'), '') AS text_key FROM c""",
)
def make_text_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.make_text_key("text").alias("text_key"))


@query(
    "format_value",
    """SELECT p_partkey, regexp_replace(printf('%.2f', p_retailprice), '\\.?0+$', '') AS price,
              regexp_replace(printf('%.2f', CAST(p_size AS DOUBLE) * 10), '\\.?0+$', '') AS size FROM part""",
)
def format_value(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.format_value("p_retailprice").alias("price"), X.format_value(F.col("p_size") * 10).alias("size")
    )


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    "truthy_text",
    f"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) WHEN turn % 2 = 0 THEN 'Remote ' || role ELSE text END AS x FROM conversations),
             n AS (SELECT *, regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') AS label FROM t)
        SELECT conv_id, turn, role, turn > 0 AS is_yes_number, coalesce(CASE WHEN label IN {in_list(specs.YES_WORDS)} THEN true WHEN label IN {in_list(specs.NO_WORDS)} THEN false END,
                    {' OR '.join(f"contains(label, '{t}')" for t in specs.YES_TOKENS)}, false) AS is_yes FROM n""",
)
def truthy_text(spark, sf_dir):
    """Whole texts, texts of digits, and a number column, which alone is compared with zero."""
    x = (
        F.when(F.col("role") == "user", F.col("turn").cast("string"))
        .when(F.col("turn") % 2 == 0, F.concat(F.lit("Remote "), F.col("role")))
        .otherwise(F.col("text"))
    )
    words = specs.YES_WORDS, specs.NO_WORDS, specs.YES_TOKENS
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", X.truthy_text("turn", *words).alias("is_yes_number"), X.truthy_text(x, *words).alias("is_yes")
    )


BUCKETS = [("metalware", ["bolt", "gear", "ring"]), ("gadget", ["widget", "gizmo"]), ("tone", ["red", "blue"])]


@query(
    "keyword_bucket",
    "SELECT p_partkey, CASE "
    + " ".join(f"WHEN {' OR '.join(f"contains(lower(p_name), '{w}')" for w in words)} THEN '{name}'" for name, words in BUCKETS)
    + " END AS bucket FROM part",
)
def keyword_bucket(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.keyword_bucket("p_name", BUCKETS).alias("bucket"))


@query(
    "prefix_family",
    """SELECT CASE WHEN starts_with(p_name, 'small') THEN 'size' WHEN starts_with(p_name, 'red') OR starts_with(p_name, 'blue') THEN 'tone'
                   ELSE 'other' END AS family, count(*) AS n FROM part GROUP BY 1""",
)
def prefix_family(spark, sf_dir):
    family = X.prefix_family("p_name", [("small", "size"), ("red", "tone"), ("blue", "tone")])
    return table(spark, sf_dir, "part").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "extract_lag_bucket",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CASE WHEN l_linenumber <= 3 THEN CAST(l_linenumber AS VARCHAR) ELSE 'current' END AS bucket FROM lineitem""",
)
def extract_lag_bucket(spark, sf_dir):
    feature = F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("price_lag"), F.col("l_linenumber").cast("string"))).otherwise("price_lag_x")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.lag_bucket(feature).alias("bucket")
    )


@query("replace_literal", "SELECT o_orderkey, replace(o_orderpriority, '-', '_') AS priority FROM orders")
def replace_literal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.replace_literal("o_orderpriority", "-", "_").alias("priority"))


@query(
    "title_case_place",
    """WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS words, p_type, p_brand FROM part)
       SELECT p_partkey, array_to_string(list_transform(words, lambda s: upper(s[1]) || substr(s, 2)), ' ') || '-'
              || upper(p_type[1]) || lower(substr(p_type, 2)) || ', ' || upper(p_brand) AS place FROM w""",
)
def title_case_place(spark, sf_dir):
    raw = F.concat(F.upper("p_name"), F.lit("-"), F.col("p_type"), F.lit(", "), F.lower("p_brand"), F.lit(", "))
    return table(spark, sf_dir, "part").select("p_partkey", X.title_case_place(raw).alias("place"))


@query(
    "signed_format",
    sql(
        """SELECT entity, year, CASE WHEN d > 0 THEN '+' ELSE '' END || printf('%.1f', d) || ' pts' AS points FROM
           (SELECT entity, year, round((urgent_share - 0.2) * 100, 1) + 0.0 AS d FROM panel)""",
        *BASE,
    ),
)
def signed_format(spark, sf_dir):
    return panel(spark, sf_dir).select("entity", "year", X.signed((F.col("urgent_share") - 0.2) * 100, 1, " pts").alias("points"))


@query(
    "percent_format",
    sql("SELECT entity, year, printf('%.1f', round(urgent_share * 100, 1)) || '%' AS share FROM panel", *BASE),
)
def percent_format(spark, sf_dir):
    return panel(spark, sf_dir).select("entity", "year", X.percent("urgent_share").alias("share"))


@query(
    "summary_sentence",
    sql(
        """SELECT entity, year, coalesce(entity_name || ' ' || year || ': ' ||
              CASE WHEN abs(d) < 1000 THEN 'little change in price.'
                   ELSE CASE WHEN d > 0 THEN 'raises ' ELSE 'lowers ' END || 'price by about ' || printf('%.2f', round(abs(d), 2)) || '.' END,
              'Summary unavailable for the current selection.') AS sentence
           FROM (SELECT *, price_g - lag(price_g) OVER (PARTITION BY entity ORDER BY year) AS d FROM gaps)""",
        *GAPPED,
    ),
)
def summary_sentence(spark, sf_dir):
    moved = lag_features(gaps(spark, sf_dir), ["price_g"], "entity", "year", lags=(1,), rolling=None)
    text = X.change_sentence("entity_name", "year", F.col("price_g") - F.col("price_g_lag1"), 1000, "price")
    return moved.select("entity", "year", text.alias("sentence"))


@query("contains_ci", "SELECT doc_id, coalesce(contains(lower(nullif(source, 'web')), 'boo'), false) AS hit FROM documents")
def contains_ci(spark, sf_dir):
    source = F.nullif(F.col("source"), F.lit("web"))
    return table(spark, sf_dir, "documents").select("doc_id", X.contains_ci(source, "BOO").alias("hit"))


@query(
    "year_of_text_date",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""",
)
def year_of_text_date(spark, sf_dir):
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    text = F.when(F.col("o_orderstatus") == "P", F.concat(day, F.lit(" or so"))).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.year_of_text(text).alias("year"))


@query("month_label", "SELECT o_orderkey, strftime(o_orderdate, '%B %Y') AS label FROM orders")
def month_label(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.month_label(F.date_format(day, "MMM"), F.year(day)).alias("label")
    )


@query(
    "logit",
    sql(
        """SELECT entity, year, ln(p / (1 - p)) AS logit FROM (SELECT entity, year, least(greatest(open_share, 0.0001), 0.9999) AS p FROM panel)""",
        *BASE, doubles="logit", digits=6,
    ),
)
def logit(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("entity", "year", X.logit("open_share").alias("logit")), 6)


@query("expit", sql("SELECT entity, year, 1 / (1 + exp(-(balance - 4500) / 500)) AS share FROM panel", *BASE, doubles="share", digits=6))
def expit(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("entity", "year", X.expit((F.col("balance") - 4500) / 500).alias("share")), 6)


@query("geometric_decay", sql("SELECT p_partkey, pow(0.92, p_size) AS decay FROM part", doubles="decay", digits=6))
def geometric_decay(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", X.geometric_decay("p_size", 0.92).alias("decay")), 6)


@query(
    "bounded_linear_score",
    sql(
        """SELECT entity, year, least(greatest(50 - 65 * (urgent_share - m.u) + 120 * (open_share - 0.55), 36), 64) AS score
           FROM panel, (SELECT avg(urgent_share) AS u FROM panel) m""",
        *BASE, doubles="score",
    ),
)
def bounded_linear_score(spark, sf_dir):
    p = materialize(panel(spark, sf_dir))
    mean = p.agg(F.avg("urgent_share")).scalar()
    score = X.bounded_score(50, [(-65, F.col("urgent_share"), mean), (120, F.col("open_share"), 0.55)], 36, 64)
    return rounded(p.select("entity", "year", score.alias("score")))


@query(
    "relative_tilt",
    sql(
        """SELECT region, least(greatest(0.4 * avg(urgent_share) / (SELECT avg(urgent_share) FROM panel), 0.3), 0.402) AS tilted
           FROM panel GROUP BY region""",
        *BASE, doubles="tilted", digits=6,
    ),
)
def relative_tilt(spark, sf_dir):
    p = materialize(panel(spark, sf_dir))
    overall = p.agg(F.avg("urgent_share")).scalar()
    means = p.groupBy("region").agg(F.avg("urgent_share").alias("m"))
    return rounded(means.select("region", C.clip(F.lit(0.4) * C.safe_ratio("m", overall), 0.3, 0.402).alias("tilted")), 6)


@query(
    "anchor_nowcast",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d)
       SELECT event_type, round(least(greatest(0.5 * avg(n) FILTER (WHERE k <= 4) / avg(n), 0.35), 0.65), 6) + 0.0 AS nowcast
       FROM r GROUP BY event_type""",
)
def anchor_nowcast(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    recent = recent_mean(daily, "n", "event_type", "day", 4, "recent")
    yearly = daily.groupBy("event_type").agg(F.avg("n").alias("all_days"))
    ratio = C.safe_ratio("recent", "all_days")
    out = recent.join(yearly, "event_type")
    return rounded(out.select("event_type", C.clip(F.lit(0.5) * ratio, 0.35, 0.65).alias("nowcast")), 6)


@query(
    "controls_json",
    sql(
        """SELECT entity, year, '{' || array_to_string(list_filter([
              '"year":' || year, CASE WHEN share_g IS NOT NULL THEN '"has_share":true' END, '"region":"' || region || '"'], lambda x: x IS NOT NULL), ',') || '}' AS controls
           FROM gaps""",
        *GAPPED,
    ),
)
def controls_json(spark, sf_dir):
    has = F.when(F.col("share_g").isNotNull(), F.lit(True))
    return gaps(spark, sf_dir).select(
        "entity", "year", X.sparse_json({"year": "year", "has_share": has, "region": "region"}).alias("controls")
    )


@query(
    "quality_flags_json",
    sql(
        """SELECT entity, year, '{' || array_to_string(list_filter([
              CASE WHEN region <> 'ASIA' THEN '"source_used":"' || region || '"' END,
              CASE WHEN price_g IS NOT NULL OR share_g IS NOT NULL THEN '"index_modes":{' || array_to_string(list_filter([
                   CASE WHEN price_g IS NOT NULL THEN '"price":"observed"' END, CASE WHEN share_g IS NOT NULL THEN '"share":"observed"' END],
                   lambda x: x IS NOT NULL), ',') || '}' END], lambda x: x IS NOT NULL), ',') || '}' AS flags FROM gaps""",
        *GAPPED,
    ),
)
def quality_flags_json(spark, sf_dir):
    source = F.when(F.col("region") == "ASIA", "").otherwise(F.col("region"))
    modes = {n: F.when(F.col(f"{n}_g").isNotNull(), F.lit("observed")) for n in ("price", "share")}
    flags = X.quality_json({"source_used": source, "warning": F.lit(None).cast("string")}, "index_modes", modes)
    return gaps(spark, sf_dir).select("entity", "year", flags.alias("flags"))


@query(
    "feature_manifest_json",
    sql("""SELECT entity, year, '{"lags":["price_lag1","price_lag2"],"years":["year_index"],"region":"' || region || '"}' AS manifest FROM panel""", *BASE),
)
def feature_manifest_json(spark, sf_dir):
    text = X.manifest_json({"lags": ["price_lag1", "price_lag2"], "years": ["year_index"]}, {"region": "region"})
    return panel(spark, sf_dir).select("entity", "year", text.alias("manifest"))


@query(
    "map_lookup_default",
    """SELECT p_type, CAST(coalesce(map {'SMALL': 5, 'LARGE': 10, 'PROMO': 7}[p_type], 1) AS INTEGER) AS width, count(*) AS n
       FROM part GROUP BY ALL""",
)
def map_lookup_default(spark, sf_dir):
    width = X.map_lookup("p_type", {"SMALL": 5, "LARGE": 10, "PROMO": 7}, 1)
    return table(spark, sf_dir, "part").groupBy("p_type", width.alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "year_sequence",
    """SELECT o_orderkey, CAST(y AS INTEGER) AS year FROM (SELECT o_orderkey, unnest(range(year(o_orderdate), 2003)) AS y FROM orders)""",
)
def year_sequence(spark, sf_dir):
    years = F.sequence(F.year("o_orderdate"), F.lit(2002))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(years).alias("year"))


@query(
    "distinct_ordered_array",
    """SELECT page_id, array_to_string(list_sort(list_distinct(string_split(url, '/'))), '; ') AS parts FROM pages""",
)
def distinct_ordered_array(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.distinct_sorted_text(F.split("url", "/")).alias("parts"))
