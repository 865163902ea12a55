"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import windows as W
from ..session import materialize
from .base import BASE, CUSTOMERS, END, GAPPED, GEO, customer_panel, gaps, geo, money_sum, panel, query, rounded, sql, table


def yearly_events(spark, sf_dir):
    """Event counts per (user group as entity, day number as year 1995 + day mod 7)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.lpad((F.col("user_id") % 25).cast("string"), 2, "0").alias("entity"),
        (F.lit(1995) + F.dayofmonth(F.col("ts").cast("date")) % 7).cast("int").alias("year"),
    ).agg(F.count(F.lit(1)).alias("n_events"), money_sum("value").alias("revenue"))


EVENTS = """ev AS (SELECT lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS entity,
    CAST(1995 + day(ts) % 7 AS INTEGER) AS year, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM events GROUP BY ALL)"""


@query(
    "left_join_panels",
    sql(
        """SELECT p.entity, p.year, p.price, p.revenue, ev.n_events, s.n_suppliers
           FROM panel p LEFT JOIN ev ON p.entity = ev.entity AND p.year = ev.year
           LEFT JOIN (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS entity, count(*) AS n_suppliers FROM supplier GROUP BY 1) s
             ON p.entity = s.entity""",
        *BASE, EVENTS, doubles="price revenue",
    ),
)
def left_join_panels(spark, sf_dir):
    base = panel(spark, sf_dir).select("entity", "year", "price", "revenue")
    suppliers = table(spark, sf_dir, "supplier").groupBy(C.pad_code("s_nationkey", 2).alias("entity")).agg(
        F.count(F.lit(1)).alias("n_suppliers")
    )
    no_keys = table(spark, sf_dir, "region")
    frames = [None, base.filter(F.lit(False)), base, yearly_events(spark, sf_dir), suppliers, no_keys]
    return rounded(J.left_join_panels(frames, ["entity", "year"]))


@query(
    "outer_join_coalesce",
    sql(
        """SELECT coalesce(g.entity, ev.entity) AS entity, coalesce(g.year, ev.year) AS year, coalesce(g.price_g, NULL) AS price_g,
                  coalesce(ev.revenue, g.revenue) AS revenue, ev.n_events
           FROM (SELECT * FROM gaps WHERE price_g IS NOT NULL) g FULL OUTER JOIN ev ON g.entity = ev.entity AND g.year = ev.year""",
        *GAPPED, EVENTS, doubles="price_g revenue",
    ),
)
def outer_join_coalesce(spark, sf_dir):
    left = gaps(spark, sf_dir).filter(F.col("price_g").isNotNull()).select("entity", "year", "price_g", "revenue")
    return rounded(
        J.outer_join_coalesce(left, yearly_events(spark, sf_dir), ["entity", "year"], prefer_right=["revenue"])
    )


@query(
    "lookup_join",
    """SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey % 6 = 0 THEN CASE WHEN s_nationkey = 0 THEN 'National' ELSE 'unknown' END
              ELSE r_name END AS region
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def lookup_join(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.when(F.col("n_nationkey") % 6 != 0, C.pad_code("n_nationkey", 2)).alias("code"), F.col("r_name").alias("region")
    )
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", C.pad_code("s_nationkey", 2).alias("code"))
    return J.lookup_join(rows, dim, "code", "region", special={"00": "National"}, default="unknown").drop("code")


@query(
    "unmatched_keys",
    "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def unmatched_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.unmatched_keys(table(spark, sf_dir, "orders"), lines, "o_orderkey")


@query(
    "match_report",
    """WITH l AS (SELECT l_partkey % 3000 AS id, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT p_partkey + 100 AS id FROM part)
       SELECT coalesce(l.id, r.id) AS id, coalesce(n, 0) AS left_rows, CAST(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS right_rows,
              CASE WHEN r.id IS NULL THEN 'left_only' WHEN l.id IS NULL THEN 'right_only' ELSE 'matched' END AS status
       FROM l FULL OUTER JOIN r ON l.id = r.id""",
)
def match_report(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3000).alias("id"))
    right = table(spark, sf_dir, "part").select((F.col("p_partkey") + 100).alias("id"))
    return J.match_report(left, right, "id")


TWO_PASS_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                    CASE WHEN l_linestatus = 'F' THEN l_partkey + 1000 ELSE l_partkey END AS part_id,
                    CASE WHEN l_returnflag <> 'N' THEN p_name || p_type END AS text_key
                    FROM lineitem JOIN part ON l_partkey = p_partkey),
       by_id AS (SELECT DISTINCT p_partkey AS part_id, p_size FROM part),
       by_text AS (SELECT DISTINCT p_name || p_type AS text_key, p_size FROM part)
       SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, i.p_size, 'id' AS matched_by FROM l JOIN by_id i ON l.part_id = i.part_id
       UNION ALL
       SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, t.p_size, CASE WHEN t.p_size IS NOT NULL THEN 'text' END
       FROM l LEFT JOIN by_text t ON l.text_key = t.text_key WHERE l.part_id NOT IN (SELECT part_id FROM by_id)"""


@query(
    "two_pass_fallback_join",
    f"SELECT l_linenumber, matched_by, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total_size FROM ({TWO_PASS_SQL}) GROUP BY ALL",
)
def two_pass_fallback_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.concat("p_name", "p_type")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linestatus") == "F", F.col("l_partkey") + 1000).otherwise(F.col("l_partkey")).alias("part_id"),
        F.when(F.col("l_returnflag") != "N", text).alias("text_key"),
    )
    parts = part.select(F.col("p_partkey").alias("part_id"), text.alias("text_key"), "p_size")
    joined = J.two_pass_join(lines, parts, first_keys=["part_id"], second_keys=["text_key"], values=["p_size"])
    return joined.groupBy("l_linenumber", "matched_by").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total_size"))


@query(
    "null_safe_join",
    sql(
        """SELECT entity, year, label, n FROM
           (SELECT entity, year, CASE WHEN share_g IS NOT NULL THEN region END AS place FROM gaps) g
           LEFT JOIN (SELECT CASE WHEN segment <> 'BUILDING' THEN region END AS place, 'from ' || coalesce(CASE WHEN segment <> 'BUILDING' THEN region END, 'nowhere') AS label,
                      count(*) AS n FROM geo GROUP BY ALL) r ON g.place IS NOT DISTINCT FROM r.place""",
        *GAPPED,
    ),
)
def null_safe_join(spark, sf_dir):
    left = gaps(spark, sf_dir).select("entity", "year", F.when(F.col("share_g").isNotNull(), F.col("region")).alias("place"))
    place = F.when(F.col("segment") != "BUILDING", F.col("region"))
    right = geo(spark, sf_dir).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    right = right.withColumn("label", F.concat(F.lit("from "), F.coalesce("place", F.lit("nowhere"))))
    return J.null_safe_join(left, right, ["place"]).select("entity", "year", "label", "n")


@query(
    "baseline_self_join",
    sql(
        """SELECT customer, year, revenue - b AS revenue_growth, o - n_orders AS orders_saved FROM
           (SELECT *, avg(revenue) FILTER (WHERE year BETWEEN 1995 AND 1997) OVER (PARTITION BY customer) AS b,
                   avg(n_orders) FILTER (WHERE year BETWEEN 1995 AND 1997) OVER (PARTITION BY customer) AS o FROM customer_panel)""",
        CUSTOMERS, doubles="revenue_growth orders_saved", digits=3,
    ),
)
def baseline_self_join(spark, sf_dir):
    out = J.baseline_deltas(
        customer_panel(spark, sf_dir), "customer", "year", (1995, 1997),
        rising={"revenue": "revenue_growth"}, falling={"n_orders": "orders_saved"},
    )
    return rounded(out.select("customer", "year", "revenue_growth", "orders_saved"), 3)


@query(
    "hierarchy_fallback_join",
    sql(
        """SELECT p.entity, p.year, coalesce(g.price_g, rg.v + 100 * p.urgent_share, nt.v + 100 * p.urgent_share) AS price,
                  CASE WHEN g.price_g IS NOT NULL THEN 'observed' WHEN coalesce(rg.v, nt.v) IS NOT NULL THEN 'modeled' ELSE 'missing' END AS price_status
           FROM panel p LEFT JOIN gaps g ON p.entity = g.entity AND p.year = g.year
           LEFT JOIN (SELECT region, year, avg(price_g) AS v FROM gaps WHERE region <> 'ASIA' GROUP BY ALL) rg ON p.region = rg.region AND p.year = rg.year
           LEFT JOIN (SELECT year, avg(price_g) AS v FROM gaps WHERE year <> 1998 GROUP BY ALL) nt ON p.year = nt.year""",
        *GAPPED, doubles="price",
    ),
)
def hierarchy_fallback_join(spark, sf_dir):
    g = materialize(gaps(spark, sf_dir))
    fine = g.select("entity", "year", F.col("price_g").alias("price"))
    middle = g.groupBy("region", "year").agg(F.avg(F.when(F.col("region") != "ASIA", F.col("price_g"))).alias("price"))
    coarse = g.groupBy("year").agg(F.avg(F.when(F.col("year") != 1998, F.col("price_g"))).alias("price"))
    base = panel(spark, sf_dir).select("entity", "region", "year", "urgent_share")
    out = J.hierarchy_fallback_join(
        base, fine, middle, coarse, entity="entity", group="region", year="year", metrics=["price"],
        adjustments={"price": F.lit(100.0) * F.col("urgent_share")},
    )
    return rounded(out.select("entity", "year", "price", "price_status"))


SCENARIO_ROWS = """sc AS (SELECT entity, year, o_orderpriority AS scenario, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS path,
                   count(*) AS n FROM geo GROUP BY ALL)"""


def priority_rows(spark, sf_dir):
    """Nation × year × order priority, the priority standing in for the scenario."""
    return geo(spark, sf_dir).groupBy("entity", "year", F.col("o_orderpriority").alias("scenario")).agg(
        money_sum("o_totalprice").alias("path"), F.count(F.lit(1)).alias("n")
    )


@query(
    "reference_vs_scenario_join",
    sql(
        """SELECT s.entity, s.year, s.scenario, s.path, r.path AS reference_path, s.path - r.path AS delta_path
           FROM sc s LEFT JOIN (SELECT * FROM sc WHERE scenario = '1-URGENT') r ON s.entity = r.entity AND s.year = r.year""",
        GEO, SCENARIO_ROWS, doubles="path reference_path delta_path",
    ),
)
def reference_vs_scenario_join(spark, sf_dir):
    out = J.against_reference(priority_rows(spark, sf_dir), ["entity", "year"], "scenario", "1-URGENT", ["path"])
    return rounded(out.drop("n"))


@query(
    "rescaled_region_proxy",
    sql(
        """SELECT region, r.year, CASE WHEN r.v > 0 AND coalesce(n.v, m.v) > 0 THEN 25.0 * r.v / coalesce(n.v, m.v) END AS proxy
           FROM (SELECT region, year, avg(price_g) AS v FROM gaps GROUP BY ALL HAVING avg(price_g) IS NOT NULL) r
           LEFT JOIN (SELECT year, avg(price_g) AS v FROM gaps WHERE year NOT IN (1997, 2000) GROUP BY ALL) n ON r.year = n.year,
           (SELECT median(v) AS v FROM (SELECT year, avg(price_g) AS v FROM gaps WHERE year NOT IN (1997, 2000) GROUP BY ALL)) m""",
        *GAPPED, doubles="proxy",
    ),
)
def rescaled_region_proxy(spark, sf_dir):
    g = materialize(gaps(spark, sf_dir))
    region = g.groupBy("region", "year").agg(F.avg("price_g").alias("price"))
    national = g.groupBy("year").agg(F.avg(F.when(~F.col("year").isin(1997, 2000), F.col("price_g"))).alias("price"))
    return rounded(
        J.rescaled_region_proxy(region, national, region="region", year="year", value="price", anchor=25.0, name="proxy")
    )


@query(
    "national_series_join",
    sql(
        """SELECT g.entity, g.year, coalesce(price_g, n.v * g.urgent_share / m.e) AS price_g,
                  CASE WHEN price_g IS NOT NULL THEN 'observed' WHEN n.v IS NOT NULL THEN 'scaled_national_series' ELSE 'missing' END AS price_source
           FROM gaps g LEFT JOIN (SELECT CAST(1995 + month(ts) % 7 AS INTEGER) AS year, avg(value) AS v FROM events GROUP BY 1) n ON g.year = n.year
           JOIN (SELECT year, avg(urgent_share) AS e FROM gaps GROUP BY 1) m ON g.year = m.year""",
        *GAPPED, doubles="price_g",
    ),
)
def national_series_join(spark, sf_dir):
    series = A.period_mean(
        table(spark, sf_dir, "events"), (F.lit(1995) + F.month(F.col("ts").cast("date")) % 7).cast("int"), "value", "national"
    )
    out = J.national_series_join(
        materialize(gaps(spark, sf_dir)), series, year="year", value="price_g", national="national", exposure="urgent_share", source="price_source"
    )
    return rounded(out.select("entity", "year", "price_g", "price_source"))


@query(
    "expand_time_grid",
    sql(
        f"""SELECT customer, last_year, CAST(y AS INTEGER) AS year FROM
           (SELECT customer, last_year, unnest(range(last_year + 1, {END + 1})) AS y
            FROM (SELECT customer, max(year) AS last_year FROM customer_panel GROUP BY 1))""",
        CUSTOMERS,
    ),
)
def expand_time_grid(spark, sf_dir):
    last = customer_panel(spark, sf_dir).groupBy("customer").agg(F.max("year").alias("last_year"))
    return J.expand_time_grid(last, "last_year", END)


@query(
    "latest_row_join",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
       SELECT c_custkey AS customer, c_mktsegment AS segment, o_totalprice AS latest_price, o_orderpriority AS latest_priority
       FROM customer LEFT JOIN r ON c_custkey = o_custkey AND k = 1""",
)
def latest_row_join(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer")
    return J.latest_row_join(
        people, orders, ["customer"], "o_orderkey", {"o_totalprice": "latest_price", "o_orderpriority": "latest_priority"}
    )


@query(
    "parent_inherit_join",
    sql(
        """SELECT c_custkey AS child, CASE WHEN c_custkey % 10 <> 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS entity, price_g AS value,
                  CASE WHEN c_custkey % 10 = 0 THEN 'no_parent' WHEN e.entity IS NOT NULL THEN 'inherited' ELSE 'parent_without_estimate' END AS inherit_status
           FROM customer LEFT JOIN (SELECT entity, price_g FROM gaps WHERE year = 2000 AND price_g IS NOT NULL) e
             ON e.entity = CASE WHEN c_custkey % 10 <> 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END""",
        *GAPPED, doubles="value",
    ),
)
def parent_inherit_join(spark, sf_dir):
    child = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("child"), F.when(F.col("c_custkey") % 10 != 0, C.pad_code("c_nationkey", 2)).alias("entity")
    )
    parent = gaps(spark, sf_dir).filter("year = 2000 AND price_g IS NOT NULL").select("entity", F.col("price_g").alias("value"))
    return rounded(J.parent_inherit(child, parent, parent_key="entity", values=["value"]))


@query(
    "enrich_from_entity",
    """SELECT o_orderkey, coalesce(CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END, o_orderstatus) AS segment,
              coalesce(CASE WHEN c_acctbal > 5000 THEN 'rich' END, 'not stated') AS wealth
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def enrich_from_entity(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("segment"))
    entities = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") > 5000, "rich").alias("wealth"),
    )
    return J.enrich_from_entity(records, entities, "id", {"segment": None, "wealth": "not stated"}).drop("id")


@query(
    "skill_rollup_join",
    """WITH t AS (SELECT l_suppkey AS k, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS types FROM lineitem JOIN part ON l_partkey = p_partkey
                  WHERE l_suppkey % 3 <> 0 GROUP BY 1),
            b AS (SELECT l_suppkey AS k, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey
                  WHERE l_suppkey % 4 <> 0 GROUP BY 1),
            j AS (SELECT s_suppkey AS supplier, types, brands, nullif(concat_ws('; ', CASE WHEN types IS NULL THEN 'types' END,
                         CASE WHEN brands IS NULL THEN 'brands' END), '') AS missing_columns
                  FROM supplier LEFT JOIN t ON s_suppkey = t.k LEFT JOIN b ON s_suppkey = b.k)
       SELECT *, 'Missing match in: ' || missing_columns AS mismatch_summary FROM j""",
)
def skill_rollup_join(spark, sf_dir):
    """Supplier-part pairs are reduced once and written; keys are masked, so that some suppliers have no text."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), "l_partkey").distinct()
    pairs = materialize(pairs.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("s", "p_type", "p_brand").distinct())
    masked = lambda n: pairs.withColumn("supplier", F.when(F.col("s") % n != 0, F.col("s")))
    types = A.joined_sorted(masked(3), ["supplier"], "p_type", "types")
    brands = A.joined_sorted(masked(4), ["supplier"], "p_brand", "brands")
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"))
    return J.rollup_join(base, {"types": types, "brands": brands}, "supplier")


@query(
    "forecast_inputs_join",
    sql(
        """SELECT s.entity, s.year, s.scenario, s.n, p.n_orders, p.balance, s.n * 1000.0 / p.n_orders AS per_thousand
           FROM sc s LEFT JOIN panel p ON s.entity = p.entity AND s.year = p.year""",
        GEO, BASE[1], SCENARIO_ROWS, doubles="balance per_thousand",
    ),
)
def forecast_inputs_join(spark, sf_dir):
    rows = priority_rows(spark, sf_dir).withColumn("n_orders", F.lit(-1)).drop("path")
    out = J.join_inputs(rows, panel(spark, sf_dir), ["entity", "year"], ["n_orders", "balance"])
    return rounded(out.withColumn("per_thousand", F.lit(1000.0) * C.safe_ratio("n", "n_orders")))


@query(
    "denominator_backfill_join",
    sql(
        """SELECT s.entity, s.year, s.scenario, g.balance_g FROM sc s
           LEFT JOIN (SELECT DISTINCT entity, year, balance_g FROM gaps WHERE balance_g IS NOT NULL) g ON s.entity = g.entity AND s.year = g.year""",
        *GAPPED, SCENARIO_ROWS, doubles="balance_g",
    ),
)
def denominator_backfill_join(spark, sf_dir):
    rows = priority_rows(spark, sf_dir).select("entity", "year", "scenario")
    return rounded(J.backfill_column(rows, gaps(spark, sf_dir), ["entity", "year"], "balance_g"))


# the occupation–task chain on suppliers, lines, parts
TASKS_SQL = """WITH e AS (SELECT s_suppkey AS k, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0),
  t AS (SELECT DISTINCT l_suppkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_partkey + 1000000 END AS task_id,
               upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS text_key FROM lineitem JOIN part ON l_partkey = p_partkey),
  a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS task_id, upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS text_key, p_type AS activity
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 20),
  r AS (SELECT e.*, t.task_id, t.text_key FROM e LEFT JOIN t ON e.k = t.k),
  ids AS (SELECT DISTINCT k, task_id, activity FROM a), txt AS (SELECT DISTINCT k, text_key, activity FROM a),
  j AS (SELECT r.k, r.task_id, r.text_key, ids.activity, 'id' AS matched_by FROM r JOIN ids ON r.k = ids.k AND r.task_id = ids.task_id
        UNION ALL
        SELECT r.k, r.task_id, r.text_key, txt.activity, CASE WHEN txt.activity IS NOT NULL THEN 'text' END
        FROM r LEFT JOIN txt ON r.k = txt.k AND r.text_key = txt.text_key
        WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.k = r.k AND ids.task_id = r.task_id)),
  b AS (SELECT l_suppkey AS k, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_suppkey % 4 <> 0 GROUP BY 1)"""


def task_inputs(spark, sf_dir):
    """Lines are reduced to supplier-part pairs before the part text is joined, and written once."""
    line = F.col("l_linenumber")
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p_partkey")).agg(
        F.bool_or(line % 2 == 0).alias("even"), F.bool_or(line % 2 == 1).alias("odd"), F.bool_or(F.col("l_quantity") > 20).alias("big")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", X.make_text_key("p_name").alias("text_key"))
    pairs = materialize(pairs.join(part, "p_partkey"))
    entities = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), "s_name", "s_acctbal", (F.col("s_acctbal") > 0).alias("eligible")
    )
    ids = F.array(F.when(F.col("even"), F.col("p_partkey")), F.when(F.col("odd"), F.col("p_partkey") + 1000000))
    tasks = pairs.select("k", F.explode(F.array_compact(ids)).alias("task_id"), "text_key").distinct()
    big = lambda c: F.when(F.col("big"), F.col(c))  # noqa: E731  other pairs stay, without a key to be found by
    acts = pairs.select("k", big("p_partkey").alias("task_id"), big("text_key").alias("text_key"), F.col("p_type").alias("activity"))
    masked = pairs.select(F.when(F.col("k") % 4 != 0, F.col("k")).alias("k"), "p_brand").distinct()
    rollups = {"brands": A.joined_sorted(masked, ["k"], "p_brand", "brands")}
    return entities, tasks, acts, rollups


@query(
    "task_dataset",
    TASKS_SQL
    + """ SELECT j.k, j.task_id, j.text_key, j.activity, j.matched_by, b.brands, CASE WHEN b.brands IS NULL THEN 'brands' END AS missing_columns
          FROM j LEFT JOIN b ON j.k = b.k""",
)
def task_dataset(spark, sf_dir):
    from ..plans.tasks import task_dataset as build

    entities, tasks, acts, rollups = task_inputs(spark, sf_dir)
    out = build(
        entities, tasks, acts, rollups, key="k", order="s_name", eligible="eligible", task_id="task_id", text_key="text_key", activity="activity"
    )
    return out.select("k", "task_id", "text_key", "activity", "matched_by", "brands", "missing_columns")


@query(
    "mismatch_report",
    TASKS_SQL
    + """, m AS (SELECT count(*) FILTER (WHERE brands IS NULL AND text_key IS NOT NULL) AS rows_with_task,
                count(*) FILTER (WHERE brands IS NULL AND activity IS NOT NULL) AS rows_with_title FROM j LEFT JOIN b ON j.k = b.k)
         SELECT 'brands' AS rollup, (SELECT count(*) FROM e WHERE k NOT IN (SELECT k FROM b)) AS entities_missing, rows_with_task, rows_with_title FROM m""",
)
def mismatch_report(spark, sf_dir):
    from ..plans.audit import mismatch_report as report
    from ..plans.tasks import task_dataset as build

    entities, tasks, acts, rollups = task_inputs(spark, sf_dir)
    rows = build(
        entities, tasks, acts, rollups, key="k", order="s_name", eligible="eligible", task_id="task_id", text_key="text_key", activity="activity"
    )
    return report(rows, entities.filter("eligible"), rollups, "k", task="text_key", title="activity")


@query(
    "weighted_panel_zscore",
    sql(
        """WITH w AS (SELECT entity, entity_name, region, year, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mean_price,
                            count(*) AS n_lines FROM micro GROUP BY ALL)
           SELECT *, CASE WHEN stddev_pop(mean_price) OVER (PARTITION BY year) = 0 THEN 0.0 ELSE
                  (mean_price - avg(mean_price) OVER (PARTITION BY year)) / stddev_pop(mean_price) OVER (PARTITION BY year) END AS price_z FROM w""",
        GEO, "micro AS (SELECT * FROM lineitem JOIN geo ON l_orderkey = o_orderkey)", doubles="mean_price price_z",
    ),
)
def weighted_panel_zscore(spark, sf_dir):
    """Line prices weighted by quantity, summed per order before the orders are joined."""
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(q * x).alias("wx"), F.sum(q).alias("w"), F.count(F.lit(1)).alias("n")
    )
    joined = geo(spark, sf_dir).join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    means = joined.groupBy("entity", "entity_name", "region", "year").agg(
        C.safe_ratio(F.sum("wx"), F.sum("w")).alias("mean_price"), F.sum("n").alias("n_lines")
    )
    return rounded(W.zscore_by_period(means, {"mean_price": "price_z"}, "year"))
