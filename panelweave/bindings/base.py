"""The operators bound to the test tables: shared frames, their SQL twins, the registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# Declared schemas: reading with one saves the footer job that would infer it.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder for one run's files."""
    return f"{checkpoint_dir(spark)}/panelweave/{label}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, negative zero removed: summation order must not show."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in doubles}) if doubles else df


def sql(body: str, *ctes: str, doubles: str = "", digits: int = 4) -> str:
    """One statement from shared CTEs and a body, with the named doubles rounded as in ``rounded``."""
    names = doubles.split()
    if not names:
        return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
    replaced = ", ".join(f'round(CAST("{n}" AS DOUBLE), {digits}) + 0.0 AS "{n}"' for n in names)
    head = ",\n".join([*ctes, f"_result AS ({body})"])
    return f"WITH {head}\nSELECT * REPLACE ({replaced}) FROM _result"


def cents(x: Column | str) -> Column:
    """A two-decimal amount in whole cents: integer sums do not depend on their order."""
    return F.rint((F.col(x) if isinstance(x, str) else x) * 100).cast("bigint")


def money_sum(x: Column | str) -> Column:
    """Sum of two-decimal amounts. An integer sum that overflows raises an error."""
    return F.sum(cents(x)) / F.lit(100.0)


LAST = 2001  # last year of the tables
END = LAST + 36  # as far as forecasts and grids of future years go


# --- orders with geography ------------------------------------------------------------------------


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact first, then one dimension after the other: each dimension is judged by its own size.

    A dimension joined from others would carry the product of their sizes as its estimate.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        "o_orderdate",
        F.col("n_nationkey").alias("nk"),
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("entity"),
        F.col("n_name").alias("entity_name"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.year("o_orderdate").alias("year"),
    )


GEO = """geo AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate,
         n_nationkey AS nk, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS entity, n_name AS entity_name,
         r_name AS region, c_mktsegment AS segment, c_acctbal AS balance,
         CAST(year(o_orderdate) AS INTEGER) AS year
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --- microdata: one row per line, weighted ---------------------------------------------------------


def micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's geography; weight = quantity, value = price of the line."""
    lines = table(spark, sf_dir, "lineitem")
    head = geo(spark, sf_dir)
    return lines.join(head, lines.l_orderkey == head.o_orderkey)


MICRO = """micro AS (SELECT * FROM lineitem JOIN geo ON l_orderkey = o_orderkey)"""


# --- entity × year panel --------------------------------------------------------------------------


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation × year: counts, sums, means and shares of orders; 25 × 7 rows however many orders.

    Orders are summed by nation key and year before the names are joined.
    """
    n = F.count(F.lit(1))
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cells = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nk"), F.year("o_orderdate").alias("year"))
        .agg(
            n.alias("n_orders"),
            money_sum("o_totalprice").alias("revenue"),
            money_sum("c_acctbal").alias("_balance"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("_urgent"),
            F.count_if(F.col("o_orderstatus") == "O").alias("_open"),
            F.count_if(F.col("o_orderpriority") == "5-LOW").alias("_low"),
        )
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = cells.join(nation, F.col("nk") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    per_order = lambda c: F.col(c) / F.col("n_orders")
    return named.select(
        F.lpad(F.col("nk").cast("string"), 2, "0").alias("entity"),
        F.col("n_name").alias("entity_name"),
        F.col("r_name").alias("region"),
        "nk",
        "year",
        "n_orders",
        "revenue",
        per_order("revenue").alias("price"),
        per_order("_balance").alias("balance"),
        per_order("_urgent").alias("urgent_share"),
        per_order("_open").alias("open_share"),
        per_order("_low").alias("low_share"),
    )


PANEL = """panel AS (
  SELECT entity, entity_name, region, nk, year, count(*) AS n_orders,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price,
         CAST(sum(CAST(balance AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS balance,
         CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) / count(*) AS urgent_share,
         CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) / count(*) AS open_share,
         CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS DOUBLE) / count(*) AS low_share
  FROM geo GROUP BY entity, entity_name, region, nk, year)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with missing values placed by rule: gaps of 0 to 5 rows, leading, trailing, all."""
    nk, year = F.col("nk"), F.col("year")
    inner = (year >= 1996) & (year < 1996 + nk % 6)
    edge = ((nk % 7 == 3) & (year >= 2000)) | ((nk % 7 == 5) & (year <= 1996)) | (nk == 24)
    return panel(spark, sf_dir).withColumns(
        {
            "price_g": F.when(~(inner | edge), F.col("price")),
            "balance_g": F.when((nk + year) % 4 != 0, F.col("balance")),
            "share_g": F.when((nk * 2 + year) % 3 != 0, F.col("urgent_share")),
        }
    )


GAPS = """gaps AS (
  SELECT *, CASE WHEN NOT ((year >= 1996 AND year < 1996 + nk % 6) OR (nk % 7 = 3 AND year >= 2000)
                       OR (nk % 7 = 5 AND year <= 1996) OR nk = 24) THEN price END AS price_g,
         CASE WHEN (nk + year) % 4 <> 0 THEN balance END AS balance_g,
         CASE WHEN (nk * 2 + year) % 3 <> 0 THEN urgent_share END AS share_g
  FROM panel)"""

BASE = (GEO, PANEL)
GAPPED = (GEO, PANEL, GAPS)


# --- a panel that grows with the data --------------------------------------------------------------


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer × year in the years the customer ordered."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        money_sum("o_totalprice").alias("revenue"),
    )


CUSTOMERS = """customer_panel AS (
  SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
  FROM orders GROUP BY 1, 2)"""
