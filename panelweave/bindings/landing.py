"""Queries of the scans, sinks and incremental batches.

Files are written by Spark under the shared checkpoint folder, from the given tables,
and read back by the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import ranking as R
from ..plans import publish as PB
from ..session import materialize
from ..sources import landed
from ..sources import readers as RD
from ..sources import snapshots as SN
from ..sources import writers as WR
from ..streaming import incremental as INC
from .aggregating import LINES, SUB_NAMES, ci_sql, measures, sub_sql
from .base import BASE, micro, panel, query, rounded, scratch, sql, table


@query(
    "scan_csv_checked",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, TRY_CAST(c_mktsegment AS DOUBLE) AS bad_number, c_nationkey AS nation FROM customer",
)
def scan_csv_checked(spark, sf_dir):
    path = scratch(spark, "customer") + ".csv"
    WR.write_table(table(spark, sf_dir, "customer"), path)
    spec = RD.SourceSpec(
        "customers", {"id": "bigint", "name": "string", "balance": "double"}, {"bad_number": "double", "nation": "int", "absent": "int"},
        {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "bad_number", "c_nationkey": "nation"},
    )
    return RD.scan_csv(spark, path, spec).select("id", "name", "balance", "bad_number", "nation")


@query("scan_first_available", "SELECT s_suppkey, s_name, s_nationkey, 'parquet' AS kind FROM supplier")
def scan_first_available(spark, sf_dir):
    base = scratch(spark, "supplier")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    WR.write_table(rows.withColumn("kind", F.lit("parquet")), f"{base}/panel.parquet")
    WR.write_table(rows.withColumn("kind", F.lit("csv")), f"{base}/panel.csv")
    return RD.scan_first_available(spark, [f"{base}/preferred", f"{base}/panel"])


@query(
    "scan_yearly_files",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderstatus END AS o_orderstatus,
              CAST(year(o_orderdate) AS INTEGER) AS source_year FROM orders""",
)
def scan_yearly_files(spark, sf_dir):
    """One folder per year in changing layouts; early years lack a column; one year has no file."""
    base = scratch(spark, "yearly")
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    layouts = ["act_{y}/act_{y}/act_{y}.dat", "act-{y}/act-{y}.dat", "act_{y}/act_{y}.dat", "act-{y}/act_{y}.dat"]
    first, last = orders.agg(F.min("year"), F.max("year")).first()
    for i, y in enumerate(range(first, last + 1)):
        columns = ["O_ORDERKEY", "O_ORDERPRIORITY"] + (["O_ORDERSTATUS"] if y >= 1998 else [])
        rows = orders.filter(F.col("year") == y).select(*[F.col(c.lower()).alias(c) for c in columns], "o_totalprice")
        rows.write.option("header", True).csv(f"{base}/{y}/{layouts[i % 4].format(y=y)}")
    wanted = ["O_ORDERKEY", "O_ORDERPRIORITY", "O_ORDERSTATUS", "ABSENT"]
    return RD.scan_yearly_files(spark, base, range(first, last + 3), "act", wanted)


@query(
    "scan_columns_years",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'",
)
def scan_columns_years(spark, sf_dir):
    return RD.scan_columns_years(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity", "absent"], "l_shipdate", 1998)


@query(
    "scan_json_header_rows",
    """SELECT c_custkey AS doc, 1 AS _pos, CAST(c_nationkey AS VARCHAR) AS state, c_mktsegment AS value FROM customer
       UNION ALL SELECT c_custkey, 2, c_name, NULL FROM customer""",
)
def scan_json_header_rows(spark, sf_dir):
    """Per customer a document ``[["state","value"], [..], [..]]``; every other one has the columns the other way round."""
    text = lambda c: F.col(c).cast("string")
    swap = F.col("c_custkey") % 2 == 1
    pair = lambda a, b: F.when(swap, F.array(b, a)).otherwise(F.array(a, b))
    rows = F.array(
        pair(F.lit("state"), F.lit("value")), pair(text("c_nationkey"), F.col("c_mktsegment")), pair(F.col("c_name"), F.lit(None).cast("string"))
    )
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.to_json(rows).alias("text"))
    return RD.header_rows(docs, "text", ["state", "value"])


@query(
    "scan_json_records",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS place, value AS lat, CAST(json_extract_string(props, '$.k') AS BIGINT) AS hybrid_work FROM events
       UNION ALL SELECT event_id, event_type, NULL, -1 FROM events""",
)
def scan_json_records(spark, sf_dir):
    """Per event a document ``{"rows": [...]}`` with nested coordinates and a name with a space."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    record = lambda name, lat, n: F.struct(
        name.alias("geoName"), F.struct(lat.alias("lat"), F.lit(0.5).alias("lng")).alias("coordinates"), n.alias("hybrid work")
    )
    rows = F.array(
        record(F.col("user_id").cast("string"), F.col("value"), k),
        record(F.col("event_type"), F.lit(None).cast("double"), F.lit(-1).cast("bigint")),
    )
    docs = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(rows.alias("rows"))).alias("text"))
    return RD.record_rows(
        docs, "text", "geoName string, coordinates struct<lat: double, lng: double>, `hybrid work` bigint",
        {"place": "geoName", "lat": "coordinates.lat", "hybrid_work": "`hybrid work`"},
    )


@query(
    "decode_array_records",
    """SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag, l_linestatus AS status, CAST(NULL AS VARCHAR) AS absent,
              l_linestatus AS status_by_schema FROM lineitem""",
)
def decode_array_records(spark, sf_dir):
    flip = F.col("l_suppkey") % 2 == 0
    values = F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    own = F.when(flip, F.array(F.lit("flag"), F.lit("status"))).otherwise(F.array(F.lit("status"), F.lit("flag")))
    mixed = F.when(flip, F.array("l_returnflag", "l_linestatus")).otherwise(F.array("l_linestatus", "l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", values.alias("values"), own.alias("schema"), mixed.alias("mixed"))
    fixed = RD.decode_positional(rows, "values", ["line", "flag", "status", "absent"])
    renamed = fixed.withColumnsRenamed({"status": "s", "flag": "f"})
    out = RD.decode_with_schema(renamed, "mixed", "schema", ["status"])
    return out.select("l_orderkey", "line", F.col("f").alias("flag"), F.col("s").alias("status"), "absent", F.col("status").alias("status_by_schema"))


@query("strip_js_wrapper_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events")
def strip_js_wrapper_json(spark, sf_dir):
    body = F.to_json(F.struct("props", "value"))
    script = F.concat(F.lit("window.PANEL = "), body, F.when(F.col("event_id") % 2 == 0, F.lit(";\n")).otherwise(F.lit("")))
    docs = RD.unwrap_script(table(spark, sf_dir, "events").select("event_id", script.alias("text")), "text", "window.PANEL")
    parsed = F.from_json("json", "struct<props: string, value: double>")
    return docs.select("event_id", F.get_json_object(parsed["props"], "$.k").cast("bigint").alias("k"), parsed["value"].alias("value"))


PER_DOCUMENT = 1000


@query("scan_landed_files", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS absent, c_nationkey AS nation FROM customer WHERE c_nationkey >= 7")
def scan_landed_files(spark, sf_dir):
    """Customers as script files of positional rows, in a folder per nation; every other file has its columns in another order."""
    path = scratch(spark, "script-files")
    rows = table(spark, sf_dir, "customer").withColumn("block", F.floor(F.col("c_custkey") / PER_DOCUMENT))
    flip = F.col("block") % 2 == 0
    cells = {"id": "c_custkey", "balance": "c_acctbal", "name": "c_name", "segment": "c_mktsegment"}
    cell = lambda n: F.regexp_extract(F.to_json(F.array(cells[n])), r"(?s)^\[(.*)\]$", 1)
    plain = lambda order: F.concat(F.lit("["), F.concat_ws(",", *map(cell, order)), F.lit("]"))
    orders = list(cells), list(cells)[::-1]
    names = lambda order: F.lit("[" + ",".join(f'"{n}"' for n in order) + "]")
    docs = rows.groupBy("c_nationkey", "block").agg(F.array_sort(F.collect_list(F.when(flip, plain(orders[0])).otherwise(plain(orders[1])))).alias("lines"))
    text = F.concat(
        F.lit('window.CUSTOMERS = {"schema":'), F.when(flip, names(orders[0])).otherwise(names(orders[1])), F.lit(',"rows":['), F.array_join("lines", ","), F.lit("]};")
    )
    docs.select(text.alias("value"), F.col("c_nationkey").alias("nation")).write.partitionBy("nation").option("maxRecordsPerFile", 1).text(path)
    landed.register(spark)
    found = (
        spark.read.format("landed_files").schema("id bigint, balance double, segment string, absent string, nation int")
        .option("form", "positional").option("variable", "window.CUSTOMERS").option("files", r"nation=(?P<nation>\d+)/").load(path)
    )
    return found.filter("nation >= 7")


@query(
    "write_table",
    sql(
        """SELECT entity, year, n_orders, region, 'parquet' AS kind FROM panel UNION ALL SELECT entity, year, n_orders, region, 'csv' FROM panel""", *BASE
    ),
)
def write_table(spark, sf_dir):
    base = scratch(spark, "tables")
    rows = panel(spark, sf_dir).select("entity", "year", "n_orders", "region")
    WR.write_table(rows, f"{base}/deep/panel.parquet", partition_by=["year"])
    WR.write_table(rows, f"{base}/deep/panel.csv")
    a = spark.read.parquet(f"{base}/deep/panel.parquet").select(F.col("entity").cast("string"), "year", "n_orders", "region")
    b = spark.read.option("header", True).schema(rows.schema).csv(f"{base}/deep/panel.csv")
    return a.withColumn("kind", F.lit("parquet")).unionByName(b.withColumn("kind", F.lit("csv")))


@query("write_json_records", "SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'MACHINERY') AS segment, c_mktsegment = 'MACHINERY' AS wrote_null FROM customer")
def write_json_records(spark, sf_dir):
    path = scratch(spark, "records") + ".json"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("segment"))
    WR.write_json_records(rows, path)
    text = spark.read.text(path)
    return text.select(
        F.from_json("value", rows.schema).alias("r"), F.col("value").contains('"segment":null').alias("wrote_null")
    ).select("r.*", "wrote_null")


def export_sql() -> str:
    have = {
        "geography_id": "entity", "geography_name": "entity_name", "state_name": "region", "year": "CAST(year AS VARCHAR)",
        "rank": "CASE WHEN n_orders > 85 THEN CAST(n_orders AS VARCHAR) ELSE '' END", "geography_type": "'state'", "main_driver": "'say \"hi\", twice'",
        "unit_label": "'orders'",
    }
    return "SELECT " + ", ".join(f"{have.get(h, chr(39) * 2)} AS {h}" for h in PB.EXPORT_HEADER) + " FROM panel"


@query("export_csv_fixed_header", sql(export_sql(), *BASE))
def export_csv_fixed_header(spark, sf_dir):
    """Written as quoted CSV and read back; a blank cell comes back blank."""
    rows = panel(spark, sf_dir).select(
        F.col("entity").alias("geography_id"), F.col("entity_name").alias("geography_name"), F.col("region").alias("state_name"), "year",
        F.when(F.col("n_orders") > 85, F.col("n_orders")).alias("rank"), F.lit('say "hi", twice').alias("main_driver"),
    )
    path = scratch(spark, "export") + ".csv"
    WR.write_export_csv(PB.export_rows(rows, {"geography_type": "state", "unit_label": "orders"}), path)
    back = spark.read.option("header", True).option("escape", '"').schema(", ".join(f"`{h}` string" for h in PB.EXPORT_HEADER)).csv(path)
    return back.fillna("")


@query(
    "upsert_keep_last",
    """SELECT o_orderkey, o_custkey, o_orderpriority, late FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY late DESC, o_orderkey DESC) AS k
       FROM (SELECT *, year(o_orderdate) >= 1999 AS late FROM orders)) WHERE k = 1""",
)
def upsert_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", (F.year("o_orderdate") >= 1999).alias("late")
    )
    keys = ["o_custkey", "o_orderpriority"]
    current = INC.upsert_keep_last(None, rows.filter("NOT late"), keys, order=["o_orderkey"])
    return INC.upsert_keep_last(current, rows.filter("late"), keys, order=["o_orderkey"])


@query("append_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, CASE WHEN l_quantity > 25 THEN l_linestatus END AS l_linestatus FROM lineitem")
def append_distinct(spark, sf_dir):
    status = F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).alias("l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", status)
    return INC.append_distinct(INC.append_distinct(None, rows.filter("l_suppkey % 2 = 0")), rows)


@query(
    "incremental_backfill_plan",
    """WITH g AS (SELECT unnest(['click', 'view', 'purchase', 'refund']) AS event_type), y AS (SELECT CAST(unnest(range(1, 36)) AS INTEGER) AS day),
            c AS (SELECT event_type, CAST(day(ts) AS INTEGER) AS day FROM events GROUP BY ALL HAVING count(DISTINCT user_id) >= 60)
       SELECT g.event_type, y.day FROM g, y WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.event_type = g.event_type AND c.day = y.day)""",
)
def incremental_backfill_plan(spark, sf_dir):
    loaded = table(spark, sf_dir, "events").select("event_type", F.dayofmonth(F.col("ts").cast("date")).alias("day"), "user_id")
    return INC.backfill_plan(
        loaded, "event_type", "day", "user_id", keys=["click", "view", "purchase", "refund"], years=range(1, 36), expected=60
    )


@query(
    "replace_partition",
    """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS split, o_totalprice AS value, CAST(NULL AS VARCHAR) AS model FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL
       UNION ALL SELECT o_orderkey, 'F', o_totalprice * 2, 'new' FROM orders WHERE o_orderstatus = 'F'""",
)
def replace_partition(spark, sf_dir):
    """Stored by split; the rows of one split are swapped in one commit and bring a new column, the other splits keep their files."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("split"), F.col("o_totalprice").alias("value")
    )
    stored = SN.SnapshotTable(spark, scratch(spark, "splits"))
    SN.replace_partitions(stored, rows, ["split"])
    old = SN.read_partitions(stored, ["split"], [("F",)])
    SN.replace_partitions(stored, old.withColumns({"value": F.col("value") * 2, "model": F.lit("new")}), ["split"])
    return stored.read().select("o_orderkey", "split", "value", "model")


@query(
    "bucketed_upsert",
    """SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY year(o_orderdate) DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""",
)
def bucketed_upsert(spark, sf_dir):
    """One batch per year into hash buckets, each sent twice: a later batch beats what is stored, inside a batch the largest key."""
    base, keys = scratch(spark, "upserts"), ["o_custkey", "o_orderpriority"]
    rows = table(spark, sf_dir, "orders").select(*keys, "o_orderkey", F.year("o_orderdate").alias("year"))
    years = [r[0] for r in rows.select("year").distinct().orderBy("year").collect()]  # one per year
    apply = INC.foreach_batch_upsert(base, keys, ["o_orderkey"], buckets=16)
    for number, year in enumerate(years):
        for _ in range(2):
            apply(rows.filter(F.col("year") == year).drop("year"), number)
    return INC.stored_state(spark, base).select(*keys, "o_orderkey")


ORDER_FILES = 6


def order_stream(spark, sf_dir):
    """Orders as a stream of ``ORDER_FILES`` files in an order of their own: one micro-batch per file."""
    source = scratch(spark, "order-files")
    rows = table(spark, sf_dir, "orders").withColumn("part", (F.col("o_orderkey") % ORDER_FILES).cast("int"))
    rows.repartition(ORDER_FILES, "part").write.partitionBy("part").parquet(source)
    schema = rows.drop("part").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)


def run_to_the_end(stream, spark, apply) -> None:
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_latest_rows",
    """SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC) AS k FROM orders)
       WHERE k = 1 GROUP BY o_custkey, o_orderpriority""",
)
def stream_latest_rows(spark, sf_dir):
    """The latest order per customer and priority, kept up by a stream in hash buckets: a batch never replaces a later order."""
    base, keys = scratch(spark, "newest"), ["o_custkey", "o_orderpriority"]
    latest = lambda rows, by: R.top_per_group(rows, by, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 1).select(*by, "o_orderdate", "o_orderkey")
    partials = lambda batch: latest(batch.select(*keys, "o_orderdate", "o_orderkey"), keys)
    run_to_the_end(order_stream(spark, sf_dir), spark, INC.foreach_batch_accumulate(base, keys, partials, latest, buckets=16))
    return INC.stored_state(spark, base).select(*keys, "o_orderkey")


@query(
    "stream_moment_state",
    sql(
        ci_sql("o_orderpriority, month", "o", "o_totalprice", "w", "price"),
        "o AS (SELECT *, CAST(month(o_orderdate) AS INTEGER) AS month, 1.0 + o_custkey % 7 AS w FROM orders)",
        doubles="price price_se price_ci_low price_ci_high",
    ),
)
def stream_moment_state(spark, sf_dir):
    """Weighted means with intervals from stored moments, to which a stream adds batch by batch; each row is read once."""
    base, keys = scratch(spark, "moments"), ["o_orderpriority", "month"]
    rows = order_stream(spark, sf_dir).select(
        "o_orderpriority", F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("price"), (F.lit(1.0) + F.col("o_custkey") % 7).alias("w")
    )
    partials = lambda batch: A.moment_states(batch, keys, ["price"], "w")
    add = lambda stored, by: A.merge_moments(stored, by, ["price"])
    run_to_the_end(rows, spark, INC.foreach_batch_accumulate(base, keys, partials, add, buckets=8))
    return rounded(A.finish_moments(INC.stored_state(spark, base), keys, ["price"]))


@query("stream_panel_state", sql(sub_sql("entity, year"), *LINES, doubles=SUB_NAMES))
def stream_panel_state(spark, sf_dir):
    """Ten weighted measures of sub-populations from stored numerators and denominators, accumulated in three batches, one replayed."""
    base, keys, names = scratch(spark, "panel-state"), ["entity", "year"], [m.name for m in measures()]
    lines = materialize(micro(spark, sf_dir))
    apply = INC.foreach_batch_accumulate(base, keys, lambda batch: A.panel_partials(batch, keys, "l_quantity", measures()), lambda rows, by: A.add_partials(rows, by, names), buckets=8)
    for number, part in [(0, 0), (1, 1), (1, 1), (2, 2)]:
        apply(lines.filter(F.pmod(F.col("l_orderkey"), F.lit(3)) == part), number)
    return rounded(A.finish_partials([INC.stored_state(spark, base)], keys, names))
