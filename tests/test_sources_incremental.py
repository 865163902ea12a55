from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from panelweave import session
from panelweave.functions.columns import MissingColumnsError
from panelweave.plans import publish as PB
from panelweave.sources import readers as RD
from panelweave.sources import writers as WR
from panelweave.streaming import incremental as INC


def test_csv_is_checked_and_cast(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("ID,v,extra\n1,2.5,x\n2,bad,y\n")
    spec = RD.SourceSpec("births", {"id": "int", "v": "double"}, renames={"ID": "id"})
    assert rows_of(RD.scan_csv(spark, str(path), spec)) == [(1, 2.5, "x"), (2, None, "y")]
    with pytest.raises(MissingColumnsError, match="births is missing required columns: w"):
        RD.scan_csv(spark, str(path), RD.SourceSpec("births", {"w": "int"}))


def test_parquet_wins_and_nothing_is_none(spark, tmp_path):
    df = spark.range(3)
    WR.write_table(df, f"{tmp_path}/b.csv")
    assert RD.scan_first_available(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).count() == 3
    WR.write_table(df.limit(1), f"{tmp_path}/b.parquet")
    assert RD.scan_first_available(spark, [f"{tmp_path}/b"]).count() == 1
    assert RD.scan_first_available(spark, [f"{tmp_path}/zz"]) is None
    with pytest.raises(ValueError, match="no writer"):
        WR.write_table(df, f"{tmp_path}/b.dta")


def test_yearly_layouts_and_globs(spark, tmp_path):
    def put(relative, text):
        target = tmp_path / relative
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    put("2003/act_2003/act_2003/act_2003.dat", "CASE,CODE,X\n1,a,9\n")
    put("2004/act-2004/act_2004.dat", "CASE,CODE,X\n2,b,9\n")
    put("2005/deep/er/act_final2005.dat", "CASE\n3\n")
    put("2005/deep/er/other_2005.dat", "CASE\n4\n")
    out = RD.scan_yearly_files(spark, str(tmp_path), [2003, 2004, 2005, 2006], "act", ["CASE", "CODE", "ABSENT"])
    assert rows_of(out, "case", "code", "source_year") == [("1", "a", 2003), ("2", "b", 2004), ("3", None, 2005)]
    assert RD.scan_yearly_files(spark, str(tmp_path), [1999], "act", ["CASE"]) is None
    put("2005/again/act_2005.dat", "CASE\n5\n")
    with pytest.raises(ValueError, match="act of 2005 is in more than one table"):
        RD.scan_yearly_files(spark, str(tmp_path), [2005], "act", ["CASE"])


def test_year_bound_and_columns_reach_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = RD.scan_columns_years(lines, ["l_orderkey", "l_quantity"], "l_shipdate", 1998)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate,1998-01-01" in plan and "l_extendedprice" not in plan


def test_nested_json_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"rows":[{"geoName":"Pune","coordinates":{"lat":18.5,"lng":73.8},"hybrid job":7}]}')
    docs = RD.scan_json_files(spark, str(tmp_path / "c.json"), "rows array<struct<geoName:string,coordinates:struct<lat:double,lng:double>,`hybrid job`:bigint>>")
    row = docs.select(F.explode("rows").alias("r")).select("r.geoName", "r.coordinates.lat", "r.`hybrid job`").first()
    assert tuple(row) == ("Pune", 18.5, 7)


def test_header_rows_follow_each_documents_own_header(spark):
    df = spark.createDataFrame([('[["a","b"],["1","2"],["3",null]]',), ('[["b","a"],["4","5"]]',), ("broken",)], "t string")
    assert rows_of(RD.header_rows(df, "t", ["a", "b", "c"], strict=False), "a", "b", "c") == sorted(
        [("1", "2", None), ("3", None, None), ("5", "4", None)], key=repr
    )
    assert rows_of(RD.broken_documents(df, "t")) == [("broken",)]
    with pytest.raises(Exception, match="document of another form: broken"):
        RD.header_rows(df, "t", ["a"]).collect()


def test_broken_records_are_reported(spark):
    df = spark.createDataFrame([(1, '{"rows": [{"a": 1}, {"a": 2}]}'), (2, '{"rows": [{"a":'), (3, None), (4, '{"rows": []}')], "d int, t string")
    assert rows_of(RD.record_rows(df, "t", "a int", {"a": "a"}, strict=False)) == [(1, 1), (1, 2)]
    assert rows_of(RD.broken_documents(df, "t", "a int"), "d") == [(2,)]
    with pytest.raises(Exception, match="document of another form"):
        RD.record_rows(df, "t", "a int", {"a": "a"}).collect()


def test_only_the_partitions_of_the_frame_are_replaced(spark, tmp_path):
    put = lambda rows: WR.overwrite_partitions(spark.createDataFrame(rows, "split string, v int"), f"{tmp_path}/t", ["split"])
    put([("train", 1), ("forecast", 2), ("forecast", 3)])
    put([("forecast", 9)])
    assert rows_of(spark.read.parquet(f"{tmp_path}/t"), "split", "v") == [("forecast", 9), ("train", 1)]


def test_several_machines_need_a_shared_folder(spark, monkeypatch):
    assert session.one_machine("local[8]") and not session.one_machine("local-cluster[2,1,1024]") and not session.one_machine("yarn")

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(type("Session", (), {"sparkContext": Context()})())


def test_script_wrapper(spark):
    df = spark.createDataFrame([("window.X = {\"a\": [1;2]};\n",), ("nothing",)], "t string")
    assert [r[0] for r in RD.unwrap_script(df, "t", "window.X").collect()] == ['{"a": [1;2]}', None]


def test_export_quotes_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'He said "x", ok', None)], "rank int, geography_name string, year int")
    rows = PB.export_rows(df, {"model": "m"})
    assert rows.columns == PB.EXPORT_HEADER and len(PB.EXPORT_HEADER) == 47
    WR.write_export_csv(rows.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    assert text[0].split(",") == PB.EXPORT_HEADER
    assert '"He said ""x"", ok"' in text[1] and text[1].startswith("1,")


def test_documents_keep_entities_without_data(spark):
    dim = spark.createDataFrame([("a", "A"), ("b", "B")], "e string, n string")
    panel = spark.createDataFrame([("a", 2021, 2.0), ("a", 2020, 1.0), ("a", 2022, None)], "e string, y int, v double")
    docs = PB.entity_documents(dim, panel, "e", "y", ["v"], ["v"], ["n"])
    got = {r.e: r for r in docs.collect()}
    assert [(p.year, p.v) for p in got["a"].series] == [(2020, 1.0), (2021, 2.0), (2022, None)]
    assert (got["a"].latest.v, got["a"].latest.v_year, got["b"].latest, got["b"].series) == (2.0, 2021, None, [])
    text = {r.e: r.document for r in PB.documents_json(docs, "e").collect()}
    assert text["b"] == '{"e":"b","n":"B","series":[]}'


def test_upsert_is_idempotent_and_newest_wins(spark):
    current = spark.createDataFrame([("k1", 1, "old"), ("k2", 1, "keep")], "k string, n int, v string")
    batch = spark.createDataFrame([("k1", 1, "newer"), ("k1", 2, "newest"), ("k3", 1, "add")], "k string, n int, v string")
    once = INC.upsert_keep_last(current, batch, ["k"], order=["n"])
    want = [("k1", "newest"), ("k2", "keep"), ("k3", "add")]
    assert rows_of(once, "k", "v") == want
    assert rows_of(INC.upsert_keep_last(once, batch, ["k"], order=["n"]), "k", "v") == want
    assert rows_of(INC.append_distinct(INC.append_distinct(None, batch), batch)) == rows_of(batch)


def test_backfill_plan_and_replace(spark):
    loaded = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x"), ("b", 1, "x")], "key string, year int, e string")
    plan = INC.backfill_plan(loaded, "key", "year", "e", keys=["a", "b"], years=[1, 2], expected=2)
    assert rows_of(plan) == [("a", 2), ("b", 1), ("b", 2)]
    cur = spark.createDataFrame([("train", 1), ("forecast", 2), (None, 3)], "split string, v int")
    new = spark.createDataFrame([("forecast", 9)], "split string, v int")
    assert rows_of(INC.replace_partition(cur, new, F.col("split") == "forecast"), "v") == [(1,), (3,), (9,)]


def test_stream_of_batches_keeps_the_newest_row(spark, tmp_path):
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    schema = "k string, n int"
    for i, rows in enumerate([[("a", 1), ("b", 1)], [("a", 3), ("a", 2)], [("c", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream.writeStream.foreachBatch(INC.foreach_batch_upsert(state, ["k"], ["n"]))
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = dict(rows_of(INC.stored_state(spark, state), "k", "n"))
    assert set(got) == {"a", "b", "c"} and got["b"] == 1 and got["c"] == 1
