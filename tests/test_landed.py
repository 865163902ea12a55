"""The data source of landed documents: forms, wanted columns, files chosen by path, and documents of another form."""

from __future__ import annotations

import json

import pytest
from conftest import rows_of

from panelweave.sources.landed import DocumentError, LandedReader, register


@pytest.fixture(scope="module")
def reader(spark):
    register(spark)
    return lambda schema, **options: spark.read.format("landed_files").schema(schema).options(**options)


def put(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text if isinstance(text, str) else json.dumps(text, ensure_ascii=False))
    return str(folder)


def test_headers_records_and_positional_rows(reader, tmp_path):
    heads = put(tmp_path / "h", {"a.json": [["place", "v", "w"], ["x", 1, "é"], ["y", None, 2]], "b.json": [["v", "place"], [3, "z"]], "c.json": []})
    assert rows_of(reader("place string, v bigint, w string", form="header_rows").load(heads)) == sorted([("x", 1, "é"), ("y", None, "2"), ("z", 3, None)], key=repr)
    records = put(tmp_path / "r", {"a.json": {"data": {"list": [{"geo": {"name": "x"}, "n": 1.5}, {"geo": {}, "n": None}, {}]}}})
    found = reader("name string, n double", form="records", rows_at="data.list", fields='{"name": "geo.name"}').load(records)
    assert rows_of(found) == sorted([("x", 1.5), (None, None), (None, None)], key=repr)
    script = put(tmp_path / "s", {"a.js": 'window.P = {"schema": ["v", "k"], "rows": [[1, "a"], [2]]};\n', "b.js": 'window.P = {"rows": [["b", 5]], "schema": ["k", "v"]}'})
    assert rows_of(reader("k string, v int", form="positional", variable="window.P").load(script)) == sorted([("a", 1), (None, 2), ("b", 5)], key=repr)
    fixed = put(tmp_path / "f", {"a.json": {"rows": [[1, 2], [3, 4]]}})
    assert rows_of(reader("second int", form="positional", names='["first", "second"]').load(fixed)) == [(2,), (4,)]


def test_only_wanted_columns_are_read(reader, tmp_path):
    """A column that would not convert does no harm unless it is asked for."""
    path = put(tmp_path / "d", {"a.json": {"rows": [{"good": 1, "bad": "no number", "huge": 10**30}]}})
    assert rows_of(reader("good int").load(path)) == [(1,)]
    with pytest.raises(Exception, match="a.json holds no document of the form records"):
        reader("good int, bad int").load(path).collect()
    asked = LandedReader(reader("good int").load(path).schema, {"path": path})
    batches = [b for p in asked.partitions() for b in asked.read(p)]
    assert [b.schema.names for b in batches] == [["good"]]


def test_files_are_chosen_by_their_path(spark, reader, tmp_path):
    path = put(tmp_path / "y", {f"{y}/act_{y}.json": {"rows": [{"v": y - 2000}]} for y in range(2001, 2008)} | {"2003/note.txt": "no document", "_SUCCESS": "", "2005/.x.json": "{"})
    table = reader("v int, source_year int", files=r"act_(?P<source_year>\d{4})\.json$").load(path)
    assert table.rdd.getNumPartitions() == 7
    some = table.filter("source_year >= 2005 AND v <> 6")
    assert rows_of(some) == [(5, 2005), (7, 2007)] and some.rdd.getNumPartitions() == 3
    assert rows_of(table.filter("source_year IN (2001, 2009)")) == [(1, 2001)]
    assert table.filter("source_year > 2010").collect() == [] and table.filter("source_year = 2002").count() == 1
    broken = put(tmp_path / "y", {"2009/act_2009.json": "{"})
    assert rows_of(reader("v int, source_year int", files=r"act_(?P<source_year>\d{4})\.json$").load(broken).filter("source_year < 2002")) == [(1, 2001)]


@pytest.mark.parametrize(("text", "options"), [
    ('{"rows": 5}', {}), ('{"other": []}', {}), ("[1, 2", {}), ("window.Q = {}", {"variable": "window.P"}), ('{"rows": [[1]]}', {"form": "positional"}),
])
def test_other_documents_fail_with_their_name(reader, tmp_path, text, options):
    path = put(tmp_path / "b", {"odd.json": text})
    with pytest.raises(Exception, match="odd.json holds no document of the form"):
        reader("v int", **options).load(path).collect()


def test_a_schema_is_needed_and_plain(spark, reader, tmp_path):
    path = put(tmp_path / "d", {"a.json": {"rows": []}})
    assert reader("v int").load(path).collect() == []
    with pytest.raises(Exception, match="name the wanted columns"):
        spark.read.format("landed_files").load(path)
    with pytest.raises(Exception, match="columns of plain types only, not v"):
        reader("v array<int>").load(path).collect()
    assert issubclass(DocumentError, ValueError)


def test_many_small_files_share_partitions(reader, tmp_path):
    """Rows and values from the path are the same; the number of tasks does not follow the number of files."""
    path = put(tmp_path / "m", {f"year={y}/{i:04}.json": {"rows": [{"v": 1000 * y + i}]} for y in range(2) for i in range(300)})
    found = reader("v bigint, year int", form="records", files=r"year=(?P<year>\d+)/").load(path)
    assert found.rdd.getNumPartitions() <= 100
    assert rows_of(found) == sorted([(1000 * y + i, y) for y in range(2) for i in range(300)], key=repr)
    assert rows_of(found.filter("year = 1")) == sorted([(1000 + i, 1) for i in range(300)], key=repr)
