"""A Spark data source for landed JSON documents: whole files, many small ones to a partition, only the wanted columns, files chosen by their path.

    register(spark)
    spark.read.format("landed_files").schema("place string, value double, source_year int")
        .option("files", r"year=(?P<source_year>[0-9]+)/").option("form", "records").load(folder)

The schema names the wanted columns: nothing else of a document is converted. Columns that are named groups of ``files`` come
from the path, and filters on them choose files before any is opened. Options:

``form``      ``header_rows``: arrays, the first of which is the header; ``records``: objects; ``positional``: arrays whose names
              stand in the document (``names_at``) or in the option ``names`` (a JSON list)
``rows_at``   dotted place of the rows in the document; empty for the document itself. Default: ``rows``, or empty for header_rows
``fields``    JSON object from column to its dotted place in a record or its name in a header; by default the column's own name
``variable``  the script variable that the document is assigned to, as in ``window.X = {...};``
``files``     a pattern that the path below the folder must hold
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
ROWS_AT_ONCE = 10_000
# Up to so many files are a partition each. More share partitions: of so many bytes, a file counting as its size and what opening costs.
FILES_ALONE, PART_BYTES, OPEN_BYTES = 64, 16 << 20, 256 << 10
_COMPARE = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b,
}


class DocumentError(ValueError):
    """A file that does not hold a document of the form that was asked for."""


def register(spark: SparkSession) -> None:
    """Make ``landed_files`` known to a session, and let it choose files by the filters of a query."""
    spark.dataSource.register(LandedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class LandedPart(InputPartition):
    """Files as (path, values of the columns that come from it)."""

    def __init__(self, files: list[tuple[str, dict[str, object]]]):
        super().__init__(files[0][0] if files else None)
        self.files = files


class LandedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_files"

    def schema(self) -> StructType:
        raise ValueError("name the wanted columns with schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return LandedReader(schema, dict(self.options))


class LandedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        unknown = [f.name for f in schema.fields if f.dataType.simpleString() not in ARROW]
        if unknown:
            raise TypeError(f"columns of plain types only, not {', '.join(unknown)}")
        self.columns = {f.name: ARROW[f.dataType.simpleString()] for f in schema.fields}
        self.folder, self.form = options["path"], options.get("form", "records")
        if self.form not in ("header_rows", "records", "positional"):
            raise ValueError(f"no form {self.form!r}")
        self.pattern = re.compile(options.get("files", ""))
        self.from_path = [c for c in self.columns if c in self.pattern.groupindex]
        self.rows_at = options.get("rows_at", "" if self.form == "header_rows" else "rows")
        self.fields = {c: c for c in self.columns} | json.loads(options.get("fields", "{}"))
        self.names, self.names_at = json.loads(options.get("names", "null")), options.get("names_at")
        self.variable = options.get("variable")
        self.chosen: list[tuple[str, object, object]] = []  # column, kind of filter, value

    # --- planning, on the driver ---------------------------------------------------------------------

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on columns of the path are settled by the choice of files; all others stay with Spark."""
        for f in filters:
            if type(f) in _COMPARE and f.attribute[0] in self.from_path:
                self.chosen.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files in the order of their paths; an empty choice is one partition without a file, since Spark asks for at least one."""
        system, root = fs.FileSystem.from_uri(self.folder)
        entries = system.get_file_info(fs.FileSelector(root, recursive=True))
        files: list[tuple[str, dict[str, object]]] = []
        costs: list[int] = []
        for entry in sorted(entries, key=lambda e: e.path):
            below = entry.path.removeprefix(root).lstrip("/")
            match = self.pattern.search(below)
            hidden = any(p.startswith(("_", ".")) for p in below.split("/"))
            if entry.type == fs.FileType.File and match and not hidden:
                found = {c: self._typed(c, match[c]) for c in self.from_path}
                if all(found[c] is not None and _COMPARE[kind](found[c], value) for c, kind, value in self.chosen):
                    files.append((entry.path, found))
                    costs.append((entry.size or 0) + OPEN_BYTES)
        if len(files) <= FILES_ALONE:
            return [LandedPart([f]) for f in files] or [LandedPart([])]
        room, parts, used = min(PART_BYTES, -(-sum(costs) // FILES_ALONE)), [[]], 0
        for file, cost in zip(files, costs):
            if parts[-1] and used + cost > room:
                parts.append([])
                used = 0
            parts[-1].append(file)
            used += cost
        return [LandedPart(p) for p in parts]

    def _typed(self, column: str, text: str | None) -> object:
        if text is None or self.columns[column] == pa.string():
            return text
        return float(text) if pa.types.is_floating(self.columns[column]) else int(text)

    # --- reading, file after file -----------------------------------------------------------------------

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        for path, found in partition.files:
            yield from self._document(system, path, found)

    def _document(self, system: fs.FileSystem, path: str, found: dict[str, object]) -> Iterator[pa.RecordBatch]:
        with system.open_input_stream(path) as stream:
            text = stream.read().decode("utf-8")
        try:
            document = json.loads(self._body(text))
            rows, getters = self._rows(document)
            for at in range(0, len(rows), ROWS_AT_ONCE):
                yield self._batch(rows[at : at + ROWS_AT_ONCE], getters, found)
        except (ValueError, TypeError, KeyError, IndexError, AttributeError, pa.ArrowException) as error:
            raise DocumentError(f"{path} holds no document of the form {self.form}: {error}") from error

    def _body(self, text: str) -> str:
        if self.variable is None:
            return text
        match = re.fullmatch(rf"\s*{re.escape(self.variable)}\s*=\s*(.*?);?\s*", text, re.S)
        if not match:
            raise ValueError(f"it does not assign {self.variable}")
        return match[1]

    def _rows(self, document: object) -> tuple[list, dict]:
        """The rows, and for every wanted column how to get it from one; a column that is not there is missing."""
        rows = _at(document, self.rows_at)
        if not isinstance(rows, list):
            raise ValueError("its rows are not a list")
        wanted = {c: self.fields[c] for c in self.columns if c not in self.from_path}
        if self.form == "records":
            return rows, {c: (lambda row, place=place: _at(row, place, None)) for c, place in wanted.items()}
        if self.form == "header_rows":
            names, rows = (rows[0], rows[1:]) if rows else ([], [])
        else:
            names = self.names if self.names is not None else _at(document, self.names_at or "schema")
        index = {name: i for i, name in reversed(list(enumerate(names)))}
        return rows, {c: (lambda row, i=index.get(n): row[i] if i is not None and i < len(row) else None) for c, n in wanted.items()}

    def _batch(self, rows: list, getters: dict, found: dict[str, object]) -> pa.RecordBatch:
        arrays = []
        for column, kind in self.columns.items():
            values = [found[column]] * len(rows) if column in found else [getters[column](row) for row in rows]
            if kind == pa.string():
                values = [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values]
            arrays.append(pa.array(values, kind))
        return pa.RecordBatch.from_arrays(arrays, names=list(self.columns))


_REQUIRED = object()


def _at(value: object, place: str | None, otherwise: object = _REQUIRED) -> object:
    """What stands at a dotted place of nested objects."""
    for part in place.split(".") if place else []:
        if not isinstance(value, dict) or part not in value:
            if otherwise is _REQUIRED:
                raise ValueError(f"it has no {place}")
            return otherwise
        value = value[part]
    return value
