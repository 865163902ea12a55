"""Scans of landed files with declared schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import require_columns


@dataclass(frozen=True)
class SourceSpec:
    """Name, required columns, optional columns with types, and renames of one input."""

    name: str
    required: Mapping[str, str]
    optional: Mapping[str, str] = field(default_factory=dict)
    renames: Mapping[str, str] = field(default_factory=dict)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system the path belongs to (local, HDFS or object store)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def scan_csv(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    """Delimited text as strings, renamed, checked and cast; bad numbers become NULL.

    Columns that the file has beyond the specification pass through as text.
    """
    raw = spark.read.option("header", True).csv(path).withColumnsRenamed(dict(spec.renames))
    require_columns(raw, spec.required, spec.name)
    types = {**spec.required, **{c: t for c, t in spec.optional.items() if c in raw.columns}}
    return raw.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if t != "string"})


def scan_first_available(spark: SparkSession, stems: Sequence[str]) -> DataFrame | None:
    """The first stem that exists, Parquet before CSV; None if there is nothing."""
    for stem in stems:
        if path_exists(spark, f"{stem}.parquet"):
            return spark.read.parquet(f"{stem}.parquet")
        if path_exists(spark, f"{stem}.csv"):
            return spark.read.option("header", True).csv(f"{stem}.csv")
    return None


def component_tables(spark: SparkSession, root: str, component: str, year: int) -> list[str]:
    """All tables of one component and year under a folder, whatever its layout, by one listing of the file system.

    A table is a file or a folder of part files whose name begins with the component and ends with ``<year>.dat``. A folder
    that does not exist has none; any other failure of the file system is raised.
    """
    if not path_exists(spark, root):
        return []
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    found, listing = set(), folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True)
    named = re.compile(rf"(.*/{re.escape(component)}[^/]*{year}\.dat)(?:/[^/]+)?$")
    while listing.hasNext():
        match = named.match(listing.next().getPath().toString())
        if match:
            found.add(match[1])
    return sorted(found)


def scan_yearly_files(
    spark: SparkSession, base: str, years: Sequence[int], component: str, columns: Sequence[str]
) -> DataFrame | None:
    """One component from a folder per year, the wanted columns that exist, lower-cased and stacked.

    The year comes from each file's path. Years with the same header share one scan. Two tables that both claim a component
    and year are an error.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for year in years:
        found = component_tables(spark, f"{base}/{year}", component, year)
        if len(found) > 1:
            raise ValueError(f"{component} of {year} is in more than one table: {', '.join(found)}")
        if found:
            header = tuple(spark.read.option("header", True).csv(found[0]).columns)
            by_header.setdefault(header, []).append(found[0])
    out = None
    for header, files in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        year_of_path = F.regexp_extract(F.col("_metadata.file_path"), rf"{re.escape(component)}[^/]*?(\d{{4}})\.dat", 1)
        frame = (
            spark.read.option("header", True)
            .schema(schema)
            .csv(files)
            .select(*[F.col(c).alias(c.lower()) for c in columns if c in header], year_of_path.cast("int").alias("source_year"))
        )
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def scan_columns_years(df: DataFrame, columns: Sequence[str], year: str, min_year: int) -> DataFrame:
    """A column subset from ``min_year`` on; both reach the Parquet scan.

    ``year`` is a year number or a date or timestamp, which is compared with the first
    day of ``min_year`` so that the bound can be pushed down.
    """
    dated = isinstance(df.schema[year].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    bound = F.lit(f"{min_year:04d}-01-01").cast(df.schema[year].dataType) if dated else F.lit(min_year)
    return df.filter(F.col(year) >= bound).select(*[c for c in columns if c in df.columns])


def _parsed(df: DataFrame, text: str, value: Column, strict: bool) -> Column:
    """The parsed part of a JSON text; a text without it raises an error that shows its beginning, unless ``strict`` is off."""
    broken = F.col(text).isNotNull() & value.isNull()
    message = F.concat(F.lit(f"column {text} holds a document of another form: "), F.substring(F.col(text), 1, 80))
    return F.when(broken, F.raise_error(message)).otherwise(value) if strict else value


def _header_arrays(text: str) -> Column:
    return F.from_json(F.col(text), "array<array<string>>")


def _record_arrays(text: str, schema: str) -> Column:
    return F.from_json(F.col(text), f"struct<rows:array<struct<{schema}>>>")["rows"]


def broken_documents(df: DataFrame, text: str, schema: str | None = None) -> DataFrame:
    """The rows whose text is neither missing nor of the form ``header_rows`` (or, with a schema, ``record_rows``) reads."""
    value = _record_arrays(text, schema) if schema else _header_arrays(text)
    return df.filter(F.col(text).isNotNull() & value.isNull())


def header_rows(df: DataFrame, text: str, header: Sequence[str], *, strict: bool = True) -> DataFrame:
    """JSON texts that hold arrays of arrays, the first inner array being the header.

    Columns are found by the position their name has in each document's own header. A text of another form fails the query;
    without ``strict`` it gives no rows, and ``broken_documents`` lists it.
    """
    parsed = df.withColumn("_rows", _parsed(df, text, _header_arrays(text), strict)).drop(text)
    heads = parsed.withColumn("_head", F.get(F.col("_rows"), F.lit(0)))
    rows = heads.select("*", F.posexplode("_rows").alias("_pos", "_row")).filter("_pos > 0")
    cells = {
        h: F.get(F.col("_row"), F.nullif(F.array_position("_head", F.lit(h)), F.lit(0).cast("long")).cast("int") - 1) for h in header
    }
    return rows.withColumns(cells).drop("_rows", "_head", "_row")


def record_rows(df: DataFrame, text: str, schema: str, fields: Mapping[str, str], *, strict: bool = True) -> DataFrame:
    """JSON texts ``{"rows": [...]}`` to one row per record; nested parts by dotted path. ``strict`` as in ``header_rows``."""
    parsed = df.withColumn("_found", _parsed(df, text, _record_arrays(text, schema), strict))
    rows = parsed.select(*[c for c in df.columns if c != text], F.explode("_found").alias("_row"))
    return rows.select(
        *[c for c in rows.columns if c != "_row"], *[F.col(f"_row.{path}").alias(name) for name, path in fields.items()]
    )


def scan_json_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole JSON documents, one per file, with nested records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def decode_positional(df: DataFrame, values: str, names: Sequence[str] | str) -> DataFrame:
    """Positional arrays to named columns.

    ``names`` is the fixed list of names, or the column that holds each row's own names.
    """
    if isinstance(names, str):
        raise TypeError("give the list of names; use decode_with_schema for a schema column")
    return df.withColumns({n: F.get(F.col(values), F.lit(i)) for i, n in enumerate(names)}).drop(values)


def decode_with_schema(df: DataFrame, values: str, schema: str, names: Sequence[str]) -> DataFrame:
    """As ``decode_positional``, with the names array of each row deciding the place."""
    table = F.map_from_arrays(F.col(schema), F.col(values))
    return df.withColumn("_map", table).withColumns({n: F.try_element_at("_map", F.lit(n)) for n in names}).drop(
        "_map", values, schema
    )


def unwrap_script(df: DataFrame, text: str, variable: str, name: str = "json") -> DataFrame:
    """``window.X = {...};`` to its JSON text."""
    body = F.regexp_extract(F.col(text), rf"(?s)^\s*{re.escape(variable)}\s*=\s*(.*?);?\s*$", 1)
    return df.withColumn(name, F.nullif(body, F.lit(""))).drop(text)
