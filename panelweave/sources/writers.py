"""Sinks: tables by suffix, JSON records, fixed-header CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """Parquet or CSV by the path's suffix; parent folders are made by the writer."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith(".parquet"):
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for {path!r}: use .parquet or .csv")


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace exactly the partitions that ``df`` has rows of; the other folders of the table are not touched or read."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def json_records(df: DataFrame, columns: Sequence[str] | None = None, name: str = "record") -> DataFrame:
    """One JSON text per row; missing values are written as null."""
    chosen = list(columns or df.columns)
    return df.select(F.to_json(F.struct(*chosen), {"ignoreNullFields": "false"}).alias(name))


def write_json_records(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    json_records(df, columns).write.mode("overwrite").text(path)


def write_export_csv(rows: DataFrame, path: str) -> None:
    """Quoted where needed, a quote inside a value doubled, blanks kept blank."""
    (
        rows.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
