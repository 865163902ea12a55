"""Exact duplicates by 128-bit content hash, with the bytes compared inside every hash group. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import text_or_empty

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


COPIES_AT_ONCE = 1 << 12  # equal rows that one array brings back


def exact_duplicates(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are grouped by ``digest`` of the text and, inside a digest, by the text itself, so texts that only share a digest
    are different groups. Of a group the row with the smallest (or, with ``keep="largest"``, largest) doc_id stays. Texts are
    pre-aggregated in each task before the one shuffle that carries them: a hot text is sent once per task. Rows find their
    group by digest and SHA-256, as short rows, in an inner join that the adaptive skew join splits.

    A null text counts as empty. A row without doc_id stays only if no row of its group has one; keep_id is then null. Of
    rows that repeat the kept doc_id with the same text exactly one is kept: such rows are counted before the join and
    brought back by number after it, so no row number of a scan is needed, and a task that runs again gives the same rows
    whatever the order of its input. An empty table gives no rows; other columns are ignored.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    groups = rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
    groups = groups.select("digest", F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id")
    short = rows.groupBy("digest", F.sha2("text", 256).alias("text_sha256"), "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    joined = short.join(groups, ["digest", "text_sha256"])
    one = lambda last: F.explode(F.sequence(F.lit(1).cast("bigint"), last))
    joined = joined.withColumn("block", one(F.ceil(F.col("copies") / COPIES_AT_ONCE)))
    left = F.col("copies") - (F.col("block") - 1) * COPIES_AT_ONCE
    joined = joined.withColumn("copy", one(F.least(left, F.lit(COPIES_AT_ONCE))))
    first = (F.col("block") == 1) & (F.col("copy") == 1)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One whole row of ``docs`` for each distinct text: the one with the smallest doc_id (rows without one come last).

    One shuffle, pre-aggregated; the bytes are compared because the text is a grouping key beside its digest. A null text
    counts as empty. Ties of repeated ids go by a hash of the row. All columns are returned.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(HIGHEST)), F.xxhash64(*plain))
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    row = F.struct(*others, F.col("text").isNull().alias("_no_text"))
    body = text_or_empty()
    groups = docs.groupBy(digest(body).alias("_digest"), body.alias("_text")).agg(F.min_by(row, order).alias("_row"))
    back = {c: F.col(f"_row.`{c}`") for c in docs.columns if c != "text"}
    back["text"] = F.when(~F.col("_row._no_text"), F.col("_text"))
    return groups.select(*[back[c].alias(c) for c in docs.columns])
