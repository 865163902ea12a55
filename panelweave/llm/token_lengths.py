"""Exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import with_running
from .store import keep, ship
from .tokens import chunk_ids


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``length``: number of ids of each text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_ids(tokenizer).texts
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(ids) for ids in encode(batch.column(0))], pa.int64())], names=["length"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "length bigint")


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per distinct encoded length, seen as a context limit.

    ``length``, ``n_docs``; ``docs_up_to`` and ``tokens_up_to`` (documents that fit the limit), ``docs_over`` and
    ``tokens_over`` (suffix sums beyond it), ``tokens_truncated`` (all tokens when every document is cut at the limit),
    ``total_docs``, ``total_tokens``, ``quantile`` (share of documents that fit: the length is the quantile of every
    probability above the row before, up to this one).

    Documents are counted per length before anything is shuffled; running totals go over ranges of lengths, so no task holds
    the histogram. Null and empty texts have length 0; repeated rows count as often as they occur; an empty table gives no
    rows; only ``text`` is read.
    """
    ship(docs.sparkSession)
    counts = keep(encoded_lengths(docs, tokenizer).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    tokens = F.col("length") * F.col("n_docs")
    total_docs, total_tokens = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(tokens), F.lit(0))).first()
    run = with_running(counts, [F.col("length").asc()], {"docs_up_to": F.col("n_docs"), "tokens_up_to": tokens})
    over, heavier = F.lit(total_docs) - F.col("docs_up_to"), F.lit(total_tokens) - F.col("tokens_up_to")
    return run.select(
        "length",
        "n_docs",
        "docs_up_to",
        "tokens_up_to",
        over.alias("docs_over"),
        heavier.alias("tokens_over"),
        (F.col("tokens_up_to") + F.col("length") * over).alias("tokens_truncated"),
        F.lit(total_docs).cast("bigint").alias("total_docs"),
        F.lit(total_tokens).cast("bigint").alias("total_tokens"),
        (F.col("docs_up_to") / F.lit(total_docs)).alias("quantile"),
    )


def answers(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit``, ``docs_over``, ``tokens_truncated`` for limits that need not be lengths of the histogram.

    One aggregate: tokens of the documents that fit, plus the limit for each that does not.
    """
    spread = histogram.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in sorted(set(limits))])))
    longer = F.col("length") > F.col("context_limit")
    return spread.groupBy("context_limit").agg(
        F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("tokens_truncated"),
    )
