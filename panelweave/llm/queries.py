"""The operators with production parameters over the whole test tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    crf_extract,
    exact_dedup,
    filter_audit,
    hyperminhash,
    mixing,
    packing,
    simhash,
    spelling,
    surrogates,
    token_lengths,
    tool_calls,
    topk_search,
    weak_quality,
)
from .store import table
from .tokens import default_tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_pii_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(table(spark, sf_dir, "documents"), key="surrogates-2024")


@query("op2_token_length_histogram")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.length_histogram(table(spark, sf_dir, "documents"), default_tokenizer())


@query("op3_hyperminhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op4_crf_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return crf_extract.extracted(pages, crf_extract.fit(pages))


@query("op5_vector_best_fit")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), default_tokenizer())


@query(
    "op6_source_mix",
    "WITH " + mixing.MIX_SQL.strip().format(docs="documents") + "\nSELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents")).drop("source")


@query("op7_weak_label_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weak_quality.scored(docs, weak_quality.fit(docs))


@query("op8_tool_call_links", tool_calls.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_calls(tool_calls.as_tool_messages(table(spark, sf_dir, "conversations")), tool_calls.TOOLS)


@query(
    "op9_branch_and_bound_top_k",
    """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query(
    "op10_exact_dedup",
    """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
ranked AS (
  SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
  FROM rows)
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM ranked""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op11_pivotal_grams")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_filter_shapley", filter_audit.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_simhash_pigeonring")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, most=4)
