"""Nested per-entity documents and fixed-header exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import latest_nonnull
from ..operators.ordering import positions
from ..session import materialize

FILE_LIMIT = 50 << 20  # fixed value: bytes that a published file stays below


def entity_documents(
    dim: DataFrame, panel: DataFrame, entity: str, year: str, latest: Sequence[str], series: Sequence[str], attributes: Sequence[str] = ()
) -> DataFrame:
    """Per entity: the latest value and year of each metric and the yearly series, sorted.

    An entity holds one row per year, so its series is as long as the calendar. Entities
    of the dimension without any panel row stay, with empty parts.
    """
    aggs = []
    for c in latest:
        when, value = latest_nonnull(c, year)
        aggs += [value.alias(c), when.alias(f"{c}_year")]
    point = F.struct(F.col(year).alias("year"), *[F.col(c) for c in series])
    grouped = panel.groupBy(entity).agg(
        F.struct(*aggs).alias("latest"), F.array_sort(F.collect_list(point)).alias("series")
    )
    empty = F.filter(F.array(F.lit(None).cast(grouped.schema["series"].dataType.elementType)), lambda p: p.isNotNull())
    return dim.select(entity, *attributes).join(grouped, entity, "left").withColumn("series", F.coalesce("series", empty))


def documents_json(documents: DataFrame, entity: str) -> DataFrame:
    """One JSON text per entity; missing parts are left out."""
    return documents.select(entity, F.to_json(F.struct(*[F.col(c) for c in documents.columns])).alias("document"))


def assign_shards(documents: DataFrame, entity: str, *, document: str = "document", limit: int = FILE_LIMIT) -> DataFrame:
    """``entity``, ``bytes`` and ``shard`` of every document, so that the documents of a shard make a file below ``limit``.

    Documents lie one per line in the order of their entity. Prefix sums of their bytes deal them out: with the widest of
    them w bytes long, those that begin in the same stretch of limit - w bytes go together, and so never reach the limit.
    A document of more than half the limit has a file of its own; one that reaches it alone is an error. The sums run over
    ranges of entities; the documents themselves do not move.
    """
    sized = documents.select(entity, (F.octet_length(document).cast("bigint") + 1).alias("bytes"))
    allowed = F.when(F.col("bytes") < limit, F.col("bytes")).otherwise(
        F.raise_error(F.concat(F.lit(f"a document alone reaches the limit of {limit} bytes: "), F.col(entity).cast("string")))
    )
    sized = materialize(sized.withColumn("bytes", allowed))
    wide = F.col("bytes") > limit // 2
    stretch = F.lit(limit) - sized.filter(~wide).agg(F.max("bytes")).scalar()
    together = positions(sized.filter(~wide), entity, weight="bytes").withColumn("shard", F.format_string("part-%06d", F.floor(F.col("before") / stretch).cast("bigint")))
    alone = positions(sized.filter(wide), entity).withColumn("shard", F.format_string("wide-%06d", F.col("before").cast("bigint")))
    return together.select(entity, "bytes", "shard").unionByName(alone.select(entity, "bytes", "shard"))


def shard_manifest(shards: DataFrame, entity: str) -> DataFrame:
    """One row per file: ``shard``, ``first_entity``, ``last_entity``, ``n_entities``, ``bytes``."""
    return shards.groupBy("shard").agg(
        F.min(entity).alias("first_entity"), F.max(entity).alias("last_entity"), F.count(F.lit(1)).alias("n_entities"), F.sum("bytes").alias("bytes")
    )


def write_shards(documents: DataFrame, entity: str, path: str, *, document: str = "document", limit: int = FILE_LIMIT) -> None:
    """``<path>/files/shard=<name>``: one file of JSON lines each, below ``limit``; ``<path>/manifest``: its rows as JSON lines.

    Every entity is in exactly one file. Files are written by as many tasks as the session shuffles to; a task holds whole
    files, each of bounded size. The manifest is written last, so a reader that finds it finds all files.
    """
    shards = materialize(assign_shards(documents, entity, document=document, limit=limit))
    lines = documents.select(entity, document).join(shards.select(entity, "shard"), entity)
    placed = lines.repartition("shard").sortWithinPartitions("shard", entity)
    placed.select(F.col(document).alias("value"), "shard").write.mode("overwrite").partitionBy("shard").option("compression", "none").text(f"{path}/files")
    shard_manifest(shards, entity).write.mode("overwrite").json(f"{path}/manifest")


# The header of the export, in order.
EXPORT_HEADER = [
    "rank", "ranking_group", "download_scope", "view_segment", "selected_geo_type", "geo_type", "geography_type",
    "geography_id", "geography_name", "state_fips", "state_abbr", "state_name", "cbsa_code", "cbsa_type", "msa_id",
    "msa_name", "estimate_status", "availability_flag", "low_sample_flag", "caveat_flag", "selected_horizon_year",
    "year", "model", "model_label", "scenario", "scenario_label", "outcome", "outcome_label", "reference_path",
    "scenario_path", "scenario_difference", "change_relative_to_reference", "observed_value", "unit_label",
    "scenario_shift_component", "manual_adjustment_component", "main_driver", "data_source_note",
    "selected_state_filter", "selected_state_filter_label", "selected_place_id", "selected_place_name",
    "remote_work_assumption", "digital_distraction_assumption", "online_social_life_assumption",
    "face_to_face_assumption", "care_burden_assumption",
]


def export_rows(df: DataFrame, constants: Mapping[str, object], header: Sequence[str] = EXPORT_HEADER) -> DataFrame:
    """Every header column as text in order; what is missing is blank."""
    def cell(name: str):
        if name in df.columns:
            source = F.col(name)
        elif name in constants:
            source = F.lit(constants[name])
        else:
            return F.lit("").alias(name)
        return F.coalesce(source.cast("string"), F.lit("")).alias(name)

    return df.select(*[cell(name) for name in header])
