"""Panel joins with explicit precedence and provenance.

No join here carries a broadcast hint: a file-backed dimension below
``spark.sql.autoBroadcastJoinThreshold`` is broadcast from its known size, a
derived side when the adaptive planner has measured it, and anything larger is
shuffled, with skewed partitions split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, cascade, flag, safe_ratio
from ..session import materialize
from .ordering import exact_median


def assert_unique(df: DataFrame, keys: Sequence[str], dataset: str) -> DataFrame:
    """Raise if a key occurs twice. One distributed aggregate; only one offender reaches the driver."""
    clash = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"{dataset}: key {tuple(clash[0][:-1])} occurs {clash[0][-1]} times")
    return df


def left_join_panels(frames: Sequence[DataFrame | None], keys: Sequence[str]) -> DataFrame:
    """The first non-empty frame is the base; the others are left-joined on the keys they share.

    Columns of earlier frames win name clashes. Frames without any key are skipped. A joined frame in which the shared keys
    occur twice raises an error, because it would multiply the rows of the panel.
    """
    present = [f for f in frames if f is not None]
    base, rest = None, present
    while rest and base is None:
        head, rest = rest[0], rest[1:]
        base = None if head.isEmpty() else head
    if base is None:
        raise ValueError("no panel has any row")
    out = base
    for frame in rest:
        shared = [k for k in keys if k in frame.columns and k in out.columns]
        if not shared:
            continue
        fresh = [c for c in frame.columns if c not in out.columns]
        if fresh:
            assert_unique(frame, shared, "a joined panel")
            out = out.join(frame.select(*shared, *fresh), shared, "left")
    return out


def outer_join_coalesce(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, prefer_left: Sequence[str] = (), prefer_right: Sequence[str] = ()
) -> DataFrame:
    """Full outer join; shared columns take one side's value first; other columns pass through."""
    merged = left.alias("l").join(right.alias("r"), list(keys), "full_outer")

    def pick(column: str) -> Column:
        sides = ("l", "r") if column in prefer_left else ("r", "l")
        return F.coalesce(*[F.col(f"{s}.`{column}`") for s in sides]).alias(column)

    chosen = [*prefer_left, *prefer_right]
    only_left = [F.col(f"l.`{c}`") for c in left.columns if c not in keys and c not in chosen]
    only_right = [
        F.col(f"r.`{c}`") for c in right.columns if c not in keys and c not in chosen and c not in left.columns
    ]
    return merged.select(*keys, *[pick(c) for c in chosen], *only_left, *only_right)


def lookup_join(
    df: DataFrame, dim: DataFrame, key: str, value: str, *, special: Mapping[str, str] | None = None, default: str | None = None
) -> DataFrame:
    """Attach one attribute of a dimension; reserved codes and a default for the rest."""
    out = df.join(dim.select(key, F.col(value).alias("_found")), key, "left")
    rules = [F.col("_found")]
    rules += [F.when(F.col(key) == code, F.lit(label)) for code, label in (special or {}).items()]
    if default is not None:
        rules.append(F.lit(default))
    return out.withColumn(value, F.coalesce(*rules)).drop("_found")


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct present keys of the left side with no partner, sorted."""
    return (
        left.filter(F.col(key).isNotNull())
        .select(key)
        .join(right.select(key), key, "left_anti")
        .distinct()
        .orderBy(key)
    )


def match_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every id of either side with its status: matched, left_only or right_only."""
    sides = (
        left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))
    )
    status = (
        F.when(F.col("right_rows") == 0, "left_only").when(F.col("left_rows") == 0, "right_only").otherwise("matched")
    )
    return sides.withColumn("status", status)


def two_pass_join(
    left: DataFrame, right: DataFrame, *, first_keys: Sequence[str], second_keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Join by id; rows with no id match are joined again by a text key; all left rows are kept.

    ``matched_by`` says which pass found the partner. Both passes are left joins in one chain, so the left rows are made once.
    Rows that have nothing to look for in a pass, as their key is missing or a partner was found before, carry a salt as
    one more key: they match nothing and spread over all tasks.
    """
    present = lambda keys: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hashable = [c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(4096)).cast("int") + 1

    def attach(df: DataFrame, keys: Sequence[str], wanted: Column, mark: str) -> DataFrame:
        own = [F.col(k).alias(f"{mark}_k{i}") for i, k in enumerate(keys)]
        found = [F.col(v).alias(f"{mark}_v{i}") for i, v in enumerate(values)]
        partners = right.filter(present(keys)).select(*own, *found).distinct().withColumn(mark, F.lit(0))
        salted = df.withColumn(f"{mark}_salt", F.when(wanted, F.lit(0)).otherwise(spread))
        same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{mark}_k{i}") for i, k in enumerate(keys)])
        return salted.join(partners, same & (F.col(f"{mark}_salt") == F.col(mark)), "left")

    first = attach(left, first_keys, present(first_keys), "_id")
    both = attach(first, second_keys, F.col("_id").isNull() & present(second_keys), "_text")
    found = [F.when(F.col("_id").isNotNull(), F.col(f"_id_v{i}")).otherwise(F.col(f"_text_v{i}")).alias(v) for i, v in enumerate(values)]
    # a text partner without a value is no match
    by = F.when(F.col("_id").isNotNull(), F.lit("id")).when(F.col("_text_v0").isNotNull(), F.lit("text"))
    return both.select(*left.columns, *found, by.alias("matched_by"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equality in which a missing key meets a missing key."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, condition, how).drop(*[f"_{k}" for k in keys])


def baseline_deltas(
    df: DataFrame, entity: str, year: str, years: tuple[int, int], *, rising: Mapping[str, str], falling: Mapping[str, str]
) -> DataFrame:
    """Distance of each row from the entity's mean over the baseline years.

    ``rising`` maps column -> name for value - baseline, ``falling`` for baseline - value.
    An entity holds one row per year, so its window is as small as the calendar.
    """
    own = Window.partitionBy(entity)
    in_base = F.col(year).between(*years)
    columns = {**rising, **falling}
    base = {f"{c}_baseline": F.avg(F.when(in_base, F.col(c))).over(own) for c in columns}
    out = df.withColumns(base)
    deltas = {name: F.col(c) - F.col(f"{c}_baseline") for c, name in rising.items()}
    deltas.update({name: F.col(f"{c}_baseline") - F.col(c) for c, name in falling.items()})
    return out.withColumns(deltas)


def hierarchy_fallback_join(
    panel: DataFrame,
    fine: DataFrame,
    middle: DataFrame,
    coarse: DataFrame,
    *,
    entity: str,
    group: str,
    year: str,
    metrics: Sequence[str],
    adjustments: Mapping[str, Column] | None = None,
    pooled: Mapping[str, str] | None = None,
) -> DataFrame:
    """Entity-year value, else group-year plus adjustment, else year plus adjustment, with a status.

    ``pooled`` maps a metric to the column of ``fine`` used where its direct value is
    missing; rows flagged ``is_pooled_estimate`` then read "imputed".
    """
    adjustments, pooled = dict(adjustments or {}), dict(pooled or {})
    flags = ["is_pooled_estimate"] if "is_pooled_estimate" in fine.columns else []
    direct = fine.select(
        entity,
        year,
        *flags,
        *[(F.coalesce(F.col(m), F.col(pooled[m])) if m in pooled else F.col(m)).alias(f"_f_{m}") for m in metrics],
    ).dropDuplicates([entity, year])
    out = (
        panel.join(direct, [entity, year], "left")
        .join(middle.select(group, year, *[F.col(m).alias(f"_m_{m}") for m in metrics]), [group, year], "left")
        .join(coarse.select(year, *[F.col(m).alias(f"_c_{m}") for m in metrics]), [year], "left")
    )
    observed = (
        F.when(flag(F.col("is_pooled_estimate")), F.lit("imputed")).otherwise(F.lit("observed")) if flags else F.lit("observed")
    )
    new: dict[str, Column] = {}
    for m in metrics:
        shift = adjustments.get(m, F.lit(0.0))
        modeled = F.coalesce(F.col(f"_m_{m}"), F.col(f"_c_{m}")) + shift
        value, status = cascade([(f"_f_{m}", observed), (modeled, "modeled")], "missing")
        new[m], new[f"{m}_status"] = value, status
    drop = [f"_{side}_{m}" for side in "fmc" for m in metrics]
    return out.withColumns(new).drop(*drop, *flags)


def against_reference(
    df: DataFrame, keys: Sequence[str], scenario: str, reference: str, values: Sequence[str]
) -> DataFrame:
    """Each scenario row beside the reference row of the same key, with deltas.

    A key holds one row per scenario, so the window never grows with the data.
    """
    same = Window.partitionBy(*keys)
    base = {f"reference_{v}": F.max(F.when(F.col(scenario) == reference, F.col(v))).over(same) for v in values}
    out = df.withColumns(base)
    return out.withColumns({f"delta_{v}": F.col(v) - F.col(f"reference_{v}") for v in values})


def rescaled_region_proxy(
    region_rows: DataFrame, national_rows: DataFrame, *, region: str, year: str, value: str, anchor: float, name: str
) -> DataFrame:
    """Region-year over national-year, scaled to an anchor.

    A missing national year takes the median of the national years; both sides must be positive.
    """
    national = national_rows.filter(F.col(value).isNotNull()).select(year, F.col(value).alias("_national"))
    middle = exact_median(national, "_national").scalar()
    base = F.coalesce(F.col("_national"), middle)
    proxy = F.when((F.col(value) > 0) & (base > 0), F.lit(anchor) * F.col(value) / base)
    return (
        region_rows.filter(F.col(region).isNotNull() & F.col(value).isNotNull())
        .join(national, year, "left")
        .select(region, year, proxy.alias(name))
    )


def national_series_join(
    panel: DataFrame, series: DataFrame, *, year: str, value: str, national: str, exposure: str, source: str
) -> DataFrame:
    """Fill missing entity values from a yearly series scaled by relative exposure, with a source label."""
    yearly = panel.groupBy(year).agg(F.avg(exposure).alias("_mean_exposure"))
    # one row per year, written so that its size is known and the panel is joined once, without a shuffle by its calendar
    side = materialize(yearly.join(series.select(year, national), year, "left"))
    scaled = F.col(national) * safe_ratio(exposure, "_mean_exposure")
    out = panel.join(side, year, "left")
    filled, label = cascade([(value, "observed"), (scaled, "scaled_national_series")], "missing")
    return out.withColumns({value: filled, source: label}).drop("_mean_exposure", national)


def expand_time_grid(df: DataFrame, last: Column | str, horizon: int, *, year: str = "year", include_last: bool = False) -> DataFrame:
    """One row per future year; rows whose last year is at or past the horizon yield none."""
    start = as_col(last) if include_last else as_col(last) + 1
    years = F.when(start <= horizon, F.sequence(start.cast("int"), F.lit(horizon)))
    return df.withColumn(year, F.explode(years))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key. Rank limits are applied before the shuffle, so a hot key costs one row per task."""
    newest = Window.partitionBy(*keys).orderBy(*[as_col(o).desc_nulls_last() for o in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def latest_row_join(df: DataFrame, history: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str]) -> DataFrame:
    last = latest_rows(history.select(*keys, order, *columns), keys, [order])
    return df.join(last.select(*keys, *[F.col(c).alias(n) for c, n in columns.items()]), list(keys), "left")


def parent_inherit(
    child: DataFrame, parent: DataFrame, *, parent_key: str, values: Sequence[str], status: str = "inherit_status"
) -> DataFrame:
    """Children take their parent's values; a child without one stays as a context row."""
    held = parent.select(parent_key, F.lit(True).alias("_held"), *values)
    label = (
        F.when(F.col(parent_key).isNull(), "no_parent").when(F.col("_held"), "inherited").otherwise("parent_without_estimate")
    )
    return child.join(held, parent_key, "left").withColumn(status, label).drop("_held")


def enrich_from_entity(records: DataFrame, entities: DataFrame, key: str, fields: Mapping[str, object]) -> DataFrame:
    """Attributes from the entity table, else from the record, else the default."""
    side = entities.select(key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    out = records.join(side, key, "left")
    new = {}
    for field, default in fields.items():
        own = [F.col(field)] if field in records.columns else []
        rest = [F.lit(default)] if default is not None else []
        new[field] = F.coalesce(F.col(f"_e_{field}"), *own, *rest)
    return out.withColumns(new).drop(*[f"_e_{f}" for f in fields])


def rollup_join(base: DataFrame, rollups: Mapping[str, DataFrame], key: str, *, separator: str = "; ") -> DataFrame:
    """Left-join pre-aggregated text per label and list the labels a row has none of.

    A roll-up has one row per key, so it is hashed per partition and the rows, which may be many more, are not sorted.
    """
    out = base
    for label, frame in rollups.items():
        out = out.join(frame.select(key, label).hint("shuffle_hash"), key, "left")
    gaps = F.array_join(
        F.array_compact(F.array(*[F.when(F.col(label).isNull(), F.lit(label)) for label in rollups])), separator
    )
    missing = F.nullif(gaps, F.lit(""))
    return out.withColumns(
        {"missing_columns": missing, "mismatch_summary": F.concat(F.lit("Missing match in: "), missing)}
    )


def join_inputs(df: DataFrame, inputs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Attach input columns from one side only, replacing any copy the left side carries."""
    return df.drop(*columns).join(inputs.select(*keys, *columns), list(keys), "left")


def backfill_column(df: DataFrame, panel: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Add a missing column from the panel's present, distinct values; leave it alone if it exists."""
    if column in df.columns:
        return df
    return df.join(panel.select(*keys, column).dropna(subset=[column]).distinct(), list(keys), "left")
