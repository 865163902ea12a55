"""Column-level building blocks: casts, flags, bins, ratios, provenance.

Every function takes and returns ``Column`` expressions (or a ``DataFrame``
where whole columns are added), so Catalyst folds, prunes and code-generates
them together with the scan they sit on.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


class MissingColumnsError(ValueError):
    """A required input column is absent."""


def require_columns(df: DataFrame, columns: Iterable[str], dataset: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{dataset} is missing required columns: {', '.join(missing)}")
    return df


def numeric(x: Column | str, dtype: str = "double") -> Column:
    """Text or number to a number; bad text, NaN and infinity become NULL."""
    value = as_col(x).try_cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return finite if dtype == "double" else finite.try_cast(dtype)


def pad_code(x: Column | str, width: int, fill: str = "0") -> Column:
    """Left-pad a code without ever cutting a longer one; NULL stays NULL."""
    text = as_col(x).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, fill)).otherwise(text)


def normalize_entity_year(
    df: DataFrame,
    entity: str,
    year: str,
    *,
    width: int = 2,
    regions: DataFrame | None = None,
    flagged_year: int | None = None,
    warning: str = "",
    warning_column: str = "year_warning",
) -> DataFrame:
    """Padded key, integer year, region looked up by key, note on one special year.

    ``regions`` is a dimension (entity, region); it is joined without a hint, so a
    file-backed dimension under the broadcast threshold is broadcast and a larger
    one is shuffled.
    """
    out = df.withColumns({entity: pad_code(entity, width), year: F.col(year).try_cast("int")})
    if regions is not None:
        out = out.drop("region").join(regions, entity, "left")
    if flagged_year is not None:
        note = F.when(F.col(year) == flagged_year, F.lit(warning)).otherwise(F.lit(""))
        out = out.withColumn(warning_column, note)
    return out


def recode(x: Column | str, labels: Mapping[object, str], *, keep_unmapped: bool = False) -> Column:
    value = as_col(x)
    hit: Column | None = None
    for code, label in labels.items():
        hit = F.when(value == F.lit(code), F.lit(label)) if hit is None else hit.when(value == F.lit(code), F.lit(label))
    if hit is None:
        raise ValueError("recode needs at least one label")
    return hit.otherwise(value.cast("string")) if keep_unmapped else hit


def bin_ranges(x: Column | str, ranges: Sequence[tuple[float, float, str]]) -> Column:
    """Closed ranges to labels; outside every range is NULL."""
    value = as_col(x)
    return F.coalesce(*[F.when(value.between(lo, hi), F.lit(label)) for lo, hi, label in ranges])


def bin_conditions(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    return F.coalesce(*[F.when(cond, F.lit(label)) for cond, label in rules], F.lit(default))


def flag(condition: Column) -> Column:
    """A predicate in which a missing operand counts as false."""
    return F.coalesce(condition, F.lit(False))


def flag_number(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def starts_with_any(x: Column | str, prefixes: Iterable[str]) -> Column:
    value = as_col(x)
    return flag(reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes]))


def classify_code(
    code: Column | str,
    tier: Column | str | None,
    *,
    prefixes: Mapping[str, Sequence[str]],
    exact: Mapping[str, Sequence[str]],
    tiers: Mapping[str, Sequence[str]],
    tier_width: int = 2,
) -> dict[str, Column]:
    """One boolean per category: by code prefix, by exact code, or by tier.

    Without a tier column the first characters of the code stand in for it.
    """
    text = as_col(code).cast("string")
    head = F.substring(text, 1, tier_width)
    level = head if tier is None else F.coalesce(pad_code(tier, tier_width), head)
    out = {name: starts_with_any(text, values) for name, values in prefixes.items()}
    out.update({name: flag(text.isin(*values)) for name, values in exact.items()})
    out.update({name: flag(level.isin(*values)) for name, values in tiers.items()})
    return out


def masked(value: Column | str, condition: Column) -> Column:
    """The value where the flag holds, else zero; a missing value counts as zero."""
    return F.when(flag(condition), F.coalesce(as_col(value), F.lit(0.0))).otherwise(F.lit(0.0))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL when the denominator is NULL or zero, the numerator NULL, or the result not finite."""
    return numeric(F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double")))


def midpoint_mean(df: DataFrame, total: str, midpoints: Mapping[str, float]) -> Column:
    """Mean from bin counts; only the bins that exist take part."""
    parts = [numeric(c) * F.lit(float(mid)) for c, mid in midpoints.items() if c in df.columns]
    return safe_ratio(reduce(lambda a, b: a + b, parts), numeric(total))


def rates_index(up_a: Column | str, up_b: Column | str, down: Column | str) -> Column:
    """(a + b + (1 - c)) / 3, NULL if any input is NULL."""
    return (as_col(up_a) + as_col(up_b) + (F.lit(1.0) - as_col(down))) / F.lit(3.0)


def row_sum(columns: Sequence[Column | str], *, min_count: int = 0) -> Column:
    """Sum across columns with missing as zero; with ``min_count`` set, NULL if too few are present."""
    cols = [as_col(c) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    if not min_count:
        return total
    return F.when(present_count(cols) >= min_count, total)


def present_count(columns: Sequence[Column | str]) -> Column:
    return reduce(lambda a, b: a + b, [as_col(c).isNotNull().cast("int") for c in columns])


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean across the columns that are present; NULL if none is."""
    return F.try_divide(row_sum(columns), present_count(columns).cast("double"))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value. ``greatest``/``least`` skip NULL, so NULL is guarded."""
    value = as_col(x)
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def two_source_flag(
    first: Column | str,
    first_codes: tuple[object, object],
    second: Column | str,
    second_codes: tuple[object, object],
) -> Column:
    """1/0 from the first source's (yes, no) codes; gaps filled from the second's."""
    a, b = as_col(first), as_col(second)
    return (
        F.when(a == F.lit(first_codes[0]), 1.0)
        .when(a == F.lit(first_codes[1]), 0.0)
        .when(b == F.lit(second_codes[0]), 1.0)
        .when(b == F.lit(second_codes[1]), 0.0)
    )


def below_sentinel(x: Column | str, sentinel: float) -> Column:
    """Reserved codes at or above the sentinel become NULL."""
    value = numeric(x)
    return F.when(value < F.lit(float(sentinel)), value)


def prefer(columns: Sequence[Column | str]) -> Column:
    return F.coalesce(*[as_col(c) for c in columns])


def cascade(candidates: Sequence[tuple[Column | str, Column | str]], default_label: str) -> tuple[Column, Column]:
    """First present candidate and the label that belongs to it, from one list.

    Labels are ``Column`` or plain text.
    """
    def label_of(x: Column | str) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    value = F.coalesce(*[as_col(c) for c, _ in candidates])
    label = F.coalesce(
        *[F.when(as_col(c).isNotNull(), label_of(text)) for c, text in candidates], F.lit(default_label)
    )
    return value, label


def finite_or(x: Column | str, default: float | None = None) -> Column:
    value = numeric(x)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def no_negative_zero(x: Column | str) -> Column:
    value = as_col(x)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def with_optional(df: DataFrame, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add the columns that are absent, as (type, constant or None)."""
    new = {c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def with_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({name: F.lit(v) for name, v in values.items()})


def inverse_features(
    df: DataFrame, *, one_minus: Sequence[str] = (), negated: Sequence[str] = (), renames: Mapping[str, str] | None = None
) -> DataFrame:
    """Helper columns ``x_inverse`` = 1 - x or -x for those inputs that exist."""
    out = df.withColumnsRenamed(dict(renames or {}))
    new = {f"{c}_inverse": F.lit(1.0) - F.col(c) for c in one_minus if c in out.columns}
    new.update({f"{c}_inverse": -F.col(c) for c in negated if c in out.columns})
    return out.withColumns(new) if new else out


def calendar_trend_features(df: DataFrame, year: str, break_year: int) -> DataFrame:
    """Year index from the first year of the table, its square, and a break dummy and ramp.

    The first year is a one-value scalar subquery, not a window over the whole table.
    """
    first = df.agg(F.min(year)).scalar()
    index = (F.col(year) - first).cast("int")
    return df.withColumns(
        {
            "year_index": index,
            "year_index_sq": index * index,
            "post_break": F.when(F.col(year) >= break_year, 1).otherwise(0),
            "post_break_trend": F.when(F.col(year) >= break_year, F.col(year) - break_year).otherwise(0),
        }
    )


def window_prefer_source(
    df: DataFrame, year: str, start: int, end: int, source: str | None = None, preferred: str | None = None
) -> DataFrame:
    """Years within [start, end]; if any row there is from the preferred source, only those rows."""
    kept = df.withColumn(year, numeric(year, "int")).filter(F.col(year).between(start, end))
    if source is None or source not in df.columns:
        return kept
    is_preferred = flag(F.col(source) == F.lit(preferred))
    any_preferred = F.coalesce(kept.agg(F.max(is_preferred)).scalar(), F.lit(False))
    return kept.filter(is_preferred | ~any_preferred)


def year_coverage(df: DataFrame, year: str, modern_from: int) -> DataFrame:
    y = numeric(year, "int")
    return df.agg(
        F.coalesce(F.min(y), F.lit(-1)).alias("min_year"),
        F.coalesce(F.max(y), F.lit(-1)).alias("max_year"),
        F.count_distinct(y).alias("n_years"),
        F.coalesce(F.bool_or(y >= modern_from), F.lit(False)).alias("has_modern_years"),
    )


def assert_year_coverage(df: DataFrame, year: str, min_year: int) -> None:
    row = year_coverage(df, year, min_year).first()
    if row.max_year < min_year:
        raise ValueError(
            f"data covers years {row.min_year} to {row.max_year}; at least {min_year} or later is needed"
        )


def resolve_alias(x: Column | str, aliases: Mapping[str, str]) -> Column:
    value = as_col(x)
    return F.coalesce(*[F.when(value == old, F.lit(new)) for old, new in aliases.items()], value)


def slice_filter(df: DataFrame, upto: Mapping[str, object] | None = None, **equals: object) -> DataFrame:
    """Equality slices; ``None`` or "all" leaves a dimension open. ``upto`` are inclusive upper bounds."""
    out = df
    for column, wanted in equals.items():
        if wanted is None or (isinstance(wanted, str) and wanted.lower() == "all"):
            continue
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        out = out.filter(F.col(column).isin(*values))
    for column, bound in (upto or {}).items():
        out = out.filter(F.col(column) <= F.lit(bound))
    return out


def normalize_records(
    frames: Sequence[tuple[DataFrame, str]],
    *,
    id_fields: Mapping[str, Sequence[str]],
    name_fields: Mapping[str, Sequence[str]],
    id_width: Mapping[str, int],
    passthrough: Sequence[str],
) -> DataFrame:
    """Records with different field names per geography type, as one schema.

    The difference is recomputed as scenario - reference where both are finite.
    Rows without an id are dropped.
    """
    def first_text(df: DataFrame, names: Sequence[str]) -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    parts = []
    for df, kind in frames:
        key = first_text(df, id_fields[kind])
        key = pad_code(key, id_width[kind]) if kind in id_width else key
        reference, scenario = numeric("reference_path"), numeric("scenario_path")
        given = numeric("scenario_difference") if "scenario_difference" in df.columns else F.lit(None).cast("double")
        parts.append(
            df.select(
                F.lit(kind).alias("geography_type"),
                key.alias("geography_id"),
                F.coalesce(first_text(df, name_fields[kind]), key).alias("geography_name"),
                *[F.col(c) for c in passthrough],
                reference.alias("reference_path"),
                scenario.alias("scenario_path"),
                F.coalesce(scenario - reference, given).alias("scenario_difference"),
            ).filter(F.col("geography_id").isNotNull())
        )
    return reduce(lambda a, b: a.unionByName(b), parts)
