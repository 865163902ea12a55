"""Weighted and grouped aggregates.

All of them are sums, extremes or distinct counts, so Spark combines them on the
map side and a hot key reaches the shuffle as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col, flag, masked, row_mean, safe_ratio
from ..session import materialize

# Fixed value: normal quantile of the reported interval.
Z_95 = 1.96


# --- weighted means and shares -------------------------------------------------------------------


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    x, w = as_col(value), as_col(weight)
    return safe_ratio(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def weighted_share(condition: Column, weight: Column | str) -> Column:
    w = as_col(weight)
    return safe_ratio(F.sum(masked(w, condition)), F.sum(w))


@dataclass(frozen=True)
class Measure:
    """One weighted measure with its own sub-population.

    ``value`` is a number or a 0/1 condition cast to one; ``where`` limits both
    numerator and denominator; rows with a missing value count in neither.
    """

    name: str
    value: Column
    where: Column | None = None


def _parts(measure: Measure, weight: Column) -> tuple[Column, Column]:
    valid = measure.value.isNotNull()
    if measure.where is not None:
        valid = valid & flag(measure.where)
    return F.sum(F.when(valid, weight * measure.value)), F.sum(F.when(valid, weight))


def subpopulation_panel(
    df: DataFrame, keys: Sequence[str], weight: Column | str, measures: Sequence[Measure], extra: Sequence[Column] = ()
) -> DataFrame:
    """All measures of all sub-populations in one aggregate: one scan, one shuffle."""
    w = as_col(weight)
    out = []
    for m in measures:
        top, bottom = _parts(m, w)
        out.append(safe_ratio(top, bottom).alias(m.name))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_size"), *out, *extra)


def panel_partials(df: DataFrame, keys: Sequence[str], weight: Column | str, measures: Sequence[Measure]) -> DataFrame:
    """Numerators and denominators per key, to be stored and merged with later batches. Missing keys are dropped."""
    w = as_col(weight)
    sums = []
    for m in measures:
        top, bottom = _parts(m, w)
        sums += [top.alias(f"{m.name}__num"), bottom.alias(f"{m.name}__den")]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_size"), *sums)


def add_partials(partials: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Stored and new partials added up per key; the result is partials again."""
    sums = [F.sum(f"{n}__{part}").alias(f"{n}__{part}") for n in names for part in ("num", "den")]
    return partials.groupBy(*keys).agg(F.sum("sample_size").alias("sample_size"), *sums)


def finish_partials(partials: Sequence[DataFrame], keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    merged = add_partials(reduce(lambda a, b: a.unionByName(b), partials), keys, names)
    return merged.select(*keys, "sample_size", *[safe_ratio(f"{n}__num", f"{n}__den").alias(n) for n in names])


def weighted_distribution(df: DataFrame, keys: Sequence[str], category: str, weight: str, name: str = "distribution") -> DataFrame:
    """Category -> weight share as a sorted map per group; rows with a missing part are left out.

    The map holds one entry per category, after the weights were summed per category.
    """
    cells = df.dropna(subset=[category, weight]).groupBy(*keys, category).agg(F.sum(weight).alias("_w"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(category).cast("string").alias("k"), F.col("_w").alias("v"))))
    grouped = cells.groupBy(*keys).agg(F.sum("_w").alias("_total"), entries.alias("_entries"))
    shares = F.transform("_entries", lambda e: F.struct(e["k"].alias("k"), safe_ratio(e["v"], F.col("_total")).alias("v")))
    return grouped.filter("_total <> 0").select(*keys, F.map_from_entries(shares).alias(name))


# --- moments: mean, effective n, standard error, interval -----------------------------------------

_STATE = ("w", "w2", "mean", "m2")
# Weights are brought near the spread of the values by one of these factors; the first holds from 2^16 spreads of the weights on.
_SCALES = {2.0**24: 2.0**16, 1.0: 2.0**-6, 2.0**-16: 0.0}


def _weighted_parts(x: Column, w: Column) -> dict[str, Column]:
    """Aggregates from which weight, mean and squared spread of weighted values follow, all of them centred ones.

    Spark's variance, covariance and skewness keep a running mean and merge partial states pairwise, so none of them loses
    digits to the distance of a group from zero, from other groups or from any constant.
    """
    parts = {"n": F.count(x), "w": F.sum(w), "x": F.avg(x), "vx": F.var_pop(x), "vw": F.var_pop(w), "c": F.covar_pop(x, w), "sw": F.skewness(w)}
    for i, a in enumerate(_SCALES):
        parts |= {f"up{i}": F.skewness(x + F.lit(a) * w), f"down{i}": F.skewness(x - F.lit(a) * w)}
    return parts


def _weighted_state(p: Mapping[str, Column]) -> tuple[Column, Column]:
    """Weighted mean and squared spread around it.

    The spread around the plain mean is n (w) var(x) + S, where S sums (w - mean w)(x - mean x)^2. That mixed third moment is
    the difference of the third moments of x + a w and x - a w, less that of w, by 6 a.
    """
    third = lambda skew, var: F.coalesce(skew, F.lit(0.0)) * p["n"] * F.pow(F.greatest(var, F.lit(0.0)), F.lit(1.5))

    def mixed(i: int, a: float) -> Column:
        around, twist = p["vx"] + F.lit(a * a) * p["vw"], F.lit(2 * a) * p["c"]
        own = F.lit(2 * a**3) * third(p["sw"], p["vw"])
        return (third(p[f"up{i}"], around + twist) - third(p[f"down{i}"], around - twist) - own) / F.lit(6 * a)

    ranked = [(F.sqrt(p["vx"]) >= F.lit(least) * F.sqrt(p["vw"]), mixed(i, a)) for i, (a, least) in enumerate(_SCALES.items())]
    cross = F.coalesce(*[F.when(*pair) for pair in ranked])
    shift = F.try_divide(p["c"] * p["n"], p["w"])
    spread = p["w"] * p["vx"] + cross - p["w"] * shift * shift
    return p["x"] + shift, F.when(p["vx"] == 0, F.lit(0.0)).otherwise(F.greatest(spread, F.lit(0.0)))


def _merge_states(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], size: Column, given: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One state per key and metric from rows that are states themselves: their weight, its squares, mean and inner spread."""
    aggregates, finished = [F.sum(size).alias("sample_size")], []
    for i, m in enumerate(metrics):
        g = given[m]
        valid = g["mean"].isNotNull() & g["w"].isNotNull()
        only = lambda c, valid=valid: F.when(valid, c)
        parts = _weighted_parts(only(g["mean"].cast("double")), only(g["w"].cast("double")))
        parts |= {"w2": F.sum(only(g["w2"])), "inner": F.sum(only(g["m2"])) if g["m2"] is not None else F.lit(0.0)}
        aggregates += [c.alias(f"_{i}_{k}") for k, c in parts.items()]
        held = {k: F.col(f"_{i}_{k}") for k in parts}
        mean, spread = _weighted_state(held)
        state = {"w": held["w"], "w2": held["w2"], "mean": mean, "m2": spread + held["inner"]}
        finished += [F.when(held["w"] != 0, state[k]).alias(f"{m}__{k}") for k in _STATE]
    return df.groupBy(*keys).agg(*aggregates).select(*keys, "sample_size", *finished)


def moment_states(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], weight: str) -> DataFrame:
    """Per key the number of rows and, per metric, a state that merges with others: weight, its squares, mean, squared spread.

    Columns ``sample_size`` and ``<metric>__w``, ``__w2``, ``__mean``, ``__m2``. One scan and one shuffle of one row per key
    and task; groups may lie any number of spreads apart.
    """
    w = F.col(weight).cast("double")
    given = {m: {"mean": F.col(m), "w": w, "w2": w * w, "m2": None} for m in metrics}
    return _merge_states(df, keys, metrics, F.lit(1).cast("bigint"), given)


def merge_moments(states: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """States of finer keys, of other batches or of other machines, merged to one per key."""
    given = {m: {p: F.col(f"{m}__{p}") for p in _STATE} for m in metrics}
    return _merge_states(states, keys, metrics, F.col("sample_size"), given)


def interval_columns(metric: str) -> dict[str, Column]:
    """Mean, standard error and interval of one metric from its state."""
    w, w2, mean, m2 = (F.col(f"{metric}__{p}") for p in _STATE)
    effective = F.greatest(safe_ratio(w * w, w2), F.lit(1.0))
    error = F.sqrt(safe_ratio(m2, w) / effective)
    return {
        metric: mean,
        f"{metric}_se": error,
        f"{metric}_ci_low": mean - F.lit(Z_95) * error,
        f"{metric}_ci_high": mean + F.lit(Z_95) * error,
    }


def finish_moments(states: DataFrame, keys: Sequence[str], metrics: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    columns = [c.alias(n) for m in metrics for n, c in interval_columns(m).items()]
    return states.select(*keys, "sample_size", *extra, *columns)


def weighted_mean_ci(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], weight: str) -> DataFrame:
    """Weighted mean with effective-sample standard error and 95 % interval per group, from one scan of the rows."""
    return finish_moments(moment_states(df, keys, metrics, weight), keys, metrics)


@dataclass(frozen=True)
class Grain:
    """A level of the multi-grain table. ``present`` are keys whose missing rows are left out."""

    name: str
    keys: tuple[str, ...]
    present: tuple[str, ...] = ()
    threshold: int | None = None


def multi_grain(
    df: DataFrame,
    grains: Sequence[Grain],
    metrics: Sequence[str],
    weight: str,
    *,
    grain_column: str = "geography_type",
) -> DataFrame:
    """The same estimates at several grains in one tagged table.

    Raw rows are aggregated once, to the finest grain, and that small table is written down;
    coarser grains merge its states, so the raw data is not read again per grain.
    """
    finest = max(grains, key=lambda g: len(g.keys))
    base = materialize(moment_states(df, finest.keys, metrics, weight))
    tables = []
    for g in grains:
        source = base.dropna(subset=list(g.present)) if g.present else base
        states = source if g.keys == finest.keys else merge_moments(source, g.keys, metrics)
        done = finish_moments(states, g.keys, metrics).withColumn(grain_column, F.lit(g.name))
        if g.threshold is not None:
            done = suppress_small_cells(done, metrics, g.threshold)
        else:
            done = done.withColumns({"estimate_status": F.lit("observed"), "quality_warning": F.lit("")})
        tables.append(done)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def suppress_small_cells(
    df: DataFrame,
    metrics: Sequence[str],
    threshold: int,
    *,
    size: str = "sample_size",
    warning: str = "cell below the minimum sample; estimates hidden",
) -> DataFrame:
    """Blank the estimates of cells below the threshold and say so."""
    enough = F.col(size) >= threshold
    names = [n for m in metrics for n in (m, f"{m}_se", f"{m}_ci_low", f"{m}_ci_high") if n in df.columns]
    out = df.withColumns({n: F.when(enough, F.col(n)) for n in names})
    return out.withColumns(
        {
            "estimate_status": F.when(enough, F.lit("observed")).otherwise(F.lit("pooled_or_modeled_required")),
            "quality_warning": F.when(enough, F.lit("")).otherwise(F.lit(warning)),
        }
    )


# --- sums, rates, rolls ---------------------------------------------------------------------------


def sum_or_zero(x: Column | str) -> Column:
    """A sum in which an all-missing group is zero."""
    return F.coalesce(F.sum(as_col(x)), F.lit(0))


def period_mean(df: DataFrame, period: Column, value: Column | str, name: str, *, percent: bool = False) -> DataFrame:
    """Dated series to a mean per period; a percent becomes a share."""
    x = as_col(value) / F.lit(100.0) if percent else as_col(value)
    return df.groupBy(period.alias("year")).agg(F.avg(x).alias(name))


def event_rollup(events: DataFrame, case: str, measures: Mapping[str, Column]) -> DataFrame:
    """Activity log to one row per case: the sum of each masked measure."""
    return events.groupBy(case).agg(*[sum_or_zero(c).alias(n) for n, c in measures.items()])


def event_to_person(
    events: DataFrame, persons: DataFrame, geography: DataFrame | None, *, case: str, person_keys: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Measures per case, on the person table, with geography where it exists and a label saying so."""
    rolled = persons.join(event_rollup(events, case, measures), case, "left")
    if geography is None:
        return rolled.withColumns(
            {"region": F.lit("National only"), "geography_mode": F.lit("national_only")}
        )
    return rolled.join(geography, list(person_keys), "left").withColumn(
        "geography_mode", F.lit("entity_and_region_available")
    )


def rate_per_thousand(events: DataFrame, denominators: DataFrame, keys: Sequence[str], event: str, base: str, name: str) -> DataFrame:
    """1000 x summed events over a denominator; rows with a missing key are dropped."""
    summed = events.dropna(subset=list(keys)).groupBy(*keys).agg(sum_or_zero(event).alias(event))
    return summed.join(denominators, list(keys), "left").withColumn(name, F.lit(1000.0) * safe_ratio(event, base))


def band_rates(events: DataFrame, denominators: DataFrame, keys: Sequence[str], band: str, event: str, base: str, name: str) -> DataFrame:
    return rate_per_thousand(events, denominators, [*keys, band], event, base, name)


def banded_rate_sum(rates: DataFrame, keys: Sequence[str], band: str, rate: str, widths: Mapping[str, float], name: str) -> DataFrame:
    """Sum over bands of rate/1000 x band width."""
    width = F.coalesce(*[F.when(F.col(band) == b, F.lit(float(w))) for b, w in widths.items()])
    return rates.groupBy(*keys).agg(sum_or_zero(F.col(rate) / F.lit(1000.0) * width).alias(name))


def keyword_baskets(
    df: DataFrame, keys: Sequence[str], keyword: str, value: Column, baskets: Mapping[str, Sequence[str]], composite: str
) -> DataFrame:
    """Mean per basket of keywords, all baskets in one pass, and the mean of the baskets."""
    out = df.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(keyword).isin(*words), value)).alias(name) for name, words in baskets.items()]
    )
    return out.withColumn(composite, row_mean(list(baskets)))


def global_zscore_mean(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Row mean of table-wide z-scores (population sd; zero sd gives zero), missing skipped.

    The table statistics are one scalar row, not a window over everything.
    """
    stats = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])
    ).scalar()
    parts = []
    for c in columns:
        m, s = stats.getField(c).getField("m"), stats.getField(c).getField("s")
        parts.append(F.when(s > 0, (F.col(c) - m) / s).otherwise(F.col(c) * F.lit(0.0)))
    return df.withColumn(name, row_mean(parts))


def sample_weighted_mean(df: DataFrame, keys: Sequence[str], value: str, size: str, name: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(weighted_mean(value, size).alias(name))


def pivot_mean(df: DataFrame, keys: Sequence[str], column: str, value: str, values: Sequence[str], prefix: str) -> DataFrame:
    """Long bands to one mean column per band; "-" in a band becomes "_" in the name."""
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(F.avg(value))
    return wide.withColumnsRenamed({v: f"{prefix}{v.replace('-', '_')}" for v in values})


def source_quality(df: DataFrame, source: str, order: str, *, first: Sequence[str], year: str, size: str) -> DataFrame:
    """Per source: first flag values in load order, latest year, median sample size."""
    from .ordering import exact_median

    head = df.groupBy(source).agg(
        *[F.min_by(c, order).alias(c) for c in first], F.max(year).alias("latest_year")
    )
    return head.join(exact_median(df, size, by=[source], name="median_sample_size"), source, "left")


def latest_nonnull(value: str, year: str) -> tuple[Column, Column]:
    """Last year with a value, and that value, as aggregates."""
    present = F.when(F.col(value).isNotNull(), F.col(year))
    return F.max(present), F.max_by(value, present)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in columns], name, value)


def latest_year_means(df: DataFrame, year: str, metrics: Sequence[str]) -> DataFrame:
    """Per metric: the mean over entities in the last year in which it has any value; one job for all metrics."""
    cells = unpivot(df, [year], metrics).filter(F.col("value").isNotNull())
    yearly = cells.groupBy("metric", year).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_entities"))
    return yearly.groupBy("metric").agg(
        F.max(year).alias("latest_year"), F.max_by("value", year).alias("latest_value"), F.max_by("n_entities", year).alias("n_entities")
    )


def kpi_table(national: DataFrame | None, panel: DataFrame, year: str, metrics: Sequence[str]) -> DataFrame:
    """Latest value per metric, from the national rows where they have one, else the entity mean."""
    means = latest_year_means(panel, year, metrics)
    if national is None:
        return means.withColumn("source_level", F.lit("entity_mean"))
    top = latest_year_means(national, year, [m for m in metrics if m in national.columns])
    top = top.select("metric", F.col("latest_year").alias("_y"), F.col("latest_value").alias("_v"))
    return means.join(top, "metric", "left").select(
        "metric",
        F.coalesce("_y", "latest_year").alias("latest_year"),
        F.coalesce("_v", "latest_value").alias("latest_value"),
        F.when(F.col("_v").isNotNull(), "national").otherwise("entity_mean").alias("source_level"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# --- text roll-ups --------------------------------------------------------------------------------


def ordered_labels(
    df: DataFrame, keys: Sequence[str], value: str, order: str, labels: Mapping[str, str], *, empty: str, name: str
) -> DataFrame:
    """Distinct values in first-seen order, relabelled and joined.

    Rows are reduced to one per distinct value before anything is gathered.
    """
    seen = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    text = F.coalesce(
        *[F.when(F.col(value) == v, F.lit(label)) for v, label in labels.items()], F.replace(F.col(value), F.lit("_"), F.lit(" "))
    )
    items = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col("_first"), text.alias("t")))))
    joined = F.array_join(F.transform(items, lambda s: s["t"]), ", ")
    return seen.groupBy(*keys).agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty)).alias(name))


def joined_sorted(df: DataFrame, keys: Sequence[str], text: str, name: str, separator: str = "; ") -> DataFrame:
    """Sorted distinct texts of a group in one cell; duplicates go before the gather."""
    parts = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*keys, text).distinct()
    return parts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(text)), separator).alias(name))


def two_level_text(
    df: DataFrame, keys: Sequence[str], element: str, scale: str | None, value: str | None, name: str
) -> DataFrame:
    """"element (scale=value, …)" per element, then "; "-joined per key."""
    named = df.dropna(subset=[*keys, element])
    if scale is None or value is None:
        return joined_sorted(named.select(*keys, F.col(element).alias("_label")), keys, "_label", name)
    pair = F.when(
        F.col(scale).isNotNull() & F.col(value).isNotNull(), F.struct(F.col(scale).alias("s"), F.col(value).alias("v"))
    )
    distinct = named.select(*keys, element, pair.alias("_pair")).distinct()
    per_element = distinct.groupBy(*keys, element).agg(F.array_sort(F.collect_list("_pair")).alias("_pairs"))
    inner = F.array_join(F.transform("_pairs", lambda p: F.concat(p["s"], F.lit("="), p["v"])), ", ")
    label = F.when(F.size("_pairs") > 0, F.concat(F.col(element), F.lit(" ("), inner, F.lit(")"))).otherwise(F.col(element))
    return joined_sorted(per_element.select(*keys, label.alias("_label")), keys, "_label", name)


def flagged_label(example: str, kind: str, flags: Mapping[str, Column]) -> Column:
    """example, or "example (kind)", with the names of the flags that hold in brackets."""
    e, k = F.col(example), F.col(kind)
    label = F.when(e.isNotNull() & k.isNotNull() & (e != k), F.concat(e, F.lit(" ("), k, F.lit(")"))).otherwise(F.coalesce(e, k))
    marks = F.array_join(F.array_compact(F.array(*[F.when(flag(c), F.lit(n)) for n, c in flags.items()])), ", ")
    return F.when(marks != "", F.concat(label, F.lit(" ["), marks, F.lit("]"))).otherwise(label)
