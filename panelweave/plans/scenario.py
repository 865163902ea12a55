"""Entity × scenario × year expansion and scenario arithmetic.

Scenarios are an exploded array of literal parameter structs (their number is fixed
by the specification), so all of them run in one job and no join is needed. Linear
recurrences are closed forms over the exploded years; the bounded share, which has
none, folds over an array inside the row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col, clip, flag, row_sum, safe_ratio
from ..functions.text import expit, logit
from ..operators.joins import against_reference, latest_rows
from ..operators.windows import argmax_label, bounded_scale, mean_ranks, reference_scales
from . import specs


def increment_table(
    templates: Mapping[str, tuple[str, Mapping[str, float]]] = specs.SCENARIOS, user: Mapping[str, float] | None = None
) -> dict[tuple[str, str], float]:
    """Yearly increment by (scenario, column): the templates' and, under "user_defined", the user's parameters that are known."""
    rows = [(name, column, step) for name, (_, steps) in templates.items() if name != "user_defined" for column, step in steps.items()]
    rows += [("user_defined", column, user[parameter]) for parameter, column in specs.USER_PARAMETERS.items() if user and parameter in user]
    return {(name, column): step for name, column, step in rows}


def growth_overrides(scenario: str, user: Mapping[str, float] | None = None) -> dict[str, float]:
    """The increments of one scenario; a name without a template grows as the baseline does."""
    name = scenario if scenario in specs.SCENARIOS else "baseline_continuation"
    return {column: step for (owner, column), step in increment_table(user=user).items() if owner == name}


def explode_scenarios(
    df: DataFrame,
    scenarios: Sequence[str],
    columns: Sequence[str],
    *,
    user: Mapping[str, float] | None = None,
    measures: Mapping[str, Mapping[str, float]] = specs.MEASURE_INCREMENTS,
) -> DataFrame:
    """One row per scenario with its label and a struct of yearly increments per column."""
    entries = []
    for name in scenarios:
        label = specs.SCENARIOS.get(name, specs.SCENARIOS["baseline_continuation"])[0]
        increments = {**growth_overrides(name, user=user), **measures.get(name, {})}
        values = F.struct(*[F.lit(float(increments.get(c, 0.0))).alias(c) for c in columns])
        kind = "user_defined" if name == "user_defined" else "template"
        entries.append(
            F.struct(
                F.lit(name).alias("scenario_name"),
                F.lit(label).alias("scenario_label"),
                F.lit(kind).alias("scenario_input_type"),
                values.alias("increment"),
            )
        )
    return df.select("*", F.inline(F.array(*entries)))


def scenario_overrides(df: DataFrame, scenarios: Sequence[str], columns: Sequence[str], user: Mapping[str, float] | None = None) -> DataFrame:
    """(…, scenario, feature, increment) in long form for every row of ``df``."""
    wide = explode_scenarios(df, scenarios, columns, user=user)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"increment.{c}").alias("annual_increment")) for c in columns])
    return wide.withColumn("_pairs", pairs).select(
        *df.columns, "scenario_name", "scenario_label", "scenario_input_type", F.inline("_pairs")
    )


def baseline_anchor(
    panel: DataFrame,
    entity: str,
    year: str,
    *,
    slopes: Sequence[str],
    logit_slopes: Sequence[str] = (),
    growth: Sequence[str] = (),
    n: int = 5,
) -> DataFrame:
    """Last row per entity with recent slopes, logit slopes and growth rates as columns.

    Equal to joining ``recent_slopes`` and ``recent_growth`` to the last row, but every
    column's recent points are counted under the same partitioning by entity, so the panel
    is shuffled once however many columns there are.
    """
    forward, backward = Window.partitionBy(entity).orderBy(year), Window.partitionBy(entity).orderBy(F.col(year).desc())
    so_far = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    rows = panel.withColumns({f"_r_{c}": safe_ratio(c, F.last(c, True).over(before)) - 1 for c in growth})
    ranks = {f"_k_{c}": F.count(c).over(so_far) for c in {*slopes, *logit_slopes}}
    ranks.update({f"_kr_{c}": F.count(f"_r_{c}").over(so_far) for c in growth})
    rows = rows.withColumns({**ranks, "_rank": F.row_number().over(backward)})
    x = F.col(year).cast("double")

    def slope(c: str, y: Column) -> Column:
        point = F.when(F.col(f"_k_{c}") <= n, y)
        return F.when(F.count(point) >= 2, F.coalesce(F.regr_slope(point, x), F.lit(0.0))).otherwise(F.lit(0.0))

    last = [F.max(F.when(F.col("_rank") == 1, F.col(c))).alias(c) for c in panel.columns if c != entity]
    made = [slope(c, F.col(c).cast("double")).alias(f"{c}_baseline_slope") for c in slopes]
    made += [slope(c, logit(c)).alias(f"{c}_logit_slope") for c in logit_slopes]
    made += [
        F.coalesce(F.avg(F.when(F.col(f"_kr_{c}") <= n - 1, F.col(f"_r_{c}"))), F.lit(0.0)).alias(f"{c}_baseline_growth") for c in growth
    ]
    return rows.groupBy(entity).agg(*last, *made)


def override_scales(anchor: DataFrame, columns: Sequence[str], entity: str = "entity") -> DataFrame:
    """Entity-specific multipliers ``scenario_scale_<column>`` from percentile ranks over the entities."""
    used = sorted({specs.SCALE_OF_COLUMN[c] for c in columns if c in specs.SCALE_OF_COLUMN})
    components = {f"_rank_{name}": specs.SCALE_COMPONENTS[name][:2] for name in used}
    out = mean_ranks(anchor, [entity], components)
    scales = {}
    for c in columns:
        name = specs.SCALE_OF_COLUMN.get(c)
        low, high = specs.SCALE_COMPONENTS[name][2:] if name else (1.0, 1.0)
        scales[f"scenario_scale_{c}"] = bounded_scale(f"_rank_{name}", low, high) if name else F.lit(1.0)
    return out.withColumns(scales).drop(*components)


def explode_years(df: DataFrame, first: Column, last: int, year: str = "year") -> DataFrame:
    """Years from ``first`` to ``last`` with their distance k from the first."""
    out = df.drop(year).withColumn("_first", first.cast("int"))
    years = F.when(F.col("_first") <= last, F.sequence(F.col("_first"), F.lit(last)))
    return out.withColumn(year, F.explode(years)).withColumn("k", F.col(year) - F.col("_first")).drop("_first")


def additive_decay(start: Column, slope: Column, increment: Column, scale: Column, k: Column, rate: float = specs.OVERRIDE_DECAY) -> Column:
    """v_k of v_{k+1} = v_k + slope + increment·scale·rate^k."""
    ramp = (F.lit(1.0) - F.pow(F.lit(rate), k)) / F.lit(1.0 - rate)
    return start + k * slope + increment * scale * ramp


def compound_growth(start: Column, growth: Column, k: Column) -> Column:
    return start * F.pow(F.lit(1.0) + growth, k)


def bounded_share_path(
    start: Column, slope: Column, increment: Column, scale: Column, steps: Column, rate: float = specs.OVERRIDE_DECAY
) -> Column:
    """Array s_0 … s_steps of s_{k+1} = clip(expit(logit(s_k) + slope) + increment·scale·rate^k)."""
    eps = specs.SHARE_EPSILON
    first = start.cast("double")

    def step(path: Column, k: Column) -> Column:
        moved = expit(logit(F.element_at(path, -1), eps) + slope) + increment * scale * F.pow(F.lit(rate), k.cast("double"))
        return F.concat(path, F.array(clip(moved, eps, 1.0 - eps)))

    ks = F.when(steps >= 1, F.sequence(F.lit(0), steps.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(start.isNotNull(), F.aggregate(ks, F.array(first), step))


def scenario_covariates(
    anchor: DataFrame,
    latest_year: Column,
    end_year: int,
    scenarios: Sequence[str],
    *,
    additive: Sequence[str],
    share: str | None = None,
    compound: Sequence[str] = (),
    trend: Sequence[str] = (),
    year: str = "year",
    user: Mapping[str, float] | None = None,
) -> DataFrame:
    """All scenario paths of all entities from the re-labelled last year to ``end_year``.

    ``anchor`` carries slopes, growth rates and scales as made by ``baseline_anchor`` and
    ``override_scales``. The share's path is folded once per (entity, scenario), before
    the years are exploded.
    """
    moved = [*additive, *([share] if share else [])]
    rows = explode_scenarios(anchor, scenarios, moved, user=user).withColumn("_latest", latest_year.cast("int"))
    scaled = F.col("scenario_name").isin(*specs.SCALED_SCENARIOS)

    def scale(c: str) -> Column:
        name = f"scenario_scale_{c}"
        return F.when(scaled, F.col(name)).otherwise(F.lit(1.0)) if name in rows.columns else F.lit(1.0)

    if share:
        path = bounded_share_path(
            F.col(share), F.col(f"{share}_logit_slope"), F.col(f"increment.{share}"), scale(share), F.lit(end_year) - F.col("_latest")
        )
        rows = rows.withColumn("_share_path", path)
    out = explode_years(rows, F.col("_latest"), end_year, year)
    k = F.col("k").cast("double")
    new = {
        c: additive_decay(F.col(c), F.col(f"{c}_baseline_slope"), F.col(f"increment.{c}"), scale(c), k) for c in additive
    }
    new.update({c: compound_growth(F.col(c), F.col(f"{c}_baseline_growth"), k) for c in compound})
    new.update({c: F.col(c) + k * F.col(f"{c}_baseline_slope") for c in trend})
    if share:
        new[share] = F.get(F.col("_share_path"), F.col("k"))
    status = F.when(F.col("k") > 0, "user_specified_scenario_assumption").otherwise("observed_anchor")
    out = out.withColumns({**new, "covariate_status": status})
    return out.drop("_share_path", "_latest", "increment")


def derived_identities(df: DataFrame, share: str, minutes: str, parts: Sequence[str], total: str) -> DataFrame:
    """Time saved one way, there and back, and the sum of two parts (NULL only if both are missing)."""
    one_way = F.col(share) * F.col(minutes)
    return df.withColumns(
        {"time_saved_one_way": one_way, "time_saved_roundtrip": one_way * F.lit(2.0), total: row_sum(list(parts), min_count=1)}
    )


def mechanism_contributions(
    covariates: DataFrame,
    keys: Sequence[str],
    scenario: str,
    reference: str,
    terms: Sequence[tuple[str, str, float, float, str]],
    mechanisms: Mapping[str, str] = specs.MECHANISMS,
    *,
    remote: tuple[str, str, str, str, float, str] | None = None,
) -> DataFrame:
    """Scaled distance from the reference per mechanism, with total and main driver.

    ``terms`` are (scenario, column, theta, sign, mechanism). ``remote`` is
    (scenario, share, minutes, time saved, beta, mechanism): beta x (change in share x
    reference minutes x 2) / sd of the reference time saved.
    """
    columns = list(dict.fromkeys([c for _, c, *_ in terms] + ([remote[1], remote[2], remote[3]] if remote else [])))
    scales = reference_scales(covariates, scenario, reference, columns)
    out = against_reference(covariates, keys, scenario, reference, columns)
    current = F.col(scenario)
    amounts: dict[str, list[Column]] = {m: [] for m in mechanisms}
    contributions: dict[str, list[Column]] = {}
    for name, column, theta, sign, mechanism in terms:
        size = F.lit(sign * theta) * F.coalesce(F.col(f"delta_{column}"), F.lit(0.0)) / scales.getField(column)
        amounts[mechanism].append(F.when(current == name, size).otherwise(F.lit(0.0)))
        contributions.setdefault(f"contribution_{column}", []).append(F.when(current == name, size))
    if remote:
        name, share, minutes, saved, beta, mechanism = remote
        minutes_saved = (
            F.coalesce(F.col(f"delta_{share}"), F.lit(0.0)) * F.coalesce(F.col(f"reference_{minutes}"), F.lit(0.0)) * F.lit(2.0)
        )
        size = F.lit(beta) * minutes_saved / scales.getField(saved)
        amounts[mechanism].append(F.when(current == name, size).otherwise(F.lit(0.0)))
        contributions.setdefault("contribution_time_saved", []).append(F.when(current == name, size))
    new = {m: reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0) for m, parts in amounts.items()}
    new.update({n: F.coalesce(*parts) for n, parts in contributions.items()})
    out = out.withColumns(new)
    driver = argmax_label(dict(mechanisms), "observed state trend")
    return out.withColumns({"scenario_adjustment": row_sum(list(mechanisms)), "main_driver": driver})


def bounded_paths(df: DataFrame, reference: str, adjustment: str, low: float = specs.FORECAST_FLOOR, high: float = specs.FORECAST_CEILING) -> DataFrame:
    """Path = reference + adjustment within bounds; the difference is taken after bounding."""
    free = F.col(reference) + F.coalesce(F.col(adjustment), F.lit(0.0))
    path = clip(free, low, high)
    return df.withColumns(
        {"scenario_path": path, "scenario_difference": path - F.col(reference), "bounded_flag": flag(path != free)}
    )


def naive_future_paths(
    history: DataFrame, future: DataFrame, keys: Sequence[str], entity: str, year: str, value: str
) -> DataFrame:
    """Last value held, and last value plus k times the last step, for years after the entity's last.

    ``keys`` identify one future path of an entity; k numbers its remaining years.
    """
    newest = Window.partitionBy(entity).orderBy(F.col(year).desc())
    tail = history.select(entity, year, value).withColumn("_rank", F.row_number().over(newest)).filter("_rank <= 2")
    ends = tail.groupBy(entity).agg(
        F.max(year).alias("_last_year"),
        F.max(F.when(F.col("_rank") == 1, F.col(value))).alias("_last"),
        F.max(F.when(F.col("_rank") == 2, F.col(value))).alias("_before"),
    )
    out = future.join(ends, entity).filter(F.col(year) > F.col("_last_year"))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(year))
    step = F.coalesce(F.col("_last") - F.col("_before"), F.lit(0.0))
    return out.withColumns(
        {"baseline_last_observed": F.col("_last"), "baseline_recent_trend": F.col("_last") + k * step}
    ).drop("_last_year", "_last", "_before")


def compare_scenarios(df: DataFrame, keys: Sequence[str], scenario: str, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Values under two scenarios side by side and their difference; one aggregate, no self-join."""
    aggs = []
    for v in values:
        va, vb = F.max(F.when(F.col(scenario) == a, F.col(v))), F.max(F.when(F.col(scenario) == b, F.col(v)))
        aggs += [va.alias(f"{v}_a"), vb.alias(f"{v}_b"), (va - vb).alias(f"{v}_a_minus_b")]
    return df.filter(F.col(scenario).isin(a, b)).groupBy(*keys).agg(*aggs)


def path_series(
    history: DataFrame, forecast: DataFrame, entity: str, year: str, observed: str, path: str, horizon: int, *, keys: Sequence[str] = ()
) -> DataFrame:
    """The last observed point per entity followed by the forecast points up to the horizon."""
    last = latest_rows(history.filter(F.col(observed).isNotNull()), [entity], [year])
    start = forecast.select(entity, *keys).distinct().join(last.select(entity, year, F.col(observed).alias("value")), entity)
    points = forecast.filter(F.col(year) <= horizon).select(entity, *keys, year, F.col(path).alias("value"))
    return start.withColumn("kind", F.lit("observed")).unionByName(points.withColumn("kind", F.lit("forecast")))


def projected_change(forecast: DataFrame, history: DataFrame, entity: str, year: str, observed: str, predicted: str) -> DataFrame:
    last = latest_rows(history.filter(F.col(observed).isNotNull()), [entity], [year])
    out = forecast.join(last.select(entity, F.col(observed).alias("latest_observed")), entity, "left")
    change = F.col(predicted) - F.col("latest_observed")
    return out.withColumns({"projected_change": change, "projected_change_share": safe_ratio(change, "latest_observed")})


def slider_profile(scenario: Column | str, part: str) -> Column:
    """Weight of one mechanism under a scenario; 1 for a scenario without a profile."""
    current = as_col(scenario)
    return F.coalesce(
        *[F.when(current == name, F.lit(profile[part])) for name, profile in specs.SLIDER_PROFILES.items()],
        F.lit(specs.SLIDER_NEUTRAL[part]),
    )


def slider_raw_adjustment(
    scenario: Column | str, deltas: Mapping[str, float], *, share: Column, dating: Column, growth: Column, genai: Column
) -> Column:
    """Raw effect of moved sliders: coefficient x move x entity sensitivity x scenario weight."""
    measures = {"share": share, "dating": dating, "growth": F.abs(growth), "genai": genai}
    terms = []
    for slider, per_unit, base, slope, measure, cap in specs.SLIDER_EFFECTS:
        reach = measures[measure] * slope
        sensitivity = F.lit(base) + (reach if cap is None else F.least(F.lit(cap), reach))
        terms.append(F.lit(per_unit * float(deltas.get(slider, 0.0))) * sensitivity * slider_profile(scenario, slider))
    raw = reduce(lambda a, b: a + b, terms)
    return F.when(as_col(scenario) == "reference_path", F.lit(0.0)).otherwise(raw)


def slider_mechanisms(scenario: Column | str, deltas: Mapping[str, float], share: Column) -> dict[str, Column]:
    """Stored mechanism scores plus what the moved sliders add; the reference path stays as stored."""
    on_reference = as_col(scenario) == "reference_path"
    out = {}
    for mechanism in dict.fromkeys(m for m, *_ in specs.SLIDER_MOVES):
        own = [(part, slider, score, slope) for m, part, slider, score, slope in specs.SLIDER_MOVES if m == mechanism]
        moves = [F.lit(score * float(deltas.get(slider, 0.0))) * (F.lit(1.0) + share * slope) for _, slider, score, slope in own]
        moved = slider_profile(scenario, own[0][0]) * reduce(lambda a, b: a + b, moves)
        out[mechanism] = F.coalesce(F.col(mechanism), F.lit(0.0)) + F.when(on_reference, F.lit(0.0)).otherwise(moved)
    return out
