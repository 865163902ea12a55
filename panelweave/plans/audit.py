"""Forecast scoring, bound shares, scenario diagnostics and consistency checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, row_mean, safe_ratio
from . import specs


def _count_if(condition: Column) -> Column:
    return F.count_if(condition)


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def at_ceiling(x: Column, high: float = specs.FORECAST_CEILING) -> Column:
    return flag(x >= F.lit(high - specs.BOUND_SLACK))


def at_floor(x: Column, low: float = specs.FORECAST_FLOOR) -> Column:
    return flag(x <= F.lit(low + specs.BOUND_SLACK))


def at_bound(x: Column, low: float = specs.FORECAST_FLOOR, high: float = specs.FORECAST_CEILING) -> Column:
    return at_ceiling(x, high) | at_floor(x, low)


# --- error metrics --------------------------------------------------------------------------------


def error_metrics(
    predictions: DataFrame,
    keys: Sequence[str],
    *,
    entity: str,
    region: str,
    year: str,
    actual: str,
    predicted: str,
    split_year: int,
) -> DataFrame:
    """RMSE, MAE, MAPE, R² and n overall, per entity, per region and per period, for each of ``keys``.

    Rows are summed once per (keys, entity, region, period); the four levels add up those
    sums with grouping sets, so the expansion multiplies group rows, not predictions. The
    sums of squares are taken from the table mean of the actual values, which keeps the
    total sum of squares exact when the values are far from zero.
    """
    scored = predictions.dropna(subset=[actual, predicted])
    anchor = scored.agg(F.avg(actual)).scalar()
    a, e, c = F.col("_a"), F.col("_e"), F.col("_c")
    measured = {
        "_a": F.col(actual).cast("double"),
        "_e": F.col(predicted).cast("double") - F.col(actual).cast("double"),
        "_c": F.col(actual).cast("double") - anchor,
        "period": F.when(F.col(year) < split_year, "before").otherwise("after"),
    }
    cells = (
        scored.withColumns(measured)
        .groupBy(*keys, F.col(entity).alias("_entity"), F.col(region).alias("_region"), "period")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(e * e).alias("sse"),
            F.sum(F.abs(e)).alias("sae"),
            F.sum(F.when(a != 0, F.abs(e / F.nullif(a, F.lit(0.0))))).alias("sape"),
            F.count_if(a != 0).alias("n_nonzero"),
            F.sum(c).alias("sc"),
            F.sum(c * c).alias("scc"),
        )
    )
    levels = [[F.col(k) for k in keys] + [F.col(x) for x in extra] for extra in ([], ["_entity"], ["_region"], ["period"])]
    dims = [*keys, "_entity", "_region", "period"]
    rolled = cells.groupingSets(levels, *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_level"),
        *[F.sum(s).alias(s) for s in ("n", "sse", "sae", "sape", "n_nonzero", "sc", "scc")],
    )
    bits = {7: ("overall", F.lit("all")), 3: ("entity", F.col("_entity").cast("string")), 5: ("region", F.col("_region").cast("string")), 6: ("period", F.col("period"))}
    kind = F.coalesce(*[F.when(F.col("_level") == b, F.lit(name)) for b, (name, _) in bits.items()])
    name = F.coalesce(*[F.when(F.col("_level") == b, label) for b, (_, label) in bits.items()])
    total = F.col("scc") - F.col("sc") * F.col("sc") / F.col("n")
    return rolled.select(
        *keys,
        kind.alias("group_type"),
        name.alias("group_name"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
        safe_ratio("sape", "n_nonzero").alias("mape"),
        F.when(F.col("n") > 1, F.lit(1.0) - safe_ratio("sse", total)).alias("r_squared"),
        F.col("n").alias("n_obs"),
    )


def metrics_side_by_side(metrics: DataFrame, model: str, split: str, splits: Sequence[str], values: Sequence[str]) -> DataFrame:
    return metrics.groupBy(model).agg(
        *[F.max(F.when(F.col(split) == s, F.col(v))).alias(f"{s}_{v}") for s in splits for v in values]
    )


# --- bounds ---------------------------------------------------------------------------------------


def bound_share(df: DataFrame, keys: Sequence[str], value: str, *, low: float = specs.FORECAST_FLOOR, high: float = specs.FORECAST_CEILING) -> DataFrame:
    x = F.col(value)
    out = df.filter(x.isNotNull()).groupBy(*keys).agg(
        _share(at_ceiling(x, high)).alias("bound_share_ceiling"), _share(at_floor(x, low)).alias("bound_share_floor")
    )
    total = F.col("bound_share_ceiling") + F.col("bound_share_floor")
    return out.withColumns({"bound_share": total, "bounded_heavily": total >= specs.HEAVY_BOUND_SHARE})


def bound_share_by_year(df: DataFrame, keys: Sequence[str], *, low: float, high: float) -> DataFrame:
    r, s = F.col("reference_path"), F.col("scenario_path")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _count_if(at_bound(r, low, high)).alias("bounded_reference"),
        _count_if(at_bound(s, low, high)).alias("bounded_scenario"),
        _share(at_bound(r, low, high)).alias("share_bounded_reference"),
        _share(at_bound(s, low, high)).alias("share_bounded_scenario"),
    )


def bound_share_by_scenario(df: DataFrame, keys: Sequence[str], *, low: float, high: float) -> DataFrame:
    r, s, d = F.col("reference_path"), F.col("scenario_path"), F.col("scenario_difference")
    both = at_bound(r, low, high) & at_bound(s, low, high)
    return df.groupBy(*keys).agg(
        _share(at_bound(r, low, high)).alias("share_reference_bounded"),
        _share(at_bound(s, low, high)).alias("share_scenario_bounded"),
        _share(flag(d == 0) & both).alias("share_zero_due_to_bound"),
    )


def nonzero_effects(df: DataFrame, keys: Sequence[str], difference: str, *, tolerance: float) -> DataFrame:
    d = F.col(difference)
    size = F.abs(d)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(d).alias("nonmissing"),
        _count_if(size > 1e-12).alias("nonzero_1e12"),
        _count_if(size > 1e-8).alias("nonzero_1e8"),
        _count_if(size > 1e-6).alias("nonzero_1e6"),
        _count_if(F.round(size, 3) > 0).alias("visible_nonzero_3dp"),
        F.min(d).alias("min_difference"),
        F.avg(d).alias("mean_difference"),
        F.max(d).alias("max_difference"),
        _count_if(d > 0).alias("positive"),
        _count_if(d < 0).alias("negative"),
        _count_if(d == 0).alias("zero"),
        _count_if(size < tolerance).alias("near_zero"),
    )


def nonzero_survival(df: DataFrame, keys: Sequence[str], *, low: float, high: float) -> DataFrame:
    """Of the rows off the bounds, the share with an effect; and the shares that are zero on the bounds."""
    r, s, d = F.col("reference_path"), F.col("scenario_path"), F.col("scenario_difference")
    free = ~at_bound(r, low, high) & ~at_bound(s, low, high)
    floor = at_floor(r, low) & at_floor(s, low)
    either = floor | (at_ceiling(r, high) & at_ceiling(s, high))
    zero = flag(F.abs(d) <= 1e-12)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _count_if(free).alias("unbounded_rows"),
        F.avg(F.when(free, F.when(zero, F.lit(0.0)).otherwise(F.lit(1.0)))).alias("share_nonzero_among_unbounded"),
        _share(zero & floor).alias("share_zero_both_floor"),
        _share(zero & either).alias("share_zero_both_bound"),
    )


# --- scenario diagnostics -------------------------------------------------------------------------


def scenario_diagnostics(
    df: DataFrame, keys: Sequence[str], difference: str, inputs: Sequence[str], *,
    earlier: str | None = None, revised: Column | None = None, only: Column | None = None,
) -> DataFrame:
    """Spread of the difference per slice, how the inputs moved, and a rule-based reason.

    ``only`` limits the rows, to one type of place for example. ``earlier`` is the effect that a former model gave, if any;
    where its mean is below -0.01 in a slice for which ``revised`` (a condition on the keys) holds, that is the reason.
    """
    df = df if only is None else df.filter(only)
    d = F.col(difference)
    size = F.abs(d)
    moved = row_mean([F.abs(F.col(c)) for c in inputs])
    sds = [F.stddev_pop(c) for c in inputs]
    out = df.groupBy(*keys).agg(
        F.min(d).alias("min_difference"),
        F.max(d).alias("max_difference"),
        F.avg(d).alias("mean_difference"),
        F.stddev_pop(d).alias("std_difference"),
        F.count_distinct(F.round(d, 3)).alias("distinct_3dp"),
        _count_if(d > 0.05).alias("positive_entities"),
        _count_if(d < -0.05).alias("negative_entities"),
        _count_if(size < 0.05).alias("near_zero_entities"),
        _share(flag(size < 0.05)).alias("share_below_005"),
        _share(flag(size < 0.10)).alias("share_below_010"),
        _share(flag(size < 0.50)).alias("share_below_050"),
        F.avg(moved).alias("input_change"),
        row_mean(sds).alias("input_dispersion"),
        (F.avg(earlier) if earlier else F.lit(None).cast("double")).alias("_earlier"),
    )
    turned = flag(F.col("_earlier") < -0.01) & (F.lit(False) if revised is None else flag(revised))
    mostly_zero = F.col("share_below_005") >= 0.8
    reason = (
        F.when(turned, "a former model gave the opposite sign")
        .when(mostly_zero & flag(F.col("input_change") < 0.05), "inputs barely change")
        .when(mostly_zero & flag(F.col("input_dispersion") < 0.02), "inputs move alike everywhere")
        .when(mostly_zero, "adjustment is modest")
        .otherwise("inputs vary enough for a visible spread")
    )
    return out.withColumn("diagnostic_reason", reason).drop("_earlier")


def audit_summary(df: DataFrame, difference: str, *, tolerance: float) -> DataFrame:
    """One row about one slice."""
    d = F.col(difference)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(d).alias("n_present"),
        F.min(d).alias("min_difference"),
        F.max(d).alias("max_difference"),
        F.avg(d).alias("mean_difference"),
        F.stddev_pop(d).alias("std_difference"),
        F.count_distinct(F.round(d, 3)).alias("distinct_3dp"),
        _count_if(d > tolerance).alias("positive"),
        _count_if(d < -tolerance).alias("negative"),
        _count_if(F.abs(d) <= tolerance).alias("near_zero"),
    )


def reliability_table(
    records: DataFrame, metrics: DataFrame, *, geography: str, model: str, year: str, expected: int | None = None, low: float, high: float
) -> DataFrame:
    """Per (geography, model): bound shares, the worst year, coverage, test fit, and a status by rule."""
    r, s = F.col("reference_path"), F.col("scenario_path")
    keys = [geography, model]
    per_year = records.groupBy(*keys, year).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(r).alias("n_reference"),
        _count_if(at_floor(r, low)).alias("low"),
        _count_if(at_ceiling(r, high)).alias("high"),
        _count_if(at_bound(s, low, high)).alias("scenario_bound"),
        _count_if(flag(F.col("scenario_difference") == 0) & at_bound(r, low, high) & at_bound(s, low, high)).alias("same"),
    )
    per_year = per_year.withColumn("share", safe_ratio(F.col("low") + F.col("high"), "n_reference"))
    table = per_year.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        safe_ratio(F.sum("low"), F.sum("n_reference")).alias("reference_lower_share"),
        safe_ratio(F.sum("high"), F.sum("n_reference")).alias("reference_upper_share"),
        safe_ratio(F.sum("scenario_bound"), F.sum("n")).alias("scenario_bound_share"),
        safe_ratio(F.sum("same"), F.sum("n")).alias("same_bound_zero_share"),
        F.max("share").alias("peak_bound_share"),
        F.max_by(year, F.struct(F.col("share"), -F.col(year))).alias("peak_bound_year"),
        safe_ratio(F.sum("n_reference"), F.lit(expected) if expected else F.sum("n")).alias("coverage_share"),
    )
    fit = metrics.select(model, F.col("rmse").alias("test_rmse"), F.col("r_squared").alias("test_r_squared"))
    out = table.join(fit, model, "left")
    boundary = F.col("reference_lower_share") + F.col("reference_upper_share")
    weak = flag(F.col("test_r_squared") <= 0)
    status = F.when((boundary > specs.CAUTION_BOUND_SHARE) | weak, "USE CAUTION").otherwise("AVAILABLE")
    return out.withColumns({"reference_bound_share": boundary, "negative_test_r2": weak, "status": status})


def attach_reliability(models: DataFrame, bounds: DataFrame, metrics: DataFrame, model: str) -> DataFrame:
    """Model rows with bound shares, test R², a reliable flag and a note."""
    fit = metrics.select(model, F.col("r_squared").alias("test_r_squared"))
    out = models.join(bounds, model, "left").join(fit, model, "left")
    heavy = F.coalesce(F.col("bounded_heavily"), F.lit(False))
    fits = F.coalesce(F.col("test_r_squared") > 0, F.lit(True))
    note = (
        F.when(heavy, "most forecasts sit on a bound, so scenario differences are suppressed")
        .when(~fits, "held-out fit is weak")
        .otherwise("usable benchmark")
    )
    return out.withColumns({"bounded_heavily": heavy, "reliable": ~heavy & fits, "performance_note": note})


def impact_direction(df: DataFrame, keys: Sequence[str], difference: str, geography: str) -> DataFrame:
    """Mean effect, entities above, below and near the reference, and the direction in words.

    The tolerance follows the geography type.
    """
    tol = F.when(F.max(geography) == "msa", specs.DIFFERENCE_TOLERANCE["msa"]).otherwise(specs.DIFFERENCE_TOLERANCE["state"])
    d = F.col(difference)
    row_tol = F.when(F.col(geography) == "msa", specs.DIFFERENCE_TOLERANCE["msa"]).otherwise(specs.DIFFERENCE_TOLERANCE["state"])
    out = df.filter(d.isNotNull()).groupBy(*keys).agg(
        F.avg(d).alias("mean_difference"),
        _count_if(d > row_tol).alias("n_above"),
        _count_if(d < -row_tol).alias("n_below"),
        _count_if(F.abs(d) <= row_tol).alias("n_near"),
        tol.alias("tolerance"),
    )
    mean = F.col("mean_difference")
    text = F.when(mean > F.col("tolerance"), "raises").when(mean < -F.col("tolerance"), "lowers").otherwise("stays close")
    return out.withColumn("direction", text)


def consistency_checks(records: DataFrame, *, coverage_keys: Sequence[str], entity: str, expected: int, required: Sequence[str]) -> DataFrame:
    """Violations as rows (rule, detail, n): coverage, missing values, and the difference identity."""
    coverage = (
        records.groupBy(*coverage_keys)
        .agg(F.count_distinct(entity).alias("n"))
        .filter(F.col("n") != expected)
        .select(F.lit("coverage").alias("rule"), F.concat_ws("|", *coverage_keys).alias("detail"), "n")
    )
    gaps = records.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    missing = gaps.unpivot([], list(required), "detail", "n").filter("n > 0").select(F.lit("missing").alias("rule"), "detail", "n")
    broken = F.abs((F.col("scenario_path") - F.col("reference_path")) - F.col("scenario_difference")) > 1e-8
    identity = (
        records.filter(broken)
        .groupBy(*coverage_keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("identity").alias("rule"), F.concat_ws("|", *coverage_keys).alias("detail"), "n")
    )
    return coverage.unionByName(missing).unionByName(identity)


def value_domain(df: DataFrame, keys: Sequence[str], value: str, *, symmetric: bool) -> DataFrame:
    """Axis range: symmetric around zero with a minimum span, or min/max with padding when constant."""
    lo, hi, top = F.min(value), F.max(value), F.max(F.abs(F.col(value)))
    constant = lo == hi
    span = F.greatest(top, F.lit(specs.MIN_DOMAIN_SPAN))
    pad = F.greatest(F.lit(specs.MIN_DOMAIN_SPAN), F.abs(lo) * specs.DOMAIN_PADDING)
    low = -span if symmetric else F.when(constant, lo - pad).otherwise(lo)
    high = span if symmetric else F.when(constant, hi + pad).otherwise(hi)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        constant.alias("is_constant"), F.when(constant, lo).alias("constant_value"), low.alias("zmin"), high.alias("zmax")
    )


def filter_funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], effect: str) -> DataFrame:
    """Rows left after each successive filter, and the effect's range among those left at the end; one pass."""
    aggs = [F.count(F.lit(1)).alias("rows_loaded")]
    passed: Column = F.lit(True)
    for name, condition in steps:
        passed = passed & flag(condition)
        aggs.append(F.count_if(passed).alias(f"after_{name}"))
    x = F.when(passed, F.col(effect))
    aggs += [
        F.count(x).alias("n_effects"),
        F.min(x).alias("effect_min"),
        F.avg(x).alias("effect_mean"),
        F.max(x).alias("effect_max"),
    ]
    return df.agg(*aggs)


def mismatch_report(
    rows: DataFrame, entities: DataFrame, rollups: Mapping[str, DataFrame], key: str, *, task: str, title: str
) -> DataFrame:
    """Per text roll-up: entities without it, and joined rows that have a task or a title but not it."""
    counts = rows.agg(
        *[F.count_if(F.col(c).isNull() & F.col(task).isNotNull()).alias(f"t_{c}") for c in rollups],
        *[F.count_if(F.col(c).isNull() & F.col(title).isNotNull()).alias(f"d_{c}") for c in rollups],
    )
    known = entities.select(key).distinct()
    rows_out = []
    for c, frame in rollups.items():
        absent = known.join(frame.select(key), key, "left_anti").agg(F.count(F.lit(1))).scalar()
        rows_out.append(
            F.struct(
                F.lit(c).alias("rollup"), absent.alias("entities_missing"), F.col(f"t_{c}").alias("rows_with_task"),
                F.col(f"d_{c}").alias("rows_with_title"),
            )
        )
    return counts.select(F.inline(F.array(*rows_out)))


def preferred_else_first(df: DataFrame, keys: Sequence[str], item: str, order: str, available: str, preferred: str | Column) -> DataFrame:
    """The preferred item where it is available, else the first available one."""
    wanted = preferred if isinstance(preferred, Column) else F.lit(preferred)
    place = F.struct((F.col(item) != wanted).cast("int").alias("a"), F.col(order).alias("b"))
    usable = F.when(F.col(available), place)
    return df.groupBy(*keys).agg(F.min_by(F.col(item), usable).alias("chosen"))


def mean_abs_error_top(df: DataFrame, entity: str, actual: str, predicted: str, k: int = 15) -> DataFrame:
    errors = df.dropna(subset=[actual, predicted]).groupBy(entity).agg(
        F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mean_abs_error")
    )
    return errors.orderBy(F.col("mean_abs_error").desc(), F.col(entity)).limit(k)


def contribution_by_bucket(df: DataFrame, bucket: Column, name: str, contribution: str) -> DataFrame:
    return df.groupBy(bucket.alias(name)).agg(
        F.sum(F.abs(F.col(contribution))).alias("abs_contribution"), F.sum(contribution).alias("net_contribution")
    )
