"""Model operators on Spark ML, scoring, recursion over years, and explanations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, row_mean
from ..functions.text import fixed, lag_bucket, prefix_family
from ..operators.aggregate import unpivot
from ..operators.ordering import exact_median, positions
from ..operators.windows import lag_features, rank_first
from ..session import checkpoint_dir, materialize
from . import specs

# --- profile --------------------------------------------------------------------------------------


def column_note(name: str, named: Mapping[str, str], endings: Sequence[tuple[str, str]] = specs.COLUMN_NOTES) -> str:
    """The note given for a column by name, else by the end of its name, else "derived"."""
    by_end = (note for end, note in endings if name.endswith(end))
    return named.get(name) or next(by_end, "derived")


def column_profile(df: DataFrame, named: Mapping[str, str] | None = None) -> DataFrame:
    """Name, type, note and present count of every column, from one aggregate; ``named`` gives notes by column."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(t).alias("dtype"),
                F.lit(column_note(c, named or {})).alias("description"),
                F.col(f"`{c}`").alias("n_present"),
            )
            for c, t in df.dtypes
        ]
    )
    return counts.select(F.inline(rows))


def feature_columns(df: DataFrame, candidates: Sequence[str], categorical: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric candidates that exist and have a value, and the categorical ones that exist."""
    kinds = dict(df.dtypes)
    numbers = ("int", "bigint", "double", "float", "smallint", "tinyint")
    known = [c for c in dict.fromkeys(candidates) if kinds.get(c, "").startswith(("decimal", *numbers))]
    present = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in known]).first() if known else None
    return [c for c in known if present[c]], [c for c in categorical if c in kinds]


# --- stored statistics ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Stat:
    median: float
    mean: float
    scale: float


def fit_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, Stat]:
    """Median, and mean and population sd after median imputation; one small row per feature reaches the driver."""
    long = unpivot(df, [], columns, "feature", "value")
    medians = {r["feature"]: r["median"] for r in exact_median(long, "value", by=["feature"]).collect()}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns]
    row = df.agg(
        *[F.avg(x).alias(f"m_{c}") for c, x in zip(columns, filled)],
        *[F.stddev_pop(x).alias(f"s_{c}") for c, x in zip(columns, filled)],
    ).first()
    return {c: Stat(medians[c], row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def apply_stats(stats: Mapping[str, Stat], suffix: str = "_std") -> dict[str, Column]:
    """Impute with the stored median, centre and scale; a zero scale is one."""
    return {
        f"{c}{suffix}": (F.coalesce(F.col(c).cast("double"), F.lit(s.median)) - F.lit(s.mean)) / F.lit(s.scale or 1.0)
        for c, s in stats.items()
    }


# --- models ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FittedModel:
    """A fitted model and what its input needs. ``predict`` adds one column."""

    name: str
    stats: Mapping[str, Stat]
    modes: Mapping[str, str]
    pipeline: PipelineModel
    standardize: bool

    @property
    def features(self) -> list[str]:
        return [*self.stats, *self.modes]

    def inputs(self) -> dict[str, Column]:
        """The columns the pipeline reads: numbers imputed (and scaled), categories with the mode for a missing one."""
        if self.standardize:
            made = apply_stats(self.stats, "__x")
        else:
            made = {f"{c}__x": F.coalesce(F.col(c).cast("double"), F.lit(s.median)) for c, s in self.stats.items()}
        return made | {f"{c}__c": F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in self.modes.items()}

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        scored = self.pipeline.transform(df.withColumns(self.inputs()))
        return scored.select(*df.columns, F.col("_prediction").alias(column))

    def save(self, path: str) -> None:
        """The pipeline, and the statistics and modes its input needs, in one folder of a shared file system."""
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        rows = [(self.name, self.standardize, c, None, s.median, s.mean, s.scale) for c, s in self.stats.items()]
        rows += [(self.name, self.standardize, c, m, None, None, None) for c, m in self.modes.items()]
        schema = "name string, standardize boolean, feature string, mode string, median double, mean double, scale double"
        numbered = [(i, *r) for i, r in enumerate(rows)]
        spark.createDataFrame(numbered, f"place int, {schema}").coalesce(1).write.mode("overwrite").parquet(f"{path}/inputs")

    @staticmethod
    def load(path: str) -> FittedModel:
        rows = SparkSession.active().read.parquet(f"{path}/inputs").orderBy("place").collect()  # one row per feature
        stats = {r.feature: Stat(r.median, r.mean, r.scale) for r in rows if r.mode is None}
        modes = {r.feature: r.mode for r in rows if r.mode is not None}
        return FittedModel(rows[0].name, stats, modes, PipelineModel.load(f"{path}/pipeline"), rows[0].standardize)


def most_frequent(df: DataFrame, column: str) -> str | None:
    row = (
        df.filter(F.col(column).isNotNull()).groupBy(column).count()
        .orderBy(F.col("count").desc(), F.col(column)).limit(1).collect()
    )
    return str(row[0][0]) if row else None


def fit_ridge(
    train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), *, alpha: float = 1.0, name: str = "statistical_ridge"
) -> FittedModel:
    """Ridge on standardised numbers and one-hot categories; an unseen category is all zero.

    Spark divides the mean squared error by two and measures the penalty against the
    label's population sd, so alpha becomes alpha * sd(y) / n.
    """
    rows = train.filter(F.col(target).isNotNull())
    stats = fit_stats(rows, numeric)
    modes = {c: most_frequent(rows, c) or "" for c in categorical}
    size = rows.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("sd")).first()
    inputs = apply_stats(stats, "__x")
    inputs.update({f"{c}__c": F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in modes.items()})
    stages = []
    vectors = [f"{c}__x" for c in numeric]
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"{c}__c", outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v", dropLast=True))
        vectors.append(f"{c}__v")
    stages.append(VectorAssembler(inputCols=vectors, outputCol="_features"))
    stages.append(
        LinearRegression(
            featuresCol="_features", labelCol=target, predictionCol="_prediction", elasticNetParam=0.0,
            regParam=alpha * (size.sd or 1.0) / size.n, standardization=False, solver="normal",
        )
    )
    model = Pipeline(stages=stages).fit(rows.withColumns(inputs))
    return FittedModel(name, stats, modes, model, True)


def places(df: DataFrame, columns: Mapping[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """``df`` with, per new column, the number of ascending cuts at or above a value: 0 above all of them, one too many for NaN.

    A search in compiled code; buckets are closed below and a node's left side is closed above, so values are negated.
    """
    cut = {name: (x, cuts) for name, (x, cuts) in columns.items() if cuts}
    ready = df
    if cut:
        ready = df.withColumns({f"{name}__n": F.lit(0.0) - x for name, (x, _) in cut.items()})
        splits = [[float("-inf"), *[0.0 - c for c in reversed(cuts)], float("inf")] for _, cuts in cut.values()]
        found = Bucketizer(splitsArray=splits, inputCols=[f"{name}__n" for name in cut], outputCols=[f"{name}__p" for name in cut], handleInvalid="keep")
        ready = found.transform(ready)
    number = {name: F.col(f"{name}__p").cast("int") if name in cut else F.lit(0) for name in columns}
    return ready.select(*df.columns, *[c.alias(name) for name, c in number.items()])


def _fit_trees(train: DataFrame, target: str, numeric: Sequence[str], learner, name: str) -> FittedModel:
    rows = train.filter(F.col(target).isNotNull())
    stats = fit_stats(rows, numeric)
    inputs = {f"{c}__x": F.coalesce(F.col(c).cast("double"), F.lit(s.median)) for c, s in stats.items()}
    assembler = VectorAssembler(inputCols=[f"{c}__x" for c in numeric], outputCol="_features")
    model = Pipeline(stages=[assembler, learner]).fit(rows.withColumns(inputs))
    return FittedModel(name, stats, {}, model, False)


def bin_values(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """The values that stand for the bins of each column, ascending: its own if they are few, else quantiles; two small rows."""
    shares = [(2 * k + 1) / (2 * bins) for k in range(bins)]
    first = df.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns], *[F.percentile_approx(c, shares, 10_000).alias(c) for c in columns]).first()
    few = [c for c in columns if first[f"n_{c}"] <= 2 * bins]  # an estimate, so the values of more columns than needed are gathered
    own = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
    return {c: own[c] if c in few and len(own[c]) <= bins else sorted(set(first[c] or [])) for c in columns}


def fit_boosted_trees(
    train: DataFrame, target: str, numeric: Sequence[str], *, rounds: int = 250, rate: float = 0.06, depth: int = 6, leaf: int = 4,
    seed: int = 42, name: str = "tree_gradient_boosting", bins: int = 32,
) -> FittedModel:
    """Boosted trees; the residuals are checkpointed every ten rounds, so the lineage stays short.

    Least squares on binned features needs no more of the rows than their number and mean target by bins: rows of the same
    bins go the same way in every tree, and their spread around that mean is no split's to explain. So each combination of
    bins that occurs is one weighted row in the rounds. A leaf's least size counts rows. Spark cuts between neighbouring
    values, so every value stands for what is nearest to it and the trees apply to the numbers as they are.
    """
    checkpoint_dir(train.sparkSession)
    rows = train.filter(F.col(target).isNotNull())
    stats = fit_stats(rows, numeric)
    exact = rows.select(F.col(target).cast("double").alias("_y"), *[F.coalesce(F.col(c).cast("double"), F.lit(s.median)).alias(f"{c}__x") for c, s in stats.items()])
    inputs = [f"{c}__x" for c in numeric]
    values = bin_values(exact, inputs, bins)
    cuts = {c: [(a + b) / 2.0 for a, b in zip(v, v[1:])] for c, v in values.items()}
    binned = places(exact, {f"{c}b": (F.col(c), cuts[c]) for c in inputs}).select(
        "_y", *[F.get(F.lit([*reversed(values[c]), float("nan")]), F.col(f"{c}b")).alias(c) for c in inputs]
    )
    cells = materialize(binned.groupBy(*inputs).agg(F.count(F.lit(1)).cast("double").alias("_rows"), F.avg("_y").alias("_y")))
    size = cells.agg(F.sum("_rows")).first()[0] or 0.0
    least = {"minWeightFractionPerNode": (leaf - 0.5) / size} if 2 * leaf <= size else {"minInstancesPerNode": leaf}  # else no split is allowed
    learner = GBTRegressor(
        featuresCol="_features", labelCol="_y", weightCol="_rows", predictionCol="_prediction", stepSize=rate, maxDepth=depth,
        maxIter=rounds, maxBins=bins, seed=seed, checkpointInterval=10, **least,
    )
    dealt = cells.repartition(train.sparkSession.sparkContext.defaultParallelism, *inputs)  # few bytes, much work
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_features"), learner]).fit(dealt)
    return FittedModel(name, stats, {}, model, False)


def boosting_losses(model: FittedModel, df: DataFrame, target: str) -> list[float]:
    """Mean squared error on ``df`` after each round of a boosted model: one number per round reaches the driver."""
    assembler, trees = model.pipeline.stages
    known = df.filter(F.col(target).isNotNull()).withColumns(model.inputs())
    ready = assembler.transform(known.withColumns({trees.getLabelCol(): F.col(target).cast("double"), trees.getWeightCol(): F.lit(1.0)}))
    return list(trees.evaluateEachIteration(ready, "squared"))


def fit_random_forest(
    train: DataFrame, target: str, numeric: Sequence[str], *, trees: int = 100, depth: int = 10, leaf: int = 4, seed: int = 42,
    name: str = "tree_random_forest",
) -> FittedModel:
    learner = RandomForestRegressor(
        featuresCol="_features", labelCol=target, predictionCol="_prediction", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=leaf, seed=seed,
    )
    return _fit_trees(train, target, numeric, learner, name)


# --- scoring --------------------------------------------------------------------------------------


def linear_score(coefficients: Mapping[str, float], intercept: float) -> Column:
    """Intercept + sum of coefficient x column, as an expression; missing inputs make it missing."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for c, w in coefficients.items()], F.lit(float(intercept)))


def prediction_frame(df: DataFrame, ids: Sequence[str], actual: str, predicted: Column | str, model: str, split: str = "split") -> DataFrame:
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return df.select(*ids, F.lit(model).alias("model_name"), F.col(split).alias("split"), F.col(actual).alias("actual"), p.alias("predicted"))


# --- recursion over years -------------------------------------------------------------------------


def linear_recursive_forecast(
    history: DataFrame,
    future: DataFrame,
    *,
    entity: str,
    path: Sequence[str],
    year: str,
    target: str,
    lags: Sequence[float],
    rolling: float,
    exogenous: Column,
    low: float = specs.FORECAST_FLOOR,
    high: float = specs.FORECAST_CEILING,
) -> DataFrame:
    """Closed loop of a linear model: each year's bounded prediction feeds the next year's lags.

    ``lags`` are the coefficients of lag 1, 2, 3 and ``rolling`` that of the mean of the last
    three values; ``exogenous`` is everything that does not depend on predictions, evaluated
    on ``future``. One row per (entity, path) folds over its own years, a calendar-sized array.
    A lag beyond the history counts as the last value.
    """
    newest = Window.partitionBy(entity).orderBy(F.col(year).desc())
    tail = (
        history.filter(F.col(target).isNotNull())
        .withColumn("_rank", F.row_number().over(newest))
        .filter("_rank <= 3")
        .groupBy(entity)
        .agg(
            F.max(year).alias("_last_year"),
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(year).alias("t"), F.col(target).cast("double").alias("y")))), lambda s: s["y"]).alias("_tail"),
        )
    )
    steps = (
        future.join(tail.select(entity, "_last_year"), entity)
        .filter(F.col(year) > F.col("_last_year"))
        .groupBy(entity, *path)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(year).alias("t"), exogenous.cast("double").alias("x")))).alias("_steps"))
        .join(tail.select(entity, "_tail"), entity)
    )

    def back(values: Column, k: int) -> Column:
        return F.coalesce(F.get(values, F.size(values) - k), F.element_at(values, -1))

    def step(values: Column, s: Column) -> Column:
        recent = F.slice(values, F.greatest(F.size(values) - 2, F.lit(1)), 3)
        mean = F.aggregate(recent, F.lit(0.0), lambda a, v: a + v) / F.size(recent)
        score = s["x"] + F.lit(float(rolling)) * mean
        for k, w in enumerate(lags, start=1):
            score = score + F.lit(float(w)) * back(values, k)
        return F.concat(values, F.array(clip(score, low, high)))

    folded = steps.withColumn("_all", F.aggregate("_steps", F.col("_tail"), step))
    made = F.slice("_all", F.size("_tail") + 1, F.size("_steps"))
    zipped = F.arrays_zip(F.transform("_steps", lambda s: s["t"]).alias("t"), made.alias("p"))
    return folded.select(entity, *path, F.inline(zipped)).select(
        entity, *path, F.col("t").alias(year), F.col("p").alias("predicted")
    )


def known_ahead(history: DataFrame, future: DataFrame, keys: Sequence[str], entity: str, year: str, lagged: Sequence[str]) -> DataFrame:
    """The future covariates with plain lags of ``lagged`` over history and future together."""
    if not lagged:
        return future
    past = history.select(entity, year, *lagged).join(future.select(*keys).distinct(), entity)
    both = past.withColumn("_is_future", F.lit(False)).unionByName(future.withColumn("_is_future", F.lit(True)), allowMissingColumns=True)
    with_path = both.withColumn("_path", F.struct(*keys))
    return lag_features(with_path, lagged, "_path", year, lags=(1, 2), rolling=None).filter("_is_future").drop("_is_future", "_path")


def recursive_forecast(
    score: Callable[[DataFrame, str], DataFrame],
    history: DataFrame,
    future: DataFrame,
    *,
    entity: str,
    path: Sequence[str],
    year: str,
    target: str,
    exogenous_lags: Sequence[str] = (),
    low: float = specs.FORECAST_FLOOR,
    high: float = specs.FORECAST_CEILING,
) -> DataFrame:
    """Any scorer in a closed loop: one distributed scoring step per future year, all entities and scenarios at once.

    For models without a compiled form; ``compiled.compiled_forecast`` gives the same for the fitted ones in one plan.

    ``score(df, column)`` adds the prediction. The features rebuilt each year are
    ``<target>_lag1..3``, ``<target>_rolling3``, ``history_mean_target`` and ``year_index``
    (from the entity's own first year). Covariates are known ahead, so their lags are plain
    lags over history and future together. Each year is written once, its state with it, which
    keeps the plan one year long.
    """
    keys = [entity, *path]
    known = history.filter(F.col(target).isNotNull())
    newest = Window.partitionBy(entity).orderBy(F.col(year).desc())
    tail = known.withColumn("_rank", F.row_number().over(newest)).filter("_rank <= 3")
    seed = known.groupBy(entity).agg(
        F.min(year).alias("_first"), F.max(year).alias("_last"), F.sum(target).alias("_sum"), F.count(target).alias("_n")
    ).join(
        tail.groupBy(entity).agg(*[F.max(F.when(F.col("_rank") == k, F.col(target))).alias(f"_y{k}") for k in (1, 2, 3)]), entity
    )
    covariates = known_ahead(history, future, keys, entity, year, exogenous_lags)
    covariates = materialize(covariates.join(seed.select(entity, "_last"), entity).filter(F.col(year) > F.col("_last")).drop("_last"))
    state = materialize(covariates.select(*keys).distinct().join(seed.drop("_last"), entity))
    years = [r[0] for r in covariates.select(year).distinct().orderBy(year).collect()]
    out = []
    for t in years:
        # a path without covariates this year keeps its state
        rows = state.join(covariates.filter(F.col(year) == t).withColumn("_has", F.lit(True)), keys, "left")
        rows = rows.withColumns(
            {
                f"{target}_lag1": F.col("_y1"),
                f"{target}_lag2": F.col("_y2"),
                f"{target}_lag3": F.col("_y3"),
                f"{target}_rolling3": row_mean(["_y1", "_y2", "_y3"]),
                "history_mean_target": F.col("_sum") / F.col("_n"),
                "year_index": (F.col(year) - F.col("_first")).cast("int"),
            }
        )
        scored = score(rows, "_raw").withColumn("predicted", F.when(F.col("_has"), clip("_raw", low, high)))
        done = materialize(scored.select(*keys, year, "predicted", "_has", "_first", "_sum", "_n", "_y1", "_y2", "_y3"))
        out.append(done.filter("_has").select(*keys, year, "predicted"))
        moved = lambda new, old: F.when(F.col("_has"), F.col(new)).otherwise(F.col(old))
        state = done.select(
            *keys, "_first", (F.col("_sum") + F.coalesce("predicted", F.lit(0.0))).alias("_sum"), (F.col("_n") + F.coalesce(F.col("_has").cast("int"), F.lit(0))).alias("_n"),
            moved("predicted", "_y1").alias("_y1"), moved("_y1", "_y2").alias("_y2"), moved("_y2", "_y3").alias("_y3"),
        )
    return reduce(lambda a, b: a.unionByName(b), out)


# --- explanations ---------------------------------------------------------------------------------


def _hash_order(feature: Column, row_id: Column, seed: int) -> Column:
    """A reproducible pseudo-random number per (feature, row): 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", feature, row_id.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def permutation_importance(
    df: DataFrame,
    score: Callable[[DataFrame, str], DataFrame],
    features: Sequence[str],
    target: str,
    row_id: str,
    *,
    seed: int = 42,
) -> DataFrame:
    """Rise of the RMSE when one feature's values change places, for all numeric features in one job.

    Row i of a feature takes the value of the row at place i in hash order. Both orders are
    numbered with range-cut positions, so no task sorts the whole table.
    """
    rows = df.filter(F.col(target).isNotNull())
    names = F.array(*[F.lit(f) for f in features])
    place = positions(rows.select(row_id), row_id, name="_place")
    values = rows.select(row_id, F.explode(F.map_from_arrays(names, F.array(*[F.col(f).cast("double") for f in features]))).alias("_feature", "_value"))
    values = values.withColumn("_hash", _hash_order(F.col("_feature"), F.col(row_id), seed))
    shuffled = positions(values, "_hash", by=["_feature"], name="_place").select("_feature", "_place", "_value")
    base = rows.join(place, row_id).select("*", F.explode(names).alias("_feature")).join(shuffled, ["_feature", "_place"])
    moved = base.withColumns({f: F.when(F.col("_feature") == f, F.col("_value")).otherwise(F.col(f).cast("double")) for f in features})
    squared = score(moved, "_p").withColumn("_e2", F.pow(F.col("_p") - F.col(target), F.lit(2.0)))
    plain = score(rows, "_p").agg(F.sqrt(F.avg(F.pow(F.col("_p") - F.col(target), F.lit(2.0))))).scalar()
    return squared.groupBy(F.col("_feature").alias("feature")).agg(F.sqrt(F.avg("_e2")).alias("_rmse")).select(
        "feature", (F.col("_rmse") - plain).alias("importance_value"), F.lit("permutation_rmse_delta").alias("importance_type")
    )


def local_perturbation(
    df: DataFrame,
    reference: DataFrame,
    score: Callable[[DataFrame, str], DataFrame],
    features: Sequence[str],
    keys: Sequence[str],
    *,
    name: str,
    place: str,
    year: str,
    categorical: Sequence[str] = (),
) -> DataFrame:
    """Prediction minus prediction with one feature at its reference value, per row and feature.

    The reference value is the median, or the most frequent value of a categorical feature.
    Rows are exploded by feature and scored once; the medians are one small row.
    """
    numeric = [f for f in features if f not in categorical]
    modes = {f: most_frequent(reference, f) for f in categorical}
    long = unpivot(reference, [], numeric, "feature", "value")
    medians = exact_median(long, "value", by=["feature"]).agg(
        F.struct(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f) for f in numeric])
    ).scalar()
    plain = score(df, "predicted")
    rows = plain.select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    here = lambda f: F.col("feature") == f
    changed = {f: F.when(here(f), medians.getField(f)).otherwise(F.col(f).cast("double")) for f in numeric}
    changed.update({f: F.when(here(f), F.lit(modes[f])).otherwise(F.col(f)) for f in categorical})
    out = score(rows.withColumns(changed), "_p").withColumn("contribution", F.col("predicted") - F.col("_p"))
    out = out.withColumn("_order", F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")))
    raises = F.col("contribution") >= 0
    out = out.withColumns(
        {
            "model_name": F.lit(name),
            "feature_family": prefix_family("feature", specs.FEATURE_FAMILIES),
            "temporal_bucket": lag_bucket("feature"),
            "direction": F.when(raises, "positive").otherwise("negative"),
            "importance_rank": rank_first(keys, F.col("contribution"), ["_order"]),
        }
    )
    sentence = F.concat(
        F.col(place), F.lit(" "), F.col(year).cast("int").cast("string"), F.lit(": "), F.col("feature_family"),
        F.when(raises, " raises").otherwise(" lowers"), F.lit(" the projected rate by about "),
        fixed(F.abs("contribution"), 2), F.lit("."),
    )
    return out.select(
        *keys, "model_name", "predicted", "feature", "feature_family", "temporal_bucket", "contribution", "direction",
        "importance_rank", sentence.alias("plain_english"),
    )
