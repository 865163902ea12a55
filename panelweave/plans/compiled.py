"""Fitted models as relations and expressions, so that scoring needs no ML pipeline and a recursion no job per year.

A ridge becomes a weighted sum with look-ups for its categories. A tree ensemble becomes a relational node table, which
rows can descend level by level in joins (``descend``), or an array per tree, which an expression walks inside one fold over
the calendar (``compiled_forecast``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, row_mean
from ..session import checkpoint_dir, materialize
from . import specs
from .models import FittedModel, Stat, known_ahead, places

Lookup = Callable[[str], Column]


# --- compiled forms ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class CompiledLinear:
    """Intercept, weights of standardised numbers, and a weight per known category; an unknown category adds nothing."""

    name: str
    intercept: float
    weights: Mapping[str, float]
    stats: Mapping[str, Stat]
    categories: Mapping[str, tuple[str, Mapping[str, float]]]  # column: mode for a missing value, weight by value

    @property
    def features(self) -> list[str]:
        return [*self.weights, *self.categories]

    def attach(self, df: DataFrame) -> DataFrame:
        return df

    def score(self, value: Lookup) -> Column:
        terms = [F.lit(float(self.intercept))]
        for c, w in self.weights.items():
            s = self.stats[c]
            terms.append(F.lit(float(w)) * ((F.coalesce(value(c).cast("double"), F.lit(s.median)) - F.lit(s.mean)) / F.lit(s.scale or 1.0)))
        for c, (mode, by_value) in self.categories.items():
            if by_value:
                known = F.map_from_arrays(F.lit(list(by_value)), F.lit(list(by_value.values())))
                terms.append(F.coalesce(F.element_at(known, F.coalesce(value(c).cast("string"), F.lit(mode))), F.lit(0.0)))
        return reduce(lambda a, b: a + b, terms)


MODEL = "_compiled_model"  # the column that holds the trees of a compiled ensemble
CELL = "_cell"  # the columns that tell the cells of a compiled ensemble apart
CELLS_AT_MOST = 1 << 62  # in one such column


@dataclass(frozen=True)
class CompiledTrees:
    """An ensemble as a node table: ``tree``, ``weight``, ``node``, ``feature`` (-1 in a leaf), ``threshold``, ``left``, ``right``, ``value``.

    A row goes left where its feature is at most the threshold. The score is the weighted sum of the leaves reached.
    """

    name: str
    features: Sequence[str]
    medians: Mapping[str, float]
    nodes: DataFrame
    trees: int
    depth: int
    cuts: Sequence[Sequence[float]]  # per feature its thresholds in all trees, ascending; no more than the bins of the training

    def vector(self, value: Lookup) -> Column:
        return F.array(*[F.coalesce(value(c).cast("double"), F.lit(float(self.medians[c]))) for c in self.features])

    def _corners(self, f: int) -> list[float]:
        """A value in each of a feature's places, which go from above all cuts down; the last place is that of NaN."""
        return [float("inf"), *reversed(self.cuts[f]), float("nan")]

    def _packs(self) -> list[list[int]]:
        """The features whose places are numbered together in a cell column."""
        packs, room = [], 0
        for f in range(len(self.features)):
            if room < len(self._corners(f)):
                packs, room = [*packs, []], CELLS_AT_MOST
            packs[-1].append(f)
            room //= len(self._corners(f))
        return packs

    def place(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """``df`` with the cell of each row, and the names of these columns. No node tells the rows of a cell apart."""
        x = self.vector(F.col)
        found = {f"{CELL}_p{f}": (F.get(x, F.lit(f)), cuts) for f, cuts in enumerate(self.cuts)}
        placed = places(df, found)
        numbers = {}
        for k, pack in enumerate(self._packs()):
            number = F.lit(0).cast("bigint")
            for f in pack:
                number = number * len(self._corners(f)) + F.col(f"{CELL}_p{f}")
            numbers[f"{CELL}{k}"] = number
        return placed.select(*df.columns, *[c.alias(n) for n, c in numbers.items()]), list(numbers)

    def corner(self) -> dict[str, Column]:
        """The features of a value in the cell, from the cell's columns: it goes the way of every row there."""
        made = {}
        for k, pack in enumerate(self._packs()):
            rest = F.col(f"{CELL}{k}")
            for f in reversed(pack):
                places = F.lit(len(self._corners(f))).cast("bigint")
                made[self.features[f]] = F.get(F.lit(self._corners(f)), F.pmod(rest, places).cast("int"))
                rest = F.call_function("div", rest, places)
        return made

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with all trees in one column: arrays by node number. Their size is that of the model, whatever the data."""
        one = F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "left", "right", "value")))
        trees = self.nodes.groupBy("tree", "weight").agg(one.alias("n"))
        parts = F.struct("tree", "weight", *[F.col(f"n.{c}").alias(c) for c in ("feature", "threshold", "left", "right", "value")])
        return df.withColumn(MODEL, trees.agg(F.array_sort(F.collect_list(parts))).scalar())

    def score(self, value: Lookup) -> Column:
        def leaf(tree: Column, x: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                feature = F.get(tree["feature"], at)
                goes_left = F.get(x, feature) <= F.get(tree["threshold"], at)
                return F.when(feature < 0, at).when(goes_left, F.get(tree["left"], at)).otherwise(F.get(tree["right"], at))

            return F.get(tree["value"], F.aggregate(F.sequence(F.lit(1), F.lit(max(self.depth, 1))), F.lit(0), step))

        # the vector is bound once by the outer transform, not rebuilt at every node
        summed = lambda x: F.aggregate(F.col(MODEL), F.lit(0.0), lambda total, tree: total + tree["weight"] * leaf(tree, x))
        return F.get(F.transform(F.array(self.vector(value)), summed), F.lit(0))


Compiled = CompiledLinear | CompiledTrees


def node_table(model: GBTRegressionModel | RandomForestRegressionModel, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted ensemble as rows, from the files in which Spark keeps a model; written once, for its many readers."""
    path = f"{checkpoint_dir(spark)}/panelweave/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    share = F.lit(1.0 / len(model.treeWeights)) if isinstance(model, RandomForestRegressionModel) else F.col("weight")
    n = spark.read.parquet(f"{path}/data").toDF("tree", "n")
    rows = n.select(
        "tree",
        F.col("n.id").alias("node"),
        F.col("n.split.featureIndex").alias("feature"),
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("n.leftChild").alias("left"),
        F.col("n.rightChild").alias("right"),
        F.col("n.prediction").alias("value"),
    )
    joined = rows.join(weights.withColumn("weight", share), "tree")
    return materialize(joined.select("tree", "weight", "node", "feature", "threshold", "left", "right", "value"))


def compile_model(model: FittedModel) -> Compiled:
    """The relational or expression form of a fitted ridge, boosted ensemble or forest; equal to ``model.predict``."""
    last = model.pipeline.stages[-1]
    if isinstance(last, (GBTRegressionModel, RandomForestRegressionModel)):
        medians = {c: s.median for c, s in model.stats.items()}
        depth = max(t.depth for t in last.trees)
        nodes = node_table(last, SparkSession.active())
        found = nodes.filter("feature >= 0").groupBy("feature").agg(F.array_sort(F.collect_set("threshold")).alias("cuts")).collect()
        cuts = {r.feature: r.cuts for r in found}  # one row per feature
        return CompiledTrees(model.name, list(medians), medians, nodes, len(last.treeWeights), depth, [cuts.get(f, []) for f in range(len(medians))])
    if not isinstance(last, LinearRegressionModel) or not model.standardize:
        raise TypeError(f"no compiled form of {type(last).__name__}")
    weights = iter(last.coefficients.toArray().tolist())
    numbers = {c: next(weights) for c in model.stats}
    labels = {s.getOutputCol().removesuffix("__i"): list(s.labels) for s in model.pipeline.stages if isinstance(s, StringIndexerModel)}
    order = next(s for s in model.pipeline.stages if isinstance(s, VectorAssembler)).getInputCols()
    if order != [f"{c}__x" for c in numbers] + [f"{c}__v" for c in labels]:
        raise ValueError("the model's vector is not in the order of its features")
    categories = {c: (model.modes[c], {label: next(weights) for label in known}) for c, known in labels.items()}
    return CompiledLinear(model.name, last.intercept, numbers, model.stats, categories)


def by_cell(model: CompiledTrees, df: DataFrame, score: Callable[[DataFrame, list[str]], DataFrame], column: str) -> DataFrame:
    """``df`` with the score of each row's cell as one more column.

    Trees are cut at a few values of each feature, so rows that lie between the same cuts go the same way in all of them.
    ``score(cells, keys)`` gets one row per cell that ``df`` has, with the model's features and the cell's columns ``keys``,
    and gives the keys and the score. Cells are no more than rows, nor than the cuts allow, however many rows there are.
    """
    placed, keys = model.place(df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by number: a cell is a few bytes and 250 trees of work, so its size says nothing about the tasks it needs
    cells = placed.select(*keys).distinct().repartition(parts, *keys).withColumns(model.corner())
    return placed.join(score(cells, keys).select(*keys, column), keys).select(*df.columns, column)


def compiled_predict(model: Compiled, df: DataFrame, column: str = "prediction") -> DataFrame:
    """``df`` with the score as one more column, by an expression alone: on the rows, or on the cells of an ensemble."""

    def score(rows: DataFrame, _: Sequence[str] = ()) -> DataFrame:
        return model.attach(rows).withColumn(column, model.score(F.col)).drop(MODEL)

    return by_cell(model, df, score, column) if isinstance(model, CompiledTrees) else score(df)


# --- the node table as a relation ---------------------------------------------------------------------


def descend(rows: DataFrame, keys: Sequence[str], model: CompiledTrees, column: str = "prediction") -> DataFrame:
    """``keys`` and the score: every row walks down all trees at once, one equi-join with the node table per level.

    A row is one token per tree, (tree, node), which each join moves to a child; leaves stay. The node table has at most
    trees * 2^(depth + 1) rows, however many rows are scored, so it goes to the tasks, and the tokens, which are rows times
    trees, meet it where they are made: only ``rows`` are shuffled, once, by the keys of the sum over trees.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, model.vector(F.col).alias("_x")).repartition(parts, *keys)
    tokens = dealt.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(model.trees - 1)))).withColumn("node", F.lit(0))
    inner_nodes = F.broadcast(model.nodes.select("tree", "node", "feature", "threshold", "left", "right"))
    for _ in range(model.depth):
        inner = tokens.join(inner_nodes, ["tree", "node"])
        child = F.when(F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        tokens = inner.select(*keys, "_x", "tree", F.when(F.col("feature") < 0, F.col("node")).otherwise(child).alias("node"))
    ends = tokens.join(F.broadcast(model.nodes.select("tree", "node", (F.col("weight") * F.col("value")).alias("_part"))), ["tree", "node"])
    return ends.groupBy(*keys).agg(F.sum("_part").alias(column))


def descend_by_cell(rows: DataFrame, keys: Sequence[str], model: CompiledTrees, column: str = "prediction") -> DataFrame:
    """As ``descend``, but the tokens are those of the cells: one walk for all rows between the same cuts."""
    scored = by_cell(model, rows, lambda cells, own: descend(cells, own, model, column), column)
    return scored.groupBy(*keys).agg(F.sum(column).alias(column))


# --- recursion in one fold ----------------------------------------------------------------------------


def compiled_forecast(
    model: Compiled,
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
    """A fitted model in a closed loop, as ``recursive_forecast`` does it, but in one plan without a job per year.

    Each (entity, path) gathers its own future years, a calendar-sized array, and folds over them: the bounded prediction of
    a year becomes the next year's ``<target>_lag1``; ``<target>_lag2``, ``<target>_lag3``, ``<target>_rolling3``,
    ``history_mean_target`` and ``year_index`` follow. Every other feature is read from the year's covariates. Two shuffles
    on the entity and path, none per year; nothing is collected or written.
    """
    keys = [entity, *path]
    known = history.filter(F.col(target).isNotNull())
    newest = Window.partitionBy(entity).orderBy(F.col(year).desc())
    ranked = known.select(entity, year, F.col(target).cast("double").alias("_t")).withColumn("_rank", F.row_number().over(newest))
    seed = ranked.groupBy(entity).agg(
        F.min(year).alias("_first"), F.max(year).alias("_last"), F.sum("_t").alias("_sum"), F.count("_t").alias("_n"),
        *[F.max(F.when(F.col("_rank") == k, F.col("_t"))).alias(f"_y{k}") for k in (1, 2, 3)],
    )
    own = {f"{target}_lag1", f"{target}_lag2", f"{target}_lag3", f"{target}_rolling3", "history_mean_target", "year_index"}
    given = [c for c in model.features if c not in own]
    covariates = known_ahead(history, future, keys, entity, year, exogenous_lags)
    steps = covariates.join(seed.select(entity, "_last"), entity).filter(F.col(year) > F.col("_last"))
    # features are numbered in the struct, so that any name will do
    step_row = F.struct(F.col(year).alias("t"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(given)])
    gathered = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(step_row), lambda a, b: (a["t"] - b["t"]).cast("int")).alias("_steps"))
    ready = model.attach(gathered.join(seed.drop("_last"), entity))

    def state(y1: Column, y2: Column, y3: Column, total: Column, n: Column, made: Column) -> Column:
        parts = {"y1": y1, "y2": y2, "y3": y3, "total": total, "n": n, "made": made}
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    def step(acc: Column, s: Column) -> Column:
        here = {f"{target}_lag{k}": acc[f"y{k}"] for k in (1, 2, 3)} | {
            f"{target}_rolling3": row_mean([acc["y1"], acc["y2"], acc["y3"]]),
            "history_mean_target": acc["total"] / acc["n"],
            "year_index": (s["t"] - F.col("_first")).cast("int"),
        }
        here |= {c: s[f"x{i}"] for i, c in enumerate(given)}
        # bound once: the score stands in five places of the new state
        moved = lambda p: state(
            p, acc["y1"], acc["y2"], acc["total"] + F.coalesce(p, F.lit(0.0)), acc["n"] + F.lit(1).cast("bigint"), F.concat(acc["made"], F.array(p))
        )
        return F.get(F.transform(F.array(clip(model.score(lambda c: here[c]), low, high)), moved), F.lit(0))

    start = state(F.col("_y1"), F.col("_y2"), F.col("_y3"), F.col("_sum"), F.col("_n"), F.array().cast("array<double>"))
    folded = ready.withColumn("_made", F.aggregate("_steps", start, step, lambda acc: acc["made"]))
    zipped = F.arrays_zip(F.transform("_steps", lambda s: s["t"]).alias("t"), F.col("_made").alias("p"))
    return folded.select(*keys, F.inline(zipped)).select(*keys, F.col("t").alias(year), F.col("p").alias("predicted"))
