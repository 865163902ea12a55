"""Exact top-k search by inner product: columnar branch-and-bound over quantised vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, ship

STEPS = 64  # steps of the quantisation per unit
CELL_ROWS, CELL_QUERIES = 4096, 1024  # size of one cell of the query x candidate grid
SEEDS, CLASSES = 2048, 64  # rows that every query meets first; classes of rows by their length
BATCH, BLOCK = 64, 16  # queries that are bounded together; dimensions added between two prunings


def quantised(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """``vec_id``, ``dim``, ``v`` (floor(steps * x) per component), ``norm`` (at least the vector's length).

    Components are little-endian 32-bit whole numbers where all of a row fit, else 64-bit floats of whole numbers. Rows with a null id, a null or empty vector, or a null, NaN or infinite component are left out; equal rows are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out, norms = [], [], [], []
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values
            gaps = ~flat.is_valid().to_numpy(zero_copy_only=False) if flat.null_count else None
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                part = slice(ends[i], ends[i + 1])
                x = values[part]
                if vec_id is None or not lists[i].is_valid or not len(x) or not np.isfinite(x).all() or (gaps is not None and gaps[part].any()):
                    continue
                ids.append(vec_id)
                dims.append(len(x))
                whole = np.floor(steps * x)
                norms.append(float(np.sqrt((whole * whole).sum())) * (1 + 1e-9))
                out.append(whole.astype("<i4" if np.abs(whole).max() < 1 << 31 else "<f8").tobytes())
            arrays = [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "dim", "v", "norm"])

    slim = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    slim = slim.distinct()
    return slim.mapInArrow(run, "vec_id bigint, dim int, v binary, norm double")


def _stacked(column: pd.Series, dim: int) -> np.ndarray:
    if all(len(v) == 4 * dim for v in column):
        return np.frombuffer(b"".join(column), dtype="<i4").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(v, dtype="<i4" if len(v) == 4 * dim else "<f8").astype(np.float64) for v in column])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id; ``ids`` ascend."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        chosen = np.sort(np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]))
        ids, scores = ids[chosen], scores[chosen]
    order = np.argsort(-scores, kind="stable")
    return ids[order], scores[order]


def search(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floors: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Exact (query id, ids, scores) of each query among ``rows``, its own id excluded, of at least the query's floor.

    Candidates lie dimension by dimension, strongest dimensions first. After each block of dimensions every partial product
    gets a bound from the norms of what is left of both vectors; candidates whose upper bound is below the floor or the k-th
    best lower bound of every query of the batch are dropped and the columns compacted. Whole numbers below 2^53 keep the sums exact;
    larger products go through Python integers.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    dim = rows.shape[1]
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    largest = (np.abs(queries).max(initial=0) + 1) * (np.abs(rows).max(initial=0) + 1) * dim
    if largest >= 2.0**53:
        whole = [[int(x) for x in r] for r in rows]
        for query_id, q in zip(query_ids, queries):
            own = [int(x) for x in q]
            scores = sorted((-sum(a * b for a, b in zip(own, r)), int(i)) for i, r in zip(ids, whole) if i != query_id)[:k]
            yield query_id, np.array([i for _, i in scores], dtype=object), np.array([-s for s, _ in scores], dtype=object)
        return
    strong = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(rows[:, strong].T)
    queries = queries[:, strong]
    cuts = list(range(0, dim, BLOCK)) + [dim]
    rest = np.stack([np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts[1:]])
    for at in range(0, len(queries), BATCH):
        q, own, floor = queries[at : at + BATCH], query_ids[at : at + BATCH], floors[at : at + BATCH]
        alive, data, left = ids, columns, rest
        partial = np.zeros((len(q), len(ids)))
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            partial += q[:, lo:hi] @ data[lo:hi]
            if hi == dim or not len(alive) or (len(alive) <= 4 * k and not np.isfinite(floor).all()):
                continue
            slack = np.sqrt((q[:, hi:] ** 2).sum(axis=1))[:, None] * left[b][None, :] * (1 + 1e-12) + 1
            lower = partial - slack
            lower[own[:, None] == alive[None, :]] = -np.inf  # a query's own row sets no bound
            least = np.partition(lower, len(alive) - k, axis=1)[:, len(alive) - k] if len(alive) > k else np.full(len(q), -np.inf)
            wanted = (partial + slack >= np.maximum(least, floor)[:, None]).any(axis=0)
            if wanted.mean() < 0.8:
                alive, data, left, partial = alive[wanted], data[:, wanted], left[:, wanted], partial[:, wanted]
        for i, query_id in enumerate(own):
            others = (alive != query_id) & (partial[i] >= floor[i])
            yield query_id, *_best(alive[others], partial[i][others], k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, steps: int = STEPS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` rows with the highest inner product for every query.

    ``is_query`` is a condition on ``vec_id``. Candidates are all rows but the query's own vec_id; ties go to the smaller
    vec_id; a query with fewer candidates gets all. Vectors meet vectors of their own dimension only. Every distinct vector of
    a repeated vec_id is a candidate; of a repeated query the products of all its vectors are ranked together. Null and non-finite vectors take no part; an empty table gives no rows.

    1. Every query meets the same ``SEEDS`` rows, the longest ones and some drawn by hash; its k-th best score among them is a
       floor that the answer cannot fall under.
    2. The other rows fall into classes by length. A query is sent to a class only if its length times the longest of the
       class reaches its floor, and prunes by the floor inside. The grid is cut into cells of at most about 4096 x 1024; a
       cell is one group, returns k rows per query at most, and a ranking that Spark trims in each task merges the cells.
    """
    ship(vectors.sparkSession)
    made = quantised(vectors, steps).withColumn("draw", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)))
    made = keep(made, "vectors")
    marks = F.percentile_approx("norm", [i / CLASSES for i in range(1, CLASSES)], 10_000)
    n, m, edges = made.agg(F.count(F.lit(1)), F.count_if(is_query), marks).first()  # as many edges as classes
    parts, groups = max(1, math.ceil(n / CELL_ROWS / CLASSES)), max(1, math.ceil(m / CELL_QUERIES))
    seed_share, top = min(1.0, SEEDS / 2 / max(n, 1)), (edges or [0.0])[-1]
    # half of the seeds by hash, half of them among the longest class
    seed = (F.col("draw") < int(seed_share * (1 << 30))) | ((F.col("norm") >= top) & (F.col("draw") < int(min(1.0, CLASSES * seed_share) * (1 << 30))))
    place = lambda x: F.pmod(F.xxhash64("vec_id", "v", F.lit(x)), F.lit(1 << 31))
    other = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    asked = made.filter(is_query).withColumn("g", (place(2) % groups).cast("int"))
    keys = ["c", "p", "g", "dim"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            dim = int(left["dim"].iloc[0])
            floors = left["floor"].to_numpy(dtype=np.float64)
            sides = left["vec_id"].to_numpy(), _stacked(left["v"], dim), right["r_vec_id"].to_numpy(), _stacked(right["r_v"], dim)
            cell = search(*sides, k, np.where(np.isnan(floors), -np.inf, floors))
            for query_id, ids, scores in cell:
                found.append(pd.DataFrame({"query_id": int(query_id), "vec_id": ids.astype("int64"), "score": np.clip(scores, -(2**63), 2**63 - 1).astype("int64")}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

    def met(queries: DataFrame, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("g", other(groups)).select(*[F.col(c).alias(f"r_{c}") for c in (*keys, "vec_id", "v")])
        pairs = queries.select(*keys, "vec_id", "v", "floor").groupBy(*keys).cogroup(rows.groupBy(*[f"r_{c}" for c in keys]))
        return pairs.applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda cells: cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    seeds = made.filter(seed).withColumns({"c": F.lit(-1), "p": F.lit(0)})
    first = keep(best(met(asked.withColumns({"c": F.lit(-1), "p": F.lit(0), "floor": F.lit(None).cast("double")}), seeds)), "first")
    floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    # equal products of several vectors of one query id are one candidate each, so the floor holds for the id
    classes = lambda x: sum((F.when(x >= e, 1).otherwise(0) for e in (edges or [])), F.lit(0))
    rows = made.filter(~seed).withColumns({"c": classes(F.col("norm")), "p": (place(1) % parts).cast("int")})
    longest = {r.c: r.most for r in rows.groupBy("c").agg(F.max("norm").alias("most")).collect()}  # one row per class
    reach = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(most)).alias("most")) for c, most in sorted(longest.items())])
    if longest:
        sent = asked.join(floors, "vec_id", "left").withColumn("at", F.explode(reach))
        sent = sent.filter(F.col("floor").isNull() | (F.col("norm") * F.col("at.most") * (1 + 1e-9) + 1 >= F.col("floor")))
        sent = sent.withColumn("c", F.col("at.c")).withColumn("p", other(parts))
        first = first.drop("rank").unionByName(met(sent, rows))
    else:
        first = first.drop("rank")
    return best(first).select("query_id", "rank", "vec_id", "score")
