"""Vector best-fit packing of tokenized documents into sequences.

Pieces of equal length have equal resource vectors (tokens, one document, attention cost = length squared). So their exact
histogram, which has at most as many rows as a sequence has tokens, holds all that a best-fit plan needs: the plan is made
on it, for whole groups of equal bins, and every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, ship, width
from .tokens import chunk_ids

END = 1  # id that closes every document
TOKENS = 4096


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence and the weights of its residuals; the defaults of the last two never bind before tokens do."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    select: str = "norm"  # "norm": smallest weighted residual norm; "dot": largest weighted dot product with the item

    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        if min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError("a sequence must hold at least one token")
        return min(self.tokens, math.isqrt(self.attention))


class _Bins:
    """Groups of equal bins, each an interval of sequence numbers with one residual vector."""

    def __init__(self, capacity: Capacity):
        self.full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.int64)
        self.scale = np.array(capacity.weights) / self.full.astype(np.float64)
        self.select, self.n, self.used = capacity.select, 0, 0
        self.first, self.many, self.left = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros((64, 3), np.int64)

    def add(self, first: int, many: int, left: np.ndarray) -> None:
        if self.n == len(self.first):
            self.first, self.many, self.left = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.many, self.left))
        self.first[self.n], self.many[self.n], self.left[self.n] = first, many, left
        self.n += 1

    def best(self, item: np.ndarray) -> int | None:
        left = self.left[: self.n]
        fits = np.flatnonzero((left >= item).all(axis=1) & (self.many[: self.n] > 0))
        if not len(fits):
            return None
        if self.select == "dot":
            score = -(left[fits] * item * self.scale * self.scale).sum(axis=1)
        else:
            score = (((left[fits] - item) * self.scale) ** 2).sum(axis=1)
        return int(fits[np.argmin(score)])

    def prune(self, smallest: int) -> None:
        """Forget groups that no remaining item fits."""
        alive = np.flatnonzero((self.left[: self.n] >= 1).all(axis=1) & (self.many[: self.n] > 0))
        self.first, self.many, self.left = self.first[alive], self.many[alive], self.left[alive]
        self.n = len(alive)
        if self.n == 0:
            self.first, self.many, self.left = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros((64, 3), np.int64)


def plan(histogram: dict[int, int], capacity: Capacity = Capacity()) -> np.ndarray:
    """Runs of equal placements: rows (length, first rank, copies per bin, first bin, offset in the bin).

    Longest pieces first; each goes to the bin that the rule selects among those with room under every constraint. Under the
    norm rule the chosen bin stays the best one until the item no longer fits, under the dot rule bins of a group take turns,
    so whole groups move at once and the work follows the number of lengths, not of pieces.
    """
    bins, runs = _Bins(capacity), []
    for step, (length, count) in enumerate(sorted(histogram.items(), reverse=True)):
        item = np.array([length, 1, length * length], dtype=np.int64)
        if (item > bins.full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rank, waiting = 0, int(count)
        while waiting:
            chosen = bins.best(item)
            if chosen is None:
                each = int((bins.full // item).min())
                many = waiting // each or 1
                first, left = bins.used, bins.full
                bins.used += many
            else:
                first, many, left = int(bins.first[chosen]), int(bins.many[chosen]), bins.left[chosen].copy()
                each = int((left // item).min()) if bins.select == "norm" else 1
            each = min(each, waiting)
            take = min(many, waiting // each)
            runs.append((length, rank, each, first, int(bins.full[0] - left[0])))
            if chosen is not None:
                bins.first[chosen] += take
                bins.many[chosen] -= take
            bins.add(first, take, left - each * item)
            rank += take * each
            waiting -= take * each
        if step % 64 == 63:
            bins.prune(length)
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, longest: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """Tokenized documents, each closed by id 1; only those longer than ``longest`` are cut.

    ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (little-endian 32-bit). A null or
    empty text is the closing id alone. Whole texts are read, one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_ids(tokenizer).texts
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                raw = found.tobytes() + end
                for number, at in enumerate(range(0, len(raw) // 4, longest)):
                    part = raw[4 * at : 4 * (at + longest)]
                    doc.append(doc_id)
                    piece.append(number)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            made = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                made, names = [*made, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(made, names=names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def packed(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset`` (their place there, gapless from 0).

    The histogram of lengths (at most ``capacity.tokens`` rows) is all that the driver sees. Ranks within a length are
    salted: a row number per length and salt plus the sizes of the salts before, so one length with a third of all pieces is
    spread over all partitions. Rows that repeat a document are packed as often as they occur; null doc_ids are packed too;
    an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    made = pieces(docs, tokenizer, capacity.longest(), with_ids)
    made = keep(made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(width(spark))).cast("int")), "pieces")
    cells = keep(made.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "cells")
    runs = plan({r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("inside", F.row_number().over(inside)).join(cells, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    order = np.lexsort((runs[:, 1], runs[:, 0]))
    table = runs[order]
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            past = rank - table[at, 1]
            sequence = table[at, 3] + past // table[at, 2]
            offset = table[at, 4] + past % table[at, 2] * length
            arrays = [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(columns).schema.fields)
    return ranked.select(*columns, "rank").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")
