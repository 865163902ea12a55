"""How corpus filters interact: counts for every order of the filters, and exact Shapley values by constrained least squares."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

FILTERS = "ABCDE"  # bit i of a mask: the document fails filter i
UPPER, INNER = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
SIGNS = re.compile(rb"[#$%&*|]")


def own_failures(text: bytes | None) -> int:
    """Mask of the filters A to D that a text fails by itself; null counts as empty.

    A: under 100 words. B: 100 * distinct words < 80 * words. C: 100 * capitals A-Z > 10 * code points. D: any of # $ % & * |
    """
    text = text or b""
    words = text.split()
    n = len(words)
    mask = n < 100
    mask |= (100 * len(set(words)) < 80 * n) << 1
    capitals, points = len(text) - len(text.translate(None, UPPER)), len(text.translate(None, INNER))
    mask |= (100 * capitals > 10 * points) << 2
    return mask | (SIGNS.search(text) is not None) << 3


def document_masks(docs: DataFrame) -> DataFrame:
    """``part``, ``doc_id`` and ``mask`` of all five filters; one row per row of ``docs``.

    E fails where a smaller doc_id has the same text anywhere in the table (equal SHA-256). Texts are read once; the shuffle
    carries digests and smallest ids, combined in each task, and the join of short rows is split by the adaptive skew join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array([own_failures(t.as_py()) for t in batch.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("digest"), masks], names=["part", "doc_id", "digest", "own"])

    ship(docs.sparkSession)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.col("text").cast("binary").alias("text"),
    )
    rows = slim.mapInArrow(run, "part string, doc_id bigint, digest binary, own int")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    joined = rows.join(least.select("digest", "least"), "digest", "left")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return joined.select("part", "doc_id", F.col("own").bitwiseOR(F.shiftleft(again, 4)).alias("mask"))


@lru_cache(maxsize=4)
def attribution_weights(n: int) -> tuple[tuple[int, ...], ...]:
    """Row i, column S: n! times the weight of coalition S in the value of player i.

    The values minimise the kernel-weighted squared distance between v(S) - v({}) and the sum of the members' values, under
    the constraint that all values add up to v(all). The normal equations with the multiplier are solved in rationals.
    """
    whole = (1 << n) - 1
    bits = lambda s: [(s >> i) & 1 for i in range(n)]
    kernel = {s: Fraction(n - 1, comb(n, sum(bits(s))) * sum(bits(s)) * (n - sum(bits(s)))) for s in range(1, whole)}
    rows = []
    for i in range(n):
        left = [sum((w for s, w in kernel.items() if bits(s)[i] and bits(s)[j]), Fraction(0)) for j in range(n)] + [Fraction(1)]
        right = [kernel[s] * bits(s)[i] if s in kernel else Fraction(0) for s in range(whole + 1)]
        right[0] -= sum(right[1:])  # v({}) is taken from every other value
        rows.append(left + right)
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == whole) - int(s == 0)) for s in range(whole + 1)])
    size = n + 1
    for i in range(size):
        pivot = next(r for r in range(i, size) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(size):
            if r != i and rows[r][i]:
                factor = rows[r][i]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[i])]
    scaled = [[x * factorial(n) for x in row[size:]] for row in rows[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("weights times n! must be whole numbers")
    return tuple(tuple(int(x) for x in row) for row in scaled)


def interactions(masks: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step; zeros included.

    ``masks`` has ``part``, ``doc_id`` and ``mask``; ``labels`` has ``doc_id``, ``quality`` and ``toxic``. All documents of a
    part with equal masks are counted together first, so what follows sees at most 2^n rows a part: the documents removed by
    each of the 2^n coalitions, whose differences are the counts of every step, and whose weighted sums are the Shapley
    values times n! (the removals of a filter summed over all orders).
    """
    n, whole = len(filters), (1 << len(filters)) - 1
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    table = masks.select("part", "doc_id", "mask").join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(one("good")).alias("good"), F.sum(one("toxic")).alias("toxic")
    )
    hit = lambda s: F.col("mask").bitwiseAND(F.lit(s)) != 0
    gone = lambda c: F.array(*[F.sum(F.when(hit(s), F.col(c)).otherwise(0)) for s in range(whole + 1)])
    alone = F.array(*[F.sum(F.when(F.col("mask") == (1 << i), F.col("n")).otherwise(0)) for i in range(n)])
    parts = table.groupBy("part").agg(
        F.sum("n").alias("all"), gone("n").alias("v"), gone("good").alias("good"), gone("toxic").alias("toxic"), alone.alias("alone")
    )
    value = lambda w: sum((F.lit(x).cast("bigint") * F.col("v")[s] for s, x in enumerate(w) if x), F.lit(0).cast("bigint"))
    parts = parts.withColumn("shapley", F.array(*[value(w) for w in attribution_weights(n)]))
    parts = parts.withColumn("order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(filters)])))
    parts = parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = lambda k: F.instr(F.lit(filters), F.substr("order", k, F.lit(1))) - 1
    before = F.aggregate(
        F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda acc, k: F.when(k < F.col("step"), acc.bitwiseOR(_bit(place(k), n))).otherwise(acc)
    )
    parts = parts.withColumns({"i": place(F.col("step")), "before": before})
    parts = parts.withColumn("after", F.col("before").bitwiseOR(_bit(F.col("i"), n)))
    step = lambda c: F.get(c, F.col("after")) - F.get(c, F.col("before"))
    return parts.select(
        "part",
        F.col("order").alias("filter_order"),
        "step",
        (F.col("all") - F.get("v", F.col("after"))).alias("kept"),
        step("v").alias("removed"),
        (F.get("v", _bit(F.col("i"), n)) - step("v")).alias("redundant"),
        F.get("alone", F.col("i")).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("i")).alias("shapley"),
    )


def _bit(place, n: int):
    return F.get(F.array(*[F.lit(1 << i) for i in range(n)]), place)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters on ``docs`` by ``lang``.

    A null text counts as empty; a null ``lang`` is the part of the empty string. A row without doc_id never fails E, makes no
    other row fail it and has no label. Rows that repeat a doc_id count each; of equal texts those with the smallest doc_id
    pass E. Labels that repeat a doc_id mark it if one of them does. Documents without label are neither good nor toxic.
    Extra columns are ignored. An empty table gives no rows.
    """
    return interactions(document_masks(docs), labels)


SQL = r"""
WITH labelled AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
words AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM texts),
flags AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body),
    regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
  FROM words),
counted AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flags LEFT JOIN labelled USING (doc_id) GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
seen AS (
  SELECT part, filter_order, step, n, good, toxic, f,
    f[ascii(filter_order[step]) - 64] AS fails,
    len(list_filter(range(1, step), lambda k: f[ascii(filter_order[k]) - 64])) > 0 AS earlier,
    len(list_filter(f, lambda x: x)) = 1 AS alone
  FROM steps, counted),
rows AS (
  SELECT part, filter_order, step,
    sum(CASE WHEN NOT earlier AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT earlier AND fails THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN earlier AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT earlier AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT earlier AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM rows"""
