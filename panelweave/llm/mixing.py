"""Mix sources to target weights: repetition rates per source, and hash-seeded copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_running
from .store import discard, keep

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0  # the mix takes this share of all words; no source more than CAP times its own
WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 16.0**13  # a draw is 13 hexadecimal digits


def words(column: str = "text") -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target``, ``rate``: one row per source, null being one of them.

    ``docs`` needs ``source`` and ``size``. Sources in code point order, null last, take the weights in turn. The total is
    shared by weight; a target stops at ``cap`` times the size of its source and the excess is shared again by weight until
    none is above. Sizes are aggregated per source first; each round of sharing is one aggregate over the sources.
    """
    if share > cap:
        raise ValueError("the sources cannot give that share under this cap")
    sizes = docs.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    ranked = with_running(sizes, [F.col("source").isNull().asc(), F.col("source").asc()], {"rank": F.lit(1).cast("bigint")})
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights)))
    ranked = keep(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))), "sources")
    every, shares = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    total, level, stopped = share * every, share * every / (shares or 1), 0
    while True:
        above = F.col("weight") * F.lit(level) > F.lit(cap) * F.col("source_size")
        n, size, open_weight = ranked.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (total - cap * size) / open_weight
    target = F.least(F.lit(cap) * F.col("source_size"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target")).withColumn("rate", rate)


def copies(rate: Column, doc_id: Column, seed: str) -> Column:
    """floor(rate), plus one with probability equal to the fraction, drawn from a hash of the seed and the doc_id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    draw = F.conv(digits, 16, 10).cast("bigint") / F.lit(_STEPS)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def mixed_sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words the mix takes, repeats counted).

    ``taken`` is the size times the document's copies, so a document gives at most ``CAP`` times its size, and a run repeats
    another with the same seed. Null or empty texts have size 0; null sources are one source; null doc_ids share one draw,
    as do rows that repeat a doc_id. An empty table gives no rows. Extra columns are ignored.
    """
    slim = keep(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")), "sizes")
    targets = source_targets(slim).select(F.col("source").alias("_source"), "source_size", "target", "rate")
    joined = slim.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * copies(F.col("rate"), F.col("doc_id"), seed)
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns (and the same edge cases)."""
    slim = keep(docs.select(F.col("source").cast("string").alias("source"), words().alias("size")), "sizes")
    targets = source_targets(slim).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    discard(slim)
    joined = docs.join(targets, F.col("source").cast("string").eqNullSafe(F.col("_mix_source")))
    times = copies(F.col("_mix_rate"), F.col("doc_id"), seed).cast("int")
    return joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)


MIX_SQL = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM per_source),
filling AS (
  SELECT *, 2.0 * source_size / weight AS stop,
         sum(source_size) OVER (ORDER BY 2.0 * source_size / weight, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING) - source_size AS before_size,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING) - weight AS before_weight,
         sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM weighed),
level AS (
  SELECT arg_min((1.5 * all_size - 2.0 * before_size) / (all_weight - before_weight), before_weight) AS level FROM filling
  WHERE (1.5 * all_size - 2.0 * before_size) / (all_weight - before_weight) <= stop),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, weight * level)::DOUBLE AS target,
         CASE WHEN source_size > 0 THEN least(2.0 * source_size, weight * level)::DOUBLE / source_size ELSE 0.0 END AS rate
  FROM weighed, level),
mixed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         (floor(t.rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0
                                    < t.rate - floor(t.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)"""
