"""Spelling variants: words one edit apart, found by pivotal grams, and the form that each word goes back to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, keep, ship

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COUNTS_AT_ONCE = 400_000  # words that a task counts before it passes them on
# one edit elsewhere in the word: how it moves the pivot's place and the length, and the part up to or from the pivot that it leaves
SHIFTS = [(0, 0, "head"), (0, 1, "head"), (0, -1, "head"), (0, 0, "tail"), (1, 1, "tail"), (-1, -1, "tail")]


def words_of(doc_id: int | None, text: bytes | None, rate: int = 97) -> Iterator[tuple[str, int]]:
    """The distinct lower-cased runs of a text as the words they stand for, with their number of occurrences.

    One in ``rate`` runs, chosen by the hash of ``<doc_id>:<run>``, loses the letter that the hash points at.
    """
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall((text or b"").lower().decode("utf-8", "replace"))).items():
        h = crc32(run.encode(), start)
        if h % rate:
            yield run, n
        else:
            at = h % len(run)
            yield run[:at] + run[at + 1 :], n


def word_counts(docs: DataFrame, shortest: int = 5, fewest: int = 3, rate: int = 97) -> DataFrame:
    """``word``, ``n``: words of at least ``shortest`` code points that occur ``fewest`` times or more in the whole table.

    Each task counts before the shuffle, at most ``COUNTS_AT_ONCE`` words at a time, so a frequent word is one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py(), rate):
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) >= COUNTS_AT_ONCE:
                    yield rows()
        yield rows()

    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = slim.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def grams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def prefix(ranks: Sequence[int]) -> tuple[list[int], int]:
    """Places of the rarest three bigrams of a word, with all that tie with the third, and the rank of the third."""
    last = sorted(ranks)[2]
    return [i for i, r in enumerate(ranks) if r <= last], last


def pivots(places: Sequence[int], ranks: Sequence[int]) -> tuple[int, int]:
    """The two disjoint bigrams of the prefix with the least sum of ranks.

    Dynamic programme over places from left to right: ``one`` is the best bigram that ends before the next may begin, ``best``
    the best pair so far. Three different places always hold two that are two apart.
    """
    best: tuple[int, int, int] | None = None
    one: tuple[int, int] | None = None
    behind = 0
    for at in places:
        while behind < len(places) and places[behind] + 2 <= at:
            here = (ranks[places[behind]], places[behind])
            one = here if one is None else min(one, here)
            behind += 1
        if one is not None:
            pair = (one[0] + ranks[at], one[1], at)
            best = pair if best is None else min(best, pair)
    assert best is not None
    return best[1], best[2]


def near_pairs(words: DataFrame) -> DataFrame:
    """``a`` < ``b``: every pair of distinct ``word``s (four code points or more) one insertion, deletion or replacement apart.

    Bigrams are ranked by the number of words that hold them, rare ones first. A word's prefix is its three rarest bigrams,
    its pivots are two disjoint ones of them. One edit destroys one pivot at most. Of two words one has the prefix that ends
    at the lower or the same rank; its surviving pivot stands in the other's prefix, moved as the edit moves places and
    length, and the word up to it or from it on is untouched. So pivots, shifted in the ways an edit can, meet prefixes on
    (bigram, place, length, hash of the untouched part), and what meets is verified: the other untouched end first, then the
    distance. The ranks of the bigrams are a table of the alphabet squared: 90 letters make 8100 bigrams at most, whatever
    the input, and only these are sent to the tasks.
    """
    spark = words.sparkSession
    ship(spark)
    count = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))).alias("gram"))
    ordered = count.groupBy("gram").count().orderBy("count", "gram").collect()  # at most the alphabet squared
    rank = {r.gram: i for i, r in enumerate(ordered)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word in batch.column(0).to_pylist():
                ranks = [rank[g] for g in grams(word)]
                places, last = prefix(ranks)
                chosen = pivots(places, ranks)
                partner = dict(zip(chosen, chosen[::-1]))
                out += [(word, len(word), last, ranks[p], p, partner.get(p)) for p in places]
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.string(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "size", "last", "gram", "place", "partner"])

    index = keep(words.select("word").mapInArrow(run, "word string, size int, last int, gram int, place int, partner int"), "grams")
    head = F.xxhash64(F.lit("head"), F.substr("word", F.lit(1), F.col("place") + 2))
    tail = F.xxhash64(F.lit("tail"), F.substr("word", F.col("place") + 1, F.col("size")))
    parts = {"head": head, "tail": tail}
    # an edit behind both pivots is found by the later one, so for the earlier one what stands behind its partner is untouched too
    behind = F.when(F.col("partner") > F.col("place"), F.substr("word", F.col("partner") + 3, F.col("size"))).otherwise("")
    before = F.when(F.col("partner") < F.col("place"), F.substr("word", F.lit(1), F.col("partner"))).otherwise("")
    ends = {"head": (F.lit(""), behind), "tail": (before, F.lit(""))}
    shifts = [
        F.struct((F.col("place") + p).alias("place"), (F.col("size") + s).alias("size"), parts[side].alias("part"), ends[side][0].alias("begin"), ends[side][1].alias("end"))
        for p, s, side in SHIFTS
    ]
    asks = index.filter("partner IS NOT NULL").select("gram", F.col("word").alias("a"), F.col("last").alias("a_last"), F.inline(F.array(*shifts)))
    both = F.explode(F.array(head, tail)).alias("part")
    held = index.select("gram", "place", "size", both, F.col("word").alias("b"), F.col("last").alias("b_last"))
    met = asks.join(held, ["gram", "place", "size", "part"]).filter(
        "a_last <= b_last AND startswith(b, begin) AND endswith(b, end) AND a <> b AND levenshtein(a, b, 1) = 1"
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of the words that have a ``form``, by doubling: each round follows twice as many steps.

    A form occurs at least twice as often as its word, so a chain is no longer than the logarithm of the largest count.
    """
    current = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = keep(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(current)
        current = following
        if current.filter("moved").isEmpty():
            return current.select("word", "root")


def variants(docs: DataFrame, shortest: int = 5, fewest: int = 3, times: int = 2, rate: int = 97) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word that occurs most (ties: the smallest in code-point order) if it occurs at least ``times`` as
    often as the word, else null; ``root`` is where forms lead in the end, the word itself without one.

    Null and empty texts have no words. A row without doc_id is hashed with an empty id; rows that repeat a doc_id count
    each. Extra columns are ignored. An empty table gives no rows.
    """
    words = keep(word_counts(docs, shortest, fewest, rate), "words")
    pairs = keep(near_pairs(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    near = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("w"))).alias("best"))
    joined = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    strong = -F.col("best.m") >= times * F.col("n")
    joined = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(strong, F.col("best.w")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"),
    )
    joined = keep(joined, "forms")
    discard(pairs)
    found = roots(joined.filter(F.col("form").isNotNull()))
    return joined.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
