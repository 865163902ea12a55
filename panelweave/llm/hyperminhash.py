"""Near-duplicate detection with HyperMinHash sketches, verified on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches
from .components import components
from .store import discard, keep, ship

ROWS, BANDS = 6, 42  # a pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 6) ** 42 < 3e-6
SURE = 5.5  # standard errors below the threshold at which an estimate rules a pair out
ORDERS = 4  # of ids, by which buckets choose their leaders: large groups have a few leaders and not one for every bucket
TURNS = 2  # further leaders of buckets that hold several components
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20  # size of one side of a cell in which members of a bucket are compared


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (128 bits of the set) and ``regs`` (the registers, little-endian 16 bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sketches.WordHashes()
        for batch in batches:
            made = list(sketches.digests(batch.column(1).to_pylist(), shingle, words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in made], pa.int64()),
                    pa.array([key for _, key, _ in made], pa.binary()),
                    pa.array([regs.tobytes() for _, _, regs in made], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "regs"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    """``key``, ``id``: one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sketches.band_keys(np.frombuffer(r, dtype=np.uint16), ROWS, BANDS) for r in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
            flat = np.fromiter((k for own in keys for k in own), dtype=np.int64, count=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids.astype(np.int64))], names=["key", "id"])

    return classes.select("id", "regs").mapInArrow(run, "key bigint, id bigint")


def _led(bands: DataFrame) -> DataFrame:
    """``key``, ``id``, ``leader``, ``m`` (its number of members) of the buckets with several ids.

    The leader is the first in one of ``ORDERS`` orders, chosen by the key. Members that meet in many buckets so meet the same
    leaders again and are few pairs, while leaders still differ enough to find what a single one would not.
    """
    salt = F.xxhash64(F.pmod("key", F.lit(ORDERS)))
    mask = F.col("id").bitwiseXOR(salt)
    buckets = bands.groupBy("key").agg(F.min(mask).alias("lo"), F.max(mask).alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi")
    return bands.join(buckets.select("key", F.col("lo").bitwiseXOR(salt).alias("leader"), "m"), "key")


def _margin(used: np.ndarray, threshold: float) -> np.ndarray:
    return SURE * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))


def _plausible(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """False only where the corrected estimate lies ``SURE`` standard errors under the threshold, or the sizes exclude a link."""
    used = ((a != sketches.EMPTY) | (b != sketches.EMPTY)).sum(axis=-1)
    threshold = percent / 100
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (sketches.estimate(a, b, n_a, n_b) >= threshold - _margin(used, threshold))


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs with both registers that the estimate does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("a_regs", "b_regs"))
                n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a_n", "b_n"))
                good = pa.array(_plausible(a, b, n_a, n_b, percent))
                yield batch.select(["a", "b"]).filter(good)

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs of texts whose whole shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sketches.WordHashes()
        for batch in batches:
            good = [
                sketches.overlap_linked(sketches.shingle_set(x, shingle, words), sketches.shingle_set(y, shingle, words), percent)
                for x, y in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist())
            ]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "u bigint, v bigint")


def _links_in_cells(shingle: int, percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links between members of different components in each cell of a pack: a forest per cell, so never more than members.

        The cells of a pack are told apart by number in one pass, since most buckets have a handful of members.
        """
        frame = frame.sort_values(["key", "i", "j", "id"], kind="stable").reset_index(drop=True)
        words, texts, sets, found = sketches.WordHashes(), frame["text"].tolist(), {}, []
        columns = ("key", "i", "j", "id", "component", "side", "n", "diagonal")
        key, i, j, ids, group, side, n, diagonal = (frame[c].to_numpy() for c in columns)
        regs, group = np.frombuffer(b"".join(frame["regs"]), dtype=np.uint16).reshape(len(frame), -1), group.copy()

        def whole(at: int) -> np.ndarray:
            """The shingle set of a member, made only for those that an estimate cannot tell apart."""
            if at not in sets:
                sets[at] = sketches.shingle_set(texts[at], shingle, words)
            return sets[at]

        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        starts = np.flatnonzero(new)
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)]):
            sets.clear()
            here = np.arange(first, end)
            asking, asked = (here, here) if diagonal[first] else (here[side[first:end] == 1], here[side[first:end] == 0])
            for x in asking:
                others = asked[asked < x] if diagonal[first] else asked
                others = others[group[others] != group[x]]
                if len(others):
                    others = others[_plausible(regs[others], regs[x], n[others], n[x], percent)]
                for y in others:
                    if group[y] != group[x] and sketches.overlap_linked(whole(x), whole(y), percent):
                        found.append((ids[x], ids[y]))
                        own = group[first:end]  # a view
                        own[own == group[y]] = group[x]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def _mixed(wide: DataFrame, found: DataFrame) -> DataFrame | None:
    """``key``, ``id``, ``component``, ``major`` (its largest component) of the buckets that hold several; None if there are none."""
    named = wide.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("major"), F.count(F.lit(1)).alias("parts"))
    # written, so that its size is known: a short list is broadcast and the members of a hot bucket stay where they are
    parts = keep(parts.filter("parts > 1").select("key", "major"), "mixed")
    if parts.isEmpty():
        discard(parts)
        return None
    out = keep(named.join(parts, "key"), "wide")
    discard(parts)
    return out


def _linked_in_cells(wide: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between the components of buckets, from cells of bounded size that give back forests.

    A member of the largest component of its bucket is compared with the members of the others only, so a bucket of one large
    component and a few strays is as many cells as it has blocks, each with the strays beside a block.
    """
    sizes = texts.groupBy("id").agg(F.max("bytes").alias("bytes"))
    wide = wide.join(sizes, "id").withColumn("large", F.col("component") == F.col("major"))
    blocks = lambda of: F.greatest(F.ceil(F.count_if(of) / BLOCK_ROWS), F.ceil(F.sum(F.when(of, F.col("bytes")).otherwise(0)) / BLOCK_BYTES))
    counts = keep(wide.groupBy("key").agg(blocks(F.col("large")).alias("of_large"), blocks(~F.col("large")).alias("of_rest")), "blocks")
    placed = wide.join(counts, "key")
    spread = lambda of: F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1)
    block = F.pmod(F.xxhash64("id"), F.when(F.col("large"), F.col("of_large")).otherwise(F.col("of_rest")))
    placed = placed.withColumn("block", block)
    cell = lambda i, j, side, diagonal: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"), diagonal.alias("diagonal"))
    own, no = F.col("block"), F.lit(False)
    beside = F.transform(spread("of_rest"), lambda j: cell(own, -1 - j, F.lit(0), no))
    across = F.transform(spread("of_large"), lambda i: cell(i, -1 - own, F.lit(1), no))
    among = F.transform(spread("of_rest"), lambda j: cell(F.least(own, j), F.greatest(own, j), own > j, own == j))
    cells = placed.select("key", "id", "component", F.inline(F.when(F.col("large"), beside).otherwise(F.concat(across, among))))
    # registers come along, so that only the texts of pairs that pass the estimate are cut into shingles
    cells = cells.join(classes.select("id", "n", "regs"), "id").join(texts.select("id", "text"), "id")
    # small cells share a group: about as many rows and bytes together as one full cell
    rows, size = wide.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    packs = 1 + rows // BLOCK_ROWS + size // BLOCK_BYTES
    cells = cells.withColumn("pack", F.pmod(F.xxhash64("key", "i", "j"), F.lit(packs)))
    more = keep(cells.groupBy("pack").applyInPandas(_links_in_cells(shingle, percent), "u bigint, v bigint"), "more-links")
    discard(counts)
    return more


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``class_id``.

    Documents are linked when the Jaccard similarity of their sets of word shingles, confirmed on the whole sets, is at least
    ``percent`` / 100; ``component_id`` is the smallest doc_id that links reach and ``kept`` marks that document.

    1. Every text becomes a HyperMinHash sketch: in each of 256 buckets the leading-zero count and 10 mantissa bits of the
       smallest hash. Texts with the same set (128-bit digest) form a class, whose smallest doc_id stands for all.
    2. Registers are cut into 42 bands of 6 (an empty register borrows from an occupied one). Classes that share a band are
       a bucket. Each bucket has one leader, drawn in one of a few orders; leader-member pairs pass the collision-corrected estimate,
       then the check on the whole sets. Their components come from alternating stars.
    3. Buckets that still hold several components get further leaders, one a turn, from outside of their largest component.
       What then stays apart is compared across components in cells of bounded size, the largest component only with the
       rest; a cell gives back a forest of links and never its pairs. So no link between members of a bucket is lost.

    Null, empty and blank texts have no shingles and are linked with nothing. A null doc_id links with nothing, has a null
    component and is kept. Rows that repeat a doc_id with the same set are all kept or all dropped together; with different
    texts they are one document, which any of its texts may link. Extra columns are ignored. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    made = keep(sketch(docs, shingle), "sketches")
    usable = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = keep(
        usable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs")), "classes"
    )
    bands = _bands(classes)
    members = keep(_led(bands), "buckets")

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("binary").alias("text"))
    involved = members.select("id").distinct()
    texts = keep(texts.join(involved, "id").withColumn("bytes", F.length("text")), "texts")

    def compared(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (``a``, ``b``) of class ids: the estimate on registers first, whole texts of what is left."""
        side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("regs").alias(f"{s}_regs"))
        likely = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        likely = _estimated(likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_regs", "b_regs"), percent)
        body = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"{s}_text"))
        likely = likely.join(body("a"), "a").join(body("b"), "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "a_text", "b_text")
        return keep(_verified(likely, shingle, percent), "links")

    links = compared(members.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")))
    final = components(links)
    star = lambda found: found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    wide = members.filter("m > 2").select("key", "id")
    wide, done = _mixed(wide, final), [members, links]
    for turn in range(TURNS):
        if wide is None:
            break
        done.append(wide)
        # one more leader for every bucket that is not one component, from outside of its largest one
        order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "component")
        leaders = wide.filter("component <> major").groupBy("key").agg(F.min(order).alias("l"))
        leaders = keep(leaders.select("key", F.col("l.id").alias("b"), F.col("l.component").alias("other")), "leaders")
        links = compared(wide.join(leaders, "key").filter("component <> other").select(F.col("id").alias("a"), "b"))
        done += [leaders, links]
        if not links.isEmpty():
            final = components(star(final).unionByName(links))
        wide = _mixed(wide.select("key", "id"), final)
    if wide is not None:
        done.append(wide)
        more = _linked_in_cells(wide, classes, texts, shingle, percent)
        done.append(more)
        if not more.isEmpty():
            final = components(star(final).unionByName(more))
    for table in (*done, texts):
        discard(table)

    named = made.select("doc_id", "n_shingles", "set_key").join(
        classes.select("set_key", F.col("id").alias("class_id")), "set_key", "left"
    )
    out = named.join(final.withColumnRenamed("node", "class_id"), "class_id", "left")
    # a document without shingles, or without id, stands for itself
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "class_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
        F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without the documents that a near copy with a smaller doc_id stands for; all its columns."""
    gone = near_duplicates(docs, shingle, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
