"""SimHash near-duplicates: fingerprints linked by a pigeonring search and the full Hamming check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import discard, keep, ship, width

BITS, SEED = 64, 42
SHINGLES_AT_ONCE = 1 << 16  # hashes whose bits are counted together
BLOCK = 4096  # members of a key that one cell takes from one side


# --- fingerprints -----------------------------------------------------------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64 bits; a bit is 1 if it is set in over half the hashes of the word shingles, repeats included.

    A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D; a shingle is its words with one space
    between, hashed by XXH64 with seed 42. A text with fewer words is one shingle; one without words gives zero.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, span = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - span] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[span - 1 :].tolist())]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = np.array(hashes[at : at + SHINGLES_AT_ONCE], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, fp bigint")


# --- pigeonring -------------------------------------------------------------------------------------------------------------


def ring(most: int) -> list[tuple[int, int]]:
    """``most`` + 1 segments as (first bit, bits), as even as they go.

    With one segment more than differing bits, a chain of k segments may hold floor(k * most / (most + 1)) = k - 1 of them.
    """
    n = most + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(segment: tuple[int, int]) -> int:
    first, bits = segment
    return ((1 << bits) - 1) << first


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def chain_masks(most: int) -> np.ndarray:
    """Row s: the cumulative masks of the chain that starts at segment s, from its third segment to the whole ring."""
    segments = ring(most)
    n = len(segments)
    rows = []
    for s in range(n):
        total = _mask(segments[s]) | _mask(segments[(s + 1) % n])
        row = []
        for k in range(2, n):
            total |= _mask(segments[(s + k) % n])
            row.append(total)
        rows.append(row)
    return np.array(rows, dtype=np.uint64)


def _own_keys(fp: Column, most: int) -> Column:
    """For each start of a chain: the start and the bits of its first two segments."""
    segments = ring(most)
    n = len(segments)
    return F.array(
        *[
            F.struct(F.lit(s).alias("start"), fp.bitwiseAND(F.lit(_signed(_mask(segments[s]) | _mask(segments[(s + 1) % n])))).alias("bits"))
            for s in range(n)
        ]
    )


def _visits(fp: Column, most: int) -> Column:
    """Keys of those whose second segment has one bit more than ``fp``: each pair with one such bit meets once."""
    segments = ring(most)
    n = len(segments)
    keys = []
    for s in range(n):
        both = _mask(segments[s]) | _mask(segments[(s + 1) % n])
        first, bits = segments[(s + 1) % n]
        for j in range(first, first + bits):
            bit = F.lit(_signed(1 << j))
            key = F.struct(F.lit(s).alias("start"), fp.bitwiseAND(F.lit(_signed(both))).bitwiseOR(bit).alias("bits"))
            keys.append(F.when(fp.bitwiseAND(bit) == 0, key))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def viable(differing: Column, start: Column, most: int) -> Column:
    """Whether the chain from ``start`` stays within its budgets from the third segment on, and the whole within ``most``.

    The keys have settled the first two segments: no differing bit in the first, one at most in the second.
    """
    tests = F.lit(False)
    for s, row in enumerate(chain_masks(most)):
        good = start == s
        for k, mask in enumerate(row, start=2):
            good = good & (F.bit_count(differing.bitwiseAND(F.lit(_signed(int(mask))))) <= k)
        tests = tests | good
    return tests


def _forest(most: int):
    """Links between components found in cells, at most one fewer than a task sees components."""

    def solve(key, fp, own, side, component, start, masks) -> list[tuple[int, int]]:
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        ends = np.repeat(np.append(begins[1:], len(fp)), np.diff(np.append(begins, len(fp))))
        names, group = np.unique(component, return_inverse=True)
        root = np.arange(len(names))
        found = []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        at = np.arange(len(fp))
        step = 1
        while True:
            at = at[at + step < ends[at]]
            if not len(at):
                return found
            a, b = at, at + step
            meet = (group[a] != group[b]) & (own[a] | own[b]) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[meet], b[meet]
            differing = fp[a] ^ fp[b]
            for k in range(masks.shape[1]):
                near = np.bitwise_count(differing & masks[start[a], k]) <= k + 2
                a, b, differing = a[near], b[near], differing[near]
            if len(a):
                pairs = np.unique(np.stack([np.minimum(group[a], group[b]), np.maximum(group[a], group[b])], axis=1), axis=0)
                for x, y in pairs.tolist():
                    p, q = top(x), top(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        found.append((int(names[x]), int(names[y])))
                group = np.array([top(x) for x in range(len(names))])[group]
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, columns = chain_masks(most), ["start", "bits", "i", "j", "fp", "own", "side", "component"]
        waiting = None

        def links(rows: pa.Table) -> pa.RecordBatch:
            c = {n: rows.column(n).to_numpy() for n in columns}
            key = np.stack([c["start"].astype(np.int64), c["bits"], c["i"], c["j"]], axis=1)
            made = solve(key, c["fp"].view(np.uint64), c["own"], c["side"], c["component"], c["start"], masks)
            u, v = (np.array([x[k] for x in made], dtype=np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            rows = pa.Table.from_batches([batch.select(columns)])
            if waiting is not None:
                rows = pa.concat_tables([waiting, rows])
            key = np.stack([rows.column(n).to_numpy().astype(np.int64) for n in columns[:4]], axis=1)
            other = np.flatnonzero((key != key[-1]).any(axis=1)) if len(key) else []
            cut = int(other[-1]) + 1 if len(other) else 0  # the last cell may go on in the next batch
            if cut:
                yield links(rows.slice(0, cut))
            waiting = rows.slice(cut).combine_chunks()
        if waiting is not None and waiting.num_rows:
            yield links(waiting)

    return run


def led(values: DataFrame, most: int) -> DataFrame:
    """``start``, ``bits``, ``fp``, ``own``, ``leader``: the members of every key, its leader left out, beside the leader.

    There is a leader per key, several times the rows of ``values``, which Spark does not see: it gives an exploded table the
    size of the table before. The merge hint keeps it from collecting the leaders on the driver for a broadcast.
    """
    own_rows = values.select("fp", F.explode(_own_keys(F.col("fp"), most)).alias("k"), F.lit(True).alias("own"))
    visits = values.select("fp", F.explode(_visits(F.col("fp"), most)).alias("k"), F.lit(False).alias("own"))
    own_rows, visits = (d.select("k.start", "k.bits", "fp", "own") for d in (own_rows, visits))
    mix = F.xxhash64("fp", "start")
    leaders = own_rows.groupBy("start", "bits").agg(F.min(F.struct(mix.alias("m"), F.col("fp").alias("leader"))).alias("x"))
    leaders = leaders.select("start", "bits", "x.leader").hint("merge")
    return own_rows.unionByName(visits).join(leaders, ["start", "bits"]).filter("fp <> leader")


def linked_components(values: DataFrame, most: int = 4) -> DataFrame:
    """``node``, ``component`` for the distinct 64-bit ``fp`` of ``values`` that lie within ``most`` bits of another one.

    The pigeonring principle: cut 64 bits into ``most`` + 1 segments in a ring. If two values differ in at most ``most``
    bits, some segment starts a chain in which the first k segments together differ in at most k - 1 bits, for every k.

    1. A value's keys are its chain starts with the bits of two segments. Pairs with equal first and second segment share a
       key; where the second segments differ in one bit, the value without that bit visits the key of the other.
    2. Every key has one leader. Members that pass the chain's further budgets and the full check are linked to it, so a
       key with very many members costs as many rows. Components come from alternating stars.
    3. Keys that still hold several components are compared across components, in cells of bounded size that give back
       forests of links. No link between two values is lost; only its pairs inside a component are never listed.
    """
    spark = values.sparkSession
    ship(spark)
    placed = keep(led(values, most).withColumn("near", viable(F.col("fp").bitwiseXOR(F.col("leader")), F.col("start"), most)), "placed")

    first = placed.filter("near").select(F.col("fp").alias("u"), F.col("leader").alias("v"))
    first = keep(components(first), "components")

    def named(df: DataFrame, column: str, name: str) -> DataFrame:
        found = first.select(F.col("node").alias(column), F.col("component").alias("_c"))
        return df.join(found, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")

    # the leader is a member too; a key whose only other member has been compared with it is done
    members = placed.select("start", "bits", "fp", "own", F.lit(1).alias("rest"))
    heads = placed.groupBy("start", "bits").agg(F.min("leader").alias("fp"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = members.join(heads.select("start", "bits"), ["start", "bits"], "left_semi").unionByName(
        heads.select("start", "bits", "fp", F.lit(True).alias("own"), F.lit(1).alias("rest"))
    )
    members = keep(named(members, "fp", "component").select("start", "bits", "fp", "own", "component"), "members")
    mixed = members.groupBy("start", "bits").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")
    )
    # written, so that its size is known: a short list is broadcast and the members of a hot key stay where they are
    mixed = keep(mixed.filter("lo < hi").select("start", "bits", F.ceil(F.col("m") / BLOCK).cast("bigint").alias("blocks")), "mixed")
    cells = members.join(mixed, ["start", "bits"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    same = F.col("block") == F.col("other")
    cells = cells.select(
        "start", "bits", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "own",
        F.when(same, 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"), "component",
    )
    cells = cells.repartition(width(spark), "start", "bits", "i", "j").sortWithinPartitions("start", "bits", "i", "j", "side")
    more = keep(cells.mapInArrow(_forest(most), "u bigint, v bigint"), "more-links")
    star = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = first if more.isEmpty() else keep(components(star.unionByName(more)), "components")
    for table in (placed, members, mixed, more, *([] if final is first else [first])):
        discard(table)
    return final


def near_duplicates(docs: DataFrame, shingle: int = 5, most: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 lower-case hex digits), ``component_id``.

    Rows whose fingerprints differ in ``most`` bits or fewer are linked; ``component_id`` is the smallest doc_id that links
    reach, the own one included. Texts are read once; after that only numbers move, one per distinct fingerprint.

    Null, empty and blank texts have the fingerprint zero and are linked like any other. A row without doc_id is linked too
    and takes the smallest doc_id of its component, null if that has none. Rows that repeat a doc_id each have their own
    fingerprint. Extra columns are ignored. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    made = keep(fingerprints(docs, shingle), "fingerprints")
    classes = keep(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = linked_components(classes.select("fp"), most)
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = keep(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return made.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
