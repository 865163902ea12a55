"""Spelling variants, SimHash links and the filter audit against plain Python versions and on odd rows."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations, permutations
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelweave.llm import filter_audit, simhash, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", word string, n bigint, fp bigint, part string, mask int, digest string, step int, component_id string, own int, i int"
LONG = " ".join(f"word{'abcdefg'[i % 7]}x{'klm'[i % 3]} Ünïcodeß" for i in range(20_000))
ODD = [
    (1, "the same words in two rows of this table", "en", "a", 1),
    (1, "the same words in two rows of this table", "en", "a", 1),
    (2, "the same words in two rows of this table", None, None, None),
    (3, None, "en", "b", 0),
    (4, "", "en", None, 0),
    (None, "a row without an id but with some words in it", "de", "a", 3),
    (5, " \t\n ", "", "", 3),
    (6, LONG, "en", "c", len(LONG)),
    (7, "x #", "en", "c", 1),
    (8, "THE SAME WORDS in two ROWS of this table", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + ("w", 1, 2, "p", 3, "d", 4, "c", 5, 6) for r in ODD], SCHEMA + CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def components_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


# --- SimHash ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[i : i + size]), seed=42).intdigest() for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_links(values, most):
    values = np.array(values, dtype=np.uint64)
    return [(k, j) for k in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= most).tolist()]


@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_simhash_against_all_pairs(which, request):
    table = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    group = components_of(len(rows), plain_links(fps, 4))
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    truth = Counter((i, f"{fp:016x}", least[g]) for (i, _), fp, g in zip(rows, fps, group))
    got = simhash.near_duplicates(table, 4, 4)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and Counter(map(tuple, got.collect())) == truth


def clouds(seed, centres, members, flips):
    """Distinct values around centres, so that chains of links and near misses are frequent."""
    draw = np.random.Generator(np.random.PCG64(seed))
    out = set()
    for c in draw.integers(0, 1 << 63, centres).tolist():
        for _ in range(members):
            bits = draw.choice(64, int(draw.integers(0, flips + 1)), replace=False)
            out.add(c ^ sum(1 << int(b) for b in bits))
    return sorted(out)


@pytest.mark.parametrize(("values", "most", "block"), [
    (clouds(1, 30, 12, 9), 4, 4096), (clouds(2, 2, 400, 6), 4, 50), (clouds(3, 40, 8, 8), 3, 5), ([0, 15, 31, (1 << 64) - 1, (1 << 64) - 32, 1 << 63], 4, 2),
])
def test_pigeonring_loses_no_link(spark, monkeypatch, values, most, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {r.node: r.component for r in simhash.linked_components(spark.createDataFrame([(v,) for v in signed], "fp bigint"), most).collect()}
    group = components_of(len(values), plain_links(values, most))
    same = {(a, b) for a, b in combinations(range(len(values)), 2) if group[a] == group[b]}
    name = [found.get(v, v) for v in signed]
    assert {(a, b) for a, b in combinations(range(len(values)), 2) if name[a] == name[b]} == same


def test_every_near_pair_has_a_viable_chain():
    draw = np.random.Generator(np.random.PCG64(5))
    for most in (2, 3, 4, 6):
        segments = simhash.ring(most)
        assert sum(b for _, b in segments) == 64
        for _ in range(300):
            x = sum(1 << int(b) for b in draw.choice(64, int(draw.integers(0, most + 1)), replace=False))
            counts = [(x >> first & ((1 << bits) - 1)).bit_count() for first, bits in segments]
            n = len(counts)
            assert any(all(sum(counts[(s + k) % n] for k in range(m)) <= m - 1 for m in range(1, n + 1)) for s in range(n))


def test_links_of_a_crowd_stay_a_forest(spark):
    """A crowd of near values gives rows in proportion to its members, not to its pairs."""
    values = clouds(7, 1, 1500, 4)
    pairs = len(plain_links(values, 4))
    masks = simhash.chain_masks(4)
    assert masks.shape == (5, 3) and pairs > 100_000
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    out = simhash.linked_components(frame, 4)
    assert out.count() == len(values) and out.select("component").distinct().count() == 1


def test_leaders_are_not_broadcast(spark, tmp_path):
    """A table below Spark's limit has keys and leaders far above it: Spark sizes them as the table before the explode."""
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/values")
    plan = simhash.led(spark.read.parquet(f"{tmp_path}/values"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# --- spelling ---------------------------------------------------------------------------------------------------------------


def plain_distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, rate=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % rate else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    # words with equal rest after one deletion, and words that are another's rest, hold all pairs
    rests = {}
    for w in words:
        for k in range(len(w)):
            rests.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: set() for w in words}
    for rest, group in rests.items():
        for a in group | ({rest} & words.keys()):
            near[a] |= {b for b in group | ({rest} & words.keys()) if a != b and plain_distance_one(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_variants_against_brute_force(which, request):
    table = request.getfixturevalue(which)
    got = spelling.variants(table)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == plain_variants([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]) and len(rows) == len(set(rows))


def test_variants_with_many_misspellings(spark):
    """A high rate of lost letters, ties of counts, chains of forms and repeated bigrams."""
    draw = np.random.Generator(np.random.PCG64(11))
    stems = ["banana", "bananana", "ananas", "mississippi", "aaaaa", "aaaaaa", "aaaaaaa", "éééàà", "straßen", "organise", "organize", "ababab", "abababab"]
    rows = [(k, " ".join(draw.choice(stems, 40).tolist())) for k in range(300)]
    rows += [(1000 + k, "organizer " * 3 + "organisex organisey " * 3) for k in range(2)] + [(None, "Banana banANA BANANA")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in spelling.variants(frame, rate=3).collect()} == plain_variants(rows, rate=3)


def test_pivotal_pairs_against_all_pairs(spark):
    draw = np.random.Generator(np.random.PCG64(4))
    words = sorted({"".join(draw.choice(list("abc" if k % 2 else "abcdeé"), int(draw.integers(4, 9))).tolist()) for k in range(900)})
    got = {(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a, b in combinations(words, 2) if plain_distance_one(a, b)} and len(got) > 500


def test_pivots_are_the_least_disjoint_pair():
    draw = np.random.Generator(np.random.PCG64(9))
    for _ in range(500):
        ranks = draw.integers(0, 6, int(draw.integers(3, 10))).tolist()
        places, last = spelling.prefix(ranks)
        a, b = spelling.pivots(places, ranks)
        pairs = [(x, y) for x, y in combinations(places, 2) if y - x >= 2]
        assert (a, b) in pairs and ranks[a] + ranks[b] == min(ranks[x] + ranks[y] for x, y in pairs)
        assert len(places) >= 3 and last == sorted(ranks)[2]


# --- filter audit -----------------------------------------------------------------------------------------------------------


def plain_audit(rows, marks):
    """Every order applied to the documents one after the other; the Shapley value from its definition."""
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text],
        }
        docs.append((lang or "", i, fails))
    out = set()
    for part in {p for p, _, _ in docs}:
        steps = {}
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in docs if p == part]
            for step, x in enumerate(order, start=1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                failing = [f for p, _, f in docs if p == part and f[x]]
                steps["".join(order), step] = (
                    len(left), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for f in failing),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
        total = Counter()
        for (order, step), s in steps.items():
            total[order[step - 1]] += s[1]
        out |= {(part, order, step, *s, total[order[step - 1]]) for (order, step), s in steps.items()}
    return out


@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_audit_against_applying_the_filters(spark, labels, which, request):
    table = request.getfixturevalue(which)
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    if which == "odd":
        marks = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, 1), (99, 1, 1)]
        labels = spark.createDataFrame([m + ("x", 1) for m in marks], "doc_id bigint, quality int, toxic int, part string, n int")
    got = filter_audit.audit(table, labels).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in table.select("doc_id", "text", "lang").collect()]
    truth = plain_audit(rows, marks)
    assert {tuple(r) for r in got} == truth and len(got) == len(truth) == 600 * len({r[2] or "" for r in rows})


def test_least_squares_gives_the_shapley_weights():
    from math import factorial

    for n in (2, 3, 5):
        weights = filter_audit.attribution_weights(n)
        for i in range(n):
            for s in range(1 << n):
                size = s.bit_count()
                with_i = bool(s >> i & 1)
                expected = factorial(size - 1) * factorial(n - size) if with_i else -factorial(size) * factorial(n - size - 1)
                assert weights[i][s] == expected
