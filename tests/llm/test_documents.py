"""Operators on documents: edge cases that all must take, and each against a brute-force version."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from panelweave.llm import exact_dedup, hyperminhash, mixing, packing, sketches, surrogates, token_lengths, weak_quality
from panelweave.llm import queries as llm_queries
from panelweave.llm.tokens import chunk_ids, default_tokenizer
from tools import check_queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ", kept boolean, size bigint, component_id string, digest string, rate double, row bigint, salt int, rank int"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, "the same words in two rows of this table", "en", "a", 1),
    (1, "the same words in two rows of this table", "en", "a", 1),
    (2, "the same words in two rows of this table", None, None, None),
    (3, None, "en", "b", 0),
    (4, "", "en", None, 0),
    (None, "a row without an id but with some words in it", "de", "a", 3),
    (5, " \t\n ", "en", "", 3),
    (6, LONG, "en", "c", len(LONG)),
    (7, "x", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + (True, 1, "q", "d", 0.5, 9, 1, 1) for r in ODD], SCHEMA + CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def classifier(df):
    return weak_quality.scored(df, weak_quality.fit(df))


PER_ROW = {
    "surrogates": lambda d: surrogates.pseudonymised(d, "k"),
    "near": lambda d: hyperminhash.near_duplicates(d, 4, 80),
    "mix": mixing.mixed_sizes,
    "quality": classifier,
    "exact": exact_dedup.exact_duplicates,
}
WHOLE = {"mixed": mixing.mixed_documents, "distinct": exact_dedup.distinct_documents, "without near": hyperminhash.without_near_duplicates}


@pytest.mark.parametrize("name", PER_ROW)
def test_odd_rows_are_all_there(odd, empty, name):
    assert PER_ROW[name](empty).collect() == []
    rows = PER_ROW[name](odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)


@pytest.mark.parametrize("name", WHOLE)
def test_stages_keep_the_columns(odd, empty, name):
    assert WHOLE[name](empty).collect() == []
    out = WHOLE[name](odd)
    assert out.columns == odd.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in odd.collect()}


def test_quality_learns_from_rows_without_ids(spark, docs):
    """The sample is drawn by the text too: null or equal ids neither take all rows nor none."""
    model = weak_quality.fit(docs.withColumn("doc_id", F.lit(None).cast("bigint")), train_rows=60)
    assert np.any(model.weights != 0)
    kept = weak_quality.sound_documents(docs.withColumn("doc_id", F.lit(7).cast("bigint")), model).count()
    assert 0.3 * docs.count() < kept <= docs.count()


# --- exact duplicates -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.length(c) % 3], ids=["md5", "colliding"])
@pytest.mark.parametrize("side", ["smallest", "largest"])
def test_exact_duplicates_against_dictionary(odd, docs, digest, side):
    for table in (odd, docs):
        source = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        groups = defaultdict(list)
        for doc_id, text in source:
            groups[text].append(doc_id)
        pick = min if side == "smallest" else max
        best = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
        got = exact_dedup.exact_duplicates(table, side, digest).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, best[t], len(groups[t])) for i, t in source)
        assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.distinct_documents(docs, digest).collect()
    assert Counter(r.text for r in kept) == Counter({r.text for r in docs.collect()})


def test_one_row_of_a_group_is_kept_however_the_rows_arrive(spark, docs, odd, monkeypatch):
    """Repartitioned, joined, stacked and reordered input, with many equal rows: exactly one kept row per distinct text."""
    many = spark.range(10_000).select((F.col("id") % 3).alias("doc_id"), F.lit("one text").alias("text"))
    slim = docs.select("doc_id", "text")
    shapes = {
        "repartitioned": slim.repartition(7), "by a column": slim.repartition(5, "text"), "stacked": slim.unionByName(slim).unionByName(odd.select("doc_id", "text")),
        "joined": slim.join(docs.select("doc_id", "lang"), "doc_id"), "sorted": slim.orderBy(F.rand(3)), "many": many.repartition(9),
    }
    monkeypatch.setattr(exact_dedup, "COPIES_AT_ONCE", 7)
    for name, table in shapes.items():
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        for side in ("smallest", "largest"):
            got = exact_dedup.exact_duplicates(table, side).collect()
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows), name
            kept = Counter(r.text_sha256 for r in got if r.kept)
            assert set(kept.values()) == {1} and len(kept) == len({r[1] or "" for r in rows}), name
    plan = exact_dedup.exact_duplicates(slim)._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically" not in plan and "Window" not in plan


# --- near duplicates ------------------------------------------------------------------------------------------------------


def brute_components(rows, shingle, percent):
    """Sets of word tuples in plain Python, every pair compared."""
    sets = []
    for doc_id, text in rows:
        if doc_id is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((doc_id, {tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), len(s)) for i, s in sets}


def family(seed, n, words, changed):
    """Copies of one text with some words replaced, so that many similarities lie near the threshold."""
    draw = np.random.Generator(np.random.PCG64(seed))
    base = [f"w{x}" for x in draw.integers(0, 10_000, words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in draw.integers(0, words, int(draw.integers(0, changed + 1))):
            text[at] = f"n{draw.integers(0, 10_000)}"
        out.append(" ".join(text))
    return out


def test_near_duplicates_against_all_pairs(spark, docs, odd, monkeypatch):
    texts = [t for k in range(6) for t in family(k, 25, 60 + 40 * k, 2 + k)]
    texts += ["one two", "One Two", "one", "two one", "a b c d", "a b c d e", "a b c d e f"]
    planted = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for blocks, turns in ((512, 2), (7, 0), (3, 1)):  # the others make many cells of a bucket
        monkeypatch.setattr(hyperminhash, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(hyperminhash, "TURNS", turns)
        for table in (planted, docs, odd) if blocks == 512 else (planted,):
            truth = brute_components([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], 4, 80)
            got = hyperminhash.near_duplicates(table, 4, 80).filter("doc_id IS NOT NULL").collect()
            assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == truth
            assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(i != c for i, (c, _) in truth.items()) > 10


def test_sketch_estimate_is_close():
    words, draw = sketches.WordHashes(), np.random.Generator(np.random.PCG64(3))
    for share in (0.5, 0.8, 0.95):
        common = [f"c{i}" for i in range(int(2000 * share))]
        a, b = (" ".join(common) for _ in "ab")
        a, b = (t.encode() + b" " + " ".join(f"{s}{i}" for i in range(2000 - len(common))).encode() for t, s in ((a, "a"), (b, "b")))
        sets = [sketches.shingle_set(t, 1, words) for t in (a, b)]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        found = sketches.estimate(*map(sketches.registers, sets), *map(len, sets))
        assert abs(found - true) < 0.13 and (sketches.filled(sketches.registers(sets[0])) != sketches.EMPTY).all()


# --- surrogates -----------------------------------------------------------------------------------------------------------


def test_surrogates_keep_identity_format_and_clean_texts(spark):
    texts = [
        "Write to Anna.Meier@web.de or ANNA.MEIER@WEB.DE now; call +1 (017) 555-7713 or +1 017 555 7713.",
        "Mr. John Smith met Mrs. Smith. Card 4417 7442 8035 1547 = 4417744280351547, from 144.137.247.239",
        'token = "83d8ceb44e15e09fd311c3cf3163b66d5a9875b8" and 83D8CEB44E15E09FD311C3CF3163B66D5A9875B8',
        "Госпожа Светлана Иванова ждёт. Version 2.0. Page 12 of 300, 1999",
        "nothing personal | at all, version 4.0.",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in surrogates.pseudonymised(frame, "k").collect()}
    assert out[4].text == texts[4] and out[4].n_entities == 0
    whole = " ".join(r.text for r in out.values())
    for secret in ("Anna", "ANNA", "web.de", "7713", "John", "Smith", "4417", "1547", "144.137", "83d8", "83D8", "Светлана", "Иванова"):
        assert secret not in whole, secret
    mails = re.findall(r"\S+@[\w.]+\w", out[0].text)
    assert mails[0] == mails[1].lower() and mails[1] == mails[1].upper() and len(mails[0].split("@")[0]) == len("anna.meier")
    phones = re.findall(r"\+1 [()\d -]+\d", out[0].text)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0]) and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    card = re.search(r"Card ([\d ]+) = (\d+)", out[1].text)
    digits = [int(c) for c in card[2]]
    assert card[1].replace(" ", "") == card[2] and digits[0] == 4
    assert sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    first, second = re.search(r"Mr\. (\w+) (\w+) met Mrs\. (\w+)\.", out[1].text).group(1, 2), re.search(r"Mrs\. (\w+)", out[1].text)[1]
    assert first[1] == second and first[0].endswith("us")
    assert re.search(r"Госпожа [А-Я][а-я]+ия [А-Я][а-я]+енко ждёт. Version 2.0. Page 12 of 300, 1999", out[3].text)
    again = {r.doc_id: r.text for r in surrogates.pseudonymised(frame, "k").collect()}
    assert again == {k: r.text for k, r in out.items()}
    assert {r.doc_id: r.text for r in surrogates.pseudonymised(frame, "other").collect()}[0] != out[0].text


def test_names_have_a_large_space(spark):
    for script in ("latin", "cyrillic", "greek"):
        made = surrogates.syllables(script)
        assert len(made) == len(set(made)) == 1024 and surrogates.SYLLABLE_COUNT == 4
    plain = surrogates.syllables("latin")
    pairs = [a + b for a in plain[::7] for b in plain]  # whole pairs read back in one way
    assert len(pairs) == len(set(pairs))
    forms = spark.range(20_000).select(surrogates.fake(F.lit("surname"), F.concat(F.lit("name"), "id"), F.lit(0), "k").alias("form"))
    assert forms.distinct().count() == 20_000


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_surrogates_stay_distinct_when_the_first_forms_collide(spark, monkeypatch, bits):
    """One syllable makes 1024 names, so many of 1296 collide and move; the filter of 64 bits lists nearly every document."""
    monkeypatch.setattr(surrogates, "SYLLABLE_COUNT", 1)
    monkeypatch.setattr(surrogates, "FILTER_BITS", bits)
    names = [f"{a}{b}{c}{d}" for a in ("Xa", "Xe", "Xo", "Zu") for b in "abcdefghijkl" for c in "mnopqrstu" for d in ("kal", "tor", "min")]
    texts = [(k, f"Mr. {n} spoke. Mr. {n} left.") for k, n in enumerate(names)]
    texts += [(None, f"Mr. {names[0]} spoke. Mr. {names[700]} left."), (-5, "clean"), (7, None), (9, f"Mr. {names[9]} spoke.")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = surrogates.pseudonymised(frame, "k").collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in texts)
    said = {r.doc_id: re.findall(r"Mr\. (\w+)", r.text or "") for r in rows if r.doc_id is None or len(re.findall(r"Mr\. (\w+)", r.text or "")) == 2}
    single = [said[k] for k in range(len(names))]
    assert all(a == b for a, b in single) and len({a for a, _ in single}) == len(names)
    assert said[None] == [said[0][0], said[700][0]]
    assert {r.text for r in rows if r.doc_id == 9} == {f"Mr. {said[9][0]} spoke. Mr. {said[9][0]} left.", f"Mr. {said[9][0]} spoke."}
    first = frame.select(F.lower(F.regexp_extract("text", r"Mr\. (\w+)", 1)).alias("canon")).select(F.lit("surname").alias("kind"), "canon").distinct()
    assert surrogates.attempts(first, "k").count() > 100  # many did collide


def test_texts_are_not_shuffled_when_entities_move(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLE_COUNT", 1)
    names = ["Dr Xa" + "abcdefghijklmnopqrstuvwxyz"[k % 26] + "abcdefghijklmnopqrstuvwxyz"[k // 26] + "or" for k in range(400)]
    frame = spark.createDataFrame([(k, f"So {n} said.") for k, n in enumerate(names)], "doc_id bigint, text string")
    out = surrogates.pseudonymised(frame, "k")
    assert len({r.text for r in out.collect()}) == 400
    exchanges = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"Exchange (hash|range|round|single)", line, re.I)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert exchanges and not [line for line in exchanges if re.search(r"\b(doc_id|_id|text)#", line)]


def test_one_person_is_the_same_one_under_every_title(spark):
    texts = ["Mr Oliver Brown came.", "Dr Oliver Brown left.", "Mr Kim Lee", "Mrs Kim Lee", "Dr Kim Lee", "Prof. Frauke Brown", "Frau Frauke Brown"]
    rows = surrogates.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "k").collect()
    said = {r.doc_id: re.search(r"(?:Mr|Dr|Mrs|Prof\.|Frau) (\w+) (\w+)", r.text).groups() for r in rows}
    assert said[0] == said[1] and said[0][0].endswith("us") and said[5] == said[6] and said[5][0].endswith("ia") and said[5][1] == said[0][1]
    assert said[2][0].endswith("us") and said[3][0].endswith("ia") and said[4][0].endswith("en") and len({said[k][1] for k in (2, 3, 4)}) == 1


def test_phones_keep_the_whole_country_code(spark):
    numbers = ["+49 30 1234567", "+1 (017) 555-7713", "+7 495 123 4567", "+380 44 123 4567", "+33 12 345 6789", "+4930 123 4567"]
    frame = spark.createDataFrame([(k, f"call {n} now") for k, n in enumerate(numbers)], "doc_id bigint, text string")
    for r in surrogates.pseudonymised(frame, "k").collect():
        code = ["+49", "+1", "+7", "+380", "+33", "+49"][r.doc_id]
        made = re.fullmatch(r"call (.+) now", r.text)[1]
        assert made.startswith(code) and made != numbers[r.doc_id] and re.sub(r"\d", "0", made) == re.sub(r"\d", "0", numbers[r.doc_id])


def test_titled_names_with_any_capital_are_replaced_whole(spark):
    names = ["Herr Özil", "Mme Élodie Petit", "Señora Álvarez", "Господин Ёлкин", "Mr O'Brien", "Mr McDonald", "Frau Müller-Lüdenscheidt", "Dr Ωνάσης", "Mr Jean-Luc O’Neill"]
    frame = spark.createDataFrame([(k, f"So {n}'s dog, {n}.") for k, n in enumerate(names)], "doc_id bigint, text string")
    for r in surrogates.pseudonymised(frame, "k").collect():
        title, *words = names[r.doc_id].split(" ")
        shape = " ".join([title, *[r"(\w+)"] * len(words)])
        found = re.fullmatch(rf"So {shape}'s dog, {shape}\.", r.text)
        assert found and found.groups()[: len(words)] == found.groups()[len(words) :] and not set(words) & set(found.groups()), r.text
        assert re.search("[Α-ω]", found[1]) if "Ω" in words[0] else re.search("[А-я]", found[1]) if "Ё" in words[0] else found[1].isascii()


def test_secrets_without_digits_and_of_any_length_are_replaced_whole(spark):
    hidden = ["sk-" + "aBcDeFgHiJkLmNoPqRsT", "ghp_" + "qWeRtY" * 6, "AKIA" + "QWERTYUIOPASDFGH", "sk-" + "x9Y" * 40, "0a1b2c3d" * 40, "ABCDEF" * 6, "abcdef" * 30, "gho_" + "Zz9" * 20]
    frame = spark.createDataFrame([(k, f"the key is {x}.") for k, x in enumerate(hidden)], "doc_id bigint, text string")
    for r in surrogates.pseudonymised(frame, "k").collect():
        made = re.fullmatch(r"the key is (\S+)\.", r.text)[1]
        assert r.kinds == ["secret"] and made != hidden[r.doc_id] and hidden[r.doc_id][4:24] not in made and len(made) == len(hidden[r.doc_id])
        assert made[:3] == hidden[r.doc_id][:3] or re.fullmatch("[0-9a-f]+|[0-9A-F]+", made)


def test_names_keep_the_titles_gender_and_are_found_again_alone(spark):
    texts = [
        "SMITH! Smith said that John Smith left. John's car is Smith's; Smithson and Johnny stay. MR John.",
        "Frau Anna Schmidt and Mr Oliver Brown. Anna met Brown. Frau Schmidt Herr Braun",
        "Prof. Dr. Anna Weber came. Frau Dr. Anna Weber left. Dr Kim Lee",
        "Smith and Anna stay in another text with Smith.",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in surrogates.pseudonymised(frame, "k").collect()}
    a = re.fullmatch(r"(\w+)! (\w+) said that (\w+us) (\w+son) left\. (\w+)'s car is (\w+)'s; Smithson and Johnny stay\. MR (\w+)\.", out[0].text).groups()
    assert a == (a[3].upper(), a[3], a[2], a[3], a[2], a[3], a[2]) and not {"John", "Smith"} & set(a) and out[0].n_entities == 6
    b = re.fullmatch(r"Frau (\w+ia) (\w+son) and Mr (\w+us) (\w+son)\. (\w+) met (\w+)\. Frau (\w+) Herr (\w+son)", out[1].text).groups()
    assert (b[4], b[5], b[6]) == (b[0], b[3], b[1]) and not set(b) & set(texts[1].split())
    c = re.fullmatch(r"Prof\. Dr\. (\w+ia) (\w+son) came\. Frau Dr\. (\w+) (\w+) left\. Dr (\w+en) (\w+son)", out[2].text).groups()
    assert c[:2] == c[2:4] and c[0] == b[0] and not set(c) & set(texts[2].split())
    assert out[3].text == texts[3] and out[3].kinds == []


# --- token lengths and packing --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoded(docs):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    return {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}


def test_chunked_ids_equal_the_tokenizers():
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = ["it's DON'T ''s <|endoftext|>x", "é́ İΣς\x1cq\x0bz ²½ª× a b", "", "  ", None, "🙂🙂 a_b__c 1234", "ǅ ﬁ"]
    found = [x.tolist() for x in chunk_ids(default_tokenizer()).texts(pa.array(texts))]
    assert found == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_length_histogram_against_counting(docs, odd, empty, encoded):
    assert token_lengths.length_histogram(empty, default_tokenizer()).collect() == []
    assert token_lengths.length_histogram(odd, default_tokenizer()).filter("length = 0").first().n_docs == 3
    lengths = [len(x) for x in encoded.values()]
    hist = token_lengths.length_histogram(docs, default_tokenizer())
    for r in hist.collect():
        assert (r.n_docs, r.docs_up_to) == (lengths.count(r.length), sum(x <= r.length for x in lengths))
        assert r.tokens_over == sum(x for x in lengths if x > r.length) and r.docs_over == sum(x > r.length for x in lengths)
        assert r.tokens_truncated == sum(min(x, r.length) for x in lengths) and r.total_tokens == sum(lengths)
    limits = [1, 128, 1000, 10**6]
    for r in token_lengths.answers(hist, limits).collect():
        assert r.tokens_truncated == sum(min(x, r.context_limit) for x in lengths)


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= capacity.tokens and len(items) <= capacity.documents and sum(n * n for _, n in items) <= capacity.attention
    return len(by)


@pytest.mark.parametrize(
    "capacity",
    [packing.Capacity(), packing.Capacity(select="dot"), packing.Capacity(tokens=2048, documents=5), packing.Capacity(tokens=1024, attention=300_000, select="dot")],
    ids=["norm", "dot", "few documents", "attention"],
)
def test_packing_round_trip_under_every_constraint(docs, encoded, capacity):
    rows = packing.packed(docs, default_tokenizer(), capacity, with_ids=True).collect()
    used = check_packing(rows, capacity)
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append((r.start, r.ids))
    back = {i: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for i, p in pieces.items()}
    assert back == {i: [*ids, 1] for i, ids in encoded.items()}
    total = sum(r.length for r in rows)
    if capacity.documents == capacity.tokens == 4096:
        assert used <= total / 4096 * 1.02 + 1


def test_packing_of_odd_rows(odd, empty):
    assert packing.packed(empty, default_tokenizer()).collect() == []
    rows = packing.packed(odd, default_tokenizer()).collect()
    check_packing(rows, packing.Capacity())
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in ODD)
    assert [r.length for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1] and max(r.piece for r in rows) > 5


# --- mixing ---------------------------------------------------------------------------------------------------------------


def water_levels(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in stopped}
        level = (total - sum(stopped.values())) / (sum(left.values()) or 1)
        new = {s: 2.0 * sizes[s] for s, w in left.items() if w * level > 2 * sizes[s]}
        if not new:
            return {s: stopped.get(s, weight[s] * level) for s in names}
        stopped |= new


def test_mixing_targets_and_copies(spark, docs, odd):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for table, tolerance in ((odd, None), (docs, None), (big, 0.2)):
        rows = mixing.mixed_sizes(table).collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += r.size
        target = water_levels(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
            assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if tolerance:
            taken = Counter()
            for r in rows:
                taken[r.source] += r.taken
            assert all(abs(taken[s] / target[s] - 1) < tolerance for s in target if target[s])
        assert sorted(map(repr, mixing.mixed_sizes(table).collect())) == sorted(map(repr, rows))
    counted = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert counted == Counter({r.doc_id: r.taken // r.size for r in mixing.mixed_sizes(docs).collect() if r.taken})


# --- quality --------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    model = weak_quality.fit(docs)  # sees no label
    got = {r.doc_id: r.kept for r in weak_quality.scored(docs, model).collect()}
    clean = [got[i] for i, q in labels.items() if q == 1]
    junk = [not got[i] for i, q in labels.items() if q == 0]
    assert np.mean(clean) >= 0.99 and np.mean(junk) >= 0.9
    assert (model.labels.accuracy() > 0.7).all()
    assert sorted(r.doc_id for r in weak_quality.sound_documents(docs, model).collect()) == sorted(i for i, k in got.items() if k)


def test_label_model_recovers_accuracies():
    draw = np.random.Generator(np.random.PCG64(1))
    truth = draw.random(40_000) < 0.2
    right = [0.95, 0.85, 0.9, 0.7]
    votes = np.stack([np.where(draw.random(len(truth)) < p, truth, ~truth).astype(int) for p in right], axis=1)
    votes[draw.random(votes.shape) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.2) < 0.03 and np.abs(model.accuracy() - right).max() < 0.05


# --- the pipeline and the registered queries ------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    table, columns = docs, docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == columns
        table = spark.createDataFrame(table.collect(), docs.schema)
        sizes.append((name, table.count()))
        if name == "exact_dedup":
            assert table.select("text").distinct().count() == table.count()
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in table.collect()]
            assert all(i == c for i, (c, _) in brute_components(rows, 5, 80).items())
    assert sizes[0][1] < docs.count() and sizes[1][1] < sizes[0][1] and sizes[2][1] < sizes[1][1]
    rows = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    check_packing(rows, packing.Capacity())
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in table.collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r.doc_id for r in rows)


@pytest.mark.parametrize("name", llm_queries.ORACLE)
def test_query_equals_its_twin(spark, name):
    connection = duckdb.connect()
    for t in check_queries.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = connection.execute(entry.oracle_sql()[name])
    sides = check_queries.ordered(df.columns, [tuple(r) for r in df.collect()]), check_queries.ordered([d[0] for d in cursor.description], cursor.fetchall())
    assert sides[0][0] == sides[1][0] and len(sides[0][1]) == len(sides[1][1]) > 0
    assert all(check_queries.near(x, y) for a, b in zip(sides[0][1], sides[1][1]) for x, y in zip(a, b))


def test_large_groups_have_few_leaders(spark):
    """Two hundred classes that meet in each of 42 buckets are compared with a few leaders, not with one for every bucket."""
    keys = [(i * 0x9E3779B97F4A7C15) % 2**62 - 2**61 for i in range(42)]
    bands = spark.createDataFrame([(k, i) for k in keys for i in range(200)], "key bigint, id bigint")
    led = hyperminhash._led(bands)
    assert led.count() == 42 * 200 and led.agg(F.min("m"), F.max("m")).first() == (200, 200)
    assert led.groupBy("key").agg(F.count_distinct("leader").alias("n")).filter("n <> 1").isEmpty()
    assert led.select("id", "leader").distinct().count() <= hyperminhash.ORDERS * 200
    lone = spark.createDataFrame([(1, 5)], "key bigint, id bigint")
    assert hyperminhash._led(lone).isEmpty()
