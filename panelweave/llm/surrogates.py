"""Personal data replaced by keyed, type-consistent surrogates. DataFrame functions only.

Every detected entity has a canonical form (an address in lower case, the digits of a number). Its surrogate is made from a
keyed hash of type and canonical form, so the same entity gets the same one in every document and in every spelling, and is
written in the format, case and script of the mention. Distinct entities keep distinct surrogates: see ``attempts``.
A given name borne by men and women is two entities, one of each gender.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

# Titles and given names by which a person's name is recognised, and its gender.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа"]
TITLES_F, TITLES_M = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"], ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
MALE = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Hans", "Jürgen", "Pierre", "François", "Carlos", "José", "Иван", "Сергей", "Дмитрий", "Владимир"]
FEMALE = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Ursula", "Monika", "Isabelle", "Sylvie", "Carmen", "María", "Ольга", "Наталья", "Екатерина", "Светлана"]
# Invented names have four syllables: one of 32 onsets, one of 4 vowels and one of 8 codas each, so 2^40 names of a kind and
# script. No coda and onset together read as another coda and onset, so different choices are different names.
ONSETS, VOWELS, CODAS = "b c d f g h j k l m n p r s t v w z br dr fr gr bl fl gl pl pr vr vl cl cr ch".split(), "a e i o".split(), ["", *"n r l s m t k".split()]
SYLLABLE_COUNT = 4
SCRIPTS = {  # the same letters in other scripts
    "cyrillic": dict(zip("b c d f g h j k l m n p r s t v w z a e i o ch".split(), "б ц д ф г х ж к л м н п р с т в ш з а е и о ч".split())),
    "greek": dict(zip("b c d f g h j k l m n p r s t v w z a e i o ch".split(), "β ξ δ φ γ χ ζ κ λ μ ν π ρ σ τ θ ψ η α ε ι ο χτ".split())),
}


def syllables(script: str) -> list[str]:
    """All 1024 syllables of a script; in the Greek one the letter eta stands for a consonant, so that syllables stay distinct."""
    plain = [(o, v, c) for o in ONSETS for v in VOWELS for c in CODAS]
    if script == "latin":
        return ["".join(p) for p in plain]
    letters = SCRIPTS[script]
    spell = lambda part: letters.get(part) or "".join(letters[x] for x in part)
    return ["".join(map(spell, p)) for p in plain]


ENDS = {"latin": {"given_f": "ia", "given_m": "us", "given": "en", "surname": "son"}, "cyrillic": {"given_f": "ия", "given_m": "ан", "given": "ли", "surname": "енко"}, "greek": {"given_f": "ία", "given_m": "ος", "given": "ιν", "surname": "ίδης"}}

_GIVEN = "|".join(MALE + FEMALE)
_TITLE = "|".join(TITLES)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+)(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
# Country codes are 1, 7, these two-digit ones, and else three digits long.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{13,19})(?!\d)"
_CAPITAL = r"(?=\p{Lu})"  # looked at first: most places fail here at once
# two letters at least and no title; an apostrophe or hyphen goes on with a capital, so that a genitive's s stays outside
_WORD = rf"(?!(?:{_TITLE})\.? \p{{Lu}})(?:\p{{Lu}}[\p{{L}}\p{{M}}]+|\p{{Lu}}(?=['’-]\p{{Lu}}))(?:['’-]\p{{Lu}}[\p{{L}}\p{{M}}]+)*+"
TITLED = rf"(?:(?:{_TITLE})\.? )++"
NAME = rf"{_CAPITAL}(?<!\p{{L}})(?:{TITLED}{_WORD}(?: {_WORD})?|(?:{_GIVEN}) {_WORD})"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "ip": IP, "phone": PHONE, "ssn": SSN, "card": CARD, "name": NAME}
ENTITY = "|".join(KINDS.values())
# without any of these a text holds no entity, and the long pattern is not tried on it
GATE = rf"[0-9@]|(?<![0-9A-Za-z])(?:sk-|gh[pousr]_|AKIA|[a-f]{{32}}|[A-F]{{32}})|{_CAPITAL}(?:{_TITLE}|{_GIVEN})\.? \p{{Lu}}"
PART = "array<struct<kind:string,canon:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas know no common subexpressions."""
    return F.transform(F.array(value), use)[0]


def mentions(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_who`` (the words of the persons' names), ``_pattern`` and ``_found`` (the entities as written, in order).

    Names are read first; a text that has some is read again for their words standing alone, before or after the full name.
    """
    none = F.array().cast("array<string>")
    docs = docs.withColumn("_full", F.coalesce(F.when(F.col("text").rlike(GATE), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))), none))
    docs = docs.withColumn("_who", F.array_distinct(F.flatten(F.transform(F.filter("_full", lambda m: kind_of(m) == "name"), _words))))
    written_so = F.transform("_who", lambda w: w["word"])
    shapes = F.sort_array(F.array_distinct(F.concat(written_so, F.transform(written_so, F.upper))), asc=False)  # a longer name before its own start
    alone = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(shapes, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    docs = docs.withColumn("_pattern", F.when(F.size("_who") > 0, alone).otherwise(ENTITY))
    return docs.withColumn("_found", F.when(F.size("_who") > 0, F.regexp_extract_all("text", F.col("_pattern"), F.lit(0))).otherwise(F.col("_full")))


def kind_of(mention: Column) -> Column:
    whole = lambda name: mention.rlike(f"^(?:{KINDS[name]})$")
    found = F.when(mention.contains("@"), "email")
    for name in ("secret", "ip", "ssn", "card", "phone", "iban"):
        found = found.when(whole(name), name)
    return found.otherwise("name")


def _untitled(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^{TITLED}", "")


def _words(mention: Column) -> Column:
    """``word``, ``kind``, ``canon`` of the words of a name; a given name has the gender of the lists, or else of the title."""
    titled = lambda titles: mention.rlike(rf"^(?:(?:{_TITLE})\.? )*?(?:{'|'.join(titles)})\.? ")

    def split_up(words: Column) -> Column:
        given = F.when(words[0].isin(FEMALE), "given_f").when(words[0].isin(MALE), "given_m")
        given = given.when(titled(TITLES_F), "given_f").when(titled(TITLES_M), "given_m").otherwise("given")
        name = lambda k, w: F.struct(w.alias("word"), k.alias("kind"), F.lower(w).alias("canon"))
        return F.when(F.size(words) > 1, F.array(name(given, words[0]), name(F.lit("surname"), words[1]))).otherwise(F.array(name(F.lit("surname"), words[0])))

    return _let(F.split(_untitled(mention), " "), split_up)


def parts_of(mention: Column, who: Column) -> Column:
    """The (kind, canonical form) pairs a mention is made of: one, or the words of a person's name; ``who`` are those of the text."""
    return _let(kind_of(mention), lambda kind: _parts(mention, kind, who))


def _parts(mention: Column, kind: Column, who: Column) -> Column:
    kinds = lambda canon: F.transform(F.filter(who, lambda w: w["canon"] == canon), lambda w: w["kind"])
    # the text may tell a gender at another mention of the name
    gender = lambda k, canon: F.when(k == "given", F.coalesce(F.array_min(F.filter(kinds(canon), lambda x: x.startswith("given_"))), k)).otherwise(k)
    part = lambda k, canon: F.struct(k.alias("kind"), canon.alias("canon"))
    alone = _let(F.lower(mention), lambda canon: part(gender(F.array_min(kinds(canon)), canon), canon))
    persons = F.when(mention.contains(" "), F.transform(_words(mention), lambda w: part(gender(w["kind"], w["canon"]), w["canon"]))).otherwise(F.array(alone))
    canon = F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(mention, "[^0-9+]", "")).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
    canon = canon.when(kind == "email", F.lower(mention)).otherwise(mention)
    return F.when(kind == "name", persons).otherwise(F.array(part(kind, canon))).cast(PART)


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits of a keyed hash."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("more"), seed), 256))


def _at(stream: Column, place: Column, base: int) -> Column:
    """A number below ``base`` from three digits of the stream; the stream is read in a ring."""
    start = F.pmod(place * 3, F.lit(126)) + 1
    return F.pmod(F.conv(F.substring(stream, start, F.lit(3)), 16, 10).cast("int"), F.lit(base))


def _same_class(text: Column, stream: Column, kept: Column) -> Column:
    """Every letter and digit after the first ``kept`` characters replaced by one of its own class."""
    pick = lambda letters, i: F.substring(F.lit(letters), _at(stream, i, len(letters)) + 1, F.lit(1))

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return (
            F.when(i <= kept, c)
            .when(c.rlike("[0-9]"), _at(stream, i, 10).cast("string"))
            .when(c.rlike(r"[\p{IsCyrillic}]"), pick("абвгдежзиклмнопрстуфхцчш", i))
            .when(c.rlike(r"[\p{IsGreek}]"), pick("αβγδεζηθικλμνξοπρστυφχψω", i))
            .when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
            .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", i))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled; a multiple of ten for a valid number."""
    n = F.length(digits)

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), weigh)


def fake(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of a surrogate: of the same kind, length and character classes, valid where the original was."""
    return _let(_stream(kind, canon, attempt, key), lambda stream: _fake(kind, canon, attempt, stream))


def _card(canon: Column, number: Column) -> Column:
    """The new number, with a valid check digit if the old one had one."""
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(_luhn(canon) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(number)


def _fake(kind: Column, canon: Column, attempt: Column, stream: Column) -> Column:
    country = F.length(F.regexp_extract(canon, COUNTRY, 0))
    octet = lambda i: (_at(stream, F.lit(i), 254) + 1).cast("string")
    ip = F.concat_ws(".", octet(1), octet(2), octet(3), octet(4))
    local = F.substring_index(canon, "@", 1)
    email = F.concat(_same_class(local, stream, F.lit(0)), F.lit("@mail"), F.substring(stream, F.lit(100), F.lit(8)), F.lit(".example.net"))
    digits = F.substring(F.repeat(stream, F.ceil(F.length(canon) / 128).cast("int")), F.lit(1), F.length(canon))  # in a ring
    secret = F.when(canon.rlike("^[0-9a-f]+$"), digits).when(canon.rlike("^[0-9A-F]+$"), F.upper(digits)).otherwise(_same_class(canon, stream, F.lit(4)))

    def invented(script: str) -> Column:
        table = F.split(F.lit(" ".join(syllables(script))), " ")
        syllable = lambda i: F.element_at(table, _at(stream, i, 1024) + 1)
        ends = ENDS[script]
        end = F.when(kind == "given_f", ends["given_f"]).when(kind == "given_m", ends["given_m"]).when(kind == "given", ends["given"]).otherwise(ends["surname"])
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), attempt + SYLLABLE_COUNT), syllable), ""), end)

    person = F.when(canon.rlike(r"\p{IsCyrillic}"), invented("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), invented("greek")).otherwise(invented("latin"))
    card = _let(_same_class(canon, stream, F.lit(1)), lambda number: _card(canon, number))
    out = F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", card)
    out = out.when(kind == "phone", _same_class(canon, stream, country)).when(kind == "ssn", _same_class(canon, stream, F.lit(0)))
    return out.when(kind == "iban", _same_class(canon, stream, F.lit(2))).otherwise(person)


def written(mention: Column, fakes: Column) -> Column:
    """A surrogate in the format of the mention: separators, case and number of words."""
    sign = lambda i: F.substring(mention, i, F.lit(1))
    before = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^0-9A-Za-z+]", ""))

    def by_kind(kind: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(mention))
        weave = F.array_join(F.transform(places, lambda i: F.when(sign(i).rlike("[0-9A-Za-z+]"), F.substring(fakes[0], before(i), F.lit(1))).otherwise(sign(i))), "")
        email = F.when(mention == F.upper(mention), F.upper(fakes[0])).otherwise(fakes[0])
        bare = _untitled(mention)
        words = F.array_join(F.transform(fakes, F.initcap), " ")
        name = F.concat(F.regexp_extract(mention, f"^{TITLED}", 0), F.when(bare == F.upper(bare), F.upper(words)).otherwise(words))
        return F.when(kind == "email", email).when(kind.isin("phone", "ssn", "card", "iban"), weave).when(kind == "name", name).otherwise(fakes[0])

    return _let(kind_of(mention), by_kind)


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``attempt`` of the entities whose first surrogate would not do.

    A surrogate is refused if a smaller entity of its kind has it too, or if it is an entity of the corpus itself; the entity
    then tries the next hash. Entities whose attempts may still change are few after the first round; each round is two
    aggregates keyed by kind and form, on the distinct entities.
    """
    state = keep(entities.select("kind", "canon", F.lit(0).alias("attempt")), "entities")
    while True:
        tried = state.withColumn("form", fake(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        # an entity already moved gives way to the others, so that a round never moves one that was settled
        rank = F.struct(F.col("attempt"), F.col("canon"))
        owners = tried.groupBy("kind", "form").agg(F.min(rank).alias("owner"), F.count(F.lit(1)).alias("n"))
        shared = owners.filter("n > 1").select("kind", "form", "owner")
        real = entities.select("kind", F.col("canon").alias("form"), F.lit(True).alias("real"))
        refused = tried.join(shared, ["kind", "form"], "left").join(real, ["kind", "form"], "left")
        refused = refused.filter((F.col("owner").isNotNull() & (F.col("owner") != rank)) | F.col("real"))
        again = keep(refused.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "refused")
        if again.isEmpty():
            return state.filter("attempt > 0")
        later = again.withColumnRenamed("attempt", "later")
        state = keep(state.join(later, ["kind", "canon"], "left").select("kind", "canon", F.coalesce("later", "attempt").alias("attempt")), "entities")


GIVEN = ["given_f", "given_m", "given"]
FILTER_BITS = 1 << 20  # of the filter that finds documents with a changed entity: 128 kB, whatever the input


def resolved(entities: DataFrame) -> DataFrame:
    """``canon``, ``becomes``: given names met without a gender that the corpus knows with exactly one."""
    known = entities.filter(F.col("kind").isin(GIVEN)).groupBy("canon").agg(F.collect_set("kind").alias("kinds"))
    one = known.filter(F.array_contains("kinds", "given") & (F.size("kinds") == 2))
    return one.select("canon", F.array_min(F.filter("kinds", lambda k: k != "given")).alias("becomes"))


def changes(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``becomes``, ``attempt`` of the entities that are not replaced by their own first surrogate."""
    gendered = keep(resolved(entities), "genders")
    named = entities.join(gendered.withColumn("kind", F.lit("given")), ["kind", "canon"], "left_anti")
    moved = attempts(named, key)
    to = gendered.join(moved.select(F.col("kind").alias("becomes"), "canon", "attempt"), ["becomes", "canon"], "left")
    to = to.select(F.lit("given").alias("kind"), "canon", "becomes", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return keep(moved.select("kind", "canon", F.col("kind").alias("becomes"), "attempt").unionByName(to), "changes")


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))


def _listed(ids: DataFrame) -> Column:
    """Words of a bit filter over ``doc_id``: FILTER_BITS / 64 numbers, combined in each task and put in order."""
    slot = _slot(F.col("doc_id"))
    words = ids.select(F.floor(slot / 64).cast("int").alias("at"), _bit(slot).alias("bit"))
    words = words.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = ids.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("at"))
    dense = every.join(words, "at", "left").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("all"))
    return dense.select(F.transform("all", lambda w: w["bits"])).scalar()


def _may_be_listed(listed: Column, doc_id: Column) -> Column:
    slot = _slot(doc_id)
    word = F.get(listed, F.floor(slot / 64).cast("int"))
    return word.bitwiseAND(_bit(slot)) != 0


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """Per row: ``doc_id``, ``text`` with every entity replaced, ``n_entities``, ``kinds`` (sorted distinct kinds).

    Kinds: email, phone, card, ssn, iban, ip, secret (keys and tokens) and person names (one or two capitalised words after
    titles, or one after a known given name; and each of these words standing alone in the same text, also in capitals). Card
    numbers keep their first digit and a valid check digit, phones the country code, given names their script and gender: of
    the known name, of a title before it, or of the one gender that the corpus gives the name elsewhere. So a person is the
    same one under every title. A text without entities is returned as it is; a null text stays null with 0 entities; rows
    that repeat get the same result; extra columns are ignored; an empty table gives no rows.

    The texts are searched once and written with what was found. Replacement is a projection of that table. Entities whose
    surrogate is not their own first one (a collision, or a gender found elsewhere) are few; a bit filter of fixed size, from
    the ids alone, marks the documents that hold one, and only what it marks is joined (by doc_id) with its list of changes.
    """
    body = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("text"))
    marked = keep(mentions(slim).drop("_full"), "mentions")
    parts = lambda m: parts_of(m, F.col("_who"))
    found = marked.filter(F.size("_found") > 0).select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform("_found", parts)))).alias("part"))
    found = keep(found.select("doc_id", "part.kind", "part.canon"), "parts")
    entities = keep(found.groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("n")), "distinct-entities")
    changed = changes(entities, key)
    if changed.isEmpty():
        return _replaced(marked.withColumn("_changes", F.lit(None).cast(CHANGES)), key)
    own = found.join(changed, ["kind", "canon"]).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))
    own = keep(own.agg(F.collect_set(F.struct("kind", "canon", "becomes", "attempt")).alias("_changes")), "changed-documents")
    known = F.coalesce("doc_id", F.lit(-1))
    marked = marked.withColumn("_listed", (F.size("_found") > 0) & _may_be_listed(_listed(own), known))
    others = marked.filter("NOT _listed").withColumn("_changes", F.lit(None).cast(CHANGES))
    few = marked.filter("_listed").join(own.withColumnRenamed("doc_id", "_id"), known == F.col("_id"), "left").drop("_id")
    return _replaced(others.unionByName(few), key)


CHANGES = "array<struct<kind:string,canon:string,becomes:string,attempt:int>>"


def _replaced(marked: DataFrame, key: str) -> DataFrame:
    """The texts with the surrogates of their mentions in place."""

    def surrogate_of(part: Column) -> Column:
        mine = F.get(F.filter("_changes", lambda c: (c["kind"] == part["kind"]) & (c["canon"] == part["canon"])), F.lit(0))
        return _let(mine, lambda c: fake(F.coalesce(c["becomes"], part["kind"]), part["canon"], F.coalesce(c["attempt"], F.lit(0)), key))

    fakes = lambda m: F.transform(parts_of(m, F.col("_who")), surrogate_of)
    surrogate = lambda m: _let(fakes(m), lambda made: written(m, made))
    pieces = F.split("text", F.col("_pattern"), -1)
    ends = F.concat(F.transform(F.col("_found"), surrogate), F.array(F.lit("")))
    text = F.when(F.size("_found") > 0, F.array_join(F.zip_with(pieces, ends, lambda a, b: F.concat(a, b)), "")).otherwise(F.col("text"))
    return marked.select("doc_id", text.alias("text"), F.size("_found").alias("n_entities"), F.array_sort(F.array_distinct(F.transform(F.col("_found"), kind_of))).alias("kinds"))
