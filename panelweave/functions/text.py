"""Text, date, number-format, JSON and array expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col, clip

# The characters counted as white space, below and above U+0100.
LOW_WHITE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x{85}\x{A0}"
HIGH_WHITE = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Low characters are one table lookup; the high ones are only looked at inside their range.
WHITE = rf"(?:[{LOW_WHITE}]|[\x{{1680}}-\x{{3000}}&&[{HIGH_WHITE}]])"


def strip(x: Column | str) -> Column:
    return F.regexp_replace(as_col(x).cast("string"), f"^{WHITE}+|{WHITE}+$", "")


def blank_to_null(x: Column) -> Column:
    """Blank and "nan" become NULL. ``x`` stands once in the expression, so it is computed once."""
    return F.get(F.filter(F.array(x), lambda v: (v != "") & (F.lower(v) != "nan")), F.lit(0))


def _only(x: Column) -> Column:
    return F.get(F.filter(F.array(x), lambda v: v != ""), F.lit(0))


def normalize_label(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "")


def normalize_code(x: Column | str) -> Column:
    """Text of a code; blank and "nan" are NULL."""
    return blank_to_null(strip(x))


def normalize_number_code(x: Column | str) -> Column:
    """Text of a numeric code, whole numbers without a trailing ".0"."""
    value = as_col(x)
    whole = value.try_cast("long")
    return F.when(value == whole, whole.cast("string")).otherwise(F.when(~F.isnan(value), value.cast("string")))


def make_key(x: Column | str) -> Column:
    return _only(F.regexp_replace(F.upper(normalize_code(x)), "[^A-Z0-9]+", ""))


def clean_text(x: Column | str) -> Column:
    # after the runs are one space each, only a space can stand at either end
    return blank_to_null(F.trim(F.regexp_replace(as_col(x).cast("string"), f"{WHITE}+", " ")))


def make_text_key(x: Column | str) -> Column:
    return _only(F.regexp_replace(F.upper(clean_text(x)), "[^A-Z0-9]+", ""))


def fixed(x: Column, digits: int) -> Column:
    """Fixed decimals; a missing number is NULL, not the text "null"."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def format_value(x: Column | str) -> Column:
    """Two decimals, then trailing zeros and a trailing point removed."""
    return F.regexp_replace(fixed(as_col(x).cast("double"), 2), r"\.?0+$", "")


def truthy_text(x: Column | str, yes: Sequence[str], no: Sequence[str], tokens: Sequence[str]) -> Column:
    """Cells of a number or boolean type are true above zero; text, of digits too, goes by the yes/no list, else by containing
    a token; missing is false."""
    label = normalize_label(x)
    number = F.when(F.typeof(as_col(x)) != "string", as_col(x).try_cast("double"))
    token_hit = reduce(lambda a, b: a | b, [label.contains(t) for t in tokens])
    verdict = F.when(number.isNotNull() & ~F.isnan(number), number > 0).when(label.isin(*yes), True).when(
        label.isin(*no), False
    )
    return F.coalesce(verdict, token_hit, F.lit(False))


def keyword_bucket(x: Column | str, buckets: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Name of the first list with a keyword inside the lower-cased text, else NULL."""
    text = F.lower(as_col(x))
    rules = [
        F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), F.lit(name)) for name, words in buckets
    ]
    return F.coalesce(*rules)


def prefix_family(x: Column | str, families: Sequence[tuple[str, str]], default: str = "other") -> Column:
    text = as_col(x)
    return F.coalesce(*[F.when(text.startswith(p), F.lit(name)) for p, name in families], F.lit(default))


def lag_bucket(x: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(as_col(x), r"_lag(\d)$", 1), F.lit("")), F.lit("current"))


def replace_literal(x: Column | str, old: str, new: str) -> Column:
    return F.replace(as_col(x), F.lit(old), F.lit(new))


def title_case_place(x: Column | str) -> Column:
    """First comma part in title case, the others trimmed and upper-cased, blanks dropped."""
    parts = F.split(strip(x), ",")
    rest = F.filter(
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.upper(F.trim(p))),
        lambda p: p != "",
    )
    return F.array_join(F.concat(F.array(title_case(F.get(parts, F.lit(0)))), rest), ", ")


def title_case(x: Column | str) -> Column:
    """Lower case, with a capital after a start, a space, a hyphen, a slash or an opening bracket."""
    return _capital_after(F.lower(as_col(x)))


def _capital_after(text: Column) -> Column:
    breaks = " -/(["
    chars = F.split(text, "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                (i == 0) | F.lit(breaks).contains(F.get(chars, i - 1)), F.upper(c)
            ).otherwise(c),
        ),
        "",
    )


def round_half(x: Column | str, digits: int) -> Column:
    """Rounded, with negative zero removed."""
    value = F.round(as_col(x).cast("double"), digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def signed(x: Column | str, digits: int, suffix: str = "") -> Column:
    value = round_half(x, digits)
    sign = F.when(value > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, fixed(value, digits), F.lit(suffix))


def percent(x: Column | str, digits: int = 1, suffix: str = "%") -> Column:
    return F.concat(fixed(round_half(as_col(x) * 100, digits), digits), F.lit(suffix))


def change_sentence(place: Column | str, year: Column | str, difference: Column | str, tolerance: float, noun: str) -> Column:
    """"<place> <year>: little change" or "raises/lowers <noun> by about x"."""
    diff = as_col(difference)
    lead = F.concat(as_col(place), F.lit(" "), as_col(year).cast("string"), F.lit(": "))
    size = fixed(round_half(F.abs(diff), 2), 2)
    moved = F.concat(
        F.when(diff > 0, F.lit("raises ")).otherwise(F.lit("lowers ")), F.lit(f"{noun} by about "), size, F.lit(".")
    )
    body = F.when(F.abs(diff) < tolerance, F.lit(f"little change in {noun}.")).otherwise(moved)
    return F.coalesce(F.concat(lead, body), F.lit("Summary unavailable for the current selection."))


def contains_ci(x: Column | str, needle: str) -> Column:
    return F.coalesce(F.lower(as_col(x)).contains(needle.lower()), F.lit(False))


def year_of_text(x: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Year of a text date; text that is not a date is NULL."""
    return F.year(F.to_date(F.try_to_timestamp(as_col(x), F.lit(fmt))))


# Month names by their three-letter short form.
MONTHS = {
    "Jan": "January", "Feb": "February", "Mar": "March", "Apr": "April", "May": "May", "Jun": "June",
    "Jul": "July", "Aug": "August", "Sep": "September", "Oct": "October", "Nov": "November", "Dec": "December",
}


def month_label(month: Column | str, year: Column | str) -> Column:
    short = as_col(month)
    full = F.coalesce(*[F.when(short == k, F.lit(v)) for k, v in MONTHS.items()])
    return F.concat(full, F.lit(" "), as_col(year).cast("string"))


def sparse_json(fields: Mapping[str, Column | str]) -> Column:
    """A JSON object of the fields that are present (``to_json`` leaves NULL out)."""
    return F.to_json(F.struct(*[as_col(c).alias(name) for name, c in fields.items()]))


def quality_json(fields: Mapping[str, Column | str], nested_name: str, nested: Mapping[str, Column | str]) -> Column:
    """As ``sparse_json``, with blank text left out and a nested object that vanishes when empty."""
    inner = F.struct(*[as_col(c).alias(name) for name, c in nested.items()])
    any_inner = reduce(lambda a, b: a | b, [as_col(c).isNotNull() for c in nested.values()])
    outer = [F.nullif(as_col(c).cast("string"), F.lit("")).alias(name) for name, c in fields.items()]
    return F.to_json(F.struct(*outer, F.when(any_inner, inner).alias(nested_name)))


def manifest_json(lists: Mapping[str, Sequence[str]], fields: Mapping[str, Column | str]) -> Column:
    arrays = [F.array(*[F.lit(v) for v in values]).alias(name) for name, values in lists.items()]
    return F.to_json(F.struct(*arrays, *[as_col(c).alias(name) for name, c in fields.items()]))


def map_lookup(x: Column | str, table: Mapping[str, object], default: object | None = None) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    found = F.try_element_at(F.create_map(*pairs), as_col(x))
    return found if default is None else F.coalesce(found, F.lit(default))


def distinct_sorted_text(x: Column | str, separator: str = "; ") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(as_col(x)))), separator)


def logit(x: Column | str, epsilon: float = 1e-4) -> Column:
    p = clip(x, epsilon, 1.0 - epsilon)
    return F.ln(p / (F.lit(1.0) - p))


def expit(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def geometric_decay(k: Column | str, rate: float) -> Column:
    return F.pow(F.lit(rate), as_col(k))


def bounded_score(constant: float, terms: Sequence[tuple[float, Column, Column | float]], low: float, high: float) -> Column:
    """clip(constant + sum of coefficient * (value - anchor), low, high)."""
    score = F.lit(float(constant))
    for coefficient, value, anchor in terms:
        base = anchor if isinstance(anchor, Column) else F.lit(float(anchor))
        score = score + F.lit(float(coefficient)) * (value - base)
    return clip(score, low, high)
