from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from panelweave.functions import columns as C
from panelweave.functions import text as X
from panelweave.plans import specs


def one(spark, column, values=((None,),), schema="x double"):
    return [r[0] for r in spark.createDataFrame(list(values), schema).select(column).collect()]


def test_required_columns_name_the_dataset(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(C.MissingColumnsError, match="survey.*b, c"):
        C.require_columns(df, ["a", "b", "c"], "survey")


def test_numeric_turns_bad_text_and_nan_into_null(spark):
    assert one(spark, C.numeric("x"), [("1.5",), ("x",), ("",), (None,), ("NaN",), ("Infinity",)], "x string") == [1.5, None, None, None, None, None]


def test_pad_code_never_cuts(spark):
    assert one(spark, C.pad_code("x", 2), [("1",), ("12",), ("123",), (None,)], "x string") == ["01", "12", "123", None]


def test_bins_are_closed_ranges(spark):
    got = one(spark, C.bin_ranges("x", specs.AGE_GROUPS), [(14.0,), (15.0,), (24.0,), (54.0,), (55.0,), (None,)])
    assert got == [None, "15-24", "15-24", "45-54", None, None]


def test_flag_counts_missing_as_false(spark):
    assert one(spark, C.flag(F.col("x") > 1), [(2.0,), (1.0,), (None,)]) == [True, False, False]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_ratio("a", "b")).collect()] == [0.5, None, None, None]


def test_row_sum_and_mean_skip_missing(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (None, None)], "a double, b double")
    got = df.select(C.row_sum(["a", "b"]), C.row_sum(["a", "b"], min_count=1), C.row_mean(["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(4.0, 4.0, 2.0), (3.0, 3.0, 3.0), (0.0, None, None)]


def test_clip_keeps_null(spark):
    assert one(spark, C.clip("x", 0, 1), [(-1.0,), (0.5,), (2.0,), (None,)]) == [0.0, 0.5, 1.0, None]


def test_activity_codes(spark):
    df = spark.createDataFrame([("120308", None), ("120303", None), ("120101", None), ("050101", "3"), ("020101", None)], "code string, tier string")
    flags = C.classify_code("code", "tier", prefixes=specs.ACTIVITY_PREFIXES, exact=specs.ACTIVITY_EXACT, tiers=specs.ACTIVITY_TIERS)
    got = [r.asDict() for r in df.select(*[c.alias(n) for n, c in flags.items()]).collect()]
    assert [g["is_screen_leisure_broad"] for g in got] == [True, True, False, False, False]
    assert [g["is_digital_media_narrow"] for g in got] == [True, False, False, False, False]
    assert got[2]["is_socializing"] and got[3]["is_work"] and got[3]["is_unpaid_care"] and got[4]["is_household_work"]


def test_preferred_source_window(spark):
    rows = [("01", 2013, "fallback"), ("01", 2014, "ipums"), ("01", 2024, "ipums"), ("01", 2025, "fallback"), ("01", 2020, "fallback")]
    df = spark.createDataFrame(rows, "e string, year int, source string")
    assert rows_of(C.window_prefer_source(df, "year", 2014, 2024, "source", "ipums"), "year") == [(2014,), (2024,)]
    assert rows_of(C.window_prefer_source(df, "year", 2014, 2024, "source", "nothing"), "year") == [(2014,), (2020,), (2024,)]
    assert rows_of(C.window_prefer_source(df.drop("source"), "year", 2014, 2024, "source", "ipums"), "year") == [(2014,), (2020,), (2024,)]


def test_year_guard_raises(spark):
    df = spark.createDataFrame([("1990",), ("1995",), ("x",)], "year string")
    assert tuple(C.year_coverage(df, "year", 2010).first()) == (1990, 1995, 2, False)
    with pytest.raises(ValueError, match="1990 to 1995"):
        C.assert_year_coverage(df, "year", 2010)
    assert tuple(C.year_coverage(df.filter("year = 'x'"), "year", 2010).first()) == (-1, -1, 0, False)


def test_slice_filter_all_means_open(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "m string, y int")
    assert df.count() == C.slice_filter(df, m="all").count()
    assert rows_of(C.slice_filter(df, upto={"y": 1}, m=None)) == [("a", 1)]


def test_codes_and_keys(spark):
    df = spark.createDataFrame([("  Ab-1.0 ",), ("nan",), ("   ",), (None,), ("a  b\n c",)], "x string")
    got = [tuple(r) for r in df.select(X.make_key("x"), X.clean_text("x"), X.make_text_key("x"), X.normalize_label("x")).collect()]
    assert got == [("AB10", "Ab-1.0", "AB10", "ab10"), (None, None, None, "nan"), (None, None, None, ""), (None, None, None, None), ("ABC", "a b c", "ABC", "abc")]
    assert one(spark, X.normalize_number_code("x"), [(12.0,), (12.5,), (float("nan"),), (None,)]) == ["12", "12.5", None, None]


def test_format_value_strips_zeros_only_after_the_point(spark):
    assert one(spark, X.format_value("x"), [(10.0,), (2.5,), (2.456,), (0.0,), (None,)]) == ["10", "2.5", "2.46", "0", None]


def test_truthy_text(spark):
    values = [("1",), ("0",), ("-2",), ("Yes",), ("non-remote",), ("Work at home feasible",), ("teleworkers",), ("office",), (None,)]
    got = one(spark, X.truthy_text("x", specs.YES_WORDS, specs.NO_WORDS, specs.YES_TOKENS), values, "x string")
    assert got == [True, False, False, True, False, True, True, False, False]


def test_place_names_and_signed_numbers(spark):
    names = [("WINSTON-SALEM, nc-va",), ("new york, ny, ",), ("o'FALLON/st. louis (metro), mo",)]
    assert one(spark, X.title_case_place("x"), names, "x string") == ["Winston-Salem, NC-VA", "New York, NY", "O'fallon/St. Louis (Metro), MO"]
    assert one(spark, X.signed("x", 1), [(1.25,), (-0.04,), (-2.0,), (None,)]) == ["+1.3", "0.0", "-2.0", None]
    assert one(spark, X.percent("x"), [(0.125,), (None,)]) == ["12.5%", None]


def test_dates(spark):
    got = one(spark, X.year_of_text("x"), [("2019-03-01",), ("soon",), (None,)], "x string")
    assert got == [2019, None, None]
    df = spark.createDataFrame([("Jan", 2024), ("Zzz", 2024)], "m string, y int")
    assert [r[0] for r in df.select(X.month_label("m", "y")).collect()] == ["January 2024", None]


def test_json_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([(1.0, None, ""), (None, "x", "y")], "a double, b string, c string")
    assert [r[0] for r in df.select(X.sparse_json({"a": "a", "b": "b"})).collect()] == ['{"a":1.0}', '{"b":"x"}']
    got = [r[0] for r in df.select(X.quality_json({"c": "c"}, "modes", {"b": "b"})).collect()]
    assert got == ["{}", '{"c":"y","modes":{"b":"x"}}']


def test_expit_inverts_logit(spark):
    assert one(spark, F.round(X.expit(X.logit("x")), 9), [(0.3,), (0.0,), (1.0,)]) == [0.3, 0.0001, 0.9999]
