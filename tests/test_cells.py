"""Numbers, text and blankness of cells, and the text rules behind them."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.cells import Cells, field_number, fixed_number
from ledgerline.functions.js import java_regex, js_number, js_string, like_regex
from ledgerline.profile import ColumnDef, Profile


def _each(spark, values, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, s string")
    return [r[0] for r in df.select("k", expression(F.col("s")).alias("x")).orderBy("k").select("x").collect()]


@pytest.mark.parametrize(
    "signed, cases",
    [
        (None, {"00012345": 123.45, "0001234-": -12.34, "123.45": 123.45, "-5-": -0.05, "+7": 0.07, "5.": 5.0, ".5": 0.5, "000000000,123": 0.123}),
        (None, {"-00120": -1.2, "12345678901234567890": 12345678901234567890.0 / 100, "5\x01": None, "\r5": None, "1 2": None, "5d": None, "٣": None, "--5": None}),
        (None, {"  12 ": 0.12, "\t7\0": 0.07, "0000-": 0.0, "9999999999999": 99999999999.99}),
        (None, dict.fromkeys(["", "   ", "12A45", "00000000000 -", "00000000001E5", ".............", "-", "1,234.5", "1.2.3"])),
        ("trailing", {"0001234-": -12.34, "-1234": -12.34}),
        ("leading", {"0001234-": None, "-1234": -12.34}),
        ("none", {"1234-": None, "-1234": -12.34}),
    ],
)
def test_fixed_numbers(spark, signed, cases):
    assert _each(spark, list(cases), lambda s: fixed_number(s, 2, signed)) == list(cases.values())


def test_fixed_number_without_scale(spark):
    assert _each(spark, ["12", "12.5", "-3"], fixed_number) == [12.0, 12.5, -3.0]


def test_field_numbers(spark):
    cases = {
        "12": 12.0, " 1,5 ": 1.5, "1e3": 1000.0, "-.5": -0.5, "0x1F": 31.0, "0b101": 5.0, "0o17": 15.0, "5.": 5.0,
        "": None, "1d": None, "NaN": None, "1,2,3": None, "Infinity": None, "1 2": None, "1e999": None,
    }
    assert _each(spark, list(cases), field_number) == list(cases.values())


def test_literal_numbers():
    assert [js_number(x) for x in ("", " 5 ", "1e3", "0x10", None, 7)] == [0.0, 5.0, 1000.0, 16.0, 0.0, 7.0]
    assert all(math.isnan(js_number(x)) for x in ("a", "1_0", "1d", "0xZZ", "--1"))
    assert js_number("-Infinity") == -math.inf
    assert [js_string(x) for x in (1.0, 2.5, None, "x")] == ["1", "2.5", "", "x"]


@pytest.mark.parametrize(
    "pattern, ignore, text, want",
    [
        ("%C5%", False, "xxC5xx", True), ("a_c", False, "abc", True), ("a.c", False, "abc", False), ("a%", False, "a\nb", True), ("abc", False, "abc\n", False),
        ("%é%", True, "CAFÉ", True), ("open%", True, "OPENED", True), ("open%", False, "OPENED", False), ("50\\%", False, "50\\x", True), ("[x]", False, "[x]", True),
    ],
)
def test_like(spark, pattern, ignore, text, want):
    assert _each(spark, [text], lambda s: s.rlike(like_regex(pattern, ignore))) == [want]


@pytest.mark.parametrize(
    "pattern, flags, text, want",
    [
        (r"^C\d", "", "C5-001", True), (r"a\sb", "", "a\xa0b", True), (r"a$", "", "a\n", False), (r"a$", "m", "a\nb", True), (r"a.b", "", "a\nb", False), (r"a.b", "s", "a\nb", True),
        (r"a.b", "", "a\x85b", True), (r"É", "i", "é", True), (r"[[]", "", "[", True), (r"[^]b", "", "\nb", True), (r"[a&&b]+$", "", "&", True), (r"\Sx", "", "\xa0x", False),
    ],
)
def test_patterns(spark, pattern, flags, text, want):
    assert _each(spark, [text], lambda s: s.rlike(java_regex(pattern, flags))) == [want]


def test_unknown_flags_are_refused():
    with pytest.raises(ValueError):
        java_regex("a", "g")


def _cells(spark, profile, records):
    df = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(records)], "k int, value binary")
    cells = Cells(profile, F.col("value"))
    columns = [c.name for c in profile.columns]
    rows = df.orderBy("k").select(*(cells.text(c) for c in columns), *(cells.blank(c) for c in columns)).collect()
    n = len(columns)
    return [(tuple(r)[:n], tuple(r)[n:]) for r in rows]


LAYOUT = Profile.fixed(
    ColumnDef("CODE", 0, 6, trim="both"), ColumnDef("AMOUNT", 6, 8, "decimal", "both", 2, "trailing"), ColumnDef("STATUS", 14, 6, trim="both")
)


def test_fixed_cells(spark):
    got = _cells(spark, LAYOUT, [b"C5-00100012345OPEN  ", b"C5-001 001", b"", b"C5-001        OPEN  ", b"\0 \t   00000001"])
    assert [t for t, _ in got] == [("C5-001", "00012345", "OPEN"), ("C5-001", "001", ""), ("", "", ""), ("C5-001", "", "OPEN"), ("", "00000001", "")]
    assert [b for _, b in got] == [(False, False, False), (False, False, True), (True, True, True), (False, True, False), (True, False, True)]


def test_trims_and_encodings(spark):
    profile = Profile.fixed(ColumnDef("N", 0, 4), ColumnDef("L", 0, 4, trim="left"), ColumnDef("R", 0, 4, trim="right"), ColumnDef("B", 0, 4, trim="both"))
    assert _cells(spark, profile, [b" A\x85 "])[0][0] == (" A\x85 ", "A\x85 ", " A\x85", "A\x85")
    wide = Profile.fixed(ColumnDef("A", 0, 2), ColumnDef("B", 2, 3), encoding="utf8")
    assert _cells(spark, wide, ["é€".encode(), "a€b".encode()]) == [(("é", "€"), (False, False)), (("a�", "��b"), (False, False))]


def test_split_and_match_cells(spark):
    split = Profile(tuple(ColumnDef(c) for c in "abc"), mode="split").checked()
    assert [t for t, _ in _cells(spark, split, [b"alpha one   beta two   gamma", b"alone", b"", b"x\xa0\xa0y"])] == [
        ("alpha one", "beta two", "gamma"), ("alone", "", ""), ("", "", ""), ("x", "y", ""),
    ]
    match = Profile((ColumnDef("k"), ColumnDef("v")), mode="match", pattern=r"(\w+)=(\w+)?").checked()
    assert [t for t, _ in _cells(spark, match, [b"-- a=1", b"b=", b"none"])] == [("a", "1"), ("b", ""), ("", "")]
