"""Frames over files and tables: framing, predicates, windows, sorting, filters, exports, streams."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.errors import LayoutError, QueryError, SourceError, nearest
from ledgerline.operators import frame as frame_module
from ledgerline.operators.filters import ColumnFilter, combined, filters_to_sql
from ledgerline.operators.frame import FlatFrame, concat_records, file_stamps
from ledgerline.operators.predicates import field
from ledgerline.profile import BESIDE, ColumnDef, Profile, columns_from_widths, infer_columns, widths_from_cuts
from ledgerline.sources.records import line_ending, read_records
from ledgerline.streaming.follow import follow

from tests import oracle

LAYOUT = Profile.fixed(
    ColumnDef("CODE", 0, 6, trim="both"), ColumnDef("AMOUNT", 6, 8, "decimal", "both", 2, "trailing"), ColumnDef("STATUS", 14, 6, trim="both")
)


def _frame(spark, records, profile=LAYOUT):
    rows = [(k, bytearray(r if isinstance(r, bytes) else r.encode("latin-1"))) for k, r in enumerate(records)]
    return FlatFrame.from_df(spark.createDataFrame(rows, "row long, record binary"), "record", "row", profile)


def _rows(frame):
    return sorted(r[0] for r in frame.records.select("_row").collect())


def _file(path: Path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


# ---- framing


@pytest.mark.parametrize("data, want", [(b"a\nb\n", "lf"), (b"a\r\nb\r\n", "crlf"), (b"no terminator", "none"), (b"", "none"), (b"\n", "lf")])
def test_line_endings(data, want):
    assert line_ending(data) == want


A, B = b"C1-1        0000000012345 OPEN    ", b"C1-2        0000000012345-SHUT    "
WIDE = Profile.fixed(ColumnDef("CODE", 0, 12, trim="both"), ColumnDef("AMOUNT", 12, 14, "decimal", "both", 2), ColumnDef("STATUS", 26, 8, trim="both"))


@pytest.mark.parametrize(
    "data, codes",
    [
        (b"", []), (A, ["C1-1"]), (A + b"\n" + B, ["C1-1", "C1-2"]), (A + b"\r\n" + B + b"\r\n", ["C1-1", "C1-2"]), (A + b"\r\n" + B + b"\n" + A + b"\r\n", ["C1-1", "C1-2", "C1-1"]),
        (b"\xef\xbb\xbf" + A + b"\n", ["C1-1"]), (A + b"\n\n" + B + b"\n\n\n", ["C1-1", "", "C1-2", "", ""]), (b"C1-1\n" + B + b"\n", ["C1-1", "C1-2"]),
    ],
)
def test_lines(spark, tmp_path, data, codes):
    frame = FlatFrame.open(spark, _file(tmp_path / "f.dat", data), WIDE)
    got = frame.numbered.orderBy("_row").collect()
    assert [r.CODE for r in got] == codes
    assert [r._row for r in got] == list(range(len(codes)))
    assert all(r.STATUS in ("OPEN", "SHUT", "") for r in got)


def test_bytes_beyond_ascii_and_long_lines(spark, tmp_path):
    odd = bytes(range(0x80, 0xA0)) + b"\x00\x7f\xff"
    path = _file(tmp_path / "f.dat", odd + b"\n" + b"X" * 2_000_000 + b"\n" + b"last\n")
    frame = FlatFrame.open(spark, path, Profile.fixed(ColumnDef("A", 0, 35), ColumnDef("Z", 1_999_999, 10)))
    got = frame.numbered.orderBy("_row").collect()
    assert got[0].A == odd.decode("latin-1")
    assert [r.Z for r in got] == ["", "X", ""]


def test_row_numbers_over_many_splits(spark, tmp_path):
    path = _file(tmp_path / "f.dat", b"".join(b"%08d%s" % (k, b"\r\n" if k % 3 else b"\n") for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = FlatFrame.open(spark, path, Profile.fixed(ColumnDef("N", 0, 8)))
        assert frame.records.rdd.getNumPartitions() > 4
        assert frame.where(field("N") >= 0).numbered.where(F.col("_row") != F.col("N").cast("long")).count() == 0
        assert frame.count() == 20_000
        assert [r.N for r in frame.rows(9_999, 2).numbered.orderBy("_row").collect()] == ["00009999", "00010000"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_follow_the_paths_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lengths, first = (10, 3_000, 0, 1, 9_000, 20_000), 0
    for k, n in enumerate(lengths):  # later files are longer; the last are read in several splits
        _file(folder / f"part-{k}.txt", b"".join(b"%08d\n" % (first + j) for j in range(n)))
        first += n
    layout = Profile.fixed(ColumnDef("N", 0, 8), skip_records=5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        frame = FlatFrame.open(spark, str(folder), layout)
        got = frame.numbered.select("_row", F.col("N").cast("long").alias("n")).collect()
        assert sorted(r._row for r in got) == list(range(first)) and all(r._row == r.n for r in got)
        assert [r.N for r in frame.limit(3).df.collect()] == ["00000005", "00000006", "00000007"]
        assert [r.N for r in frame.rows(9, 3).numbered.orderBy("_row").collect()] == ["00000009", "00000010", "00000011"]
        assert frame.where(field("N") < 20).count() == 15
        given = read_records(spark, [str(folder / f"part-{k}.txt") for k in (3, 0, 3)], layout)
        assert [r.value.decode() for r in given.orderBy("_row").collect()] == ["00003010", *(f"{j:08d}" for j in range(10)), "00003010"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fixed_length_records(spark, tmp_path):
    profile = Profile.fixed(ColumnDef("N", 0, 4, "number"), line_ending="none", record_length=8)
    path = _file(tmp_path / "f.dat", b"\xef\xbb\xbf" + b"".join(b"%04dabcd" % k for k in range(1000)) + b"0000abc")
    frame = FlatFrame.open(spark, path, profile)
    assert frame.count() == 1000
    assert [r.N for r in frame.rows(500, 3).numbered.orderBy("_row").collect()] == ["0500", "0501", "0502"]
    assert frame.go_to(1000).df.first().N == "0999"
    assert frame.where(field("N") < 3).count() == 3


# ---- predicates


RECORD = "C5-00100012345OPEN  "


@pytest.mark.parametrize(
    "predicate, want",
    [
        (field("STATUS") == "OPEN", True), (field("STATUS") == "SHUT", False), (field("AMOUNT") > 9, True), (field("AMOUNT") > 999, False), (field("code").like("%5-0%"), True),
        (field("STATUS").isin("OPEN", "SHUT"), True), (field("AMOUNT").between(100, 200), True), (field("STATUS").is_not_null(), True), (field("CODE").matches(r"^C\d"), True),
        (~field("STATUS").like("%OPEN%"), False), (~(field("STATUS") == "OPEN"), False), (field("STATUS").ilike("op%"), True), (field("AMOUNT") == "123.45", True),
        (field("CODE") == None, False), (field("STATUS") > "OPEM", True), (field("CODE") > 5, False), (~(field("CODE") > 5), True), (field("AMOUNT").isin("123.45"), True),
    ],
)
def test_predicates_on_one_record(spark, predicate, want):
    assert _rows(_frame(spark, [RECORD]).where(predicate)) == ([0] if want else [])


def test_blank_amounts(spark):
    frame = _frame(spark, [RECORD, "C5-001        OPEN  ", "C5-0010012A345OPEN  "])
    amount = field("AMOUNT")
    for predicate, want in (
        (amount > 0, [0]), (amount < 0, []), (amount != 5, [0]), (~(amount > 0), [1, 2]), (~amount.isin(1, 2), [0, 1, 2]), (amount.isin("x", 5), [1, 2]), (~amount.isin("x"), [0]),
        (amount.between(0, 999), [0]), (amount.not_between(500, 999), [0]), (~amount.between(500, 999), [0, 1, 2]), (amount.is_null(), [1]), (amount.is_not_null(), [0, 2]),
        (amount.between("x", 5), []), (amount.not_between("x", 5), [0]),
    ):
        assert _rows(frame.where(predicate)) == want, predicate.sql


def test_conjuncts_run_cheapest_first():
    both = field("CODE").matches("x") & (field("STATUS") == "OPEN") & field("CODE").like("C%")
    assert both.sql == "STATUS = 'OPEN' AND CODE LIKE 'C%' AND CODE MATCHES /x/"
    assert ((field("a") == 1) | (field("b") == "o'k")).sql == "(a = 1) OR (b = 'o''k')"


def test_refused_predicates(spark):
    frame = _frame(spark, [RECORD])
    for bad in (
        lambda: frame.where(field("AMOUNT") > "abc"), lambda: frame.where(field("COED") == "x"), lambda: field("CODE").matches("("), lambda: field("CODE").matches("a", "g"),
        lambda: field("CODE") == field("STATUS"), lambda: field("CODE").isin(), lambda: bool(field("CODE") == 1), lambda: frame.limit(-1), lambda: frame.query(order_by="CODE"), lambda: frame.query(offset=1),
    ):
        with pytest.raises(QueryError):
            bad()
    with pytest.raises(QueryError, match="Did you mean CODE"):
        frame.select("COED")


def test_random_predicates_match_the_row_oracle(spark):
    rng = random.Random(5)
    records = []
    for _ in range(300):
        amount = rng.choice([f"{rng.randrange(10**6):07d}{rng.choice(' -+')}", "        ", "12A45   ", f"{rng.randrange(1000)}.{rng.randrange(10)}".rjust(8), "0,5     "])
        records.append(f"{rng.choice(['C', 'c', 'D'])}{rng.randrange(100):<5}{amount}{rng.choice(['OPEN', 'SHUT', 'é', '', 'open'])}")
    frame = _frame(spark, records)
    cells = [oracle.cells(r, LAYOUT) for r in records]
    flags, wants, shown = [], [], []
    for _ in range(60):
        predicate, want = oracle.random_predicate(rng)
        flags.append(predicate.build(frame.cells).alias(f"p{len(flags)}"))
        wants.append([want(c) for c in cells])
        shown.append(predicate.sql)
    got = frame.records.orderBy("_row").select(*flags).collect()
    for k, want in enumerate(wants):
        assert [r[k] for r in got] == want, shown[k]


# ---- projection, windows, sorting


def test_selection_keeps_order_and_ignores_case(spark):
    frame = _frame(spark, [RECORD]).select("status", "CODE")
    assert frame.df.columns == ["STATUS", "CODE"]
    assert tuple(frame.df.first()) == ("OPEN", "C5-001")


def test_unused_columns_are_not_computed(spark, tmp_path):
    _frame(spark, [RECORD]).select("STATUS").df.explain("extended")
    plan = _frame(spark, [RECORD]).select("STATUS").df._jdf.queryExecution().optimizedPlan().toString()
    assert "STATUS" in plan and "AMOUNT" not in plan


AMOUNTS = ["00000300", "00000100", "        ", "00000200", "00000100", "00000100-"[:8], "xx      "]


def test_sorting(spark):
    frame = _frame(spark, [f"{k:06d}{a}OPEN  " for k, a in enumerate(AMOUNTS)])
    order = lambda *args, **kw: [r._row for r in frame.top(*args, **kw).numbered.collect()]
    assert order(7, "AMOUNT") == [1, 4, 5, 3, 0, 2, 6]
    assert order(7, "AMOUNT", descending=True) == [2, 6, 0, 3, 1, 4, 5]
    assert order(2, "AMOUNT", offset=1) == [4, 5]
    assert order(3, "CODE", descending=True) == [6, 5, 4]
    plan = frame.top(2, "AMOUNT").df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_windows_skips_and_caps(spark):
    frame = _frame(spark, [f"{k:06d}00000{k:03d}OPEN  " for k in range(50)])
    assert _rows(frame.limit(3, 4)) == [4, 5, 6]
    assert _rows(frame.rows(48, 10)) == [48, 49]
    assert _rows(frame.go_to(1)) == [0]
    skipping = frame.with_profile(Profile.fixed(*LAYOUT.columns, skip_records=10))
    assert _rows(skipping.limit(2)) == [10, 11] and _rows(skipping.rows(0, 2)) == [0, 1]
    assert _rows(skipping.where(field("AMOUNT") < 0.12)) == [10, 11]
    assert [frame.capped(n)[1] for n in (49, 50, 51)] == [True, True, False]
    assert frame.statistics().first().asDict() == {"records": 50, "average_bytes": 20.0}


# ---- column filters


def test_column_filters(spark):
    frame = _frame(spark, [RECORD, "50%   00000100SHUT  ", "507   00000500open  ", "              "])
    for boxes, want in (
        ([("STATUS", "contains", "OPE"), ("AMOUNT", "gte", "100")], [0]), ([("CODE", "startsWith", "50%")], [1]), ([("STATUS", "endsWith", "EN")], [0, 2]),
        ([("STATUS", "equals", "OPEN")], [0]), ([("STATUS", "notEquals", "OPEN")], [1, 2, 3]), ([("AMOUNT", "lt", "1,5")], [1]), ([("AMOUNT", "lte", "1")], [1]), ([("AMOUNT", "gt", "1")], [0, 2]),
        ([("CODE", "regex", "^c")], [0]), ([("CODE", "empty", "")], [3]), ([("AMOUNT", "notEmpty", "")], [0, 1, 2]), ([("CODE", "contains", "")], [0, 1, 2, 3]), ([], [0, 1, 2, 3]),
    ):
        assert _rows(frame.filter(*(ColumnFilter(*b) for b in boxes))) == want, boxes
    assert combined([ColumnFilter("CODE", "equals", "")]) is None
    assert filters_to_sql([ColumnFilter("STATUS", "contains", "OPE"), ColumnFilter("AMOUNT", "gte", "100")]) == "SELECT * WHERE AMOUNT >= 100 AND STATUS ILIKE '%OPE%'".replace(
        "AMOUNT >= 100 AND STATUS ILIKE '%OPE%'", "STATUS ILIKE '%OPE%' AND AMOUNT >= 100"
    )
    with pytest.raises(QueryError):
        frame.filter(ColumnFilter("CODE", "near", "x"))


# ---- profiles


def test_profiles(tmp_path):
    profile = Profile.from_widths([3, 0, 4], ["a", "b"], skip_records=2)
    assert [(c.name, c.start, c.length) for c in profile.columns] == [("a", 0, 3), ("col3", 3, 4)]
    profile.save(tmp_path / "p.json")
    assert Profile.load(tmp_path / "p.json") == profile
    assert json.loads((tmp_path / "p.json").read_text())["skip_records"] == 2
    assert widths_from_cuts([5, 2, 2, 0, 12], 10) == [2, 3, 5]
    assert [c.length for c in columns_from_widths([1, -1, 2])] == [1, 2]
    assert profile.record_width == 7 and Profile.default().mode == "split"


def test_profile_problems_are_all_told():
    bad = Profile((ColumnDef("a", -1, 0), ColumnDef("A", 0, 1, "date")), line_ending="none", encoding="ebcdic")
    assert len(bad.problems()) == 6
    with pytest.raises(LayoutError):
        bad.checked()
    assert Profile(mode="split", pattern="(,)").problems() and Profile(mode="match", pattern="(").problems()
    overlapping = Profile.fixed(ColumnDef("a", 0, 5), ColumnDef("b", 2, 9))
    assert overlapping.problems() == []


def test_columns_are_inferred(spark, tmp_path):
    path = _file(tmp_path / "f.txt", b"a  b\na  b  c\n")
    assert FlatFrame.open(spark, path).df.columns == ["col1", "col2", "col3"]
    assert infer_columns(["a,b"], "(") == () and len(infer_columns(["x"], r"(\w)(\d)", "match")) == 2
    assert FlatFrame.open(spark, path).sample(1) == ["a  b"]


# ---- exports and streams


def test_csv_and_jsonl(spark, tmp_path):
    profile = Profile((ColumnDef("a", trim="none"), ColumnDef("b", trim="none")), mode="split", pattern=r"\|", encoding="utf8")
    frame = _frame(spark, ["1|plain".encode(), '2| q"uote'.encode(), "3|com,ma".encode(), "4|".encode(), "5|é".encode()], profile)
    want = [("1", "plain"), ("2", ' q"uote'), ("3", "com,ma"), ("4", ""), ("5", "é")]
    one = tmp_path / "one.csv"
    assert frame.limit(9).export(str(one)) == 5
    assert one.read_text() == 'a,b\n1,plain\n2," q""uote"\n3,"com,ma"\n4,\n5,é\n'
    lines = tmp_path / "one.jsonl"
    assert frame.limit(9).export(str(lines)) == 5
    assert [tuple(json.loads(x).values()) for x in lines.read_text().splitlines()] == want
    frame.write_csv(str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', schema="a string, b string").na.fill("")
    assert sorted(map(tuple, back.collect())) == want
    frame.write_jsonl(str(tmp_path / "jsonl"))
    assert sorted(map(tuple, spark.read.schema("a string, b string").json(str(tmp_path / "jsonl")).collect())) == want


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _file(folder / "a.dat", RECORD.encode() + b"\r\nC5-00200000100SHUT  \n")
    stream = follow(spark, str(folder), LAYOUT, field("AMOUNT") > 100)
    query = stream.writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [(r.CODE, r.AMOUNT) for r in spark.table("followed").collect()] == [("C5-001", "00012345")]


def test_typed_views_joins_and_concatenation(spark, tmp_path):
    frame = _frame(spark, [RECORD, "C5-002        SHUT  "])
    frame.to_view("records")
    assert spark.sql("SELECT sum(AMOUNT) FROM records").first()[0] == 123.45
    assert concat_records([frame, frame]).count() == 4
    with pytest.raises(LayoutError):
        concat_records([frame, frame.with_profile(WIDE)])
    path = _file(tmp_path / "f.dat", b"abc")
    assert file_stamps(spark, path).first()["size"] == 3


def test_text_payloads_and_clashing_columns(spark):
    df = spark.createDataFrame([(7, RECORD, "x"), (8, None, "y")], "id int, CODE string, value string")
    got = FlatFrame.from_df(df, "CODE", "id", LAYOUT).numbered.orderBy("_row").collect()
    assert (got[0]._row, got[0].CODE, got[0].STATUS) == (7, "C5-001", "OPEN")
    assert FlatFrame.from_df(df.limit(0), "CODE", "id", LAYOUT).count() == 0


# ---- places in files, what is not read, what was asked


def test_offsets_of_lines(spark, tmp_path):
    data = [b"\xef\xbb\xbfone\r\n\nthree\n", b"four\r\nfive", b"", b"".join(b"%d\n" % k for k in range(5000)), b"\xef\xbb\xbflast"]
    paths = [_file(tmp_path / f"{9 - k}.txt", d) for k, d in enumerate(data)]
    want = []
    for d in data:
        at = 3 if d.startswith(b"\xef\xbb\xbf") else 0
        lines = d[at:].split(b"\n")
        for x in lines[: len(lines) - (not lines[-1])]:
            want.append((at, x.removesuffix(b"\r").decode()))
            at += len(x) + 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = FlatFrame.open(spark, paths, Profile.fixed(ColumnDef("A", 0, 9))).located().orderBy("_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r._row for r in got] == list(range(len(want)))
    assert [(r._offset, r.A) for r in got] == want


def test_offsets_and_paths_of_fixed_records(spark, tmp_path):
    folder = tmp_path / "in, with [odd] names"
    folder.mkdir()
    _file(folder / "b.dat", b"\xef\xbb\xbfb1b2b")
    _file(folder / "a.dat", b"a1a2")
    _file(folder / "_skip.dat", b"xx")
    layout = Profile.fixed(ColumnDef("A", 0, 2), line_ending="none", record_length=2)
    for path in (str(folder), f"{folder}/*.dat", [f"{folder}/a.dat", f"{folder}/b.dat"]):
        got = FlatFrame.open(spark, path, layout).located().orderBy("_row").collect()
        assert [(r._row, r._offset, r.A) for r in got] == [(0, 0, "a1"), (1, 2, "a2"), (2, 3, "b1"), (3, 5, "b2")]
    with pytest.raises(SourceError):
        FlatFrame.open(spark, f"{folder}/*.none", layout)


def test_a_filter_does_not_number_rows(spark, tmp_path):
    frame = FlatFrame.open(spark, _file(tmp_path / "f.dat", b"C1\nC2\nC1\n"), Profile.fixed(ColumnDef("A", 0, 2)))
    found = frame.where(field("A") == "C1")
    assert found.count() == 2 and found.df.count() == 2 and found.typed(row=False).count() == 2
    assert frame.numbering._bases is None
    assert _rows(found) == [0, 2]


def test_limits_beyond_a_sort_are_cut_by_counts(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, n in enumerate((10, 400, 0, 90)):
        _file(folder / f"{k}.txt", b"".join(b"%d-%04d\n" % (k, j) for j in range(n)))
    frame = FlatFrame.open(spark, str(folder), Profile.fixed(ColumnDef("A", 0, 6), skip_records=3))
    odd = frame.where(field("A").matches("[13579]$"))
    want = [r.A for r in odd.numbered.orderBy("_row").collect()]
    assert len(want) == 249
    monkeypatch.setattr(frame_module, "SORTED_ROWS", 0)
    for n, offset in ((5, 0), (100, 20), (1000, 240), (0, 3), (7, 300)):
        cut = odd.limit(n, offset)
        assert [r.A for r in cut.numbered.orderBy("_row").collect()] == want[offset : offset + n]
    assert [r._row for r in frame.limit(20).numbered.orderBy("_row").collect()] == list(range(3, 23))
    assert odd.capped(249)[1] and not odd.capped(250)[1]


def test_profiles_beside_a_file(spark, tmp_path):
    path = _file(tmp_path / "f.dat", b"C1-1  00000012\n")
    assert FlatFrame.open(spark, path).profile.mode == "split"
    Profile.fixed(ColumnDef("CODE", 0, 4)).save(path + BESIDE)
    assert FlatFrame.open(spark, path).df.collect() == [("C1-1",)]
    Path(path + BESIDE).write_text('{"columns": [], "mode": "fixed"}')
    with pytest.warns(UserWarning, match="ignored"):
        assert FlatFrame.open(spark, path).df.columns == ["col1", "col2"]


def test_prefilters_and_descriptions(spark):
    split = Profile(tuple(ColumnDef(n) for n in ("a", "b")), mode="split", pattern=r"\s{2,}", encoding="utf8").checked()
    frame = FlatFrame.from_df(spark.createDataFrame([(0, "PENDING  é"), (1, "OPEN  x"), (2, "x  PENDING")], "row long, record string"), "record", "row", split)
    open_, both = field("a") == "PENDING", (field("a") == "PENDING") & (field("b") > 5)
    assert open_.needle(frame.cells) == both.needle(frame.cells) == "PENDING"
    assert (open_ | (field("b") == "x")).needle(frame.cells) is None and (~open_).needle(frame.cells) is None
    assert field("b").like("%ab%cde_f").needle(frame.cells) == "cde" and (field("AMOUNT") == "5").needle(_frame(spark, []).cells) is None
    assert ((field("a") == "x") & (field("b").like("%y%") | (field("a") > 1))).columns == ("a", "b")
    assert _rows(frame.where(open_)) == [0] and _rows(frame.where(field("b") == "é")) == [0]
    assert frame.where(open_).top(5, "B").describe() == 'filter · block prefilter "PENDING" · top-5 by b'
    assert frame.top(5, "a").describe() == "full scan · top-5 by a" and frame.describe() == "full scan"
    assert frame.where(field("a") > "A").describe() == "filter"


@pytest.mark.parametrize("name, want", [("AMOUN", "AMOUNT"), ("AMOUNTS", "AMOUNT"), ("amuont", "AMOUNT"), ("CODA", "CODE"), ("STATE", "STATUS"), ("QQQQQQQQQ", None), ("", "CODE")])
def test_suggestions(name, want):
    assert nearest(name, ["CODE", "AMOUNT", "STATUS"]) == want


def test_error_codes():
    with pytest.raises(QueryError) as found:
        field("A").matches("(")
    assert found.value.code == "QUERY_SYNTAX" and QueryError.code == "QUERY_SEMANTIC" and LayoutError.code == "SCHEMA_INVALID"
