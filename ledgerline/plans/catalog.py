"""Queries over the driver's tables: rows rendered as flat records, then queried as such.

Each table is rendered to one record per row (``lpad``/``rpad``, amounts as 13 digits of
cents and a sign byte), read back through a layout, and queried with its unique key as
row number. The SQL beside each query says the same over the original columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.errors import LayoutError, QueryError, SourceError, nearest
from ledgerline.operators.filters import ColumnFilter, filters_to_sql
from ledgerline.operators.frame import FlatFrame, file_stamps
from ledgerline.operators.predicates import Predicate, field
from ledgerline.profile import ColumnDef, Profile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _both(name: str, start: int, length: int, kind: str = "string", **more) -> ColumnDef:
    return ColumnDef(name, start, length, kind, "both", **more)


CUSTOMER = Profile.fixed(_both("CUST", 0, 10, "number"), _both("NAME", 10, 20), _both("SEG", 30, 12), _both("BAL", 42, 14, "decimal", scale=2, signed="trailing"))
ORDERS = Profile.fixed(
    _both("ORDER", 0, 12, "number"), _both("STATUS", 12, 2), _both("PRIORITY", 14, 16), _both("DATE", 30, 10), _both("TOTAL", 40, 14, "decimal", scale=2)
)
PART = Profile.fixed(_both("PART", 0, 10, "number"), _both("NAME", 10, 60), _both("BRAND", 70, 12), _both("TYPE", 82, 30), _both("SIZE", 112, 4, "number"))
EVENTS = Profile.fixed(_both("EVENT", 0, 12, "number"), _both("USER", 12, 10, "number"), _both("TYPE", 22, 12), _both("VALUE", 34, 24, "number"))
EVENT_LINES = Profile(tuple(ColumnDef(n) for n in ("id", "type", "user", "value")), mode="split", pattern=r"\s{2,}").checked()
SUPPLIER = Profile.fixed(_both("SUPP", 0, 10, "number"), _both("NAME", 10, 25), _both("BAL", 35, 14, "decimal", scale=2), line_ending="none", record_length=50)


def _digits(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _text(c: Column, n: int) -> Column:
    return F.rpad(c, n, " ")


def _money(c: Column) -> Column:
    cents = F.round(F.abs(c) * 100).cast("long")
    return F.concat(_digits(cents, 13), F.when(c < 0, "-").otherwise(" "))


def _frame(spark: SparkSession, sf_dir: str, table: str, key: str, profile: Profile, *parts: Column, sep: str = "") -> FlatFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return FlatFrame.from_df(df.select(key, F.concat_ws(sep, *parts).alias("record")), "record", key, profile)


def customer(spark: SparkSession, sf_dir: str) -> FlatFrame:
    return _frame(
        spark, sf_dir, "customer", "c_custkey", CUSTOMER,
        _digits(F.col("c_custkey"), 10), _text(F.col("c_name"), 20), _text(F.col("c_mktsegment"), 12), _money(F.col("c_acctbal")),
    )


def orders(spark: SparkSession, sf_dir: str) -> FlatFrame:
    return _frame(
        spark, sf_dir, "orders", "o_orderkey", ORDERS,
        _digits(F.col("o_orderkey"), 12), _text(F.col("o_orderstatus"), 2), _text(F.col("o_orderpriority"), 16),
        F.date_format("o_orderdate", "yyyy-MM-dd"), _money(F.col("o_totalprice")),
    )


def part(spark: SparkSession, sf_dir: str) -> FlatFrame:
    return _frame(
        spark, sf_dir, "part", "p_partkey", PART,
        _digits(F.col("p_partkey"), 10), _text(F.col("p_name"), 60), _text(F.col("p_brand"), 12), _text(F.col("p_type"), 30), _digits(F.col("p_size"), 4),
    )


def events(spark: SparkSession, sf_dir: str) -> FlatFrame:
    """Events whose value is left blank in every seventh record."""
    value = F.when(F.col("event_id") % 7 != 0, F.format_string("%.4f", F.round("value", 4)))
    return _frame(
        spark, sf_dir, "events", "event_id", EVENTS,
        _digits(F.col("event_id"), 12), _digits(F.col("user_id"), 10), _text(F.col("event_type"), 12), F.lpad(F.coalesce(value, F.lit("")), 24, " "),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> FlatFrame:
    """The same as separated fields; a blank value is a missing last field."""
    value = F.when(F.col("event_id") % 7 != 0, F.format_string("%.4f", F.round("value", 4)))
    return _frame(
        spark, sf_dir, "events", "event_id", EVENT_LINES,
        F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string"), value, sep="   ",
    )


_C = "SELECT c_custkey::DOUBLE AS CUST, c_name AS NAME, c_mktsegment AS SEG, c_acctbal AS BAL FROM customer"
_O = "SELECT o_orderkey::DOUBLE AS \"ORDER\", o_orderstatus AS STATUS, o_orderpriority AS PRIORITY, strftime(o_orderdate, '%Y-%m-%d') AS DATE, o_totalprice AS TOTAL FROM orders"
_P = "SELECT p_partkey::DOUBLE AS PART, p_name AS NAME, p_brand AS BRAND, p_type AS TYPE, p_size::DOUBLE AS SIZE FROM part"
_E = "SELECT event_id::DOUBLE AS EVENT, user_id::DOUBLE AS \"USER\", event_type AS TYPE, CASE WHEN event_id % 7 <> 0 THEN round(value, 4) END AS VALUE FROM events"
_TABLES = {"c": (customer, _C), "o": (orders, _O), "p": (part, _P), "e": (events, _E)}


def _register(name: str, table: str, condition: Predicate, sql: str) -> None:
    frame, base = _TABLES[table]
    QUERIES[name] = lambda spark, sf_dir: frame(spark, sf_dir).where(condition).typed(row=False)
    SQL[name] = f"SELECT * FROM ({base}) WHERE {sql}"


for _name, _table, _condition, _sql in (
    ("cmp_text_eq", "c", field("SEG") == "BUILDING", "SEG = 'BUILDING'"),
    ("cmp_text_ne", "c", field("seg") != "BUILDING", "SEG <> 'BUILDING'"),
    ("cmp_text_range", "p", (field("TYPE") >= "M") & (field("TYPE") < "P"), "TYPE >= 'M' AND TYPE < 'P'"),
    ("cmp_num_range", "c", field("BAL") > 5000, "BAL > 5000"),
    ("cmp_num_negative", "c", field("BAL") < -100.5, "BAL < -100.5"),
    ("cmp_num_quoted", "c", field("BAL") <= "-5e2", "BAL <= -500"),
    ("like_prefix", "p", field("NAME").like("b%"), "NAME LIKE 'b%'"),
    ("like_infix", "p", field("NAME").like("%d w_d%"), "NAME LIKE '%d w_d%'"),
    ("not_like", "p", ~field("TYPE").like("%A%"), "TYPE NOT LIKE '%A%'"),
    ("ilike", "p", field("NAME").ilike("%WIDG_T"), "NAME ILIKE '%WIDG_T'"),
    ("matches_regex", "p", field("BRAND").matches(r"#[1-3]\d?$"), "regexp_matches(BRAND, '#[1-3][0-9]?$')"),
    ("not_matches", "p", ~field("BRAND").matches("brand.*2", "i"), "NOT regexp_matches(BRAND, '(?i)brand.*2')"),
    ("in_text", "c", field("SEG").isin("BUILDING", "MACHINERY"), "SEG IN ('BUILDING', 'MACHINERY')"),
    ("in_num", "p", field("SIZE").isin(1, "7", 49.0), "SIZE IN (1, 7, 49)"),
    ("not_in_blank", "e", ~field("VALUE").isin(1, 2), "VALUE IS NULL OR VALUE NOT IN (1, 2)"),
    ("between_num", "e", field("VALUE").between(10, "50"), "VALUE BETWEEN 10 AND 50"),
    ("not_between_blank", "e", field("VALUE").not_between(10, 50), "VALUE NOT BETWEEN 10 AND 50"),
    ("between_text", "o", field("DATE").between("1996-01-01", "1996-12-31"), "DATE BETWEEN '1996-01-01' AND '1996-12-31'"),
    ("is_null", "e", field("VALUE").is_null(), "VALUE IS NULL"),
    ("is_not_null", "e", field("VALUE").is_not_null(), "VALUE IS NOT NULL"),
    ("null_literal", "o", field("ORDER") == None, "\"ORDER\" = 0"),  # noqa: E711
    ("not_comparison_blank", "e", ~(field("VALUE") > 20), "VALUE IS NULL OR NOT VALUE > 20"),
    ("and_or_precedence", "o", (field("STATUS") == "F") | (field("STATUS") == "O") & (field("TOTAL") > 200000), "STATUS = 'F' OR STATUS = 'O' AND TOTAL > 200000"),
    ("and_cost_order", "o", field("PRIORITY").matches("^[12]-") & (field("STATUS") == "F") & field("TOTAL").between(1000, 90000), "STATUS = 'F' AND TOTAL BETWEEN 1000 AND 90000 AND regexp_matches(PRIORITY, '^[12]-')"),
):
    _register(_name, _table, _condition, _sql)


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


@_query("scan_fixed_all", "SELECT lpad(c_custkey::VARCHAR, 10, '0') AS CUST, c_name AS NAME, c_mktsegment AS SEG, lpad(round(abs(c_acctbal) * 100)::BIGINT::VARCHAR, 13, '0') || CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END AS BAL FROM customer")
def scan_fixed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer(spark, sf_dir).df


@_query("typed_decimal", "SELECT c_custkey::DOUBLE AS CUST, c_acctbal AS BAL FROM customer")
def typed_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer(spark, sf_dir).select("CUST", "BAL").typed(row=False)


@_query("project_columns", "SELECT o_orderpriority AS PRIORITY, o_orderstatus AS STATUS FROM orders")
def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("priority", "Status").df


@_query("topn_asc", f"SELECT * FROM ({_O}) ORDER BY TOTAL, \"ORDER\" LIMIT 50")
def topn_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).top(50, "TOTAL").typed(row=False)


@_query("topn_desc_blank_first", f"SELECT EVENT, VALUE FROM ({_E}) ORDER BY VALUE DESC NULLS FIRST, EVENT LIMIT 100 OFFSET 1400")
def topn_desc_blank_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).top(100, "VALUE", descending=True, offset=1400).select("EVENT", "VALUE").typed(row=False)


@_query("topn_text", f"SELECT PART, NAME FROM ({_P}) ORDER BY NAME DESC, PART LIMIT 40 OFFSET 5")
def topn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir).top(40, "NAME", descending=True, offset=5).select("PART", "NAME").typed(row=False)


@_query("limit_offset", f"SELECT * FROM ({_O}) WHERE STATUS = 'F' ORDER BY \"ORDER\" LIMIT 30 OFFSET 20")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).query(where=field("STATUS") == "F", limit=30, offset=20).typed(row=False)


@_query("statement", f"SELECT NAME, SEG, BAL FROM ({_C}) WHERE SEG = 'BUILDING' AND BAL > 500 AND NAME NOT LIKE '%99%' ORDER BY BAL DESC, CUST LIMIT 100")
def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: select, where, order by, limit."""
    condition = (field("SEG") == "BUILDING") & (field("BAL") > 500) & ~field("NAME").like("%99%")
    found = customer(spark, sf_dir).query(["NAME", "SEG", "BAL"], condition, order_by="BAL", descending=True, limit=100)
    return found.typed(row=False)


@_query("row_window", f"SELECT * FROM ({_O}) WHERE \"ORDER\" >= 100 AND \"ORDER\" < 300")
def row_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).rows(100, 200).typed(row=False)


@_query("skip_records", f"SELECT * FROM ({_C}) WHERE CUST >= 25 AND BAL > 0")
def skip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = customer(spark, sf_dir)
    frame = frame.with_profile(replace(frame.profile, skip_records=25))
    return frame.where(field("BAL") > 0).typed(row=False)


@_query("match_statistics", f"SELECT count(*)::BIGINT AS matched FROM ({_O}) WHERE TOTAL > 100000")
def match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).where(field("TOTAL") > 100000).records.agg(F.count("*").alias("matched"))


_LINES = "SELECT event_id::VARCHAR AS id, event_type AS type, user_id::VARCHAR AS \"user\", CASE WHEN event_id % 7 <> 0 THEN printf('%.4f', round(value, 4)) ELSE '' END AS value FROM events"


_RAW = "SELECT event_id, event_id::VARCHAR || '   ' || event_type || '   ' || user_id::VARCHAR || CASE WHEN event_id % 7 <> 0 THEN '   ' || printf('%.4f', round(value, 4)) ELSE '' END AS raw FROM events"


@_query("record_statistics", f"SELECT count(*)::BIGINT AS records, avg(strlen(raw)) AS average_bytes FROM ({_RAW})")
def record_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).statistics()


@_query("raw_records", f"SELECT event_id AS at, raw FROM ({_RAW})")
def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).raw().withColumnRenamed("_row", "at")


@_query("null_literal_text", f"SELECT * FROM ({_LINES}) WHERE value = ''")
def null_literal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).where(field("value") == None).df  # noqa: E711


@_query("blank_separated_fields", f"SELECT * FROM ({_LINES}) WHERE value = '' AND type <> 'view'")
def blank_separated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).where(field("value").is_null() & (field("type") != "view")).df


@_query("prefiltered_fields", f"SELECT * FROM ({_LINES}) WHERE type = 'click' AND value LIKE '%.5%'")
def prefiltered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).where((field("type") == "click") & field("value").like("%.5%")).df


@_query("cmp_num_on_text", f"SELECT CUST, NAME, SEG, lpad(round(abs(BAL) * 100)::BIGINT::VARCHAR, 13, '0') || CASE WHEN BAL < 0 THEN '-' ELSE '' END AS BAL FROM ({_C}) WHERE round(BAL * 100) > 500000")
def cmp_num_on_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column compared with a number: its digits, without the scale that it does not declare."""
    frame = customer(spark, sf_dir)
    texts = [replace(c, type="string", scale=0, signed=None) if c.name == "BAL" else c for c in frame.profile.columns]
    return frame.with_profile(frame.profile.with_columns(*texts)).where(field("BAL") > 500000).typed(row=False)


@_query("regex_split", _LINES)
def regex_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).df


@_query("regex_number", f"SELECT id, round(value::DOUBLE, 4) AS value FROM ({_LINES}) WHERE value <> '' AND value::DOUBLE >= 25")
def regex_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = event_lines(spark, sf_dir)
    columns = [replace(c, type="number") if c.name == "value" else c for c in frame.profile.columns]
    return frame.with_profile(frame.profile.with_columns(*columns)).where(field("value") >= 25).select("id", "value").typed(row=False)


@_query("regex_match", "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)(/[a-z]+)?', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)(/[a-z]+)?', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)(/[a-z]+)?', 3) AS section FROM pages")
def regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = Profile(tuple(ColumnDef(n) for n in ("scheme", "host", "section")), mode="match", pattern="^(https?)://([^/]+)(/[a-z]+)?", encoding="utf8")
    frame = FlatFrame.from_df(spark.read.parquet(f"{sf_dir}/pages.parquet"), "url", "page_id", profile)
    return frame.numbered.withColumnRenamed("_row", "page_id")


@_query("regex_no_match_kept", "SELECT event_id, regexp_extract(props, '\"k\": ([0-9]{2})\\}', 1) AS k FROM events")
def regex_no_match_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = Profile((ColumnDef("k"),), mode="match", pattern=r'"k": ([0-9]{2})\}')
    frame = FlatFrame.from_df(spark.read.parquet(f"{sf_dir}/events.parquet"), "props", "event_id", profile)
    return frame.numbered.withColumnRenamed("_row", "event_id")


@_query("filters_contains", f"SELECT * FROM ({_C}) WHERE contains(lower(NAME), 'r#0') AND starts_with(lower(SEG), 'b') AND BAL > 1000.5")
def filters_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = (ColumnFilter("NAME", "contains", "R#0"), ColumnFilter("SEG", "startsWith", "b"), ColumnFilter("BAL", "gt", "1000,5"), ColumnFilter("CUST", "lt", ""))
    return customer(spark, sf_dir).filter(*boxes).typed(row=False)


@_query("filters_ends_regex", f"SELECT * FROM ({_P}) WHERE ends_with(lower(TYPE), 'my') AND regexp_matches(BRAND, '(?i)brand#[145]') AND SIZE <> 10 AND SIZE <= 40")
def filters_ends_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = (ColumnFilter("BRAND", "regex", "brand#[145]"), ColumnFilter("SIZE", "notEquals", "10"), ColumnFilter("TYPE", "endsWith", "My"), ColumnFilter("SIZE", "lte", "40"))
    return part(spark, sf_dir).filter(*boxes).typed(row=False)


@_query("filters_numeric", f"SELECT * FROM ({_E}) WHERE VALUE >= 12.5 AND VALUE < 80 AND TYPE = 'click'")
def filters_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = (ColumnFilter("VALUE", "gte", "12,5"), ColumnFilter("VALUE", "lt", "80"), ColumnFilter("TYPE", "equals", "click"))
    return events(spark, sf_dir).filter(*boxes).typed(row=False)


@_query("filters_empty", f"SELECT * FROM ({_E}) WHERE VALUE IS NULL AND TYPE IS NOT NULL")
def filters_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(ColumnFilter("VALUE", "empty"), ColumnFilter("TYPE", "notEmpty")).typed(row=False)


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/ledgerline/flat-{uuid.uuid4().hex}"


@_query("text_file_rows", "SELECT c_custkey::DOUBLE AS CUST, c_acctbal AS BAL, (c_custkey - 1)::BIGINT AS at FROM customer WHERE c_acctbal > 1000")
def text_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as lines in key order and read back; row numbers follow the file."""
    path = _scratch(spark)
    records = customer(spark, sf_dir).records
    low = records.agg(F.min("_row")).first()[0] or 0
    records.orderBy("_row").select(F.col("value").cast("string")).write.text(path)
    frame = FlatFrame.open(spark, path, CUSTOMER).select("CUST", "BAL").where(field("BAL") > 1000)
    return frame.typed().select("CUST", "BAL", (F.col("_row") + (low - 1)).alias("at"))


@_query("fixed_length_rows", "SELECT s_suppkey::DOUBLE AS SUPP, s_name AS NAME, s_acctbal AS BAL FROM supplier WHERE s_acctbal < 5000")
def fixed_length_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as records of 49 bytes and a line feed, read back as 50 bytes each."""
    path = _scratch(spark)
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    record = F.concat(_digits(F.col("s_suppkey"), 10), _text(F.col("s_name"), 25), _money(F.col("s_acctbal")))
    df.select(record.alias("value")).write.text(path)
    frame = FlatFrame.open(spark, path, SUPPLIER)
    return frame.where(field("BAL") < 5000).typed(row=False)


@_query("csv_roundtrip", "SELECT p_name AS NAME, p_brand AS BRAND, p_type AS TYPE FROM part")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    part(spark, sf_dir).select("NAME", "BRAND", "TYPE").write_csv(path)
    return spark.read.option("header", True).option("escape", '"').schema("NAME string, BRAND string, TYPE string").csv(path)


@_query("jsonl_roundtrip", "SELECT p_name AS NAME, lpad(p_size::VARCHAR, 4, '0') AS SIZE FROM part")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    part(spark, sf_dir).select("NAME", "SIZE").write_jsonl(path)
    return spark.read.schema("NAME string, SIZE string").json(path)


# ---- framing of files: ends of lines, blank lines, marks, tails, several files


def _lines(spark: SparkSession, df: DataFrame, sep: str = "\n", order: str = "at") -> str:
    """A folder of one file of the column ``value`` in this order."""
    path = _scratch(spark)
    df.coalesce(1).sortWithinPartitions(order).select("value").write.option("lineSep", sep).text(path)
    return path


def _nations(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("at"), value.alias("value"))


NAMES = Profile.fixed(_both("NAME", 0, 40))
_LAST = "n_nationkey = (SELECT max(n_nationkey) FROM nation)"


@_query("crlf_lines", "SELECT n_nationkey::BIGINT AS at, n_name AS \"NAME\" FROM nation WHERE n_name <> 'none'")
def crlf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines end in CR LF; the CR is no part of the record."""
    path = _lines(spark, _nations(spark, sf_dir, F.concat("n_name", F.when(F.col("n_nationkey") % 3 != 1, "\r").otherwise(""))))
    return FlatFrame.open(spark, path, NAMES).where(field("NAME") != "none").numbered.withColumnRenamed("_row", "at")


@_query("blank_lines", "SELECT n_nationkey::BIGINT AS at, CASE WHEN n_nationkey % 4 <> 2 THEN n_name ELSE '' END AS \"NAME\" FROM nation")
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, _nations(spark, sf_dir, F.when(F.col("n_nationkey") % 4 != 2, F.col("n_name")).otherwise("")))
    return FlatFrame.open(spark, path, NAMES).numbered.withColumnRenamed("_row", "at")


@_query("mark_and_tail", f"SELECT n_nationkey::BIGINT AS at, n_name || CASE WHEN {_LAST} THEN '|' ELSE '' END AS \"NAME\" FROM nation")
def mark_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte order mark before the first line, and no end after the last."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x.n_name), "\n")
    table = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.concat(F.lit("\ufeff"), names).alias("value"), F.lit(0).alias("at"))
    return FlatFrame.open(spark, _lines(spark, table, "|"), NAMES).numbered.withColumnRenamed("_row", "at")


@_query("record_offsets", "SELECT n_nationkey::BIGINT AS at, n_name AS \"NAME\", (sum(strlen(n_name) + 2) OVER (ORDER BY n_nationkey) - strlen(n_name) - 2)::BIGINT AS byte FROM nation")
def record_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, _nations(spark, sf_dir, F.concat("n_name", F.lit("\r"))))
    return FlatFrame.open(spark, path, NAMES).located().withColumnsRenamed({"_row": "at", "_offset": "byte"})


@_query("malformed_utf8", "SELECT c_custkey::BIGINT AS at, c_name || chr(65533) || c_mktsegment AS \"TEXT\" FROM customer")
def malformed_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat(F.encode("c_name", "UTF-8"), F.lit(b"\xff"), F.encode("c_mktsegment", "UTF-8"))
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", payload.alias("record"))
    frame = FlatFrame.from_df(table, "record", "c_custkey", Profile.fixed(_both("TEXT", 0, 60), encoding="utf8"))
    return frame.numbered.withColumnRenamed("_row", "at")


@_query("several_files", "SELECT c_custkey::DOUBLE AS CUST, (row_number() OVER (ORDER BY CASE WHEN c_custkey % 10 = 0 THEN 0 WHEN c_custkey % 10 < 7 THEN 1 ELSE 2 END, c_custkey) - 1)::BIGINT AS at FROM customer")
def several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files of a tenth, six tenths and three tenths of the rows, numbered in the order given."""
    records = customer(spark, sf_dir).records.select(F.col("_row").alias("at"), F.col("value").cast("string").alias("value"))
    rest = F.col("at") % 10
    paths = [_lines(spark, records.where(part)) for part in (rest == 0, (rest > 0) & (rest < 7), rest >= 7)]
    return FlatFrame.open(spark, paths, CUSTOMER).select("CUST").typed().withColumnRenamed("_row", "at")


@_query("file_row_window", "SELECT c_custkey::DOUBLE AS CUST, c_name AS NAME FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 60")
def file_row_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, customer(spark, sf_dir).records.select(F.col("_row").alias("at"), F.col("value").cast("string").alias("value")))
    return FlatFrame.open(spark, path, CUSTOMER).rows(60, 50).select("CUST", "NAME").typed(row=False)


_S = "SELECT s_suppkey::DOUBLE AS SUPP, s_name AS NAME, s_acctbal AS BAL FROM supplier"


def _supplier_file(spark: SparkSession, sf_dir: str) -> str:
    """Records of 49 bytes and one more that ends no line."""
    record = F.concat(_digits(F.col("s_suppkey"), 10), _text(F.col("s_name"), 25), _money(F.col("s_acctbal")))
    return _lines(spark, spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("at"), record.alias("value")), "#")


@_query("sniffed_records", f"{_S} WHERE s_acctbal >= 5000")
def sniffed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file without line feeds is read by its record length."""
    frame = FlatFrame.open(spark, _supplier_file(spark, sf_dir), replace(SUPPLIER, line_ending="auto"))
    return frame.where(field("BAL") >= 5000).typed(row=False)


@_query("fixed_length_window", f"{_S} ORDER BY s_suppkey LIMIT 5 OFFSET 3")
def fixed_length_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of rows, read from its byte range alone."""
    return FlatFrame.open(spark, _supplier_file(spark, sf_dir), SUPPLIER).rows(3, 5).typed(row=False)


@_query("sample_head", "SELECT rank - 1 AS at, raw FROM (SELECT row_number() OVER (ORDER BY event_id) AS rank, raw FROM (" + _RAW + ")) WHERE rank <= 25")
def sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_lines(spark, sf_dir).sample(25)
    return spark.createDataFrame(list(enumerate(found)), "at long, raw string")


@_query("go_to", f"SELECT * FROM ({_O}) WHERE \"ORDER\" = 100")
def go_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).go_to(101).typed(row=False)


@_query("result_cap", f"SELECT *, true AS truncated FROM ({_O}) WHERE STATUS = 'F' ORDER BY \"ORDER\" LIMIT 40")
def result_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, truncated = orders(spark, sf_dir).where(field("STATUS") == "F").capped(40)
    return cut.typed(row=False).withColumn("truncated", F.lit(truncated))


@_query("change_stamps", "SELECT (count(*) * 57)::BIGINT AS bytes, true AS stamped FROM customer")
def change_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    customer(spark, sf_dir).records.select(F.col("value").cast("string")).write.text(path)
    return file_stamps(spark, path).agg(F.sum("size").alias("bytes"), F.bool_and(F.col("modified").isNotNull()).alias("stamped"))


@_query("exported_file", f"SELECT CUST, NAME, SEG FROM (SELECT lpad(CUST::BIGINT::VARCHAR, 10, '0') AS CUST, NAME, SEG, BAL FROM ({_C})) WHERE BAL > 2000")
def exported_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}.csv"
    customer(spark, sf_dir).where(field("BAL") > 2000).select("CUST", "NAME", "SEG").export(path)
    return spark.read.option("header", True).option("escape", '"').schema("CUST string, NAME string, SEG string").csv(path)


@_query("saved_profile", f"SELECT CUST, BAL FROM ({_C}) WHERE BAL < 0")
def saved_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = customer(spark, sf_dir).with_profile(Profile.from_json(CUSTOMER.to_json()))
    return frame.where(field("BAL") < 0).select("CUST", "BAL").typed(row=False)


# ---- what is refused, suggested and told


def _refused(run: Callable[[], object]) -> str:
    try:
        run()
    except (QueryError, LayoutError, SourceError) as why:
        return why.code
    return "accepted"


@_query("refusals", "SELECT * FROM (VALUES ('column against column', 'QUERY_SEMANTIC'), ('bare column', 'QUERY_SEMANTIC'), ('order without limit', 'QUERY_SEMANTIC'), ('offset without limit', 'QUERY_SEMANTIC'), ('negative limit', 'QUERY_SEMANTIC'), ('empty list', 'QUERY_SEMANTIC'), ('unknown column', 'QUERY_SEMANTIC'), ('text for a number', 'QUERY_SEMANTIC'), ('pattern', 'QUERY_SYNTAX'), ('column without length', 'SCHEMA_INVALID'), ('no file', 'FILE_UNREADABLE'), ('statement', 'accepted')) t(what, code)")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = orders(spark, sf_dir)
    cases: dict[str, Callable[[], object]] = {
        "column against column": lambda: field("STATUS") == field("PRIORITY"),
        "bare column": lambda: bool(field("STATUS") == "F"),
        "order without limit": lambda: frame.query(order_by="TOTAL"),
        "offset without limit": lambda: frame.query(offset=3),
        "negative limit": lambda: frame.limit(-1),
        "empty list": lambda: field("STATUS").isin(),
        "unknown column": lambda: frame.where(field("STATE") == "F"),
        "text for a number": lambda: frame.where(field("TOTAL") > "much"),
        "pattern": lambda: field("STATUS").matches("("),
        "column without length": lambda: Profile.fixed(ColumnDef("A", 0, 0)),
        "no file": lambda: FlatFrame.open(spark, f"{_scratch(spark)}/none.dat", SUPPLIER),
        "statement": lambda: frame.query(["status"], field("TOTAL") > 5, "TOTAL", limit=3),
    }
    return spark.createDataFrame([(what, _refused(run)) for what, run in cases.items()], "what string, code string")


@_query("suggestions", "SELECT * FROM (VALUES ('TOTL', 'TOTAL'), ('total_price', 'TOTAL'), ('STATIS', 'STATUS'), ('PRIO', 'PRIORITY'), ('ORDERS', 'ORDER'), ('CUSTOMER', NULL)) t(wrong, near)")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [c.name for c in ORDERS.columns]
    return spark.createDataFrame([(w, nearest(w, known)) for w in ("TOTL", "total_price", "STATIS", "PRIO", "ORDERS", "CUSTOMER")], "wrong string, near string")


@_query("told", "SELECT 'SELECT * WHERE SEG ILIKE ''b%'' AND BAL > 12.5 AND NAME IS NOT NULL' AS sql, 'SEG,BAL,NAME' AS columns, 'filter · block prefilter \"BUILDING\" · top-5 by BAL' AS plan")
def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters as a statement, the columns that a condition names, and what a frame was asked for."""
    boxes = (ColumnFilter("SEG", "startsWith", "b"), ColumnFilter("BAL", "gt", "12,5"), ColumnFilter("NAME", "notEmpty"))
    columns = ((field("SEG") == "BUILDING") & ((field("BAL") > 5) | ~field("NAME").is_null())).columns
    frame = customer(spark, sf_dir).where((field("SEG") == "BUILDING") & (field("BAL") > 5)).top(5, "bal")
    return spark.createDataFrame([(filters_to_sql(boxes), ",".join(columns), frame.describe())], "sql string, columns string, plan string")
