"""Frames of flat records: a layout over a DataFrame of record bytes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.errors import LayoutError, QueryError
from ledgerline.functions.cells import Cells
from ledgerline.operators.filters import ColumnFilter, combined
from ledgerline.operators.predicates import Predicate
from ledgerline.profile import Profile, beside, infer_columns
from ledgerline.sources import exports
from ledgerline.sources.records import BLOCK, Numbering, head, line_ending, once, read_fixed, scan_records

ROW, VALUE = "_row", "value"
SAMPLE_RECORDS, INFER_RECORDS, PAGE_ROWS = 200, 20, 2048
#: Rows of a LIMIT and its OFFSET that are sorted in every task; more are cut by counts.
SORTED_ROWS = 10_000


@dataclass(frozen=True)
class FlatFrame:
    """Lazy: every method returns a new frame, and ``df`` is what Spark will run.

    ``base`` holds the records: with ``_row``, or as lines that ``numbering`` numbers when
    a row number is first needed. ``path`` is set while the frame holds every record of
    its files; ``plan`` says what was asked of it.
    """

    base: DataFrame
    profile: Profile
    columns: tuple[str, ...] | None = None
    path: str | Sequence[str] | None = None
    numbering: Numbering | None = None
    plan: tuple[str, ...] = ()

    # ---- opening

    @classmethod
    def open(cls, spark: SparkSession, path: str | Sequence[str], profile: Profile | None = None) -> FlatFrame:
        """Files as a frame. Without a profile, the one saved beside the file is used; if
        there is none or it cannot be used, columns are inferred from the first records."""
        profile = profile or beside(path) or Profile.default()
        if profile.line_ending == "auto":
            # without a terminator or a declared length, the file is one record
            found = line_ending(head(path if isinstance(path, str) else path[0])) if profile.record_length else "lf"
            profile = replace(profile, line_ending="none" if found == "none" else "lf")
        records, numbering = scan_records(spark, path, profile)
        frame = cls(records, profile, path=path, numbering=numbering)
        return frame if profile.columns else frame.inferred()

    @classmethod
    def from_df(cls, df: DataFrame, payload: str, row: str, profile: Profile) -> FlatFrame:
        """Any table with a binary or text payload and a unique row number as a frame."""
        value = F.col(payload)
        if dict(df.dtypes)[payload] == "string":
            value = F.encode(value, "UTF-8" if profile.encoding == "utf8" else "ISO-8859-1")
        return cls(df.select(F.col(row).cast("long").alias(ROW), once(value).alias(VALUE)), profile)

    def with_profile(self, profile: Profile) -> FlatFrame:
        """The same records under another layout; framing must not change."""
        if profile.line_ending == "none" and self.profile.line_ending != "none":
            raise LayoutError(["records are framed when a file is opened; open it with this profile"])
        frame = replace(self, profile=profile.checked() if profile.columns else profile, columns=None)
        return frame if profile.columns else frame.inferred()

    def inferred(self) -> FlatFrame:
        """The columns that the first records suggest."""
        columns = infer_columns(self.sample(INFER_RECORDS), self.profile.pattern, self.profile.mode)
        return replace(self, profile=self.profile.with_columns(*columns))

    # ---- what is shown

    @property
    def records(self) -> DataFrame:
        """(_row, value)."""
        return self.numbering.rows(self.base) if self.numbering else self.base.select(ROW, VALUE)

    @property
    def cells(self) -> Cells:
        return Cells(self.profile, F.col(VALUE))

    def _names(self) -> list[str]:
        return [self.profile.column(n)[1].name for n in (self.columns or [c.name for c in self.profile.columns])]

    def _texts(self) -> list[Column]:
        return [self.cells.text(n).alias(n) for n in self._names()]

    @property
    def df(self) -> DataFrame:
        """The selected columns as trimmed text."""
        return self.base.select(*self._texts())

    @property
    def numbered(self) -> DataFrame:
        """``df`` with ``_row``."""
        return self.records.select(ROW, *self._texts())

    def typed(self, row: bool = True) -> DataFrame:
        """``_row``, unless told otherwise, and the selected columns, numeric ones as doubles (null: no number)."""
        cells = self.cells
        shown = ((cells.number(n) if self.profile.column(n)[1].numeric else cells.text(n)).alias(n) for n in self._names())
        return self.records.select(ROW, *shown) if row else self.base.select(*shown)

    def raw(self) -> DataFrame:
        """``_row`` and ``raw``: whole records as text."""
        return self.records.select(ROW, self.cells.raw().alias("raw"))

    def located(self) -> DataFrame:
        """``numbered`` with ``_offset``: where each record begins in its file, in bytes."""
        if self.numbering:
            return self.numbered.join(self.numbering.offsets(), ROW)
        if "_offset" not in self.base.columns:
            raise QueryError("records of a table have no place in a file")
        return self.base.select(ROW, "_offset", *self._texts())

    def to_view(self, name: str) -> None:
        """Register the typed columns for Spark SQL."""
        self.typed().createOrReplaceTempView(name)

    # ---- queries

    def select(self, *names: str) -> FlatFrame:
        """Columns by name in any case, in this order."""
        return replace(self, columns=tuple(self.profile.column(n)[1].name for n in names))

    def _data(self) -> DataFrame:
        """The records that queries see: those after the profile's header records."""
        skip = self.profile.skip_records
        if not skip:
            return self.base
        if self.numbering is None:
            return self.base.where(F.col(ROW) >= skip)
        return self.base.join(F.broadcast(self.numbering.bases()), BLOCK).where(F.col("_base") + F.col("_at") >= skip).select(*self.base.columns)

    def where(self, predicate: Predicate) -> FlatFrame:
        """The records that satisfy a predicate; those without a text that it needs are not even parsed."""
        found, needle = self._data(), predicate.needle(self.cells)
        told = ["filter"]
        if needle and (raw := self._needle(needle)) is not None:
            told.append(f'block prefilter "{needle}"')
            if self.profile.mode != "fixed":  # a byte range costs no more than the search
                found = found.where(F.contains(VALUE, F.lit(raw)))
        return replace(self, base=found.where(predicate.build(self.cells)), path=None, plan=(*self.plan, *told))

    def _needle(self, text: str) -> bytes | None:
        """The bytes of a text inside a record; none where decoding may have made it."""
        try:
            return None if "\ufffd" in text else text.encode("utf-8" if self.profile.encoding == "utf8" else "latin-1")
        except UnicodeEncodeError:
            return None

    def describe(self) -> str:
        """What was asked of the frame, in order."""
        return " · ".join(self.plan if "filter" in self.plan else ("full scan", *self.plan))

    def filter(self, *filters: ColumnFilter) -> FlatFrame:
        """Column filters, all of which must hold; without any value the frame stays."""
        found = combined(filters)
        return self.where(found) if found is not None else self

    def _ordered(self) -> DataFrame:
        """The records that queries see, as (_row, value)."""
        found = self._data()
        return self.numbering.rows(found) if self.numbering else found.select(ROW, VALUE)

    def limit(self, n: int, offset: int = 0) -> FlatFrame:
        """Rows by number. What is too much for a sort is cut by counts of the records in each block of the files."""
        _checked_window(n, offset)
        if self.numbering is None or n + offset <= SORTED_ROWS:
            return replace(self, base=self._ordered().orderBy(ROW).offset(offset).limit(n), path=None, numbering=None)
        # numbered once more, without those that a filter left out
        found = self._data().withColumnRenamed("_at", "_scan").withColumn("_at", F.monotonically_increasing_id())
        match = F.col("_base") + F.col("_at")
        cut = found.join(F.broadcast(Numbering(found).bases()), BLOCK).where((match >= offset) & (match < offset + n))
        return replace(self, base=cut.drop("_at").withColumnRenamed("_scan", "_at").select(*self.base.columns), path=None)

    def top(self, n: int, by: str, descending: bool = False, offset: int = 0) -> FlatFrame:
        """The first rows by one column, ties by row number.

        Numeric columns sort by value; what is no number counts as infinite, so it comes
        last ascending and first descending.
        """
        _checked_window(n, offset)
        c = self.profile.column(by)[1]
        key = self.cells.number(by) if c.numeric else self.cells.text(by)
        key = key.desc_nulls_first() if descending else key.asc_nulls_last()
        found = self._ordered().orderBy(key, F.col(ROW).asc()).offset(offset).limit(n)
        return replace(self, base=found, path=None, numbering=None, plan=(*self.plan, f"top-{n} by {c.name}"))

    def query(self, columns: Sequence[str] | None = None, where: Predicate | None = None, order_by: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0) -> FlatFrame:
        """One statement: select, where, order by with limit, limit and offset."""
        if order_by is not None and limit is None:
            raise QueryError("ORDER BY needs a LIMIT")
        if offset and limit is None:
            raise QueryError("OFFSET needs a LIMIT")
        frame = self.where(where) if where is not None else replace(self, base=self._data(), path=None)
        if order_by is not None and limit is not None:
            frame = frame.top(limit, order_by, descending, offset)
        elif limit is not None:
            frame = frame.limit(limit, offset)
        return frame.select(*columns) if columns is not None else frame

    def capped(self, most: int = 2_000_000) -> tuple[FlatFrame, bool]:
        """(the first ``most`` rows, whether there are as many or more)."""
        cut = self.limit(most)
        return cut, cut.base.count() >= most

    def rows(self, start: int, count: int) -> FlatFrame:
        """A page of rows by number, header records included; at most 2,048."""
        _checked_window(count, start)
        count = min(count, PAGE_ROWS)
        if self.path is not None and self.profile.line_ending == "none":
            found = read_fixed(self.base.sparkSession, self.path, self.profile.record_width, start, count)
        else:
            found = self.records.where((F.col(ROW) >= start) & (F.col(ROW) < start + count))
        return replace(self, base=found, path=None, numbering=None)

    def go_to(self, number: int) -> FlatFrame:
        """The row that is shown as ``number``, from 1."""
        return self.rows(number - 1, 1)

    def sample(self, n: int = 20) -> list[str]:
        """Whole records from the head."""
        found = self.records.orderBy(ROW).limit(min(n, SAMPLE_RECORDS)).select(self.cells.raw())
        return [r[0] for r in found.collect()]

    def count(self) -> int:
        return self.base.count()

    # ---- about the source

    def statistics(self) -> DataFrame:
        """One row: records and average bytes of a record."""
        return self.base.agg(F.count("*").alias("records"), F.avg(F.octet_length(VALUE)).alias("average_bytes"))

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    # ---- exports

    def write_csv(self, path: str) -> None:
        exports.write_csv(self.df, path)

    def write_jsonl(self, path: str) -> None:
        exports.write_jsonl(self.df, path)

    def export(self, path: str) -> int:
        """One local file, in row order; JSON Lines for .jsonl, else CSV."""
        return exports.write_file(self.numbered.orderBy(ROW).drop(ROW) if not self.plan else self.df, path)


def file_stamps(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of the files behind a path, to tell whether they changed."""
    meta = spark.read.format("binaryFile").load(path)
    return meta.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _checked_window(n: int, offset: int) -> None:
    if any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for x in (n, offset)):
        raise QueryError("LIMIT, OFFSET and row numbers are whole and not negative")


def concat_records(frames: Sequence[FlatFrame]) -> FlatFrame:
    """Frames of one layout, one after another; row numbers are those of each frame."""
    if len({f.profile for f in frames}) != 1:
        raise LayoutError(["frames of different layouts"])
    return replace(frames[0], base=reduce(DataFrame.unionByName, (f.records for f in frames)), path=None, numbering=None)
