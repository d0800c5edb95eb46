"""Records of flat files as (_row, value): a row number and the record's bytes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.errors import SourceError
from ledgerline.profile import Profile

BOM = b"\xef\xbb\xbf"
HEAD_BYTES = 64 << 10
#: Bytes of one task over fixed-length records.
SPLIT_BYTES = 128 << 20
#: Records of one Arrow batch from them.
BATCH_RECORDS = 16_384


def line_ending(head: bytes) -> str:
    """lf or crlf by the first line feed of a file's head; none without one."""
    at = head.find(b"\n")
    return "none" if at < 0 else "crlf" if head[at - 1 : at] == b"\r" else "lf"


def without_cr(value: Column) -> Column:
    """Bytes without one trailing carriage return."""
    return F.when(F.substring(value, -1, 1) == F.lit(b"\r"), F.substring(value, 1, F.octet_length(value) - 1)).otherwise(value)


def once(value: Column) -> Column:
    """``value``, computed once a row: filters above it are not pushed below, which would repeat it for every use."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


BLOCK = ["_given", "_file", "_start"]


class Numbering:
    """Row numbers and byte offsets of a scan of lines, found when first asked for.

    Spark packs blocks of files into partitions longest first, so rows are counted by
    block: one pass counts each block's rows and bytes (a row per input split, some
    36 bytes for 128 MB), and those before are added to the rows of the scan. Both passes
    must see the same blocks in the same partitions, as two scans of the same files do.
    """

    def __init__(self, scan: DataFrame):
        self._scan = scan
        self._bases: DataFrame | None = None

    def bases(self) -> DataFrame:
        if self._bases is None:
            sums = [F.count("*").alias("n"), F.min("_at").alias("first"), F.sum("_bytes").alias("bytes"), F.max("_size").alias("size")]
            found = sorted(self._scan.groupBy(*BLOCK).agg(*sums).collect(), key=lambda r: (r["_given"], r["_file"], r["_start"]))
            whole: dict[tuple, int] = {}
            for r in found:
                whole[r["_given"], r["_file"]] = whole.get((r["_given"], r["_file"]), 0) + r["bytes"]
            rows, at, rest = 0, {}, []
            for r in found:
                file = r["_given"], r["_file"]
                if file not in at:  # lines and their ends add up to the file, but for a mark at its start and an end left out
                    at[file] = len(BOM) if whole[file] - r["size"] in (-len(BOM), 1 - len(BOM)) else 0
                rest.append((*file, r["_start"], rows - r["first"], at[file]))
                rows += r["n"]
                at[file] += r["bytes"]
            self._bases = self._scan.sparkSession.createDataFrame(rest, "_given int, _file string, _start long, _base long, _from long")
        return self._bases

    def rows(self, df: DataFrame) -> DataFrame:
        """Lines of the scan as (_row, value)."""
        return df.join(F.broadcast(self.bases()), BLOCK).select((F.col("_base") + F.col("_at")).alias("_row"), "value")

    def offsets(self) -> DataFrame:
        """(_row, _offset): where each record begins in its file."""
        before = F.sum("_bytes").over(Window.partitionBy(*BLOCK).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        placed = self._scan.select(*BLOCK, "_at", "_bytes").withColumn("before", F.coalesce(before, F.lit(0)))
        return placed.join(F.broadcast(self.bases()), BLOCK).select((F.col("_base") + F.col("_at")).alias("_row"), (F.col("_from") + F.col("before")).alias("_offset"))


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, Numbering]:
    """LF-separated records with one trailing CR taken off; blank lines are records.

    Rows are numbered by the order of the given paths, then by file path and place in
    it, once the numbers are needed: a filter alone reads the files once.
    """
    raw = F.col("value").cast("binary")
    meta = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_size").alias("_size")]
    columns = [*meta, F.monotonically_increasing_id().alias("_at"), (F.octet_length(raw) + 1).cast("long").alias("_bytes"), once(without_cr(raw)).alias("value")]
    given = [path] if isinstance(path, str) else list(path)
    scans = (spark.read.option("lineSep", "\n").text(p).select(F.lit(k).alias("_given"), *columns) for k, p in enumerate(given))
    scan = reduce(DataFrame.unionByName, scans)
    return scan, Numbering(scan)


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        found, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        found, inner = fs.LocalFileSystem(), path
    return found, inner


def expanded(path: str) -> list[str]:
    """The files of a path, in order: itself, those of a folder, or those that a last part with * ? [ ] fits.

    Names that begin with _ or . are left out of folders and patterns.
    """
    from pyarrow import fs

    found, inner = opened(path)
    info = found.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    folder, _, name = (inner.rstrip("/"), "", "*") if info.type == fs.FileType.Directory else inner.rpartition("/")
    listed = found.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    names = sorted(f.base_name for f in listed if f.is_file and f.base_name[0] not in "_." and fnmatchcase(f.base_name, name))
    if not names:
        raise SourceError(f"no file at {path}")
    base = path.rstrip("/") if info.type == fs.FileType.Directory else path.rpartition("/")[0]
    return [f"{base}/{n}" if base else n for n in names]


class _Span(InputPartition):
    def __init__(self, path: str, begin: int, first: int, count: int):
        self.path, self.begin, self.first, self.count = path, begin, first, count


class FixedRecords(DataSource):
    """Format ``flat_records``: back-to-back records of ``recordLength`` bytes.

    Options: files (a JSON list, in order) or path (one file), recordLength, and firstRow
    and rowCount for a window of rows, which reads its byte range only. ``_offset`` is
    where a record begins in its file. A leading byte order mark is skipped and a
    partial last record dropped.
    """

    @classmethod
    def name(cls) -> str:
        return "flat_records"

    def schema(self) -> str:
        return "_row bigint, _offset bigint, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _FixedReader(self.options)


class _FixedReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["files"]) if "files" in options else [options["path"]]
        self.length = int(options["recordLength"])
        self.low = int(options.get("firstRow", 0))
        self.high = self.low + int(options["rowCount"]) if "rowCount" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        spans, before = [], 0
        step = max(1, SPLIT_BYTES // self.length)
        for path in self.paths:
            found, inner = opened(path)
            with found.open_input_file(inner) as file:
                skip = len(BOM) if file.read(len(BOM)) == BOM else 0
                records = (file.size() - skip) // self.length
            low, high = max(self.low, before), before + records if self.high is None else min(self.high, before + records)
            spans += [_Span(path, skip + (k - before) * self.length, k, min(step, high - k)) for k in range(low, high, step)]
            before += records
        return spans

    def read(self, partition: _Span):
        import numpy as np
        import pyarrow as pa

        found, inner = opened(partition.path)
        with found.open_input_file(inner) as file:
            file.seek(partition.begin)
            for at in range(0, partition.count, BATCH_RECORDS):
                n = min(BATCH_RECORDS, partition.count - at)
                data = file.read(n * self.length)
                values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.length), n, [None, pa.py_buffer(data)])
                rows, offsets = (pa.array(np.arange(at, at + n) * step + first) for step, first in ((1, partition.first), (self.length, partition.begin)))
                yield pa.RecordBatch.from_arrays([rows, offsets, values.cast(pa.binary())], names=["_row", "_offset", "value"])


def read_fixed(spark: SparkSession, path: str | Sequence[str], length: int, first: int = 0, count: int | None = None) -> DataFrame:
    """Fixed-length records without terminators: all, or ``count`` of them from row ``first``.

    Paths are files, folders or patterns, one after another.
    """
    spark.dataSource.register(FixedRecords)
    files = [f for p in ([path] if isinstance(path, str) else path) for f in expanded(p)]
    reader = spark.read.format("flat_records").option("files", json.dumps(files)).option("recordLength", length).option("firstRow", first)
    if count is not None:
        reader = reader.option("rowCount", count)
    return reader.load()


def scan_records(spark: SparkSession, path: str | Sequence[str], profile: Profile) -> tuple[DataFrame, Numbering | None]:
    """The records of files as the profile frames them, and what numbers them if they are lines."""
    if profile.line_ending == "none":
        return read_fixed(spark, path, profile.record_width), None
    return read_lines(spark, path)


def read_records(spark: SparkSession, path: str | Sequence[str], profile: Profile) -> DataFrame:
    """(_row, value) of files as the profile frames them, in order of the given paths."""
    found, numbering = scan_records(spark, path, profile)
    return numbering.rows(found) if numbering else found.select("_row", "value")


def head(path: str) -> bytes:
    """The first 64 KB of a file, or of the first of several."""
    found, inner = opened(expanded(path)[0])
    with found.open_input_file(inner) as file:
        return file.read(HEAD_BYTES)
