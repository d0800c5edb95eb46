"""Text columns written as CSV or JSON Lines, by Spark's writers."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.errors import ExportError
from ledgerline.sources.records import expanded, opened

CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV: header, quotes only where needed and doubled inside, blanks kept."""
    df.write.options(**CSV).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON Lines: one object of strings per row."""
    df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)).write.option("ignoreNullFields", False).json(path)


def write_file(df: DataFrame, path: str) -> int:
    """One file, JSON Lines by its suffix or else CSV; the rows written.

    Spark writes the parts beside it, in order; only whole files are joined here, so no
    row passes through Python.
    """
    lines, parts = path.endswith(".jsonl"), f"{path}.parts-{uuid.uuid4().hex}"
    told = Observation()
    df = df.observe(told, F.count(F.lit(1)).alias("rows"))
    write_jsonl(df, parts) if lines else df.write.options(**(CSV | {"header": False})).csv(parts)
    files, folder = opened(path)
    try:
        with files.open_output_stream(folder) as out:
            if not lines:
                names = (f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in '",\n\r') else c for c in df.columns)
                out.write((",".join(names) + "\n").encode())
            for part in expanded(parts):
                source, inner = opened(part)
                with source.open_input_stream(inner) as one:
                    shutil.copyfileobj(one, out, 1 << 20)
        files.delete_dir(opened(parts)[1])
    except OSError as why:
        raise ExportError(f"cannot write {path}: {why}") from why
    return told.get["rows"]
