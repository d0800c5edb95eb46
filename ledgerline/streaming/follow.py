"""Flat records as a stream: new files of a folder, parsed and filtered as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.cells import Cells
from ledgerline.operators.predicates import Predicate
from ledgerline.profile import Profile
from ledgerline.sources.records import without_cr


def follow(spark: SparkSession, folder: str, profile: Profile, where: Predicate | None = None) -> DataFrame:
    """A streaming DataFrame of the profile's text columns and ``_file``.

    Records are LF-separated. Row numbers and skipped header records need a whole file,
    so they do not apply to a stream.
    """
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    records = lines.select(F.col("_metadata.file_path").alias("_file"), without_cr(F.col("value").cast("binary")).alias("value"))
    cells = Cells(profile, F.col("value"))
    if where is not None:
        records = records.where(where.build(cells))
    return records.select("_file", *(cells.text(c.name).alias(c.name) for c in profile.columns))
