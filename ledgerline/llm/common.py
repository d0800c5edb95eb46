"""What the operators share: tables of a corpus, scratch tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python, so that long rows cannot fill a worker.
BATCH_BYTES = 4 << 20
#: Bytes of a table that is broadcast at most, by its rows written as JSON; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20
#: Scripts, styles and comments of HTML, up to the end of the page where they never close.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark from wherever ``sf_dir`` is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "2147483647") in (None, "2147483647"):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="ledgerline-")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    This cuts lineage so that a lost executor costs a re-read, not a recomputation,
    and several readers share one computation. Tables stay for the life of the
    folder, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a materialized table, marked for broadcast if its measured bytes are few."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df
