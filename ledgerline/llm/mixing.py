"""Mixing sources to target weights by capped water-filling (operator 4).

Sources share the total size by weight; a source's target stops at ``epochs`` times its
own size and the excess is shared again by weight until no target is above its cap.
Each source then repeats all its documents floor(target / size) times and takes the rest
from a seeded order of its documents: a place from 0 to 2**62, drawn by the id. Places
below the source's cut are taken once more, those above are not. The cut is found from
sums over ranges of places, each level 4,096 times finer, until so few documents are left
in the range that holds it that they are chosen one by one. So every row tells by its own
place how often it is taken, and only rows in those last ranges are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, small, table

EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = 20240501
#: Different documents from which on a range is cut into finer ones.
GROUP_DOCS = 512
PLACE_BITS, LEVEL_BITS = 62, 12


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source_size, weight, ...) with the column ``target``.

    The level is the words a weight of 1 receives. Raising it clamps more sources at
    their caps, which raises it again for the others; it stops when none is new.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        capped = F.col("source_size") * epochs <= F.col("weight") * F.lit(level)
        fixed, open_ = sources.agg(
            F.sum(F.when(capped, F.col("source_size") * epochs).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        raised = (total - fixed) / open_ if open_ else level
        if raised <= level or not open_:
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(epochs)), F.col("weight") * F.lit(max(level, 0.0))))


def source_key(source: Column) -> Column:
    """A source as a text that is never null and sorts like it, null last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def place_of(doc_id: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 64 - PLACE_BITS)


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, from 0 by ``name``: counts of sorted ranges, not one window over all."""
    parts = materialize(sources.repartitionByRange("name").withColumn("part", F.spark_partition_id()), "ranges")
    counts = sorted(parts.groupBy("part").count().collect())
    before = F.lit(0)
    for k, (part, _) in enumerate(counts):
        before = F.when(F.col("part") == part, sum(n for _, n in counts[:k])).otherwise(before)
    return parts.withColumn("rank", before + F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1).drop("part")


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """How many rows of each (place, size) fit what is left of the target, in order of place."""
    rows = rows.sort_values(["place", "size"], kind="stable")
    left = float(rows["left"].iloc[0])
    extra = []
    for size, n in zip(rows["size"].tolist(), rows["n"].tolist(), strict=True):
        extra.append(min(n, int(left // size)) if size else 0)
        left -= size * extra[-1]
    rows["extra"] = extra
    over = rows[(rows["extra"] < rows["n"]) & (rows["size"] > 0) & (rows["size"] < 2 * left)]
    if len(over):  # one more document comes nearer than none
        rows.loc[(over["size"] - left).abs().idxmin(), "extra"] += 1
    return rows[["name", "place", "size", "extra"]]


def cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` (name, wanted, source_docs, ...) with ``low`` and ``high``: places below low are taken, from high on not."""
    some = F.col("wanted") > 0
    state = sources.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.when(some, F.lit(1 << PLACE_BITS)).otherwise(F.lit(0)).cast("long"))
    state = materialize(state.withColumn("left", F.col("wanted")).withColumn("docs", F.when(some, F.col("source_docs")).otherwise(0)), "cuts")
    shift = PLACE_BITS
    while shift > LEVEL_BITS and not state.where(F.col("docs") > GROUP_DOCS).isEmpty():
        shift -= LEVEL_BITS
        open_ = small(state.where(F.col("docs") > GROUP_DOCS).select("name", "low", "high", "left"))
        inside = sized.join(open_, "name").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
        sums = inside.groupBy("name", "left", F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("rest", F.col("left") - before).where("rest > 0")
        cut = F.col("rest") < F.col("words")
        found = sums.groupBy("name").agg(
            F.max(F.when(cut, F.col("bin"))).alias("cut"), F.max(F.when(~cut, F.col("bin"))).alias("whole_bin"),
            F.max(F.when(cut, F.col("rest"))).alias("rest"), F.max(F.when(cut, F.col("n"))).alias("n"),
        )
        to = lambda c: F.shiftleft(c, shift)
        found = found.select(
            "name", F.coalesce(to(F.col("cut")), to(F.col("whole_bin") + 1)).alias("new_low"), to(F.col("cut") + 1).alias("new_high"), "rest", F.coalesce("n", F.lit(0)).alias("n")
        )
        was = state.join(found, "name", "left")
        new = F.col("new_low").isNotNull()
        state = materialize(
            was.withColumn("low", F.coalesce("new_low", "low"))
            .withColumn("high", F.when(new, F.coalesce("new_high", "new_low")).otherwise(F.col("high")))
            .withColumn("left", F.when(new, F.coalesce("rest", F.lit(0.0))).otherwise(F.col("left")))
            .withColumn("docs", F.coalesce("n", "docs"))
            .select(*state.columns),
            "cuts",
        )
    return state


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """From (name, place, size) rows: the sources with target, whole, low and high; and
    (name, place, size, extra): how many rows between low and high are taken once more."""
    sources = ranked(sized.groupBy("name").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = targets(materialize(sources.withColumn("weight", weight), "sources"), epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    sources = cuts(sized, sources.withColumn("wanted", F.when(wanted >= 0.5, wanted).otherwise(0.0)))
    inside = sized.join(small(sources.select("name", "low", "high", "left")), "name").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    inside = inside.groupBy("name", "place", "size", "left").agg(F.count("*").alias("n"))
    chosen = inside.groupBy("name").applyInPandas(_choose, "name string, place long, size long, extra long")
    return sources, materialize(chosen, "chosen")


def with_times(rows: DataFrame, sources: DataFrame, chosen: DataFrame, size: Column, tie: Column) -> DataFrame:
    """``rows`` (name, place, ...) with ``times`` and the source's columns; rows of one place and size are told apart by ``tie``."""
    joined = rows.join(small(sources.select("name", "source_size", "target", "whole", "low", "high")), "name")
    between = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    outside = joined.where(~between).withColumn("extra", F.when(F.col("place") < F.col("low"), 1).otherwise(0))
    inside = joined.where(between).withColumn("own_size", size)
    number = F.row_number().over(Window.partitionBy("name", "place", "own_size").orderBy(tie))
    inside = inside.withColumn("number", number).join(small(chosen.withColumnRenamed("size", "own_size")), ["name", "place", "own_size"])
    inside = inside.withColumn("extra", F.when(F.col("number") <= F.col("extra"), 1).otherwise(0))
    both = outside.unionByName(inside.select(*outside.columns))
    return both.withColumn("times", (F.col("whole") + F.col("extra")).cast("int"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", source_key(F.col("source")).alias("name"), place_of(F.col("doc_id"), seed).alias("place"), size_of(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of every document.

    Sources are ranked by code point, null last, and take the weights in turn. A
    source's taken words come within its smallest fitting document of its target. Null
    and wordless texts have size 0 and target 0 alone; an empty table gives no rows.
    Rows of repeated or null ids are mixed as separate rows. The result depends on ids,
    sizes, sources and the seed only.
    """
    sized = materialize(_sized(docs, seed), "sizes")
    found = with_times(sized, *plan(sized, weights, epochs), F.col("size"), F.lit(0))
    source = F.when(F.col("name") == "~", F.lit(None)).otherwise(F.expr("substring(name, 2)"))
    return found.select("doc_id", source.alias("source"), "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns, whatever their names.

    Rows of repeated or null ids are separate rows; of those with one id and size, the
    lowest hashes of the text go first.
    """
    sources, chosen = plan(materialize(_sized(docs, seed), "sizes"), weights, epochs)
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", source_key(F.col("row.source")).alias("name"), place_of(F.col("row.doc_id"), seed).alias("place"))
    taken = with_times(rows, sources, chosen, size_of(F.col("row.text")), F.xxhash64("row.text")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def op4_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_water_filling_mix": op4_water_filling_mix}
#: Seeded sampling: tested against its constraints and a plain water-filling instead.
SQL: dict[str, str] = {}
