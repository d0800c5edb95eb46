"""MinHash near-duplicate detection with odd sketches (operator 3).

1. Every text becomes its set of distinct word shingles (64-bit hashes), and from it 32
   band keys of 4 MinHash samples each, and an odd sketch: one-permutation MinHash (the
   least value of each of 8,192 bins) folded into a bitmap in which each sample flips
   one bit. Texts with equal sets form a class; its smallest id stands for it.
2. Every band bucket has a head, drawn by a hash of the bucket and the id, so a class of
   a large group meets a different head in each bucket. The population count of the XOR
   of two sketches estimates similarity; each class's best head is confirmed on both
   full shingle sets. This joins all but a few of a group.
3. Buckets that still hold several components draw further heads from their largest one
   for the members outside it, as long as each turn cuts the pairs left by a fifth.
4. What is left is finished exactly: the members outside the bucket's largest component
   against all others of another component. Either in salted blocks, by sketch; or by
   prefixes: texts of that similarity share one of the rarest shingles of both, of which a
   quarter of the set and one more need be looked at, so families that share most of a
   text and are not similar make no pairs. Both find every link; prefixes are tried where
   pairs outnumber the members' shingles by far, and taken if they make fewer pairs. Pairs
   inside one component are never made.
5. Components come from contraction joins.

Two documents of similarity 0.75 share a band with probability 1 - 5e-6, and the
sketch's margin is five standard deviations, so recall is that of an exact join for
practical purposes; precision is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_batches, materialize, small, table
from ledgerline.llm.components import connected_components
from ledgerline.llm.textbatch import Words, chunks, mix, ragged, text_buffers

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 32, 4
#: Bins of the one-permutation samples, and bits of the bitmap they are folded into.
BINS, SKETCH_BITS = 8192, 2048
#: Members of one block of a bucket that is compared pair by pair, and rows of blocks in one group.
BLOCK, CELL_ROWS = 1024, 8192
#: Pairs of a block that cost as much as one shingle on its way through two shuffles.
PAIRS_PER_SHINGLE = 20
#: Turns of further heads at most, and pairs left from which the exact finish is cheaper than a turn.
TURNS, FINISH_PAIRS = 8, 200_000

_SAMPLES = BANDS * ROWS
_LONGS = SKETCH_BITS // 64
_rng = np.random.default_rng(7)
_MULT = _rng.integers(0, 1 << 32, size=(_SAMPLES, 1), dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, size=(_SAMPLES, 1), dtype=np.uint32)
_BAND_MULT = _rng.integers(1, 1 << 63, size=(BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND_SALT = _rng.integers(1, 1 << 63, size=BANDS, dtype=np.uint64)

SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary, n_samples long"


def similar(sizes: np.ndarray, samples: np.ndarray, apart: np.ndarray, percent: int = THRESHOLD_PERCENT) -> np.ndarray:
    """Which pairs can have the similarity, from both sets' sizes, samples and differing bits.

    ``sizes`` and ``samples`` are (2 x pairs). The sets' union is at most (n + n2) / (1 + J);
    its samples fill U bins, of which J match, less five deviations of that sampling (next
    to none while every shingle has its own bin). The other samples, d in all, flip bits:
    at most d end odd, and as good as never more than bits / 2 * (1 - exp(-2d / bits))
    plus five deviations of that.
    """
    j, bits = percent / 100, SKETCH_BITS
    union = np.maximum(sizes.sum(axis=0) / (1 + j), 1)
    filled = BINS * -np.expm1(-union / BINS)
    spread = np.sqrt(j * (1 - j) * filled * np.maximum(1 - filled / union, 0) + 0.1)
    differ = np.maximum(samples.sum(axis=0) - 2 * j * filled + 10 * spread, 0)
    odd = bits / 2 * -np.expm1(-2 * differ / bits)
    spread = np.sqrt(np.maximum(bits / 4 * -np.expm1(-4 * differ / bits) - differ * np.exp(-4 * differ / bits), 1))
    return (100 * sizes.min(axis=0) >= percent * sizes.max(axis=0)) & (apart <= np.minimum(differ, odd + 5 * spread))


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows x longs) of a column of bitmaps."""
    return text_buffers(column)[0].view(np.uint64).reshape(len(column), _LONGS)


def minhash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents x samples) minima over each document's run of 32-bit values."""
    out = np.empty((len(first), _SAMPLES), dtype=np.uint32)
    ends = np.append(first[1:], len(values))
    low = 0
    while low < len(first):
        high = max(int(np.searchsorted(ends, first[low] + 4096, "right")), low + 1)
        a, b = first[low], ends[high - 1]
        if high == low + 1 and b - a > 4096:
            best = np.full(_SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
            for c in range(a, b, 4096):
                np.minimum(best, ((values[c : min(c + 4096, b)] ^ _XOR) * _MULT).min(axis=1), out=best)
            out[low] = best
        else:
            out[low:high] = np.minimum.reduceat((values[a:b] ^ _XOR) * _MULT, first[low:high] - a, axis=1).T
        low = high
    return out


def odd_sketch(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((documents x longs) bitmaps, numbers of samples) of runs of 32-bit values.

    A value's high bits are its bin; the least value of each bin flips one bit.
    """
    n = len(sizes)
    doc = np.repeat(np.arange(n, dtype=np.uint64), sizes)
    key = np.sort((doc << np.uint64(32)) | values.astype(np.uint64))
    bin_ = key >> np.uint64(32 - int(np.log2(BINS)))
    key = key[np.append(True, bin_[1:] != bin_[:-1])] if len(key) else key
    doc = (key >> np.uint64(32)).astype(np.int64)
    at = doc * SKETCH_BITS + (mix(key & np.uint64(0xFFFFFFFF)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    out = np.zeros((n, _LONGS), dtype=np.int64)
    step = 256
    ends = np.searchsorted(doc, np.arange(0, n + step, step))
    for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        rows = min(step, n - k * step)
        odd = np.bincount(at[low:high] - k * step * SKETCH_BITS, minlength=rows * SKETCH_BITS) & 1
        out[k * step : k * step + rows] = np.packbits(odd.astype(bool).reshape(rows, SKETCH_BITS), axis=1).view(np.int64)
    return out, np.bincount(doc, minlength=n)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            n = high - low
            doc, value = Words(data, offsets, fold=True).shingles(SHINGLE_WORDS)
            sizes = np.bincount(doc, minlength=n)
            full = np.flatnonzero(sizes)
            first = (np.cumsum(sizes) - sizes)[full]
            sums = np.zeros((2, n), dtype=np.uint64)
            bands = np.zeros((n, BANDS), dtype=np.int64)
            sketch, n_samples = odd_sketch((value & np.uint64(0xFFFFFFFF)).astype(np.uint32), sizes)
            if len(full):
                sums[0, full] = np.add.reduceat(value, first)
                sums[1, full] = np.add.reduceat(mix(value + np.uint64(1)), first)
                samples = minhash((value >> np.uint64(32)).astype(np.uint32), first)
                per_band = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
                bands[full] = mix((per_band * _BAND_MULT).sum(axis=2, dtype=np.uint64) + _BAND_SALT).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, n),
                    pa.array(sizes, pa.int64()),
                    *(pa.array(s.view(np.int64)) for s in sums),
                    ragged(pa.array(bands.ravel()), np.full(n, BANDS)),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.array(n_samples),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch", "n_samples"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """One signature row per document; null and wordless texts have an empty set."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_signatures, SIGNATURE)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, common, united) from rows (a, text_a, b, text_b), on full shingle sets."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for low, high, data, offsets in chunks(column):
            doc, value = Words(data, offsets, fold=True).shingles(SHINGLE_WORDS)
            ends = np.searchsorted(doc, np.arange(high - low + 1))
            found += [value[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return found

    for batch in batches:
        heads = batch.column("a").to_numpy()
        # rows of one id may have several texts
        text_a = batch.column("text_a")
        other = pc.not_equal(text_a.slice(1), text_a.slice(0, len(text_a) - 1)).fill_null(True).to_numpy(zero_copy_only=False) if len(heads) else None
        new = np.flatnonzero(np.append(True, (heads[1:] != heads[:-1]) | other)) if len(heads) else np.zeros(0, dtype=int)
        left, right = sets(batch.column("text_a").take(pa.array(new))), sets(batch.column("text_b"))
        which = np.searchsorted(new, np.arange(len(heads)), "right") - 1
        common = np.array([len(np.intersect1d(left[k], r, assume_unique=True)) for k, r in zip(which, right, strict=True)], dtype=np.int64)
        united = np.array([len(left[k]) + len(r) for k, r in zip(which, right, strict=True)], dtype=np.int64) - common
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(common), pa.array(united)], names=["a", "b", "common", "united"]
        )


def confirm(docs: DataFrame, pairs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    ids = small(materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids"))
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "text_a", "b", "text_b")
        .mapInArrow(_confirm, "a long, b long, common long, united long")
        .where(F.col("common") * 100 >= F.col("united") * percent)
        .select("a", "b")
    )


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, head, apart) of the similar ones among rows with both sides' columns."""
    for batch in batches:
        apart = np.bitwise_count(_sketches(batch.column("sketch")) ^ _sketches(batch.column("sketch_2"))).sum(axis=1, dtype=np.int64)
        sizes, samples = (np.stack([batch.column(c).to_numpy(), batch.column(f"{c}_2").to_numpy()]) for c in ("n_shingles", "n_samples"))
        near = pa.array(similar(sizes, samples, apart, percent))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("head"), pa.array(apart)], names=["doc_id", "head", "apart"]).filter(near)


def best_heads(tries: DataFrame, sketches: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(a, b): of each document's (doc_id, head) tries, the similar one nearest by sketch."""
    other = sketches.select(F.col("doc_id").alias("head"), *(F.col(c).alias(f"{c}_2") for c in sketches.columns if c != "doc_id"))
    return (
        tries.distinct()
        .join(sketches, "doc_id")
        .join(other, "head")
        .mapInArrow(lambda rows: _near(rows, percent), "doc_id long, head long, apart long")
        .groupBy("doc_id")
        .agg(F.min_by("head", F.struct("apart", "head")).alias("head"))
        .select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b"))
        .distinct()
    )


def merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` (bucket, doc_id, component) with the components that the links (a, b) join."""
    at = placed.select("doc_id", "component").distinct()
    edges = links.join(at.toDF("a", "src"), "a").join(at.toDF("b", "dst"), "b").select("src", "dst")
    to = connected_components(edges).toDF("component", "upper")
    return placed.join(to, "component", "left").select("bucket", "doc_id", F.coalesce("upper", "component").alias("component"))


def open_buckets(placed: DataFrame) -> DataFrame:
    """(bucket, largest component, members, members outside it) of buckets with several components."""
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    found = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("members"), F.max("n").alias("inside"), F.count("*").alias("components")
    )
    return found.where("components > 1").select("bucket", "largest", "members", (F.col("members") - F.col("inside")).alias("outside"))


def _block_pairs(rows: pa.Table, percent: int) -> pa.Table:
    """The similar pairs of the blocks in these rows; each block has left and right members."""
    rows = rows.sort_by([("bucket", "ascending"), ("block", "ascending"), ("other", "ascending"), ("right", "ascending")])
    bucket, block, other, right, doc, component, size, samples, outside = (
        rows.column(c).to_numpy() for c in ("bucket", "block", "other", "right", "doc_id", "component", "n_shingles", "n_samples", "outside")
    )
    sketch = _sketches(rows.column("sketch"))
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(doc), BANDS)
    new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(other) != 0)) + 1
    found: list[np.ndarray] = []
    for low, high in zip(np.append(0, new), np.append(new, len(doc)), strict=True):
        middle = low + int(np.searchsorted(right[low:high], True))
        for k in range(low, middle):
            apart = np.bitwise_count(sketch[middle:high] ^ sketch[k]).sum(axis=1, dtype=np.int64)
            pair = lambda x, k=k, m=middle, h=high: np.stack([np.full(h - m, x[k]), x[m:h]])
            hit = similar(pair(size), pair(samples), apart, percent) & (component[middle:high] != component[k])
            # two outside members meet twice, and in every bucket that they share: told once
            hit &= ~outside[middle:high] | (doc[k] < doc[middle:high])
            hit = np.flatnonzero(hit) + middle
            if len(hit):
                same = bands[hit] == bands[k]
                hit = hit[bands[k][same.argmax(axis=1)] == bucket[k]]
                found.append(np.stack([np.full(len(hit), doc[k]), doc[hit]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return pa.table({"a": pairs.min(axis=0), "b": pairs.max(axis=0)})


def remaining_pairs(placed: DataFrame, open_: DataFrame, reps: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(a, b): every pair of an open bucket in different components with similar sketches.

    Members outside the largest component meet all others, block by block; blocks and the
    cells that hold several of them have a bounded number of rows. A pair that shares
    several buckets is told by the first of them alone.
    """

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / BLOCK).cast("int")

    def numbered(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    open_ = open_.select("bucket", "largest", blocks("members").alias("rights"), blocks("outside").alias("lefts"))
    rest = placed.join(open_, "bucket").withColumn("outside", F.col("component") != F.col("largest")).join(reps, "doc_id")
    own = lambda n: F.pmod(F.xxhash64("doc_id", "bucket"), F.col(n)).cast("int")
    left = rest.where("outside").withColumn("block", own("lefts")).withColumn("other", numbered(F.col("rights"))).withColumn("right", F.lit(False))
    right = rest.withColumn("other", own("rights")).withColumn("block", numbered(F.col("lefts"))).withColumn("right", F.lit(True))
    sides = materialize(left.unionByName(right).drop("largest", "lefts", "rights"), "open-buckets")
    cells = -(-sides.count() // CELL_ROWS)
    sides = sides.withColumn("cell", F.pmod(F.xxhash64("bucket", "block", "other"), F.lit(max(cells, 1))))
    return sides.groupBy("cell").applyInArrow(lambda rows: _block_pairs(rows, percent), "a long, b long")


def _open_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            doc, value = Words(data, offsets, fold=True).shingles(SHINGLE_WORDS)
            sizes = np.bincount(doc, minlength=high - low)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), ragged(pa.array(value.view(np.int64)), sizes)], names=["doc_id", "shingles"])


def prefixes(docs: DataFrame, placed: DataFrame, open_: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(token, doc_id, n, component, outside): the rarest shingles of the open buckets' members.

    Sets of sizes n and m of the similarity share one of the n - ceil(n percent) + 1 first
    shingles of one and as many of the other in any one order; here by how many members
    hold a shingle. Those of one member take up places, but find nobody.
    """
    rest = placed.join(open_.select("bucket", "largest"), "bucket")
    members = materialize(rest.groupBy("doc_id").agg(F.min("component").alias("component"), F.bool_or(F.col("component") != F.col("largest")).alias("outside")), "open-members")
    texts = docs.select("doc_id", "text").join(small(materialize(members.select("doc_id"), "open-ids")), "doc_id", "left_semi")
    held = materialize(texts.mapInArrow(_open_shingles, "doc_id long, shingles array<long>"), "open-shingles")
    each = held.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    counts = materialize(each.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "shingle-counts")
    common = each.join(small(counts), "token").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("common"))
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("common"))
    common = common.withColumn("places", places.cast("int")).where("places > 0")
    told = common.select("doc_id", "n", F.explode(F.slice("common", F.lit(1), F.col("places"))).alias("c")).select("doc_id", "n", "c.token")
    return materialize(told.join(members, "doc_id"), "prefixes")


def prefix_pairs(prefix: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(a, b): members of different components, one outside its bucket's largest, that share a prefix shingle and may be similar by size."""
    right = prefix.select("token", F.col("doc_id").alias("other"), F.col("n").alias("m"), F.col("component").alias("other_component"), F.col("outside").alias("other_outside"))
    found = prefix.where("outside").join(right, "token").where("component <> other_component and (not other_outside or doc_id < other)")
    found = found.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return found.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Ties and copies: equal texts share a class. Null, empty and wordless texts have no
    shingles and are their own component. Rows of one id are one node of the graph, each
    with its own n_shingles. A row without an id belongs to the component of an equal
    text, if there is one; else its component_id is null and it is kept. Columns besides
    doc_id and text are ignored.
    """
    signed = materialize(signatures(docs), "signatures")
    sets = ["n_shingles", "set_a", "set_b"]
    # most texts have no equal: only classes of several go back to their members
    classes = signed.where("n_shingles > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = small(materialize(classes, "classes"))
    member = materialize(
        signed.select("doc_id", *sets).join(classes, sets, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members"
    )
    reps = signed.where("n_shingles > 0").join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    reps = reps.select("doc_id", "n_shingles", "n_samples", "sketch", "bands")
    sketches = reps.drop("bands")

    def drawn(members: DataFrame, turn: int) -> DataFrame:
        """A head of each bucket, by a hash of the bucket, the id and the turn."""
        return members.groupBy("bucket").agg(F.min_by("doc_id", F.xxhash64("doc_id", "bucket", F.lit(turn))).alias("head"), F.count("*").alias("n"))

    # 2. each class's best head
    bucket = reps.select("doc_id", F.explode("bands").alias("bucket"))
    heads = materialize(drawn(bucket, 0).where("n > 1").select("bucket", "head"), "heads")
    buckets = materialize(bucket.join(heads, "bucket"), "buckets")
    pairs = materialize(best_heads(buckets.where("doc_id <> head").select("doc_id", "head"), sketches, percent), "pairs")
    placed = materialize(merged(buckets.select("bucket", "doc_id", F.col("doc_id").alias("component")), confirm(docs, pairs, percent)), "placed")

    # 3. further heads, from each open bucket's largest component
    work = None
    for turn in range(1, TURNS + 1):
        open_ = materialize(open_buckets(placed), "open")
        left = open_.agg(F.sum(F.col("members") * F.col("outside"))).first()[0] or 0
        if left <= FINISH_PAIRS or (work is not None and left > 0.8 * work):
            break
        work = left
        inside = placed.join(open_.select("bucket", F.col("largest").alias("component")), ["bucket", "component"], "left_semi")
        tries = placed.join(open_.select("bucket", "largest"), "bucket").where("component <> largest").join(drawn(inside, turn).drop("n"), "bucket")
        pairs = materialize(best_heads(tries.select("doc_id", "head"), sketches, percent), "pairs")
        placed = materialize(merged(placed, confirm(docs, pairs, percent)), "placed")

    # 4. what still is apart, exactly
    open_ = materialize(open_buckets(placed), "open")
    blocks = open_.agg(F.sum(F.col("members") * F.col("outside"))).first()[0] or 0
    prefix, shared = None, blocks
    shingles = placed.join(small(materialize(open_.select("bucket"), "open-buckets")), "bucket", "left_semi").select("doc_id").distinct().join(reps, "doc_id") if blocks > FINISH_PAIRS else None
    if shingles is not None and blocks > PAIRS_PER_SHINGLE * (shingles.agg(F.sum("n_shingles")).first()[0] or 0):
        prefix = prefixes(docs, placed, open_, percent)
        loads = prefix.groupBy("token").agg((F.count_if("outside") * F.count("*")).alias("pairs"))
        shared = loads.agg(F.sum("pairs")).first()[0] or 0
    pairs = prefix_pairs(prefix, percent) if prefix is not None and shared < blocks else remaining_pairs(placed, open_, reps, percent)
    pairs = materialize(pairs, "pairs")
    if not pairs.isEmpty():
        placed = merged(placed, confirm(docs, pairs, percent))
    parts = placed.select(F.col("doc_id").alias("rep"), "component").distinct()
    return (
        member.join(parts, "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def keep_one_of_each(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The documents that stand for their near-duplicate component, all columns kept; rows without an id are kept."""
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct("*").alias("row"))
    named = rows.where("row.doc_id is not null").join(kept, F.col("row.doc_id") == F.col("kept_id"), "left_semi")
    return named.unionByName(rows.where("row.doc_id is null")).select("row.*")


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_minhash_near_dup": op3_minhash_near_dup}
#: Components of a similarity graph: tested against brute force instead.
SQL: dict[str, str] = {}
