"""Quality classifier: histogram gradient-boosted trees on document statistics (operator 1).

Statistics are computed from whole texts in batches. Trees of fixed depth are grown on
binned statistics with logistic loss and stored as flat arrays (one row per tree, nodes
in heap order), so a batch is scored by indexing alone. Labels, language, source and
ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import bound_batches, table
from ledgerline.llm.textbatch import Words, chunks, mix
from ledgerline.llm.textstats import NOISE, SOLID, SYMBOLS, Lines, _mask, per_doc, repeated_words

#: Labelled rows that one fit may use: a documented bound, drawn by a hash of the id.
FIT_ROWS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, LAMBDA, LEAST_ROWS = 60, 3, 0.2, 64, 1.0, 8

_UPPER, _LETTERS = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGITS, _STOPS, _BARS, _BANGS = _mask("0123456789"), _mask(".,;:?"), _mask("|"), _mask("!")

STATISTICS = (
    "log_words", "word_length", "longest_word", "upper", "digits", "stops", "symbols", "bars", "bangs", "noise", "wide", "bare_words",
    "repeated", "distinct", "log_lines", "line_words", "duplicate_lines", "closed_lines",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents x statistics); an empty text is all zeros."""
    words = Words(data, offsets)
    lines = Lines(words)
    n = words.n_docs
    counts, size = words.counts, np.diff(offsets)
    some, chars = np.maximum(counts, 1), np.maximum(size, 1)
    letters = np.maximum(per_doc(_LETTERS[data], offsets), 1)
    length = words.end - words.start
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, words.doc, length)
    n_lines = np.bincount(lines.doc, minlength=n)
    key = mix(words.hash + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(words.doc[np.unique(key, return_index=True)[1]], minlength=n)
    columns = (
        np.log1p(counts),
        np.bincount(words.doc, weights=length, minlength=n) / some,
        longest,
        per_doc(_UPPER[data], offsets) / letters,
        per_doc(_DIGITS[data], offsets) / chars,
        per_doc(_STOPS[data], offsets) / some,
        per_doc(SYMBOLS[data], offsets) / some,
        per_doc(_BARS[data], offsets) / some,
        per_doc(_BANGS[data], offsets) / some,
        per_doc(NOISE[data], offsets) / some,
        per_doc(data > 127, offsets) / chars,
        np.bincount(lines.doc, weights=lines.bare(), minlength=n) / some,
        repeated_words(words) / some,
        distinct / some,
        np.log1p(n_lines),
        counts / np.maximum(n_lines, 1),
        lines.duplicates() / np.maximum(n_lines, 1),
        np.bincount(lines.doc, weights=lines.terminal(), minlength=n) / np.maximum(n_lines, 1),
    )
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


@dataclass(frozen=True)
class Trees:
    """Flat trees: inner nodes by heap number, then one value per leaf."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Grow the trees; one class alone, or no rows, give its smoothed share as the score."""
    share = (y.sum() + 1) / (len(y) + 2)
    inner = 2**DEPTH - 1
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(x) else x.astype(int)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(x), bias)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            if len(own):
                feature[k], cut = _split(binned[own], g[own], h[own])
                if cut >= 0:
                    threshold[k] = edges[feature[k]][cut]
            node[own] = 2 * k + 1 + (x[own, feature[k]] > threshold[k])
        leaf = node - inner
        sums = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = -RATE * sums[0] / (sums[1] + LAMBDA)
        margin += value[leaf]
        grown.append((feature, threshold, value))
    pick = lambda k, shape, kind: np.stack([t[k] for t in grown]) if grown else np.zeros(shape, dtype=kind)
    return Trees(bias, pick(0, (0, inner), np.int64), pick(1, (0, inner), float), pick(2, (0, inner + 1), float))


def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """(statistic, bin) of the best cut by gain; bin -1 if none helps."""
    best = (0.0, 0, -1)
    whole = g.sum() ** 2 / (h.sum() + LAMBDA)
    for j in range(binned.shape[1]):
        gl, hl, nl = (np.cumsum(np.bincount(binned[:, j], weights=w, minlength=BINS))[:-1] for w in (g, h, np.ones(len(g))))
        gain = gl**2 / (hl + LAMBDA) + (g.sum() - gl) ** 2 / (h.sum() - hl + LAMBDA) - whole
        gain[(nl < LEAST_ROWS) | (len(g) - nl < LEAST_ROWS)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), j, k)
    return best[1], best[2]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            found = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality").slice(low, high - low), pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))],
                names=["quality", "statistics"],
            )


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents that are not held out.

    The sample is the same for the same ids: the lowest hashes of doc_id. Null labels
    are left out.
    """
    bound_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    measured = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    found = measured.mapInArrow(_measure, "quality int, statistics array<double>").toArrow()
    x = np.array(found["statistics"].to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    y = found["quality"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; fit the same trees
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every document; null and empty texts are scored too."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                score = model.score(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(score)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at or above the threshold, with their own columns."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(statistics(data, offsets)) >= threshold for _, _, data, offsets in chunks(batch.column("text"))]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality_trees": op1_quality_trees}
#: A trained model: tested by held-out accuracy and against plain tree traversal instead.
SQL: dict[str, str] = {}
