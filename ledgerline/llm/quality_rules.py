"""Line-first cleaning rules (operator 6).

Every line is judged alone; it fails if

* punctuation: it has one noise character ``#*$%&|<>!`` for every two words or more, or
  it has at most three words and no closing punctuation;
* navigation: three words in ten or more hold no letter or digit (``|``, ``»`` ...);
* boilerplate: it has at most twenty words and a phrase of site boilerplate, in English,
  German, French or Spanish.

Failed lines are removed; a document that loses more than half of its words is
rejected. The base rules reject documents of under 50 words and those mostly made of
repeated three-word runs, before the verdict of the lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import bound_batches, table
from ledgerline.llm.textbatch import Words, chunks
from ledgerline.llm.textstats import NOISE, SYMBOLS, Lines, per_doc, phrase_pattern, repeated_words

LEAST_WORDS, REPEAT_PERCENT, LOSS_PERCENT = 50, 50, 50

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_lines_removed long, n_words_removed long, base_failed boolean, kept boolean, text string"
)


def failing(lines: Lines) -> np.ndarray:
    """Which lines fail a rule."""
    n = lines.n_words
    noise = 2 * lines.count(NOISE[lines.words.data]) >= n
    fragment = (n <= 3) & ~lines.terminal()
    navigation = 10 * lines.bare() >= 3 * n
    return noise | fragment | navigation | ((n <= 20) & lines.boilerplate())


def _judge(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            words = Words(data, offsets)
            lines = Lines(words)
            bad = failing(lines)
            total = words.counts
            lost = np.bincount(lines.doc, weights=lines.n_words * bad, minlength=high - low).astype(np.int64)
            repeats = repeated_words(words)
            base_failed = (total < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * total)
            kept = ~base_failed & (100 * lost <= LOSS_PERCENT * total)
            inside = np.zeros(len(data) + 1, dtype=np.int8)
            inside[words.start] += 1
            inside[words.end] -= 1
            point = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
            count = lambda doc: np.bincount(doc, minlength=high - low)
            text: list[str | None] = [None] * (high - low)
            if with_text:
                good = np.flatnonzero(~bad)
                held: list[list[bytes]] = [[] for _ in text]
                for d, a, b in zip(lines.doc[good].tolist(), lines.start[good].tolist(), lines.end[good].tolist(), strict=True):
                    held[d].append(data[a:b].tobytes())
                text = [b"\n".join(x).decode("utf-8", "replace") for x in held]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    *(
                        pa.array(x.astype(np.int64))
                        for x in (total, per_doc(point, offsets), per_doc(SYMBOLS[data], offsets), lines.duplicates(), repeats, count(lines.doc), count(lines.doc[bad]), lost)
                    ),
                    pa.array(base_failed),
                    pa.array(kept),
                    pa.array(text, pa.string()),
                ],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )


def line_rules(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Counts, verdict and cleaned text (kept lines joined by a line feed) per document.

    Null, empty and wordless texts count as zero words: they fail the base rules and
    clean to an empty text. Repeated rows are judged apart; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda rows: _judge(rows, with_text), RESULT)


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules(table(spark, sf_dir, "documents"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_removed", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_line_rules": op6_line_rules}
_W = r"'[^\x20\x09-\x0D]+'"
SQL: dict[str, str] = {
    "op6_line_rules": rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents
), runs AS (
  SELECT doc_id, pos, array_to_string(w[pos : pos + 2], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS pos FROM docs WHERE len(w) >= 3)
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (
    SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n >= 2
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, regexp_extract_all(line, {_W}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
), judged AS (
  SELECT doc_id, line, len(w) AS n,
         2 * length(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) >= len(w)
         OR (len(w) <= 3 AND NOT regexp_matches(w[len(w)], '[.!?:;"'')\]…”’»。]$'))
         OR 10 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]'))) >= 3 * len(w)
         OR (len(w) <= 20 AND regexp_matches(line, '(?i){phrase_pattern().replace(chr(39), chr(39) * 2)}')) AS bad
  FROM lines WHERE len(w) > 0
), by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost FROM judged GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_words_removed
  FROM docs LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id)
)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * n_words_removed <= {LOSS_PERCENT} * n_words AS kept
FROM counts
"""
}
