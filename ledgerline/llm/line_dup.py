"""Site-relative line deduplication (operator 2).

All DataFrame functions. A page becomes its text lines; a line's frequency is the share
of its host's pages that hold it. Lines above the boilerplate ratio, and on more than one
page, are dropped from every page of the host. A host can have at most (lines per page /
ratio) such lines, so what joins back to the pages is small, and hosts of any size are
counted by partial sums, not in one group. Lines travel as 64-bit hashes. Patterns match
to a page's end what never closes, so pages of any shape take time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import HIDDEN, materialize, small, table
from ledgerline.llm.url_filter import host

RATIO = 0.3
#: Pages of a host that must hold a line: what stands on one page alone repeats nowhere.
LEAST_HELD = 2
#: What ends a line of text in HTML.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section",
    "select", "table", "td", "th", "title", "tr", "ul",
)
_BLOCK = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:[\s/][^>]*)?(?:>|\z)"
_TAG = r"<[^>]*(?:>|\z)"


def text_lines(html: Column) -> Column:
    """The non-empty text lines of a page: block tags and line feeds end lines, other white space becomes one space."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), _TAG, "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.array_remove(F.split(F.btrim(text, F.lit(" \n")), "\n"), "")


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, least_held: int = LEAST_HELD) -> DataFrame:
    """(host, line, share) of the lines above the ratio and on ``least_held`` pages or more, by hash, from (host, hashes) rows."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    held = pages.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    held = held.where(F.col("n") >= least_held)  # most lines stand on one page: they never meet the totals
    return held.join(totals, "host").where(F.col("n") > F.col("pages") * ratio).select("host", "line", (F.col("n") / F.col("pages")).alias("share"))


def drop_site_lines(pages: DataFrame, ratio: float = RATIO, least_held: int = LEAST_HELD) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) of every page row.

    A line that a page repeats counts once for the page and is dropped everywhere.
    Hosts of any size are treated alike; the only page of a host keeps its lines. Null
    and empty pages have no lines and an empty text. Urls without a host form one site,
    the empty host. Repeated page rows count as pages; other columns are ignored.
    """
    held = materialize(pages.select("page_id", host(F.col("url")).alias("host"), text_lines(F.col("html")).alias("lines")), "page-lines")
    held = held.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    site = boilerplate_lines(held, ratio, least_held).groupBy("host").agg(F.collect_set("line").alias("site"))
    kept = F.when(F.col("site").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("site", F.xxhash64(x))))
    cleaned = held.join(small(materialize(site, "site-lines")), "host", "left")
    cleaned = cleaned.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return cleaned.select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )


def op2_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_site_lines(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_site_line_dedup": op2_site_line_dedup}
SQL: dict[str, str] = {
    "op2_site_line_dedup": rf"""
WITH held AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '{_BLOCK}', chr(10), 'g'), '{_TAG}', '', 'g'), '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'),
      ' ' || chr(10)), chr(10)), lambda x: x <> '') AS lines
  FROM pages
), totals AS (
  SELECT host, count(*) AS pages FROM held GROUP BY host
), counted AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM held) GROUP BY host, line
), site AS (
  SELECT host, list(line) AS lines FROM counted JOIN totals USING (host) WHERE n > pages * {RATIO}::DOUBLE AND n >= {LEAST_HELD} GROUP BY host
), cleaned AS (
  SELECT page_id, held.host, len(held.lines)::BIGINT AS n_lines, list_filter(held.lines, lambda x: NOT list_contains(coalesce(site.lines, []), x)) AS kept
  FROM held LEFT JOIN site ON held.host = site.host
)
SELECT page_id, host, n_lines, (n_lines - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM cleaned
"""
}
