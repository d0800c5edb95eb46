"""URL rules with redirect equivalence (operator 9).

All DataFrame functions. A rule is a host and a path prefix with a verdict; it fits its
host and all subdomains when the url's path starts with its path, and the longest rule
wins. Pages that redirect (an http-equiv refresh) or name a canonical link are aliases
of the target: components over these edges carry a block to members without a rule of
their own, unless a member is allowed explicitly. Links are resolved against the page's url
and its base element, as a browser does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import HIDDEN, materialize, table
from ledgerline.llm.components import connected_components

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: A link, meta or base tag, up to its end or that of the page.
_TAGS = r"(?is)<(?:link|meta|base)\b[^>]*"
_REL = r"""(?is)[\s"'/]rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_HREF = r"""(?is)[\s"'/]href\s*=\s*["']?([^"'\s>]+)"""
_EQUIV = r"""(?is)[\s"'/]http-equiv\s*=\s*["']?refresh\b"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_REST = r"(?s)^.*?://[^/?#]*([^#]*)"
_UP = ("..", ".%2e", "%2e.", "%2e%2e")


def host(url: Column) -> Column:
    """What stands between the first :// and /, ? or #, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; ties by the rule's text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def without_dots(path: Column) -> Column:
    """An absolute path with its . and .. segments resolved."""
    closed = F.regexp_replace(path, r"(?i)/((?:\.|%2e){1,2})\z", "/$1/")
    segments = F.split(F.substring(closed, 2, F.length(closed)), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, x: F.when(F.lower(x).isin(*_UP), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(F.lower(x).isin(".", "%2e"), done)
        .otherwise(F.concat(done, F.array(x))),
    )
    return F.when(path.rlike(r"(?i)/(?:\.|%2e)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def alias_key(url: Column) -> Column:
    """What names a page apart from scheme and fragment, a missing path being /; null without a host."""
    query = F.regexp_extract(F.regexp_extract(F.coalesce(url, F.lit("")), _REST, 1), r"(?s)^[^?]*(.*)", 1)
    named = F.when(path(url) == "", F.lit("/")).otherwise(without_dots(path(url)))
    return F.when(host(url) != "", F.concat(host(url), named, query))


def resolve(base: Column, link: Column) -> Column:
    """The absolute url of a link on a page; null where either leads to no host."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path(base), r"(?s)^.*/", 0), F.lit("")), F.lit("/")))
    found = (
        F.when(link.rlike(_SCHEME), F.when(F.contains(F.regexp_extract(link, _SCHEME + "//", 0), F.lit("://")), link))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path(base), link))
        .when((link == "") | F.startswith(link, F.lit("#")), base)
        .otherwise(F.concat(folder, link))
    )
    return F.when((host(base) != "") & (host(found) != ""), found)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) keys of pages and of the urls that they redirect to or name canonical.

    Every canonical link and refresh of a page counts, but for those in comments, scripts
    and styles; the first base element holds. Pages without a host, and links that lead
    to none (mailto: and the like), have no edges.
    """
    told = pages.where(F.col("html").rlike("(?i)canonical|refresh") & (host(F.col("url")) != ""))
    tags = F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(_TAGS), 0)
    told = told.select("url", tags.alias("tags"))

    def named(tag: str, what: str, value: str) -> Column:
        """What the tags of a name, that have an attribute, lead to."""
        own = F.filter("tags", lambda t: F.lower(F.substring(t, 2, len(tag))) == tag)
        found = F.transform(F.filter(own, lambda t: t.rlike(what)), lambda t: F.regexp_replace(F.regexp_extract(t, value, 1), "&amp;", "&"))
        return F.array_remove(found, "")

    links = F.concat(named("link", _REL, _HREF), named("meta", _EQUIV, _TARGET))
    told = told.select("url", F.get(named("base", _HREF, _HREF), F.lit(0)).alias("based"), F.explode(links).alias("to"))
    told = told.withColumn("base", F.coalesce(resolve(F.col("url"), F.col("based")), F.col("url")))
    edges = told.select(alias_key(F.col("url")).alias("src"), alias_key(resolve(F.col("base"), F.col("to"))).alias("dst"))
    return edges.where("src is not null and dst is not null")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page row.

    Null urls and urls without :// have an empty host and path, fit no rule and are
    allowed. Repeated urls are judged alike. Edges to urls that are not pages count.
    """
    judged = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = judged.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("key", alias_key(F.col("url")))
    parts = connected_components(materialize(alias_edges(pages), "aliases"))
    # a key is a url without scheme and fragment: give it one to judge it
    as_url = F.concat(F.lit("http://"), F.col("node"))
    ruled = parts.withColumn("own", matching_rule(host(as_url), path(as_url), rules).getField("verdict"))
    spread = ruled.groupBy("component").agg(F.bool_or(F.col("own") == "block").alias("block"), F.bool_or(F.col("own") == "allow").alias("allow"))
    blocked = spread.where("block and not coalesce(allow, false)").select("component")
    aliases = parts.join(blocked, "component", "left_semi").select(F.col("node").alias("key"), F.lit("block").alias("spread"))
    return judged.join(aliases, "key", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict")
    )


def op9_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _cases(host: str, path: str, pick: int) -> str:
    """The rules, longest first, as SQL for the rule's text (0) or verdict (1)."""
    ordered = sorted(RULES, key=lambda r: len(r[1] + r[2]), reverse=True)
    whens = (
        f"WHEN ({host} = '{n}' OR ends_with({host}, '.{n}')) AND starts_with({path}, '{p}') THEN '{(n + p, v)[pick]}'" for v, n, p in ordered
    )
    return f"CASE {' '.join(whens)} END"


_Q = "[\"'']?"
_LOW = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
_KEY = _LOW.format(r"regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1)") + r" || regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_redirect_rules": op9_redirect_rules}
SQL: dict[str, str] = {
    "op9_redirect_rules": rf"""
WITH RECURSIVE urls AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), judged AS (
  SELECT page_id, {_LOW.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         {_KEY.format("url")} AS key
  FROM urls
), told AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*{_Q}canonical\b[^>]*>'), '(?is)\bhref\s*=\s*{_Q}([^"''\s>]+)', 1) AS target FROM urls
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*{_Q}refresh\b[^>]*>'), '(?is)\burl\s*=\s*{_Q}([^"''\s>;]+)', 1) FROM urls
), edges AS (
  SELECT {_KEY.format("url")} AS a, {_KEY.format("replace(target, '&amp;', '&')")} AS b FROM told WHERE contains(target, '://') AND {_KEY.format("url")} NOT LIKE '/%' AND {_KEY.format("url")} <> ''
), sides AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT a AS node, a AS other FROM sides
  UNION
  SELECT reach.node, sides.b FROM reach JOIN sides ON reach.other = sides.a
), ruled AS (
  SELECT node, {_cases("regexp_extract(other, '^([^/?#]*)', 1)", "regexp_extract(other, '^[^/?#]*([^?#]*)', 1)", 1)} AS verdict FROM reach
), spread AS (
  SELECT node FROM ruled GROUP BY node HAVING bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false)
)
SELECT page_id, host, path, {_cases("host", "path", 0)} AS rule,
       coalesce({_cases("host", "path", 1)}, CASE WHEN key IN (SELECT node FROM spread) THEN 'block' END, 'allow') AS verdict
FROM judged
"""
}
