"""Benchmark decontamination over a positional inverted index (operator 10).

All DataFrame functions. Benchmark items become phrases: each run of ten consecutive
words, or the whole item if it is shorter.

1. Documents are split into words once, as a table of 64-bit term hashes.
2. Term statistics: occurrences, in all documents, of every benchmark term.
3. A phrase's lists are intersected from its rarest term on. The index first holds the
   postings (term, document, position) of the two rarest terms of every phrase: each
   posting, less the term's offset, proposes where the phrase would begin, and both lists
   must propose the same place. The lists of the other terms are made for the documents
   that are left, and must propose it too.
4. What is left is compared with the phrase, word by word.
5. Proximity: the two rarest different terms of a phrase that occur at all stand close
   together, in any order. It finds passages that were changed; it is a hint, no proof.

Rows are told apart by two hashes of id and text, so rows of one id are judged alone and
equal rows alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, small, table

WINDOW_WORDS = 10
#: Words that the two terms of a proximity match may be apart.
SLOP = 20
#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["key_a", "key_b"]


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def phrases(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, phrase array): the windows of every item that has words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("phrase")).distinct()


def keys() -> list[Column]:
    """What names a row: 128 bits of its id and text."""
    return [F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key_b")]


def tokens(docs: DataFrame) -> DataFrame:
    """(key_a, key_b, doc_id, terms): the hashes of each row's words, in order; written once."""
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    return materialize(docs.select(*keys(), "doc_id", hashed.alias("terms")), "tokens")


def search_plan(found: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the phrases: (phrase_id, phrase, size); the lists to intersect (phrase_id, size,
    h, offset, rank), rarest first, of phrases all of whose terms occur; and the proximity
    pairs (phrase_id, h, h_2) of each phrase's two rarest different terms that occur.

    Ties go by the term and then the offset.
    """
    distinct = found.select("phrase").distinct().select(F.monotonically_increasing_id().alias("phrase_id"), "phrase", F.size("phrase").alias("size"))
    distinct = materialize(distinct, "distinct-phrases")
    places = distinct.select("phrase_id", "size", F.posexplode("phrase").alias("offset", "term")).withColumn("h", F.xxhash64("term"))
    vocabulary = materialize(places.select("h").distinct(), "terms")
    counts = split.select(F.explode("terms").alias("h")).join(small(vocabulary), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    places = materialize(places.join(small(materialize(counts, "term-counts")), "h", "left"), "places")
    each = Window.partitionBy("phrase_id")
    whole = places.withColumn("lowest", F.min(F.coalesce("n", F.lit(0))).over(each)).where("lowest > 0")
    whole = whole.withColumn("rank", F.row_number().over(each.orderBy("n", "term", "offset"))).select("phrase_id", "size", "h", "offset", "rank")
    close = places.where("n > 0").select("phrase_id", "h", "n", "term").distinct().withColumn("rank", F.row_number().over(each.orderBy("n", "term")))
    close = close.groupBy("phrase_id").agg(F.max(F.when(F.col("rank") == 1, F.col("h"))).alias("h"), F.max(F.when(F.col("rank") == 2, F.col("h"))).alias("h_2"))
    return distinct, materialize(whole, "lists"), materialize(close.where("h_2 is not null"), "proximity-pairs")


def postings(split: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, key_a, key_b, at): where these terms stand."""
    return split.select(*KEY, F.posexplode("terms").alias("at", "h")).join(small(terms), "h", "left_semi").select("h", *KEY, "at")


@dataclass(frozen=True)
class Index:
    """The split documents, the plan of the search and the postings that it starts from."""

    docs: DataFrame
    split: DataFrame
    phrases: DataFrame
    lists: DataFrame
    pairs: DataFrame
    postings: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, found: DataFrame, near: bool = True) -> Index:
        """An index of ``docs`` for the phrases; without ``near``, none of the proximity pairs' lists."""
        split = tokens(docs)
        distinct, lists, pairs = search_plan(found, split)
        terms = lists.where("rank <= 2").select("h")
        if near:
            terms = terms.union(pairs.select("h")).union(pairs.select("h_2"))
        return cls(docs, split, distinct, lists, pairs, materialize(postings(split, materialize(terms.distinct(), "terms")), "postings"))

    def _starts(self, rank: int) -> DataFrame:
        """Where phrases would begin by the postings of their term of this rank."""
        lists = small(materialize(self.lists.where(F.col("rank") == rank), "lists"))
        placed = self.postings.join(lists, "h").select(*KEY, (F.col("at") - F.col("offset")).alias("start"), "phrase_id", "size")
        return placed.where("start >= 0")

    def matches(self) -> DataFrame:
        """(key_a, key_b, start, size, phrase): every occurrence of the phrases, exactly."""
        place = [*KEY, "start", "phrase_id"]
        first = self._starts(1)
        left = first.where("size > 1").join(self._starts(2), place, "left_semi")
        left = materialize(left.unionByName(first.where("size = 1")).distinct(), "candidates")  # equal rows have one key
        # the other lists, of the documents that are left
        more = left.join(self.lists.where("rank > 2").select("phrase_id", "h", "offset"), "phrase_id")
        more = more.select(*place, "size", "h", (F.col("start") + F.col("offset")).alias("at"))
        held = materialize(left.select(*KEY).distinct(), "candidate-documents")
        lists = self.split.join(small(held), KEY, "left_semi").dropDuplicates(KEY).select(*KEY, F.posexplode("terms").alias("at", "h"))
        agree = more.join(lists, [*KEY, "at", "h"]).groupBy(*place, "size").agg(F.count("*").alias("n")).where("n = size - 2").drop("n")
        left = materialize(left.where("size <= 2").unionByName(agree.select(*left.columns)), "agreed")
        # word by word, so that no hash decides
        held = materialize(left.select(*KEY).distinct(), "agreed-documents")
        texts = self.docs.select(*keys(), "text").join(small(held), KEY, "left_semi").select(*KEY, words(F.col("text")).alias("w")).dropDuplicates(KEY)
        told = left.join(texts, KEY).join(small(self.phrases.select("phrase_id", "phrase")), "phrase_id")
        return told.where(F.slice("w", F.col("start") + 1, F.col("size")) == F.col("phrase")).select(*KEY, "start", "size", "phrase")

    def near(self, slop: int = SLOP) -> DataFrame:
        """(key_a, key_b, h, h_2, near_at, near): proximity pairs at most ``slop`` words apart in a document.

        ``near`` is the closest distance of the pair, and ``near_at`` where its rarest term stands then.
        """
        pairs = small(materialize(self.pairs.select("h", "h_2").distinct(), "pairs"))
        left = self.postings.join(pairs, "h").select(*KEY, "h", "h_2", "at", F.floor(F.col("at") / slop).alias("cell"))
        right = self.postings.withColumnRenamed("h", "h_2").join(pairs, "h_2").select(*KEY, "h", "h_2", F.col("at").alias("other"))
        right = right.select("*", F.explode(F.array(*((F.floor(F.col("other") / slop) + d) for d in (-1, 0, 1)))).alias("cell"))
        apart = F.abs(F.col("at") - F.col("other"))
        return (
            left.join(right, [*KEY, "h", "h_2", "cell"])
            .where(apart <= slop)
            .groupBy(*KEY, "h", "h_2")
            .agg(F.min_by("at", F.struct(apart, F.col("at"))).alias("near_at"), F.min(apart).alias("near"))
        )


def phrase_matches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key_a, key_b, start, size, phrase): every occurrence of the phrases in the rows, which ``keys`` names."""
    return Index.of(docs, found, near=False).matches()


def proximity_matches(docs: DataFrame, found: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_id, phrase, near_at, near): rows where a phrase's two rarest terms stand close."""
    index = Index.of(docs, found)
    told = index.near(slop).join(index.pairs, ["h", "h_2"]).join(index.phrases, "phrase_id")
    return told.join(index.split.select(*KEY, "doc_id"), KEY).select("doc_id", "phrase", "near_at", "near")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, slop: int = SLOP) -> DataFrame:
    """Per row: words, words inside benchmark phrases, the items they belong to, and the
    items of which a proximity pair stands close (n_near).

    Null and wordless texts have no words and no hits; an item without words never
    occurs; repeated items and phrases count once; rows of one id are judged apart.
    Columns other than doc_id, item_id and text are ignored. No hits: n_items 0 and the
    digest of the empty string.
    """
    found = materialize(phrases(benchmark, size), "phrases")
    index = Index.of(docs, found)
    matches = materialize(index.matches(), "matches")
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    spans = matches.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = spans.withColumn("before", before).groupBy(*KEY)
    hit = hit.agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0))).cast("long").alias("hit"))
    items = matches.select(*KEY, "phrase").distinct().join(small(found), "phrase")
    items = items.select(*KEY, F.col("item_id").cast("string").alias("item")).groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = hit.join(items, KEY).select(*KEY, "hit", F.size("items").cast("long").alias("n"), F.array_join("items", ",").alias("list"))
    of_pair = index.pairs.join(index.phrases, "phrase_id").join(found, "phrase").select("h", "h_2", "item_id").distinct()
    near = index.near(slop).select(*KEY, "h", "h_2").join(small(materialize(of_pair, "pair-items")), ["h", "h_2"])
    near = near.select(*KEY, "item_id").distinct().groupBy(*KEY).agg(F.count("*").alias("near"))
    told = materialize(hits.join(near, KEY, "full"), "told")
    return index.split.join(small(told), KEY, "left").select(
        "doc_id",
        F.size("terms").cast("long").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The documents in which no benchmark phrase occurs, all columns kept."""
    found = materialize(phrases(benchmark, size), "phrases")
    hit = materialize(phrase_matches(docs.select("doc_id", "text"), found).select(*KEY).distinct(), "hit-documents")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key_b"))
    return rows.join(small(hit), KEY, "left_anti").select("row.*")


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_positional_decontamination": op10_positional_decontamination}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL: dict[str, str] = {
    "op10_positional_decontamination": f"""
WITH items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[pos : pos + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), sizes AS (
  SELECT DISTINCT size FROM phrases
), windows AS (
  SELECT doc_id, pos, size, array_to_string(w[pos : pos + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM docs, sizes WHERE len(w) >= size)
), matches AS (
  SELECT doc_id, pos, size, item_id FROM windows JOIN phrases USING (phrase, size)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM matches) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM matches) GROUP BY doc_id
), counts AS (
  SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM docs) GROUP BY term
), ranked AS (
  SELECT phrase, term, row_number() OVER (PARTITION BY phrase ORDER BY n, term) AS rank
  FROM (SELECT DISTINCT phrase, unnest(string_split(phrase, ' ')) AS term FROM phrases) JOIN counts USING (term)
), pairs AS (
  SELECT DISTINCT item_id, a.term AS t, b.term AS u FROM ranked a JOIN ranked b USING (phrase) JOIN phrases USING (phrase) WHERE a.rank = 1 AND b.rank = 2
), places AS (
  SELECT doc_id, term, p FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM docs) SEMI JOIN (SELECT t AS term FROM pairs UNION SELECT u FROM pairs) USING (term)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM (SELECT DISTINCT x.doc_id, x.term AS t, y.term AS u
        FROM places x JOIN (SELECT DISTINCT t, u FROM pairs) d ON x.term = d.t JOIN places y ON y.doc_id = x.doc_id AND y.term = d.u AND abs(x.p - y.p) <= {SLOP})
  JOIN pairs USING (t, u) GROUP BY doc_id
)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""
}
