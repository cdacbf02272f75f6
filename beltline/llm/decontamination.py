"""Benchmark decontamination over a positional inverted index.

The index holds postings (term, doc, position). A window of test words can only occur where its rarest term does, so
the search starts from the postings of the rarest term of each window, shifts them by the term's place in the item
(one diagonal per item and document), and keeps a diagonal only if the next rarest terms have postings at the shifted
places. What is left is compared word by word.

The words of the index are those of the comparison: only A-Z are lower-cased, as the contamination rule says. (``lower``
would make words differ by what stands around them, as with a Greek final sigma.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import let, stored, table

#: What separates words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANCHORS = 3
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def exact_words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return words(F.translate(text, upper, upper.lower()))


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows (short rows: words and numbers), as it is beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` where all of ``on`` agree; a null doc_id agrees with a null one."""
    other = right.select(*(F.col(c).alias(f"{c}_" if c in on else c) for c in right.columns))
    agree = [F.col(c).eqNullSafe(F.col(f"{c}_")) if c == "doc_id" else F.col(c) == F.col(f"{c}_") for c in on]
    return left.join(other, agree, how).drop(*(f"{c}_" for c in on))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The index of (doc_id, h, text): term, doc_id, h, pos. With ``terms``, the postings of those terms only."""
    rows = docs.select("doc_id", "h", F.posexplode(exact_words(F.col("text"))).alias("pos", "term"))
    return rows if terms is None else rows.join(hinted(terms), "term", "left_semi")


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of ``terms`` occurs in the corpus; 0 if it does not."""
    rows = docs.select(F.explode(exact_words(F.col("text"))).alias("term")).join(hinted(terms), "term", "left_semi")
    return terms.join(rows.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def phrase_windows(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Exact phrase matches: doc_id, h, item, start, length, one row for each occurrence of a window of ``width`` words.

    ``docs`` has doc_id, h (a hash of the text) and text, ``items`` has item and text. An item of fewer words, but not
    none, is one window. Repeated rows count once.
    """
    items = stored(items.select("item", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("key", F.monotonically_increasing_id())
                   .withColumn("n", F.size(words(F.col("text")))).where("n > 0"), "items")
    places = stored(items.select("key", "n", F.posexplode(exact_words(F.col("text"))).alias("at", "term")), "places")
    freq = stored(frequencies(docs, places.select("term").distinct()), "terms")
    first = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - width + 1), F.least(F.col("at"), F.greatest(F.lit(0), F.col("n") - width)))).alias("first")
    rank = F.row_number().over(Window.partitionBy("key", "first").orderBy("f", "at"))
    anchors = stored(places.join(freq.withColumnRenamed("n", "f"), "term").select("key", "n", "at", "term", "f", first)
                     .withColumn("rank", rank).where(F.col("rank") <= ANCHORS).groupBy("key", "n", "at", "term").agg(F.min("rank").alias("rank")), "anchors")
    index = stored(postings(docs, anchors.select("term").distinct()), "postings")

    start = index.join(hinted(anchors.where("rank = 1")), "term").select("doc_id", "h", "key", (F.col("pos") - F.col("at")).alias("diag")).distinct()
    wanted = start.join(hinted(anchors.select("key", "n", "at", "term")), "key").withColumn("pos", F.col("diag") + F.col("at"))
    found = matched(wanted, index, ["doc_id", "h", "pos", "term"], "left_semi").groupBy("doc_id", "h", "key", "n", "diag").agg(F.countDistinct("at").alias("have"))
    left = stored(found.where(F.col("have") >= F.least(F.lit(min(ANCHORS, width)), "n")).drop("have"), "diagonals")

    by_doc = left.groupBy("doc_id", "h").agg(F.collect_set(F.struct("key", "n", "diag")).alias("c"))
    texts = matched(docs, hinted(by_doc.select("doc_id", "h")), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    cut = let(exact_words(F.col("text")), lambda w: F.transform(F.col("c"), lambda c: F.struct(
        c["key"].alias("key"), c["diag"].alias("diag"),
        F.slice(w, F.greatest(c["diag"], F.lit(0)) + 1, c["n"] + F.least(c["diag"], F.lit(0))).alias("have"))))
    pieces = matched(texts, by_doc, ["doc_id", "h"]).select("doc_id", "h", F.explode(cut).alias("c")).select("doc_id", "h", "c.*")
    pairs = pieces.join(items.select("key", "item", "n", exact_words(F.col("text")).alias("want")), "key") \
        .withColumn("off", F.greatest(-F.col("diag"), F.lit(0))).withColumn("w", F.least(F.lit(width), "n")).where(F.size("have") >= F.col("w"))
    same = F.expr("filter(sequence(0, size(have) - w), i -> slice(have, i + 1, w) = slice(want, off + i + 1, w))")
    hits = pairs.select("doc_id", "h", "item", "diag", "off", "w", F.explode(same).alias("i"))
    return hits.select("doc_id", "h", "item", (F.col("diag") + F.col("off") + F.col("i")).alias("start"), F.col("w").alias("length")).distinct()


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Where both terms of a pair (a, b) occur at most ``within`` words apart: doc_id, h, a, b, pos_a, pos_b.

    An equality join on stretches of ``within`` words: each place of b is looked for in three of them.
    """
    stretch = F.floor(F.col("pos") / within)
    left = index.join(hinted(pairs), index["term"] == pairs["a"]).select("doc_id", "h", "a", "b", F.col("pos").alias("pos_a"), stretch.alias("s"))
    right = index.join(hinted(pairs.select("b").distinct()), index["term"] == F.col("b")).select(
        "doc_id", "h", "b", F.col("pos").alias("pos_b"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("s"))
    near = matched(left, right, ["doc_id", "h", "b", "s"])
    return near.where((F.abs(F.col("pos_a") - F.col("pos_b")) <= within) & (F.col("pos_a") != F.col("pos_b"))).select("doc_id", "h", "a", "b", "pos_a", "pos_b")


def contamination(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, h, n_words, n_hit, items (sorted ids as strings).

    A word inside any occurrence of a window is hit, once however many windows cover it. Null texts have no words. Texts
    under a null doc_id are searched like all others (the SQL joins by doc_id and leaves them without hits).
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    hits = stored(phrase_windows(keyed, items, width), "hits")
    places = hits.select("doc_id", "h", "start", "length").distinct() \
        .select("doc_id", "h", F.explode(F.expr("sequence(start, start + length - 1)")).alias("pos")).distinct()
    n_hit = places.groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    which = hits.select("doc_id", "h", F.col("item").cast("string").alias("item")).distinct() \
        .groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = matched(n_hit, which, ["doc_id", "h"])
    rows = keyed.select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["h"] == found["h"]), "left").select(
        rows["doc_id"], rows["h"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """Hit at all, and in a twentieth of its words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "item"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(0, greatest(0, len(w) - n + 1))) AS i FROM d, sizes)
), hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
