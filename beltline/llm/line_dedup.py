"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is dropped if an earlier line of the corpus, by (doc_id, line number), equals it or is within one edit of it
(insertion, deletion or substitution of a character). All lines are judged on the input. Blank lines stay. Lines shorter
than ``min_chars`` are compared for equality only, as one edit is most of them.

Two strings within one edit share a variant that leaves out one character, or one is such a variant of the other. All
variants of all lines would be as many rows as the corpus has characters, so lines are first narrowed: an edit lies in
one half of a line, and the other half then is equal, so only lines that share a half with another line go on, with the
half that may differ. Long halves are narrowed again until they are short, and only those emit their variants.
A variant's key has the place of the missing character, so all lines under one key are within one edit of each other and
each needs comparing with the earliest only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import hinted
from .frames import let, stored, table

MIN_CHARS = 16
SHORT = 256


def narrowed(key: Column, short: Column, chunk: Column) -> Column:
    """The two narrower states of a state: an array of (key, x) where x tells which half is left to differ.

    ``short`` states stand for strings one character shorter than those they are compared with.
    """
    p = F.floor((F.length(chunk) + short) / 2).cast("int")
    return F.array(F.struct(F.xxhash64(key, F.lit("x"), F.left(chunk, p)).alias("key"), F.lit(True).alias("tail")),
                   F.struct(F.xxhash64(key, F.lit("y"), F.substring(chunk, p + 1 - short, F.length(chunk))).alias("key"), F.lit(False).alias("tail")))


def left_over(short: Column, chunk: Column, tail: Column) -> Column:
    p = F.floor((F.length(chunk) + short) / 2).cast("int")
    return F.when(tail, F.substring(chunk, p + 1, F.length(chunk))).otherwise(F.left(chunk, p - short))


def states(line: Column) -> Column:
    """A line as it meets lines of its length or shorter by one (short = 0), and longer by one (short = 1)."""
    n = F.length(line)
    return F.array(F.struct(F.lit(0).alias("short"), F.xxhash64(n).alias("key")), F.struct(F.lit(1).alias("short"), F.xxhash64(n + 1).alias("key")))


def several(rows: DataFrame) -> DataFrame:
    """Keys under which different lines meet, at least one of them not short."""
    return rows.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("short").alias("s")).where("lo < hi AND s = 0").select("key")


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, line, h1, h2 of (doc_id, th, text), blank lines left out."""
    rows = docs.select("doc_id", "th", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).where(F.trim("line") != "")
    return rows.select("doc_id", "th", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line", F.length("line")).alias("h2"))


def near_earlier(lines: DataFrame, distinct: DataFrame, min_chars: int = MIN_CHARS, short: int = SHORT) -> DataFrame:
    """h1, h2 of the distinct lines within one edit of an earlier one."""
    first = lines.where(F.length("line") >= min_chars)
    level = first.select("h1", F.explode(states(F.col("line"))).alias("s"), "line") \
        .select("h1", F.col("s.short").alias("short"), F.explode(narrowed(F.col("s.key"), F.col("s.short"), F.col("line"))).alias("k")) \
        .select("h1", "short", "k.key", "k.tail").distinct()
    level = stored(level, "halves")
    keys = several(level)
    open_ = stored(level.join(keys, "key", "left_semi"), "open")
    who = open_.select("h1").distinct()
    # the text of each line that goes on, from its earliest place
    spot = stored(distinct.join(who, "h1", "left_semi").select("h1", "h2", "first.doc_id", "first.th", "first.pos"), "spots")
    at = hinted(spot.select("doc_id", "th").distinct(), 500_000)
    held = first.join(at, first["doc_id"].eqNullSafe(at["doc_id"]) & (first["th"] == at["th"]), "left_semi")
    s = spot.withColumnRenamed("doc_id", "d")
    text = stored(held.select("doc_id", "th", "pos", "line", "h1", "h2").join(s, ["th", "pos", "h1", "h2"])
                  .where(F.col("doc_id").eqNullSafe(F.col("d"))).select("h1", "h2", "line", F.struct("doc_id", "th", "pos").alias("first")).dropDuplicates(["h1", "h2"]), "texts")
    state = open_.join(text.select("h1", "line"), "h1").select("h1", "short", "key", left_over(F.col("short"), F.col("line"), F.col("tail")).alias("chunk"))
    done = None
    while True:
        state = stored(state, "state")
        small = state.where(F.length("chunk") <= short)
        done = small if done is None else done.unionByName(small)
        big = state.where(F.length("chunk") > short)
        if big.isEmpty():
            break
        big = big.select("h1", "short", "chunk", F.explode(narrowed(F.col("key"), F.col("short"), F.col("chunk"))).alias("k")) \
            .select("h1", "short", "k.key", left_over(F.col("short"), F.col("chunk"), F.col("k.tail")).alias("chunk"))
        big = stored(big, "state")
        state = big.join(several(big), "key", "left_semi")

    order = text.select("h1", "first")
    cut = F.transform(F.sequence(F.lit(1), F.length("chunk")), lambda i: F.struct(
        i.alias("at"), F.xxhash64("key", F.concat(F.left("chunk", i - 1), F.substring("chunk", i + 1, F.length("chunk")))).alias("v")))
    longer = done.where("short = 0 AND length(chunk) > 0").select("h1", F.explode(cut).alias("c")).select("h1", "c.at", "c.v")
    shorter = done.where("short = 1").select("h1", F.xxhash64("key", "chunk").alias("v")).distinct()
    longer = stored(longer.join(order, "h1"), "variants")
    head = longer.groupBy("v", "at").agg(F.min(F.struct("first", "h1")).alias("e"), F.count("*").alias("many")).where("many > 1")
    pairs = longer.join(head, ["v", "at"]).where("h1 <> e.h1").select("h1", F.col("e.h1").alias("e"))
    less = shorter.join(order, "h1").select("v", F.col("h1").alias("s"), F.col("first").alias("sf"))
    across = longer.join(less, "v").where("h1 <> s")
    pairs = pairs.unionByName(across.select(F.when(F.col("sf") < F.col("first"), F.col("h1")).otherwise(F.col("s")).alias("h1"),
                                            F.when(F.col("sf") < F.col("first"), F.col("s")).otherwise(F.col("h1")).alias("e"))).distinct()
    late = text.select("h1", "h2", "line", "first")
    soon = text.select(F.col("h1").alias("e"), F.col("line").alias("line2"), F.col("first").alias("first2"))
    return pairs.join(late, "h1").join(soon, "e").where("first2 < first AND levenshtein(line, line2, 1) >= 0").select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, short: int = SHORT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text, kept (the text without its dropped lines), n_lines,
    n_removed.

    Rows with equal doc_id and text are one document and lose the same lines; null doc_ids come before all others. Null
    texts are empty: no line, nothing dropped.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    lines = line_rows(keyed)
    distinct = stored(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("many")), "lines")
    near = near_earlier(lines, distinct, min_chars, short).withColumn("near", F.lit(True))
    bad = stored(distinct.join(near, ["h1", "h2"], "left").where("many > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "bad")
    places = lines.select("doc_id", "th", "pos", "h1", "h2").join(hinted(bad), ["h1", "h2"]) \
        .where("near OR NOT (struct(doc_id, th, pos) <=> first)").select("doc_id", "th", "pos").distinct()
    gone = places.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("gone")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "gone")
    out = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["d"]) & (keyed["th"] == gone["t"]), "left")
    rest = F.array_join(let(F.col("gone"), lambda g: F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(g, i))), "\n")
    return out.select("doc_id", "text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("kept"),
                      F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("n_chars"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, pos, line FROM (
    SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), u AS (SELECT line, length(line) AS n, min({'d': doc_id, 'p': pos}) AS first FROM l WHERE trim(line) <> '' GROUP BY line
), k AS (
  SELECT DISTINCT line, n, first, h, side, CASE side WHEN 'l' THEN left(line, h) ELSE right(line, h) END AS part
  FROM u, (VALUES ('l'), ('r')) s(side), LATERAL (SELECT n // 2 AS h UNION SELECT (n - 1) // 2) WHERE n >= 16
), near AS (
  SELECT DISTINCT b.line FROM k a JOIN k b USING (side, h, part)
  WHERE a.first < b.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1
), g AS (
  SELECT l.doc_id, l.pos, l.line, coalesce({'d': l.doc_id, 'p': l.pos} <> u.first OR near.line IS NOT NULL, FALSE) AS gone
  FROM l LEFT JOIN u USING (line) LEFT JOIN near USING (line)
), t AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, n_removed, length(kept) AS n_chars, sha256(kept) AS kept_sha256
FROM t JOIN documents USING (doc_id)
"""
