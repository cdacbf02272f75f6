"""Document fingerprints: bottom-k sketches of shingle hashes, in column expressions only.

A sketch is the sorted array of the k smallest distinct 40-bit hashes of a text's runs of ``width`` words. It is
mergeable: the sketch of a union is the k smallest of the parts' sketches. Fewer than k values mean that the sketch
holds every shingle, and all estimates are exact up to hash collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import let, table

BITS = 40


def words(text: Column) -> Column:
    """Runs of anything but white space; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """One hash for each run of ``width`` words; a text of fewer words, but not none, is one run."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(w[i + j] for j in range(width))))
        few = F.array(F.xxhash64(F.concat_ws(" ", w)))
        return F.when(F.size(w) >= width, runs).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), of)


def sketch(text: Column, k: int = 128, width: int = 5) -> Column:
    cut = F.transform(shingle_hashes(text, width), lambda h: F.shiftrightunsigned(h, 64 - BITS))
    return F.slice(F.sort_array(F.array_distinct(cut)), 1, k)


def merged(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, keys: list[str], sketches: str, k: int = 128) -> DataFrame:
    """Sketches of all parts of each key merged: keys, sketch. A key may have any number of parts.

    Values are made distinct, then banded, and only the k smallest of each band meet.
    """
    values = df.select(*keys, F.explode(sketches).alias("v")).distinct().withColumn("band", F.pmod(F.xxhash64("v"), F.lit(64)))

    def least(rows: DataFrame, by: list) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("v"))).where(F.col("rn") <= k).drop("rn")

    return least(least(values, [*keys, "band"]), keys).groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Share of the union's sketch that both hold: an estimate of |A and B| / |A or B|. Two empty sketches are alike."""
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_count(a: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of A's shingles that B has too; an empty A is contained."""
    both = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")


def with_next(docs: DataFrame, *values: str) -> DataFrame:
    """Each row with ``next``, a struct of the ``values`` of the row after it by descending doc_id, the last row's being
    the first. Equal doc_ids follow by text, null doc_ids come last.

    The id range is cut at quantiles, each piece is ordered on its own, and each piece gets a copy of the first row of
    the piece after it; the list of pieces is as long as the number of shuffle partitions times four at most.
    """
    spark = docs.sparkSession
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], 20 * pieces).alias("q")).first()["q"]
    cut = F.array(*(F.lit(x) for x in sorted(set(cuts or [])))).cast("array<bigint>")
    own = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(cut, lambda x: F.col("doc_id") >= x)))
    rows = docs.withColumn("piece", own)
    tops = docs.select("doc_id").withColumn("piece", own).groupBy("piece").agg(F.max("doc_id").alias("top"))
    line = Window.orderBy("piece")
    above = F.coalesce(F.lead("piece").over(line), F.first("piece").over(line))
    # at most one row for each piece
    tops = F.broadcast(tops.select("piece", "top", above.alias("above")))
    both = rows.join(tops, (rows["piece"] == tops["piece"]) & rows["doc_id"].eqNullSafe(tops["top"]), "left").drop(tops["piece"])
    places = F.array(F.struct(F.col("piece").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("above").alias("at"), F.lit(True).alias("ghost")))
    dealt = both.select(*docs.columns, F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("p"))
    order = Window.partitionBy("p.at").orderBy("p.ghost", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next", F.lead(F.struct(*values)).over(order)).where("NOT p.ghost").drop("p")


def op1_fingerprints(spark, sf_dir: str, k: int = 128, width: int = 5) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("sketch", sketch(F.col("text"), k, width))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = with_next(docs, "text", "sketch").withColumn("edited", F.concat(
        F.expr("left(text, length(text) - CAST(floor(length(text) / 2) AS INT))"), F.substring(F.col("next.text"), F.lit(1), half)))
    out = edited.withColumn("edited_sketch", sketch(F.col("edited"), k, width))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next.sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"))
