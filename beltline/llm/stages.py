"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents with the stage's decisions made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontamination, language as language_id, line_dedup, minhash, mixing
from .frames import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others take the predicted language."""
    model = language_id.fit(docs.select("text", "lang"))
    kept = language_id.identify(docs.select(*COLUMNS), model).where("NOT rejected")
    return kept.withColumn("lang", kept["lang_pred"]).select(*COLUMNS)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had words and is left without any goes."""
    own = docs.select(*COLUMNS).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = line_dedup.dedup_lines(own).where("n_removed > 0").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "kept").dropDuplicates(["d", "t"])
    new = own.join(out, own["doc_id"].eqNullSafe(out["d"]) & (own["th"] == out["t"]), "left").where("kept IS NULL OR trim(kept) <> ''")
    text = F.coalesce("kept", "text")
    return new.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, null ids last, and then of the smallest digest.

    Groups are told apart by their texts, so different texts under one doc_id, or under none, each stay.
    """
    own = docs.select(*COLUMNS)
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), "digest")).alias("k")
    first = minhash.near_classes(own).groupBy("root").agg(lowest).select("k.d", "k.digest")
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = own.withColumn("g", digest).join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("g") == F.col("digest")), "left_semi")
    return kept.dropDuplicates(["doc_id", "g"]).select(*COLUMNS)


def uncontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    own = docs.select(*COLUMNS)
    found = decontamination.contamination(own, table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "item"))
    bad = found.where(decontamination.contaminated()).select(F.col("doc_id").alias("d"), "h").distinct()
    on = own["doc_id"].eqNullSafe(bad["d"]) & (F.xxhash64(own["text"]) == bad["h"])
    return own.join(decontamination.hinted(bad), on, "left_anti")


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its rate: how often to take it so that the expected domain shares match the targets."""
    own = docs.select(*COLUMNS).withColumn("th", F.xxhash64("text"))
    # equal texts have equal rates and tokens
    out = mixing.mixed(own, table(spark, sf_dir, "labels")).groupBy("doc_id", "h").agg(F.first("rate").alias("rate"), F.first("tokens").alias("tokens"))
    out = out.withColumnRenamed("doc_id", "d")
    return own.join(out, own["doc_id"].eqNullSafe(out["d"]) & (own["th"] == out["h"])).select(*COLUMNS, "rate", "tokens")
