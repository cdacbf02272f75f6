"""Session folders and recorder tables in, staged records and track tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..kernels.ordered import RowNo, Seq, ordered
from ..operators.sequences import CHUNK_US, nominal_rate


def _session(path) -> "F.Column":
    """Name of the folder a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def _csv(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    rows = spark.read.schema(schema).options(**options).csv(path)
    return rows.withColumn("session", _session(F.col("_metadata.file_path")))


def scan_session_imu(spark: SparkSession, path: str) -> DataFrame:
    """Comma text without header; comment and blank lines are skipped, extra fields ignored."""
    return _csv(spark, path, S.SESSION_IMU, comment="#", ignoreLeadingWhiteSpace="true").filter("t IS NOT NULL")


def scan_session_mag(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, S.SESSION_MAG, header="true", enforceSchema="true")


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """All label files of all sessions: trimmed, blank labels dropped, end = start + length."""
    rows = _csv(spark, path, S.SESSION_LABELS, header="true", enforceSchema="true")
    return rows.withColumns({"label": F.trim("label"), "end": F.col("start") + F.col("length")}).filter(
        "start IS NOT NULL AND label <> ''")


def scan_clip_labels(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, S.CLIP_LABELS, header="true", enforceSchema="true")


def scan_merged_recorder(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The recorder table with wall time from the first sample; the device clock, which marks bursts, is kept.

    Unparsable rows are skipped, or end the job where ``strict``.
    """
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = _csv(spark, path, S.MERGED, header="true", enforceSchema="true", mode=mode).filter("t_rel_s IS NOT NULL")
    first = rows.groupBy("session").agg(F.min_by("t_rel_s", "t_host_us").alias("_t0"))
    return rows.join(first, "session").withColumn("t_wall", F.col("t_rel_s") - F.col("_t0")).drop("_t0")


def recorder_rate(rows: DataFrame) -> DataFrame:
    """Nominal sample rate per session from the positive steps of the device clock."""
    return nominal_rate(rows, ["session"], "t_dev_us", ["t_host_us", "t_rel_s"], positive_only=True)


def uniform_timeline(rows: DataFrame, order=("t_host_us", "t_rel_s", "t_dev_us"), chunk_us=CHUNK_US) -> DataFrame:
    """Adds ``fs`` and ``t`` = sample number / fs, for steps that need an even grid instead of the clocks."""
    t, *ties = order
    numbered = ordered(rows, Seq.by_time(["session"], t, ties, chunk_us), RowNo("_i"))
    return numbered.join(recorder_rate(rows), "session").withColumn("t", (F.col("_i") - 1) / F.col("fs")).drop("_i", "_chunk")


def ndjson_sink(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One staged record per line; absent senses stay explicit nulls."""
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)


def track_sinks(wheels: DataFrame, track: DataFrame, anchors: DataFrame, base: str, mode: str = "errorifexists") -> None:
    """The three localization tables, rounded as reports expect them."""
    def put(df, name, digits):
        df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]).write.mode(mode).option(
            "header", "true").csv(f"{base}/{name}")

    put(wheels, "wheels", {"t_rel_s": 3})
    put(track, "track", {"t_rel_s": 3, "cum_cm": 1, "map_x": 1, "map_y": 1})
    put(anchors, "anchors", {"t_rel_s": 3, "deg": 0})


def write_scores(scores: DataFrame, path: str, mode: str = "append") -> None:
    """Scores partitioned by day, so time filters and retention touch whole partitions."""
    scores.withColumn("day", F.to_date(F.timestamp_micros("ts_us"))).write.mode(mode).partitionBy("day").parquet(path)
