"""The engine's input topics and tables, derived whole from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

ORIGIN_US = 1_704_067_200_000_000   # 2024-01-01T00:00:00Z
SPEED_UP = 3600                     # one recorded second per hour of event time


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type", "value",
        "props", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))


def _container(df):
    return df.withColumns({
        "container_id": F.concat(F.lit("cnc-"), F.col("user_id").cast("string")),
        "line": F.concat(F.lit("line"), (F.col("user_id") % 4 + 1).cast("string"))})


def scores(spark, sf) -> DataFrame:
    e = _container(events(spark, sf))
    return e.select(
        "event_id", "ts_us", "container_id", "line", F.least(F.col("value") / 100, F.lit(1.0)).alias("anomaly_score"),
        F.concat(F.lit("pdm@"), (F.col("k") % 3).cast("string")).alias("model_version"),
        F.when(F.col("event_type") == "error", "bearing wear").alias("fault_class"),
        F.concat(F.lit("seg-"), (F.col("k") % 17 + 1).cast("string")).alias("location"),
        F.when(F.col("event_type").isin("view", "error"), "inference").when(F.col("event_type") == "click", "raw")
        .when(F.col("event_type") == "purchase", "features").alias("data_classification"),
        (F.length("props") * 10).cast("bigint").alias("bytes"))


def labels(spark, sf) -> DataFrame:
    e = _container(events(spark, sf)).filter(F.col("event_type").isin("purchase", "signup"))
    return e.select(
        "event_id", "ts_us", "container_id", "line",
        F.when(F.col("event_type") == "signup", "dismiss").otherwise("bearing wear").alias("label"),
        F.concat(F.lit("win-"), F.col("k").cast("string")).alias("feature_window_ref"))


def deploys(spark, sf) -> DataFrame:
    e = _container(events(spark, sf)).filter("event_type = 'error'")
    return e.select("event_id", "ts_us", "line", F.lit(None).cast("string").alias("model_version"),
                    F.lit("from console").alias("detail"))


def alerts(spark, sf) -> DataFrame:
    from ..operators.lifecycle import alert_lifecycle

    return alert_lifecycle(scores(spark, sf), labels(spark, sf))


def model_events(spark, sf) -> DataFrame:
    from ..operators.lifecycle import deploy_events, retrain_queue, version_autoname

    return retrain_queue(labels(spark, sf), 5).unionByName(deploy_events(version_autoname(deploys(spark, sf))))


def fixes(spark, sf) -> DataFrame:
    e = _container(events(spark, sf)).filter("event_type = 'click'")
    return e.select("event_id", "ts_us", "line", "container_id", F.col("ts_us").alias("t_host_us"),
                    (F.col("value") / 10).alias("x"), (F.col("k") / 10).alias("y"))


def anomalies(spark, sf) -> DataFrame:
    return scores(spark, sf).filter("fault_class IS NOT NULL")


def imu(spark, sf) -> DataFrame:
    k = F.col("k")
    return events(spark, sf).select(
        "event_id", F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("session"),
        F.call_function("div", F.col("ts_us") - ORIGIN_US, F.lit(SPEED_UP).cast("bigint")).alias("t_us"),
        "ts_us", "event_type", "value", "k",
        ((k - 50) / 1000).alias("ax"), ((k * 7 % 100 - 50) / 1000).alias("ay"), (1 + F.col("value") / 1000).alias("az"),
        ((k * 3 % 100 - 50) / 2).alias("gx"), ((k * 11 % 100 - 50) / 2).alias("gy"), (F.col("value") - 50).alias("gz"),
        (k * 37 % 100 - 30).cast("double").alias("mx"), (k * 53 % 100 - 20).cast("double").alias("my"))


def intervals(spark, sf) -> DataFrame:
    """Labelled spans of a session, ``[start_us, end_us)``."""
    e = imu(spark, sf).filter("event_type = 'error'")
    return e.select(
        "session", F.col("event_id").alias("label_id"), F.col("t_us").alias("start_us"),
        (F.col("t_us") + F.round(F.col("value") * 10000).cast("bigint")).alias("end_us"),
        F.when(F.col("k") % 3 == 0, "fault").when(F.col("k") % 3 == 1, "qs_wobbly").otherwise("qs_smooth").alias("label"))


def window_scores(spark, sf) -> DataFrame:
    """Scored windows of a session: centre time and score."""
    return imu(spark, sf).select("session", F.col("event_id").alias("win_id"), F.col("t_us").alias("center_us"),
                                 F.least(F.col("value") / 100, F.lit(1.0)).alias("score"))


def frames(spark, sf) -> DataFrame:
    e = imu(spark, sf).filter("event_type = 'view'")
    return e.select(
        "session", F.col("event_id").alias("frame_no"), F.col("t_us").alias("host_us"),
        F.concat(F.lit("cam_f"), F.col("event_id").cast("string"), F.lit("_"), F.col("t_us").cast("string"),
                 F.lit(".jpg")).alias("name"),
        (F.col("k") / 100).alias("dark"), (F.col("value") / 100).alias("net"))


def signal_windows(spark, sf) -> DataFrame:
    """One 64-sample signal window per row; the label is the unit it came from."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("u"), F.col("label").cast("string")).alias("unit"), F.col("embedding").alias("sig"))


def clip_scores(spark, sf) -> DataFrame:
    """Scored, labelled clips: text length as score, quality as the true class."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("clip"), F.col("source").alias("recording"), F.col("n_chars").cast("double").alias("score"),
        F.col("toxic").cast("double").alias("score2"), F.col("quality").cast("int").alias("y"))


def profiles(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("network"),
        (F.col("p_size") * 100.0).alias("total_sram_used"), (F.col("p_retailprice") / 20).alias("batch_inference_time"),
        F.col("p_size").cast("double").alias("cpu_operators"), (F.lit(100.0) - F.col("p_size")).alias("npu_operators"),
        F.when(F.col("p_size") > 10, F.col("p_size") * 40960.0).alias("artifact_bytes"))


def spans(spark, sf) -> DataFrame:
    """Client spans from orders, server spans from their line items."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trace_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("dev-"), F.substring("o_orderpriority", 1, 1)).alias("service"),
        F.lit("publish").alias("name"), F.lit("CLIENT").alias("kind"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400 * 1_000_000).alias("start_us"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("dur"))
    li = table(spark, sf, "lineitem").join(
        o.select("trace_id", F.col("start_us").alias("p")), F.col("l_orderkey") == F.col("trace_id")).select(
        F.col("l_orderkey").alias("trace_id"),
        F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("span_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent_id"),
        F.concat(F.lit("svc-"), F.col("l_returnflag")).alias("service"),
        F.concat(F.lit("handle-"), F.col("l_linestatus")).alias("name"), F.lit("SERVER").alias("kind"),
        (F.col("p") + (F.col("l_quantity") * 700000).cast("bigint")).alias("start_us"),
        F.floor(F.col("l_extendedprice") * 10).cast("bigint").alias("dur"))
    return o.unionByName(li).withColumn("end_us", F.col("start_us") + F.col("dur")).withColumn(
        "duration_ms", F.col("dur") / 1000).drop("dur")
