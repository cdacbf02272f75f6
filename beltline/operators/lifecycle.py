"""Alerts, labels, retrain and deploy events, capture watch-sets, shadow verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..kernels.ordered import Fill, Lag, RowNo, RunSum, Seq, ordered

DAY_US = 86_400_000_000


def alert_lifecycle(scores: DataFrame, labels: DataFrame, threshold: float = S.ALERT_THRESHOLD,
                    chunk_us: int = DAY_US) -> DataFrame:
    """Alerts with their final state.

    A container's labels cut its time into epochs.  In each epoch the first score at or over the
    threshold opens an alert and the label that ends the epoch closes it.  Scores without a
    container never match an open alert, so each of them over the threshold opens its own.
    """
    s = scores.select("event_id", "ts_us", "container_id", "anomaly_score", F.lit(0).alias("kind"))
    lab = labels.filter("container_id IS NOT NULL").select(
        "event_id", "ts_us", "container_id", "label", F.lit(1).alias("kind"))
    line = s.filter("container_id IS NOT NULL").unionByName(lab, allowMissingColumns=True)
    seq = Seq.by_time(["container_id"], "ts_us", ["event_id", "kind"], chunk_us)
    line = ordered(line, seq, RunSum("_seen", "kind")).withColumn("epoch", F.col("_seen") - F.col("kind"))
    pos = F.struct("ts_us", "event_id")
    hot = (F.col("kind") == 0) & (F.col("anomaly_score") >= threshold)
    alerts = line.groupBy("container_id", "epoch").agg(
        F.min_by(F.struct("event_id", "ts_us", "anomaly_score"), F.when(hot, pos)).alias("a"),
        F.max(F.when(F.col("kind") == 1, F.struct("label", F.col("ts_us").alias("at")))).alias("l"),
    ).filter("a IS NOT NULL").select(
        F.col("a.event_id").alias("alert_id"), F.col("a.ts_us").alias("ts_us"), "container_id",
        F.col("a.anomaly_score").alias("anomaly_score"),
        F.when(F.col("l").isNull(), "unlabeled").when(F.col("l.label") == "dismiss", "dismissed")
        .otherwise("labeled").alias("state"),
        F.col("l.label").alias("label"), F.col("l.at").alias("labeled_at_us"))
    orphans = s.filter(F.col("container_id").isNull() & (F.col("anomaly_score") >= threshold)).select(
        F.col("event_id").alias("alert_id"), "ts_us", "container_id", "anomaly_score",
        F.lit("unlabeled").alias("state"))
    return alerts.unionByName(orphans, allowMissingColumns=True)


def retrain_queue(labels: DataFrame, every: int, chunk_us: int = DAY_US) -> DataFrame:
    """A ``retrain_queued`` event at every ``every``-th actionable label, counted over all lines."""
    seq = Seq.by_time([], "ts_us", ["event_id"], chunk_us)
    counted = ordered(labels.filter("label <> 'dismiss'"), seq, RowNo("n"))
    return counted.filter(F.col("n") % every == 0).select(
        "ts_us", "event_id", "line", F.lit("retrain_queued").alias("event_type"),
        F.lit(None).cast("string").alias("model_version"),
        F.lit(f"queued from {every} label(s)").alias("detail"))


def version_autoname(deploys: DataFrame, chunk_us: int = DAY_US) -> DataFrame:
    """Name deploys that do not state a version after the number of deploys so far."""
    seq = Seq.by_time([], "ts_us", ["event_id"], chunk_us)
    named = ordered(deploys, seq, RowNo("n"))
    return named.withColumn("model_version", F.coalesce(
        "model_version", F.concat(F.lit("pdm-anomaly@retrained-"), F.col("n").cast("string")))).drop("n")


def deploy_events(deploys: DataFrame) -> DataFrame:
    return deploys.select("ts_us", "event_id", F.coalesce("line", F.lit("line1")).alias("line"),
                          F.lit("deployed").alias("event_type"), "model_version", "detail")


def desired_vs_observed(desired: DataFrame, events: DataFrame) -> DataFrame:
    """Lines whose latest deployed version differs from the desired one."""
    latest = events.filter("event_type = 'deployed'").groupBy("line").agg(
        F.max_by("model_version", F.struct("ts_us", "event_id")).alias("observed"))
    return desired.join(latest, "line", "left").filter(
        ~F.col("desired").eqNullSafe(F.col("observed"))).select("line", "desired", "observed")


def shadow_verdict(pairs: DataFrame, keys, max_single=0.30, min_windows=20, max_mean=0.05) -> DataFrame:
    """Promote, hold or roll back a candidate from old/new score pairs."""
    d = F.abs(F.col("new_score") - F.col("old_score"))
    agg = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("sum_abs_delta"),
                                   F.max(d).alias("max_abs_delta"))
    return agg.withColumn(
        "verdict", F.when(F.col("max_abs_delta") > max_single, "ROLLBACK")
        .when(F.col("n") < min_windows, "PENDING")
        .when(F.col("sum_abs_delta") / F.col("n") <= max_mean, "PROMOTE").otherwise("ROLLBACK"))


def capture_watch(commands: DataFrame, windows: DataFrame, keys, limit: int = 8,
                  chunk_us: int = DAY_US) -> DataFrame:
    """Windows taken while their segment was being watched, with the label in force.

    Between two stop commands only the first ``limit`` distinct segments get in; adding a watched
    segment again refreshes its label.  A window belongs to the epoch (stops so far) it falls in
    and to the last accepted command for its segment before it.
    """
    keys = list(keys)
    cmd = commands.select(*keys, "ts_us", "event_id", "segment", "label", "stop", F.lit(0).alias("kind"))
    win = windows.select(*keys, "ts_us", "event_id", "segment", F.lit(1).alias("kind"))
    rows = cmd.unionByName(win, allowMissingColumns=True).withColumn("_stop", F.coalesce(F.col("stop").cast("int"), F.lit(0)))
    seq = Seq.by_time(keys, "ts_us", ["kind", "event_id"], chunk_us)
    rows = ordered(rows, seq, RunSum("epoch", "_stop"))
    adds = rows.filter("kind = 0 AND _stop = 0")
    first = adds.groupBy(*keys, "epoch", "segment").agg(F.min(F.struct("ts_us", "event_id")).alias("_first"))
    # Only distinct segments of one epoch are ranked; a rank filter lets Spark prune before the shuffle.
    w = Window.partitionBy(*keys, "epoch").orderBy("_first")
    accepted = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).select(
        *keys, "epoch", "segment")
    live = rows.filter("_stop = 0").join(accepted, [*keys, "epoch", "segment"])
    inner = Seq.by_time([*keys, "epoch", "segment"], "ts_us", ["kind", "event_id"], chunk_us, "_slot")
    live = ordered(live, inner, Fill("cmd", F.when(F.col("kind") == 0, F.struct("label", F.col("event_id").alias("command_id")))))
    return live.filter("kind = 1 AND cmd IS NOT NULL").select(
        *keys, "event_id", "ts_us", "segment", "cmd.label", "cmd.command_id")


def span_pairs(spans: DataFrame, ttl_us: int = 30_000_000) -> DataFrame:
    """CLIENT spans with the SERVER spans they caused; unpaired or late ones are dropped."""
    c = spans.filter("kind = 'CLIENT'").select(
        "trace_id", "span_id", F.col("service").alias("client"), F.col("start_us").alias("c_start"),
        (F.col("end_us") - F.col("start_us")).alias("client_us"))
    s = spans.filter("kind = 'SERVER'").select(
        "trace_id", F.col("parent_id").alias("span_id"), F.col("span_id").alias("server_span_id"),
        F.col("service").alias("server"), F.col("start_us").alias("s_start"),
        (F.col("end_us") - F.col("start_us")).alias("server_us"))
    return c.join(s, ["trace_id", "span_id"]).filter(
        F.abs(F.col("s_start") - F.col("c_start")) <= ttl_us).drop("c_start", "s_start")
