"""The queries behind the operator surface: feeds, gauges, rates, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.quantiles import exact_percentiles

# Latency bucket bounds in ms.
LATENCY_BUCKETS_MS = (1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)


def in_window(df: DataFrame, lo_us=None, hi_us=None, ts="ts_us") -> DataFrame:
    """Closed dashboard time filter."""
    if lo_us is not None:
        df = df.filter(F.col(ts) >= lo_us)
    return df if hi_us is None else df.filter(F.col(ts) <= hi_us)


def latest_by(df: DataFrame, keys, order=("ts_us", "event_id"), cols=None) -> DataFrame:
    """Newest row per key, as a map-side-combined ``max_by`` (a hot key is not one task)."""
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return agg.select(*keys, "_r.*")


def track_rollup(scores: DataFrame, alerts: DataFrame) -> DataFrame:
    """Latest score per track segment and whether its container has an open alert."""
    latest = latest_by(scores.filter("location IS NOT NULL"), ["location"],
                       cols=["container_id", "anomaly_score", "fault_class", "ts_us"])
    open_ = alerts.filter("state = 'unlabeled' AND container_id IS NOT NULL").select("container_id").distinct()
    flagged = latest.join(open_.withColumn("_open", F.lit(True)), "container_id", "left")
    return flagged.select("location", "container_id", "anomaly_score", "fault_class", "ts_us",
                          F.coalesce("_open", F.lit(False)).alias("alerting"))


def inference_egress(scores: DataFrame) -> DataFrame:
    span = (F.max("ts_us") - F.min("ts_us")) / 1e6
    return scores.agg((F.count(F.lit(1)) * 50.0 / F.greatest(span, F.lit(1.0))).alias("bytes_per_s"))


def p95_score(scores: DataFrame) -> DataFrame:
    return exact_percentiles(scores, [], "anomaly_score", {"p95": 0.95})


def boundary_bytes(policed: DataFrame, window_us: int = 60_000_000) -> DataFrame:
    """Bytes at the boundary per minute, class and disposition, metered before the filter."""
    slot = F.expr(f"(ts_us div {window_us}L) * {window_us}L")
    return (
        policed.groupBy(slot.alias("window_us"), "data_classification", "disposition")
        .agg(F.sum("bytes").alias("bytes"))
        .withColumn("bytes_per_s", F.col("bytes") / (window_us / 1e6))
    )


def latency_histogram(spans: DataFrame, keys, ms: str = "duration_ms") -> DataFrame:
    """Calls, total and cumulative bucket counts per key, one row per bucket bound."""
    keys = list(keys)
    aggs = [F.count_if(F.col(ms) <= b).alias(f"_b{i}") for i, b in enumerate(LATENCY_BUCKETS_MS)]
    agg = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum(ms).alias("sum_ms"), *aggs)
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(LATENCY_BUCKETS_MS)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("calls").alias("n")))
    return agg.select(*keys, "calls", "sum_ms", F.inline(F.array(*rows)))


def histogram_quantile(hist: DataFrame, keys, q: float) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket; the open bucket gives its lower bound.

    The window runs over the fixed handful of buckets of a key.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("le")
    rank = q * F.col("calls")
    h = hist.withColumns({"_pn": F.coalesce(F.lag("n").over(w), F.lit(0)),
                          "_pl": F.coalesce(F.lag("le").over(w), F.lit(0.0))})
    hit = h.filter((F.col("n") >= rank) & ((F.col("_pn") < rank) | (F.col("_pl") == 0)) & (F.col("calls") > 0))
    value = F.when(F.col("le") == float("inf"), F.col("_pl")).otherwise(
        F.col("_pl") + (F.col("le") - F.col("_pl")) * (rank - F.col("_pn")) / (F.col("n") - F.col("_pn")))
    return hit.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile_ms"))


def recent_traces(spans: DataFrame, n: int = 20) -> DataFrame:
    per = spans.groupBy("trace_id", "service").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_us").alias("s"), F.max("end_us").alias("e"))
    return (
        per.groupBy("trace_id").agg(
            F.min("s").alias("start_us"), F.max("e").alias("end_us"), F.sum("n").alias("n_spans"),
            F.count(F.lit(1)).alias("n_services"))
        .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
        .orderBy(F.desc("start_us"), F.desc("trace_id")).limit(n)
    )


def feed(df: DataFrame, n: int, *cols) -> DataFrame:
    """Newest n rows (a top-k, not a global sort)."""
    return df.orderBy(F.desc("ts_us"), F.desc(cols[0])).limit(n)


def retention(df: DataFrame, hours: int = 48) -> DataFrame:
    """Rows of the last ``hours`` before the newest one; the bound is a one-row scalar subquery."""
    bound = df.agg((F.max("ts_us") - F.lit(hours * 3_600_000_000)).alias("m")).scalar()
    return df.filter(F.col("ts_us") >= bound)


def health_checks(scores, alerts, labels, events, boundary) -> DataFrame:
    """One boolean per stage of the loop."""
    def check(df, name, cond):
        return df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias("ok")).select(
            F.lit(name).alias("check_name"), "ok")

    rate = boundary.groupBy("disposition").agg(F.sum("bytes").alias("b"))
    parts = [
        check(scores, "score_over_threshold", F.expr("anomaly_score >= 0.6")),
        check(alerts, "alert_exists", F.lit(True)),
        check(labels, "label_stored", F.lit(True)),
        check(events, "retrain_queued", F.expr("event_type = 'retrain_queued'")),
        check(events, "deployed", F.expr("event_type = 'deployed'")),
        check(rate, "blocked_rate", F.expr("disposition = 'blocked' AND b > 0")),
        check(rate, "egressed_rate", F.expr("disposition = 'egressed' AND b > 0")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
