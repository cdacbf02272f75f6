"""Queries behind dashboards, feeds and the alert / retrain loop."""

from pyspark.sql import functions as F

from ..operators import dashboards as D
from ..operators import lifecycle as L
from ..operators import messages as M
from . import bindings as B
from .registry import query

LO, HI = B.ORIGIN_US, B.ORIGIN_US + 20 * 86_400_000_000
_IN = f"ts_us BETWEEN {LO} AND {HI}"


@query("track_rollup_alerting", ("v_scores", "v_alerts"), """SELECT location, container_id, anomaly_score, fault_class, ts_us,
 container_id IN (SELECT container_id FROM v_alerts WHERE state='unlabeled') AS alerting
 FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY ts_us DESC, event_id DESC) AS rn FROM v_scores WHERE data_classification='inference') WHERE rn=1""")
def track_rollup_alerting(spark, sf):
    fwd = M.boundary_forward(M.boundary_policy(B.scores(spark, sf)))
    return D.track_rollup(fwd, B.alerts(spark, sf))


@query("containers_reporting", ("v_scores",), f"SELECT count(DISTINCT container_id) AS value FROM v_scores WHERE {_IN}")
def containers_reporting(spark, sf):
    return D.in_window(B.scores(spark, sf), LO, HI).agg(F.countDistinct("container_id").alias("value"))


@query("active_alerts", ("v_alerts",), "SELECT count(*) AS value FROM v_alerts WHERE state='unlabeled'")
def active_alerts(spark, sf):
    return B.alerts(spark, sf).filter("state = 'unlabeled'").agg(F.count(F.lit(1)).alias("value"))


@query("p95_score", ("v_scores",), f"SELECT round(quantile_cont(anomaly_score,0.95),9) AS p95 FROM v_scores WHERE {_IN}")
def p95_score(spark, sf):
    return D.p95_score(D.in_window(B.scores(spark, sf), LO, HI)).select(F.round("p95", 9).alias("p95"))


@query("inference_egress", ("v_scores",), f"""SELECT round(count(*)*50.0::DOUBLE/greatest((max(ts_us)-min(ts_us))/1e6,1),9) AS bytes_per_s FROM v_scores WHERE {_IN}""")
def inference_egress(spark, sf):
    return D.inference_egress(D.in_window(B.scores(spark, sf), LO, HI)).select(F.round("bytes_per_s", 9).alias("bytes_per_s"))


@query("labels_captured", ("v_labels",), "SELECT count(*) AS value FROM v_labels WHERE label<>'dismiss'")
def labels_captured(spark, sf):
    return B.labels(spark, sf).agg(F.count_if(F.col("label") != "dismiss").alias("value"))


@query("retrains_queued", ("v_model_events",), "SELECT count(*) AS value FROM v_model_events WHERE event_type='retrain_queued'")
def retrains_queued(spark, sf):
    return B.model_events(spark, sf).agg(F.count_if(F.col("event_type") == "retrain_queued").alias("value"))


@query("current_model_version", ("v_model_events",), """SELECT coalesce((SELECT model_version FROM v_model_events WHERE event_type='deployed'
 ORDER BY ts_us DESC, event_id DESC LIMIT 1),'baseline') AS value""")
def current_model_version(spark, sf):
    newest = F.max_by("model_version", F.when(F.col("event_type") == "deployed", F.struct("ts_us", "event_id")))
    return B.model_events(spark, sf).agg(F.coalesce(newest, F.lit("baseline")).alias("value"))


_POLICED = """(SELECT ts_us, coalesce(data_classification,'unknown') AS data_classification, bytes,
 CASE WHEN data_classification='inference' THEN 'egressed' ELSE 'blocked' END AS disposition FROM v_scores)"""


@query("boundary_bytes", ("v_scores",), f"""SELECT ts_us//60000000*60000000 AS window_us, data_classification, disposition, CAST(sum(bytes) AS BIGINT) AS bytes,
 sum(bytes)/60.0::DOUBLE AS bytes_per_s FROM {_POLICED} GROUP BY 1,2,3""")
def boundary_bytes(spark, sf):
    return D.boundary_bytes(M.boundary_policy(B.scores(spark, sf)))


@query("tumbling_rate", ("v_scores",), f"""SELECT ts_us//300000000*300000000 AS window_us, disposition, count(*) AS n, sum(bytes)/300.0::DOUBLE AS bytes_per_s FROM {_POLICED} GROUP BY 1,2""")
def tumbling_rate(spark, sf):
    p = M.boundary_policy(B.scores(spark, sf)).groupBy(F.window(F.timestamp_micros("ts_us"), "5 minutes").alias("w"), "disposition").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("bytes") / 300.0).alias("bytes_per_s"))
    return p.select(F.unix_micros("w.start").alias("window_us"), "disposition", "n", "bytes_per_s")


@query("sliding_windows", ("v_imu",), """SELECT session, w*500000 AS window_us, count(*) AS n, round(avg(value),6) AS mean FROM v_imu, (VALUES (0),(1)) d(d),
 LATERAL (SELECT t_us//500000-d AS w) GROUP BY 1,2""")
def sliding_windows(spark, sf):
    w = B.imu(spark, sf).groupBy("session", F.window(F.timestamp_micros("t_us"), "1 second", "500 milliseconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return w.select("session", F.unix_micros("w.start").alias("window_us"), "n", "mean")


_BK = ",".join(f"({b}::DOUBLE)" for b in D.LATENCY_BUCKETS_MS)
_HIST = f"""h AS (SELECT name, le, calls, sum_ms, n FROM (SELECT name, le, count(*) AS calls, sum(duration_ms) AS sum_ms, count(*) FILTER (duration_ms<=le) AS n
 FROM v_spans, (VALUES {_BK},('infinity'::DOUBLE)) b(le) GROUP BY 1,2))"""


@query("latency_histogram", ("v_spans",), f"WITH {_HIST} SELECT name, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, calls, round(sum_ms,3) AS sum_ms, n FROM h")
def latency_histogram(spark, sf):
    h = D.latency_histogram(B.spans(spark, sf), ["name"])
    return h.select("name", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "calls", F.round("sum_ms", 3).alias("sum_ms"), "n")


@query("histogram_quantile", ("v_spans",), f"""WITH {_HIST}, c AS (SELECT *, coalesce(lag(n) OVER w,0) AS pn, coalesce(lag(le) OVER w,0) AS pl, 0.5*calls AS r FROM h WINDOW w AS (PARTITION BY name ORDER BY le))
 SELECT name, round(arg_min(CASE WHEN isinf(le) THEN pl ELSE pl+(le-pl)*(r-pn)/(n-pn) END, le),6) AS quantile_ms FROM c WHERE n>=r AND (pn<r OR pl=0) GROUP BY 1""")
def histogram_quantile(spark, sf):
    h = D.latency_histogram(B.spans(spark, sf), ["name"])
    return D.histogram_quantile(h, ["name"], 0.5).select("name", F.round("quantile_ms", 6).alias("quantile_ms"))


@query("latest_score_gauge", ("v_scores", "v_alerts"), """SELECT 'anomaly_score' AS metric, container_id, anomaly_score AS value FROM
 (SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY ts_us DESC, event_id DESC) AS rn FROM v_scores) WHERE rn=1
 UNION ALL SELECT 'active_alerts', NULL, CAST(count(*) AS DOUBLE) FROM v_alerts WHERE state='unlabeled'""")
def latest_score_gauge(spark, sf):
    latest = D.latest_by(B.scores(spark, sf), ["container_id"], cols=["anomaly_score"])
    gauge = latest.select(F.lit("anomaly_score").alias("metric"), "container_id", F.col("anomaly_score").alias("value"))
    n = active_alerts(spark, sf).select(F.lit("active_alerts").alias("metric"), F.lit(None).cast("string").alias("container_id"), F.col("value").cast("double"))
    return gauge.unionByName(n)


@query("distinct_on_latest", ("v_labels",), """SELECT container_id AS location, label, feature_window_ref AS note, ts_us FROM
 (SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY ts_us DESC, event_id DESC) AS rn FROM v_labels) WHERE rn=1""")
def distinct_on_latest(spark, sf):
    r = D.latest_by(B.labels(spark, sf), ["container_id"], cols=["label", "feature_window_ref", "ts_us"])
    return r.select(F.col("container_id").alias("location"), "label", F.col("feature_window_ref").alias("note"), "ts_us")


@query("alert_feed", ("v_alerts",), "SELECT alert_id, ts_us, container_id, anomaly_score, state, label FROM v_alerts ORDER BY ts_us DESC, alert_id DESC LIMIT 50")
def alert_feed(spark, sf):
    return D.feed(B.alerts(spark, sf).select("alert_id", "ts_us", "container_id", "anomaly_score", "state", "label"), 50, "alert_id")


@query("open_alerts", ("v_alerts",), "SELECT alert_id, ts_us, container_id, anomaly_score FROM v_alerts WHERE state='unlabeled' ORDER BY ts_us DESC")
def open_alerts(spark, sf):
    a = B.alerts(spark, sf).filter("state = 'unlabeled'")
    return a.select("alert_id", "ts_us", "container_id", "anomaly_score").orderBy(F.desc("ts_us"), F.desc("alert_id"))


@query("model_event_feed", ("v_model_events",), "SELECT ts_us, event_type, model_version, detail FROM v_model_events ORDER BY ts_us DESC, event_id DESC LIMIT 20")
def model_event_feed(spark, sf):
    return D.feed(B.model_events(spark, sf), 20, "event_id").select("ts_us", "event_type", "model_version", "detail")


@query("annotations", ("v_model_events",), f"""SELECT ts_us, event_type||': '||coalesce(model_version,detail,'') AS text, event_type AS tags FROM v_model_events WHERE {_IN} ORDER BY ts_us""")
def annotations(spark, sf):
    e = D.in_window(B.model_events(spark, sf), LO, HI)
    return e.select("ts_us", F.concat("event_type", F.lit(": "), F.coalesce("model_version", "detail", F.lit(""))).alias("text"),
                    F.col("event_type").alias("tags")).orderBy("ts_us")


@query("score_series", ("v_scores",), f"SELECT container_id, event_id, ts_us, anomaly_score FROM v_scores WHERE {_IN} ORDER BY container_id, ts_us, event_id")
def score_series(spark, sf, container: str | None = None):
    """The score panel of every container, or of the one that the board's variable names."""
    s = D.in_window(B.scores(spark, sf), LO, HI)
    if container is not None:
        s = s.filter(F.col("container_id") == container)
    return s.select("container_id", "event_id", "ts_us", "anomaly_score").orderBy("container_id", "ts_us", "event_id")


@query("container_variable", ("v_scores",), "SELECT DISTINCT container_id FROM v_scores ORDER BY 1")
def container_variable(spark, sf):
    return B.scores(spark, sf).select("container_id").distinct().orderBy("container_id")


@query("recent_traces", ("v_spans",), """SELECT trace_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_spans, count(DISTINCT service) AS n_services,
 max(end_us)-min(start_us) AS duration_us FROM v_spans GROUP BY 1 ORDER BY start_us DESC, trace_id DESC LIMIT 20""")
def recent_traces(spark, sf):
    return D.recent_traces(B.spans(spark, sf))


@query("retention_48h", ("v_scores",), "SELECT event_id, ts_us FROM v_scores WHERE ts_us >= (SELECT max(ts_us) FROM v_scores)-48*3600000000")
def retention_48h(spark, sf):
    return D.retention(B.scores(spark, sf)).select("event_id", "ts_us")


@query("alert_lifecycle", ("v_alerts",), "SELECT * FROM v_alerts")
def alert_lifecycle(spark, sf):
    return B.alerts(spark, sf)


@query("score_has_open_alert", ("v_scores", "v_alerts"), """SELECT event_id, EXISTS (SELECT 1 FROM v_alerts a WHERE a.container_id=s.container_id AND a.state='unlabeled') AS has_open FROM v_scores s""")
def score_has_open_alert(spark, sf):
    return spark.sql("""SELECT s.event_id, EXISTS (SELECT 1 FROM {a} a WHERE a.container_id = s.container_id AND a.state = 'unlabeled') AS has_open
                        FROM {s} s""", s=B.scores(spark, sf), a=B.alerts(spark, sf))


@query("retrain_queue", ("v_model_events",), "SELECT ts_us, line, event_type, detail FROM v_model_events WHERE event_type='retrain_queued'")
def retrain_queue(spark, sf):
    return L.retrain_queue(B.labels(spark, sf), 5).select("ts_us", "line", "event_type", "detail")


@query("version_autoname", ("v_deploys",), "SELECT event_id, ts_us, line, model_version FROM v_deploys")
def version_autoname(spark, sf):
    return L.version_autoname(B.deploys(spark, sf)).select("event_id", "ts_us", "line", "model_version")


@query("desired_vs_observed", ("v_model_events",), """WITH d AS (SELECT 'line'||(s_suppkey%6+1) AS line, 'pdm-anomaly@retrained-'||max(s_suppkey) AS desired FROM supplier GROUP BY 1),
 o AS (SELECT line, arg_max(model_version, ts_us) AS observed FROM v_model_events WHERE event_type='deployed' GROUP BY 1)
 SELECT line, desired, observed FROM d LEFT JOIN o USING (line) WHERE desired IS DISTINCT FROM observed""")
def desired_vs_observed(spark, sf):
    d = B.table(spark, sf, "supplier").groupBy(F.concat(F.lit("line"), (F.col("s_suppkey") % 6 + 1).cast("string")).alias("line")).agg(
        F.concat(F.lit("pdm-anomaly@retrained-"), F.max("s_suppkey").cast("string")).alias("desired"))
    return L.desired_vs_observed(d, B.model_events(spark, sf))


@query("shadow_verdict", ("ev",), """WITH d AS (SELECT container_id, CASE WHEN k<20 THEN abs(k/1000) WHEN user_id<40 THEN abs((k%30)/1000) ELSE abs((k%50)/150-0.02) END AS d FROM ev)
 SELECT container_id, count(*) AS n, round(sum(d),6) AS sum_abs_delta, round(max(d),6) AS max_abs_delta, CASE WHEN max(d)>0.3 THEN 'ROLLBACK' WHEN count(*)<20 THEN 'PENDING'
  WHEN sum(d)/count(*)<=0.05 THEN 'PROMOTE' ELSE 'ROLLBACK' END AS verdict FROM d GROUP BY 1""")
def shadow_verdict(spark, sf):
    e = B._container(B.events(spark, sf))
    d = F.when(F.col("k") < 20, F.col("k") / 1000).when(F.col("user_id") < 40, F.col("k") % 30 / 1000).otherwise(F.col("k") % 50 / 150 - 0.02)
    v = L.shadow_verdict(e.select("container_id", F.lit(0.0).alias("old_score"), d.alias("new_score")), ["container_id"])
    return v.withColumns({c: F.round(c, 6) for c in ("sum_abs_delta", "max_abs_delta")})


_CMD = """c AS (SELECT line, ts_us, event_id, 0 AS kind, 'seg-'||(k%17+1) AS segment, 'fault-'||(k%5) AS label, k>=97 AS stop FROM ev WHERE event_type='purchase'),
 w AS (SELECT line, ts_us, event_id, 1 AS kind, 'seg-'||(k%17+1) AS segment FROM ev WHERE event_type='view'),
 a AS (SELECT *, sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY ts_us, kind, event_id) AS epoch FROM
   (SELECT * FROM c UNION ALL SELECT *, NULL, NULL FROM w)),
 f AS (SELECT line, epoch, segment, min(ts_us) AS t0 FROM a WHERE kind=0 AND NOT stop GROUP BY 1,2,3),
 ok AS (SELECT line, epoch, segment FROM (SELECT *, row_number() OVER (PARTITION BY line, epoch ORDER BY t0) AS r FROM f) WHERE r<=8)"""


@query("capture_watch_match", ("ev",), f"""WITH {_CMD} SELECT line, event_id, ts_us, segment, x.label, x.cid AS command_id FROM (
  SELECT a.line, a.event_id, a.ts_us, a.segment, (SELECT struct_pack(label:=arg_max(b.label,b.ts_us), cid:=max(b.event_id)) FROM a b WHERE b.kind=0 AND NOT b.stop AND b.line=a.line
    AND b.epoch=a.epoch AND b.segment=a.segment AND b.ts_us<=a.ts_us) AS x FROM a JOIN ok USING (line, epoch, segment) WHERE kind=1) WHERE x.cid IS NOT NULL""")
def capture_watch_match(spark, sf):
    e = B._container(B.events(spark, sf)).withColumns({
        "segment": F.concat(F.lit("seg-"), (F.col("k") % 17 + 1).cast("string")), "label": F.concat(F.lit("fault-"), (F.col("k") % 5).cast("string")),
        "stop": F.col("k") >= 97})
    return L.capture_watch(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["line"])


@query("span_pair", ("v_spans",), """SELECT c.trace_id, c.span_id, c.service AS client, c.end_us-c.start_us AS client_us, s.span_id AS server_span_id, s.service AS server, s.end_us-s.start_us AS server_us
 FROM v_spans c JOIN v_spans s ON s.trace_id=c.trace_id AND s.parent_id=c.span_id WHERE c.kind='CLIENT' AND s.kind='SERVER' AND abs(s.start_us-c.start_us)<=30000000""")
def span_pair(spark, sf):
    return L.span_pairs(B.spans(spark, sf))


@query("loop_health_checks", ("v_scores", "v_alerts", "v_labels", "v_model_events"), """SELECT 'score_over_threshold' AS check_name, EXISTS (SELECT 1 FROM v_scores WHERE anomaly_score>=0.6) AS ok
 UNION ALL SELECT 'alert_exists', EXISTS (SELECT 1 FROM v_alerts) UNION ALL SELECT 'label_stored', EXISTS (SELECT 1 FROM v_labels)
 UNION ALL SELECT 'retrain_queued', EXISTS (SELECT 1 FROM v_model_events WHERE event_type='retrain_queued')
 UNION ALL SELECT 'deployed', EXISTS (SELECT 1 FROM v_model_events WHERE event_type='deployed')
 UNION ALL SELECT 'blocked_rate', (SELECT sum(bytes)>0 FROM v_scores WHERE data_classification IS DISTINCT FROM 'inference')
 UNION ALL SELECT 'egressed_rate', (SELECT sum(bytes)>0 FROM v_scores WHERE data_classification='inference')""")
def loop_health_checks(spark, sf):
    return D.health_checks(B.scores(spark, sf), B.alerts(spark, sf), B.labels(spark, sf), B.model_events(spark, sf),
                           M.boundary_policy(B.scores(spark, sf)))
