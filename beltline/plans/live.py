"""The stateful operators as streaming queries, drained over the event files."""

from pyspark.sql import functions as F

from ..operators import messages as M
from ..streaming import localizer as LO
from ..streaming import processors as SP
from ..streaming import runs as R
from . import bindings as B
from .boards import _CMD, _POLICED
from .matching import _ASOF
from .oracle_views import staged_sql
from .registry import query


#: How much later than newer rows a row may come, and the pause after which an idle device is forgotten.
DELAY, IDLE_US = "30 minutes", 6 * 3600 * 1_000_000


def live_events(spark, sf):
    s = R.stream_files(spark, sf, "events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))
    return B._container(s.withColumn("ts_us", F.unix_micros("ts")))


@query("stateful_asof", ("v_scores", "v_fix"), f"SELECT line, container_id, event_id, ts_us, x, y, t_host_us AS pos_t_host_us FROM ({_ASOF})")
def stateful_asof(spark, sf):
    e = live_events(spark, sf).filter(F.col("event_type").isin("click", "error"))
    rows = e.select("line", "container_id", "event_id", "ts_us", (F.col("event_type") == "error").cast("int").alias("kind"),
                    (F.col("value") / 10).alias("x"), (F.col("k") / 10).alias("y"))
    return R.drain_ordered(spark, "asof", rows, SP.LastFix(), DELAY)


@query("state_ttl", ("ev",), f"""WITH s AS (SELECT container_id, ts_us, sum(b) OVER (PARTITION BY container_id ORDER BY ts_us) AS g FROM (SELECT *,
  CASE WHEN ts_us-lag(ts_us) OVER (PARTITION BY container_id ORDER BY ts_us)<={IDLE_US} THEN 0 ELSE 1 END AS b FROM ev))
 SELECT container_id, min(ts_us) AS opened_us, max(ts_us) AS last_us, max(ts_us)+{IDLE_US} AS evicted_us, count(*) AS n FROM s GROUP BY container_id, g""")
def state_ttl(spark, sf):
    """Every stay of a device in state: opened by its first row, evicted after a pause, opened anew by a later row."""
    return R.drain_ordered(spark, "ttl", live_events(spark, sf).select("container_id", "event_id", "ts_us"), SP.Activity(IDLE_US), DELAY)


@query("stateful_asof_ttl", ("v_scores", "v_fix", "ev"), f"""WITH s AS (SELECT event_id, sum(b) OVER (PARTITION BY container_id ORDER BY ts_us) AS g FROM (SELECT *,
  CASE WHEN ts_us-lag(ts_us) OVER (PARTITION BY container_id ORDER BY ts_us)<={IDLE_US} THEN 0 ELSE 1 END AS b FROM ev WHERE event_type IN ('click','error'))),
 f AS (SELECT container_id, ts_us, s.g FROM ev JOIN s USING (event_id) WHERE event_type='click'),
 j AS (SELECT a.*, s.g, f.g AS fg FROM ({_ASOF}) a JOIN s USING (event_id) LEFT JOIN f ON f.container_id=a.container_id AND f.ts_us=a.t_host_us)
 SELECT line, container_id, event_id, ts_us, CASE WHEN g=fg THEN x END AS x, CASE WHEN g=fg THEN y END AS y, CASE WHEN g=fg THEN t_host_us END AS pos_t_host_us FROM j""")
def stateful_asof_ttl(spark, sf):
    """The live as-of join with forgetting: a position does not outlive the pause that evicts its device."""
    e = live_events(spark, sf).filter(F.col("event_type").isin("click", "error"))
    rows = e.select("line", "container_id", "event_id", "ts_us", (F.col("event_type") == "error").cast("int").alias("kind"),
                    (F.col("value") / 10).alias("x"), (F.col("k") / 10).alias("y"))
    return R.drain_ordered(spark, "asof-ttl", rows, SP.LastFix().forgetting(IDLE_US), DELAY)


@query("stateful_alerts", ("v_alerts",), "SELECT * FROM v_alerts")
def stateful_alerts(spark, sf):
    e = live_events(spark, sf)
    score = F.struct(F.lit(0).alias("kind"), F.least(F.col("value") / 100, F.lit(1.0)).alias("anomaly_score"), F.lit(None).cast("string").alias("label"))
    label = F.struct(F.lit(1).alias("kind"), F.lit(None).cast("double").alias("anomaly_score"),
                     F.when(F.col("event_type") == "signup", "dismiss").otherwise("bearing wear").alias("label"))
    both = F.when(F.col("event_type").isin("purchase", "signup"), F.array(score, label)).otherwise(F.array(score))
    rows = e.select("container_id", "event_id", "ts_us", F.explode(both).alias("m")).select("container_id", "event_id", "ts_us", "m.*")
    out = R.drain_ordered(spark, "alerts", rows, SP.Alerts(), DELAY)
    return R.newest(out, ["container_id", "alert_id"], "version").drop("version")


@query("stateful_splitter", ("ev",), """SELECT s.event_id, round((s.k-50)*300/32768*coalesce(c.acc,4),9) AS acc_g, CAST(coalesce(c.acc,4) AS BIGINT) AS acc_range_g FROM
 (SELECT * FROM ev WHERE event_type<>'signup') s ASOF LEFT JOIN (SELECT ts_us, container_id, 2+k%15 AS acc FROM ev WHERE event_type='signup') c
 ON s.container_id=c.container_id AND s.ts_us>=c.ts_us""")
def stateful_splitter(spark, sf):
    rows = live_events(spark, sf).select("container_id", "event_id", "ts_us", (F.col("event_type") != "signup").cast("int").alias("kind"),
                                         (2 + F.col("k") % 15).alias("acc_range"), ((F.col("k") - 50) * 300).alias("raw"))
    out = R.drain_ordered(spark, "splitter", rows, SP.Ranges(), DELAY)
    return out.select("event_id", F.round("acc_g", 9).alias("acc_g"), "acc_range_g")


@query("stateful_stage", ("ev",), "WITH RECURSIVE " + staged_sql("""SELECT session, event_id AS id, v, row_number() OVER (PARTITION BY session ORDER BY ts_us, event_id) AS rn
  FROM (SELECT 's'||(user_id%8) AS session, event_id, ts_us, least(value/100,1.0::DOUBLE) AS v FROM ev)""", 0.45, 3, 4) + " SELECT session, id AS event_id, stage, trend FROM staged")
def stateful_stage(spark, sf):
    """Online staging of raw window scores (the tests compare it with the batch form)."""
    rows = live_events(spark, sf).select(F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("session"), "event_id", "ts_us",
                                         F.least(F.col("value") / 100, F.lit(1.0)).alias("v"))
    return R.drain_ordered(spark, "stage", rows, SP.Stages(v_thr=0.45, dwell=3, release=4), DELAY)


@query("stateful_shadow", ("ev",), """WITH d AS (SELECT container_id, CASE WHEN k<20 THEN abs(k/1000) WHEN user_id<40 THEN abs((k%30)/1000) ELSE abs((k%50)/150-0.02) END AS d FROM ev)
 SELECT container_id, count(*) AS n, round(sum(d),6) AS sum_abs_delta, round(max(d),6) AS max_abs_delta, CASE WHEN max(d)>0.3 THEN 'ROLLBACK' WHEN count(*)<20 THEN 'PENDING'
  WHEN sum(d)/count(*)<=0.05 THEN 'PROMOTE' ELSE 'ROLLBACK' END AS verdict FROM d GROUP BY 1""")
def stateful_shadow(spark, sf):
    d = F.when(F.col("k") < 20, F.col("k") / 1000).when(F.col("user_id") < 40, F.col("k") % 30 / 1000).otherwise(F.col("k") % 50 / 150 - 0.02)
    rows = live_events(spark, sf).select("container_id", "event_id", "ts_us", F.lit(0.0).alias("old_score"), d.alias("new_score"))
    out = R.newest(R.drain_ordered(spark, "shadow", rows, SP.Shadow(), DELAY), ["container_id"], "n")
    return out.select("container_id", "n", F.round("sum_abs_delta", 6).alias("sum_abs_delta"), F.round("max_abs_delta", 6).alias("max_abs_delta"), "verdict")


@query("stateful_capture", ("ev",), f"""WITH {_CMD} SELECT line, event_id, ts_us, segment, x.label, x.cid AS command_id FROM (
  SELECT a.line, a.event_id, a.ts_us, a.segment, (SELECT struct_pack(label:=arg_max(b.label,b.ts_us), cid:=max(b.event_id)) FROM a b WHERE b.kind=0 AND NOT b.stop AND b.line=a.line
    AND b.epoch=a.epoch AND b.segment=a.segment AND b.ts_us<=a.ts_us) AS x FROM a JOIN ok USING (line, epoch, segment) WHERE kind=1) WHERE x.cid IS NOT NULL""")
def stateful_capture(spark, sf):
    rows = live_events(spark, sf).filter(F.col("event_type").isin("purchase", "view")).select(
        "line", "event_id", "ts_us", (F.col("event_type") == "view").cast("int").alias("kind"),
        F.concat(F.lit("seg-"), (F.col("k") % 17 + 1).cast("string")).alias("segment"), F.concat(F.lit("fault-"), (F.col("k") % 5).cast("string")).alias("label"),
        ((F.col("k") >= 97) & (F.col("event_type") == "purchase")).alias("stop"))
    return R.drain_ordered(spark, "capture", rows, SP.Capture(), DELAY)


@query("stateful_localizer")
def stateful_localizer(spark, sf):
    """Position fixes from interleaved camera, inertial and magnetic rows, in recorded time (tests: golden scenarios, one slice or many)."""
    e = live_events(spark, sf)
    k = F.col("k")
    rows = e.select(
        F.concat(F.lit("line"), (F.col("user_id") % 4 + 1).cast("string")).alias("line"), F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("container_id"),
        "event_id", F.call_function("div", F.col("ts_us") - B.ORIGIN_US, F.lit(B.SPEED_UP).cast("bigint")).alias("ts_us"),
        F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "signup", 1).otherwise(0).alias("kind"),
        ((k - 50) / 1000).alias("ax"), ((k * 7 % 100 - 50) / 1000).alias("ay"), (F.col("value") - 50).alias("gz"), (k * 37 % 100 - 30).cast("double").alias("mx"),
        (k * 53 % 100 - 20).cast("double").alias("my"), (k / 100).alias("dark"), (F.col("value") / 100).alias("net"))
    return LO.placed(R.drain_ordered(spark, "localizer", rows, LO.Localizer(win_s=2.0), "1 second"), "BL")


@query("stream_tumbling_rate", ("v_scores",), f"""SELECT * FROM (SELECT ts_us//300000000*300000000 AS window_us, disposition, count(*) AS n, sum(bytes)/300.0::DOUBLE AS bytes_per_s FROM {_POLICED} GROUP BY 1,2)
 WHERE window_us+300000000 <= ((SELECT max(ts_us) FROM v_scores)-600000000)//1000*1000""")
def stream_tumbling_rate(spark, sf):
    """Append mode: a window comes out once the watermark (10 minutes late) has passed it."""
    e = live_events(spark, sf)
    cls = F.when(F.col("event_type").isin("view", "error"), "inference").when(F.col("event_type") == "click", "raw").when(F.col("event_type") == "purchase", "features")
    p = M.boundary_policy(e.select("ts", cls.alias("data_classification"), (F.length("props") * 10).cast("bigint").alias("bytes")))
    w = p.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes").alias("w"), "disposition").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("bytes") / 300.0).alias("bytes_per_s"))
    return R.drain(spark, "rate", w.select(F.unix_micros("w.start").alias("window_us"), "disposition", "n", "bytes_per_s"))


@query("stream_session_events", ("ev",), """WITH s AS (SELECT container_id, ts_us, sum(b) OVER (PARTITION BY container_id ORDER BY ts_us) AS g FROM (SELECT *, CASE WHEN ts_us-lag(ts_us) OVER (PARTITION BY container_id ORDER BY ts_us)<=36000000000 THEN 0 ELSE 1 END AS b FROM ev)),
 a AS (SELECT container_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n FROM s GROUP BY container_id, g)
 SELECT * FROM a WHERE end_us+36000000000 <= ((SELECT max(ts_us) FROM ev)-600000000)//1000*1000""")
def stream_session_events(spark, sf):
    """Gap clustering on a stream; sessions still open at the watermark stay in state."""
    e = live_events(spark, sf).withWatermark("ts", "10 minutes").groupBy("container_id", F.session_window("ts", "10 hours")).agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("n"))
    return R.drain(spark, "sessions", e.select("container_id", "start_us", "end_us", "n"))


@query("dedupe_replay", ("ev",), "SELECT event_id, container_id, ts_us FROM ev")
def dedupe_replay(spark, sf):
    """Every message delivered twice; the second delivery is dropped within the watermark."""
    e = live_events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "1 hour")
    return R.drain(spark, "dedupe", e.dropDuplicatesWithinWatermark(["container_id", "ts"]).select("event_id", "container_id", "ts_us"))


@query("latest_frame_state", ("ev",), "SELECT line, arg_max(event_id, ts_us) AS frame_no, max(ts_us) AS host_us FROM ev WHERE event_type='view' GROUP BY 1")
def latest_frame_state(spark, sf):
    e = live_events(spark, sf).filter("event_type = 'view'").groupBy("line").agg(F.max_by("event_id", "ts_us").alias("frame_no"), F.max("ts_us").alias("host_us"))
    return R.drain_upserts(spark, "frames", e, ["line"], "host_us")


@query("stream_source", ("ev",), "SELECT event_id, line, container_id FROM ev WHERE event_type='click'")
def stream_source(spark, sf):
    """Subscription by wildcard subject over a file stream."""
    e = live_events(spark, sf)
    kind = F.when(F.col("event_type") == "click", "imu").otherwise("camera")
    e = e.select("event_id", M.edge_subject(F.col("line"), F.col("container_id"), kind).alias("subject"))
    return R.drain(spark, "source", M.parse_subject(R.subject_filter(e, "edge.imu.*.*")).select("event_id", "line", "container_id"))


@query("table_sinks", ("ev",), "SELECT CASE WHEN event_type IN ('purchase','signup') THEN 'labels' ELSE 'scores' END AS target, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM ev GROUP BY 1")
def table_sinks(spark, sf):
    """One stream routed into its tables through ``foreachBatch``; read back per table."""
    from ..session import run_dir

    e = live_events(spark, sf).select("event_id", "ts_us", "container_id", F.when(F.col("event_type").isin("purchase", "signup"), "labels").otherwise("scores").alias("target"))
    base = run_dir(spark, "tables")
    q = e.writeStream.foreachBatch(R.sink_tables(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = e.drop("target").schema
    parts = [spark.read.schema(schema).parquet(f"{base}/out/{t}/batch=*").withColumn("target", F.lit(t)) for t in ("scores", "labels")]
    return parts[0].unionByName(parts[1]).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))
