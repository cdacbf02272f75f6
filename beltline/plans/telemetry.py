"""Queries on messages, the trust boundary, track geometry and model gates."""

from pyspark.sql import functions as F

from ..operators import messages as M
from ..operators import track as TR
from . import bindings as B
from .registry import query


def _json_events(spark, sf):
    """Events as inference messages on the wire; each event type is malformed in its own way."""
    e = B._container(B.events(spark, sf))
    ts = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    q = F.lit('"')
    num = F.col("value").cast("string")
    head = F.concat(F.lit('{"ts":"'), ts)
    return e.withColumn(
        "value_json",
        F.when(F.col("event_type") == "click", F.concat(head, F.lit('Z","anomaly_score":'), num, F.lit(',"container_id":"'), F.col("container_id"), F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(head, F.lit('+00:00","container_id":"'), F.col("container_id"), F.lit('","anomaly_score":"'), num, q, F.lit(',"bytes":"x"}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"anomaly_score":'), num, F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(head, F.lit('","anomaly_score":"high"}')))
        .otherwise(F.lit("boot v1.2 #")))


@query("parse_inference", ("ev",), """SELECT event_id, ts_us, container_id, value AS anomaly_score FROM ev
 WHERE event_type IN ('click','purchase')""")
def parse_inference(spark, sf):
    ok, _ = M.parse_inference(_json_events(spark, sf).select("event_id", "value_json"), "value_json", keep=("event_id",))
    return ok.select("event_id", "ts_us", "container_id", "anomaly_score")


@query("quarantine", ("ev",), "SELECT event_type, count(*) AS n FROM ev WHERE event_type IN ('view','error','signup') GROUP BY 1")
def quarantine(spark, sf):
    _, bad = M.parse_inference(_json_events(spark, sf).select("event_id", "event_type", "value_json"), "value_json")
    return bad.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("parse_label", ("ev",), """SELECT event_id, ts_us, container_id, 'bearing wear' AS label FROM ev WHERE event_type='purchase'""")
def parse_label(spark, sf):
    e = _json_events(spark, sf)
    raw = F.when(F.col("event_type") == "purchase", F.concat(
        F.regexp_replace("value_json", '"bytes":"x"}', '"label":"bearing wear"}'))).otherwise(F.col("value_json"))
    ok, _ = M.parse_label(e.select("event_id", raw.alias("value")), keep=("event_id",))
    return ok.select("event_id", "ts_us", "container_id", "label")


@query("parse_deploy", ("ev",), "SELECT event_id, CASE WHEN event_type='error' THEN ts_us END AS ts_us, 'm-'||k AS model_version FROM ev WHERE event_type IN ('error','view')")
def parse_deploy(spark, sf):
    e = _json_events(spark, sf)
    v = F.concat(F.lit('"model_version":"m-'), F.col("k").cast("string"), F.lit('",'))
    raw = F.when(F.col("event_type").isin("error", "view"), F.concat(F.lit("{"), v, F.substring("value_json", F.lit(2), F.length("value_json")))).otherwise(F.col("value_json"))
    ok, _ = M.parse_deploy(e.select("event_id", raw.alias("value")), keep=("event_id",))
    return ok.select("event_id", "ts_us", "model_version")


@query("parse_capture", ("ev",), "SELECT event_id, k AS seq, base64(encode(props)) AS features_b64 FROM ev WHERE event_type='click'")
def parse_capture(spark, sf):
    e = _json_events(spark, sf)
    raw = F.when(F.col("event_type") == "click", F.concat(
        F.lit('{"seq":'), F.col("k").cast("string"), F.lit(',"features_b64":"'), F.base64(F.encode("props", "utf-8")), F.lit('"}'))
    ).otherwise(F.col("value_json"))
    ok, _ = M.parse_capture(e.select("event_id", raw.alias("value")), keep=("event_id",))
    return ok.select("event_id", "seq", "features_b64")


@query("parse_device_line", ("ev",), """SELECT event_id, container_id, value AS anomaly_score, 'inference' AS data_classification,
 CAST(strlen('{"container_id":"'||container_id||'","anomaly_score":'||k||'}') AS BIGINT) AS bytes
 FROM (SELECT event_id, container_id, CAST(k AS DOUBLE) AS value, k, event_type FROM ev) WHERE event_type IN ('click','purchase')""")
def parse_device_line(spark, sf):
    e = B._container(B.events(spark, sf))
    good = F.concat(F.lit('  {"container_id":"'), F.col("container_id"), F.lit('","anomaly_score":'), F.col("k").cast("string"), F.lit("} "))
    line = (F.when(F.col("event_type").isin("click", "purchase"), F.encode(good, "utf-8"))
            .when(F.col("event_type") == "view", F.unhex(F.lit("FFFE7B7D")))
            .when(F.col("event_type") == "signup", F.encode(F.lit("   "), "utf-8"))
            .otherwise(F.encode(F.lit('[1, 2]'), "utf-8")))
    out = M.parse_device_line(e.select("event_id", line.alias("raw")), keep=("event_id",))
    return out.select("event_id", "container_id", "anomaly_score", "data_classification", "bytes")


@query("parse_cfg", ("ev",), """SELECT event_id, k AS acc_odr, 4 AS acc_range, 200 AS gyr_odr, CAST(floor(value) AS BIGINT) AS gyr_range,
 CASE WHEN event_type='click' THEN 'low' ELSE 'normal' END AS power FROM ev WHERE event_type IN ('click','view')""")
def parse_cfg(spark, sf):
    e = B.events(spark, sf)
    base = F.concat(F.lit("cfg,"), F.col("k").cast("string"), F.lit(",4,200,"), F.floor("value").cast("string"))
    cmd = (F.when(F.col("event_type") == "click", F.concat(base, F.lit(",low"))).when(F.col("event_type") == "view", base)
           .when(F.col("event_type") == "error", F.lit("CFG,1,x,2,3")).otherwise(F.lit("PING")))
    c = e.select("event_id", M.parse_cfg(cmd).alias("c")).filter("c IS NOT NULL")
    return c.select("event_id", *[F.col(f"c.{n}").cast("bigint").alias(n) for n in ("acc_odr", "acc_range", "gyr_odr", "gyr_range")], "c.power")


@query("boundary_policy", ("v_scores",), """SELECT event_id, coalesce(data_classification,'unknown') AS data_classification, bytes,
 CASE WHEN data_classification='inference' THEN 'egressed' ELSE 'blocked' END AS disposition FROM v_scores""")
def boundary_policy(spark, sf):
    return M.boundary_policy(B.scores(spark, sf)).select("event_id", "data_classification", "bytes", "disposition")


@query("boundary_forward", ("v_scores",), """SELECT event_id, ts_us, container_id, line, anomaly_score, model_version, fault_class, location
 FROM v_scores WHERE data_classification='inference'""")
def boundary_forward(spark, sf):
    return M.boundary_forward(M.boundary_policy(B.scores(spark, sf)))


_SUBJECTS = """SELECT event_id, line, container_id, CASE WHEN event_type='click' THEN 'anomaly' ELSE event_type||'-data' END AS kind FROM ev"""


@query("subject_parse", ("ev",), _SUBJECTS)
def subject_parse(spark, sf):
    e = B._container(B.events(spark, sf))
    subject = F.when(F.col("event_type") == "click", M.edge_subject(F.col("line"), F.col("container_id"))).otherwise(
        M.edge_subject(F.col("line"), F.col("container_id"), F.concat("event_type", F.lit("-data"))))
    return M.parse_subject(e.select("event_id", subject.alias("subject"))).select("event_id", "line", "container_id", "kind")


@query("subject_build", ("ev",), """SELECT event_id, 'labels.'||line||'.'||container_id AS label_subject, 'models.'||line||'.deploy' AS deploy_subject,
 'capture.'||line||'.'||container_id||'.cmd' AS capture_subject FROM ev""")
def subject_build(spark, sf):
    e = B._container(B.events(spark, sf))
    line, c = F.col("line"), F.col("container_id")
    return e.select("event_id", M.label_subject(line, c).alias("label_subject"), M.deploy_subject(line).alias("deploy_subject"),
                    M.capture_subject(line, c).alias("capture_subject"))


@query("ts_to_unix_us", ("ev",), "SELECT event_id, CASE WHEN event_type<>'signup' THEN ts_us END AS ts_us FROM ev")
def ts_to_unix_us(spark, sf):
    e = B.events(spark, sf)
    t = F.timestamp_micros("ts_us")
    text = (F.when(F.col("event_type") == "click", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            .when(F.col("event_type") == "view", F.concat(F.date_format(t + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
            .when(F.col("event_type") == "signup", F.lit("yesterday"))
            .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return e.select("event_id", M.ts_to_unix_us(text).alias("ts_us"))


@query("valid_label", ("ev",), """SELECT event_id, event_type IN ('click','view') AS label_ok, event_type IN ('click','view','error') AS fault_ok FROM ev""")
def valid_label(spark, sf):
    from .. import schemas as S

    name = (F.when(F.col("event_type") == "click", "bearing wear").when(F.col("event_type") == "view", "dismiss")
            .when(F.col("event_type") == "error", "servo motor").otherwise(F.col("event_type")))
    e = B.events(spark, sf).withColumn("label", name)
    return e.select("event_id", F.col("label").isin(*S.VALID_LABELS).alias("label_ok"),
                    F.col("label").isin(*S.TRACK_FAULTS).alias("fault_ok"))


@query("segment_grid", ("v_fix",), """SELECT event_id, line||'.station-'||chr(CAST(65+greatest(0,CAST(floor((y-3)/5) AS INT))%26 AS INT))||
 CAST(floor((x-4)/5) AS INT) AS segment FROM v_fix""")
def segment_grid(spark, sf):
    return B.fixes(spark, sf).select("event_id", TR.segment_grid(F.col("x") - 4, F.col("y") - 3, F.col("line")).alias("segment"))


_XY = """CASE WHEN p<160 THEN {b} WHEN p<620 THEN {l} WHEN p<780 THEN {t} ELSE {r} END"""
XY_SQL = (_XY.format(b="120-120*(p/160)", l="0.0::DOUBLE", t="120*((p-620)/160)", r="120.0::DOUBLE"),
          _XY.format(b="0.0::DOUBLE", l="420*((p-160)/460)", t="420.0::DOUBLE", r="420-420*((p-780)/460)"),
          _XY.format(b="'bottom'", l="'left'", t="'top'", r="'right'"))


@query("cum_to_xy", ("ev",), f"""SELECT event_id, round({XY_SQL[0]},6) AS x, round({XY_SQL[1]},6) AS y, {XY_SQL[2]} AS piece
 FROM (SELECT event_id, (value*7-100) - floor((value*7-100)/1240)*1240 AS p FROM ev)""")
def cum_to_xy(spark, sf):
    e = B.events(spark, sf).select("event_id", TR.cum_to_xy(F.col("value") * 7 - 100).alias("p"))
    return e.select("event_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), "p.piece")


@query("fuse_scores", ("ev",), """SELECT event_id, round(greatest(value/500, CASE WHEN k>50 THEN k/100 END),6) AS anomaly_score,
 round(CASE WHEN k>50 THEN k/100 END,6) AS acoustic_score, round(value/500,6) AS vibration_score FROM ev""")
def fuse_scores(spark, sf):
    from ..operators.staging import fuse

    e = B.events(spark, sf).withColumns({"v": F.col("value") / 500, "a": F.when(F.col("k") > 50, F.col("k") / 100)})
    return e.select("event_id", fuse(F.col("v"), F.col("a"), 6).alias("anomaly_score"), F.round("a", 6).alias("acoustic_score"),
                    F.round("v", 6).alias("vibration_score"))


@query("gate_model", ("v_profiles",), """WITH m AS (SELECT *, cpu_operators/(cpu_operators+npu_operators) AS ratio, artifact_bytes/1024 AS kib FROM v_profiles),
 c AS (SELECT network, 'SRAM working set' AS check_name, total_sram_used AS measured, 3500.0::DOUBLE AS budget FROM m
  UNION ALL SELECT network, 'Inference latency', batch_inference_time, 50.0 FROM m
  UNION ALL SELECT network, 'CPU-fallback ratio', ratio, 0.1 FROM m
  UNION ALL SELECT network, 'Flatbuffer size', kib, 1024.0 FROM m WHERE kib IS NOT NULL)
 SELECT network, check_name, measured, budget, measured<=budget AS ok, bool_and(measured<=budget) OVER (PARTITION BY network) AS passed FROM c""")
def gate_model(spark, sf):
    return M.gate_model(B.profiles(spark, sf))


@query("normalize_profile", ("v_profiles",), """SELECT network, round(total_sram_used/7,3) AS total_sram_used, round(batch_inference_time/3,3) AS total_off_chip_flash_used,
 CAST(cpu_operators AS BIGINT) AS cpu_operators, CAST(npu_operators AS BIGINT) AS npu_operators, round(batch_inference_time/1000*1000.0,4) AS batch_inference_time FROM v_profiles""")
def normalize_profile(spark, sf):
    p = B.profiles(spark, sf).select(
        "network", (F.col("total_sram_used") / 7).alias("sram_memory_used"), (F.col("batch_inference_time") / 3).alias("off_chip_flash_memory_used"),
        (F.col("batch_inference_time") / 1000).alias("inference_time"),
        F.concat(F.lit("Network summary\nCPU operators = "), F.col("cpu_operators").cast("bigint").cast("string"),
                 F.lit(" (1%)\nNPU operators  = "), F.col("npu_operators").cast("bigint").cast("string"), F.lit("\n")).alias("stdout"))
    out = M.normalize_profile(p)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("cpu_operators", "npu_operators")})


def _fleet(spark, sf):
    s = B.table(spark, sf, "supplier")
    role = F.element_at(F.array(*[F.lit(r) for r in ("device", "vector", "bridge", "fakegen", "pipeline")]), F.col("s_nationkey") % 5 + 1)
    return s.select(F.concat(F.lit("id-"), F.col("s_suppkey").cast("string")).alias("id"), role.alias("role"),
                    F.concat(F.lit("line"), (F.col("s_suppkey") % 3).cast("string")).alias("line"))


_FLEET_SQL = """f AS (SELECT 'id-'||s_suppkey AS id, ['device','vector','bridge','fakegen','pipeline'][s_nationkey%5+1] AS role, 'line'||(s_suppkey%3) AS line FROM supplier),
 acl AS (SELECT id, role, line, CASE role WHEN 'device' THEN ['edge.'||line||'.'||id,'capture.'||line||'.'||id||'.data'] WHEN 'vector' THEN ['inference.>']
   WHEN 'bridge' THEN ['labels.>','models.>','control.>','$JS.API.>','$JS.ACK.>'] WHEN 'fakegen' THEN ['edge.'||line||'.>'] ELSE ['models.>'] END AS publish,
  CASE role WHEN 'device' THEN ['models.'||line||'.deploy','models.'||line||'.artifact','control.'||line,'capture.'||line||'.'||id||'.cmd'] WHEN 'vector' THEN ['edge.>']
   WHEN 'bridge' THEN ['inference.>','labels.>','models.>','_INBOX.>','$JS.API.>'] WHEN 'fakegen' THEN ['control.'||line] ELSE [] END AS subscribe FROM f)"""


@query("device_acl", (), f"WITH {_FLEET_SQL} SELECT id, role, array_to_string(publish,' ') AS publish, array_to_string(subscribe,' ') AS subscribe FROM acl")
def device_acl(spark, sf):
    acl = M.permissions(_fleet(spark, sf))
    return acl.select("id", "role", F.array_join("publish", " ").alias("publish"), F.array_join("subscribe", " ").alias("subscribe"))


@query("acl_audit", (), f"""WITH {_FLEET_SQL}, p AS (SELECT 'id-'||l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN 'edge.line'||(l_suppkey%3)||'.id-'||l_suppkey
  WHEN 'N' THEN 'models.line1.deploy' ELSE 'inference.line'||l_linenumber END AS subject FROM lineitem)
 SELECT p.id, subject, count(*) AS n_messages FROM p LEFT JOIN acl ON p.id=acl.id
 WHERE NOT coalesce(list_bool_or(list_transform(publish, lambda x: regexp_full_match(subject,
   regexp_replace(replace(replace(replace(x,'.','[.]'),'$','[$]'),'*','[^.]+'),'>$','.+')))),false) GROUP BY 1,2""")
def acl_audit(spark, sf):
    sent = B.table(spark, sf, "lineitem").select(
        F.concat(F.lit("id-"), F.col("l_suppkey").cast("string")).alias("id"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("edge.line"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".id-"), F.col("l_suppkey").cast("string")))
        .when(F.col("l_returnflag") == "N", "models.line1.deploy")
        .otherwise(F.concat(F.lit("inference.line"), F.col("l_linenumber").cast("string"))).alias("subject"))
    return M.acl_violations(sent, M.permissions(_fleet(spark, sf)))


@query("annotation_fanout", ("ev",), """WITH a AS (SELECT event_id, ts_us, line, container_id, 'seg-'||(k%17+1) AS location,
   CASE event_type WHEN 'purchase' THEN 'bearing wear' WHEN 'signup' THEN 'dismiss' WHEN 'error' THEN 'track bump' ELSE 'paint' END AS fault,
   CASE WHEN k>50 THEN 'n'||k ELSE '' END AS note FROM ev)
 SELECT event_id, ts_us, 'labels.'||line||'.'||location AS subject, 'label' AS message, location, fault AS label,
  CASE WHEN note='' THEN 'track:'||location ELSE note END AS note, NULL AS request_id FROM a WHERE fault<>'paint'
 UNION ALL SELECT event_id, ts_us, 'capture.'||line||'.'||container_id||'.cmd', 'capture', location, fault, NULL, 'cap-annotate-'||location
 FROM a WHERE fault NOT IN ('paint','dismiss')""")
def annotation_fanout(spark, sf):
    e = B._container(B.events(spark, sf))
    fault = (F.when(F.col("event_type") == "purchase", "bearing wear").when(F.col("event_type") == "signup", "dismiss")
             .when(F.col("event_type") == "error", "track bump").otherwise("paint"))
    return M.annotation_fanout(e.select(
        "event_id", "ts_us", "line", "container_id", F.concat(F.lit("seg-"), (F.col("k") % 17 + 1).cast("string")).alias("location"),
        fault.alias("fault"), F.when(F.col("k") > 50, F.concat(F.lit("n"), F.col("k").cast("string"))).otherwise("").alias("note")))


def _ring_sql():
    rows = ",".join(f"('{lo}',{i},'{p}',{TR.piece_size(p)[0]}::DOUBLE,{TR.piece_size(p)[1]})" for lo, r in TR.RINGS.items() for i, p in enumerate(r.split()))
    return f"""ring(loop,pos,piece,length_cm,wheels) AS (VALUES {rows}),
 nodes AS (SELECT *, 'J:'||coalesce(lag(piece) OVER w, last_value(piece) OVER a)||'->'||piece AS point_in,
   'J:'||piece||'->'||coalesce(lead(piece) OVER w, first_value(piece) OVER a) AS point_out,
   coalesce(sum(length_cm) OVER b,0) AS cum_cm_start, CAST(coalesce(sum(wheels) OVER b,0) AS BIGINT) AS cum_wheels_start,
   sum(length_cm) OVER a AS loop_cm, CAST(sum(wheels) OVER a AS BIGINT) AS loop_wheels FROM ring
   WINDOW w AS (PARTITION BY loop ORDER BY pos), a AS (PARTITION BY loop ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
   b AS (PARTITION BY loop ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _on_loop(spark, sf):
    return B.events(spark, sf).select(
        "event_id", F.when(F.col("k") % 2 == 0, "upper").otherwise("lower").alias("loop"), (F.col("value") * 9 + 0.0013).alias("cm"),
        (F.col("k") * 3).alias("wheel_count"))


_ON_LOOP = "q AS (SELECT event_id, CASE WHEN k%2=0 THEN 'upper' ELSE 'lower' END AS loop, value*9+0.0013::DOUBLE AS cm, k*3 AS wheel_count FROM ev)"


@query("ring_prefix_sum", ("ev",), f"""WITH {_ring_sql()}, {_ON_LOOP} SELECT n.loop, n.piece, point_in, point_out, cum_cm_start, cum_wheels_start, c.n_passes
 FROM nodes n JOIN (SELECT loop, count(*) AS n_passes FROM q GROUP BY 1) c ON n.loop=c.loop""")
def ring_prefix_sum(spark, sf):
    passes = _on_loop(spark, sf).groupBy("loop").agg(F.count(F.lit(1)).alias("n_passes"))
    nodes = TR.ring_prefix_sum(TR.rings(spark))
    return nodes.join(passes, "loop").select("loop", "piece", "point_in", "point_out", "cum_cm_start", "cum_wheels_start", "n_passes")


@query("cm_to_pos", ("ev",), f"""WITH {_ring_sql()}, {_ON_LOOP} SELECT event_id, q.loop, piece, point_in, point_out, round(c,2) AS cum_cm,
  round(100*(c-cum_cm_start)/length_cm,1) AS pct FROM (SELECT q.*, cm-floor(cm/t)*t AS c FROM q JOIN (SELECT DISTINCT loop, loop_cm AS t FROM nodes) x ON q.loop=x.loop) q
  JOIN nodes n ON n.loop=q.loop AND c>=cum_cm_start AND c<cum_cm_start+length_cm""")
def cm_to_pos(spark, sf):
    return TR.cm_to_pos(_on_loop(spark, sf), TR.rings(spark)).select("event_id", "loop", "piece", "point_in", "point_out", "cum_cm", "pct")


@query("wheels_to_pos", ("ev",), f"""WITH {_ring_sql()}, {_ON_LOOP} SELECT event_id, q.loop, piece, c AS cum_wheels, round(100.0::DOUBLE*(c-cum_wheels_start)/wheels,1) AS pct
  FROM (SELECT q.*, wheel_count%t AS c FROM q JOIN (SELECT DISTINCT loop, loop_wheels AS t FROM nodes) x ON q.loop=x.loop) q
  JOIN nodes n ON n.loop=q.loop AND c>=cum_wheels_start AND c<cum_wheels_start+wheels""")
def wheels_to_pos(spark, sf):
    return TR.wheels_to_pos(_on_loop(spark, sf), TR.rings(spark)).select("event_id", "loop", "piece", "cum_wheels", "pct")


@query("pos_to_cm", ("ev",), f"""WITH {_ring_sql()}, {_ON_LOOP} SELECT event_id, q.loop, n.piece, round(cum_cm_start+q.wheel_count%101/100*length_cm,6) AS cm
  FROM q JOIN nodes n ON n.loop=q.loop AND n.piece='M_BAR1'""")
def pos_to_cm(spark, sf):
    q = _on_loop(spark, sf).select("event_id", "loop", F.lit("M_BAR1").alias("piece"), (F.col("wheel_count") % 101).cast("double").alias("pct"))
    return TR.pos_to_cm(q, TR.rings(spark)).select("event_id", "loop", "piece", F.round("cm", 6).alias("cm"))


@query("undirected_edges", ("ev",), f"""WITH {_ring_sql()}, {_ON_LOOP}, e AS (SELECT DISTINCT loop, least(piece,nx) AS a, greatest(piece,nx) AS b FROM
  (SELECT loop, piece, coalesce(lead(piece) OVER (PARTITION BY loop ORDER BY pos), first_value(piece) OVER (PARTITION BY loop ORDER BY pos)) AS nx FROM ring)),
  d AS (SELECT a, b, 'P'||lpad(CAST(row_number() OVER (ORDER BY a,b)-1 AS VARCHAR),2,'0') AS point_id FROM (SELECT DISTINCT a,b FROM e))
 SELECT d.a, d.b, point_id, CAST(sum(n) AS BIGINT) AS n_passes FROM d JOIN e USING (a,b) JOIN (SELECT loop, count(*) AS n FROM q GROUP BY 1) c USING (loop) GROUP BY 1,2,3""")
def undirected_edges(spark, sf):
    ring = TR.rings(spark)
    passes = _on_loop(spark, sf).groupBy("loop").agg(F.count(F.lit(1)).alias("n"))
    named = TR.undirected_edges(ring)
    per_loop = TR.undirected_edges(ring.filter("loop = 'upper'")).select("a", "b", F.lit("upper").alias("loop")).unionAll(
        TR.undirected_edges(ring.filter("loop = 'lower'")).select("a", "b", F.lit("lower").alias("loop")))
    return named.join(per_loop, ["a", "b"]).join(passes, "loop").groupBy("a", "b", "point_id").agg(F.sum("n").alias("n_passes"))
