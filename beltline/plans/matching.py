"""As-of, nearest, interval and alignment joins."""

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import messages as M
from ..operators import sequences as Q
from ..operators import track as TR
from . import bindings as B
from .registry import query
from .telemetry import XY_SQL

_ASOF = """SELECT a.*, f.event_id AS f_id, f.x, f.y, f.t_host_us FROM (SELECT * FROM v_scores WHERE fault_class IS NOT NULL) a ASOF LEFT JOIN v_fix f
 ON a.line=f.line AND a.container_id=f.container_id AND a.ts_us>=f.ts_us"""


def _localized(spark, sf):
    fix = B.fixes(spark, sf).withColumn("segment", TR.segment_grid(F.col("x"), F.col("y"), F.col("line")))
    return A.asof_last(B.anomalies(spark, sf), fix, ["line", "container_id"], "ts_us", "event_id", ["segment", "x", "y", "t_host_us"])


@query("asof_last_position", ("v_scores", "v_fix"), f"SELECT event_id, ts_us, container_id, x, y, t_host_us AS pos_t_host_us FROM ({_ASOF})")
def asof_last_position(spark, sf):
    return _localized(spark, sf).select("event_id", "ts_us", "container_id", "fix.x", "fix.y", F.col("fix.t_host_us").alias("pos_t_host_us"))


@query("localize_project", ("v_scores", "v_fix"), f"""SELECT event_id, ts_us, x, y, t_host_us AS pos_t_host_us, (ts_us-t_host_us)//1000 AS pos_age_ms,
 'inference' AS data_classification, line||'.station-'||chr(CAST(65+greatest(0,CAST(floor(y/5) AS INT))%26 AS INT))||CAST(floor(x/5) AS INT) AS segment FROM ({_ASOF})""")
def localize_project(spark, sf):
    out = M.localize_project(_localized(spark, sf))
    return out.select("event_id", "ts_us", "x", "y", "pos_t_host_us", "pos_age_ms", "data_classification", "segment")


@query("localize_bytes")
def localize_bytes(spark, sf):
    """Self-stated message size (no SQL check: depends on the JSON writer)."""
    return M.localize_project(_localized(spark, sf)).select("event_id", "bytes")


@query("asof_cfg", ("ev",), """SELECT s.event_id, round((s.k-50)*300/32768*coalesce(c.acc,4),9) AS acc_g, CAST(coalesce(c.acc,4) AS BIGINT) AS acc_range_g FROM
 (SELECT * FROM ev WHERE event_type<>'signup') s ASOF LEFT JOIN (SELECT ts_us, container_id, 2+k%15 AS acc FROM ev WHERE event_type='signup') c
 ON s.container_id=c.container_id AND s.ts_us>=c.ts_us""")
def asof_cfg(spark, sf):
    e = B._container(B.events(spark, sf))
    cmd = F.concat(F.lit("CFG,100,"), (2 + F.col("k") % 15).cast("string"), F.lit(",200,2000"))
    cfg = e.filter("event_type = 'signup'").withColumn("cfg", M.parse_cfg(cmd)).filter("cfg IS NOT NULL").select(
        "container_id", "ts_us", "event_id", "cfg.acc_range")
    s = A.asof_last(e.filter("event_type <> 'signup'"), cfg, ["container_id"], "ts_us", "event_id", ["acc_range"], "cfg")
    rng = F.coalesce("cfg.acc_range", F.lit(4))
    return s.select("event_id", F.round((F.col("k") - 50) * 300 / 32768 * rng, 9).alias("acc_g"), rng.cast("bigint").alias("acc_range_g"))


@query("window_label_center", ("v_win", "v_iv"), """SELECT session, win_id, CAST(EXISTS (SELECT 1 FROM v_iv l WHERE l.session=w.session AND l.label='fault'
 AND w.center_us>=l.start_us AND w.center_us<l.end_us) AS INT) AS y FROM v_win w""")
def window_label_center(spark, sf):
    return Q.label_center(B.window_scores(spark, sf), B.intervals(spark, sf), ["session"], "win_id", "center_us", ["fault"]).select("session", "win_id", "y")


@query("window_label_overlap", ("v_win", "v_iv"), """SELECT session, win_id, CASE WHEN ov>=1000000 THEN label END AS label FROM v_win LEFT JOIN (
 SELECT w.session, w.win_id, max(o) AS ov, arg_min(label, (-o, start_us, label_id)) AS label FROM (SELECT w.session, w.win_id, l.label, l.start_us, l.label_id,
   least(w.center_us+1000000,l.end_us)-greatest(w.center_us-1000000,l.start_us) AS o FROM v_win w JOIN v_iv l ON l.session=w.session
   AND l.start_us<w.center_us+1000000 AND l.end_us>w.center_us-1000000) w WHERE o>0 GROUP BY 1,2) USING (session, win_id)""")
def window_label_overlap(spark, sf):
    w = B.window_scores(spark, sf).withColumns({"t0": F.col("center_us") - 1_000_000, "t1": F.col("center_us") + 1_000_000})
    return Q.window_label_overlap(w, B.intervals(spark, sf), ["session"], "win_id", "t0", "t1").select("session", "win_id", "label")


@query("sample_label_mask", ("v_imu", "v_iv"), """SELECT event_id, EXISTS (SELECT 1 FROM v_iv l WHERE l.session=w.session AND w.t_us>=l.start_us AND w.t_us<l.end_us) AS covered FROM v_imu w""")
def sample_label_mask(spark, sf):
    m = Q.label_center(B.imu(spark, sf), B.intervals(spark, sf), ["session"], "event_id", "t_us")
    return m.select("event_id", (F.col("y") == 1).alias("covered"))


@query("multi_class_label", ("v_win", "v_iv"), """SELECT session, win_id, coalesce(CASE x.label WHEN 'qs_wobbly' THEN 1 WHEN 'qs_smooth' THEN 0 END,-1) AS y, coalesce(x.label_id,-1) AS segment_id FROM v_win LEFT JOIN (
 SELECT w.session, w.win_id, arg_max(struct_pack(label:=l.label,label_id:=l.label_id),(l.start_us,l.label_id)) AS x FROM v_win w JOIN v_iv l ON l.session=w.session AND l.label<>'fault'
  AND w.center_us>=l.start_us AND w.center_us<l.end_us GROUP BY 1,2) USING (session, win_id)""")
def multi_class_label(spark, sf):
    return Q.multi_class_label(B.window_scores(spark, sf), B.intervals(spark, sf), ["session"], "win_id", "center_us",
                               {"qs_wobbly": 1, "qs_smooth": 0}).select("session", "win_id", "y", "segment_id")


_NEAR = """b AS (SELECT e.event_id, e.t_us, e.session, f.host_us AS bt, f.frame_no AS bn FROM (SELECT * FROM v_imu WHERE event_type='error') e ASOF LEFT JOIN v_frames f ON e.session=f.session AND e.t_us>=f.host_us),
 a AS (SELECT e.event_id, f.host_us AS a_t, f.frame_no AS an FROM (SELECT * FROM v_imu WHERE event_type='error') e ASOF LEFT JOIN v_frames f ON e.session=f.session AND e.t_us<=f.host_us),
 n AS (SELECT session, event_id, t_us, CASE WHEN bt IS NULL OR a_t-t_us<t_us-bt THEN an ELSE bn END AS frame_no, CASE WHEN bt IS NULL OR a_t-t_us<t_us-bt THEN a_t ELSE bt END AS ft FROM b JOIN a USING (event_id))"""


@query("nearest_frame", ("v_imu", "v_frames"), f"WITH {_NEAR} SELECT event_id, frame_no, round((ft-t_us)/1e6,6) AS dt_s FROM n")
def nearest_frame(spark, sf):
    ev = B.imu(spark, sf).filter("event_type = 'error'").select("session", "event_id", "t_us")
    fr = B.frames(spark, sf).select("session", F.col("host_us").alias("t_us"), F.col("frame_no").alias("event_id"), "frame_no", "host_us")
    m = A.nearest(ev, fr, ["session"], "t_us", "event_id", ["frame_no", "host_us"], "host_us", chunk_us=60_000_000)
    return m.select("event_id", "match.frame_no", F.round((F.col("match.host_us") - F.col("t_us")) / 1e6, 6).alias("dt_s"))


@query("nearest_event_flag", ("v_imu", "v_frames"), f"WITH {_NEAR} SELECT f.frame_no, EXISTS (SELECT 1 FROM n WHERE n.frame_no=f.frame_no) AS marked FROM v_frames f")
def nearest_event_flag(spark, sf):
    hit = nearest_frame(spark, sf).select("frame_no").distinct().withColumn("_m", F.lit(True))
    return B.frames(spark, sf).select("frame_no").join(hit, "frame_no", "left").select("frame_no", F.coalesce("_m", F.lit(False)).alias("marked"))


@query("interp_position_onto_imu", ("v_imu",), f"""WITH tr AS (SELECT session, t_us, event_id, CAST(sum(15) OVER (PARTITION BY session ORDER BY t_us, event_id) AS DOUBLE) AS cum, k%2 AS moving FROM v_imu WHERE event_type='view'),
 s AS (SELECT * FROM v_imu WHERE event_type<>'view'),
 b AS (SELECT s.event_id, s.t_us, tr.t_us AS bt, tr.cum AS bc, tr.moving AS bm FROM s ASOF LEFT JOIN tr ON s.session=tr.session AND s.t_us>=tr.t_us),
 a AS (SELECT s.event_id, tr.t_us AS a_t, tr.cum AS ac, tr.moving AS am FROM s ASOF LEFT JOIN tr ON s.session=tr.session AND s.t_us<=tr.t_us),
 c AS (SELECT event_id, CASE WHEN bt IS NULL THEN ac WHEN a_t IS NULL OR bt=t_us THEN bc ELSE bc+(ac-bc)*((t_us-bt)/(a_t-bt)) END AS cum_cm,
   CASE WHEN bt=t_us THEN bm ELSE coalesce(am,bm) END AS moving FROM b JOIN a USING (event_id)),
 p AS (SELECT *, cum_cm-floor(cum_cm/1240)*1240 AS p FROM c)
 SELECT event_id, round(cum_cm,6) AS cum_cm, round(cum_cm/1240,6) AS lap, moving, {XY_SQL[2]} AS segment, round({XY_SQL[0]},6) AS map_x, round({XY_SQL[1]},6) AS map_y FROM p""")
def interp_position_onto_imu(spark, sf):
    e = B.imu(spark, sf)
    views = e.filter("event_type = 'view'")
    track = Q.numbered(views, ["session"], "t_us", ["event_id"]).select(
        "session", "t_us", "event_id", (F.col("rn") * 15.0).alias("cum_cm"), (F.col("k") % 2).alias("moving"))
    s = e.filter("event_type <> 'view'").select("session", "event_id", "t_us")
    out = A.interpolate_track(s, track, ["session"], "t_us", "event_id", "cum_cm", "moving", chunk_us=60_000_000)
    xy = TR.cum_to_xy(F.col("cum_cm"))
    return out.withColumn("p", xy).select(
        "event_id", F.round("cum_cm", 6).alias("cum_cm"), F.round(F.col("cum_cm") / 1240, 6).alias("lap"), "moving",
        F.col("p.piece").alias("segment"), F.round("p.x", 6).alias("map_x"), F.round("p.y", 6).alias("map_y"))


def _laps(spark, sf):
    marks = B.imu(spark, sf).filter("event_type = 'signup'").select("session", "t_us").distinct()
    return Q.lap_segmentation(marks, ["session"])


_LAPS = "laps AS (SELECT * FROM (SELECT session, t_us AS lap_start, lead(t_us) OVER (PARTITION BY session ORDER BY t_us) AS lap_end FROM (SELECT DISTINCT session, t_us FROM v_imu WHERE event_type='signup')) WHERE lap_end IS NOT NULL)"


@query("lap_segmentation", ("v_imu",), f"WITH {_LAPS} SELECT * FROM laps")
def lap_segmentation(spark, sf):
    return _laps(spark, sf)


_LAPPED = f"{_LAPS}, lapped AS (SELECT w.*, l.lap_start, l.lap_end, (center_us-lap_start)/(lap_end-lap_start) AS phase FROM v_win w JOIN laps l ON w.session=l.session AND center_us>=lap_start AND center_us<lap_end)"


@query("lap_assign", ("v_imu", "v_win"), f"WITH {_LAPPED} SELECT win_id, lap_start, lap_end FROM lapped")
def lap_assign(spark, sf):
    return Q.lap_assign(B.window_scores(spark, sf), _laps(spark, sf), ["session"]).select("win_id", "lap_start", "lap_end")


@query("landmark_phase", ("v_imu", "v_win"), f"WITH {_LAPPED} SELECT win_id, round(phase,9) AS phase FROM lapped")
def landmark_phase(spark, sf):
    return Q.lap_assign(B.window_scores(spark, sf), _laps(spark, sf), ["session"]).select("win_id", F.round("phase", 9).alias("phase"))


RUNS_SQL = """runs AS (SELECT session, min(center_us) AS start_us, max(center_us) AS end_us, count(*) AS n FROM (
  SELECT *, rn-row_number() OVER (PARTITION BY session ORDER BY rn) AS g FROM v_win WHERE score>=0.4) GROUP BY session, g HAVING count(*)>=2)"""


def detections(spark, sf):
    return Q.runs_min_k(B.window_scores(spark, sf), ["session"], "center_us", "win_id", "score >= 0.4", 2)


@query("event_interval_match", ("v_win", "v_iv"), f"""WITH {RUNS_SQL} SELECT session, 'detection' AS side, start_us AS id, CASE WHEN EXISTS (SELECT 1 FROM v_iv l WHERE l.session=r.session
   AND r.start_us<=l.end_us+1500000 AND l.start_us-1500000<=r.end_us) THEN 'hit' ELSE 'false_alarm' END AS verdict FROM runs r
 UNION ALL SELECT session, 'truth', label_id, CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE l.session=r.session AND r.start_us<=l.end_us+1500000 AND l.start_us-1500000<=r.end_us) THEN 'found' ELSE 'missed' END FROM v_iv l""")
def event_interval_match(spark, sf):
    d = detections(spark, sf).withColumn("det_id", F.col("start_us"))
    return Q.event_interval_match(d, B.intervals(spark, sf), ["session"], "det_id", "label_id", 1_500_000)


@query("greedy_interval_match")
def greedy_interval_match(spark, sf):
    """Order-dependent one-to-one match; checked against brute force in the tests."""
    f = Q.numbered(B.frames(spark, sf), ["session"], "host_us", ["frame_no"], out="no")
    runs = Q.group_marks(f.filter("dark > 0.4"), ["session"], "no", 0)
    truths = Q.group_marks(f.filter("net > 0.3"), ["session"], "no", 0)
    return Q.greedy_interval_match(runs, truths, ["session"])


@query("silver_label_union", ("v_win", "v_iv"), f"""WITH {RUNS_SQL} SELECT session, start_us, end_us, false AS silver, true AS evaluate FROM v_iv WHERE label='fault'
 UNION ALL SELECT session, start_us, end_us, true, false FROM runs""")
def silver_label_union(spark, sf):
    human = B.intervals(spark, sf).filter("label = 'fault'").select("session", "start_us", "end_us", F.lit(False).alias("silver"))
    silver = detections(spark, sf).select("session", "start_us", "end_us", F.lit(True).alias("silver"))
    return human.unionByName(silver).withColumn("evaluate", ~F.col("silver"))


@query("event_aligned_slices", ("v_imu", "v_iv"), """SELECT label_id, event_id, round((t_us-(start_us+end_us)/2)/1e6,6) AS rel_s FROM v_imu i JOIN v_iv l ON i.session=l.session
 AND t_us>=(start_us+end_us)//2-8000000 AND t_us<=(start_us+end_us)//2+8000000 WHERE l.label='fault'""")
def event_aligned_slices(spark, sf):
    from ..kernels.ranges import points_in_intervals

    mid = F.call_function("div", F.col("start_us") + F.col("end_us"), F.lit(2).cast("bigint"))
    ev = B.intervals(spark, sf).filter("label = 'fault'").select(
        "session", "label_id", (mid - 8_000_000).alias("a"), (mid + 8_000_000).alias("z"), ((F.col("start_us") + F.col("end_us")) / 2).alias("c"))
    s = points_in_intervals(B.imu(spark, sf).select("session", "event_id", "t_us"), ev, ["session"], "t_us", "a", "z", 8_000_000, closed=True)
    return s.select("label_id", "event_id", F.round((F.col("t_us") - F.col("c")) / 1e6, 6).alias("rel_s"))


@query("resample_uniform", ("v_imu",), """WITH u AS (SELECT session, t_us, avg(gz) AS gz FROM v_imu GROUP BY 1,2),
 g AS (SELECT session, unnest(range(0, max(t_us), 500000)) AS t_us FROM u GROUP BY session),
 b AS (SELECT g.session, g.t_us, u.t_us AS bt, u.gz AS bv FROM g ASOF LEFT JOIN u ON g.session=u.session AND g.t_us>=u.t_us),
 a AS (SELECT g.session, g.t_us, u.t_us AS a_t, u.gz AS av FROM g ASOF LEFT JOIN u ON g.session=u.session AND g.t_us<=u.t_us)
 SELECT session, t_us, round(CASE WHEN bt IS NULL THEN av WHEN bt=t_us OR a_t IS NULL THEN bv ELSE bv+(av-bv)*((t_us-bt)/(a_t-bt)) END,6) AS gz FROM b JOIN a USING (session, t_us)""")
def resample_uniform(spark, sf):
    out = A.resample_uniform(B.imu(spark, sf), ["session"], "t_us", ["gz"], 500_000)
    return out.select("session", "t_us", F.round("gz", 6).alias("gz"))


@query("merge_modalities_timeline", ("v_imu", "v_frames"), """SELECT session, t_us, 'camera' AS modality, frame_no AS id FROM (SELECT session, host_us AS t_us, frame_no FROM v_frames)
 UNION ALL SELECT session, t_us, 'imu', event_id FROM v_imu WHERE event_type='click' UNION ALL SELECT session, t_us, 'mag', event_id FROM v_imu WHERE event_type='error'""")
def merge_modalities_timeline(spark, sf):
    i = B.imu(spark, sf)
    parts = [i.filter("event_type = 'click'").select("session", "t_us", F.lit("imu").alias("modality"), F.col("event_id").alias("id")),
             i.filter("event_type = 'error'").select("session", "t_us", F.lit("mag").alias("modality"), F.col("event_id").alias("id")),
             B.frames(spark, sf).select("session", F.col("host_us").alias("t_us"), F.lit("camera").alias("modality"), F.col("frame_no").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("session", "t_us", "id")


@query("dedupe_anchors", ("v_imu",), """WITH g AS (SELECT DISTINCT session, t_us FROM v_imu WHERE event_type='click'), r AS (SELECT DISTINCT session, t_us FROM v_imu WHERE event_type='view')
 SELECT session, t_us, 'gyro' AS source FROM g UNION ALL SELECT session, t_us, 'mag' FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.session=r.session AND abs(g.t_us-r.t_us)<4000000)""")
def dedupe_anchors(spark, sf):
    e = B.imu(spark, sf)
    return Q.dedupe_anchors(e.filter("event_type = 'click'").select("session", "t_us").distinct(),
                            e.filter("event_type = 'view'").select("session", "t_us").distinct(), ["session"])
