"""Heading, motion, laps, position and track-map queries."""

from pyspark.sql import functions as F

from ..operators import motion as P
from ..operators import sequences as Q
from ..operators import track as TR
from ..session import cut_lineage
from . import bindings as B
from .matching import _LAPPED, _laps
from .registry import query

K = ["session"]

_HD = """hd AS (SELECT *, coalesce(sum(inc) OVER (PARTITION BY session ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING),0) AS heading FROM (
  SELECT *, 0.5::DOUBLE*(gz+lag(gz) OVER w)*((t_us-lag(t_us) OVER w)/1e6) AS inc FROM v_imu WINDOW w AS (PARTITION BY session ORDER BY t_us, event_id))),
 hn AS (SELECT *, lead(heading) OVER w AS nh, lead(t_us) OVER w AS nt, abs(gz)>15 AS fast, row_number() OVER w AS i FROM hd WINDOW w AS (PARTITION BY session ORDER BY t_us, event_id)),
 tr AS (SELECT session, arg_min(heading,i) AS h0, arg_min(t_us,i) AS t0, arg_max(coalesce(nh,heading),i) AS h1, arg_max(coalesce(nt,t_us),i) AS t1 FROM (
  SELECT *, i-row_number() OVER (PARTITION BY session ORDER BY i) AS g FROM hn WHERE fast) GROUP BY session, g),
 anc AS (SELECT session, t0 AS t_us, t1 AS end_us, h1-h0 AS deg FROM tr WHERE abs(abs(h1-h0)-90)<=0.6*90)"""


@query("integrate_yaw", ("v_imu",), f"WITH {_HD} SELECT event_id, round(radians(heading),6) AS heading_rad FROM hd")
def integrate_yaw(spark, sf):
    return P.integrate_yaw(B.imu(spark, sf), K).select("event_id", F.round(F.radians("heading"), 6).alias("heading_rad"))


@query("turntable_anchors", ("v_imu",), f"WITH {_HD} SELECT session, t_us, end_us, round(radians(deg),6) AS turn_rad FROM anc")
def turntable_anchors(spark, sf):
    return P.turntable_anchors(B.imu(spark, sf), K).select("session", "t_us", "end_us", F.round(F.radians("deg"), 6).alias("turn_rad"))


_EN = """en AS (SELECT *, CASE WHEN n>2 THEN sqrt(sx*sx+sy*sy) END AS energy FROM (SELECT *, stddev_pop(ax) OVER w AS sx, stddev_pop(ay) OVER w AS sy, count(*) OVER w AS n
 FROM v_imu WINDOW w AS (PARTITION BY session ORDER BY t_us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW)))"""


def _energy(spark, sf):
    return P.vibration_energy(B.imu(spark, sf), K, win_us=2_000_000)


@query("vibration_energy", ("v_imu",), f"WITH {_EN} SELECT event_id, round(energy,9) AS energy FROM en")
def vibration_energy(spark, sf):
    return _energy(spark, sf).select("event_id", F.round("energy", 9).alias("energy"))


@query("vibration_energy_grid", ("v_imu",), """WITH m AS (SELECT session, min(t_us) AS t0, max(t_us) AS t1 FROM v_imu GROUP BY 1), g AS (SELECT session, unnest(range(t0,t1,500000)) AS t_us FROM m)
 SELECT g.session, g.t_us, round(CASE WHEN count(i.ax)>2 THEN sqrt(stddev_pop(ax)*stddev_pop(ax)+stddev_pop(ay)*stddev_pop(ay)) ELSE 0 END,9) AS energy FROM g LEFT JOIN v_imu i
 ON i.session=g.session AND i.t_us>=g.t_us-1000000 AND i.t_us<g.t_us+1000000 GROUP BY 1,2""")
def vibration_energy_grid(spark, sf):
    g = P.grid_vibration(B.imu(spark, sf), K, win_us=1_000_000, step_us=500_000)
    return g.select("session", "t_us", F.round("energy", 9).alias("energy"))


@query("hysteresis_state", ("v_imu",), """SELECT event_id, coalesce(last_value(CASE WHEN e>0.9 THEN false WHEN e<0.2 THEN true END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t_us, event_id),false) AS stopped
 FROM (SELECT *, value/100 AS e FROM v_imu)""")
def hysteresis_state(spark, sf):
    h = P.hysteresis_state(B.imu(spark, sf).withColumn("energy", F.col("value") / 100), K, ties=["event_id"], lo=0.2, hi=0.9)
    return h.select("event_id", "stopped")


@query("min_dwell_debounce")
def min_dwell_debounce(spark, sf):
    """Runs after the three absorbing passes (sequential rule; compared with brute force in the tests)."""
    g = P.grid_vibration(B.imu(spark, sf), K, win_us=1_000_000, step_us=500_000)
    h = P.hysteresis_state(g, K, lo=0.025, hi=0.05)
    return P.debounce_runs(h, K, step_us=500_000)


_DW = f"""{_EN}, c AS (SELECT session, event_id, t_us, CASE WHEN energy>0.045 THEN 'm' WHEN energy<0.03 THEN 's' WHEN energy IS NOT NULL THEN 'h' END AS c FROM en),
 q AS (SELECT *, sum(CASE WHEN c IS DISTINCT FROM pc THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t_us, event_id) AS g FROM (SELECT *, lag(c) OVER (PARTITION BY session ORDER BY t_us, event_id) AS pc FROM c WHERE c IS NOT NULL)),
 k AS (SELECT session, event_id, t_us, CASE WHEN c='s' AND t_us-f>=2000000 THEN 1 WHEN c='m' AND t_us-f>=1500000 THEN 0 END AS commit FROM (SELECT *, min(t_us) OVER (PARTITION BY session, g) AS f FROM q)
   UNION ALL SELECT session, event_id, t_us, NULL FROM c WHERE c IS NULL),
 dw AS (SELECT session, event_id, t_us, coalesce(last_value(commit IGNORE NULLS) OVER (PARTITION BY session ORDER BY t_us, event_id),0)=1 AS stopped FROM k)"""


def _dwell(spark, sf):
    # read by several passes
    e = cut_lineage(_energy(spark, sf).select("session", "event_id", "t_us", "energy"))
    return P.dwell_state(e, K, lo=0.03, hi=0.045)


@query("dwell_state", ("v_imu",), f"WITH {_DW} SELECT event_id, stopped FROM dw")
def dwell_state(spark, sf):
    return _dwell(spark, sf).select("event_id", "stopped")


_LEG = """le AS (SELECT session, t_us, event_id, CAST(event_type='view' AS INT) AS wheel, CAST(event_type='purchase' AND value>80 AS INT) AS anchor, k%5=0 AS stopped FROM v_imu),
 lw AS (SELECT *, sum(CASE WHEN wheel=1 AND NOT stopped THEN 1 ELSE 0 END) OVER w AS nw, sum(anchor) OVER w AS na FROM le WINDOW w AS (PARTITION BY session ORDER BY t_us, event_id)),
 lg AS (SELECT *, last_value(CASE WHEN anchor=1 THEN nw END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t_us, event_id) AS w0, na-1+1 AS leg FROM lw),
 pos AS (SELECT session, t_us, event_id, CAST(CASE WHEN na=0 THEN 15*nw ELSE 1240*floor(leg/4)+[0,160,620,780][CAST(leg%4 AS INT)+1]+least(15*(nw-w0),[160,460,160,460][CAST(leg%4 AS INT)+1]) END AS DOUBLE) AS cum_cm FROM lg)"""


def _loop_events(spark, sf):
    return B.imu(spark, sf).select(
        "session", "t_us", "event_id", (F.col("event_type") == "view").cast("int").alias("wheel"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 80)).cast("int").alias("anchor"), (F.col("k") % 5 == 0).alias("stopped"))


def _legpin(spark, sf):
    return P.cum_distance_legpin(_loop_events(spark, sf), K, start="BL")


@query("cum_distance_legpin", ("v_imu",), f"WITH {_LEG} SELECT event_id, cum_cm FROM pos")
def cum_distance_legpin(spark, sf):
    return _legpin(spark, sf).select("event_id", "cum_cm")


@query("cum_distance_offline", ("v_imu",), f"""WITH {_LEG}, ow AS (SELECT *, sum(wheel) OVER w AS r, sum(anchor) OVER w AS m FROM le WINDOW w AS (PARTITION BY session ORDER BY t_us, event_id)),
 oa AS (SELECT session, r AS ra, m FROM ow WHERE anchor=1), oe AS (SELECT session, min(ra) AS f, max(ra) AS l FROM oa GROUP BY 1), ok AS (SELECT session, r, max(m) AS k FROM ow GROUP BY 1,2),
 oj AS (SELECT event_id, ow.r, f, l, ok.k AS leg, ra FROM ow JOIN ok USING (session, r) LEFT JOIN oe USING (session) LEFT JOIN oa ON oa.session=ow.session AND oa.m=ok.k)
 SELECT event_id, CAST(CASE WHEN f IS NULL THEN 15*r WHEN r<=f THEN 160-least(15*(f-r),460) WHEN r>=l THEN 1240*floor(leg/4)+[0,160,620,780][CAST(leg%4 AS INT)+1]+15*(r-ra)
  ELSE 1240*floor(leg/4)+[0,160,620,780][CAST(leg%4 AS INT)+1]+least(15*(r-ra),[160,460,160,460][CAST(leg%4 AS INT)+1]) END AS DOUBLE) AS cum_cm FROM oj""")
def cum_distance_offline(spark, sf):
    return P.cum_distance_offline(_loop_events(spark, sf), K, start="BL").select("event_id", "cum_cm")


_XY = """CASE WHEN p<160 THEN 120-120*(p/160) WHEN p<620 THEN 0 WHEN p<780 THEN 120*((p-620)/160) ELSE 120 END AS map_x,
 CASE WHEN p<160 THEN 0 WHEN p<620 THEN 420*((p-160)/460) WHEN p<780 THEN 420 ELSE 420-420*((p-780)/460) END AS map_y,
 CASE WHEN p<160 THEN 'bottom' WHEN p<620 THEN 'left' WHEN p<780 THEN 'top' ELSE 'right' END AS segment"""


@query("track_csv_sinks", ("v_imu",), f"""WITH {_LEG}, x AS (SELECT *, t_us//1000/1000 AS t_rel_s FROM pos JOIN (SELECT event_id, wheel, anchor FROM le) USING (event_id)),
 d AS (SELECT *, {_XY} FROM (SELECT *, cum_cm%1240 AS p FROM x))
 SELECT 'wheels' AS "table", session, event_id, t_rel_s, NULL::DOUBLE AS cum_cm, NULL AS segment, NULL::DOUBLE AS map_x, NULL::DOUBLE AS map_y FROM d WHERE wheel=1
 UNION ALL SELECT 'anchors', session, event_id, t_rel_s, NULL, NULL, NULL, NULL FROM d WHERE anchor=1
 UNION ALL SELECT 'track', session, event_id, t_rel_s, cum_cm, segment, round(map_x,1), round(map_y,1) FROM d""")
def track_csv_sinks(spark, sf):
    """The three localization tables, written and read back."""
    from ..session import run_dir
    from ..sources import sessions as SS

    rows = _legpin(spark, sf).withColumns({"t_rel_s": F.floor(F.col("t_us") / 1000) / 1000, "_p": TR.cum_to_xy(F.col("cum_cm"))})
    name = ["session", "event_id", "t_rel_s"]
    wheels, anchors = rows.filter("wheel = 1").select(*name), rows.filter("anchor = 1").select(*name)
    track = rows.select(*name, "cum_cm", F.col("_p.piece").alias("segment"), F.col("_p.x").alias("map_x"), F.col("_p.y").alias("map_y"))
    base = run_dir(spark, "track")
    SS.track_sinks(wheels, track, anchors, base)
    read = [spark.read.schema(df.schema).option("header", "true").csv(f"{base}/{t}").withColumn("table", F.lit(t))
            for t, df in (("track", track), ("wheels", wheels), ("anchors", anchors))]
    return read[0].unionByName(read[1], allowMissingColumns=True).unionByName(read[2], allowMissingColumns=True)


@query("segment_counts", ("v_fix",), "SELECT line, CASE WHEN x<2 THEN 'near' WHEN x<6 THEN 'mid' ELSE 'far' END AS segment, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM v_fix GROUP BY 1,2")
def segment_counts(spark, sf):
    f = B.fixes(spark, sf).withColumn("segment", F.when(F.col("x") < 2, "near").when(F.col("x") < 6, "mid").otherwise("far"))
    return P.segment_counts(f, ["line", "segment"])


@query("recording_origin", ("v_imu",), "SELECT session, round(quantile_cont(ts_us-1e6*(t_us/1e6+k/1000),0.5),3) AS origin_us FROM v_imu GROUP BY 1")
def recording_origin(spark, sf):
    d = B.imu(spark, sf).select("session", F.col("ts_us").alias("t_host_us"), (F.col("t_us") / 1e6 + F.col("k") / 1000).alias("t_rel_s"))
    return P.recording_origin(d, K).select("session", F.round("origin_us", 3).alias("origin_us"))


@query("track_health_map", ("v_imu", "v_win"), f"""WITH {_LAPPED}, b AS (SELECT session, CAST(floor(phase*24) AS INT)%24 AS bin, avg(score) AS m FROM lapped GROUP BY 1,2),
 a AS (SELECT session, count(*)/24 AS coverage, max(m)/quantile_cont(m,0.5) AS contrast, (arg_min(bin,(-m,bin))+0.5::DOUBLE)/24 AS peak_phase FROM b GROUP BY 1)
 SELECT session, coverage, round(contrast,6) AS contrast, peak_phase, CASE WHEN coverage<0.6 THEN 'unknown' WHEN contrast>=2 THEN 'track' ELSE 'onboard' END AS locus FROM a""")
def track_health_map(spark, sf):
    v = Q.lap_assign(B.window_scores(spark, sf), _laps(spark, sf), K)
    m = P.track_health_map(v, K)
    return m.select("session", "coverage", F.round("contrast", 6).alias("contrast"), "peak_phase", "locus")


@query("false_alarm_position_test", ("v_imu", "v_win", "v_iv"), f"""WITH {_LEG}, d AS (SELECT w.*, EXISTS (SELECT 1 FROM v_iv l WHERE l.session=w.session AND l.label='fault' AND w.center_us>=l.start_us-1500000 AND w.center_us<=l.end_us+1500000) AS labelled FROM v_win w WHERE score>=0.5),
 j AS (SELECT d.*, p.cum_cm-floor(p.cum_cm/1240)*1240 AS c FROM d ASOF JOIN pos p ON d.session=p.session AND d.center_us>=p.t_us)
 SELECT CASE WHEN c<160 THEN 'bottom' WHEN c<620 THEN 'left' WHEN c<780 THEN 'top' ELSE 'right' END AS segment, count(*) AS detections, count(*) FILTER (NOT labelled) AS false_alarms FROM j GROUP BY 1""")
def false_alarm_position_test(spark, sf):
    """Detections by track segment, split into labelled and unlabelled ones."""
    from ..operators.asof import asof_last

    det = B.window_scores(spark, sf).filter("score >= 0.5").select("session", "win_id", F.col("center_us").alias("t_us"))
    faults = B.intervals(spark, sf).filter("label = 'fault'").select(
        "session", (F.col("start_us") - 1_500_000).alias("start_us"), (F.col("end_us") + 1_500_001).alias("end_us"))
    y = Q.label_center(det, faults, K, "win_id", "t_us")
    at = asof_last(y.withColumnRenamed("win_id", "event_id"), _legpin(spark, sf), K, "t_us", "event_id", ["cum_cm"], chunk_us=60_000_000)
    return at.filter("fix IS NOT NULL").groupBy(TR.cum_to_xy(F.col("fix.cum_cm"))["piece"].alias("segment")).agg(
        F.count(F.lit(1)).alias("detections"), F.count_if(F.col("y") == 0).alias("false_alarms"))


@query("circle_fit", ("v_imu",), """WITH c AS (SELECT session, mx-avg(mx) OVER p AS u, my-avg(my) OVER p AS v, avg(mx) OVER p AS ox, avg(my) OVER p AS oy FROM v_imu WINDOW p AS (PARTITION BY session)),
 m AS (SELECT session, any_value(ox) AS ox, any_value(oy) AS oy, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*u*u+u*v*v)/2 AS a, sum(v*v*v+v*u*u)/2 AS b FROM c GROUP BY 1)
 SELECT session, round(ox+(a*vv-b*uv)/(uu*vv-uv*uv),6) AS cx, round(oy+(b*uu-a*uv)/(uu*vv-uv*uv),6) AS cy FROM m""")
def circle_fit(spark, sf):
    return P.circle_fit(B.imu(spark, sf), K).select("session", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("mag_gap_recovery", ("v_imu",), f"""WITH {_HD}, cf AS (SELECT session, ox+(a*vv-b*uv)/(uu*vv-uv*uv) AS cx, oy+(b*uu-a*uv)/(uu*vv-uv*uv) AS cy FROM (
   SELECT session, any_value(ox) AS ox, any_value(oy) AS oy, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*u*u+u*v*v)/2 AS a, sum(v*v*v+v*u*u)/2 AS b FROM (
    SELECT session, mx-avg(mx) OVER p AS u, my-avg(my) OVER p AS v, avg(mx) OVER p AS ox, avg(my) OVER p AS oy FROM v_imu WINDOW p AS (PARTITION BY session)) GROUP BY 1)),
 gp AS (SELECT * FROM (SELECT session, event_id AS gap_id, lag(t_us) OVER (PARTITION BY session ORDER BY t_us, event_id) AS ta, t_us AS tb FROM v_imu) WHERE tb-ta>800000),
 op AS (SELECT * FROM gp g WHERE NOT EXISTS (SELECT 1 FROM anc a WHERE a.session=g.session AND least(abs(a.t_us-ta),abs(a.t_us-tb),abs(2*a.t_us-ta-tb)/2)<4000000)),
 w AS (SELECT g.*, h.heading, h.t_us, h.event_id, h.mx-cx AS x, h.my-cy AS y FROM op g JOIN hd h ON h.session=g.session AND h.t_us>=ta-3000000 AND h.t_us<=tb+3000000 JOIN cf ON cf.session=g.session),
 s AS (SELECT session, gap_id, ta, tb, count(*) FILTER (t_us<=ta-200000) AS nb, count(*) FILTER (t_us>=tb+200000) AS na,
   degrees(atan2(quantile_cont(y,0.5) FILTER (t_us<=ta-200000), quantile_cont(x,0.5) FILTER (t_us<=ta-200000))) AS bef,
   degrees(atan2(quantile_cont(y,0.5) FILTER (t_us>=tb+200000), quantile_cont(x,0.5) FILTER (t_us>=tb+200000))) AS aft,
   arg_max(heading,(t_us,event_id)) FILTER (t_us<=tb+1000000 AND t_us>=ta-1000000)-arg_min(heading,(t_us,event_id)) FILTER (t_us<=tb+1000000 AND t_us>=ta-1000000) AS gyr FROM w GROUP BY 1,2,3,4),
 d AS (SELECT *, (aft-bef+180)-floor((aft-bef+180)/360)*360-180 AS step FROM s WHERE nb>3 AND na>3)
 SELECT session, gap_id, (ta+tb)//2 AS t_us, round(step,6) AS step_deg FROM d WHERE abs(step)>70 AND abs(gyr)<40""")
def mag_gap_recovery(spark, sf):
    imu = B.imu(spark, sf)
    r = P.mag_gap_recovery(imu, P.turntable_anchors(imu, K), K)
    return r.select("session", "gap_id", "t_us", F.round("step_deg", 6).alias("step_deg"))


@query("loo_wheel_error", ("v_imu",), """WITH w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_us) AS i, t_us-lag(t_us) OVER (PARTITION BY session ORDER BY t_us) BETWEEN 0.6*450000 AND 1.7*450000 AS single FROM (SELECT DISTINCT session, t_us FROM v_imu)),
 f AS (SELECT session, t_us, lag(t_us) OVER o/1e6 AS a, t_us/1e6 AS b, lead(t_us) OVER o/1e6 AS c, CASE WHEN lag(single) OVER o THEN lag(t_us,2) OVER o/1e6 END AS z,
   CASE WHEN lead(single,2) OVER o THEN lead(t_us,2) OVER o/1e6 END AS d, single AND lead(single) OVER o AS ok FROM w WINDOW o AS (PARTITION BY session ORDER BY i)),
 m AS (SELECT *, (z+a)/2 AS m1, 15/(a-z) AS v1, (a+c)/2 AS m2, 30/(c-a) AS v2, (c+d)/2 AS m3, 15/(d-c) AS v3 FROM f WHERE ok),
 g AS (SELECT *, a+(b-a)*g/47 AS x FROM m, range(48) r(g)),
 p AS (SELECT session, t_us, any_value(b-a)/47*sum((CASE WHEN x<=m2 THEN CASE WHEN m1 IS NULL THEN v2 ELSE v1+(v2-v1)*((x-m1)/(m2-m1)) END ELSE CASE WHEN m3 IS NULL THEN v2 ELSE v2+(v3-v2)*((x-m2)/(m3-m2)) END END)*CASE WHEN g IN (0,47) THEN 0.5::DOUBLE ELSE 1 END) AS pred FROM g GROUP BY 1,2)
 SELECT session, t_us, round(abs(pred-15),6) AS err_cm FROM p""")
def loo_wheel_error(spark, sf):
    return P.loo_wheel_error(B.imu(spark, sf), K).select("session", "t_us", F.round("err_cm", 6).alias("err_cm"))


@query("dead_reckoning")
def dead_reckoning(spark, sf):
    """Leaky dead reckoning (recurrence; compared with a plain loop in the tests)."""
    e = B.imu(spark, sf).withColumns({"ax_raw": (F.col("k") - 50) * 100, "ay_raw": (F.col("k") * 7 % 100 - 50) * 100, "line": F.lit("line1")})
    return P.dead_reckoning(e, K)


def turns(spark, sf):
    return P.local_peak_turns(B.imu(spark, sf), K, k=0.5, sep_n=6)


@query("local_peak_turns")
def local_peak_turns(spark, sf):
    """Envelope peaks with greedy spacing (compared with a plain loop in the tests)."""
    return turns(spark, sf)


@query("minority_landmarks", ("v_imu",), """WITH t AS (SELECT session, t_us, CASE WHEN gz>0 THEN 1 ELSE -1 END AS direction FROM v_imu WHERE event_type='error'),
 n AS (SELECT session, CASE WHEN count(*) FILTER (direction=1)<=count(*) FILTER (direction=-1) THEN 1 ELSE -1 END AS r FROM t GROUP BY 1)
 SELECT t.session, t_us, direction FROM t JOIN n ON t.session=n.session AND direction=r""")
def minority_landmarks(spark, sf):
    t = B.imu(spark, sf).filter("event_type = 'error'").select("session", "t_us", F.when(F.col("gz") > 0, 1).otherwise(-1).alias("direction"))
    return P.minority_landmarks(t, K)


@query("route_variants")
def route_variants(spark, sf):
    """Laps with their route variant (sequential clustering; brute-forced in the tests)."""
    return P.route_variants(_laps(spark, sf), K)


@query("clustered_mode", ("v_imu",), """WITH l AS (SELECT session, t_us AS lap_start, k%4 AS variant FROM v_imu WHERE event_type='signup'), c AS (SELECT session, variant, count(*) AS n, min(lap_start) AS s FROM l GROUP BY 1,2)
 SELECT session, variant, n AS n_laps FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, s)=1""")
def clustered_mode(spark, sf):
    l = B.imu(spark, sf).filter("event_type = 'signup'").select("session", F.col("t_us").alias("lap_start"), (F.col("k") % 4).alias("variant"))
    return P.dominant_variant(l, K)


@query("frame_index", ("v_frames",), "SELECT session, frame_no, host_us, name FROM v_frames ORDER BY host_us")
def frame_index(spark, sf):
    from ..sources.media import frame_index as parse

    return parse(B.frames(spark, sf).select("session", "name")).orderBy("host_us")
