"""Rolling windows, runs, gaps and bursts."""

from pyspark.sql import functions as F

from ..operators import sequences as Q
from . import bindings as B
from .matching import RUNS_SQL, detections
from .registry import query

K = ["session"]


def _num(spark, sf):
    return Q.numbered(B.window_scores(spark, sf), K, "center_us", ["win_id"])


@query("sliding_sample_windows", ("v_win",), """WITH f AS (SELECT session, w, min(center_us) AS t0, max(center_us) AS t1, avg(score) AS mean, count(*) AS n FROM v_win,
  LATERAL (SELECT unnest(range(0,(rn-1)//8+1)) AS w) WHERE rn-1>=w*8 AND rn-1<w*8+16 GROUP BY 1,2)
 SELECT session, w AS win, t0, t1, round(mean,9) AS mean FROM f WHERE n=16""")
def sliding_sample_windows(spark, sf):
    rows = Q.sliding_sample_windows(_num(spark, sf), K, "rn", 16, 8)
    w = rows.groupBy("session", "win").agg(F.min("center_us").alias("t0"), F.max("center_us").alias("t1"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    return w.filter("n = 16").select("session", "win", "t0", "t1", F.round("mean", 9).alias("mean"))


@query("causal_rolling_mean", ("v_win",), "SELECT win_id, round(avg(score) OVER (PARTITION BY session ORDER BY rn ROWS 9 PRECEDING),9) AS smooth FROM v_win")
def causal_rolling_mean(spark, sf):
    return Q.causal_rolling_mean(_num(spark, sf), K, "rn", "score").select("win_id", F.round("smooth", 9).alias("smooth"))


@query("valid_rolling_mean", ("v_win",), """WITH c AS (SELECT *, 's'||session||(rn//100) AS s2, row_number() OVER (PARTITION BY session, rn//100 ORDER BY rn) AS r2, count(*) OVER (PARTITION BY session, rn//100) AS n FROM v_win)
 SELECT s2, r2 AS rn, round(avg(score) OVER (PARTITION BY s2 ORDER BY r2 ROWS 79 PRECEDING),9) AS smooth FROM c QUALIFY r2>=80
 UNION ALL SELECT s2, n, round(avg(score),9) FROM c WHERE n<80 GROUP BY s2, n""")
def valid_rolling_mean(spark, sf):
    s = _num(spark, sf).withColumn("s2", F.concat(F.lit("s"), "session", F.floor(F.col("rn") / 100).cast("string"))).drop("rn")
    s = Q.numbered(s, ["s2"], "center_us", ["win_id"])
    return Q.valid_rolling_mean(s, ["s2"], "rn", "score", 80).select("s2", "rn", F.round("smooth", 9).alias("smooth"))


@query("rolling_median_centered", ("v_win",), "SELECT win_id, round(quantile_cont(score,0.5) OVER (PARTITION BY session ORDER BY rn ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING),9) AS smooth FROM v_win")
def rolling_median_centered(spark, sf):
    return Q.rolling_median_centered(_num(spark, sf), K, "rn", "score").select("win_id", F.round("smooth", 9).alias("smooth"))


@query("trend_slope", ("v_win",), """SELECT win_id, round(CASE WHEN n<3 THEN 0 ELSE s END,9) AS slope, CASE WHEN n<3 OR abs(s)<=0.001 THEN 'stable' WHEN s>0 THEN 'rising' ELSE 'falling' END AS trend FROM (
 SELECT win_id, regr_slope(score, rn) OVER w AS s, count(*) OVER w AS n FROM v_win WINDOW w AS (PARTITION BY session ORDER BY rn ROWS 59 PRECEDING))""")
def trend_slope(spark, sf):
    return Q.trend_slope(_num(spark, sf), K, "rn", "score").select("win_id", F.round("slope", 9).alias("slope"), "trend")


_GAP = """SELECT session, min(center_us) AS start_us, max(center_us) AS end_us, count(*) AS n, max(score) AS peak_score, arg_min(center_us, (-score, center_us)) AS peak_us FROM (
 SELECT *, sum(brk) OVER (PARTITION BY session ORDER BY rn) AS g FROM (SELECT *, CASE WHEN center_us-lag(center_us) OVER (PARTITION BY session ORDER BY rn)<=3000000 THEN 0 ELSE 1 END AS brk FROM v_win WHERE score>=0.5)) GROUP BY session, g"""


@query("gap_cluster_events", ("v_win",), _GAP)
def gap_cluster_events(spark, sf):
    f = B.window_scores(spark, sf).filter("score >= 0.5")
    return Q.gap_cluster_events(f, K, "center_us", "win_id", "score", 3_000_000).drop("event_no")


@query("session_events", ("v_win",), f"SELECT session, start_us, end_us, n FROM ({_GAP})")
def session_events(spark, sf):
    """The same clustering through ``session_window`` (the form that also runs on a stream)."""
    f = B.window_scores(spark, sf).filter("score >= 0.5").withColumn("ts", F.timestamp_micros("center_us"))
    w = f.groupBy("session", F.session_window("ts", "3 seconds")).agg(
        F.min("center_us").alias("start_us"), F.max("center_us").alias("end_us"), F.count(F.lit(1)).alias("n"))
    return w.select("session", "start_us", "end_us", "n")


@query("runs_min_k", ("v_win",), f"WITH {RUNS_SQL} SELECT * FROM runs")
def runs_min_k(spark, sf):
    return detections(spark, sf)


@query("runs_bridge_gap1", ("v_win",), """SELECT session, min(center_us)-500000 AS start_us, max(center_us)+500000 AS end_us, count(*) AS n FROM (
 SELECT *, sum(b) OVER (PARTITION BY session ORDER BY rn) AS g FROM (SELECT *, CASE WHEN rn-lag(rn) OVER (PARTITION BY session ORDER BY rn)<=2 THEN 0 ELSE 1 END AS b FROM v_win WHERE score>=0.5))
 GROUP BY session, g HAVING count(*)>=3""")
def runs_bridge_gap1(spark, sf):
    return Q.runs_bridge_gap1(B.window_scores(spark, sf), K, "center_us", "win_id", "score >= 0.5", 3, 500_000)


_WH = """f AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY host_us, frame_no) AS i, dark>0.4 AS d FROM v_frames),
 r AS (SELECT session, min(i) AS a, max(i) AS z, max(net) AS net, max(dark) AS dark, arg_min(struct_pack(t:=host_us,no:=frame_no),(-dark,host_us,frame_no)) AS p FROM
  (SELECT *, i-row_number() OVER (PARTITION BY session ORDER BY i) AS g FROM f WHERE d) GROUP BY session, g)"""


@query("run_gate_wheels", ("v_frames",), f"""WITH {_WH}, m AS (SELECT session, max(i) AS last FROM f GROUP BY 1)
 SELECT r.session, p.t AS t_us, p.no AS frame_no, dark AS peak_dark FROM r JOIN m USING (session) WHERE net>=0.3 AND z<last""")
def run_gate_wheels(spark, sf):
    return Q.run_gate_wheels(B.frames(spark, sf), K)


@query("run_gate_wheels_padded", ("v_frames",), f"""WITH {_WH}, q AS (SELECT *, CASE WHEN a-lag(z) OVER (PARTITION BY session ORDER BY a)<=3 THEN 0 ELSE 1 END AS b FROM r WHERE net>=0.5),
 h AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY a) AS g FROM q)
 SELECT session, x.t AS t_us, x.no AS frame_no, d AS peak_dark FROM (SELECT session, arg_min(p,(-dark,a)) AS x, max(dark) AS d FROM h GROUP BY session, g)""")
def run_gate_wheels_padded(spark, sf):
    return Q.run_gate_wheels(B.frames(spark, sf), K, net_thr=0.5, streaming=False)


_MARK = "mk AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY host_us, frame_no) AS no, dark, net FROM v_frames)"


@query("group_marks", ("v_frames",), f"""WITH {_MARK} SELECT session, min(no) AS first_no, max(no) AS last_no FROM (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY no) AS g FROM
 (SELECT *, CASE WHEN no-lag(no) OVER (PARTITION BY session ORDER BY no)<=3 THEN 0 ELSE 1 END AS b FROM mk WHERE dark>0.7)) GROUP BY session, g""")
def group_marks(spark, sf):
    f = Q.numbered(B.frames(spark, sf), K, "host_us", ["frame_no"], out="no")
    return Q.group_marks(f.filter("dark > 0.7"), K, "no", 2)


@query("merge_spans", ("v_iv",), """WITH s AS (SELECT DISTINCT session, start_us//100000 AS a, end_us//100000 AS z FROM v_iv), t AS (SELECT *, max(z) OVER (PARTITION BY session ORDER BY a,z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
 SELECT session, min(a) AS a, max(z) AS z FROM (SELECT *, sum(CASE WHEN a<=m+1 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY a,z) AS g FROM t) GROUP BY session, g""")
def merge_spans(spark, sf):
    s = B.intervals(spark, sf).select("session", F.expr("start_us div 100000").alias("a"), F.expr("end_us div 100000").alias("z"))
    return Q.merge_spans(s, K, "a", "z")


@query("split_bursts", ("v_imu",), """WITH b AS (SELECT *, sum(CASE WHEN k>p THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t_us, event_id) AS burst FROM
  (SELECT *, lag(k) OVER (PARTITION BY session ORDER BY t_us, event_id) AS p FROM v_imu))
 SELECT session, CAST(burst AS BIGINT) AS burst, count(*) AS n FROM b GROUP BY 1,2 HAVING count(*)>=4""")
def split_bursts(spark, sf):
    b = Q.split_bursts(B.imu(spark, sf), K, ["t_us", "event_id"], "k", min_len=4)
    return b.groupBy("session", "burst").agg(F.count(F.lit(1)).alias("n"))


@query("nominal_rate", ("v_imu",), """SELECT session, round(1e6/quantile_cont(d,0.5),9) AS fs FROM (SELECT session, t_us-lag(t_us) OVER (PARTITION BY session ORDER BY t_us, event_id) AS d FROM v_imu) WHERE d IS NOT NULL GROUP BY 1""")
def nominal_rate(spark, sf):
    return Q.nominal_rate(B.imu(spark, sf), K, "t_us", ["t_us", "event_id"]).select("session", F.round("fs", 9).alias("fs"))


@query("nominal_rate_device_clock", ("v_imu",), """SELECT session, round(1e6/quantile_cont(d,0.5),9) AS fs FROM (SELECT session, k-lag(k) OVER (PARTITION BY session ORDER BY t_us, event_id) AS d FROM v_imu) WHERE d>0 GROUP BY 1""")
def nominal_rate_device_clock(spark, sf):
    return Q.nominal_rate(B.imu(spark, sf), K, "k", ["t_us", "event_id"], positive_only=True).select("session", F.round("fs", 9).alias("fs"))


@query("pool_sessions", ("v_win",), "SELECT session, count(*) AS n, dense_rank() OVER (ORDER BY session)-1 AS grp FROM v_win GROUP BY session")
def pool_sessions(spark, sf):
    """One dataset with a group id per session; ids follow the sorted session names."""
    from pyspark.sql import Window

    s = B.window_scores(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("grp", (F.dense_rank().over(Window.orderBy("session")) - 1).cast("bigint"))


_D1 = "SELECT session, i AS clip, i*10000000 AS start_us, least((i+1)*10000000, m) AS end_us FROM (SELECT session, m, unnest(range(0, CAST(ceil(m/1e7) AS BIGINT))) AS i FROM (SELECT session, max(t_us) AS m FROM v_imu GROUP BY 1))"


@query("clip_windows", ("v_imu",), f"SELECT session, clip+1 AS clip, start_us, end_us FROM ({_D1})")
def clip_windows(spark, sf):
    """Tile each recording from 0 in fixed clips, numbered from 1; the last one is short."""
    n = F.ceil(F.col("m") / 1e7).cast("bigint")
    m = B.imu(spark, sf).groupBy("session").agg(F.max("t_us").alias("m")).filter("m > 0")
    c = m.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return c.select("session", (F.col("i") + 1).alias("clip"), (F.col("i") * 10_000_000).alias("start_us"), F.least((F.col("i") + 1) * 10_000_000, "m").alias("end_us"))
