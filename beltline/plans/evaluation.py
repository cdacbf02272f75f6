"""Baselines, detector scores, evaluation metrics and models."""

from pyspark.sql import functions as F

from ..operators import baseline as N
from ..operators import evaluate as V
from ..operators import features as X
from ..operators import models as ML
from ..operators import motion as P
from ..operators import sequences as Q
from ..operators import staging as ST
from . import bindings as B
from .matching import RUNS_SQL, _laps
from .oracle_views import staged_sql
from .registry import query
from .signals import CENTRED, FS, TF, centred_windows

K = ["session"]
_FEATS = ["rms", "p2p", "std", "jerk_mad"]


def _r(df, keep, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


def feature_rows(spark, sf):
    """Wide window features; a window counts as healthy when its first sample is not negative."""
    w = centred_windows(spark, sf).withColumn("healthy", B.F.element_at("sig", 1) >= 0)
    return X.time_features(w).select("vec_id", "unit", "healthy", *X.TIME)


def _long(spark, sf):
    return feature_rows(spark, sf).unpivot(["vec_id", "unit", "healthy"], _FEATS, "feature", "value")


_FL = f"""{TF}, hl AS (SELECT vec_id, x>=0 AS healthy FROM c WHERE i=0),
 fl AS (SELECT vec_id, unit, healthy, feature, value FROM (SELECT tf.vec_id, unit, healthy, rms, p2p, std, jerk_mad FROM tf JOIN hl USING (vec_id)) UNPIVOT (value FOR feature IN (rms, p2p, std, jerk_mad))),
 md AS (SELECT unit, feature, quantile_cont(value,0.5) AS center, stddev_pop(value) AS sd FROM fl WHERE healthy GROUP BY 1,2),
 ma AS (SELECT fl.unit, fl.feature, quantile_cont(abs(value-center),0.5)*1.4826::DOUBLE AS m FROM fl JOIN md ON fl.unit=md.unit AND fl.feature=md.feature WHERE healthy GROUP BY 1,2),
 ft AS (SELECT md.unit, md.feature, center, CASE WHEN m>=1e-9 THEN m WHEN sd>=1e-9 THEN sd ELSE 1 END AS scale FROM md JOIN ma ON md.unit=ma.unit AND md.feature=ma.feature),
 rw AS (SELECT vec_id, fl.unit, healthy, avg(greatest((value-center)/scale,0)) AS raw FROM fl JOIN ft ON fl.unit=ft.unit AND fl.feature=ft.feature GROUP BY 1,2,3)"""


def _raw(spark, sf):
    long_ = _long(spark, sf)
    return N.directed_score(long_, N.robust_fit(long_.filter("healthy")), ["vec_id", "healthy"])


@query("robust_baseline_fit", ("v_x",), f"WITH {_FL} SELECT unit, feature, round(center,6) AS center, round(scale,6) AS scale FROM ft")
def robust_baseline_fit(spark, sf):
    return _r(N.robust_fit(_long(spark, sf).filter("healthy")), ["unit", "feature"])


@query("directed_score", ("v_x",), f"WITH {_FL} SELECT vec_id, unit, round(raw,6) AS raw FROM rw")
def directed_score(spark, sf):
    return _r(_raw(spark, sf).select("vec_id", "unit", "raw"), ["vec_id", "unit"])


@query("ecdf_score", ("v_x",), f"WITH {_FL}, q AS (SELECT vec_id, unit, healthy, round(raw,9) AS raw FROM rw) SELECT vec_id, unit, round((SELECT count(*) FROM q h WHERE h.unit=q.unit AND h.healthy AND h.raw<=q.raw)/(SELECT count(*) FROM q h WHERE h.unit=q.unit AND h.healthy),9) AS score FROM q")
def ecdf_score(spark, sf):
    raw = _raw(spark, sf).withColumn("raw", F.round("raw", 9))
    return N.ecdf_score(raw, raw.filter("healthy"), ["unit"]).select("vec_id", "unit", F.round("score", 9).alias("score"))


@query("flag_threshold", ("v_x",), f"WITH {_FL}, q AS (SELECT vec_id, unit, healthy, round(raw,9) AS raw FROM rw), t AS (SELECT unit, quantile_cont(raw,0.9) AS thr FROM q WHERE healthy GROUP BY 1) SELECT vec_id, raw>=round(thr,9) AS flag FROM q JOIN t USING (unit)")
def flag_threshold(spark, sf):
    raw = _raw(spark, sf).withColumn("raw", F.round("raw", 9))
    f = N.flag_threshold(raw, raw.filter("healthy"), ["unit"], pct=0.9)
    return f.select("vec_id", (F.col("raw") >= F.round("threshold", 9)).alias("flag"))


@query("self_baseline_scan")
def self_baseline_scan(spark, sf):
    """Band energies scored against the recording's own windows (5 % flagged)."""
    bands = X.band_energy_features(centred_windows(spark, sf).select("vec_id", "unit", "sig"), FS, 16).drop("sig")
    long_ = bands.unpivot(["vec_id", "unit"], [f"band_{i:02d}" for i in range(16)], "feature", "value")
    raw = N.directed_score(long_, N.robust_fit(long_), ["vec_id"])
    scored = N.ecdf_score(raw, raw, ["unit"])
    return N.flag_threshold(scored, scored, ["unit"], pct=0.95).select("vec_id", "unit", "raw", "score", "flag")


@query("gaussian_baseline_fit")
def gaussian_baseline_fit(spark, sf):
    """Inverse of the shrunk correlation per unit (matrix inverse; compared with numpy in the tests)."""
    return N.gaussian_fit(feature_rows(spark, sf).filter("healthy"), "unit", ["rms", "p2p", "jerk_mad", "kurtosis"])


@query("mahalanobis_score")
def mahalanobis_score(spark, sf):
    fit = gaussian_baseline_fit(spark, sf)
    return N.mahalanobis_score(feature_rows(spark, sf), fit, "unit", ["rms", "p2p", "jerk_mad", "kurtosis"]).select("vec_id", "unit", "raw")


@query("robust_standardise", ("v_win",), """WITH q AS (SELECT session, quantile_cont(score,0.25) AS a, quantile_cont(score,0.5) AS m, quantile_cont(score,0.75) AS b FROM v_win GROUP BY 1)
 SELECT win_id, round((score-m)/CASE WHEN b=a THEN 1 ELSE b-a END,6) AS z FROM v_win JOIN q USING (session)""")
def robust_standardise(spark, sf):
    return N.robust_standardise(B.window_scores(spark, sf), K, "score").select("win_id", F.round("z", 6).alias("z"))


@query("calibrate_threshold", ("v_win",), "SELECT session, round(quantile_cont(s,0.95),6) AS v_thr FROM (SELECT session, avg(score) OVER (PARTITION BY session ORDER BY rn ROWS 9 PRECEDING) AS s FROM v_win) GROUP BY 1")
def calibrate_threshold(spark, sf):
    from ..kernels.quantiles import exact_percentiles

    w = Q.numbered(B.window_scores(spark, sf), K, "center_us", ["win_id"])
    return _r(exact_percentiles(Q.causal_rolling_mean(w, K, "rn", "score"), K, "smooth", {"v_thr": 0.95}), K)


def clips(spark, sf):
    return B.clip_scores(spark, sf)


_AUC = """cl AS (SELECT recording, score, y FROM v_clips), au AS (SELECT recording, sum(CASE WHEN y=1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y=0 THEN 1 ELSE 0 END) AS n FROM cl GROUP BY 1),
 w AS (SELECT a.recording, sum(CASE WHEN a.score>b.score THEN 1.0::DOUBLE WHEN a.score=b.score THEN 0.5::DOUBLE ELSE 0 END) AS u FROM cl a JOIN cl b ON a.recording=b.recording WHERE a.y=1 AND b.y=0 GROUP BY 1)"""


@query("auc", ("v_clips",), f"WITH {_AUC} SELECT recording, CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg, round(u/(p*n),9) AS auc FROM au LEFT JOIN w USING (recording)")
def auc(spark, sf):
    return V.auc(clips(spark, sf), ["recording"]).select("recording", "n_pos", "n_neg", F.round("auc", 9).alias("auc"))


_ROC = """t AS (SELECT recording, count(*) FILTER (y=1) AS p, count(*) FILTER (y=0) AS n FROM v_clips GROUP BY 1),
 ro AS (SELECT a.recording, thr, count(*) FILTER (y=0 AND score>=thr)/greatest(any_value(n),1) AS fpr, 1-count(*) FILTER (y=1 AND score>=thr)/greatest(any_value(p),1) AS fnr
  FROM (SELECT DISTINCT recording, score AS thr FROM v_clips) a JOIN v_clips c ON c.recording=a.recording JOIN t ON t.recording=a.recording GROUP BY 1,2),
 op AS (SELECT recording, arg_min(struct_pack(thr:=thr,fpr:=fpr,fnr:=fnr),(round(abs(fpr-fnr),12),thr)) AS equal_error, arg_min(struct_pack(thr:=thr,fpr:=fpr,fnr:=fnr),(round(fpr+fnr,12),thr)) AS youden,
  arg_min(struct_pack(thr:=thr,fpr:=fpr,fnr:=fnr),(fpr,thr)) FILTER (round(fnr,12)<=0.1) AS hr, arg_min(struct_pack(thr:=thr,fpr:=fpr,fnr:=fnr),(round(fnr,12),thr)) FILTER (round(fpr,12)<=0.05) AS lf FROM ro GROUP BY 1),
 ol AS (SELECT recording, 'equal_error' AS op, equal_error AS x FROM op UNION ALL SELECT recording, 'youden', youden FROM op UNION ALL SELECT recording, 'high_recall', coalesce(hr,youden) FROM op UNION ALL SELECT recording, 'low_fpr', coalesce(lf,youden) FROM op)"""


@query("roc_operating_points", ("v_clips",), f"WITH {_ROC} SELECT recording, op, x.thr AS thr, round(x.fpr,9) AS fpr, round(x.fnr,9) AS fnr FROM ol")
def roc_operating_points(spark, sf):
    return _r(V.roc_operating_points(clips(spark, sf), ["recording"]), ["recording", "op"], 9)


@query("operating_point_fpr", ("v_clips",), """WITH t AS (SELECT recording, quantile_cont(score,0.9) FILTER (y=0) AS thr FROM v_clips GROUP BY 1)
 SELECT recording, round(thr,6) AS thr, round(count(*) FILTER (y=0 AND score>=thr)/greatest(1,count(*) FILTER (y=0)),9) AS fpr, round(1-count(*) FILTER (y=1 AND score>=thr)/greatest(1,count(*) FILTER (y=1)),9) AS fnr
 FROM v_clips JOIN t USING (recording) WHERE thr IS NOT NULL GROUP BY recording, thr""")
def operating_point_fpr(spark, sf):
    o = V.operating_point(clips(spark, sf), ["recording"], 0.10)
    return o.select("recording", F.round("thr", 6).alias("thr"), F.round("fpr", 9).alias("fpr"), F.round("fnr", 9).alias("fnr"))


def _poisson_sql(mean: str, *parts: str) -> str:
    """A list of the draws that ``poisson_total`` sums, for a row whose mean is the column ``mean``."""
    u = f"CAST('0x'||substr(md5(concat_ws('|',{','.join(parts)},i)),1,13) AS BIGINT)/4503599627370496::DOUBLE"
    lists = [str(V.poisson_cdf(k)) + "::DOUBLE[]" for k in (V.POISSON_LUMP, V.POISSON_UNIT)]
    return (f"coalesce(list_sum(list_transform(range(CAST({mean}//16+{mean}%16 AS BIGINT)), "
            f"lambda i: len(list_filter(CASE WHEN i<{mean}//16 THEN {lists[0]} ELSE {lists[1]} END, lambda c: c<={u})))),0)")


@query("bootstrap_ci", ("v_clips",), f"""WITH d AS (SELECT recording, score, count(*) AS n, min(clip) AS id FROM v_clips WHERE score IS NOT NULL GROUP BY 1,2),
 w AS (SELECT recording, score, r, {_poisson_sql('n', '0', 'r', 'id')} AS w FROM d, range(500) t(r)),
 m AS (SELECT recording, sum(w*score)/nullif(sum(w),0) AS m FROM w GROUP BY recording, r),
 c AS (SELECT recording, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi FROM m GROUP BY 1)
 SELECT recording, round(mean,6) AS mean, round(lo,6) AS lo, round(hi,6) AS hi FROM (SELECT recording, avg(score) AS mean FROM v_clips GROUP BY 1) JOIN c USING (recording)""")
def bootstrap_ci(spark, sf):
    """95 % interval of the mean by hashed Poisson resampling."""
    return _r(V.bootstrap_mean_ci(clips(spark, sf), ["recording"], "clip", "score", b=500), ["recording"])


@query("bootstrap_auc_ci", ("v_clips",), f"""WITH {_AUC}, d AS (SELECT recording, score, count(*) FILTER (y=1) AS p, count(*) FILTER (y=0) AS q, min(clip) AS id FROM v_clips GROUP BY 1,2),
 x AS (SELECT recording, score, r, {_poisson_sql('p', '0', "'p'", 'r', 'id')} AS p, {_poisson_sql('q', '0', "'n'", 'r', 'id')} AS q FROM d, range(100) t(r)),
 k AS (SELECT recording, r, p, q, sum(q) OVER (PARTITION BY recording, r ORDER BY score) AS c FROM x),
 m AS (SELECT recording, sum(p*(c-q/2.0::DOUBLE))/nullif(sum(p)*sum(q),0) AS a FROM k GROUP BY recording, r),
 c AS (SELECT recording, quantile_cont(a,0.025) AS lo, quantile_cont(a,0.975) AS hi FROM m GROUP BY 1)
 SELECT recording, round(u/(p*n),6) AS auc, round(lo,6) AS lo, round(hi,6) AS hi FROM au LEFT JOIN w USING (recording) JOIN c USING (recording)""")
def bootstrap_auc_ci(spark, sf):
    return _r(V.bootstrap_auc_ci(clips(spark, sf), ["recording"], "clip", b=100), ["recording"])


@query("avg_rank", ("v_clips",), "SELECT clip, recording, rank() OVER (PARTITION BY recording ORDER BY score)+(count(*) OVER (PARTITION BY recording, score)-1)/2 AS rank FROM v_clips")
def avg_rank(spark, sf):
    return V.avg_rank(clips(spark, sf), ["recording"], "score").select("clip", "recording", "rank")


@query("mann_whitney", ("v_clips",), f"""WITH {_AUC}, ti AS (SELECT recording, sum(t*t*t-t) AS tt FROM (SELECT recording, count(*) AS t FROM cl GROUP BY recording, score) GROUP BY 1)
 SELECT recording, round(u,6) AS u, round((u-p*n/2-0.5)/sqrt(p*n/12*((p+n)+1-tt/((p+n)*((p+n)-1)))),6) AS z FROM au JOIN w USING (recording) JOIN ti USING (recording)""")
def mann_whitney(spark, sf):
    return V.mann_whitney(clips(spark, sf), ["recording"]).filter("n_pos > 0 AND n_neg > 0").select("recording", F.round("u", 6).alias("u"), F.round("z", 6).alias("z"))


@query("spearman", ("v_clips",), """SELECT recording, round(corr(ra,rb),6) AS rho FROM (SELECT recording, rank() OVER (PARTITION BY recording ORDER BY score)+(count(*) OVER (PARTITION BY recording, score)-1)/2 AS ra,
 rank() OVER (PARTITION BY recording ORDER BY score2)+(count(*) OVER (PARTITION BY recording, score2)-1)/2 AS rb FROM v_clips) GROUP BY 1 HAVING stddev_pop(ra)>0 AND stddev_pop(rb)>0""")
def spearman(spark, sf):
    return _r(V.spearman(clips(spark, sf), ["recording"], "score", "score2").filter("rho IS NOT NULL"), ["recording"])


@query("event_level_metrics", ("v_win", "v_iv"), """WITH g AS (SELECT * FROM (VALUES (0.3::DOUBLE),(0.5::DOUBLE)) a(thr), (VALUES (2),(4)) b(k)),
 r AS (SELECT session, thr, min(center_us) AS s, max(center_us) AS e, count(*) AS n FROM (SELECT *, rn-row_number() OVER (PARTITION BY session, thr ORDER BY rn) AS i FROM v_win, (VALUES (0.3::DOUBLE),(0.5::DOUBLE)) a(thr) WHERE score>=thr) GROUP BY session, thr, i),
 d AS (SELECT r.*, k FROM r JOIN g USING (thr) WHERE n>=k), f AS (SELECT * FROM v_iv WHERE label='fault'),
 evn AS (SELECT thr, k, count(*) AS events, count(*) FILTER (NOT EXISTS (SELECT 1 FROM d WHERE d.session=f.session AND d.thr=g.thr AND d.k=g.k AND d.s<=f.end_us+1500000 AND f.start_us-1500000<=d.e)) AS missed FROM f, g GROUP BY 1,2),
 fa AS (SELECT thr, k, count(*) FILTER (NOT EXISTS (SELECT 1 FROM f WHERE d.session=f.session AND d.s<=f.end_us+1500000 AND f.start_us-1500000<=d.e)) AS false_alarms FROM d GROUP BY 1,2),
 h AS (SELECT sum(greatest(d-coalesce(fs,0),0)/3.6e9) AS h FROM (SELECT session, max(center_us)-min(center_us) AS d FROM v_win GROUP BY 1) LEFT JOIN (SELECT session, sum(end_us-start_us) AS fs FROM f GROUP BY 1) USING (session))
 SELECT thr, CAST(k AS BIGINT) AS k, events, missed, false_alarms, round(missed/events,6) AS event_fnr, round(false_alarms/(SELECT h FROM h),6) AS fa_per_hour FROM evn JOIN fa USING (thr,k)""")
def event_level_metrics(spark, sf):
    m = V.event_level_metrics(B.window_scores(spark, sf), B.intervals(spark, sf).filter("label = 'fault'"), K, "center_us", "win_id", (0.3, 0.5), (2, 4), 1_500_000)
    return m.select("thr", F.col("k").cast("bigint").alias("k"), "events", "missed", "false_alarms", F.round("event_fnr", 6).alias("event_fnr"), F.round("fa_per_hour", 6).alias("fa_per_hour"))


_SEP = f"""{_FL}, u AS (SELECT vec_id, CAST(NOT healthy AS INT) AS y, feature, round(value,9) AS value FROM fl),
 sp2 AS (SELECT a.feature, sum(CASE WHEN a.value>b.value THEN 1.0::DOUBLE WHEN a.value=b.value THEN 0.5::DOUBLE ELSE 0 END)/count(*) AS auc FROM u a JOIN u b ON a.feature=b.feature WHERE a.y=1 AND b.y=0 GROUP BY 1)"""


def _separability(spark, sf):
    w = feature_rows(spark, sf).select("vec_id", (~F.col("healthy")).cast("int").alias("y"), *[F.round(c, 9).alias(c) for c in _FEATS])
    return V.feature_separability(w, ["vec_id"], _FEATS)


@query("feature_separability", ("v_x",), f"WITH {_SEP} SELECT feature, round(auc,6) AS auc FROM sp2")
def feature_separability(spark, sf):
    return _separability(spark, sf).select("feature", F.round("auc", 6).alias("auc"))


@query("feature_ranking", ("v_x",), f"WITH {_SEP} SELECT feature, round(auc,6) AS auc, round(abs(auc-0.5),6) AS distance FROM sp2 ORDER BY abs(auc-0.5) DESC")
def feature_ranking(spark, sf):
    r = V.ranked(_separability(spark, sf))
    return r.select("feature", F.round("auc", 6).alias("auc"), F.round("distance", 6).alias("distance"))


@query("rank_fusion", ("v_clips",), """WITH r AS (SELECT recording, y, rank() OVER (PARTITION BY recording ORDER BY score)+(count(*) OVER (PARTITION BY recording, score)-1)/2
  +rank() OVER (PARTITION BY recording ORDER BY score2)+(count(*) OVER (PARTITION BY recording, score2)-1)/2 AS f FROM v_clips)
 SELECT a.recording, round(sum(CASE WHEN a.f>b.f THEN 1.0::DOUBLE WHEN a.f=b.f THEN 0.5::DOUBLE ELSE 0 END)/count(*),9) AS auc FROM r a JOIN r b ON a.recording=b.recording WHERE a.y=1 AND b.y=0 GROUP BY 1""")
def rank_fusion(spark, sf):
    return V.rank_fusion(clips(spark, sf), ["recording"], "score", "score2").filter("auc IS NOT NULL").select("recording", F.round("auc", 9).alias("auc"))


@query("rate_at_transfer", ("v_clips",), f"""WITH {_ROC}, a AS (SELECT recording AS trained_on, x.thr AS thr FROM ol WHERE op='equal_error')
 SELECT trained_on, recording AS applied_to, thr, round(count(*) FILTER (y=0 AND score>=thr)/greatest(1,count(*) FILTER (y=0)),9) AS fpr, round(1-count(*) FILTER (y=1 AND score>=thr)/greatest(1,count(*) FILTER (y=1)),9) AS fnr
 FROM v_clips JOIN a ON recording<>trained_on GROUP BY 1,2,3""")
def rate_at_transfer(spark, sf):
    return _r(V.rate_at_transfer(clips(spark, sf), "recording"), ["trained_on", "applied_to"], 9)


@query("detector_crosstalk", ("v_win", "v_iv"), """WITH y AS (SELECT w.*, coalesce((SELECT arg_max(label,(start_us,label_id)) FROM v_iv l WHERE l.session=w.session AND l.label<>'fault' AND center_us>=start_us AND center_us<end_us),'none') AS klass FROM v_win w)
 SELECT klass, 'bearing' AS detector, round(avg(CAST(score>=0.5 AS INT)),9) AS fire_rate FROM y GROUP BY 1 UNION ALL SELECT klass, 'wobble', round(avg(CAST(1-score>=0.8 AS INT)),9) FROM y GROUP BY 1""")
def detector_crosstalk(spark, sf):
    m = Q.multi_class_label(B.window_scores(spark, sf), B.intervals(spark, sf), K, "win_id", "center_us", {"qs_wobbly": 1, "qs_smooth": 0})
    w = m.select(F.when(F.col("y") == 1, "qs_wobbly").when(F.col("y") == 0, "qs_smooth").otherwise("none").alias("klass"), F.col("score").alias("bearing"),
                 (1 - F.col("score")).alias("wobble"))
    return V.detector_crosstalk(w, {"bearing": 0.5, "wobble": 0.8}, "klass").withColumn("fire_rate", F.round("fire_rate", 9))


@query("severity_ladder", ("v_win",), "SELECT session AS severity, round(quantile_cont(score,0.5),9) AS median FROM v_win GROUP BY 1")
def severity_ladder(spark, sf):
    from ..kernels.quantiles import exact_percentiles

    return exact_percentiles(B.window_scores(spark, sf), K, "score", {"median": 0.5}).select(F.col("session").alias("severity"), F.round("median", 9).alias("median"))


@query("severity_stats", ("v_iv",), """WITH f AS (SELECT session, (start_us+end_us)/2 AS c, (end_us-start_us)/1e6 AS d, start_us, label_id FROM v_iv WHERE label='fault'), l AS (SELECT *, (c-lag(c) OVER (PARTITION BY session ORDER BY start_us, label_id))/1e6 AS lap FROM f)
 SELECT session AS severity, count(*) AS n, round(avg(d),6) AS mean_s, round(sum(d)/((arg_max(c,(start_us,label_id))-arg_min(c,(start_us,label_id)))/1e6),6) AS fault_share, round(quantile_cont(lap,0.5),6) AS median_lap_s FROM l GROUP BY 1""")
def severity_stats(spark, sf):
    f = B.intervals(spark, sf).filter("label = 'fault'").withColumnRenamed("session", "severity")
    s = V.severity_stats(f, "severity")
    return s.select("severity", "n", *[F.round(c, 6).alias(c) for c in ("mean_s", "fault_share", "median_lap_s")])


@query("kinematic_speed", ("v_iv",), """WITH f AS (SELECT session, (end_us-start_us)/1e6 AS d, row_number() OVER (PARTITION BY session ORDER BY end_us-start_us) AS r, count(*) OVER (PARTITION BY session) AS n FROM v_iv WHERE label='fault'),
 b AS (SELECT session, quantile_cont(d,0.5) AS b FROM f WHERE r<=greatest(1,n//2) GROUP BY 1) SELECT session, round(b,6) AS burst_s, round(0.4/b,6) AS v_m_s, round(0.4/b/(pi()*0.05),6) AS roller_hz FROM b""")
def kinematic_speed(spark, sf):
    return _r(V.kinematic_speed(B.intervals(spark, sf).filter("label = 'fault'"), "session"), K)


@query("session_dataset_stats", ("v_win", "v_iv"), """WITH y AS (SELECT w.session, CAST(EXISTS (SELECT 1 FROM v_iv l WHERE l.session=w.session AND l.label='fault' AND center_us>=start_us AND center_us<end_us) AS INT) AS y FROM v_win w)
 SELECT coalesce(session,'TOTAL') AS session, count(*) AS windows, CAST(sum(y) AS BIGINT) AS faults, round(avg(y),9) AS prevalence FROM y GROUP BY ROLLUP(session)""")
def session_dataset_stats(spark, sf):
    y = Q.label_center(B.window_scores(spark, sf), B.intervals(spark, sf), K, "win_id", "center_us", ["fault"])
    return y.rollup("session").agg(F.count(F.lit(1)).alias("windows"), F.sum("y").cast("bigint").alias("faults"), F.round(F.avg("y"), 9).alias("prevalence")).withColumn(
        "session", F.coalesce("session", F.lit("TOTAL")))


@query("strongest_tonal_topk", ("v_win",), """WITH t AS (SELECT session, win_id, center_us AS t_us, 'squeal' AS type, score FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, win_id) AS r FROM v_win WHERE score<0.98) WHERE r<=12)
 SELECT * FROM t UNION ALL SELECT session, win_id, center_us, 'energy', score FROM v_win WHERE score>=0.98""")
def strongest_tonal_topk(spark, sf):
    """Top 12 squeals per session (rank filter, pruned before the shuffle) merged with the energy events by time."""
    from pyspark.sql import Window

    w = B.window_scores(spark, sf)
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "win_id"))
    s = w.filter("score < 0.98").withColumn("r", rank).filter("r <= 12").withColumn("type", F.lit("squeal"))
    e = w.filter("score >= 0.98").withColumn("type", F.lit("energy"))
    cols = ["session", "win_id", F.col("center_us").alias("t_us"), "type", "score"]
    return s.select(*cols).unionByName(e.select(*cols)).orderBy("session", "t_us")


@query("uncertainty_topk", ("v_win",), "SELECT win_id, score FROM v_win ORDER BY abs(score-0.5), win_id LIMIT 40")
def uncertainty_topk(spark, sf):
    return V.uncertainty_topk(B.window_scores(spark, sf), "score", "win_id", 40).select("win_id", "score")


@query("random_batch")
def random_batch(spark, sf):
    return V.random_batch(B.window_scores(spark, sf), "win_id", 40).select("win_id", "score")


_PIX = """px AS (SELECT CAST(i//8 AS BIGINT) AS y, CAST(i%8 AS BIGINT) AS x, avg(v_x.x) FILTER (unit IN ('u0','u1','u2'))-avg(v_x.x) FILTER (unit NOT IN ('u0','u1','u2')) AS diff FROM v_x GROUP BY 1,2)"""


@query("best_roi_topk", ("v_x",), f"""WITH {_PIX} SELECT b.y, b.x, round(avg(p.diff),6) AS score FROM px b JOIN px p ON p.y>=b.y AND p.y<b.y+3 AND p.x>=b.x AND p.x<b.x+3
 WHERE b.y<5 AND b.x<5 AND b.y%2=0 AND b.x%2=0 GROUP BY 1,2 ORDER BY round(avg(p.diff),12) DESC, b.y, b.x LIMIT 1""")
def best_roi_topk(spark, sf):
    fault = F.col("unit").isin("u0", "u1", "u2")
    px = B.signal_windows(spark, sf).select(fault.alias("f"), F.posexplode("sig").alias("i", "v")).groupBy("i").agg(
        (F.avg(F.when(F.col("f"), F.col("v").cast("double"))) - F.avg(F.when(~F.col("f"), F.col("v").cast("double")))).alias("diff"))
    px = px.select(F.expr("i div 8").alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), "diff")
    b = V.best_roi_topk(px, 8, 8, 3, 3)
    return b.select("y", "x", F.round("score", 6).alias("score"))


@query("threshold_grid_search")
def threshold_grid_search(spark, sf):
    """3 x 3 grid of dark and motion gates by FP + FN of the in-order match (the grid is a key, not a loop)."""
    f = Q.numbered(B.frames(spark, sf), K, "host_us", ["frame_no"], out="no")
    grid = F.array(*[F.struct(F.lit(d).alias("d0"), F.lit(n).alias("net_thr")) for d in (0.3, 0.4, 0.5) for n in (0.2, 0.3, 0.5)])
    g = f.withColumn("g", F.explode(grid)).select("session", "no", "dark", "net", "g.d0", "g.net_thr")
    keys = ["session", "d0", "net_thr"]
    runs = Q.islands(g.withColumn("_d", F.col("dark") > F.col("d0")), Q.Seq(tuple(keys), ("no",), "no div 100000"), ["_d"], "cur._d <> prev._d", "_r").filter("_d")
    runs = runs.groupBy(*keys, "_r").agg(F.min("no").alias("first_no"), F.max("no").alias("last_no"), F.max("net").alias("m")).filter(F.col("m") >= F.col("net_thr"))
    runs = runs.select(*keys, (F.col("first_no") - 1).alias("first_no"), (F.col("last_no") + 1).alias("last_no"))
    runs = Q.cut_lineage(Q.merge_spans(Q.cut_lineage(runs), keys, "first_no", "last_no"))
    truth = Q.group_marks(f.filter("dark > 0.45 AND net > 0.25"), K, "no", 2)
    truth = truth.withColumn("g", F.explode(grid)).select("session", "first_no", "last_no", "g.d0", "g.net_thr")
    per = Q.greedy_interval_match(runs, truth, keys).groupBy("d0", "net_thr").agg(F.sum("detected").alias("detected"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return per.orderBy(F.col("fp") + F.col("fn"), "d0", "net_thr")


@query("train_test_split")
def train_test_split(spark, sf):
    return ML.grouped_split(B.window_scores(spark, sf), "session").groupBy("session", "split").agg(F.count(F.lit(1)).alias("n"))


def model_rows(spark, sf):
    """Labelled clips with simple text-derived features, grouped by language (texts are read once)."""
    d = B.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("session"), F.col("n_chars").cast("double").alias("f0"),
                                               F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("f1"),
                                               F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("f2"),
                                               (F.length(F.regexp_replace("text", "[^\\s]", "")) / F.greatest("n_chars", F.lit(1))).alias("f3"))
    from ..session import cut_lineage

    return cut_lineage(d.join(B.table(spark, sf, "labels"), "doc_id").withColumn("y", F.col("quality").cast("double")))


_MF = ["f0", "f1", "f2", "f3"]


@query("loso_random_forest")
def loso_random_forest(spark, sf):
    return ML.loso_random_forest(model_rows(spark, sf), "session", _MF, trees=20).select("doc_id", "session", "y", "prob")


@query("logreg_group_cv")
def logreg_group_cv(spark, sf):
    return ML.logreg_group_cv(model_rows(spark, sf), "session", _MF).select("doc_id", "session", "y", "prob")


@query("silver_label_job")
def silver_label_job(spark, sf):
    """Out-of-fold probability over a low-FPR threshold, merged into spans along the document order."""
    from ..session import cut_lineage

    oof = cut_lineage(ML.loso_random_forest(model_rows(spark, sf), "session", _MF, trees=20).select("doc_id", "session", "y", "prob", F.lit("all").alias("g")))
    thr = V.roc_operating_points(oof, ["g"], "prob").filter("op = 'low_fpr'").select("thr").scalar()
    return Q.runs_bridge_gap1(oof.withColumn("_f", F.col("prob") >= thr), K, "doc_id", "doc_id", "_f", 2, 0, chunk_us=100_000)


@query("active_learning_round")
def active_learning_round(spark, sf):
    return ML.active_learning(model_rows(spark, sf), "doc_id", _MF, rounds=2, trees=10)


@query("correlation_clusters", ("v_x",), """WITH RECURSIVE z AS (SELECT vec_id, unit, i, (x-avg(x) OVER w)/(stddev_pop(x) OVER w+1e-9) AS z FROM v_x WINDOW w AS (PARTITION BY vec_id)),
 c AS (SELECT b.vec_id AS id, a.vec_id AS earlier, sum(a.z*b.z)/64 AS c FROM z a JOIN z b ON a.unit=b.unit AND a.i=b.i AND a.vec_id<b.vec_id GROUP BY 1,2),
 p AS (SELECT id, min(earlier) AS parent FROM c WHERE c>0.35 GROUP BY 1),
 t AS (SELECT DISTINCT unit, vec_id, vec_id AS place FROM v_x UNION ALL SELECT t.unit, t.vec_id, p.parent FROM t JOIN p ON p.id=t.place),
 r AS (SELECT unit, vec_id, min(place) AS root FROM t GROUP BY 1,2) SELECT unit, vec_id, dense_rank() OVER (PARTITION BY unit ORDER BY root)-1 AS location FROM r""")
def correlation_clusters(spark, sf):
    """Greedy similarity clusters of windows per unit."""
    return V.correlation_clusters(B.signal_windows(spark, sf), ["unit"], "vec_id", "sig", 0.35)


@query("fault_inspection_index")
def fault_inspection_index(spark, sf):
    """Energy and squeal events with their nearest frame and clip bounds, numbered by time."""
    from ..operators.asof import nearest

    ev = strongest_tonal_topk(spark, sf).withColumnRenamed("win_id", "event_id")
    fr = B.frames(spark, sf).select("session", F.col("host_us").alias("t_us"), F.col("frame_no").alias("event_id"), "frame_no", "host_us", "name")
    m = nearest(ev, fr, K, "t_us", "event_id", ["frame_no", "host_us", "name"], "host_us", chunk_us=60_000_000)
    n = Q.numbered(m, K, "t_us", ["event_id"], out="i")
    return n.select("session", "i", "t_us", "type", "score", "match.frame_no", "match.name", ((F.col("match.host_us") - F.col("t_us")) / 1e6).alias("frame_dt"),
                    (F.col("t_us") - 1_500_000).alias("clip_start_us"), (F.col("t_us") + 1_500_000).alias("clip_end_us"))


def _staged(spark, sf):
    w = Q.numbered(B.window_scores(spark, sf), K, "center_us", ["win_id"])
    s = Q.causal_rolling_mean(w, K, "rn", "score", 10, "v")
    return ST.stage_machine(s, K, "center_us", "win_id", "rn", "v", v_thr=0.45, dwell=3, release=4)


_STAGED = "WITH RECURSIVE " + staged_sql("SELECT session, win_id AS id, rn, avg(score) OVER (PARTITION BY session ORDER BY rn ROWS 9 PRECEDING) AS v FROM v_win", 0.45, 3, 4)


@query("stage_machine", ("v_win",), _STAGED + " SELECT session, id AS win_id, stage, trend FROM staged")
def stage_machine(spark, sf):
    """Severity stages (sequential rule; replayed row by row in the tests)."""
    return _staged(spark, sf).select("session", "win_id", "stage", "trend")


@query("stage_histogram", ("v_win",), _STAGED + ' SELECT session, ' + ', '.join(f'count(*) FILTER (WHERE stage={k}) AS "{k}"' for k in range(4)) + ' FROM staged GROUP BY 1')
def stage_histogram(spark, sf):
    return _staged(spark, sf).groupBy("session").pivot("stage", [0, 1, 2, 3]).count().na.fill(0)


@query("stage_contract_b")
def stage_contract_b(spark, sf):
    """Staged records: score, smooth, stage, trend, lap phase and running locus."""
    laps = P.route_variants(_laps(spark, sf), K)
    return ST.contract_b(_staged(spark, sf), laps, K, "win_id", "center_us", raw="score")
