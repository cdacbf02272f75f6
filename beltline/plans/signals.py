"""Window features, gating, spectra and embeddings."""

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import sequences as Q
from . import bindings as B
from .registry import query

FS = 64.0
K = ["session"]


def _r(df, keep, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


def centred_windows(spark, sf):
    return B.signal_windows(spark, sf).withColumn("sig", X.centred(F.col("sig")))


CENTRED = "c AS (SELECT vec_id, unit, i, x-avg(x) OVER (PARTITION BY vec_id) AS x FROM v_x)"
TF = f"""{CENTRED}, d AS (SELECT *, x-lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS dx, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS px FROM c),
 m AS (SELECT vec_id, unit, sqrt(avg(x*x)) AS rms, max(x)-min(x) AS p2p, stddev_pop(x) AS std, max(abs(x)) AS peak, avg(abs(dx)) AS jerk_mad, avg(CASE WHEN px IS NOT NULL THEN CAST(sign(x)<>sign(px) AS INT) END) AS zcr FROM d GROUP BY 1,2),
 tf AS (SELECT m.*, peak/rms AS crest, k.k4 AS kurtosis, k.k3 AS skew FROM m JOIN (SELECT c.vec_id, avg(pow(x/std,4)) AS k4, avg(pow(x/std,3)) AS k3 FROM c JOIN m USING (vec_id) GROUP BY 1) k USING (vec_id))"""


@query("dynamic_magnitude", ("v_imu",), "SELECT event_id, round(m-avg(m) OVER (PARTITION BY session, t_us//10000000),6) AS dyn FROM (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS m FROM v_imu)")
def dynamic_magnitude(spark, sf):
    d = B.imu(spark, sf).select("event_id", "session", F.expr("t_us div 10000000").alias("w"), X.magnitude(F.col("ax"), F.col("ay"), F.col("az")).alias("m"))
    mean = d.groupBy("session", "w").agg(F.avg("m").alias("mean"))
    return d.join(mean, ["session", "w"]).select("event_id", F.round(F.col("m") - F.col("mean"), 6).alias("dyn"))


@query("time_features", ("v_x",), f"WITH {TF} SELECT vec_id, " + ", ".join(f"round({c},6) AS {c}" for c in X.TIME) + " FROM tf")
def time_features(spark, sf):
    return _r(X.time_features(centred_windows(spark, sf)).select("vec_id", *X.TIME), ["vec_id"])


_DFT = f"""{CENTRED}, h AS (SELECT vec_id, i, x*(0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*i/63)) AS x FROM c),
 sp AS (SELECT vec_id, f, pow(sum(x*cos(2*pi()*f*i/64)),2)+pow(sum(x*sin(2*pi()*f*i/64)),2) AS p FROM h, range(33) r(f) GROUP BY 1,2),
 t AS (SELECT vec_id, sum(p)+1e-12 AS tot, avg(p) AS ap, exp(avg(ln(p+1e-12))) AS geo FROM sp GROUP BY 1),
 q AS (SELECT sp.*, p/tot AS pn, tot, ap, geo, sum(p/tot) OVER (PARTITION BY vec_id ORDER BY f) AS cum FROM sp JOIN t USING (vec_id)),
 z AS (SELECT vec_id, sum(f*pn) AS centroid FROM q GROUP BY 1)"""
_SHAPE_SQL = ", ".join(f"round(coalesce(sum(pn) FILTER (f>={b}*4 AND f<{b}*4+4),0),6) AS band{b}" for b in range(8))


@query("spectral_shape", ("v_x",), f"""WITH {_DFT} SELECT vec_id, {_SHAPE_SQL}, round(sum(pn) FILTER (f>=16),6) AS hf_ratio, round(any_value(centroid),6) AS centroid,
 round(sqrt(sum(pow(f-centroid,2)*pn)),6) AS spread, round(any_value(geo/(ap+1e-12)),6) AS flatness, round(-sum(pn*ln(pn+1e-12)),6) AS entropy,
 CAST(count(*) FILTER (cum<0.85) AS DOUBLE) AS rolloff FROM q JOIN z USING (vec_id) GROUP BY 1""")
def spectral_shape(spark, sf):
    f = X.spectral_shape(centred_windows(spark, sf).select("vec_id", "sig"), FS).drop("sig")
    return _r(f, ["vec_id", "rolloff"])


@query("envelope_features")
def envelope_features(spark, sf):
    """High-band envelope (zero-phase filter and Hilbert transform; tested on tones)."""
    return X.envelope_features(centred_windows(spark, sf).select("vec_id", "sig"), FS).drop("sig")


def imu_windows(spark, sf, n=32, step=16):
    rows = Q.numbered(B.imu(spark, sf), K, "t_us", ["event_id"])
    return X.window_arrays(Q.sliding_sample_windows(rows, K, "rn", n, step), [*K, "win"], "rn", ["t_us", "ax", "ay", "az", "gx", "gy", "gz"], n)


_W32 = """wn AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_us, event_id) AS rn FROM v_imu),
 ww AS (SELECT session, w AS win, rn, ax, ay, az, gx, gy, gz FROM wn, LATERAL (SELECT unnest(range(0,(rn-1)//16+1)) AS w) WHERE rn-1>=w*16 AND rn-1<w*16+32),
 wf AS (SELECT session, win FROM ww GROUP BY 1,2 HAVING count(*)=32)"""


@query("extract_window_features", ("v_imu",), f"""WITH {_W32}, e AS (SELECT w.*, sqrt(ax*ax+ay*ay+az*az) AS m, sqrt(gx*gx+gy*gy+gz*gz) AS g FROM ww w JOIN wf USING (session, win)),
 d AS (SELECT *, m-lag(m) OVER (PARTITION BY session, win ORDER BY rn) AS dm FROM e)
 SELECT session, win, round(stddev_pop(m),6) AS a_rms, round(max(m)-min(m),6) AS a_p2p, round(stddev_pop(m),6) AS a_std, round(avg(abs(dm)),6) AS a_jerk_mad,
  round(stddev_pop(ax),6) AS a_rms_x, round(stddev_pop(ay),6) AS a_rms_y, round(stddev_pop(az),6) AS a_rms_z, round(stddev_pop(g),6) AS g_rms FROM d GROUP BY 1,2""")
def extract_window_features(spark, sf):
    f = X.extract_window_features(imu_windows(spark, sf), [*K, "win"], 50.0, include_gyro=True)
    return _r(f.select(*K, "win", "a_rms", "a_p2p", "a_std", "a_jerk_mad", "a_rms_x", "a_rms_y", "a_rms_z", "g_rms"), [*K, "win"])


def _bursts(spark, sf):
    b = Q.split_bursts(B.imu(spark, sf).withColumn("mag", X.magnitude(F.col("ax"), F.col("ay"), F.col("az"))), K, ["t_us", "event_id"], "k", min_len=3)
    return Q.numbered(b, K, "t_us", ["event_id"], out="row")


def _psd(spark, sf):
    w = X.burst_windows(_bursts(spark, sf), K, "row", "mag", n_fft=8)
    return X.mean_psd(w, K, 800.0, 8)


_BURST = """bb AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS mag, sum(CASE WHEN k>p THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t_us, event_id) AS burst FROM
  (SELECT *, lag(k) OVER (PARTITION BY session ORDER BY t_us, event_id) AS p FROM v_imu)),
 bc AS (SELECT session, burst, mag-avg(mag) OVER g AS v, row_number() OVER (PARTITION BY session, burst ORDER BY t_us, event_id)-1 AS i, count(*) OVER g AS n FROM bb WINDOW g AS (PARTITION BY session, burst)),
 bw AS (SELECT session, burst, 0 AS w, i, n, v*(0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*i/(n-1))) AS x FROM bc WHERE n>=3 AND n<8
   UNION ALL SELECT session, burst, w, i-w*4, n, v*(0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*(i-w*4)/7)) FROM bc, range(30) r(w) WHERE n>=8 AND w*4+8<=n AND i>=w*4 AND i<w*4+8),
 bp AS (SELECT session, burst, w, f, pow(sum(x*cos(2*pi()*f*i/8)),2)+pow(sum(x*sin(2*pi()*f*i/8)),2) AS p FROM bw, range(5) r(f) GROUP BY 1,2,3,4),
 ps AS (SELECT session, f AS bin, f*100.0::DOUBLE AS freq, avg(p) AS power FROM bp GROUP BY 1,2)"""


@query("welch_burst_psd", ("v_imu",), f"WITH {_BURST} SELECT session, bin, freq, round(power,6) AS power FROM ps")
def welch_burst_psd(spark, sf):
    return _psd(spark, sf).select("session", F.col("bin").cast("bigint").alias("bin"), "freq", F.round("power", 6).alias("power"))


@query("spectral_ratio_bands", ("v_imu",), f"WITH {_BURST} SELECT session, round(sum(power) FILTER (freq<150)/sum(power),6) AS low, round(sum(power) FILTER (freq>=150)/sum(power),6) AS high FROM ps GROUP BY 1")
def spectral_ratio_bands(spark, sf):
    return _r(X.spectral_ratio_bands(_psd(spark, sf), K, {"low": (0, 150), "high": (150, 1e9)}), K)


@query("high_band_fraction", ("v_imu",), f"WITH {_BURST} SELECT session, round(sum(power) FILTER (freq>=400)/sum(power),6) AS hi400 FROM ps GROUP BY 1")
def high_band_fraction(spark, sf):
    return _r(X.spectral_ratio_bands(_psd(spark, sf), K, {"hi400": (400, 1e9)}), K)


@query("tonal_peaks")
def tonal_peaks(spark, sf):
    """Prominent lines of each unit's mean window spectrum."""
    w = centred_windows(spark, sf)
    psd = X.mean_psd(_window_spectra(w), ["unit"], FS, 64)
    return X.tonal_peaks(psd, ["unit"], 1.0, 31.0, prominence_db=0.5, distance=2)


def _window_spectra(w):
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<double>")
    def spectrum(v: pd.Series) -> pd.Series:
        return pd.Series([X.S.power(np.asarray(a, float)[None, :])[0].tolist() for a in v])

    return w.withColumn("psd", spectrum("sig"))


@query("bearing_window_features")
def bearing_window_features(spark, sf):
    rows = Q.numbered(B.imu(spark, sf), K, "t_us", ["event_id"])
    return X.bearing_window_features(rows, K, "rn", "t_us", 50.0)


@query("wobble_features")
def wobble_features(spark, sf):
    rows = Q.numbered(B.imu(spark, sf), K, "t_us", ["event_id"])
    return X.wobble_features(rows, K, "rn", "t_us", 25.0)


@query("rms_envelope", ("v_imu",), "SELECT event_id, round(sqrt(avg(ax*ax) OVER (PARTITION BY session ORDER BY t_us RANGE BETWEEN 1000000 PRECEDING AND 1000000 FOLLOWING)),6) AS env FROM v_imu")
def rms_envelope(spark, sf):
    return X.rms_envelope(B.imu(spark, sf), K, "t_us", "ax", 1_000_000).select("event_id", F.round("env", 6).alias("env"))


@query("band_energy_features")
def band_energy_features(spark, sf):
    return X.band_energy_features(centred_windows(spark, sf).select("vec_id", "unit", "sig"), FS, 16).drop("sig")


_HB = f"{_DFT}, hb AS (SELECT vec_id, arg_max(f,(p,-f)) AS pitch, max(p) AS mx, quantile_cont(p,0.5) AS med FROM sp WHERE f>=12 GROUP BY 1)"


@query("tonal_score", ("v_x",), f"WITH {_HB} SELECT vec_id, round(mx/(med+1e-12),6) AS tonal_score, CAST(pitch AS DOUBLE) AS pitch_hz FROM hb")
def tonal_score(spark, sf):
    return _r(X.tonal_score(centred_windows(spark, sf).select("vec_id", "sig"), FS, 12.0).drop("sig"), ["vec_id", "pitch_hz"])


_CLIP_BANDS = [0, 4, 8, 12, 16, 24, 32]
_CLIP = f"""{CENTRED}, cf AS (SELECT vec_id, w, i-w*8 AS j, x*(0.5::DOUBLE-0.5::DOUBLE*cos(2*pi()*(i-w*8)/15)) AS x FROM c, range(6) r(w) WHERE i>=w*8 AND i<w*8+16),
 cp AS (SELECT vec_id, w, f, pow(sum(x*cos(2*pi()*f*j/16)),2)+pow(sum(x*sin(2*pi()*f*j/16)),2) AS p FROM cf, range(9) r(f) GROUP BY 1,2,3),
 ca AS (SELECT vec_id, f*4 AS hz, avg(p) AS p FROM cp GROUP BY 1,2),
 cs AS (SELECT vec_id, max(p) FILTER (hz>=12)/(median(p) FILTER (hz>=12)+1e-12) AS tonal, sum(p) FILTER (hz>=16)/(sum(p)+1e-12) AS hf_ratio, sum(p*hz)/(sum(p)+1e-12) AS centroid,
  {", ".join(f"sum(p) FILTER (hz>={a} AND hz<{b}) AS band_{a}_{b}" for a, b in zip(_CLIP_BANDS, _CLIP_BANDS[1:]))} FROM ca GROUP BY 1),
 ct AS (SELECT vec_id, unit, sqrt(avg(x*x)) AS rms, max(abs(x))/(sqrt(avg(x*x))+1e-9) AS crest, avg(pow(x,4))/pow(sqrt(avg(x*x))+1e-12,4) AS kurtosis FROM c GROUP BY 1,2)"""
_CLIP_NAMES = ["rms", "crest", "kurtosis", "tonal", "hf_ratio", "centroid", *(f"band_{a}_{b}" for a, b in zip(_CLIP_BANDS, _CLIP_BANDS[1:]))]


@query("clip_acoustic_features", ("v_x",), f"WITH {_CLIP} SELECT vec_id, unit, {', '.join(f'round({c},6) AS {c}' for c in _CLIP_NAMES)} FROM ct JOIN cs USING (vec_id)")
def clip_acoustic_features(spark, sf):
    f = X.clip_acoustic_features(B.signal_windows(spark, sf).select("vec_id", "unit", "sig"), FS, _CLIP_BANDS, 12.0, 16.0, nfft=16).drop("sig")
    return _r(f, ["vec_id", "unit"])


def _tiles(spark, sf, us=10_000_000):
    return B.imu(spark, sf).withColumn("clip", F.expr(f"t_us div {us}"))


@query("clip_imu_features", ("v_imu",), """WITH s AS (SELECT session, t_us//10000000 AS clip, sqrt(ax*ax+ay*ay+az*az) AS m, gx*gx+gy*gy+gz*gz AS g2 FROM v_imu),
 c AS (SELECT *, m-avg(m) OVER (PARTITION BY session, clip) AS v FROM s)
 SELECT session, clip, round(sqrt(avg(v*v)),6) AS imu_rms, round(max(abs(v))/(sqrt(avg(v*v))+1e-9),4) AS imu_crest, round(sqrt(avg(g2)),6) AS imu_gyro_rms FROM c GROUP BY 1,2 HAVING count(*)>=8""")
def clip_imu_features(spark, sf):
    """Clip statistics need no order, so they are plain aggregates (two passes for the mean)."""
    s = _tiles(spark, sf).select("session", "clip", X.magnitude(F.col("ax"), F.col("ay"), F.col("az")).alias("m"),
                                 (F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")).alias("g2"))
    mean = s.groupBy("session", "clip").agg(F.avg("m").alias("mu"), F.count(F.lit(1)).alias("n")).filter("n >= 8")
    v = s.join(mean, ["session", "clip"]).withColumn("v", F.col("m") - F.col("mu"))
    rms = F.sqrt(F.avg(F.col("v") * F.col("v")))
    return v.groupBy("session", "clip").agg(F.round(rms, 6).alias("imu_rms"), F.round(F.max(F.abs("v")) / (rms + 1e-9), 4).alias("imu_crest"),
                                            F.round(F.sqrt(F.avg("g2")), 6).alias("imu_gyro_rms"))


@query("modality_align", ("v_imu",), """WITH a AS (SELECT session, t_us//10000000 AS clip, round(sqrt(avg(value*value)),6) AS a_rms FROM v_imu WHERE event_type='view' GROUP BY 1,2),
 i AS (SELECT session, t_us//10000000 AS clip, round(stddev_pop(sqrt(ax*ax+ay*ay+az*az)),6) AS imu_rms FROM v_imu GROUP BY 1,2 HAVING count(*)>=8) SELECT * FROM a JOIN i USING (session, clip)""")
def modality_align(spark, sf):
    audio = _tiles(spark, sf).filter("event_type = 'view'").groupBy("session", "clip").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("a_rms"))
    return audio.join(clip_imu_features(spark, sf).select("session", "clip", "imu_rms"), ["session", "clip"])


@query("highband_indicators")
def highband_indicators(spark, sf):
    rows = Q.numbered(B.imu(spark, sf), K, "t_us", ["event_id"])
    last = rows.groupBy("session").agg(F.max("rn").alias("N"))
    clips = last.select("session", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(N - 1) div 100"))).alias("clip")).select(
        "session", "clip", (F.col("clip") * 100 + 1).alias("i0"), (F.col("clip") * 100 + 101).alias("i1"))
    return X.highband_indicators(rows, clips, K, "rn", "gz", 100.0, 25.0)


@query("spectrogram_49x40")
def spectrogram_49x40(spark, sf):
    return X.spectrogram(B.signal_windows(spark, sf).select("vec_id", "sig"), 50.0).select("vec_id", "spectrogram")


@query("quantize_int8", ("v_x",), """SELECT vec_id, i, CAST(greatest(-128,least(127,round_even(x/0.05+3,0))) AS BIGINT) AS q, (greatest(-128,least(127,round_even(x/0.05+3,0)))-3)*0.05::DOUBLE AS x FROM v_x""")
def quantize_int8(spark, sf):
    q = X.quantize_int8(F.col("sig"), 0.05, 3)
    d = B.signal_windows(spark, sf).select("vec_id", q.alias("q")).withColumn("x", X.dequantize(F.col("q"), 0.05, 3))
    z = d.select("vec_id", F.posexplode(F.arrays_zip("q", "x")).alias("i", "r"))
    return z.select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("r.q").cast("bigint").alias("q"), F.col("r.x").alias("x"))


_CEN = "cen AS (SELECT unit, i, avg(x) AS c FROM v_x GROUP BY 1,2), dist AS (SELECT vec_id, v_x.unit, sqrt(sum(pow(x-c,2))) AS d FROM v_x JOIN cen ON cen.unit=v_x.unit AND cen.i=v_x.i GROUP BY 1,2)"


def _distances(spark, sf):
    from ..operators.baseline import centroid_fit

    w = B.signal_windows(spark, sf)
    fit = centroid_fit(w, "unit", "sig", "vec_id")
    d = w.join(fit, "unit").withColumn("distance", X.l2_distance(F.transform("sig", lambda v: v.cast("double")), F.col("centroid")))
    return fit, d


@query("l2_to_centroid", ("v_x",), f"WITH {_CEN}, th AS (SELECT unit, quantile_cont(d,0.95) AS t FROM dist GROUP BY 1) SELECT vec_id, unit, round(d,6) AS distance, d>t AS alert FROM dist JOIN th USING (unit)")
def l2_to_centroid(spark, sf):
    _, d = _distances(spark, sf)
    return d.select("vec_id", "unit", F.round("distance", 6).alias("distance"), (F.col("distance") > F.col("threshold")).alias("alert"))


@query("centroid_fit", ("v_x",), f"WITH {_CEN} SELECT unit, round(quantile_cont(d,0.95),6) AS threshold, round((SELECT sum(c) FROM cen WHERE cen.unit=dist.unit),6) AS centroid_sum FROM dist GROUP BY 1")
def centroid_fit(spark, sf):
    fit, _ = _distances(spark, sf)
    return fit.select("unit", F.round("threshold", 6).alias("threshold"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, v: s + v), 6).alias("centroid_sum"))


_GR = """gr AS (SELECT w.session, w.win_id, CASE WHEN count(i.gz)>=3 THEN sqrt(avg(gx*gx+gy*gy+gz*gz)) END AS energy FROM v_win w LEFT JOIN v_imu i ON i.session=w.session AND i.t_us>=w.center_us-1500000 AND i.t_us<w.center_us+1500000 GROUP BY 1,2)"""


def _gyro(spark, sf):
    return X.window_gyro_rms(B.imu(spark, sf), B.window_scores(spark, sf), K, "win_id", win_us=3_000_000)


@query("window_gyro_rms", ("v_imu", "v_win"), f"WITH {_GR} SELECT session, win_id, round(energy,6) AS energy FROM gr")
def window_gyro_rms(spark, sf):
    return _gyro(spark, sf).select("session", "win_id", F.round("energy", 6).alias("energy"))


@query("motion_threshold", ("v_imu", "v_win"), f"WITH {_GR} SELECT session, round(quantile_cont(energy,0.5),6) AS threshold FROM gr GROUP BY 1")
def motion_threshold(spark, sf):
    from ..kernels.quantiles import exact_percentiles

    return _r(exact_percentiles(_gyro(spark, sf), K, "energy", {"threshold": 0.5}), K)


@query("motion_gate", ("v_imu", "v_win"), f"WITH {_GR} SELECT session, win_id, coalesce(energy>=(SELECT quantile_cont(energy,0.5) FROM gr g WHERE g.session=gr.session),true) AS keep FROM gr")
def motion_gate(spark, sf):
    return X.motion_gate(_gyro(spark, sf), K).select("session", "win_id", "keep")


_REG = """g AS (SELECT *, sqrt(gx*gx+gy*gy+gz*gz) AS g, EXISTS (SELECT 1 FROM v_iv l WHERE l.session=v_imu.session AND l.label='fault' AND t_us>=start_us AND t_us<end_us) AS f FROM v_imu),
 c AS (SELECT session, quantile_cont(g,0.4) AS lo, quantile_cont(g,0.75) AS hi FROM g GROUP BY 1)"""


@query("motion_regime_mask", ("v_imu", "v_iv"), f"WITH {_REG} SELECT event_id, CASE WHEN f THEN 'fault' WHEN g<lo THEN 'straight' WHEN g>hi THEN 'turn' ELSE 'other' END AS regime FROM g JOIN c USING (session)")
def motion_regime_mask(spark, sf):
    m = Q.label_center(B.imu(spark, sf), B.intervals(spark, sf), K, "event_id", "t_us", ["fault"]).withColumn("covered", F.col("y") == 1)
    return X.motion_regime(m, K, "covered").select("event_id", "regime")


@query("fault_vs_baseline_ratio", ("v_imu", "v_iv"), f"WITH {_REG} SELECT session, round(avg(g) FILTER (f),6) AS fault_mean, round(avg(g) FILTER (NOT f),6) AS base_mean, round(avg(g) FILTER (f)/avg(g) FILTER (NOT f),6) AS ratio FROM g GROUP BY 1")
def fault_vs_baseline_ratio(spark, sf):
    m = Q.label_center(B.imu(spark, sf), B.intervals(spark, sf), K, "event_id", "t_us", ["fault"])
    g = X.magnitude(F.col("gx"), F.col("gy"), F.col("gz"))
    f, b = F.avg(F.when(F.col("y") == 1, g)), F.avg(F.when(F.col("y") == 0, g))
    return m.groupBy("session").agg(F.round(f, 6).alias("fault_mean"), F.round(b, 6).alias("base_mean"), F.round(f / b, 6).alias("ratio"))


@query("roi_dark_motion")
def roi_dark_motion(spark, sf):
    w = B.signal_windows(spark, sf).select(
        "unit", "vec_id", (F.col("vec_id") * 200_000).alias("t_us"),
        F.transform("sig", lambda v: F.greatest(F.lit(0), F.least(F.lit(127), ((v + 3) * 21).cast("int")))).alias("gray"))
    return X.roi_dark_motion(w, ["unit"], ["t_us", "vec_id"]).select("unit", "vec_id", "dark", "net")


_SPC = f"{_DFT}, ac AS (SELECT unit IN ('u0','u1','u2') AS fault, f, avg(p) AS power FROM sp JOIN v_sig USING (vec_id) GROUP BY 1,2)"


@query("avg_spectrum_by_class", ("v_x", "v_sig"), f"WITH {_SPC} SELECT a.f AS bin, round(a.power,6) AS fault_power, round(b.power,6) AS normal_power, round(a.power/(b.power+1e-12),6) AS ratio FROM ac a JOIN ac b USING (f) WHERE a.fault AND NOT b.fault")
def avg_spectrum_by_class(spark, sf):
    w = _window_spectra(centred_windows(spark, sf).withColumn("fault", F.col("unit").isin("u0", "u1", "u2")))
    p = X.mean_psd(w, ["fault"], FS, 64)
    m = p.groupBy("bin").agg(F.max(F.when(F.col("fault"), F.col("power"))).alias("f"), F.max(F.when(~F.col("fault"), F.col("power"))).alias("n"))
    return m.select(F.col("bin").cast("bigint").alias("bin"), F.round("f", 6).alias("fault_power"), F.round("n", 6).alias("normal_power"),
                    F.round(F.col("f") / (F.col("n") + 1e-12), 6).alias("ratio"))


@query("decode_captures", ("v_x",), "SELECT vec_id, 'healthy' AS label, i, CAST(greatest(-128,least(127,round_even(x/0.05+3,0))) AS BIGINT) AS q FROM v_x")
def decode_captures(spark, sf):
    """base64 int8 windows back to training rows (the windows are packed here, then decoded)."""
    from ..sources.logs import decode_int8_b64

    q = X.quantize_int8(F.col("sig"), 0.05, 3)
    hexed = F.array_join(F.transform(q, lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0")), "")
    cap = B.signal_windows(spark, sf).select("vec_id", F.lit("healthy").alias("label"), F.base64(F.unhex(hexed)).alias("features_b64"))
    d = decode_int8_b64(cap).select("vec_id", "label", F.posexplode("q").alias("i", "q"))
    return d.select("vec_id", "label", F.col("i").cast("bigint").alias("i"), F.col("q").cast("bigint").alias("q"))
