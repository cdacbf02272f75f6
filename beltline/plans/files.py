"""File sources and sinks: recordings are written out per session by Spark and scanned back."""

import io
import wave

import pandas as pd
from pyspark.sql import functions as F

from ..schemas import MERGED
from ..session import run_dir
from ..sources import media as SM
from ..sources import sessions as SS
from . import bindings as B
from .registry import query


def _folders(df, spark, name, header=False):
    base = run_dir(spark, name)
    df.write.partitionBy("session").option("header", str(header).lower()).csv(base)
    return f"{base}/session=*/*.csv"


def _name(c="session"):
    return F.regexp_replace(c, "^session=", "").alias("session")


@query("scan_session_imu", ("v_imu",), "SELECT session, round(t_us/1e6,6) AS t, ax, gz FROM v_imu")
def scan_session_imu(spark, sf):
    d = B.imu(spark, sf).select("session", (F.col("t_us") / 1e6).alias("t"), "ax", "ay", "az", "gx", "gy", "gz")
    s = SS.scan_session_imu(spark, _folders(d, spark, "imu"))
    return s.select(_name(), F.round("t", 6).alias("t"), "ax", "gz")


@query("scan_session_mag", ("v_imu",), "SELECT session, round(t_us/1e6,6) AS t, mx, my FROM v_imu")
def scan_session_mag(spark, sf):
    d = B.imu(spark, sf).select("session", (F.col("t_us") / 1e6).alias("t"), "mx", "my", F.lit(0.0).alias("mz"))
    return SS.scan_session_mag(spark, _folders(d, spark, "mag", True)).select(_name(), F.round("t", 6).alias("t"), "mx", "my")


@query("scan_labels", ("v_iv",), "SELECT session, round(start_us/1e6,6) AS start, label, round(end_us/1e6,6) AS \"end\" FROM v_iv WHERE label<>'qs_smooth'")
def scan_labels(spark, sf):
    d = B.intervals(spark, sf).select("session", (F.col("start_us") / 1e6).alias("start"), ((F.col("end_us") - F.col("start_us")) / 1e6).alias("length"),
                                      F.when(F.col("label") == "qs_smooth", " ").otherwise(F.concat(F.lit(" "), "label")).alias("label"), F.lit(1.0).alias("conf"),
                                      F.lit("x").alias("comment"))
    s = SS.scan_labels(spark, _folders(d, spark, "labels", True))
    return s.select(_name(), F.round("start", 6).alias("start"), "label", F.round("end", 6).alias("end"))


@query("scan_merged_recorder", ("v_imu",), """WITH f AS (SELECT session, ts_us, t_us, t_us%1000000 AS dev, event_id, ax, ay, gz FROM v_imu),
 r AS (SELECT session, 1e6::DOUBLE/quantile_cont(d,0.5) AS fs FROM (SELECT session, dev-lag(dev) OVER (PARTITION BY session ORDER BY ts_us, t_us) AS d FROM f) WHERE d>0 GROUP BY 1)
 SELECT session, ts_us AS t_host_us, dev AS t_dev_us, CAST(event_id AS INT) AS temp_raw, round(t_us/1e6-min(t_us) OVER (PARTITION BY session)/1e6,6) AS t_wall, ax AS acc_x_g, ay AS acc_y_g, gz AS gyr_z_dps,
 round(fs,6) AS fs, round((row_number() OVER (PARTITION BY session ORDER BY ts_us, t_us, event_id)-1)/fs,7) AS t FROM f JOIN r USING (session)""")
def scan_merged_recorder(spark, sf):
    """All 23 columns written and scanned; clocks, rate and the even timeline compared. The device clock restarts every second."""
    given = {"t_host_us": F.col("ts_us"), "t_rel_s": F.col("t_us") / 1e6, "t_dev_us": F.col("t_us") % 1_000_000, "acc_x_g": F.col("ax"), "acc_y_g": F.col("ay"),
             "acc_z_g": F.col("az"), "gyr_x_dps": F.col("gx"), "gyr_y_dps": F.col("gy"), "gyr_z_dps": F.col("gz"), "temp_raw": F.col("event_id")}
    d = B.imu(spark, sf).select("session", *(given.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in MERGED.fields))
    rows = SS.scan_merged_recorder(spark, _folders(d, spark, "merged", True), strict=True)
    rows = SS.uniform_timeline(rows, ("t_host_us", "t_rel_s", "temp_raw"))
    return rows.select(_name(), "t_host_us", "t_dev_us", "temp_raw", F.round("t_wall", 6).alias("t_wall"), "acc_x_g", "acc_y_g", "gyr_z_dps", F.round("fs", 6).alias("fs"),
                       F.round("t", 7).alias("t"))


@query("scan_wav", ("v_imu",), """SELECT session||'/'||(t_us//60000000) AS clip, 16000 AS fs, row_number() OVER (PARTITION BY session, t_us//60000000 ORDER BY t_us, event_id)-1 AS pos,
 CAST(k*300-15000+k*53%100*100 AS BIGINT) AS both FROM v_imu""")
def scan_wav(spark, sf):
    """Stereo recordings of a minute each, decoded to mono; ``both`` is the sum of the two channels."""
    k = F.col("k")
    d = B.imu(spark, sf).select(F.concat_ws("/", "session", F.floor(F.col("t_us") / 60_000_000).cast("string")).alias("path"), "t_us", "event_id",
                                (k * 300 - 15000).alias("left"), (k * 53 % 100 * 100).alias("right"))

    def pack(pdf):
        pdf = pdf.sort_values(["t_us", "event_id"])
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((2, 2, 16000, 0, "NONE", ""))
            w.writeframes(pdf[["left", "right"]].to_numpy("<i2").tobytes())
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [out.getvalue()]})

    clips = SM.decode_wav(d.groupBy("path").applyInPandas(pack, "path string, content binary"), chunk=256)
    s = clips.select(F.col("session").alias("clip"), "fs", "chunk_id", F.posexplode("samples").alias("i", "x"))
    return s.select("clip", "fs", (F.col("chunk_id") * 256 + F.col("i")).alias("pos"), F.round(F.col("x").cast("double") * 65534).cast("bigint").alias("both"))


@query("ndjson_sink", ("v_scores",), "SELECT event_id, container_id, anomaly_score, fault_class FROM v_scores")
def ndjson_sink(spark, sf):
    d = B.scores(spark, sf).select("event_id", "container_id", "anomaly_score", "fault_class")
    out = run_dir(spark, "ndjson")
    SS.ndjson_sink(d, out)
    return spark.read.schema(d.schema).json(out)
