"""Record logs: the events are packed into binary records by Spark, then read back by the log operators."""

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import run_dir
from ..sources import logs as L
from . import bindings as B
from .registry import query


@F.pandas_udf(T.BinaryType())
def _pack(event_id: pd.Series, ts_us: pd.Series, kind: pd.Series, k: pd.Series, props: pd.Series) -> pd.Series:
    """One framed record per event, by event type (test input for the decoders)."""
    out = []
    for e, t, typ, n, text in zip(event_id, ts_us, kind, k, props):
        imu = struct.pack("<i7h", n * 1000, *[(n - 50) * m for m in (300, 200, 100, 50, 20, 10)], n * 5)
        if typ in ("click", "view"):
            tag, body = 0x10, imu + (struct.pack("<3h", *[(n - 50) * m for m in (7, 8, 9)]) if typ == "click" else b"")
        elif typ == "purchase":
            tag, body = 0x30, struct.pack("<IHH", e, 320, 240) + (text.encode() if n > 20 else b"")
        elif typ == "error":
            tag, body = 0x40, struct.pack("<IHBB", e, 16000, 1, 16) + text.encode()
        else:
            tag, body = 0x02, f"CFG,100,{n % 8 + 1},200,2000".encode()
        out.append(struct.pack("<BQH", tag, t, len(body)) + body)
    return pd.Series(out)


#: So that filters on a record's header are not pushed below the packing, which would then run once for them and once more for the record.
_pack = _pack.asNondeterministic()


def framed(spark, sf):
    """Framed records: IMU (some legacy), camera, audio and CFG command by event type."""
    e = B._container(B.events(spark, sf))
    return e.select("event_id", "ts_us", "container_id", "k", _pack("event_id", "ts_us", "event_type", "k", "props").alias("data"))


def records(spark, sf):
    r = L.parse_records(framed(spark, sf), keep=("event_id", "container_id"))
    return r.select(F.col("container_id").alias("file"), F.col("event_id").alias("ord"), F.lit(B.ORIGIN_US).alias("t_start_us"),
                    F.lit(115200).cast("bigint").alias("baud"), "rec_type", "t_host_us", "payload")


_RNG = """rg AS (SELECT s.event_id, coalesce(c.r,4) AS r FROM ev s ASOF LEFT JOIN (SELECT container_id, ts_us, k%8+1 AS r FROM ev WHERE event_type='signup') c ON s.container_id=c.container_id AND s.ts_us>=c.ts_us)"""


@query("decode_log_records", ("ev",), """SELECT event_id AS ord, ts_us AS t_host_us, CASE WHEN event_type IN ('click','view') THEN 16 WHEN event_type='purchase' THEN 48 WHEN event_type='error' THEN 64 ELSE 2 END AS rec_type FROM ev""")
def decode_log_records(spark, sf):
    return records(spark, sf).select("ord", "t_host_us", "rec_type")


@query("explode_log_files", ("ev",), "SELECT container_id AS file, count(*) AS n_records, CAST(sum(event_id) AS BIGINT) AS id_sum FROM ev GROUP BY 1")
def explode_log_files(spark, sf):
    """Whole files: every event is packed as a file of its own with a header, exploded, and counted per device."""
    f = framed(spark, sf)
    head = F.lit((b"IMULOG01" + struct.pack("<QI", B.ORIGIN_US, 115200)).hex())
    files = f.select(F.concat_ws("|", "container_id", F.col("event_id").cast("string")).alias("path"),
                     F.concat(F.unhex(head), F.col("data"), F.unhex(F.lit("10FF"))).alias("content"))
    r = L.explode_logs(files)
    return r.groupBy(F.split("file", r"\|")[0].alias("file")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.split("file", r"\|")[1].cast("bigint")).alias("id_sum"))


@query("scan_log_ranges", ("ev",), """SELECT container_id AS file, count(*) AS n_records, CAST(sum(ord) AS BIGINT) AS ord_sum, CAST(sum(n) AS BIGINT) AS payload_bytes,
 CAST(max(ts_us) AS BIGINT) AS last_us FROM (SELECT *, row_number() OVER (PARTITION BY container_id, ts_us//86400000000 ORDER BY ts_us, event_id)-1 AS ord,
 CASE WHEN event_type='click' THEN 24 WHEN event_type='view' THEN 18 WHEN event_type='purchase' THEN 8+CASE WHEN k>20 THEN length(props) ELSE 0 END
  WHEN event_type='error' THEN 8+length(props) ELSE 18 END AS n FROM ev) GROUP BY 1""")
def scan_log_ranges(spark, sf):
    """Log files of a device and day, with cut-off tails, written by Spark to the shared folder and read back in small byte ranges.

    They lie in sub-folders, one for each writing task, so that tasks do not wait for each other's entries, nor one task lists all.
    """
    folder = run_dir(spark, "logs")
    head = b"IMULOG01" + struct.pack("<QI", B.ORIGIN_US, 115200)
    day = F.expr("ts_us div 86400000000")
    # dealt as the files are, to more tasks than their bytes would need
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = framed(spark, sf).withColumn("day", day).repartition(n, "container_id", "day")
    name = F.concat(F.coalesce("container_id", F.lit("")), F.lit("+"), F.col("day").cast("string"))
    files = rows.groupBy("container_id", "day").agg(F.sort_array(F.collect_list(F.struct("ts_us", "event_id", "data"))).alias("r")) \
        .select(F.concat_ws("/", F.pmod(F.hash("container_id", "day"), F.lit(n)).cast("string"), name).alias("name"), F.col("r.data").alias("records"))

    def write(parts):
        for part in parts:
            for name, records_ in zip(part.column("name").to_pylist(), part.column("records").to_pylist()):
                L.saved(f"{folder}/{name}.log", head + b"".join(records_) + b"\x10\xff")
            yield part.select(["name"])

    files.mapInArrow(write, "name string").write.parquet(f"{folder}/names")
    r = L.scan_logs(spark, f"{folder}/*/*.log", range_bytes=1024)
    device = F.nullif(F.substring_index(F.substring_index("file", "/", -1), "+", 1), F.lit(""))
    return r.groupBy(device.alias("file")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("ord").alias("ord_sum"),
                                               F.sum(F.octet_length("payload")).cast("bigint").alias("payload_bytes"), F.max("t_host_us").alias("last_us"))


@query("scale_imu", ("ev",), f"""WITH {_RNG} SELECT event_id AS ord, round((k-50)*300/32768*r,9) AS acc_x_g, round((k-50)*50/32768*2000,9) AS gyr_x_dps, round(23+k*5/512,9) AS temp_c,
 CASE WHEN event_type='click' THEN round((k-50)*7/256,9) ELSE 0 END AS mag_x_ut, round((ts_us-1704067200000000)/1e6,6) AS t_rel_s FROM ev JOIN rg USING (event_id) WHERE event_type IN ('click','view')""")
def scale_imu(spark, sf):
    t = L.log_to_table(records(spark, sf))
    return t.select("ord", *[F.round(c, 9).alias(c) for c in ("acc_x_g", "gyr_x_dps", "temp_c", "mag_x_ut")], F.round("t_rel_s", 6).alias("t_rel_s"))


@query("log_to_table", ("ev",), """SELECT container_id AS file, count(*) AS samples, CAST(sum((k-50)*300) AS BIGINT) AS ax_sum, CAST(sum(k*1000) AS BIGINT) AS dev_sum FROM ev WHERE event_type IN ('click','view') GROUP BY 1""")
def log_to_table(spark, sf):
    t = L.log_to_table(records(spark, sf))
    return t.groupBy("file").agg(F.count(F.lit(1)).alias("samples"), F.sum("ax_raw").alias("ax_sum"), F.sum("t_us").alias("dev_sum"))


@query("log_info", ("ev",), """SELECT container_id AS file, CASE WHEN event_type IN ('click','view') THEN 16 WHEN event_type='purchase' THEN 48 WHEN event_type='error' THEN 64 ELSE 2 END AS rec_type,
 count(*) AS n, round((max(ts_us)-min(ts_us))/1e6,6) AS duration_s FROM ev GROUP BY 1,2""")
def log_info(spark, sf):
    return L.log_info(records(spark, sf)).select("file", "rec_type", "n", F.round("duration_s", 6).alias("duration_s"))


@query("merge_logs", ("ev",), "SELECT ts_us AS t_host_us, container_id AS file, event_id AS ord, 1704067200000000 AS t_start_us, 115200 AS baud FROM ev ORDER BY ts_us")
def merge_logs(spark, sf):
    return L.merge_logs(records(spark, sf)).select("t_host_us", "file", "ord", "t_start_us", "baud")


@query("audio_chunk_stitch", ("ev",), """SELECT container_id AS file, event_id//100 AS piece, count(*) AS n_chunks, CAST(sum(gap) AS BIGINT) AS gaps, CAST(sum(length(props)) AS BIGINT) AS n_bytes FROM (
 SELECT *, CAST(coalesce(event_id<>lag(event_id) OVER (PARTITION BY container_id ORDER BY event_id)+1,false) AS INT) AS gap FROM ev WHERE event_type='error') GROUP BY 1,2""")
def audio_chunk_stitch(spark, sf):
    s = L.audio_chunk_stitch(L.audio_chunks(records(spark, sf)), 100)
    return s.select("file", "piece", "n_chunks", "gaps", F.octet_length("pcm").cast("bigint").alias("n_bytes"))


@query("camera_header", ("ev",), """SELECT event_id AS frame_id, 320 AS width, 240 AS height, base64(encode(props)) AS data FROM ev WHERE event_type='purchase' AND k>20""")
def camera_header(spark, sf):
    return L.camera_rows(records(spark, sf)).select("frame_id", "width", "height", "data")


@query("route_by_type", ("ev",), """SELECT 'imu' AS kind, count(*) AS n FROM ev WHERE event_type IN ('click','view') UNION ALL SELECT 'mag', count(*) FROM ev WHERE event_type='click'
 UNION ALL SELECT 'camera', count(*) FROM ev WHERE event_type='purchase' AND k>20""")
def route_by_type(spark, sf):
    parts = [df.select(F.lit(k).alias("kind")) for k, df in L.route_by_type(records(spark, sf)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
