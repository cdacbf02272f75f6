"""Column layouts of topics, records and tables."""

from pyspark.sql import types as T


def _s(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


STR, DBL, INT, BIG, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()
VEC = T.ArrayType(DBL)

ANOMALY = _s(ts=STR, container_id=STR, anomaly_score=DBL, model_version=STR, fault_class=STR, location=STR,
             data_classification=STR, bytes=BIG, traceparent=STR, tracestate=STR)
IMU = _s(t_us=BIG, t_host_us=BIG, acc_g=VEC, gyr_dps=VEC, temp_c=DBL, acc_range_g=INT, gyr_range_dps=INT)
MAG = _s(t_us=BIG, t_host_us=BIG, mag_ut=VEC)
CAMERA = _s(frame_id=BIG, width=INT, height=INT, format=STR, encoding=STR, t_us=BIG, t_host_us=BIG, data=STR)
POSITION = _s(t_us=BIG, t_host_us=BIG, segment=STR, x=DBL, y=DBL)
LABEL = _s(ts=STR, container_id=STR, feature_window_ref=STR, label=STR)
DEPLOY = _s(ts=STR, line=STR, model_version=STR, detail=STR)
CAPTURE = _s(request_id=STR, container_id=STR, label=STR, segment=STR, seq=BIG, features_b64=STR)

SCORES = _s(ts=TS, container_id=STR, model_version=STR, anomaly_score=DBL, fault_class=STR, location=STR)
ALERTS = _s(id=BIG, ts=TS, container_id=STR, anomaly_score=DBL, state=STR, label=STR, labeled_at=TS)
LABELS = _s(ts=TS, container_id=STR, feature_window_ref=STR, label=STR)
CAPTURES = _s(ts=TS, request_id=STR, container_id=STR, label=STR, segment=STR, seq=BIG, features_b64=STR)
MODEL_EVENTS = _s(ts=TS, line=STR, event_type=STR, model_version=STR, detail=STR)

SESSION_IMU = _s(t=DBL, ax=DBL, ay=DBL, az=DBL, gx=DBL, gy=DBL, gz=DBL)
SESSION_MAG = _s(t=DBL, mx=DBL, my=DBL, mz=DBL)
SESSION_LABELS = _s(start=DBL, length=DBL, label=STR, conf=DBL, comment=STR)
CLIP_LABELS = _s(clip=INT, t_start_s=DBL, t_end_s=DBL, fault=INT, type=STR, notes=STR)
MERGED = _s(
    t_host_us=BIG, t_rel_s=DBL, t_dev_us=BIG, acc_x_g=DBL, acc_y_g=DBL, acc_z_g=DBL, gyr_x_dps=DBL, gyr_y_dps=DBL,
    gyr_z_dps=DBL, temp_c=DBL, mag_x_ut=DBL, mag_y_ut=DBL, mag_z_ut=DBL, acc_x_raw=INT, acc_y_raw=INT,
    acc_z_raw=INT, gyr_x_raw=INT, gyr_y_raw=INT, gyr_z_raw=INT, temp_raw=INT, mag_x_raw=INT, mag_y_raw=INT,
    mag_z_raw=INT)
PROFILE = _s(network=STR, total_sram_used=DBL, total_off_chip_flash_used=DBL, cpu_operators=DBL, npu_operators=DBL,
             npu_cycles=DBL, total_cycles=DBL, batch_inference_time=DBL)

# Label sets accepted from operators.
VALID_LABELS = ("bearing wear", "imbalance", "dismiss")
TRACK_FAULTS = ("bearing wear", "imbalance", "turn table", "track bump", "rubber band slippage", "servo motor",
                "dismiss")
ALERT_THRESHOLD = 0.60
