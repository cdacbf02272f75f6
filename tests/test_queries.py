"""Registered queries against their cross-check SQL on the smallest data folder, and stream against batch."""

import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
import check  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
CORE = """track_rollup_alerting alert_lifecycle asof_last_position nearest_frame window_label_overlap event_interval_match run_gate_wheels
turntable_anchors cum_distance_legpin mag_gap_recovery directed_score roc_operating_points acl_audit capture_watch_match scale_imu
stateful_alerts scan_merged_recorder scan_wav track_csv_sinks cum_distance_offline""".split()
NAMES = sorted(E.oracle_sql()) if os.environ.get("BELTLINE_ALL") else CORE


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    want = check.rows_of([d[0] for d in cur.description], cur.fetchall())
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_stream_stage_equals_batch(spark):
    from pyspark.sql import functions as F

    from beltline.operators import sequences, staging
    from beltline.plans import bindings

    e = bindings.events(spark, SF).select(F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("session"), "event_id", "ts_us",
                                          F.least(F.col("value") / 100, F.lit(1.0)).alias("v"))
    w = sequences.numbered(e, ["session"], "ts_us", ["event_id"], chunk_us=86_400_000_000)
    batch = staging.stage_machine(w, ["session"], "ts_us", "event_id", "rn", "v", v_thr=0.45, dwell=3, release=4, chunk_us=86_400_000_000)
    live = E.queries()["stateful_stage"](spark, SF)
    cols = ["session", "event_id", "stage", "trend"]
    assert sorted(map(tuple, batch.select(*cols).collect())) == sorted(map(tuple, live.select(*cols).collect()))


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())
