"""Signal helpers, file sources, SQL functions and messages."""

import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from beltline.functions import spectral as S
from beltline.operators import features, lifecycle, messages
from beltline.sources import logs, media, sessions


def gain(sos, f):
    z = np.exp(1j * np.pi * f)
    return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos]))


def test_butterworth():
    for order in (2, 3, 4):
        low, high = S.butter_sos(order, 0.3, "low"), S.butter_sos(order, 0.3, "high")
        np.testing.assert_allclose([gain(low, 1e-9), gain(low, 0.3), gain(high, 0.3), gain(high, 1.0)], [1, 0.5**0.5, 0.5**0.5, 1], rtol=1e-6)
    band = S.butter_sos(2, [0.5, 0.95], "band")
    np.testing.assert_allclose([gain(band, 0.5), gain(band, 0.95)], [0.5**0.5] * 2, rtol=1e-6)
    t = np.arange(600)
    slow, fast = np.sin(0.05 * np.pi * t), np.sin(0.8 * np.pi * t)
    y = S.zero_phase(S.butter_sos(4, 0.2, "low"), (slow + fast)[None, :])[0]
    np.testing.assert_allclose(y[50:-50], slow[50:-50], atol=0.02)


def test_spectrum_helpers():
    t = np.arange(256) / 1600
    x = np.sin(2 * np.pi * 600 * t)[None, :]
    f = S.shape_features(S.power(x), np.fft.rfftfreq(256, 1 / 1600), 1600)
    assert abs(f["centroid"][0] - 600) < 20 and f["band6"][0] + f["band5"][0] > 0.9
    score, pitch = S.tonal(x, 1600, 100)
    assert score[0] > 300 and abs(pitch[0] - 600) < 10
    assert S.spectrogram(x - x.mean(), 50.0).shape == (1, 49, 40)
    assert S.time_features(np.zeros((1, 8)))["kurtosis"][0] == 0
    np.testing.assert_allclose(S.envelope(np.cos(0.5 * np.pi * np.arange(64))[None, :]), 1.0)


def test_session_sources(spark, tmp_path):
    d = tmp_path / "sess1"
    d.mkdir()
    (d / "IMU-Data.data").write_text("# header\n0.0,1,2,3,4,5,6,99\n\n0.02,1,2,3,4,5,6\n")
    (d / "a.label").write_text("start,length,label,conf,comment\n1.0,2.0, fault ,1,\n3.0,1.0,,1,\n")
    imu = sessions.scan_session_imu(spark, str(tmp_path / "*" / "*.data"))
    assert [tuple(r) for r in imu.select("session", "t", "gz").orderBy("t").collect()] == [("sess1", 0.0, 6.0), ("sess1", 0.02, 6.0)]
    lab = sessions.scan_labels(spark, str(tmp_path / "*" / "*.label")).collect()
    assert [(r.label, r.end) for r in lab] == [("fault", 3.0)]
    head = ",".join(f.name for f in sessions.S.MERGED)
    rows = [f"{1000 + i * 10},{5 + i / 100},{(i % 4) * 625}" + ",0" * 20 for i in range(12)]
    (d / "rec.csv").write_text("\n".join([head, *rows, "oops,x,y" + ",0" * 20]))
    rec = sessions.scan_merged_recorder(spark, str(tmp_path / "*" / "rec.csv"))
    assert rec.count() == 12 and rec.agg(F.min("t_wall")).first()[0] == 0
    assert sessions.recorder_rate(rec).first().fs == 1600
    sessions.ndjson_sink(imu, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_wav_and_log_files(spark, tmp_path):
    pcm = (np.array([[1000, 3000], [-32767, -32767]], "<i2")).tobytes()
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(pcm)
    r = media.scan_wav(spark, str(tmp_path)).first()
    np.testing.assert_allclose(r.samples, [2000 / 32767, -1.0], rtol=1e-6)

    def rec(typ, t, body):
        return struct.pack("<BQH", typ, t, len(body)) + body

    imu = struct.pack("<i10h", 7, 32767, 0, -32768, 0, 0, 0, 512, 256, 0, 0)
    data = b"IMULOG01" + struct.pack("<QI", 1000, 115200) + rec(2, 1001, b"cfg,1,8,1,1000") + rec(0x10, 1002, imu) + rec(
        0x10, 1003, imu[:18]) + rec(1, 1004, b'{"cfg":{"acc_range":2}}') + rec(0x10, 1005, imu) + b"\x10\x01"
    (tmp_path / "l.bin").write_bytes(data)
    (tmp_path / "bad.bin").write_bytes(b"nope")
    recs = logs.scan_logs(spark, str(tmp_path / "*.bin"))
    assert recs.count() == 5
    rows = logs.log_to_table(recs).orderBy("ord").collect()
    assert [r.acc_range for r in rows] == [8, 8, 2] and [r.gyr_range for r in rows] == [1000] * 3
    assert rows[0].acc_z_g == -8 and rows[0].temp_c == 24 and rows[0].mag_x_ut == 1 and rows[1].mag_x_ut == 0
    stream = logs.with_ranges(recs, ["file"], ["t_host_us", "ord"], False).orderBy("ord").collect()
    assert stream[-1].gyr_range == 2000
    merged = logs.merge_logs(recs.unionByName(recs.withColumn("file", F.lit("z"))))
    assert merged.count() == 10 and {r.baud for r in merged.collect()} == {115200}


def test_heads_are_unpacked_by_expressions(spark):
    """Against numpy: noise, the greatest and least numbers, short and null values."""
    rng = np.random.default_rng(8)
    values = [rng.bytes(int(n)) for n in rng.integers(0, 40, 300)] + [b"\xff" * 24, b"\x00\x80" * 12, b"\xff\x7f" * 12, b"", None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, b binary").repartition(3)
    for layout in (logs.RECORD_DT, logs.IMU_DT, logs.CAMERA_DT, logs.AUDIO_DT):
        got = rows.select("i", *logs.unpack(layout, F.col("b")).values())
        assert got.columns == ["i", *layout.names] and {f.dataType.simpleString() for f in got.schema.fields[1:]} == {"bigint"}
        size = layout.itemsize
        want = np.frombuffer(b"".join((v or b"")[:size].ljust(size, b"\0") for v in values), layout)
        assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == list(zip(*(want[n].astype(np.int64).tolist() for n in layout.names)))


def test_decoding_logs_takes_one_python_step(spark):
    """Only the packing of the input is Python, and it runs once: no worker for the heads, and none again for the filters on them."""
    from beltline.plans import catalog

    plan = catalog.QUERIES["log_to_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def log_bytes(rng, n, tail=b"", nested=False):
    """A log of ``n`` records of all types; payloads are noise, or look like records themselves."""
    out = [b"IMULOG01" + struct.pack("<QI", 5, 115200)]
    for i in range(n):
        size = int(rng.integers(0, 60))
        body = rng.bytes(size)
        if nested and i % 3 == 0:
            body = b"".join(struct.pack("<BQH", 0x10, 7, 4) + b"fake" for _ in range(60))
        out.append(struct.pack("<BQH", [1, 2, 0x10, 0x20, 0x30, 0x40][i % 6], 1000 + i, len(body)) + body)
    return b"".join(out) + tail


def test_logs_are_read_in_ranges(spark, tmp_path):
    """Small ranges against one walk over each file: noise, payloads that look like records, long records over whole ranges, cut-off tails."""
    rng = np.random.default_rng(4)
    long = struct.pack("<BQH", 0x40, 9, 6_500) + rng.bytes(6_500)
    files = {"noise": log_bytes(rng, 900), "cut": log_bytes(rng, 300, b"\x10" + rng.bytes(9)), "cut2": log_bytes(rng, 300, struct.pack("<BQH", 0x10, 9, 500) + b"short"),
             "nested": log_bytes(rng, 120, nested=True), "long": log_bytes(rng, 50) + long + log_bytes(rng, 50)[20:], "bare": log_bytes(rng, 0), "bad": b"nope" * 2000, "empty": b""}
    for name, data in files.items():
        (tmp_path / f"{name}.log").write_bytes(data)
    got = {}
    for r in logs.scan_logs(spark, str(tmp_path / "*.log"), range_bytes=2_000, batch=50).collect():
        got.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append((r.ord, r.rec_type, r.t_host_us, bytes(r.payload)))
    for name, data in files.items():
        want = [(i, *x) for i, x in enumerate(logs._walk(data))] if data[:8] == logs.MAGIC else []
        assert sorted(got.get(name, [])) == want, name
    ranges = logs.log_ranges(spark, str(tmp_path / "noise.log"), 2_000)
    assert ranges.count() > 10 and ranges.agg(F.sum(F.col("high") - F.col("low"))).first()[0] == len(files["noise"])


def test_many_small_logs_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Files in sub-folders, by patterns as Hadoop takes them: the driver knows folders, not files; each file is found once."""
    rng = np.random.default_rng(5)
    want = {}
    for i in range(100):
        name, data = f"{i % 7}/log {i}+{i % 3}.log", log_bytes(rng, i % 5, b"\x10\xff")
        logs.saved(f"{tmp_path}/{name}", data)
        want[name] = [(k, *x) for k, x in enumerate(logs._walk(data))]
    (tmp_path / "1" / "other.txt").write_bytes(b"no log")
    (tmp_path / "1" / ".x.log.crc").write_bytes(b"checksum")
    (tmp_path / "1" / "folder.log").mkdir()
    made, rows = type(spark).createDataFrame, []
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: rows.append(len(data)) or made(self, data, *a, **b))

    got = {}
    for r in logs.scan_logs(spark, f"{tmp_path}/*/*.log", range_bytes=100).collect():
        got.setdefault(r.file[len(f"file:{tmp_path}/"):], []).append((r.ord, r.rec_type, r.t_host_us, bytes(r.payload)))
    assert {n: sorted(x) for n, x in got.items()} == {n: x for n, x in want.items() if x}
    assert max(rows) <= 7

    def listed(pattern):
        return sorted(r.file[len(f"file:{tmp_path}/"):] for r in logs.log_files(spark, f"{tmp_path}/{pattern}").collect())

    assert listed("{1,2,[12]}/log ?[!1]*.log") == sorted(n for n in want if n[0] in "12" and n[7] != "1")
    assert listed("3/log 3+0.log") == ["3/log 3+0.log"] and listed("nothing/*.log") == []


def test_logs_of_no_device_are_scanned(spark, tmp_path):
    """Events without a user are a device of their own, as in the SQL: its name is null."""
    from beltline.plans import catalog

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.expr("CASE WHEN event_id % 5 > 0 THEN user_id END"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.file: r.n_records for r in catalog.QUERIES["scan_log_ranges"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1] for r in rows.groupBy(F.concat(F.lit("cnc-"), F.col("user_id").cast("string"))).count().collect()} and got[None] > 0


def test_sql_functions(spark):
    from beltline.functions.sql import register

    register(spark)
    r = spark.sql("SELECT cum_to_xy(1240D + 620D).piece p, segment_grid(7D, 12D, 'line1') g, boundary_disposition('raw') b, "
                  "l2_to_centroid(array(3D, 4D), array(0D, 0D)) d").first()
    assert tuple(r) == ("top", "line1.station-C1", "blocked", 5.0)
    assert spark.sql("SELECT * FROM clip_windows(25D, 10D)").count() == 3
    assert [x.win for x in spark.sql("SELECT * FROM window_ids(20, 16, 8)").collect()] == [1, 2]


def test_boundary_and_null_container(spark):
    df = spark.createDataFrame([("raw", "5", 1), ("features", "x", 1), ("inference", "7", 1), ("experimental", None, 1), (None, "1", 0)],
                               "data_classification string, bytes string, has int").withColumn("has", F.col("has") == 1)
    out = messages.boundary_policy(df, "has").collect()
    assert [r.disposition for r in out] == ["blocked", "blocked", "egressed", "blocked", "blocked"]
    assert out[-1].data_classification == "unknown" and [r.bytes for r in out] == [5, 0, 7, 0, 1]
    s = spark.createDataFrame([(1, 10, None, 0.7), (2, 20, None, 0.8), (3, 30, "a", 0.6), (4, 40, "a", 0.9)],
                              "event_id long, ts_us long, container_id string, anomaly_score double")
    none = spark.createDataFrame([], "event_id long, ts_us long, container_id string, label string")
    assert sorted(r.alert_id for r in lifecycle.alert_lifecycle(s, none).collect()) == [1, 2, 3]


def test_message_size_fixpoint(spark):
    base = spark.range(90, 1010).select(messages.json_size_fixpoint(F.col("id")).alias("b"), "id").collect()
    for r in base:
        assert r.b == r.id + len(str(r.b))


def test_roi_motion_compares_with_trusted_predecessor(spark):
    rng = np.random.default_rng(3)
    gray = rng.uniform(0, 255, (6, 64))
    t = [0, 10, 20, 5_000_000, 5_000_010, 5_000_020]  # the fourth frame comes too late to be compared
    df = spark.createDataFrame(pd.DataFrame({"key": "a", "t": t, "gray": gray.tolist()}))
    got = features.roi_dark_motion(df, ["key"], ["t"]).toPandas().sort_values("t")
    pick = [y * 8 + x for y in range(2, 6) for x in range(2, 6)]
    for k, (dark, net) in enumerate(zip(got.dark, got.net)):
        moved = np.abs(gray[k] - gray[k - 1]) if k not in (0, 3) else np.zeros(64)
        assert np.isclose(dark, (gray[k][pick] < 0.6 * np.median(gray[k])).mean())
        assert np.isclose(net, max(0.0, moved[pick].mean() - np.median(moved)))


def test_clip_spectrum_of_short_and_exact_clips(spark):
    rng = np.random.default_rng(4)
    clips = [rng.normal(size=n).tolist() for n in (8, 16, 17, 40)]
    df = spark.createDataFrame(pd.DataFrame({"id": range(4), "sig": clips}))
    got = features.clip_acoustic_features(df, 64.0, [0, 16, 40, 80], 12.0, 500.0, nfft=16).toPandas().sort_values("id")
    assert (got.band_0_16[:2] == 0).all() and (got.band_0_16[2:] > 0).all()
    assert (got.hf_ratio == 0).all() and (got.band_40_80 == 0).all()
    x = np.array(clips[3]) - np.mean(clips[3])
    p = np.mean([np.abs(np.fft.rfft(x[s:s + 16] * np.hanning(16))) ** 2 for s in (0, 8, 16)], axis=0)
    assert np.isclose(got.band_16_40[3], p[4:].sum()) and np.isclose(got.tonal[3], p[3:].max() / np.median(p[3:]))
    none = features.clip_acoustic_features(df, 64.0, [0, 16], 500.0, 12.0, nfft=16)
    assert none.where("tonal IS NOT NULL").isEmpty()


def test_spectrogram_of_mixed_lengths_in_flat_buffers(spark):
    from beltline.functions import spectral as S
    from beltline.operators import features

    rng = np.random.default_rng(2)
    sigs = [rng.normal(size=n) for n in (64, 100, 64, 80, 100, 64)] * 200
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sigs)], "id bigint, sig array<double>")
    out = features.spectrogram(df, 50.0)
    assert '"evalType":200' not in out._jdf.queryExecution().optimizedPlan().toJSON()  # no pandas series of lists
    got = {r.id: np.array(r.spectrogram, np.float32) for r in out.collect()}
    for i in (0, 1, 3, 600, 1197, 1199):
        x = sigs[i][None, :]
        np.testing.assert_allclose(got[i], S.spectrogram(x - x.mean(), 50.0)[0], rtol=1e-5, atol=1e-5)


def test_many_small_logs_are_few_tasks(spark, tmp_path):
    from beltline.sources import logs

    for i in range(150):
        (tmp_path / f"{i}.log").write_bytes(b"x" * (i + 1))
    ranges = logs.log_ranges(spark, f"{tmp_path}/*.log", 64)
    assert ranges.rdd.getNumPartitions() <= 4 * max(8, spark.sparkContext.defaultParallelism)
    assert sum(r.high - r.low for r in ranges.collect()) == 150 * 151 // 2


def test_highband_filters_samples_once(spark):
    from beltline.operators import features

    df = spark.createDataFrame([("a", i + 1, float(i % 9)) for i in range(300)], "k string, rn bigint, gz double")
    clips = spark.createDataFrame([("a", 0, 1, 101), ("a", 1, 101, 201)], "k string, clip bigint, i0 bigint, i1 bigint")
    out = features.highband_indicators(df, clips, ["k"], "rn", "gz", 100.0, 25.0)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 2
