"""Live operators: slices of any size, golden localizer scenarios, late rows over several files, eviction of idle keys."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from beltline.kernels import maps
from beltline.operators import motion
from beltline.streaming import ordered, processors as SP, runs
from beltline.streaming.localizer import CAMERA, IMU, MAG, Localizer, placed, trailing_std

SF = "/root/testdata/sf0.001"
SLICES = (1, 2, 50)


def fed(processor, rows, n):
    """Outputs and state after ``rows`` in ``n`` slices."""
    rows = rows.sort_values(["ts_us", *processor.ties], kind="stable", ignore_index=True)
    state, out = processor.start(), []
    for part in np.array_split(np.arange(len(rows)), n):
        if len(part):
            got = processor.advance(state, rows.iloc[part].reset_index(drop=True))
            out += [] if got is None or got.empty else [got]
    names = [c.split()[0] for c in processor.out_schema.split(", ")][len(processor.key_names):]
    return (pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names))[names], state


def test_maps_equal_steps():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 7, 64, 1000):
        table = rng.integers(0, 5, (7, 5))
        symbols, state, want = rng.integers(0, 7, n), 3, []
        for x in symbols:
            state = table[x, state]
            want.append(state)
        assert maps.states(table[symbols], 3).tolist() == want and maps.whole(table[symbols])[3] == state


# ---- localizer

def series(kind, t, **columns):
    rows = pd.DataFrame({"ts_us": np.round(np.asarray(t) * 1e6).astype(np.int64), "kind": kind, **columns})
    for c in ("ax", "ay", "gz", "mx", "my", "dark", "net"):
        if c not in rows:
            rows[c] = np.nan
    return rows.assign(event_id=np.arange(len(rows)))


def turn(rate=90.0):
    i = np.arange(35)
    return series(IMU, i * 0.1, ax=0.0, ay=0.0, gz=np.where((i >= 10) & (i < 20), rate, 0.0))


def wheel(*times, net=1.0):
    return pd.concat([series(CAMERA, [t, t + 0.1], dark=[0.6, 0.1], net=[net, 0.0]) for t in times])


@pytest.mark.parametrize("n", SLICES)
def test_a_quarter_turn_is_one_corner(n):
    out, state = fed(Localizer(), turn(), n)
    assert out.cause.tolist() == ["anchor"] and out.t_host_us.tolist() == [2_000_000] and state["corners"] == 1
    jitter = series(IMU, np.arange(60) * 0.1, ax=0.0, ay=0.0, gz=20.0 * (-1) ** np.arange(60))
    assert fed(Localizer(), jitter, n)[0].empty


@pytest.mark.parametrize("n", SLICES)
def test_still_and_shaking(n):
    t = np.arange(60) * 0.05
    assert fed(Localizer(), series(IMU, t, ax=0.0, ay=0.0, gz=0.0), n)[1]["stopped"]
    shaking = series(IMU, t, ax=0.2 * (-1) ** np.arange(60), ay=0.0, gz=0.0)
    assert not fed(Localizer(), shaking, n)[1]["stopped"]
    after = series(IMU, 3 + t, ax=0.2 * (-1) ** np.arange(60), ay=0.0, gz=0.0)
    assert not fed(Localizer(), pd.concat([series(IMU, t, ax=0.0, ay=0.0, gz=0.0), after]), n)[1]["stopped"]


@pytest.mark.parametrize("n", SLICES)
def test_wheels_count_unless_idle(n):
    out, _ = fed(Localizer(), wheel(0, 1), n)
    assert out.wheels.tolist() == [1, 2] and out.t_us.tolist() == [0, 1_000_000]
    assert fed(Localizer(), wheel(0, net=0.0), n)[0].empty  # a shadow that does not move
    still = series(IMU, 2 + np.arange(60) * 0.05, ax=0.0, ay=0.0, gz=0.0)
    out, _ = fed(Localizer(), pd.concat([wheel(0, 1), still, wheel(6)]), n)
    assert out.wheels.tolist() == [1, 2, 2] and out.stopped.tolist() == [False, False, True]


def test_distance_is_pinned_to_legs(spark):
    rows = [(2, 0, 0), (2, 1, 2), (42, 1, 2), (42, 2, 42)]
    events = spark.createDataFrame([("l", "c", 0, "wheel", *r, False, i) for i, r in enumerate(rows)],
                                   "line string, container_id string, t_us long, cause string, wheels long, corners long, wheels_at_corner long, stopped boolean, t_host_us long")
    assert [r.cum_cm for r in placed(events, "BL").orderBy("t_host_us").collect()] == [30, 160, 620, 620]
    assert [r.cum_cm for r in placed(events, None).orderBy("t_host_us").collect()] == [30, 30, 630, 630]


@pytest.mark.parametrize("n", SLICES)
def test_a_corner_hidden_by_a_gap(n):
    angle = np.r_[np.linspace(0, 2 * np.pi, 100), np.zeros(50), np.full(60, np.pi / 2)]
    t = np.r_[np.arange(100) * 0.05, 5 + np.arange(50) * 0.1, 12 + np.arange(60) * 0.1]
    mags = series(MAG, t + 0.001, mx=40 * np.cos(angle) + 7, my=40 * np.sin(angle) - 3)
    beats = np.r_[np.arange(100) * 0.1, 12 + np.arange(60) * 0.1]
    out, state = fed(Localizer(), pd.concat([series(IMU, beats, ax=0.0, ay=0.0, gz=0.0), mags]), n)
    assert out.cause.tolist() == ["mag"] and out.corners.tolist() == [1] and state["gaps"] == []
    near = series(IMU, np.r_[np.arange(80) * 0.1, 12 + np.arange(60) * 0.1], ax=0.0, ay=0.0, gz=np.where(np.arange(140) // 10 == 7, 90.0, 0.0))
    assert fed(Localizer(), pd.concat([near, mags]), n)[0].cause.tolist() == ["anchor"]  # the gyro has seen that corner


def recording(seed, n=1500):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([0.01, 0.05, 1.0, 3.0], n, p=[0.6, 0.36, 0.02, 0.02]))
    walk = lambda s: np.cumsum(rng.normal(0, s, n))
    return pd.DataFrame({"ts_us": (t * 1e6).astype(np.int64), "kind": rng.choice([IMU, MAG, CAMERA], n, p=[0.6, 0.2, 0.2]), "event_id": np.arange(n),
                         "ax": rng.normal(0, 0.1, n) * (np.arange(n) // 100 % 2), "ay": 0.0, "gz": walk(9) % 160 - 80, "mx": 30 * np.cos(walk(0.3)),
                         "my": 30 * np.sin(walk(0.3)), "dark": rng.random(n), "net": rng.random(n)})


def test_slices_do_not_matter():
    for seed in range(6):
        rows = recording(seed)
        one, _ = fed(Localizer(), rows, 1)
        assert {"wheel", "anchor"} <= set(one.cause) and one.stopped.any()
        for n in (2, 7, 50, 300):
            pd.testing.assert_frame_equal(fed(Localizer(), rows, n)[0], one, check_dtype=False)


def test_arrays_equal_batch_operators(spark):
    rows = recording(3)
    imu = rows[rows.kind == IMU].assign(key="k", t_us=lambda r: r.ts_us)
    df = spark.createDataFrame(imu)
    e = motion.vibration_energy(df, ["key"], "t_us", 400_000)
    want = motion.dwell_state(e, ["key"]).toPandas().sort_values(["t_us", "event_id"])
    loc = Localizer()
    got = loc.standing(loc.start(), imu.ts_us.to_numpy(), imu[["ax", "ay"]].to_numpy())
    assert got.tolist() == want.stopped.tolist() and got.any()
    turns = motion.turntable_anchors(df, ["key"], max_gap_us=2_000_000, streaming=True).toPandas()
    out, _ = fed(Localizer(), imu, 3)
    assert sorted(turns.end_us) == sorted(out.t_us) and len(out) > 3


def test_trailing_deviation():
    rng = np.random.default_rng(1)
    t, v = np.sort(rng.integers(0, 200, 80)), rng.normal(5, 1, (80, 2))
    n, s = trailing_std(t, v, 30)
    for i in range(80):
        part = v[: i + 1][t[: i + 1] >= t[i] - 30]
        assert n[i] == len(part)
        np.testing.assert_allclose(s[i], part.std(0), atol=1e-9)


# ---- the other processors: slices, and rows one by one

def random_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"ts_us": np.cumsum(rng.integers(1, 5_000_000, n)), "kind": rng.integers(0, 2, n), "event_id": np.arange(n), "x": rng.random(n), "y": rng.random(n),
                         "anomaly_score": rng.random(n), "label": rng.choice(["dismiss", "wear"], n), "acc_range": rng.integers(2, 17, n), "raw": rng.integers(-9, 9, n) * 100,
                         "v": rng.random(n), "old_score": 0.0, "new_score": rng.random(n) / 12, "segment": rng.choice(list("abcdefgh"), n), "stop": rng.random(n) < 0.06})


@pytest.mark.parametrize("processor", [SP.LastFix(), SP.Alerts(), SP.Ranges(), SP.Stages(0.45, dwell=3, release=4, trend_window=9), SP.Shadow(), SP.Capture(3)], ids=lambda p: type(p).__name__)
def test_processors_take_any_slices(processor):
    for seed in range(3):
        rows = random_rows(seed)
        one, last = fed(processor, rows, 1)
        order = list(one.columns)
        assert len(one) > 20
        for n in (2, 50, 300):
            got, state = fed(processor, rows, n)
            pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), one.sort_values(order, ignore_index=True), check_dtype=False)
            assert state.keys() == last.keys()


def test_capture_rule():
    rows = random_rows(5, 500)
    watch, want = {}, []
    for r in rows.itertuples():
        if r.kind == 1:
            want += [(r.event_id, *watch[r.segment])] if r.segment in watch else []
        elif r.stop:
            watch = {}
        elif r.segment in watch or len(watch) < 3:
            watch[r.segment] = (r.label, r.event_id)
    got, state = fed(SP.Capture(3), rows, 4)
    assert list(got[["event_id", "label", "command_id"]].itertuples(index=False, name=None)) == want
    assert {k: tuple(v) for k, v in state["watch"].items()} == watch


def test_idle_keys_leave_once():
    rows = pd.DataFrame({"ts_us": [0, 10, 500, 505, 2000], "event_id": range(5)})
    out = ordered.replayed(rows, SP.Activity(100), ("k",))
    assert out.values.tolist() == [["k", 0, 10, 110, 2], ["k", 500, 505, 605, 2], ["k", 2000, 2000, 2100, 1]]


# ---- streams over several files

@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """The events in five files; rows up to 25 minutes before a border come with the next file."""
    folder = tmp_path_factory.mktemp("late")
    e = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts")
    borders = [e.ts.iloc[len(e) * i // 5] for i in range(1, 5)]
    part = np.searchsorted(np.array(borders, "datetime64[ns]"), e.ts.to_numpy())
    moved = np.zeros(len(e), bool)
    for i, b in enumerate(borders):
        slow = (part == i) & (e.ts > b - pd.Timedelta("25min")).to_numpy() & (np.arange(len(e)) % 2 == 0)
        part[slow], moved[slow] = i + 1, True
    os.mkdir(folder / "events.parquet")
    for i in range(5):
        piece = e[part == i].sample(frac=1, random_state=i)
        spark.createDataFrame(piece).coalesce(1).write.parquet(str(folder / f"one{i}"))
        source = next(x for x in os.listdir(folder / f"one{i}") if x.startswith("part-"))
        os.link(folder / f"one{i}" / source, folder / "events.parquet" / f"part-{i}.parquet")
        os.utime(folder / "events.parquet" / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    assert moved.sum() >= 3
    return str(folder)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["stateful_asof", "stateful_alerts", "stateful_capture", "stateful_stage", "stateful_shadow", "stateful_splitter", "state_ttl"])
def test_late_rows_over_files_equal_one_file(spark, late, name, monkeypatch):
    from beltline.plans import catalog

    seen = []
    whole = runs.drain_ordered
    monkeypatch.setattr(runs, "drain_ordered", lambda *a, **k: whole(*a, **k, progress=seen))
    spark.conf.set("spark.beltline.filesPerBatch", "1")
    try:
        got = catalog.QUERIES[name](spark, late).toPandas()
    finally:
        spark.conf.unset("spark.beltline.filesPerBatch")
    batches = [p for p in seen if p.numInputRows > 0]
    assert len(batches) == 6  # five files and the mark
    assert all(s.numRowsDroppedByWatermark == 0 for p in seen for s in p.stateOperators)
    if name == "state_ttl":
        held = [p.stateOperators[0].numRowsTotal for p in seen]
        assert held[-1] == 0 and max(held) <= 3 * 15  # per key: what waits, its memory and its timers at most
    want = catalog.QUERIES[name](spark, SF).toPandas()
    order = sorted(want.columns)
    pd.testing.assert_frame_equal(got[order].sort_values(order, ignore_index=True), want[order].sort_values(order, ignore_index=True), check_dtype=False)




# ---- many keys in one call, and more rows than one table

def keyed_rows(seed, n=2000, keys=40):
    rows = random_rows(seed, n)
    who = np.random.default_rng(seed).integers(0, keys, n)
    return rows.assign(line=[None if i % 7 == 0 else f"l{i % 4}" for i in who], container_id=[f"c{i}" for i in who])


@pytest.mark.parametrize("make", [SP.LastFix, lambda: SP.LastFix().forgetting(60_000_000), SP.Alerts, lambda: SP.Activity(60_000_000), SP.Ranges, lambda: SP.Shadow().forgetting(90_000_000)],
                         ids=["fix", "fix_ttl", "alerts", "activity", "ranges", "shadow_ttl"])
def test_many_keys_are_one_call_and_equal_single_ones(make, monkeypatch):
    processor, rows = make(), keyed_rows(4)
    one = [ordered.replayed(part, processor, k) for k, part in rows.groupby(list(processor.key_names), dropna=False)]
    want = pd.concat([x for x in one if len(x)], ignore_index=True)
    calls, stays = [], type(processor).stays
    monkeypatch.setattr(type(processor), "stays", lambda self, *a: calls.append(1) or stays(self, *a))
    memory, got = {}, []
    for part in np.array_split(rows, 5):
        got += processor.processed(memory, part.sample(frac=1, random_state=1), lambda k: None)
    got += processor.evicted(memory, ordered.END_US)
    got, order = pd.concat(got, ignore_index=True), list(want.columns)
    assert len(calls) == 5 and len(got) > 20
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True).fillna(-1), want.sort_values(order, ignore_index=True).fillna(-1), check_dtype=False)


class Kept(dict):
    updateValue, getValue, removeKey = dict.__setitem__, dict.get, dict.__delitem__


def test_waiting_rows_come_in_order_and_in_bounded_tables():
    rows = random_rows(1, 30_000).sample(frac=1, random_state=2)
    p = Localizer()
    p._waiting, p.slice_rows = Kept(), 1000
    pieces = [p.put_away(part) for part in np.array_split(rows, 40)]
    until, later = int(rows.ts_us.quantile(0.9)), []
    out = list(p.in_order(pieces, until, later))
    assert len(out) > 10 and max(map(len, out)) <= 1000
    assert all(a.ts_us.max() < b.ts_us.min() for a, b in zip(out, out[1:]))
    due = rows[rows.ts_us <= until]
    assert sorted(pd.concat(out).event_id) == sorted(due.event_id)
    rest = pd.concat([ordered.unpacked(v[0]) for v in p._waiting.values()])
    assert sorted(rest.event_id) == sorted(rows[rows.ts_us > until].event_id) and min(later) == rest.ts_us.min()


def test_rows_after_a_release_of_one_instant_are_not_gathered():
    """The watermark stands on the first instant that waits, in every piece; the rows after it stay in pieces."""
    rows = random_rows(3, 30_000)
    rows.loc[rows.index % 60 == 0, "ts_us"] = until = 0
    p = Localizer()
    p._waiting, p.slice_rows = Kept(), 1000
    pieces, later = [p.put_away(part) for part in np.array_split(rows.sample(frac=1, random_state=2), 40)], []
    assert {name[0] for name in pieces} == {until}
    out = list(p.in_order(pieces, until, later))
    assert sorted(pd.concat(out).event_id) == list(range(0, 30_000, 60))
    rest = [ordered.unpacked(v[0]) for v in p._waiting.values()]
    assert max(map(len, rest)) < ordered.PIECE + 750 and sum(map(len, rest)) == 29_500 and min(later) == min(part.ts_us.min() for part in rest)
