"""The chunked kernels against plain pandas on fixtures with a hot key and tiny chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from beltline.kernels.ordered import (BackFill, Fill, Lag, Lead, RowNo, RunMax, RunSum, Seq,
                                      cumulative_by_value, frame_moments, islands, ordered, range_frame, row_frame)
from beltline.kernels.quantiles import exact_percentiles
from beltline.kernels.ranges import overlapping, points_in_intervals


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({
        "key": rng.choice(["hot", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        "t": rng.integers(0, 3000, n),
        "id": np.arange(n),
        "x": rng.integers(0, 50, n).astype(float),
    })
    pdf["maybe"] = np.where(rng.random(n) < 0.2, pdf.x, np.nan)
    return pdf.sort_values(["key", "t", "id"]).reset_index(drop=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    from pyspark.sql import functions as F
    return df.withColumn("maybe", F.when(~F.isnan("maybe"), F.col("maybe"))) if "maybe" in pdf else df


SEQ = Seq.by_time(["key"], "t", ["id"], chunk_us=70)


def test_ordered_specs(spark, frame):
    got = ordered(to_spark(spark, frame), SEQ, Lag("lag", "x"), Lead("lead", "x"), Fill("fill", "maybe"),
                  BackFill("back", "maybe"), RunSum("run", "x"), RunMax("top", "x"), RowNo("rn"))
    got = got.toPandas().sort_values(["key", "t", "id"]).reset_index(drop=True)
    g = frame.groupby("key")
    want = pd.DataFrame({
        "lag": g.x.shift(), "lead": g.x.shift(-1), "fill": g.maybe.ffill(), "back": g.maybe.bfill(),
        "run": g.x.cumsum(), "top": g.x.cummax(), "rn": g.cumcount() + 1.0})
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c], err_msg=c)


def test_islands(spark, frame):
    got = islands(to_spark(spark, frame), SEQ, ["t"], "cur.t - prev.t > 15", "run", first="opening")
    got = got.toPandas().sort_values(["key", "t", "id"]).reset_index(drop=True)
    want = frame.groupby("key").t.transform(lambda s: (s.diff().fillna(99) > 15).cumsum())
    assert (got.run == want).all()
    starts = got.assign(run=want).groupby(["key", "run"]).t.transform("min")
    assert (got.opening.map(lambda r: r["t"]) == starts).all()


def test_row_and_range_frames(spark, frame):
    from pyspark.sql import functions as F

    base = ordered(to_spark(spark, frame), SEQ, RowNo("rn"))
    got = row_frame(base, ["key"], "rn", 9, 2, {"m": F.avg("x")}, block=1).toPandas()
    got = got.sort_values(["key", "t", "id"]).reset_index(drop=True)
    for key, part in frame.groupby("key"):
        x = part.x.to_numpy()
        want = [x[max(0, i - 9):i + 3].mean() for i in range(len(x))]
        np.testing.assert_allclose(got.m[got.key == key], want)
    got = range_frame(to_spark(spark, frame), ["key"], "t", 40, 10, {"n": F.count("x")}, block=60).toPandas()
    for r in got.sample(60, random_state=2).itertuples():
        other = frame[frame.key == r.key].t
        assert r.n == ((other >= r.t - 40) & (other <= r.t + 10)).sum()


def test_exact_percentiles_bracketed(spark, frame):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"key": np.where(rng.random(30_000) < 0.6, "hot", "b"),
                        "x": np.round(rng.lognormal(0, 2, 30_000), 3)})
    got = exact_percentiles(spark.createDataFrame(pdf), ["key"], "x",
                            {"lo": 0.0, "med": 0.5, "p99": 0.99, "hi": 1.0}).toPandas().set_index("key")
    for key, part in pdf.groupby("key"):
        want = np.percentile(part.x, [0, 50, 99, 100])
        np.testing.assert_allclose(got.loc[key, ["lo", "med", "p99", "hi"]].astype(float), want)
    got = exact_percentiles(spark.createDataFrame(pdf), [], "x", {"med": 0.5}).toPandas()
    np.testing.assert_allclose(got.med[0], np.median(pdf.x))


def test_exact_percentiles_of_groups_of_every_size(spark):
    """Ranks next to a bracket count as well, as the brackets of small groups hold one value."""
    rng = np.random.default_rng(6)
    pdf = pd.concat([pd.DataFrame({"key": n, "x": np.round(rng.normal(0, 3, n), 1)}) for n in (*range(1, 40), 500, 2501, 6000)])
    probs = {"p0": 0.0, "p1": 0.001, "p10": 0.1, "q1": 0.25, "third": 1 / 3, "med": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = exact_percentiles(spark.createDataFrame(pdf), ["key"], "x", probs).toPandas().set_index("key")
    assert len(got) == 42
    for key, part in pdf.groupby("key"):
        np.testing.assert_allclose(got.loc[key, list(probs)].astype(float), np.quantile(part.x, list(probs.values())), atol=1e-12)


def test_exact_percentiles_of_one_value_of_a_long_tail_and_of_nothing(spark):
    rng = np.random.default_rng(7)
    tail = np.concatenate([rng.pareto(0.5, 60_000), np.full(40_000, 2.0), [1e300, -1e300]])
    df = spark.createDataFrame(pd.DataFrame({"x": tail}))
    got = exact_percentiles(df, [], "x", {"a": 0.3, "b": 0.9995, "c": 1.0}).first()
    np.testing.assert_allclose([got.a, got.b, got.c], np.quantile(tail, [0.3, 0.9995, 1.0]))
    assert exact_percentiles(df.select(F.lit(3.0).alias("x")), [], "x", {"a": 0.9}).first().a == 3.0
    none = df.filter("x IS NULL")
    assert exact_percentiles(none.withColumn("k", F.lit(1)), ["k"], "x", {"a": 0.5}).count() == 0
    assert exact_percentiles(none, [], "x", {"a": 0.5}).count() == 0


def test_cumulative_by_value(spark, frame):
    got = cumulative_by_value(to_spark(spark, frame), ["key"], "x", {"n": "count(1)"}, bands=7).toPandas()
    for r in got.itertuples():
        assert r.cum_n == ((frame.key == r.key) & (frame.x <= r.x)).sum()
    got = cumulative_by_value(to_spark(spark, frame), [], "x", {"n": "count(1)"}, bands=7,
                              descending=True).toPandas()
    for r in got.itertuples():
        assert r.cum_n == (frame.x >= r.x).sum()


def test_interval_joins(spark, frame):
    rng = np.random.default_rng(8)
    iv = pd.DataFrame({"key": rng.choice(["hot", "b"], 40), "s": rng.integers(0, 2900, 40)})
    iv["e"] = iv.s + rng.integers(0, 300, 40)
    iv["iv"] = np.arange(40)
    pts = points_in_intervals(to_spark(spark, frame), spark.createDataFrame(iv), ["key"], "t", "s", "e", 64)
    got = set(map(tuple, pts.select("id", "iv").toPandas().to_numpy()))
    m = frame.merge(iv, on="key")
    m = m[(m.t >= m.s) & (m.t < m.e)]
    assert got == set(zip(m.id, m.iv))
    other = iv.rename(columns={"s": "s2", "e": "e2", "iv": "iv2"})
    pairs = overlapping(spark.createDataFrame(iv), spark.createDataFrame(other), ["key"], ("s", "e"),
                        ("s2", "e2"), 64).select("iv", "iv2").toPandas()
    m = iv.merge(other, on="key")
    m = m[(m.s <= m.e2) & (m.s2 <= m.e)]
    assert sorted(zip(pairs.iv, pairs.iv2)) == sorted(zip(m.iv, m.iv2))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frame_moments_equal_brute_force(spark):
    """Dense and empty stretches, ties, null values, frames of one cell, negative times."""
    rng = np.random.default_rng(5)
    t = np.r_[rng.integers(-200, 200, 300), rng.integers(5000, 5010, 200), [900, 901]]
    x = np.where(rng.random(len(t)) < 0.1, np.nan, 1e6 + rng.random(len(t)))
    pts = pd.DataFrame({"key": ["a", "b"] * (len(t) // 2), "t": t, "x": x})
    asked = pd.DataFrame({"key": ["a"] * 60 + ["b"] * 60, "t": list(range(-230, 250, 8)) * 2})
    asked = pd.concat([asked, pts[["key", "t"]]]).drop_duplicates()
    sp, sa = to_spark(spark, pts).withColumn("x", F.nanvl("x", F.lit(None))), to_spark(spark, asked)
    for before, after in ((40, 10), (0, 0), (25, 24)):
        got = frame_moments(sp, sa, ["key"], "t", before, after, {"x": F.col("x")}).toPandas().set_index(["key", "t"])
        n = 0
        for key, at in asked.itertuples(index=False):
            inside = pts[(pts.key == key) & (pts.t >= at - before) & (pts.t <= at + after)]
            if len(inside) == 0:
                assert (key, at) not in got.index
                continue
            n += 1
            row, known = got.loc[(key, at)], inside.x.dropna()
            assert (row["rows"], row.x_n) == (len(inside), len(known))
            if len(known):
                assert abs(row.x_mean - known.mean()) < 1e-8 and abs(row.x_var - known.var(ddof=0)) < 1e-8
        assert n == len(got)


def test_frames_over_time_take_no_time_by_rows_in_reach(spark):
    """No moving frame is read again for each row, and no row is paired with each window around it."""
    from beltline.operators import features, motion

    cols = ("ax", "ay", "gx", "gy", "gz")
    df = spark.createDataFrame([("a", i * 1000, i, *[float(i % 7)] * 5) for i in range(50)], "key string, t_us bigint, event_id bigint, " + ", ".join(f"{c} double" for c in cols))
    c = df.select("key", F.col("event_id").alias("win_id"), F.col("t_us").alias("center_us"))
    for out in (motion.vibration_energy(df, ["key"]), motion.grid_vibration(df, ["key"]), features.rms_envelope(df, ["key"], "t_us", "ax", 10_000),
                features.window_gyro_rms(df, c, ["key"], "win_id", win_us=20_000)):
        plan = plan_of(out)
        assert "RangeFrame, -" not in plan and out.count() > 0
        assert not any("Join Inner" in line and ">=" in line for line in plan.splitlines())


def test_labels_of_windows_without_pairs(spark):
    """Latest cover and widest overlap of nested, equal, touching and distant intervals; empty sides and null keys."""
    from beltline.operators import sequences

    rng = np.random.default_rng(8)
    iv = pd.DataFrame({"key": rng.choice(["a", "b", "only"], 90), "label_id": np.arange(90), "start_us": rng.integers(0, 300, 90)})
    iv["end_us"], iv["label"] = iv.start_us + rng.integers(0, 60, 90), rng.choice(["u", "v"], 90)
    w = pd.DataFrame({"key": rng.choice(["a", "b", "none", None], 200), "win_id": np.arange(200), "center": rng.integers(-30, 390, 200)})
    half = rng.integers(1, 30, 200)
    w["t0"], w["t1"] = w.center - half, w.center + half
    sw, si = spark.createDataFrame(w), spark.createDataFrame(iv)
    over = sequences.window_label_overlap(sw, si, ["key"], "win_id", "t0", "t1", 0.3, 25)
    last = sequences.multi_class_label(sw, si, ["key"], "win_id", "center", {"u": 1, "v": 0}, 25)
    assert not any("Join Inner" in line for df in (over, last) for line in plan_of(df).splitlines())
    got = {r.win_id: r.label for r in over.collect()}
    held = {r.win_id: (r.y, r.segment_id) for r in last.collect()}
    assert len(got) == len(held) == len(w)
    for r in w.itertuples():
        near = [(min(r.t1, i.end_us) - max(r.t0, i.start_us), -i.start_us, -i.label_id, i.label) for i in iv.itertuples() if i.key == r.key]
        best = max([n for n in near if n[0] > 0], default=None)
        assert got[r.win_id] == (best[3] if best and best[0] >= 0.3 * (r.t1 - r.t0) else None)
        cover = max([(i.start_us, i.label_id, i.label) for i in iv.itertuples() if i.key == r.key and i.start_us <= r.center < i.end_us], default=None)
        assert held[r.win_id] == ((1 if cover[2] == "u" else 0, cover[1]) if cover else (-1, -1))


def test_summaries_of_chunks_are_not_broadcast(spark):
    from beltline.kernels import ordered as O

    df = spark.createDataFrame([("a", t, t if t % 3 == 0 else None) for t in range(30)], "k string, t long, v long")
    seq = O.Seq.by_time(["k"], "t", chunk_us=2)
    filled = O.ordered(df, seq, O.Fill("f", "v"))
    assert sorted((r.t, r.f) for r in filled.collect()) == [(t, t // 3 * 3) for t in range(30)]
    for out in (filled, O.islands(df, seq, ["t"], "cur.t - prev.t > 1", "run")):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
