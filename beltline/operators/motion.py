"""From inertial, magnetic and camera-derived signals to motion state, anchors, laps and position."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.automata import greedy_spacing
from ..kernels.ordered import (Fill, Lag, Lead, RowNo, RunSum, Seq, beside, cumulative_by_value, frame_moments, islands, ordered,
                               row_frame, slot)
from ..kernels.quantiles import exact_percentiles
from ..kernels.ranges import points_in_intervals, touching
from ..session import cut_lineage
from .track import CORNERS, LAP, LEGS, STARTS, WHEEL_CM, segment_grid

CHUNK_US = 60_000_000     # a minute of one key per chunk


# --- heading and turntable anchors ------------------------------------------------------------

def integrate_yaw(df: DataFrame, keys, t="t_us", tie="event_id", yaw="gz", max_gap_us=None, chunk_us=CHUNK_US) -> DataFrame:
    """Heading in degrees: trapezoid over the real time steps; long gaps add nothing when capped."""
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    steps = ordered(df, seq, Lag("_pt", t), Lag("_py", yaw))
    dt = (F.col(t) - F.col("_pt")) / 1e6
    inc = 0.5 * (F.col(yaw) + F.col("_py")) * dt
    if max_gap_us is not None:
        inc = F.when((F.col(t) > F.col("_pt")) & (F.col(t) - F.col("_pt") <= max_gap_us), inc).otherwise(0.0)
    return ordered(steps.withColumn("_inc", F.coalesce(inc, F.lit(0.0))), seq, RunSum("heading", "_inc")).drop("_pt", "_py", "_inc")


def turntable_anchors(df: DataFrame, keys, t="t_us", tie="event_id", yaw="gz", step_deg=90.0, min_rate=15.0, tol=0.6,
                      max_gap_us=None, streaming=False, chunk_us=CHUNK_US) -> DataFrame:
    """Stretches of fast yaw that turn the unit by about ``step_deg``.

    The turn is measured from the first fast row to the first slow row after it.  A stretch still
    open at the end counts offline (up to its last row) and not in the streaming form.
    """
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    rows = integrate_yaw(df, keys, t, tie, yaw, max_gap_us, chunk_us)
    rows = ordered(rows, seq, Lead("_next", F.struct(F.col("heading").alias("h"), F.col(t).alias("t"))))
    rows = rows.withColumn("_fast", F.abs(F.col(yaw)) > min_rate)
    runs = islands(rows, seq, ["_fast"], "cur._fast <> prev._fast", "_r").filter("_fast")
    here = F.struct(F.col("heading").alias("h"), F.col(t).alias("t"))
    pos = F.struct(t, tie)
    per = runs.groupBy(*keys, "_r").agg(F.min_by(here, pos).alias("a"), F.max_by(here, pos).alias("z"), F.max_by("_next", pos).alias("n"))
    if streaming:
        per = per.filter("n IS NOT NULL")
    end = F.coalesce("n", "z")
    turn = end["h"] - F.col("a.h")
    return per.filter(F.abs(F.abs(turn) - step_deg) <= tol * step_deg).select(
        *keys, F.col("a.t").alias("t_us"), end["t"].alias("end_us"), turn.alias("deg"))


# --- moving or stopped ------------------------------------------------------------------------

def _vibration() -> Column:
    return F.sqrt(F.col("ax_var") + F.col("ay_var"))


def vibration_energy(df: DataFrame, keys, t="t_us", win_us=400_000) -> DataFrame:
    """Horizontal vibration over the trailing window; null with two samples or fewer."""
    m = frame_moments(df, df, keys, t, win_us, 0, {"ax": F.col("ax"), "ay": F.col("ay")})
    return beside(df, m.select(*keys, t, F.when(F.col("rows") > 2, _vibration()).alias("energy")), [*keys, t])


def grid_points(df: DataFrame, keys, t, step_us, chunk_us=CHUNK_US) -> DataFrame:
    """``first, first + step, ...`` below the last timestamp of each key, spread gap by gap."""
    keys = list(keys)
    first = df.groupBy(*keys).agg(F.min(t).alias("_t0"))
    seq = Seq.by_time(keys, t, [], chunk_us)
    gaps = ordered(df.select(*keys, t).distinct(), seq, Lead("_nt", t)).filter("_nt IS NOT NULL").join(first, keys)
    step = F.lit(step_us).cast("bigint")
    lo = F.call_function("div", F.col(t) - F.col("_t0") + step - 1, step)
    hi = F.call_function("div", F.col("_nt") - F.col("_t0") - 1, step)
    grid = gaps.withColumn("g", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    return grid.select(*keys, (F.col("_t0") + F.col("g") * step).alias(t))


def grid_vibration(df: DataFrame, keys, t="t_us", win_us=400_000, step_us=50_000) -> DataFrame:
    """Vibration in ``[g - win, g + win)`` at every grid point; 0 with two samples or fewer."""
    keys = list(keys)
    grid = grid_points(df, keys, t, step_us)
    m = frame_moments(df, grid, keys, t, win_us, win_us - 1, {"ax": F.col("ax"), "ay": F.col("ay")})
    framed = beside(grid, m.filter("ax_n > 2").select(*keys, t, _vibration().alias("energy")), [*keys, t])
    return framed.select(*keys, t, F.coalesce("energy", F.lit(0.0)).alias("energy"))


def hysteresis_state(df: DataFrame, keys, t="t_us", ties=(), energy="energy", lo=0.025, hi=0.06, chunk_us=CHUNK_US) -> DataFrame:
    """Schmitt trigger: stopped below ``lo``, moving above ``hi``, unchanged between."""
    seq = Seq.by_time(keys, t, ties, chunk_us)
    edge = F.when(F.col(energy) > hi, 0).when(F.col(energy) < lo, 1)
    return ordered(df, seq, Fill("_st", edge)).withColumn("stopped", F.coalesce("_st", F.lit(0)).cast("boolean")).drop("_st")


def dwell_state(df: DataFrame, keys, t="t_us", tie="event_id", energy="energy", lo=0.025, hi=0.06,
                min_stop_us=2_000_000, min_move_us=1_500_000, chunk_us=CHUNK_US) -> DataFrame:
    """Streaming rule in closed form: the state flips once its side of the band has lasted long enough.

    Rows without an energy neither count nor interrupt.
    """
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    side = F.when(F.col(energy) > hi, "move").when(F.col(energy) < lo, "stop").when(F.col(energy).isNotNull(), "hold")
    rows = df.withColumn("_side", side)
    known = islands(rows.filter("_side IS NOT NULL"), seq, ["_side", t], "cur._side <> prev._side", "_r", first="_from")
    lasted = F.col(t) - F.col(f"_from.{t}")
    commit = F.when((F.col("_side") == "stop") & (lasted >= min_stop_us), 1).when(
        (F.col("_side") == "move") & (lasted >= min_move_us), 0)
    known = known.withColumn("_commit", commit).drop("_r", "_from")
    rows = known.unionByName(seq.tag(rows.filter("_side IS NULL")), allowMissingColumns=True)
    return ordered(rows, seq, Fill("_st", "_commit")).withColumn(
        "stopped", F.coalesce("_st", F.lit(0)).cast("boolean")).drop("_st", "_commit", "_side", seq.name)


def debounce_runs(grid: DataFrame, keys, t="t_us", state="stopped", step_us=50_000, min_stop_us=2_000_000,
                  min_move_us=1_500_000, passes=3, chunk_us=CHUNK_US) -> DataFrame:
    """Offline debounce: runs ``(start, n, state)`` after absorbing short inner runs, pass by pass.

    In one pass a short inner run takes the state before it, so in a chain of short runs every other
    one flips.  The table of runs is small next to the samples; it is written out between passes.
    """
    keys = list(keys)
    seq = Seq.by_time(keys, t, [], chunk_us)

    def merge(df, weight):
        runs = islands(df, seq, [state], f"cur.{state} <> prev.{state}", "_r")
        return runs.groupBy(*keys, "_r").agg(
            F.min(t).alias(t), F.first(state).alias(state), F.sum(weight).alias("n")).drop("_r")

    runs = cut_lineage(merge(grid.withColumn("_w", F.lit(1)), "_w"))
    need = F.when(F.col(state), min_stop_us).otherwise(min_move_us)
    for _ in range(passes):
        r = ordered(runs, seq, RowNo("_i"), Lead("_more", F.lit(True)))
        short = (F.col("n") * step_us < need) & (F.col("_i") > 1) & F.col("_more").isNotNull()
        r = islands(r.withColumn("_short", short), seq, ["_short", "_i"], "cur._short <> prev._short", "_c", first="_from")
        flip = F.col("_short") & ((F.col("_i") - F.col("_from._i")) % 2 == 0)
        r = r.withColumn(state, F.col(state) != flip).select(*keys, t, state, "n")
        runs = cut_lineage(merge(r, "n"))
    return runs


# --- position ---------------------------------------------------------------------------------

def leg_distance(wheels: Column, corners: Column, wheels_at_corner: Column, start="BR") -> Column:
    """Distance after so many wheels and corners: from the corner reached last, at most its leg; before any, that of the wheels."""
    leg = corners - 1 + CORNERS.index(start)
    at = F.pmod(leg, F.lit(4)).cast("int") + 1
    base = LAP * F.floor(leg / 4) + F.element_at(F.array(*[F.lit(s) for s in STARTS]), at)
    length = F.element_at(F.array(*[F.lit(s) for s in LEGS]), at)
    return F.when(corners == 0, WHEEL_CM * wheels).otherwise(base + F.least(WHEEL_CM * (wheels - wheels_at_corner), length))


def cum_distance_legpin(events: DataFrame, keys, t="t_us", tie="event_id", start="BR", chunk_us=CHUNK_US) -> DataFrame:
    """Distance along the loop after every wheel / anchor event (``wheel``, ``anchor``: 0/1, ``stopped``).

    Each accepted wheel adds one pitch.  The first anchor fixes the absolute start, each later one
    snaps to the next corner; between anchors the distance is capped at the leg.
    """
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    moved = F.when((F.col("wheel") == 1) & ~F.col("stopped"), 1).otherwise(0)
    rows = ordered(events, seq, RunSum("_w", moved), RunSum("_a", "anchor"))
    rows = ordered(rows, seq, Fill("_w0", F.when(F.col("anchor") == 1, F.col("_w"))))
    cum = leg_distance(F.col("_w"), F.col("_a"), F.col("_w0"), start)
    return rows.withColumn("cum_cm", cum.cast("double")).drop("_w", "_a", "_w0")


def cum_distance_offline(events: DataFrame, keys, t="t_us", tie="event_id", start="BR", chunk_us=CHUNK_US) -> DataFrame:
    """Leg-pinned distance of a finished recording, as a function of the wheels seen so far (dwell wheels included).

    An anchor pins every row with its wheel count. Rows up to the first anchor count back from its corner, by a leg at
    most; between anchors the distance is capped at the leg; after the last one it runs on. Without anchors it is the
    plain wheel distance.
    """
    keys = list(keys)
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    rows = ordered(events, seq, RunSum("_w", "wheel"), RunSum("_a", "anchor"))
    pinned = F.when(F.col("anchor") == 1, F.col("_w"))
    at_count = rows.groupBy(*keys, "_w").agg(F.max("_a").alias("_k"))
    ends = rows.groupBy(*keys).agg(F.min(pinned).alias("_first"), F.max(pinned).alias("_last"))
    legs = rows.filter("anchor = 1").groupBy(*keys, F.col("_a").alias("_k")).agg(F.min("_w").alias("_w0"))
    rows = rows.join(at_count, [*keys, "_w"]).join(ends, keys).join(legs, [*keys, "_k"], "left")
    si = CORNERS.index(start)
    leg = F.col("_k") - 1 + si
    at = (leg % 4).cast("int")
    base = LAP * F.floor(leg / 4) + F.element_at(F.array(*[F.lit(s) for s in STARTS]), at + 1)
    length = F.element_at(F.array(*[F.lit(s) for s in LEGS]), at + 1)
    since = WHEEL_CM * (F.col("_w") - F.col("_w0"))
    cum = (F.when(F.col("_first").isNull(), WHEEL_CM * F.col("_w"))
           .when(F.col("_w") <= F.col("_first"), STARTS[si] - F.least(WHEEL_CM * (F.col("_first") - F.col("_w")), F.lit(LEGS[si])))
           .when(F.col("_w") >= F.col("_last"), base + since).otherwise(base + F.least(since, length)))
    return rows.withColumn("cum_cm", cum.cast("double")).drop("_w", "_a", "_k", "_w0", "_first", "_last")


def dead_reckoning(df: DataFrame, keys, t="t_us", tie="event_id", every=50, leak=0.9, chunk_us=CHUNK_US, block=20_000) -> DataFrame:
    """Leaky velocity from acceleration counts, heading from the magnetometer, one fix per ``every`` rows.

    Each block of rows warms up on as many rows before it as a velocity takes to decay below double
    precision; positions are then a plain running sum.
    """
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    rows = ordered(df, seq, RowNo("_n"), Lag("_pt", t))
    dt = (F.col(t) - F.col("_pt")) / 1e6
    rows = rows.withColumn("_dt", F.when((dt > 0) & (dt <= 1.0), dt))
    rows = ordered(rows, seq, Fill("_hd", F.when(F.col("_dt").isNotNull(), F.atan2("my", "mx"))), RowNo("_m", F.col("_dt").isNotNull().cast("int")))
    live = rows.filter("_dt IS NOT NULL")
    halo = int(np.ceil(np.log(1e-17) / np.log(leak))) if 0 < leak < 1 else 1
    block = max(block, 8 * halo)
    i = F.col("_m") - 1
    live = live.withColumn("_own", slot(i, block)).withColumn("_b", F.explode(F.sequence(slot(i, block), slot(i + halo, block))))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_m")
        dts = pdf["_dt"].to_numpy()
        gain = np.column_stack([pdf["ax_raw"], pdf["ay_raw"]]) / 32768 * 4 * 9.81 * dts[:, None]
        v, vs = np.zeros(2), np.empty_like(gain)
        for n in range(len(gain)):
            v = v * leak + gain[n]
            vs[n] = v
        c, s = np.cos(pdf["_hd"]), np.sin(pdf["_hd"])
        out = pdf.assign(_dx=(vs[:, 0] * c - vs[:, 1] * s) * dts, _dy=(vs[:, 0] * s + vs[:, 1] * c) * dts)
        return out[out["_own"] == out["_b"]][[*keys, t, tie, "_dx", "_dy"]]

    slim = live.select(*keys, t, tie, "_m", "_own", "_b", "_dt", "_hd", "ax_raw", "ay_raw")
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in [*keys, t, tie]) + ", _dx double, _dy double"
    moves = slim.groupBy(*keys, "_b").applyInPandas(step, schema)
    placed = ordered(moves, seq, RunSum("x", "_dx"), RunSum("y", "_dy")).select(*keys, t, tie, "x", "y")
    due = live.filter((F.col("_n") % every == 0) & (F.col("_own") == F.col("_b"))).select(*keys, t, tie, "line")
    fixes = due.join(placed, [*keys, t, tie])
    return fixes.select(*keys, t, tie, segment_grid(F.col("x"), F.col("y"), F.col("line")).alias("segment"),
                        F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


# --- laps on a figure-8 -----------------------------------------------------------------------

def yaw_envelope(df: DataFrame, keys, index: str, yaw="gz", n=4) -> DataFrame:
    """Centred mean of |yaw| over ``n`` samples with mirrored ends."""
    keys = list(keys)
    half = n // 2
    last = df.groupBy(*keys).agg(F.max(index).alias("_N"))
    rows = df.withColumn("_abs", F.abs(yaw)).join(last, keys)
    head = rows.filter(F.col(index) <= half).select(*keys, (1 - F.col(index)).alias(index), "_abs")
    tail = rows.filter(F.col(index) > F.col("_N") - half).select(*keys, (2 * F.col("_N") + 1 - F.col(index)).alias(index), "_abs")
    wide = rows.unionByName(head, allowMissingColumns=True).unionByName(tail, allowMissingColumns=True)
    return row_frame(wide, keys, index, half, n - 1 - half, {"env": F.avg("_abs")}).filter("_N IS NOT NULL").drop("_abs")


def local_peak_turns(df: DataFrame, keys, t="t_us", tie="event_id", yaw="gz", smooth_n=4, sep_n=16, side_n=2, k=3.0,
                     chunk_us=CHUNK_US) -> DataFrame:
    """Signed turns: envelope peaks over median + k robust deviations, at least ``sep_n`` samples apart."""
    keys = list(keys)
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    rows = ordered(df, seq, RowNo("_i")).select(*keys, t, tie, yaw, "_i")
    env = yaw_envelope(rows, keys, "_i", yaw, smooth_n)
    env = row_frame(env, keys, "_i", side_n, side_n - 1, {"_side": F.avg(yaw)})
    med = exact_percentiles(env, keys, "env", {"_med": 0.5})
    dev = env.join(med, keys).withColumn("_dev", F.abs(F.col("env") - F.col("_med")))
    mad = exact_percentiles(dev, keys, "_dev", {"_mad": 0.5})
    thr = med.join(mad, keys).select(*keys, (F.col("_med") + k * (F.col("_mad") * 1.4826 + 1e-9)).alias("_thr"))
    by_index = Seq(tuple(keys), ("_i",), "_i div 100000", "_blk")
    env = ordered(env, by_index, Lag("_pe", "env"), Lead("_ne", "env")).join(thr, keys)
    peaks = env.filter("env > _thr AND env >= _pe AND env > _ne").select(*keys, t, "_i", "_side")
    kept = greedy_spacing(peaks, Seq(tuple(keys), ("_i",), "_i div 100000", "_blk"), "_i", sep_n)
    return kept.select(*keys, F.col(t).alias("t_us"), F.when(F.col("_side") > 0, 1).otherwise(-1).alias("direction"))


def minority_landmarks(turns: DataFrame, keys) -> DataFrame:
    """Turns of the rarer direction (+1 on a tie): the once-per-lap crossover."""
    keys = list(keys)
    n = turns.groupBy(*keys).agg(F.count_if(F.col("direction") == 1).alias("_p"), F.count_if(F.col("direction") == -1).alias("_m"))
    rare = F.when(F.col("_p") <= F.col("_m"), 1).otherwise(-1)
    return turns.join(n, keys).filter(F.col("direction") == rare).drop("_p", "_m")


def route_variants(laps: DataFrame, keys, tol=0.18) -> DataFrame:
    """Laps with their route variant: durations in rising order, a new variant once one exceeds the
    running mean of its cluster by ``tol``.

    A cluster is a stretch of the sorted durations, so running counts and sums give every running
    mean; each round finds the next border of all sessions at once.  Durations grow by at least
    ``tol`` per variant, so there are few rounds.
    """
    keys = list(keys)
    laps = laps.withColumn("_d", (F.col("lap_end") - F.col("lap_start")).cast("double"))
    cum = cumulative_by_value(laps, keys, "_d", {"n": "count(1)", "s": "sum(_d)"})
    cum = cut_lineage(cum.select(*keys, "_d", (F.col("cum_n") - F.col("n")).alias("n0"), (F.col("cum_s") - F.col("s")).alias("s0")))
    base = cum.groupBy(*keys).agg(F.min("_d").alias("from_d")).withColumns({
        "variant": F.lit(0), "bn": F.lit(0).cast("bigint"), "bs": F.lit(0.0)})
    base = cut_lineage(base)
    borders = base
    while True:
        mean = (F.col("s0") - F.col("bs")) / (F.col("n0") - F.col("bn"))
        over = cum.join(base, keys).filter((F.col("n0") > F.col("bn")) & (F.col("_d") > (1 + tol) * mean))
        nxt = over.groupBy(*keys, "variant").agg(F.min_by(F.struct("_d", "n0", "s0"), "_d").alias("b")).select(
            *keys, F.col("b._d").alias("from_d"), (F.col("variant") + 1).alias("variant"), F.col("b.n0").alias("bn"), F.col("b.s0").alias("bs"))
        base = cut_lineage(nxt)
        if base.isEmpty():
            break
        borders = borders.unionByName(base)
    spans = borders.select(*keys, "from_d", "variant")
    # A handful of borders per session, matched by an as-of pass over the durations.
    from .asof import asof_last

    d = laps.withColumns({"_pos": F.col("_d").cast("bigint"), "_tie": F.col("lap_start")})
    b = spans.withColumns({"_pos": F.col("from_d").cast("bigint"), "_tie": F.lit(0).cast("bigint")})
    out = asof_last(d, b, keys, "_pos", "_tie", ["variant"], "_v", chunk_us=60_000_000)
    return out.select(*laps.drop("_d").columns, F.col("_v.variant").alias("variant"))


def dominant_variant(laps: DataFrame, keys) -> DataFrame:
    """Most common route variant per session; the one seen first wins a tie."""
    per = laps.groupBy(*keys, "variant").agg(F.count(F.lit(1)).alias("n_laps"), F.min("lap_start").alias("_seen"))
    return per.groupBy(*keys).agg(F.max_by(F.struct("variant", "n_laps"), F.struct("n_laps", -F.col("_seen"))).alias("r")).select(
        *keys, "r.variant", "r.n_laps")


def track_health_map(values: DataFrame, keys, phase="phase", value="score", n_bins=24, contrast_thr=2.0, min_coverage=0.6) -> DataFrame:
    """Per key: coverage, contrast, peak phase and locus of a value binned by lap phase."""
    keys = list(keys)
    b = F.pmod((F.col(phase) * n_bins).cast("int"), F.lit(n_bins))
    bins = values.groupBy(*keys, b.alias("bin")).agg(F.avg(value).alias("m"))
    agg = bins.groupBy(*keys).agg(
        (F.count(F.lit(1)) / n_bins).alias("coverage"), F.max("m").alias("_max"), F.percentile("m", 0.5).alias("_med"),
        F.max_by("bin", F.struct("m", -F.col("bin"))).alias("_peak"))
    contrast = F.when(F.col("_med") > 1e-12, F.col("_max") / F.col("_med"))
    return agg.withColumns({"contrast": contrast, "peak_phase": (F.col("_peak") + 0.5) / n_bins}).withColumn(
        "locus", F.when((F.col("coverage") < min_coverage) | F.col("contrast").isNull(), "unknown")
        .when(F.col("contrast") >= contrast_thr, "track").otherwise("onboard")).drop("_max", "_med", "_peak")


# --- magnetometer -----------------------------------------------------------------------------

def circle_fit(df: DataFrame, keys, x="mx", y="my") -> DataFrame:
    """Least-squares circle centre (hard-iron offset) from moments about the means."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_ox"), F.avg(y).alias("_oy"))
    u, v = F.col(x) - F.col("_ox"), F.col(y) - F.col("_oy")
    m = df.join(mean, keys).groupBy(*keys, "_ox", "_oy").agg(
        F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"),
        (F.sum(u * u * u + u * v * v) / 2).alias("a"), (F.sum(v * v * v + v * u * u) / 2).alias("b"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    return m.select(*keys, (F.col("_ox") + (F.col("a") * F.col("vv") - F.col("b") * F.col("uv")) / det).alias("cx"),
                    (F.col("_oy") + (F.col("b") * F.col("uu") - F.col("a") * F.col("uv")) / det).alias("cy"))


def mag_gap_recovery(imu: DataFrame, anchors: DataFrame, keys, t="t_us", tie="event_id", gap_us=800_000, step_deg=70.0,
                     max_gyro_deg=40.0, chunk_us=CHUNK_US) -> DataFrame:
    """Turns hidden in data gaps: the calibrated magnetic heading steps while the gyro saw little."""
    keys = list(keys)
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    rows = integrate_yaw(imu, keys, t, tie, chunk_us=chunk_us)
    gaps = ordered(imu.select(*keys, t, tie), seq, Lag("ta", t)).filter(F.col(t) - F.col("ta") > gap_us).select(
        *keys, F.col(tie).alias("gap_id"), "ta", F.col(t).alias("tb"))
    mid2 = F.col("ta") + F.col("tb")
    near = F.lit(4_000_000)
    spots = gaps.withColumn("_p2", F.explode(F.array(2 * F.col("ta"), 2 * F.col("tb"), mid2))).withColumns({
        "_s": F.col("_p2") - 2 * near + 1, "_e": F.col("_p2") + 2 * near - 1})
    a2 = anchors.select(*keys, (2 * F.col("t_us")).alias("a0"), (2 * F.col("t_us")).alias("a1"))
    caught = touching(spots, a2, keys, ("_s", "_e"), ("a0", "a1"), "gap_id", 5_000_000)
    open_ = gaps.join(caught, [*keys, "gap_id"], "left_anti")

    centre = circle_fit(imu, keys)
    look = open_.withColumn("_w", F.explode(F.array(
        F.struct(F.lit("bef").alias("part"), (F.col("ta") - 3_000_000).alias("w0"), (F.col("ta") - 200_000).alias("w1")),
        F.struct(F.lit("aft").alias("part"), (F.col("tb") + 200_000).alias("w0"), (F.col("tb") + 3_000_000).alias("w1")),
        F.struct(F.lit("gyr").alias("part"), (F.col("ta") - 1_000_000).alias("w0"), (F.col("tb") + 1_000_000).alias("w1"))))).select(
        *keys, "gap_id", "ta", "tb", "_w.*")
    seen = points_in_intervals(rows.select(*keys, F.col(t).alias("s_t"), F.col(tie).alias("s_id"), "heading", "mx", "my"), look, keys, "s_t",
                               "w0", "w1", 10_000_000, closed=True).join(centre, keys)
    pos = F.struct("s_t", "s_id")
    # A window holds a few seconds of samples, so its median is a bounded aggregate.
    parts = seen.groupBy(*keys, "gap_id", "ta", "tb", "part").agg(
        F.count(F.lit(1)).alias("n"), F.percentile(F.col("mx") - F.col("cx"), 0.5).alias("x"), F.percentile(F.col("my") - F.col("cy"), 0.5).alias("y"),
        (F.max_by("heading", pos) - F.min_by("heading", pos)).alias("turn"))
    deg = F.degrees(F.atan2("y", "x"))

    def of(part, value):
        return F.max(F.when((F.col("part") == part) & ((F.col("n") > 3) | F.lit(part == "gyr")), value))

    g = parts.groupBy(*keys, "gap_id", "ta", "tb").agg(of("bef", deg).alias("bef"), of("aft", deg).alias("aft"), of("gyr", F.col("turn")).alias("gyro_deg"))
    step = F.pmod(F.col("aft") - F.col("bef") + 180, F.lit(360)) - 180
    hit = F.abs(step) > step_deg
    if max_gyro_deg is not None:
        hit = hit & (F.abs(F.coalesce("gyro_deg", F.lit(0.0))) < max_gyro_deg)
    mid = F.call_function("div", F.col("ta") + F.col("tb"), F.lit(2).cast("bigint"))
    return g.filter(hit).select(*keys, "gap_id", mid.alias("t_us"), step.alias("step_deg"))


# --- wheel spacing ----------------------------------------------------------------------------

def loo_wheel_error(wheels: DataFrame, keys, t="t_us", period_us=450_000, chunk_us=CHUNK_US) -> DataFrame:
    """Error (cm) of predicting each inner wheel of a single-spaced run from its neighbours' speeds.

    The prediction integrates speed between the wheel before and the held-out one; the speed there
    depends on two wheels to either side only, so a five-row frame is enough.
    """
    keys = list(keys)
    seq = Seq.by_time(keys, t, [], chunk_us)
    rows = ordered(wheels.select(*keys, t).distinct(), seq, RowNo("_i"), Lag("_pt", t))
    lo, hi = 0.6 * period_us, 1.7 * period_us
    rows = rows.withColumn("_single", F.coalesce((F.col(t) - F.col("_pt")).between(lo, hi), F.lit(False)))
    framed = row_frame(rows, keys, "_i", 2, 2, {"_near": F.collect_list(F.struct("_i", t, "_single"))})

    def at(d, field):
        return F.get(F.filter("_near", lambda w: w["_i"] == F.col("_i") + d), F.lit(0))[field]

    sec = {d: at(d, t) / 1e6 for d in (-2, -1, 0, 1, 2)}
    framed = framed.filter(F.col("_single") & F.coalesce(at(1, "_single"), F.lit(False))).withColumns({
        "_a": sec[-1], "_b": sec[0], "_c": sec[1],
        "_z": F.when(at(-1, "_single"), sec[-2]), "_d": F.when(F.coalesce(at(2, "_single"), F.lit(False)), sec[2])})
    # Mid times and speeds (cm/s) left of, across and right of the held-out wheel.
    framed = framed.withColumns({
        "_m1": (F.col("_z") + F.col("_a")) / 2, "_v1": WHEEL_CM / (F.col("_a") - F.col("_z")),
        "_m2": (F.col("_a") + F.col("_c")) / 2, "_v2": 2 * WHEEL_CM / (F.col("_c") - F.col("_a")),
        "_m3": (F.col("_c") + F.col("_d")) / 2, "_v3": WHEEL_CM / (F.col("_d") - F.col("_c"))})
    x = "(_a + (_b - _a) * g / 47)"
    v = (f"CASE WHEN {x} <= _m2 THEN CASE WHEN _m1 IS NULL THEN _v2 ELSE _v1 + (_v2 - _v1) * (({x} - _m1) / (_m2 - _m1)) END "
         f"ELSE CASE WHEN _m3 IS NULL THEN _v2 ELSE _v2 + (_v3 - _v2) * (({x} - _m2) / (_m3 - _m2)) END END")
    area = F.expr(f"aggregate(transform(sequence(0, 47), g -> {v} * CASE WHEN g IN (0, 47) THEN 0.5D ELSE 1D END), 0D, (s, e) -> s + e)")
    framed = framed.withColumn("_pred", area * (F.col("_b") - F.col("_a")) / 47)
    return framed.select(*keys, t, F.abs(F.col("_pred") - WHEEL_CM).alias("err_cm"))


def segment_counts(fixes: DataFrame, keys) -> DataFrame:
    return fixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                                    F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def recording_origin(df: DataFrame, keys, host="t_host_us", rel: Column | str = "t_rel_s") -> DataFrame:
    """Host clock at recording start: median of host time minus relative time."""
    off = df.withColumn("_o", F.col(host) - 1e6 * (F.col(rel) if isinstance(rel, str) else rel))
    return exact_percentiles(off, keys, "_o", {"origin_us": 0.5})
