"""Score fusion, trend, severity staging and the staged record."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.automata import finite_state_scan
from ..kernels.ordered import Seq
from .sequences import lap_assign, trend_slope

HEALTHY, WATCH, ESTABLISHED, ADVANCED = range(4)


def fuse(vibration: Column, acoustic: Column, digits: int = 4) -> Column:
    """Headline score: the larger of the senses present."""
    return F.round(F.greatest(vibration, acoustic), digits)


def stage_table(dwell: int, release: int) -> np.ndarray:
    """Next state for every (input, state); a state packs stage and the two saturating run lengths.

    Inputs: bit 0 = vibration high, bit 1 = trend rising, bits 2-3 = acoustic absent / low / high.
    Run lengths only matter up to their thresholds, so they saturate there.
    """
    symbol, stage, run = np.meshgrid(np.arange(12), np.arange(4), np.arange(-release, dwell + 1), indexing="ij")
    rising, acoustic = (symbol >> 1) & 1, symbol >> 2
    alarms = (symbol & 1) + (acoustic == 2)
    # the run counts up while any sense alarms and down while none does
    streak = np.where(alarms > 0, np.clip(run, 0, dwell - 1) + 1, np.clip(run, 1 - release, 0) - 1)
    ripe, calm = streak >= dwell, streak <= -release
    # two senses confirm each other; one alone has to last, and must be confirmed before it can advance
    proven = np.where(acoustic > 0, alarms == 2, (alarms == 1) & ripe)
    advancing = proven & (rising == 1) & ((acoustic > 0) | (stage >= ESTABLISHED))
    target = np.select([advancing, proven, alarms > 0], [ADVANCED, ESTABLISHED, WATCH], HEALTHY)
    climb = np.where(stage >= WATCH, stage + 1, target)
    moves = [((target > stage) & (ripe | (target == WATCH)), climb), (target > stage, np.maximum(stage, WATCH)), ((target < stage) & calm, target)]
    after = np.select([when for when, _ in moves], [to for _, to in moves], stage)
    return (after * run.shape[2] + streak + release).reshape(12, -1)


def stage_machine(df: DataFrame, keys, t, tie, index, v, a: str | None = None, v_thr=0.95, a_thr=0.95, dwell=6, release=6,
                  trend_window=60, trend_eps=1e-3, chunk_us=60_000_000) -> DataFrame:
    """Severity stage 0..3 and trend per window, in order along each key."""
    rows = trend_slope(df, keys, index, v, trend_window, trend_eps)
    sense = F.lit(0)
    if a is not None:
        sense = F.when(F.col(a).isNull(), 0).when(F.col(a) >= a_thr, 2).otherwise(1)
    rows = rows.withColumn("_sym", (F.col(v) >= v_thr).cast("int") + 2 * (F.col("trend") == "rising").cast("int") + 4 * sense)
    n_run = dwell + release + 1
    out = finite_state_scan(rows, Seq.by_time(keys, t, [tie], chunk_us), "_sym", stage_table(dwell, release), "_state", start=release)
    return out.withColumn("stage", F.expr(f"_state div {n_run}").cast("int")).drop("_state", "_sym", "_chunk")


def contract_b(staged: DataFrame, laps: DataFrame, keys, ident, center, raw, v="v", n_bins=24, contrast_thr=2.0, min_coverage=0.6,
               model_version="beltline-imu-directed") -> DataFrame:
    """One record per window: fused score, stage, trend, lap phase, and the verdict so far on where the fault sits.

    The running verdict needs every bin's mean so far.  Each bin's running sum is carried along its
    (session, variant) as one of ``n_bins`` columns of a single ordered pass.
    """
    from ..kernels.ordered import RunSum, ordered

    keys = list(keys)
    on_lap = lap_assign(staged.select(*keys, ident, center, raw), laps, keys, center)
    b = F.pmod((F.col("phase") * n_bins).cast("int"), F.lit(n_bins))
    on_lap = on_lap.withColumn("_bin", b)
    seq = Seq.by_time([*keys, "variant"], center, [ident])
    specs = []
    for i in range(n_bins):
        here = F.col("_bin") == i
        specs += [RunSum(f"_s{i}", F.when(here, F.col(raw)).otherwise(0.0)), RunSum(f"_c{i}", F.when(here, 1).otherwise(0))]
    run = ordered(on_lap, seq, *specs)
    means = F.filter(F.array(*[F.when(F.col(f"_c{i}") > 0, F.col(f"_s{i}") / F.col(f"_c{i}")) for i in range(n_bins)]), lambda m: m.isNotNull())
    run = run.select(*keys, ident, "phase", F.sort_array(means).alias("_m"))
    n = F.size("_m")
    med = (F.element_at("_m", F.expr("(size(_m) - 1) div 2 + 1").cast("int")) + F.element_at("_m", F.expr("size(_m) div 2 + 1").cast("int"))) / 2
    contrast = F.when(med > 1e-12, F.array_max("_m") / med)
    locus = F.when((n / n_bins < min_coverage) | contrast.isNull(), "unknown").when(contrast >= contrast_thr, "track").otherwise("onboard")
    run = run.select(*keys, ident, F.round("phase", 3).alias("track_position"), locus.alias("fault_locus"))
    out = staged.join(run, [*keys, ident], "left")
    return out.select(
        F.col(center).alias("ts_us"), *keys, F.lit(model_version).alias("model_version"), fuse(F.col(v), F.lit(None).cast("double")).alias("anomaly_score"),
        F.lit(None).cast("double").alias("acoustic_score"), F.round(v, 4).alias("vibration_score"), F.col("stage").alias("severity_stage"),
        "track_position", F.coalesce("fault_locus", F.lit("unknown")).alias("fault_locus"), "trend", ident)
