"""Detector evaluation: AUC, operating points, resampling, rank tests, events, fusion, clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.ordered import RowNo, Seq, cumulative_by_value, ordered, slot
from ..kernels.quantiles import exact_percentiles
from ..session import cut_lineage
from .sequences import event_interval_match, runs_min_k

_POS_NEG = {"pos": "sum(y)", "neg": "sum(1 - y)"}


def _labelled(df, keys, score, y):
    return df.select(*keys, F.col(score).cast("double").alias("s"), F.col(y).cast("bigint").alias("y")).filter("s IS NOT NULL AND NOT isnan(s)")


def auc(df: DataFrame, keys, score="score", y="y", folded=False) -> DataFrame:
    """P(positive > negative) with ties counted half; null when a class is missing."""
    cum = cumulative_by_value(_labelled(df, keys, score, y), keys, "s", _POS_NEG)
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    out = cum.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("_w"))
    a = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg")))
    return out.withColumn("auc", F.greatest(a, 1 - a) if folded else a).drop("_w")


def roc_points(df: DataFrame, keys, score="score", y="y") -> DataFrame:
    """False-positive and false-negative rate at every distinct threshold (flag means score >= thr)."""
    keys = list(keys)
    cum = cumulative_by_value(_labelled(df, keys, score, y), keys, "s", _POS_NEG, descending=True)
    total = _labelled(df, keys, score, y).groupBy(*keys).agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_n"))
    return cum.join(total, keys).select(
        *keys, F.col("s").alias("thr"), (F.col("cum_neg") / F.greatest("_n", F.lit(1))).alias("fpr"),
        (1 - F.col("cum_pos") / F.greatest("_p", F.lit(1))).alias("fnr"))


def roc_operating_points(df: DataFrame, keys, score="score", y="y") -> DataFrame:
    """Equal error, Youden, high recall (FNR <= .10) and low FPR (<= .05); the lowest threshold wins ties."""
    r = roc_points(df, keys, score, y)
    pt = F.struct("thr", "fpr", "fnr")
    # Ranking keys are rounded, so ties are ties and not the last bit of a division.
    near = lambda c: F.round(c, 12)
    best = r.groupBy(*keys).agg(
        F.min_by(pt, F.struct(near(F.abs(F.col("fpr") - F.col("fnr"))), "thr")).alias("equal_error"),
        F.min_by(pt, F.struct(near(F.col("fnr") + F.col("fpr")), "thr")).alias("youden"),
        F.min_by(pt, F.when(near(F.col("fnr")) <= 0.10, F.struct("fpr", "thr"))).alias("high_recall"),
        F.min_by(pt, F.when(near(F.col("fpr")) <= 0.05, F.struct(near(F.col("fnr")), "thr"))).alias("low_fpr"))
    names = ("equal_error", "youden", "high_recall", "low_fpr")
    rows = F.array(*[F.struct(F.lit(n).alias("op"), F.coalesce(n, "youden").alias("p")) for n in names])
    return best.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.op", "r.p.thr", "r.p.fpr", "r.p.fnr")


def operating_point(df: DataFrame, keys, fpr_target: float, score="score", y="y") -> DataFrame:
    """Threshold at the ``1 - fpr_target`` quantile of the negatives and the rates it gives."""
    rows = _labelled(df, keys, score, y)
    thr = exact_percentiles(rows.filter("y = 0"), keys, "s", {"thr": 1 - fpr_target})
    hit = (F.col("s") >= F.col("thr")).cast("int")
    return rows.join(thr, list(keys)).groupBy(*keys, "thr").agg(
        (F.sum(hit * (1 - F.col("y"))) / F.greatest(F.lit(1), F.sum(1 - F.col("y")))).alias("fpr"),
        (1 - F.sum(hit * F.col("y")) / F.greatest(F.lit(1), F.sum("y"))).alias("fnr"))


POISSON_UNIT, POISSON_LUMP = 1, 16  # means of the two draws that make up any whole mean


def poisson_cdf(mean: int) -> list[float]:
    """The distribution function of a Poisson variable as far as a 52 bit draw can tell it from 1."""
    out, p, c, k = [], float(np.exp(-mean)), 0.0, 0
    while 1 - c > 2.0 ** -52 and k < 20 * mean + 20:
        c += p
        out.append(c)
        k += 1
        p *= mean / k
    return out


def poisson_draws(m: Column) -> Column:
    """How many draws make up a Poisson variable of whole mean ``m``: lumps of 16 and units."""
    return (m / POISSON_LUMP).cast("bigint") + F.pmod(m, F.lit(POISSON_LUMP))


def poisson_draw(m: Column, i: Column, *parts: Column) -> Column:
    """Draw ``i`` of a Poisson variable of whole mean ``m``, from the md5 of ``parts`` and ``i``.

    Sums of Poisson draws are Poisson, so the sum over ``poisson_draws(m)`` is exact for any ``m``, and a value that stands for
    many rows costs a sixteenth of them. It depends on nothing but ``parts`` and is the same after a lost task. The 52 bits are
    compared as hexadecimal text with the distribution function, in one compiled expression.
    """
    bits = F.substring(F.md5(F.concat_ws("|", *[x.cast("string") for x in (*parts, i)])), 1, 13)

    def inverse(mean: int) -> Column:
        cuts = [math.ceil(c * (1 << 52)) for c in poisson_cdf(mean)]
        cuts = [f"{c:013x}" for c in cuts if c < 1 << 52]
        out = F.when(bits < cuts[0], 0)
        for k, c in enumerate(cuts[1:], 1):
            out = out.when(bits < c, k)
        return out.otherwise(len(cuts)).cast("bigint")

    return F.when(i < (m / POISSON_LUMP).cast("bigint"), inverse(POISSON_LUMP)).otherwise(inverse(POISSON_UNIT))


def poisson_total(m: Column, *parts: Column) -> Column:
    """All draws of a Poisson variable of whole mean ``m`` in one row; queries that draw much give each draw a row instead."""
    zero = F.lit(0).cast("bigint")
    last = F.greatest(poisson_draws(m), F.lit(1)) - 1
    return F.when(m > 0, F.aggregate(F.sequence(zero, last), zero, lambda s, i: s + poisson_draw(m, i, *parts))).otherwise(zero)


#: Replicates that are drawn by one task for a value; tasks share the work also where there are few values.
REPLICATES = 20


def _replicated(per: DataFrame, b: int, *by: str) -> DataFrame:
    """``per`` for each replicate ``_r`` below ``b``, dealt by ``by`` and blocks ``_block`` of replicates.

    The number of partitions is given, as Spark would put small tables into one task, whatever they grow to.
    """
    spark = per.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = per.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // REPLICATES)))).repartition(parts, *by, "_block")
    first = F.col("_block") * REPLICATES
    return blocks.withColumn("_r", F.explode(F.sequence(first, F.least(first + REPLICATES, F.lit(b)) - 1)))


def _numbered_draws(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))


def bootstrap_mean_ci(df: DataFrame, keys, ident, value, b=1000, seed=0) -> DataFrame:
    """Mean with its 95 % interval from Poisson resampling of the distinct values.

    Equal values of a key are one row, named by the least ``ident`` among them; its weight in a replicate is one draw
    with the number of rows as mean. Only distinct values and one sum per replicate and task are shuffled. Null and NaN
    values are left out, as are null keys.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    per = df.select(*keys, ident, v.alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.min(ident).alias("_id"))
    drawn = _replicated(per, b, *keys, "_v").withColumn("_i", _numbered_draws(poisson_draws(F.col("_n"))))
    reps = drawn.withColumn("_w", poisson_draw(F.col("_n"), F.col("_i"), F.lit(seed), F.col("_r"), F.col("_id"))).groupBy(*keys, "_r").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("_m"))
    ci = reps.groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    mean = per.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))
    return mean.join(ci, keys).select(*keys, "mean", F.col("_ci")[0].alias("lo"), F.col("_ci")[1].alias("hi"))


def bootstrap_auc_ci(df: DataFrame, keys, ident, score="score", y="y", b=200, seed=0, bands=64) -> DataFrame:
    """AUC with its 95 % interval from Poisson resampling of the distinct scores, classes drawn apart.

    The distinct scores are dealt to tasks by bands of their order and meet their replicates only there; a band hands on
    its own wins and class weights, which are summed over the bands of a replicate. Replicates without a class are left out.
    """
    keys = list(keys)
    rows = _labelled(df.withColumn("_ident", F.col(ident)), [*keys, "_ident"], score, y)
    per = rows.groupBy(*keys, "s").agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_q"), F.min("_ident").alias("_id"))
    cuts = per.groupBy(*keys).agg(F.percentile_approx("s", [i / bands for i in range(1, bands)], 16 * bands).alias("_cuts"))
    band = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= F.col("s")))
    dealt = _replicated(per.join(cuts, keys).withColumn("_band", band).drop("_cuts"), b, *keys, "_band")
    k = [*keys, "_band", "_block", "_r"]
    first = poisson_draws(F.col("_p"))
    rows = dealt.withColumn("_i", _numbered_draws(first + poisson_draws(F.col("_q")))).withColumn("_pos", F.col("_i") < first)
    w = poisson_draw(F.when(F.col("_pos"), F.col("_p")).otherwise(F.col("_q")), F.when(F.col("_pos"), F.col("_i")).otherwise(F.col("_i") - first),
                     F.lit(seed), F.when(F.col("_pos"), "p").otherwise("n"), F.col("_r"), F.col("_id"))
    drawn = rows.withColumn("_w", w).groupBy(*k, "s").agg(
        F.sum(F.when(F.col("_pos"), F.col("_w")).otherwise(0)).alias("_p"), F.sum(F.when(F.col("_pos"), 0).otherwise(F.col("_w"))).alias("_q"))
    upto = F.sum("_q").over(Window.partitionBy(*k).orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    inside = drawn.withColumn("_c", upto).groupBy(*k).agg(
        F.sum(F.col("_p") * (F.col("_c") - F.col("_q") / 2)).alias("_u"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    lower = F.coalesce(F.sum("_q").over(Window.partitionBy(*keys, "_r").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = inside.withColumn("_l", lower).groupBy(*keys, "_r").agg(
        F.try_divide(F.sum(F.col("_u") + F.col("_p") * F.col("_l")), (F.sum("_p") * F.sum("_q")).cast("double")).alias("_a"))
    ci = a.groupBy(*keys).agg(F.percentile("_a", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    return auc(df, keys, score, y).join(ci, keys).select(*keys, "auc", F.col("_ci")[0].alias("lo"), F.col("_ci")[1].alias("hi"))


def avg_rank(df: DataFrame, keys, value, out="rank") -> DataFrame:
    """1-based ranks within a key, ties averaged."""
    keys = list(keys)
    cum = cumulative_by_value(df, keys, value, {"n": "count(1)"})
    r = cum.select(*keys, value, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(out))
    return df.join(r, [*keys, value])


def _normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal (rational approximation, error below 1.5e-7)."""
    x = F.abs(z) / float(np.sqrt(2))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def mann_whitney(df: DataFrame, keys, score="score", y="y") -> DataFrame:
    """U of the positives, z with tie and continuity correction, one-sided p (positives larger)."""
    cum = cumulative_by_value(_labelled(df, keys, score, y), keys, "s", _POS_NEG)
    t = F.col("pos") + F.col("neg")
    g = cum.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("u"),
        F.sum((t * t * t - t).cast("double")).alias("_t"))
    n, p = (F.col("n_pos") + F.col("n_neg")).cast("double"), (F.col("n_pos") * F.col("n_neg")).cast("double")
    sd = F.sqrt(p / 12 * (n + 1 - F.col("_t") / (n * (n - 1))))
    z = (F.col("u") - p / 2 - 0.5) / sd
    return g.withColumn("z", z).withColumn("p", _normal_sf(F.col("z"))).drop("_t")


def spearman(df: DataFrame, keys, a, b) -> DataFrame:
    r = avg_rank(avg_rank(df, keys, a, "_ra"), keys, b, "_rb")
    x, y = F.col("_ra"), F.col("_rb")
    m = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(c) for c, e in (
        ("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return m.select(*keys, F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(vx * vy)).alias("rho"))


def event_level_metrics(windows: DataFrame, faults: DataFrame, keys, t, tie, thresholds, ks, tol) -> DataFrame:
    """Missed events and false alarms per hour over a grid of threshold and persistence."""
    keys = list(keys)
    grid = F.array(*[F.lit(float(x)) for x in thresholds])
    rows = windows.withColumn("thr", F.explode(grid))
    runs = runs_min_k(rows.withColumn("_f", F.col("score") >= F.col("thr")), [*keys, "thr"], t, tie, "_f", 1)
    runs = runs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("n") >= F.col("k")).withColumn("det_id", F.col("start_us"))
    truths = faults.withColumn("thr", F.explode(grid)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    m = event_interval_match(runs, truths, [*keys, "thr", "k"], "det_id", "label_id", tol)
    per = m.groupBy("thr", "k").agg(
        F.count_if(F.col("side") == "truth").alias("events"), F.count_if(F.col("verdict") == "missed").alias("missed"),
        F.count_if(F.col("verdict") == "false_alarm").alias("false_alarms"))
    span = windows.groupBy(*keys).agg((F.max(t) - F.min(t)).alias("_d"))
    fault = faults.groupBy(*keys).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("_f"))
    hours = span.join(fault, keys, "left").agg(
        (F.sum(F.greatest(F.col("_d") - F.coalesce("_f", F.lit(0)), F.lit(0))) / 3.6e9).alias("h")).scalar()
    return per.withColumns({"event_fnr": F.col("missed") / F.greatest("events", F.lit(1)),
                            "fa_per_hour": F.col("false_alarms") / F.greatest(hours, F.lit(1e-9))})


def feature_separability(df: DataFrame, ids, features, y="y") -> DataFrame:
    """AUC of every feature in one pass over the unpivoted table."""
    return auc(df.unpivot(list(ids) + [y], list(features), "feature", "value"), ["feature"], "value", y)


def rank_fusion(df: DataFrame, keys, a, b, y="y") -> DataFrame:
    """AUC of the summed average ranks of two scores."""
    r = avg_rank(avg_rank(df, keys, a, "_ra"), keys, b, "_rb").withColumn("fused", F.col("_ra") + F.col("_rb"))
    return auc(r, keys, "fused", y)


def rate_at_transfer(df: DataFrame, rec, score="score", y="y") -> DataFrame:
    """Equal-error threshold of each recording applied to every other recording.

    Every row is counted once, in the slot between the recordings' sorted thresholds it falls in;
    the rates of all (trained on, applied to) pairs are then sums over a recording's few slots.
    """
    thr = cut_lineage(roc_operating_points(df, [rec], score, y).filter("op = 'equal_error'").select(F.col(rec).alias("trained_on"), "thr"))
    steps = thr.agg(F.sort_array(F.collect_set("thr")).alias("t")).scalar()
    rows = _labelled(df, [rec], score, y).withColumn("_t", steps).withColumn("_slot", F.size(F.filter("_t", lambda c: c <= F.col("s"))))
    slots = rows.groupBy(rec, "_slot").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    per = slots.groupBy(rec).agg(F.collect_list(F.struct("_slot", "p", "n")).alias("_h"), F.sum("p").alias("_P"), F.sum("n").alias("_N"))
    pairs = thr.agg(F.collect_list(F.struct("trained_on", "thr")).alias("l")).scalar()
    wanted = per.withColumns({"_l": pairs, "_t": steps}).withColumn("t", F.explode("_l")).filter(F.col(rec) != F.col("t.trained_on"))
    reach = F.size(F.filter("_t", lambda c: c <= F.col("t.thr")))
    wanted = wanted.withColumn("_reach", reach)

    def above(f):
        return F.aggregate(F.filter("_h", lambda h: h["_slot"] >= F.col("_reach")), F.lit(0).cast("bigint"), lambda acc, h: acc + h[f])

    return wanted.select(F.col("t.trained_on").alias("trained_on"), F.col(rec).alias("applied_to"), F.col("t.thr").alias("thr"),
                         (above("n") / F.greatest("_N", F.lit(1))).alias("fpr"), (1 - above("p") / F.greatest("_P", F.lit(1))).alias("fnr"))


def detector_crosstalk(df: DataFrame, detectors: dict[str, float], klass: str) -> DataFrame:
    """Firing rate of each detector on each class of windows."""
    flags = [F.avg((F.col(c) >= thr).cast("double")).alias(c) for c, thr in detectors.items()]
    rates = df.groupBy(klass).agg(*flags)
    return rates.unpivot([klass], list(detectors), "detector", "fire_rate")


def ranked(df: DataFrame, value="auc") -> DataFrame:
    return df.withColumn("distance", F.abs(F.col(value) - 0.5)).orderBy(F.desc("distance"))


def uncertainty_topk(df: DataFrame, p: str, ident: str, k: int) -> DataFrame:
    return df.orderBy(F.abs(F.col(p) - 0.5), ident).limit(k)


def random_batch(df: DataFrame, ident: str, k: int, seed=0) -> DataFrame:
    """k rows in hashed order: random, repeatable, and a top-k instead of a full shuffle."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(ident)), ident).limit(k)


# --- severity and kinematics ------------------------------------------------------------------

def severity_stats(faults: DataFrame, key: str) -> DataFrame:
    """Mean burst length, median lap and fault-time share per severity level."""
    from ..kernels.ordered import Lag

    f = faults.withColumns({"_c": ((F.col("start_us") + F.col("end_us")) / 2), "_len": (F.col("end_us") - F.col("start_us")) / 1e6})
    seq = Seq.by_time([key], "start_us", ["label_id"])
    laps = ordered(f, seq, Lag("_p", "_c")).withColumn("_lap", (F.col("_c") - F.col("_p")) / 1e6)
    lap = exact_percentiles(laps, [key], "_lap", {"median_lap_s": 0.5})
    pos = F.struct("start_us", "label_id")
    agg = f.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean_s"),
                             (F.sum("_len") / ((F.max_by("_c", pos) - F.min_by("_c", pos)) / 1e6)).alias("fault_share"))
    return agg.join(lap, key, "left").withColumn("median_lap_s", F.when(F.col("n") > 2, F.col("median_lap_s")))


def kinematic_speed(faults: DataFrame, key: str, box_len_m=0.4, roller_d_m=0.05) -> DataFrame:
    """Belt speed from the median of the shorter half of burst lengths.

    Whether a burst is in the shorter half follows from the running count of lengths, not a sort per key.
    """
    f = faults.withColumn("_len", (F.col("end_us") - F.col("start_us")) / 1e6)
    n = f.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    cum = cumulative_by_value(f, [key], "_len", {"n": "count(1)"}).join(n, key)
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    # Order statistics around the middle of the kept half.
    lo, hi = F.floor((keep - 1) / 2), F.floor(keep / 2)
    med = cum.groupBy(key).agg(F.min(F.when(F.col("cum_n") > lo, F.col("_len"))).alias("_a"), F.min(F.when(F.col("cum_n") > hi, F.col("_len"))).alias("_b"))
    burst = (F.col("_a") + F.col("_b")) / 2
    return med.select(key, burst.alias("burst_s"), (box_len_m / burst).alias("v_m_s"), (box_len_m / burst / (float(np.pi) * roller_d_m)).alias("roller_hz"))


# --- similarity clusters ----------------------------------------------------------------------

def _fields(df: DataFrame, names) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in names)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["_z"].to_numpy()).astype(float)


def _correlation(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of standardised rows and the angles between them; a row without variation is at 90 degrees to all."""
    corr = x @ y.T / x.shape[1]
    size = np.sqrt((x * x).mean(axis=1))[:, None] * np.sqrt((y * y).mean(axis=1))[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        cos = np.nan_to_num(corr / size, nan=0.0, posinf=0.0, neginf=0.0)
    return corr, np.arccos(np.clip(cos, -1.0, 1.0))


def _first_earlier(early: pd.DataFrame, late: pd.DataFrame, corr: np.ndarray, threshold: float) -> np.ndarray:
    """Of each late row (columns of ``corr``) the first earlier row above the threshold, -1 for none."""
    at = early["_i"].to_numpy()
    hit = (corr > threshold) & (at[:, None] < late["_i"].to_numpy()[None, :])
    return np.where(hit.any(axis=0), at[hit.argmax(axis=0)], -1)


def _by_pivot(rows: DataFrame, group, rank: str, pivots: int, block: int, threshold: float) -> DataFrame:
    """(group, _i, _pivot, _angle, _parent): the nearest of the first ``pivots`` rows of a group (by ``rank``), the angle
    to it, and the first of those rows that is earlier and above the threshold (-1: none)."""
    rows = rows.withColumn("_blk", slot(F.col(rank) - 1, block))
    last = rows.groupBy(*group).agg(F.max("_blk").alias("_last"))
    copies = rows.filter(F.col(rank) <= pivots).drop("_blk").join(last, group).withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
    cols = [*group, "_blk", "_i", "_z"]

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        p, a = pdf[pdf._is_pivot].sort_values("_i"), pdf[~pdf._is_pivot]
        corr, angle = _correlation(_matrix(p), _matrix(a))
        near = angle.argmin(axis=0)
        out = a[[*group, "_i"]].copy()
        out["_pivot"], out["_angle"] = p["_i"].to_numpy()[near], angle[near, np.arange(len(a))]
        out["_parent"] = _first_earlier(p, a, corr, threshold)
        return out

    both = rows.select(*cols, F.lit(False).alias("_is_pivot")).unionByName(copies.select(*cols, F.lit(True).alias("_is_pivot")))
    return both.groupBy(*group, "_blk").applyInPandas(deal, _fields(rows, group) + "_i bigint, _pivot bigint, _angle double, _parent bigint")


def _near_leaves(leaves: DataFrame, keys, reach: float, block: int) -> DataFrame:
    """(keys, _home, _leaf): leaves that may hold an earlier partner of an open row of ``_leaf``, by the triangle inequality."""
    n = ordered(leaves, Seq(tuple(keys), ("_leaf",), "_leaf div 100000"), RowNo("_l")).withColumn("_t", slot(F.col("_l") - 1, block))
    n = n.join(n.groupBy(*keys).agg(F.max("_t").alias("_last")), keys)
    cols = ["_leaf", "_z", "_rad", "_first", "_open_last"]
    early = n.select(*keys, *cols, F.col("_t").alias("_a"), F.explode(F.sequence("_t", "_last")).alias("_b"), F.lit(True).alias("_early"))
    late = n.select(*keys, *cols, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_t"))).alias("_a"), F.col("_t").alias("_b"), F.lit(False).alias("_early"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf._early], pdf[~pdf._early]
        angle = _correlation(_matrix(a), _matrix(b))[1]
        close = angle <= a["_rad"].to_numpy()[:, None] + b["_rad"].to_numpy()[None, :] + reach
        ways = [(a, b, close)] + ([(b, a, close.T)] if pdf["_a"].iat[0] != pdf["_b"].iat[0] else [])
        out = []
        for home, query, ok in ways:
            i, j = np.nonzero(ok & (home["_first"].to_numpy()[:, None] < query["_open_last"].to_numpy()[None, :]))
            part = home.iloc[i][[*keys]].copy()
            part["_home"], part["_leaf"] = home["_leaf"].to_numpy()[i], query["_leaf"].to_numpy()[j]
            out.append(part)
        return pd.concat(out)

    return early.unionByName(late).groupBy(*keys, "_a", "_b").applyInPandas(near, _fields(leaves, keys) + "_home bigint, _leaf bigint")


def partner_candidates(rows: DataFrame, keys, threshold: float, block: int, pivots: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What has to be compared to find each row's first earlier partner, of rows (keys, _i numbered from 1, _z standardised).

    Rows are dealt to the nearest of the key's first ``pivots`` rows. In each such cell the first ``pivots`` rows become
    centres of leaves, rows close to one join it, and the others try again with the first of them, ``rounds`` times; who
    is left forms wide leaves. A row with a partner among the key's first rows is finished; one with a partner among
    centres need only look before that. For the others two leaves can hold partners only if the angle between their
    centres is at most both radii and the threshold's angle. Close means that uncorrelated leaves are told apart so.

    Returns (keys, _i, _parent) found on the way, the rows with ``_leaf`` and ``_piece`` (at most ``block`` rows in the
    leaf's order), and (keys, _home, _piece, _i): which row has to be compared with which piece of which leaf.
    """
    # angles are known to about 1e-8; no angle bounds the partners under a negative threshold
    reach = float(np.arccos(min(threshold, 1.0))) + 1e-6 if threshold >= 0 else 2 * float(np.pi)
    tight = 0.4 * max(float(np.pi) / 2 - reach, 0.0)
    first = _by_pivot(rows, keys, "_i", pivots, block, threshold).select(
        *keys, "_i", F.col("_pivot").alias("_cell"), F.col("_parent").alias("_sure"), F.lit(None).cast("bigint").alias("_best"))
    cell = Seq((*keys, "_cell"), ("_i",), "_i div 100000")
    cols = [*keys, "_i", "_z", "_cell", "_sure", "_best"]
    loose, parts = cut_lineage(ordered(rows.join(first, [*keys, "_i"]).select(*cols), cell, RowNo("_r")).select(*cols, "_r")), []
    for k in range(rounds):
        dealt = _by_pivot(loose, [*keys, "_cell"], "_r", pivots, block, threshold).select(*keys, "_i", "_pivot", "_angle", F.col("_parent").alias("_hit"))
        best = F.least("_best", F.when(F.col("_hit") >= 0, F.col("_hit")))
        tried = cut_lineage(loose.drop("_r").join(dealt, [*keys, "_i"]).withColumn("_best", best))
        close = F.col("_angle") <= tight
        parts.append(tried.filter(close).withColumn("_leaf", F.col("_pivot")))
        rest = tried.filter(~close)
        if k == rounds - 1 or tight == 0.0:
            parts.append(rest.withColumn("_leaf", -F.col("_pivot")))
            break
        loose = cut_lineage(ordered(rest.select(*cols), cell, RowNo("_r")).select(*cols, "_r"))
        if loose.isEmpty():
            break
    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    # all rows before row pivots + 1 are pivots, so up to there the first step has decided
    opened = (F.col("_sure") < 0) & (F.col("_i") > pivots + 1)
    home = ordered(members, Seq((*keys, "_leaf"), ("_i",), "_i div 100000"), RowNo("_r"))
    home = cut_lineage(home.select(*keys, "_i", "_z", "_leaf", "_angle", "_sure", "_best", opened.alias("_open"), slot(F.col("_r") - 1, block).alias("_piece")))
    leaves = home.groupBy(*keys, "_leaf").agg(
        F.max("_angle").alias("_rad"), F.min("_i").alias("_first"), F.coalesce(F.max(F.when(F.col("_open"), F.col("_i"))), F.lit(-1)).alias("_open_last"))
    leaves = leaves.withColumn("_i", F.abs("_leaf")).join(rows.select(*keys, "_i", "_z"), [*keys, "_i"]).drop("_i")
    pairs = _near_leaves(leaves, keys, reach, block)
    starts = home.groupBy(*keys, "_leaf", "_piece").agg(F.min("_i").alias("_first")).groupBy(*keys, F.col("_leaf").alias("_home")).agg(
        F.sort_array(F.collect_list("_first")).alias("_starts"))
    before = F.coalesce("_best", "_i")
    n = F.size(F.filter("_starts", lambda f: f < F.col("_before")))
    want = home.filter("_open").select(*keys, "_i", "_leaf", before.alias("_before")).join(pairs, [*keys, "_leaf"]).join(starts, [*keys, "_home"]).withColumn("_n", n)
    want = want.filter("_n > 0").select(*keys, "_home", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint") - 1)).alias("_piece"), "_i")
    found = home.select(*keys, "_i", F.when(F.col("_sure") >= 0, F.col("_sure")).otherwise(F.col("_best")).alias("_parent")).filter("_parent IS NOT NULL")
    return found, home, cut_lineage(want)


def first_partners(rows: DataFrame, keys, threshold: float, block: int, pivots: int, rounds: int) -> DataFrame:
    """(keys, _i, _parent): the first earlier row of the key above the threshold, for rows that have one.

    A piece and ``block`` of the rows that ask for it are one matrix product; a piece in demand is copied.
    """
    found, home, want = partner_candidates(rows, keys, threshold, block, pivots, rounds)
    piece = [*keys, "_home", "_piece"]
    demand = want.groupBy(*piece).agg((slot(F.count(F.lit(1)) - 1, block) + 1).alias("_parts"))
    late = want.join(demand, piece).join(rows.select(*keys, "_i", "_z"), [*keys, "_i"]).select(
        *piece, F.pmod(F.xxhash64("_i"), F.col("_parts")).alias("_q"), "_i", "_z", F.lit(False).alias("_early"))
    early = home.withColumnRenamed("_leaf", "_home").join(demand, piece).select(
        *piece, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_q"), "_i", "_z", F.lit(True).alias("_early"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf._early].sort_values("_i"), pdf[~pdf._early]
        out = b[[*keys, "_i"]].copy()
        out["_parent"] = _first_earlier(a, b, _correlation(_matrix(a), _matrix(b))[0], threshold) if len(b) else -1
        return out[out["_parent"] >= 0]

    compared = early.unionByName(late).groupBy(*piece, "_q").applyInPandas(tile, _fields(rows, keys) + "_i bigint, _parent bigint")
    return found.unionByName(compared).groupBy(*keys, "_i").agg(F.min("_parent").alias("_parent"))


def correlation_clusters(df: DataFrame, keys, ident: str, vec: str, threshold=0.5, block=512, pivots=64, rounds=4) -> DataFrame:
    """Greedy clusters of correlated vectors: each row joins the first earlier row above ``threshold``.

    Caps around pivots tell which blocks of rows have to be compared (``partner_candidates``); chains of parents are
    then shortened by doubling.
    """
    keys = list(keys)
    n = F.size("_v")
    mean = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    rows = df.select(*keys, ident, F.col(vec).alias("_v")).withColumn("_mean", mean)
    var = F.aggregate("_v", F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean"))) / n
    rows = rows.withColumn("_sd", F.sqrt(var) + 1e-9).select(
        *keys, ident, F.transform("_v", lambda v: ((v - F.col("_mean")) / F.col("_sd")).cast("double")).alias("_z"))
    seq = Seq(tuple(keys), (ident,), f"{ident} div 100000")
    rows = cut_lineage(ordered(rows, seq, RowNo("_i")).select(*keys, ident, F.col("_i").cast("bigint").alias("_i"), "_z"))
    best = first_partners(rows.drop(ident), keys, threshold, block, pivots, rounds)
    tree = cut_lineage(rows.select(*keys, ident, "_i").join(best, [*keys, "_i"], "left").withColumn("_parent", F.coalesce("_parent", "_i")))
    while True:
        up = tree.select(*keys, F.col("_i").alias("_parent"), F.col("_parent").alias("_up"))
        nxt = cut_lineage(tree.join(up, [*keys, "_parent"]).select(*keys, ident, "_i", F.col("_up").alias("_new"), (F.col("_up") != F.col("_parent")).alias("_moved")))
        tree = nxt.select(*keys, ident, "_i", F.col("_new").alias("_parent"))
        if nxt.filter("_moved").isEmpty():
            break
    roots = tree.filter("_parent = _i").select(*keys, F.col("_i").alias("_parent"))
    no = ordered(roots, Seq(tuple(keys), ("_parent",), "_parent div 100000"), RowNo("_c")).select(*keys, "_parent", (F.col("_c") - 1).alias("location"))
    return tree.join(no, [*keys, "_parent"]).select(*keys, ident, "location")


# --- region and threshold search --------------------------------------------------------------

def best_roi_topk(pixels: DataFrame, height: int, width: int, roi_h: int, roi_w: int, stride=2) -> DataFrame:
    """Box with the largest mean of a per-pixel map ``(y, x, diff)``; one image-sized map, summed by prefix sums."""
    rows = Window.partitionBy("y").orderBy("x")
    cols = Window.partitionBy("x").orderBy("y")
    s = pixels.withColumn("_r", F.sum("diff").over(rows)).withColumn("sat", F.sum("_r").over(cols)).select("y", "x", "sat")
    # Each prefix sum is a corner of up to four boxes, told apart by the box origin.
    parts = []
    for dy, dx, sign in ((roi_h, roi_w, 1.0), (0, roi_w, -1.0), (roi_h, 0, -1.0), (0, 0, 1.0)):
        parts.append(s.select((F.col("y") + 1 - dy).alias("y"), (F.col("x") + 1 - dx).alias("x"), (sign * F.col("sat")).alias("v")))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    ok = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height - roi_h) & (F.col("x") < width - roi_w) & (
        F.col("y") % stride == 0) & (F.col("x") % stride == 0)
    mean = allp.filter(ok).groupBy("y", "x").agg((F.sum("v") / (roi_h * roi_w)).alias("score"))
    return mean.orderBy(F.desc(F.round("score", 12)), "y", "x").limit(1)
