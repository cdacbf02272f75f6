"""Rolling statistics, runs, gaps and intervals along a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.ordered import Lag, Lead, RowNo, RunMax, RunSum, Seq, islands, ordered, row_frame
from ..kernels.ranges import last_covering, points_in_intervals, touching, widest_overlap
from ..session import cut_lineage

CHUNK_US = 60_000_000     # a minute of one key per chunk


def numbered(df, keys, t, ties=(), chunk_us=CHUNK_US, out="rn") -> DataFrame:
    """Dense 1-based position within each key."""
    return ordered(df, Seq.by_time(keys, t, ties, chunk_us), RowNo(out)).drop("_chunk")


def causal_rolling_mean(df, keys, index, value, n=10, out="smooth") -> DataFrame:
    """Trailing mean over ``n`` rows, partial at the head."""
    return row_frame(df, keys, index, n - 1, 0, {out: F.avg(value)})


def valid_rolling_mean(df, keys, index, value, n, out="smooth") -> DataFrame:
    """Full windows only; a series shorter than ``n`` gives its one overall mean."""
    full = row_frame(df, keys, index, n - 1, 0, {out: F.avg(value)}).filter(F.col(index) >= n)
    short = df.groupBy(*keys).agg(F.max(index).alias(index), F.avg(value).alias(out)).filter(F.col(index) < n)
    return full.select(*keys, index, out).unionByName(short.select(*keys, index, out))


def rolling_median_centered(df, keys, index, value, n=8, out="smooth") -> DataFrame:
    before = n // 2
    return row_frame(df, keys, index, before, n - 1 - before, {out: F.percentile(value, 0.5)})


def trend_slope(df, keys, index, value, n=60, eps=1e-3) -> DataFrame:
    """Least-squares slope of the last ``n`` values against their position, and its direction."""
    framed = row_frame(df, keys, index, n - 1, 0, {
        "_slope": F.regr_slope(F.col(value), F.col(index).cast("double")), "_n": F.count(value)})
    slope = F.when(F.col("_n") < 3, 0.0).otherwise(F.col("_slope"))
    return framed.withColumn("slope", slope).withColumn(
        "trend", F.when(F.col("slope") > eps, "rising").when(F.col("slope") < -eps, "falling").otherwise("stable")
    ).drop("_slope", "_n")


def gap_cluster_events(flagged: DataFrame, keys, t, tie, score, gap, chunk_us=CHUNK_US) -> DataFrame:
    """Events of flagged rows at most ``gap`` apart, with the time and height of their peak."""
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    runs = islands(flagged, seq, [t], f"cur.{t} - prev.{t} > {gap}", "event_no")
    return runs.groupBy(*keys, "event_no").agg(
        F.min(t).alias("start_us"), F.max(t).alias("end_us"), F.count(F.lit(1)).alias("n"),
        F.max(score).alias("peak_score"), F.min_by(t, F.struct(-F.col(score), t, tie)).alias("peak_us"))


def runs_min_k(df: DataFrame, keys, t, tie, flag, k, chunk_us=CHUNK_US) -> DataFrame:
    """Maximal runs of at least ``k`` consecutive flagged rows."""
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    runs = islands(df.withColumn("_f", F.expr(flag)), seq, ["_f"], "cur._f <> prev._f", "run_no").filter("_f")
    return runs.groupBy(*keys, "run_no").agg(
        F.min(t).alias("start_us"), F.max(t).alias("end_us"), F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= k).drop("run_no")


def runs_bridge_gap1(df: DataFrame, keys, t, tie, flag, min_run, hop, chunk_us=CHUNK_US, index=None) -> DataFrame:
    """Flagged runs bridging single unflagged rows; kept by flagged count and padded by ``hop``."""
    rows = df if index else numbered(df, keys, t, [tie], chunk_us, "_i")
    i = index or "_i"
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    runs = islands(rows.filter(flag), seq, [i], f"cur.{i} - prev.{i} > 2", "run_no")
    return runs.groupBy(*keys, "run_no").agg(
        (F.min(t) - hop).alias("start_us"), (F.max(t) + hop).alias("end_us"), F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_run).drop("run_no")


def run_gate_wheels(frames: DataFrame, keys, t="host_us", tie="frame_no", d0=0.4, net_thr=0.3,
                    streaming=True, chunk_us=CHUNK_US) -> DataFrame:
    """Wheels: runs of dark frames with enough motion, at their darkest frame.

    Streaming form: a run counts once a bright frame closed it.  Offline form: each accepted run is
    padded by one frame on both sides and runs whose pads meet are one wheel.
    """
    seq = Seq.by_time(keys, t, [tie], chunk_us)
    rows = ordered(frames.withColumn("_d", F.col("dark") > d0), seq, RowNo("_i"), Lead("_next", F.lit(True)))
    rows = islands(rows, seq, ["_d"], "cur._d <> prev._d", "_run").filter("_d")
    runs = rows.groupBy(*keys, "_run").agg(
        F.max("net").alias("max_net"), F.max("dark").alias("peak_dark"), F.min("_i").alias("_a"), F.max("_i").alias("_z"),
        F.min_by(F.struct(F.col(t).alias("t"), F.col(tie).alias("no")), F.struct(-F.col("dark"), t, tie)).alias("_p"),
        F.bool_and(F.col("_next").isNotNull()).alias("closed"),
    ).filter(F.col("max_net") >= net_thr)
    if streaming:
        return runs.filter("closed").select(*keys, F.col("_p.t").alias("t_us"), F.col("_p.no").alias("frame_no"), "peak_dark")
    order = Seq(tuple(keys), ("_a",), "(_a - pmod(_a, 100000L)) div 100000L", "_blk")
    runs = islands(runs, order, ["_a", "_z"], "cur._a - prev._z <= 3 = false", "_w")
    return runs.groupBy(*keys, "_w").agg(
        F.min_by("_p", F.struct(-F.col("peak_dark"), "_a")).alias("_p"), F.max("peak_dark").alias("peak_dark")).select(
        *keys, F.col("_p.t").alias("t_us"), F.col("_p.no").alias("frame_no"), "peak_dark")


def group_marks(marks: DataFrame, keys, no, gap, block=100_000) -> DataFrame:
    """Spans of marked frame numbers, bridging up to ``gap`` unmarked ones."""
    seq = Seq(tuple(keys), (no,), f"({no} - pmod({no}, {block}L)) div {block}L")
    runs = islands(marks.select(*keys, no).distinct(), seq, [no], f"cur.{no} - prev.{no} > {gap + 1}", "_g")
    return runs.groupBy(*keys, "_g").agg(F.min(no).alias("first_no"), F.max(no).alias("last_no")).drop("_g")


def merge_spans(spans: DataFrame, keys, a, z, block=100_000) -> DataFrame:
    """Union of integer spans; spans that overlap or are adjacent become one."""
    seq = Seq(tuple(keys), (a, z), f"({a} - pmod({a}, {block}L)) div {block}L")
    rows = ordered(spans.select(*keys, a, z).distinct(), seq, RunMax("_top", z))
    runs = islands(rows, seq, [a, "_top"], f"cur.{a} > prev._top + 1", "_g")
    return runs.groupBy(*keys, "_g").agg(F.min(a).alias(a), F.max(z).alias(z)).drop("_g")


def split_bursts(df: DataFrame, keys, order, dev_clock, min_len=8, block_us=CHUNK_US) -> DataFrame:
    """Rows tagged with their contiguous capture burst (the device clock rises); short ones dropped."""
    t, *ties = order
    seq = Seq.by_time(keys, t, ties, block_us)
    rows = islands(df, seq, [dev_clock], f"cur.{dev_clock} <= prev.{dev_clock}", "burst")
    size = rows.groupBy(*keys, "burst").agg(F.count(F.lit(1)).alias("burst_len")).filter(F.col("burst_len") >= min_len)
    return rows.drop(seq.name).join(size, [*keys, "burst"])


def sliding_sample_windows(df: DataFrame, keys, index, n: int, step: int) -> DataFrame:
    """One row per (sample, window it belongs to); window w covers samples ``w*step+1 .. w*step+n``.

    Windows that run past the end of the key are left in; ``full_windows`` drops them once counted.
    """
    i = F.col(index) - 1
    first = F.greatest(F.lit(0), F.call_function("div", i - (n - step), F.lit(step).cast("bigint")))
    first = F.when(i < n, F.lit(0)).otherwise(F.call_function("div", i - n, F.lit(step).cast("bigint")) + 1).cast("bigint")
    last = F.call_function("div", i, F.lit(step).cast("bigint"))
    return df.withColumn("win", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def window_label_overlap(windows, labels, keys, win_id, t0, t1, min_overlap=0.5, bucket=5_000_000) -> DataFrame:
    """Majority-overlap label; null unless it covers ``min_overlap`` of the window; the earlier label wins ties."""
    named = labels.withColumn("_named", F.struct("label_id", "label"))
    found = widest_overlap(windows.select(*keys, win_id, t0, t1), named, keys, (t0, t1), ("start_us", "end_us"), "label_id", "_named", bucket)
    best = found.groupBy(*keys, win_id).agg(
        F.max("_ov").alias("_ov"), F.min_by("_ident", F.struct(-F.col("_ov"), "_start", "_ident.label_id"))["label"].alias("label"))
    done = windows.join(best, [*keys, win_id], "left")
    enough = F.col("_ov") >= min_overlap * (F.col(t1) - F.col(t0))
    return done.withColumn("label", F.when(enough, F.col("label"))).drop("_ov")


def label_center(windows, labels, keys, win_id, center, names=None, bucket=5_000_000, out="y") -> DataFrame:
    """1 where a (named) half-open label covers the centre, else 0."""
    wanted = labels if names is None else labels.filter(F.col("label").isin(*names))
    hits = points_in_intervals(windows.select(*keys, win_id, center), wanted.select(*keys, "start_us", "end_us"),
                               keys, center, "start_us", "end_us", bucket, "left_semi").select(*keys, win_id)
    return windows.join(hits.withColumn("_h", F.lit(1)), [*keys, win_id], "left").withColumn(
        out, F.coalesce("_h", F.lit(0))).drop("_h")


def multi_class_label(windows, labels, keys, win_id, center, classes: dict[str, int], bucket=5_000_000) -> DataFrame:
    """Class of the last label (in start order) that covers the centre, its id, or -1."""
    wanted = labels.filter(F.col("label").isin(*classes))
    named = wanted.withColumn("_named", F.struct("label_id", "label"))
    hit = last_covering(windows.select(*keys, win_id, center), named, keys, center, "start_us", "end_us", "label_id", "_named", bucket)
    best = hit.groupBy(*keys, win_id).agg(F.max_by("_ident", center).alias("_l"))
    value = F.lit(-1)
    for name, v in classes.items():
        value = F.when(F.col("_l.label") == name, F.lit(v)).otherwise(value)
    return windows.join(best, [*keys, win_id], "left").withColumns({
        "y": F.when(F.col("_l").isNull(), -1).otherwise(value), "segment_id": F.coalesce("_l.label_id", F.lit(-1))}).drop("_l")


def event_interval_match(detections, truths, keys, det_id, truth_id, tol, bucket=5_000_000) -> DataFrame:
    """Existence match both ways: hits, false alarms (anti) and misses (anti)."""
    padded = truths.withColumns({"_s": F.col("start_us") - tol, "_e": F.col("end_us") + tol})
    hit_d = touching(detections, padded, keys, ("start_us", "end_us"), ("_s", "_e"), det_id, bucket)
    hit_t = touching(padded, detections, keys, ("_s", "_e"), ("start_us", "end_us"), truth_id, bucket)

    def tag(df, hits, ident, side, good, bad):
        return df.select(*keys, ident).join(hits.withColumn("_h", F.lit(True)), [*keys, ident], "left").select(
            *keys, F.lit(side).alias("side"), F.col(ident).alias("id"), F.when(F.col("_h"), good).otherwise(bad).alias("verdict"))

    return tag(detections, hit_d, det_id, "detection", "hit", "false_alarm").unionByName(
        tag(truths, hit_t, truth_id, "truth", "found", "missed"))


def _ranked(runs: DataFrame, truths: DataFrame, keys, pad: int, block: int) -> DataFrame:
    """Runs with lb and ub: how many truths end too early for the run, and how many begin early enough."""
    def counted(left, at, other, of, first: int, out: str):
        # ``first`` says whether a truth at the same place is counted
        both = left.withColumns({"_at": at, "_truth": F.lit(0)}).unionByName(
            other.select(*keys, of.alias("_at"), F.lit(1).alias("_truth")), allowMissingColumns=True)
        both = both.withColumn("_tie", F.col("_truth") * (1 - 2 * first))
        seq = Seq(tuple(keys), ("_at", "_tie"), f"(_at - pmod(_at, {block}L)) div {block}L", "_cell")
        return ordered(both, seq, RunSum(out, "_truth")).filter("_truth = 0").drop("_at", "_truth", "_tie", "_cell")

    lower = counted(runs, F.col("a"), truths, F.col("z") + 2 * pad, 1, "lb")
    return counted(lower, F.col("z") + 2 * pad, truths, F.col("a"), 0, "ub")


def _taken(p: int, lb, ub) -> tuple[int, int]:
    """Runs in order, each taking the first free truth in [lb, ub): the next free one after them, and how many were taken."""
    n = 0
    for low, high in zip(lb, ub):
        at = max(p, low)
        if at < high:
            p, n = at + 1, n + 1
    return p, n


def _match_in_order(runs: DataFrame, truths: DataFrame, keys, pad: int, block: int) -> DataFrame:
    """keys, matched: pairs of an in-order one-to-one match, where neither runs nor truths lie within each other.

    The first free truth only moves on, so it is all that a stretch of runs hands to the next. Runs are cut into chunks by their
    place. On entering one the free truth lies between the first that reaches its first run and the first
    that the run before cannot reach: a few, as such a truth lies within reach of both. Each chunk is
    matched for every one of them, the summaries are chained along the key, and nothing is matched twice.
    """
    import pandas as pd

    seq = Seq(tuple(keys), ("a", "z"), f"(a - pmod(a, {block}L)) div {block}L", "_cell")
    rows = ordered(_ranked(runs, truths, keys, pad, block), seq, Lag("_before", "ub")).filter("ub > lb")
    group = [*keys, "_cell"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "z"])
        lb, ub, low = pdf["lb"].tolist(), pdf["ub"].tolist(), int(pdf["lb"].iloc[0])
        before = pdf["_before"].iloc[0]
        high = low if pd.isna(before) else max(low, int(before))
        ends = [_taken(p, lb, ub) for p in range(low, high + 1)]
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in group}, "low": low, "leave": [e for e, _ in ends], "n": [n for _, n in ends]}])

    summaries = rows.select(*group, "a", "z", "lb", "ub", "_before").groupBy(*group).applyInPandas(summarise, f"{kinds}, low bigint, leave array<bigint>, n array<bigint>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        p, matched = 0, 0
        for low, leave, n in pdf.sort_values("_cell")[["low", "leave", "n"]].itertuples(index=False):
            i = max(p, low) - low
            p, matched = int(leave[i]), matched + int(n[i])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "matched": matched}])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return summaries.groupBy(*keys).applyInPandas(chain, f"{kinds}, matched bigint")


def greedy_interval_match(runs: DataFrame, truths: DataFrame, keys, pad=3, block=100_000) -> DataFrame:
    """Detected, false-positive and missed counts of an in-order one-to-one match: each run takes the first free truth within reach.

    Runs are matched chunk by chunk, so a recording without a pause is no single task. That needs runs, and truths, that do
    not lie within each other, as runs of frames do; where some do, their activity stretch (padded spans that chain
    together) is matched by itself, replayed in order.
    """
    import pandas as pd

    keys = list(keys)
    rows = runs.select(*keys, F.lit(1).alias("is_run"), F.col("first_no").alias("a"), F.col("last_no").alias("z")).unionByName(
        truths.select(*keys, F.lit(0).alias("is_run"), F.col("first_no").alias("a"), F.col("last_no").alias("z")))
    seq = Seq(tuple(keys), ("a", "z", "is_run"), f"(a - pmod(a, {block}L)) div {block}L")
    own = [RunMax(f"_top{k}", F.when(F.col("is_run") == k, F.col("z"))) for k in (0, 1)]
    rows = ordered(rows, seq, RunMax("_top", "z"), *own)
    rows = islands(rows, seq, ["a", "_top"], f"cur.a - prev._top >= {2 * pad}", "stretch")
    within = F.col("z") < F.when(F.col("is_run") == 1, F.col("_top1")).otherwise(F.col("_top0"))
    # The table of spans is small next to the frames and read several times below.
    rows = cut_lineage(rows.select(*keys, "stretch", "is_run", "a", "z", within.alias("within")))
    nested = cut_lineage(rows.filter("within").select(*keys, "stretch").distinct())

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        matched = 0
        for _, part in pdf.sort_values(["stretch", "a", "z"]).groupby("stretch", sort=False):
            free = list(part.loc[part.is_run == 0, ["a", "z"]].itertuples(index=False, name=None))
            for a, z in part.loc[part.is_run == 1, ["a", "z"]].itertuples(index=False, name=None):
                i = next((i for i, (ga, gz) in enumerate(free) if min(z, gz) - max(a, ga) + 2 * pad > 0), None)
                if i is not None:
                    free.pop(i)
                    matched += 1
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "matched": matched}])

    flat = rows.join(nested, [*keys, "stretch"], "left_anti")
    pairs = _match_in_order(flat.filter("is_run = 1").select(*keys, "a", "z"), flat.filter("is_run = 0").select(*keys, "a", "z"), keys, pad, block)
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", matched bigint"
    deep = rows.join(nested, [*keys, "stretch"], "left_semi").drop("within").groupBy(*keys, F.expr("stretch div 200")).applyInPandas(match, schema)
    sizes = rows.groupBy(*keys).agg(F.sum("is_run").alias("detected"), F.sum(1 - F.col("is_run")).alias("truths"))
    found = pairs.unionByName(deep).groupBy(*keys).agg(F.sum("matched").alias("_m"))
    matched = F.coalesce("_m", F.lit(0))
    return sizes.join(found, keys, "left").select(*keys, "detected", (F.col("detected") - matched).alias("fp"), (F.col("truths") - matched).alias("fn"))


def dedupe_anchors(gyro: DataFrame, recovered: DataFrame, keys, within_us=4_000_000) -> DataFrame:
    """Gyro anchors plus the recovered ones no gyro anchor lies closer than ``within_us`` to."""
    spans = gyro.select(*keys, F.col("t_us").alias("g0"), F.col("t_us").alias("g1"))
    near = recovered.withColumns({"_s": F.col("t_us") - within_us + 1, "_e": F.col("t_us") + within_us - 1})
    dup = touching(near, spans, keys, ("_s", "_e"), ("g0", "g1"), "t_us", 5_000_000)
    fresh = recovered.join(dup, [*keys, "t_us"], "left_anti")
    return gyro.select(*keys, "t_us", F.lit("gyro").alias("source")).unionByName(
        fresh.select(*keys, "t_us", F.lit("mag").alias("source")))


def lap_assign(centers, laps, keys, center="center_us", bucket=10_000_000) -> DataFrame:
    """Centres with the lap ``[lap_start, lap_end)`` they fall in and their phase within it."""
    hit = points_in_intervals(centers, laps, keys, center, "lap_start", "lap_end", bucket)
    span = F.col("lap_end") - F.col("lap_start")
    return hit.withColumn("phase", F.when(span > 0, (F.col(center) - F.col("lap_start")) / span).otherwise(0.0))


def lap_segmentation(landmarks: DataFrame, keys, t="t_us", chunk_us=24 * CHUNK_US) -> DataFrame:
    """Laps between consecutive landmarks; the open head and tail are no laps."""
    seq = Seq.by_time(keys, t, [], chunk_us)
    return ordered(landmarks, seq, Lead("lap_end", t)).filter("lap_end IS NOT NULL").select(
        *keys, F.col(t).alias("lap_start"), "lap_end")


def nominal_rate(df: DataFrame, keys, clock, order=None, positive_only=False, chunk_us=CHUNK_US) -> DataFrame:
    """Samples per second from the median step of a clock in µs, stepping in ``order``."""
    from ..kernels.quantiles import exact_percentiles

    t, *ties = order or [clock]
    seq = Seq.by_time(keys, t, ties, chunk_us)
    steps = ordered(df, seq, Lag("_p", clock)).withColumn("_d", F.col(clock) - F.col("_p"))
    if positive_only:
        steps = steps.filter("_d > 0")
    return exact_percentiles(steps, keys, "_d", {"_m": 0.5}).select(*keys, (1e6 / F.col("_m")).alias("fs"))
