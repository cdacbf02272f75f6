"""Interval joins as bucketed equi-joins (no nested-loop join, no per-key cross product)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import slot


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys, t: str, start: str,
                        end: str, bucket: int, how: str = "inner", closed: bool = False) -> DataFrame:
    """Join each point to the intervals with ``start <= t < end`` (``<= end`` when closed)."""
    keys = list(keys)
    last = F.col(end) if closed else F.col(end) - 1
    spans = intervals.filter(last >= F.col(start)).withColumn(
        "_b", F.explode(F.sequence(slot(F.col(start), bucket), slot(last, bucket)))
    )
    renamed = spans.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k_b"),
                           *[c for c in spans.columns if c not in keys and c != "_b"])
    left = points.withColumn("_b", slot(F.col(t), bucket))
    cond = [left[k] == renamed[f"_k_{k}"] for k in keys] + [left["_b"] == renamed["_k_b"]]
    inside = (left[t] >= renamed[start]) & (
        (left[t] <= renamed[end]) if closed else (left[t] < renamed[end]))
    joined = left.join(renamed, [*cond, inside], how)
    return joined.drop("_b", "_k_b", *[f"_k_{k}" for k in keys])


def overlapping(left: DataFrame, right: DataFrame, keys, l_span, r_span, bucket: int) -> DataFrame:
    """Pairs of closed intervals that touch; each pair comes out once.

    Both sides are spread over the buckets they cover and a pair is kept only in the bucket where
    the later of the two starts.
    """
    keys = list(keys)
    (ls, le), (rs, re) = l_span, r_span

    def spread(df, s, e, b):
        return df.filter(F.col(e) >= F.col(s)).withColumn(
            b, F.explode(F.sequence(slot(F.col(s), bucket), slot(F.col(e), bucket))))

    a = spread(left, ls, le, "_b")
    b = spread(right, rs, re, "_rb")
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                 *[c for c in b.columns if c not in keys])
    cond = [a[k] == b[f"_k_{k}"] for k in keys] + [a["_b"] == b["_rb"]]
    touch = (a[ls] <= b[re]) & (b[rs] <= a[le])
    once = a["_b"] == slot(F.greatest(a[ls], b[rs]), bucket)
    return a.join(b, [*cond, touch, once]).drop("_b", "_rb", *[f"_k_{k}" for k in keys])


def touching(left: DataFrame, right: DataFrame, keys, l_span, r_span, ident, bucket: int) -> DataFrame:
    """Distinct ``(keys, ident)`` of left intervals that touch any right interval (semi-join, no pairs)."""
    keys = list(keys)
    (ls, le), (rs, re) = l_span, r_span
    a = left.filter(F.col(le) >= F.col(ls)).withColumn(
        "_b", F.explode(F.sequence(slot(F.col(ls), bucket), slot(F.col(le), bucket))))
    b = right.filter(F.col(re) >= F.col(rs)).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(rs).alias("_rs"), F.col(re).alias("_re"),
        F.explode(F.sequence(slot(F.col(rs), bucket), slot(F.col(re), bucket))).alias("_rb"))
    cond = [a[k] == b[f"_k_{k}"] for k in keys] + [
        a["_b"] == b["_rb"], a[ls] <= b["_re"], b["_rs"] <= a[le]]
    return a.join(b, cond, "left_semi").select(*keys, ident).distinct()


def _bucketed(left: DataFrame, right: DataFrame, keys, name: str, run, extra: dict) -> DataFrame:
    """``run`` over the Arrow tables of each (keys, ``name``); null keys meet nothing. ``extra`` has the types of its added columns."""
    keys = list(keys)
    some = right.dropna(subset=keys) if keys else right
    both = left.groupBy(*keys, name).cogroup(some.groupBy(*keys, name))
    fields = {f.name: f.dataType for f in left.schema.fields} | extra
    return both.applyInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields.items()])).drop(name)


def _places(rows: list[int]) -> pa.Array:
    return pa.array(rows, pa.int64())


def latest_open(at: list, starts: list, ends: list) -> list[int]:
    """For each rising time the last of the intervals (in order of their starts) with ``start <= t < end``, or -1.

    A stack holds what has begun; its top leaves once it has ended, so each interval comes and goes once.
    """
    out, stack, i, n = [], [], 0, len(starts)
    for t in at:
        while i < n and starts[i] <= t:
            stack.append(i)
            i += 1
        while stack and ends[stack[-1]] <= t:
            stack.pop()
        out.append(stack[-1] if stack else -1)
    return out


def last_covering(points: DataFrame, intervals: DataFrame, keys, t: str, start: str, end: str, tie: str, ident: str,
                  bucket: int) -> DataFrame:
    """Points with ``_ident`` of the last interval, by (start, tie), with ``start <= t < end``; others are left out.

    No pair of point and interval is made: both are dealt to time buckets and swept once in order.
    """
    keys = list(keys)
    last = F.col(end) - 1
    spans = intervals.filter(last >= F.col(start)).select(
        *keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(tie).alias("_tie"), F.col(ident).alias("_ident"),
        F.explode(F.sequence(slot(F.col(start), bucket), slot(last, bucket))).alias("_b"))
    left = points.filter(F.col(t).isNotNull()).withColumn("_b", slot(F.col(t), bucket))

    def run(pts, ivs):
        pts, ivs = pts.sort_by(t), ivs.sort_by([("_s", "ascending"), ("_tie", "ascending")])
        at = latest_open(pts[t].to_pylist(), ivs["_s"].to_pylist(), ivs["_e"].to_pylist())
        rows = [i for i, a in enumerate(at) if a >= 0]
        return pts.take(_places(rows)).append_column("_ident", ivs["_ident"].take(_places([at[i] for i in rows])))

    return _bucketed(left, spans, keys, "_b", run, {"_ident": intervals.schema[ident].dataType})


def widest(t0: list, t1: list, starts: list, ends: list) -> list[tuple[int, int]]:
    """For each window (overlap, interval) of the interval, first in order of starts, that covers most of it; (0, -1) if none does.

    Of the intervals that began before a window, the first whose end reaches furthest counts (a bisection in the rising
    record ends). Of those that begin in it, the longest that also ends in it, from a tree of those that have ended, and
    the first that has not ended.
    """
    n = len(starts)
    rec_at, rec_end = [], []
    for i, e in enumerate(ends):
        if not rec_end or e > rec_end[-1]:
            rec_at.append(i)
            rec_end.append(e)
    tree, behind = [0] * (n + 1), list(range(n + 1))
    by_end, done, out = sorted(range(n), key=ends.__getitem__), 0, [(0, -1)] * len(t0)
    for w in sorted(range(len(t0)), key=t1.__getitem__):
        a, z = t0[w], t1[w]
        while done < n and ends[by_end[done]] <= z:
            i = by_end[done]
            # the longest, and of equal ones the first, is the greatest number
            code, k = (ends[i] - starts[i]) * (n + 1) + n - i, n - i
            while k <= n:
                if tree[k] < code:
                    tree[k] = code
                k += k & -k
            behind[i] = i + 1
            done += 1
        p = bisect_right(starts, a)
        best = (0, 0)
        k = bisect_left(rec_at, p)
        if k:
            x = min(rec_end[k - 1], z)
            best = max(best, (x - a, -rec_at[bisect_left(rec_end, x, 0, k)]))
        code, k = 0, n - p
        while k > 0:
            code = max(code, tree[k])
            k &= k - 1
        if code:
            size, rest = divmod(code, n + 1)
            best = max(best, (size, rest - n))
        i = p
        while behind[i] != i:
            behind[i] = behind[behind[i]]
            i = behind[i]
        if i < n and starts[i] < z:
            best = max(best, (z - starts[i], -i))
        if best[0] > 0:
            out[w] = (best[0], -best[1])
    return out


def widest_overlap(windows: DataFrame, intervals: DataFrame, keys, w_span, i_span, tie: str, ident: str, bucket: int) -> DataFrame:
    """Windows with ``_ov``, ``_start``, ``_ident`` of the interval that covers most of them, the first by (start, tie) of equal ones.

    A row for each bucket that a window touches, with the best of that bucket; windows that nothing overlaps are left out.
    """
    keys = list(keys)
    (t0, t1), (start, end) = w_span, i_span

    def spread(df, a, z):
        return df.filter(F.col(z) > F.col(a)).withColumn("_b", F.explode(F.sequence(slot(F.col(a), bucket), slot(F.col(z) - 1, bucket))))

    right = spread(intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(tie).alias("_tie"),
                                    F.col(ident).alias("_ident")), "_s", "_e")

    def run(wins, ivs):
        ivs = ivs.sort_by([("_s", "ascending"), ("_tie", "ascending")])
        found = widest(wins[t0].to_pylist(), wins[t1].to_pylist(), ivs["_s"].to_pylist(), ivs["_e"].to_pylist())
        rows = [i for i, f in enumerate(found) if f[1] >= 0]
        at = _places([found[i][1] for i in rows])
        return wins.take(_places(rows)).append_column("_ov", pa.array([found[i][0] for i in rows], pa.int64())).append_column(
            "_start", ivs["_s"].take(at)).append_column("_ident", ivs["_ident"].take(at))

    extra = {"_ov": T.LongType(), "_start": T.LongType(), "_ident": intervals.schema[ident].dataType}
    return _bucketed(spread(windows, t0, t1), right, keys, "_b", run, extra)
