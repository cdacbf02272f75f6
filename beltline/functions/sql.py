"""Functions available by name in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.track import LAP, LEGS, STARTS


def register(spark: SparkSession) -> None:
    """``cum_to_xy``, ``segment_grid``, ``boundary_disposition``, ``l2_to_centroid`` as SQL functions (inlined by the
    optimizer, no Python) and ``clip_windows`` / ``window_ids`` as table functions."""
    p = f"pmod(cum, {LAP}D)"
    b = [f"({p} - {s}D) / {n}D" for s, n in zip(STARTS, LEGS)]

    def legs(bottom, left, top, right):
        return f"CASE WHEN {p} < {STARTS[1]} THEN {bottom} WHEN {p} < {STARTS[2]} THEN {left} WHEN {p} < {STARTS[3]} THEN {top} ELSE {right} END"

    x = legs(f"120D - 120D * {b[0]}", "0D", f"120D * {b[2]}", "120D")
    y = legs("0D", f"420D * {b[1]}", "420D", f"420D - 420D * {b[3]}")
    piece = legs("'bottom'", "'left'", "'top'", "'right'")
    for name, args, returns, body in (
        ("cum_to_xy", "cum DOUBLE", "STRUCT<x: DOUBLE, y: DOUBLE, piece: STRING>", f"named_struct('x', {x}, 'y', {y}, 'piece', {piece})"),
        ("segment_grid", "x DOUBLE, y DOUBLE, line STRING", "STRING",
         "concat(line, '.station-', chr(65 + pmod(greatest(0, CAST(floor(y / 5) AS INT)), 26)), CAST(CAST(floor(x / 5) AS INT) AS STRING))"),
        ("boundary_disposition", "class STRING", "STRING", "CASE WHEN class = 'inference' THEN 'egressed' ELSE 'blocked' END"),
        ("l2_to_centroid", "v ARRAY<DOUBLE>, c ARRAY<DOUBLE>", "DOUBLE",
         "sqrt(aggregate(zip_with(v, c, (a, b) -> (a - b) * (a - b)), 0D, (s, d) -> s + d))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("clip_windows", udtf(ClipWindows, returnType="clip int, t0 double, t1 double"))
    spark.udtf.register("window_ids", udtf(WindowIds, returnType="win bigint"))


class ClipWindows:
    """Clips of ``clip_s`` seconds tiling ``[0, total_s)``, numbered from 1; the last one is short."""

    def eval(self, total_s: float, clip_s: float):
        i = 0
        while i * clip_s < total_s:
            yield i + 1, i * clip_s, min((i + 1) * clip_s, total_s)
            i += 1


class WindowIds:
    """Windows of ``n`` samples every ``step`` that contain the 1-based sample ``i``."""

    def eval(self, i: int, n: int, step: int):
        for w in range(max(0, -(-(i - n) // step)), (i - 1) // step + 1):
            yield (w,)
