"""Track geometry: the four-leg loop, grid zones, and the figure-8 ring map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Centre-to-centre leg lengths (cm) clockwise BR -> BL -> TL -> TR, wheel pitch.
WHEEL_CM = 15.0
CORNERS = ("BR", "BL", "TL", "TR")
LEGS = (160.0, 460.0, 160.0, 460.0)
STARTS = (0.0, 160.0, 620.0, 780.0)
LAP = 1240.0


def cum_to_xy(cum: Column) -> Column:
    """Distance along the loop to a struct ``(x, y, piece)`` on the 120 x 420 cm rectangle."""
    p = F.pmod(cum.cast("double"), F.lit(LAP))

    def at(x, y, piece):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(piece).alias("piece"))

    f = [(p - F.lit(s)) / F.lit(n) for s, n in zip(STARTS, LEGS)]
    return (F.when(p < STARTS[1], at(120 - 120 * f[0], F.lit(0), "bottom"))
            .when(p < STARTS[2], at(F.lit(0), 420 * f[1], "left"))
            .when(p < STARTS[3], at(120 * f[2], F.lit(420), "top"))
            .otherwise(at(F.lit(120), 420 - 420 * f[3], "right")))


def segment_grid(x: Column, y: Column, line: Column) -> Column:
    """Coarse 5 m zone: row letter and column number."""
    row = F.chr((F.lit(65) + F.pmod(F.greatest(F.lit(0), F.floor(y / 5).cast("int")), F.lit(26))).cast("int"))
    return F.concat(line, F.lit(".station-"), row, F.floor(x / 5).cast("int").cast("string"))


# The two rings as ordered piece names, and the three piece types (cm, big wheels).
RINGS = {
    "upper": "TT_TL U_TOP1 U_TOP2 TT_TR U_RGT TT_MR M_BAR2 M_BAR1 TT_ML U_LFT",
    "lower": "TT_MR L_R1 L_R2 L_R3 L_R4 L_R5 TT_BR L_BOT2 L_BOT1 TT_BL L_L4 L_L3 L_L2 L_L1 TT_ML M_BAR1 M_BAR2",
}
TURN, STRAIGHT2, STRAIGHT4 = (0.0, 0), (60.0, 4), (120.0, 8)
LONG_PIECES = ("L_R3", "L_L3", "L_L4")


def piece_size(piece: str):
    return TURN if piece.startswith("TT_") else STRAIGHT4 if piece in LONG_PIECES else STRAIGHT2


def rings(spark: SparkSession) -> DataFrame:
    rows = [(loop, i, p, *piece_size(p)) for loop, ring in RINGS.items() for i, p in enumerate(ring.split())]
    return spark.createDataFrame(rows, "loop string, pos int, piece string, length_cm double, wheels int")


def ring_prefix_sum(ring: DataFrame) -> DataFrame:
    """Distance and wheel count at the start of each piece and its junction ids.

    A ring is a description of the track (tens of pieces), so a window per loop is bounded.
    """
    w = Window.partitionBy("loop").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev = F.coalesce(F.lag("piece").over(w), F.last("piece").over(whole))
    nxt = F.coalesce(F.lead("piece").over(w), F.first("piece").over(whole))
    zero = F.lit(0)
    return ring.withColumns({
        "point_in": F.concat(F.lit("J:"), prev, F.lit("->"), F.col("piece")),
        "point_out": F.concat(F.lit("J:"), F.col("piece"), F.lit("->"), nxt),
        "cum_cm_start": F.coalesce(F.sum("length_cm").over(before), zero.cast("double")),
        "cum_wheels_start": F.coalesce(F.sum("wheels").over(before), zero).cast("bigint"),
        "loop_cm": F.sum("length_cm").over(whole),
        "loop_wheels": F.sum("wheels").over(whole).cast("bigint"),
    })


def _place(df: DataFrame, ring: DataFrame, amount: str, total: str, start: str, length: str) -> DataFrame:
    """Put each row on its piece; the ring map is tens of rows, so it is broadcast."""
    nodes = ring_prefix_sum(ring).withColumnRenamed("loop", "_loop")
    total_of = F.broadcast(nodes)
    at = F.pmod(F.col(amount), F.col(total))
    cond = ((df["loop"] == nodes["_loop"]) & (at >= F.col(start)) & (at < F.col(start) + F.col(length)))
    return df.join(total_of, cond).withColumn(
        "pct", 100.0 * (at - F.col(start)) / F.col(length)).withColumn("_at", at)


def cm_to_pos(df: DataFrame, ring: DataFrame, cm: str = "cm") -> DataFrame:
    out = _place(df, ring, cm, "loop_cm", "cum_cm_start", "length_cm")
    return out.select(*df.columns, "piece", F.round("pct", 1).alias("pct"), "point_in", "point_out",
                      F.round("_at", 2).alias("cum_cm"))


def wheels_to_pos(df: DataFrame, ring: DataFrame, wheels: str = "wheel_count") -> DataFrame:
    out = _place(df, ring, wheels, "loop_wheels", "cum_wheels_start", "wheels")
    return out.select(*df.columns, "piece", F.round("pct", 1).alias("pct"), "point_in", "point_out",
                      F.col("_at").alias("cum_wheels"))


def pos_to_cm(df: DataFrame, ring: DataFrame) -> DataFrame:
    nodes = ring_prefix_sum(ring).select("loop", "piece", "cum_cm_start", "length_cm")
    return df.join(F.broadcast(nodes), ["loop", "piece"]).withColumn(
        "cm", F.col("cum_cm_start") + F.col("pct") / 100.0 * F.col("length_cm")).select(*df.columns, "cm")


def undirected_edges(ring: DataFrame) -> DataFrame:
    """Distinct unordered pairs of neighbouring pieces, with a stable point id."""
    w = Window.partitionBy("loop").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.lead("piece").over(w), F.first("piece").over(whole))
    pairs = ring.select(F.least("piece", nxt).alias("a"), F.greatest("piece", nxt).alias("b")).distinct()
    order = Window.orderBy("a", "b")  # tens of junctions
    return pairs.withColumn("point_id", F.format_string("P%02d", F.row_number().over(order) - 1))
