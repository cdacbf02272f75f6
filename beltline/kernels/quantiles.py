"""Exact percentiles per group with bounded memory.

``percentile`` keeps every distinct value of a group in one aggregation buffer.  Here a quantile
sketch with a guaranteed rank error first brackets each wanted order statistic; only values inside
a bracket are counted one by one, of the rest the number and the value next to the bracket.  The
result is exact (linear interpolation between the two neighbouring order statistics); a rank that
its bracket does not hold is an error, never a wrong number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10_000          # sketch rank error is at most n / _ACCURACY
_MARGIN = 5 / _ACCURACY
_BELOW, _INSIDE, _ABOVE = -1, 0, 1


def exact_percentiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with one column per entry of ``probs``; nulls and NaN are ignored.

    Groups of every size take the same way. One task orders a thousandth of a key's rows at most, ties once.
    """
    keys = list(keys)
    names = list(probs)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    if not keys:
        keys, rows, bare = ["_all"], rows.withColumn("_all", F.lit(1)), True
    else:
        bare = False

    low = [max(p - _MARGIN, 0.0) for p in probs.values()]
    high = [min(p + _MARGIN, 1.0) for p in probs.values()]
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", low + high, _ACCURACY).alias("_s"),
    )
    m = len(names)
    brackets = F.array(*[
        F.struct(F.lit(i).alias("q"), F.col("_s")[i].alias("lo"), F.col("_s")[m + i].alias("hi"),
                 ((F.col("_n") - 1) * F.lit(float(p))).alias("h"))
        for i, p in enumerate(probs.values())
    ])
    sketch = sketch.select(*keys, brackets.alias("_br"))
    # Without keys the sketch is one row, read as a scalar subquery instead of a join.
    tagged = rows.withColumn("_br", sketch.select("_br").scalar()) if bare else rows.join(sketch, keys)
    side = F.when(F.col("_v") < F.col("_q.lo"), _BELOW).when(F.col("_v") > F.col("_q.hi"), _ABOVE).otherwise(_INSIDE)
    counted = (
        tagged.select(*keys, "_v", F.explode("_br").alias("_q"))
        .select(*keys, "_q.q", "_q.h", side.alias("side"), "_v")
        .withColumn("_at", F.when(F.col("side") == _INSIDE, F.col("_v")))
        .groupBy(*keys, "q", "h", "side", "_at")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_v").alias("_max"), F.min("_v").alias("_min"))
        .withColumn("_v", F.when(F.col("side") == _BELOW, F.col("_max")).otherwise(F.col("_min")))
    )
    group = [*keys, "q"]
    # A value stands for the ranks [_from, _to); outside the bracket only the rank next to it has a known value.
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))
    first = F.when(F.col("side") == _BELOW, F.col("_to") - 1).otherwise(F.col("_from"))
    last = F.when(F.col("side") == _ABOVE, F.col("_from") + 1).otherwise(F.col("_to"))

    def at(rank):
        return F.max(F.when((rank >= first) & (rank < last), F.col("_v")))

    lost = F.raise_error(F.lit("a percentile lies outside the bracket of its sketch"))
    picked = (
        ranked.groupBy(*group, "h").agg(at(F.floor("h")).alias("a"), at(F.ceil("h")).alias("b"))
        .withColumn("x", F.when(F.col("a").isNull() | F.col("b").isNull(), lost.cast("double"))
                    .otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))))
    )
    out = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == i, F.col("x"))).alias(n) for i, n in enumerate(names)]
    )
    return out.drop("_all") if bare else out
