"""Per-unit healthy baselines and the scores measured against them (long feature tables)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.ordered import cumulative_by_value
from ..kernels.quantiles import exact_percentiles


def robust_fit(healthy: DataFrame, unit="unit", feature="feature", value="value") -> DataFrame:
    """Median and robust scale per (unit, feature); degenerate scales fall back to std, then 1."""
    k = [unit, feature]
    med = exact_percentiles(healthy, k, value, {"center": 0.5})
    dev = healthy.join(med, k).withColumn("_d", F.abs(F.col(value) - F.col("center")))
    mad = exact_percentiles(dev, k, "_d", {"_mad": 0.5})
    std = healthy.groupBy(*k).agg(F.stddev_pop(value).alias("_std"))
    m = F.col("_mad") * 1.4826
    scale = F.when(m >= 1e-9, m).when(F.col("_std") >= 1e-9, F.col("_std")).otherwise(1.0)
    return med.join(mad, k).join(std, k).select(*k, "center", scale.alias("scale"))


def directed_score(rows: DataFrame, fit: DataFrame, ids, unit="unit", feature="feature", value="value", out="raw") -> DataFrame:
    """Mean positive robust deviation per window: wear only adds energy."""
    z = F.greatest((F.col(value) - F.col("center")) / F.col("scale"), F.lit(0.0))
    return rows.join(fit, [unit, feature]).groupBy(unit, *ids).agg(F.avg(z).alias(out))


def gaussian_fit(healthy: DataFrame, unit: str, features, shrinkage=0.15, ridge=1e-6) -> DataFrame:
    """Mean, std and inverse shrunk correlation per unit from one pass of second moments."""
    fs = list(features)
    d = len(fs)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    # Moments about each unit's first-pass mean keep the sums well conditioned.
    mean = healthy.groupBy(unit).agg(*[F.avg(f).alias(f"_m{i}") for i, f in enumerate(fs)])
    dev = healthy.join(mean, unit)
    c = [F.col(f) - F.col(f"_m{i}") for i, f in enumerate(fs)]
    agg = dev.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(d)],
                                *[F.sum(c[i] * c[j]).alias(f"_s{i}_{j}") for i, j in pairs])

    @F.pandas_udf("struct<std:array<double>,inv:array<array<double>>>")
    def invert(n: pd.Series, sums: pd.Series) -> pd.DataFrame:
        out = []
        for count, s in zip(n, sums):
            cov = np.zeros((d, d))
            for (i, j), v in zip(pairs, s):
                cov[i, j] = cov[j, i] = v
            std = np.sqrt(np.diag(cov) / count)
            std[std < 1e-9] = 1.0
            cov = cov / max(count - 1, 1) / np.outer(std, std)
            cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.eye(d)
            out.append((std.tolist(), np.linalg.inv(cov).tolist()))
        return pd.DataFrame(out, columns=["std", "inv"])

    fit = agg.withColumn("_f", invert("n", F.array(*[F.col(f"_s{i}_{j}") for i, j in pairs])))
    return fit.select(unit, "n", F.array(*[F.col(f"_m{i}") for i in range(d)]).alias("center"), F.col("_f.std").alias("scale"), F.col("_f.inv").alias("inverse"))


def mahalanobis_score(rows: DataFrame, fit: DataFrame, unit: str, features, out="raw") -> DataFrame:
    x = F.array(*[F.col(f) for f in features])
    z = F.zip_with(F.zip_with(x, "center", lambda a, m: a - m), "scale", lambda a, s: a / s)
    zero = F.lit(0.0)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), zero, lambda s, v: s + v)
    scored = rows.join(fit, unit).withColumn("_z", z)
    quad = dot(F.transform("inverse", lambda row: dot(row, F.col("_z"))), F.col("_z"))
    return scored.withColumn(out, F.sqrt(F.greatest(quad, zero))).drop("center", "scale", "inverse", "_z", "n")


def ecdf_score(rows: DataFrame, healthy: DataFrame, keys, raw="raw", out="score") -> DataFrame:
    """Share of healthy raw scores at or below each raw score."""
    keys = list(keys)
    both = rows.select(*keys, raw, F.lit(0).alias("_h")).unionByName(healthy.select(*keys, raw, F.lit(1).alias("_h")))
    cum = cumulative_by_value(both, keys, raw, {"h": "sum(_h)"}).select(*keys, raw, "cum_h")
    n = healthy.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(cum, [*keys, raw]).join(n, keys).withColumn(out, F.col("cum_h") / F.col("_n")).drop("cum_h", "_n")


def flag_threshold(rows: DataFrame, healthy: DataFrame, keys, raw="raw", pct=0.99) -> DataFrame:
    thr = exact_percentiles(healthy, keys, raw, {"threshold": pct})
    return rows.join(thr, list(keys)).withColumn("flag", F.col(raw) >= F.col("threshold"))


def robust_standardise(rows: DataFrame, keys, value, out="z") -> DataFrame:
    """(x - median) / IQR per recording; a zero IQR counts as 1."""
    q = exact_percentiles(rows, keys, value, {"_q1": 0.25, "_med": 0.5, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    return rows.join(q, list(keys)).withColumn(
        out, (F.col(value) - F.col("_med")) / F.when(iqr == 0, 1.0).otherwise(iqr)).drop("_q1", "_med", "_q3")


def centroid_fit(healthy: DataFrame, unit: str, vec: str, ident: str, fpr=0.05) -> DataFrame:
    """Mean embedding per unit and the ``1 - fpr`` quantile of healthy distances to it."""
    from .features import l2_distance

    dims = healthy.select(unit, F.posexplode(vec).alias("d", "v")).groupBy(unit, "d").agg(F.avg("v").alias("m"))
    centre = dims.groupBy(unit).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda r: r["m"]).alias("centroid"))
    x = F.transform(vec, lambda v: v.cast("double"))
    dist = healthy.select(unit, ident, x.alias("_x")).join(centre, unit).withColumn("_d", l2_distance(F.col("_x"), F.col("centroid")))
    thr = exact_percentiles(dist, [unit], "_d", {"threshold": 1 - fpr})
    return centre.join(thr, unit)
