"""Classifiers on window features with held-out scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def balanced(df: DataFrame, y="y") -> DataFrame:
    """Weight n / (2 * class size), so both classes count the same."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).first()
    w = F.when(F.col(y) == 1, n["n"] / (2.0 * max(n["p"], 1))).otherwise(n["n"] / (2.0 * max(n["n"] - n["p"], 1)))
    return df.withColumn("_w", w)


def _score(model, df):
    return model.transform(df).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", "_raw")


def forest(trees=300, seed=0):
    return lambda cols: Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip"),
        RandomForestClassifier(labelCol="y", weightCol="_w", numTrees=trees, seed=seed, maxDepth=10, featureSubsetStrategy="sqrt")])


def held_out_scores(df: DataFrame, group: str, features, learner, only_with_positives=True, weigh=balanced) -> DataFrame:
    """Leave-one-group-out: every group is scored by a model that never saw it.

    The driver only holds the list of group names; each fold is one distributed fit.
    """
    held = df.filter("y = 1") if only_with_positives else df
    groups = [r[0] for r in held.select(group).distinct().orderBy(group).toLocalIterator()]
    out = None
    for g in groups:
        train = weigh(df.filter(F.col(group) != g))
        part = _score(learner(list(features)).fit(train), df.filter(F.col(group) == g))
        out = part if out is None else out.unionByName(part)
    return out


def loso_random_forest(df, group, features, trees=300):
    return held_out_scores(df, group, features, forest(trees))


def logreg_group_cv(df: DataFrame, group: str, features, l2=1.0, passes=60, tol=1e-11) -> DataFrame:
    """Leave-one-group-out logistic regression, every fold in the same distributed Newton passes.

    Mean and deviation of a fold's training rows are the totals less its own group's. A pass reads the rows once and
    returns, for each fold, loss, gradient and curvature over the other groups; the driver holds these few numbers
    and the names of the groups. The number of jobs depends on how fast the slowest fold converges, not on the number of
    groups. Each fold standardises its features and has the penalty ``l2 / (2 n)`` on all weights but the intercept,
    ``n`` being all rows of ``df``. Rows with a null or NaN feature or label and rows of a null group take no part;
    a fold whose training rows have one class gives that class; features that do not vary count nothing.
    """
    features, n_all = list(features), df.count()
    whole = F.col(group).isNotNull() & F.col("y").isNotNull()
    for f in features:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    rows = df.filter(whole)
    x = [F.col(f).cast("double") for f in features]
    mid = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in x]).first()
    off = [c - F.lit(m) for c, m in zip(x, mid)]
    own = rows.groupBy(group).agg(F.count(F.lit(1)).cast("double"), F.sum(F.col("y").cast("double")), *[F.sum(o) for o in off],
                                  *[F.sum(o * o) for o in off]).orderBy(group).collect()
    if not own:
        return rows.withColumn("prob", F.lit(None).cast("double"))
    names, d = [r[0] for r in own], len(features)
    sums = np.array([list(r[1:]) for r in own], float)
    rest = sums.sum(0) - sums
    n, pos = rest[:, 0], rest[:, 1]
    mean = rest[:, 2 : 2 + d] / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(rest[:, 2 + d :] - n[:, None] * mean ** 2, 0) / np.maximum(n - 1, 1)[:, None])
    scale = np.where(spread > 1e-12 * (np.abs(np.array(mid)) + 1), 1 / np.maximum(spread, 1e-300), 0.0)
    beta = _newton(rows, group, features, names, np.array(mid) + mean, scale, n, pos, l2 / max(n_all, 1), passes, tol)
    # each fold's weights in the units of its features
    raw = beta[:, 1:] * scale
    base = beta[:, 0] - (raw * (np.array(mid) + mean)).sum(1)
    base = np.where(n == 0, np.nan, np.where(pos == 0, -np.inf, np.where(pos == n, np.inf, base)))
    fits = df.sparkSession.createDataFrame(
        [(g, float(c), [float(w) for w in ws]) for g, c, ws in zip(names, base, raw)], f"_g {df.schema[group].dataType.simpleString()}, _c double, _b array<double>")
    line = F.col("_c")
    for i, c in enumerate(x):
        line = line + F.col("_b")[i] * c
    return rows.join(fits, F.col(group) == F.col("_g")).withColumn("prob", 1 / (1 + F.exp(-line))).drop("_g", "_c", "_b")


def _newton(rows, group, features, names, centre, scale, n, pos, penalty, passes, tol) -> np.ndarray:
    """(folds, 1 + features) weights of standardised features at the least penalised mean log loss."""
    k, place = len(features) + 1, {g: i for i, g in enumerate(names)}
    live = (pos > 0) & (pos < n)
    at = np.zeros((len(names), k))
    at[live, 0] = np.log(pos[live] / (n[live] - pos[live]))
    best, step, least = at.copy(), np.zeros_like(at), np.full(len(names), np.inf)
    weight = np.r_[0.0, np.full(k - 1, penalty)]
    narrow = rows.select(group, F.col("y").cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])

    for _ in range(passes):
        folds = np.flatnonzero(live)
        if not len(folds):
            return best
        sums = _fold_sums(narrow, group, place, folds, at, centre, scale)
        for g in folds:
            loss, slope, bend = sums[g][0] / n[g], sums[g][1 : 1 + k] / n[g], sums[g][1 + k :].reshape(k, k) / n[g]
            loss += (weight * at[g] ** 2).sum() / 2
            if loss > least[g] + 1e-13 * abs(least[g]):  # too far: half the way from the best weights
                step[g] /= 2
            else:
                best[g], least[g] = at[g], loss
                step[g] = -np.linalg.lstsq(bend + np.diag(weight), slope + weight * at[g], rcond=None)[0]
            at[g] = best[g] + step[g]
            live[g] = np.abs(step[g]).max() > tol * (1 + np.abs(best[g]).max())
    raise RuntimeError(f"{int(live.sum())} of {len(names)} folds did not converge in {passes} passes")


def _fold_sums(narrow, group, place, folds, at, centre, scale) -> dict[int, np.ndarray]:
    """Loss, gradient and curvature of each fold over the rows of all other groups, summed within tasks first."""
    k = at.shape[1]

    def partial(parts):
        acc = np.zeros((len(folds), 1 + k + k * k))
        for pdf in parts:
            mine, y = pdf[group].map(place).to_numpy(), pdf["_y"].to_numpy()
            x = pdf[[f"_x{i}" for i in range(k - 1)]].to_numpy()
            for i, g in enumerate(folds):
                t = mine != g
                z = np.column_stack([np.ones(int(t.sum())), (x[t] - centre[g]) * scale[g]])
                e = z @ at[g]
                p = np.exp(-np.logaddexp(0, -e))
                acc[i, 0] += (np.logaddexp(0, e) - y[t] * e).sum()
                acc[i, 1 : 1 + k] += z.T @ (p - y[t])
                acc[i, 1 + k :] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
        yield pd.DataFrame({"fold": np.repeat(folds, acc.shape[1]), "at": np.tile(np.arange(acc.shape[1]), len(folds)), "v": acc.ravel()})

    out = {int(g): np.zeros(1 + k + k * k) for g in folds}
    for r in narrow.mapInPandas(partial, "fold bigint, at bigint, v double").groupBy("fold", "at").agg(F.sum("v")).collect():
        out[r[0]][r[1]] = r[2]
    return out


def grouped_split(df: DataFrame, group: str, holdout=0.3, seed=0) -> DataFrame:
    """Whole groups go to train or test by a hash of their name."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1 << 52)) / float(1 << 52)
    return df.withColumn("split", F.when(u < holdout, "test").otherwise("train"))


def active_learning(df: DataFrame, ident: str, features, rounds=3, batch=40, seed0=40, strategy="uncertainty", trees=30) -> DataFrame:
    """Label counts per round when each batch goes to the rows the model is least sure of (or random ones)."""
    from .evaluate import random_batch, uncertainty_topk

    half = seed0 // 2
    start = random_batch(df.filter("y = 1"), ident, half).unionByName(random_batch(df.filter("y = 0"), ident, half))
    known = cut_lineage(start.select(ident, F.lit(0).alias("round")))
    for r in range(1, rounds + 1):
        model = forest(trees)(list(features)).fit(balanced(df.join(known.select(ident), ident)))
        pool = df.join(known.select(ident), ident, "left_anti")
        scored = _score(model, pool)
        pick = uncertainty_topk(scored, "prob", ident, batch) if strategy == "uncertainty" else random_batch(scored, ident, batch, r)
        known = cut_lineage(known.unionByName(pick.select(ident, F.lit(r).alias("round"))))
    return known.join(df.select(ident, "y"), ident).groupBy("round").agg(F.count(F.lit(1)).alias("picked"), F.sum("y").alias("faults"))
