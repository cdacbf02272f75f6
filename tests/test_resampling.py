"""Bootstrap on distinct values and group-wise logistic regression against plain versions."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from beltline.operators import evaluate as V
from beltline.operators import models as ML


def draw(m, *parts):
    total = 0
    for i in range(m // 16 + m % 16):
        u = int(hashlib.md5("|".join(map(str, (*parts, i))).encode()).hexdigest()[:13], 16) / 2**52
        total += sum(c <= u for c in V.poisson_cdf(16 if i < m // 16 else 1))
    return total


def scored(n=400, seed=0):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"k": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "id": np.arange(n), "y": rng.integers(0, 2, n)})
    p["v"] = np.where(rng.random(n) < 0.3, 7.0, rng.integers(0, 40, n) + p.y * 3.0)
    return p


def test_poisson_totals_have_their_mean_and_spread(spark):
    for m in (1, 16, 37):
        r = spark.range(20_000).select(V.poisson_total(F.lit(m), F.lit(3), F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
        assert abs(r[0] - m) < 5 * (m / 20_000) ** 0.5 and abs(r[1] / m - 1) < 0.06
    assert spark.range(5).select(V.poisson_total(F.lit(0), F.col("id")).alias("w")).distinct().collect()[0].w == 0


def test_bootstrap_of_the_mean_equals_the_plain_one(spark):
    p = scored()
    extra = spark.createDataFrame([("a", 9001, 1, None), ("a", 9002, 0, float("nan"))], "k string, id bigint, y bigint, v double")
    got = {r.k: r for r in V.bootstrap_mean_ci(spark.createDataFrame(p).unionByName(extra), ["k"], "id", "v", b=20, seed=5).collect()}
    for k, part in p.groupby("k"):
        d = part.groupby("v").agg(n=("id", "size"), id=("id", "min")).reset_index()
        means = []
        for r in range(20):
            w = np.array([draw(n, 5, r, i) for n, i in zip(d.n, d.id)])
            means.append((w * d.v).sum() / w.sum())
        assert got[k]["mean"] == pytest.approx(part.v.mean())
        assert (got[k].lo, got[k].hi) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_bootstrap_of_the_auc_equals_the_plain_one(spark):
    p = scored(300, 2)
    for bands in (1, 7):
        got = {r.k: r for r in V.bootstrap_auc_ci(spark.createDataFrame(p), ["k"], "id", "v", b=10, seed=1, bands=bands).collect()}
        for k, part in p.groupby("k"):
            d = part.groupby("v").agg(p=("y", "sum"), n=("y", "size"), id=("id", "min")).reset_index()
            out = []
            for r in range(10):
                a = np.array([draw(x, 1, "p", r, i) for x, i in zip(d.p, d.id)])
                b = np.array([draw(x, 1, "n", r, i) for x, i in zip(d.n - d.p, d.id)])
                out.append((a * (np.cumsum(b) - b / 2)).sum() / (a.sum() * b.sum()))
            assert (got[k].lo, got[k].hi) == pytest.approx(tuple(np.quantile(out, [0.025, 0.975])))


def test_bootstrap_of_nothing(spark):
    none = spark.createDataFrame([], "k string, id bigint, y bigint, v double")
    assert V.bootstrap_mean_ci(none, ["k"], "id", "v", b=5).count() == V.bootstrap_auc_ci(none, ["k"], "id", "v", b=5).count() == 0


def grouped(groups=4, n=240, seed=1):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"g": [f"g{i}" for i in rng.integers(0, groups, n)], "id": np.arange(n), "a": rng.normal(1000, 3, n), "b": rng.normal(size=n), "c": 5.0})
    p["y"] = (p.b + (p.a - 1000) / 3 + rng.normal(size=n) > 0).astype(float)
    return p


def plain_fit(t, cols, penalty):
    """Newton steps in numpy until nothing moves."""
    x, y = t[cols].to_numpy(), t.y.to_numpy()
    sd = x.std(0, ddof=1)
    on = sd > 0
    z = np.c_[np.ones(len(x)), (x[:, on] - x[:, on].mean(0)) / sd[on]]
    w, lam = np.zeros(z.shape[1]), np.r_[0, np.full(on.sum(), penalty)]
    for _ in range(100):
        q = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z / len(z) + np.diag(lam), z.T @ (q - y) / len(z) + lam * w)
    return lambda v: 1 / (1 + np.exp(-(w[0] + ((v[cols].to_numpy()[:, on] - x[:, on].mean(0)) / sd[on]) @ w[1:])))


def test_all_folds_at_once_equal_single_fits(spark):
    p, cols = grouped(), ["a", "b", "c"]
    got = ML.logreg_group_cv(spark.createDataFrame(p), "g", cols).toPandas().set_index("id").prob
    assert len(got) == len(p)
    for g in p.g.unique():
        own = p[p.g == g]
        assert got[own.id].to_numpy() == pytest.approx(plain_fit(p[p.g != g], cols, 1 / len(p))(own), abs=1e-8)


def test_folds_equal_the_ml_library(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    p, cols = grouped(3, 150, 4), ["a", "b"]
    df = spark.createDataFrame(p)
    got = ML.logreg_group_cv(df, "g", cols).toPandas().set_index("id").prob
    data = VectorAssembler(inputCols=cols, outputCol="r").transform(df)
    scaler = StandardScaler(inputCol="r", outputCol="f", withMean=True).fit(data.filter("g <> 'g0'"))
    model = LogisticRegression(featuresCol="f", labelCol="y", regParam=1 / len(p), standardization=False, maxIter=500, tol=1e-13).fit(scaler.transform(data.filter("g <> 'g0'")))
    want = model.transform(scaler.transform(data.filter("g = 'g0'"))).select("id", vector_to_array("probability")[1].alias("p")).toPandas().set_index("id").p
    assert got[want.index].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-6)


def test_jobs_do_not_grow_with_the_groups(spark):
    jobs = []
    for groups in (3, 12):
        name = f"folds-{groups}"
        spark.sparkContext.setJobGroup(name, name)
        ML.logreg_group_cv(spark.createDataFrame(grouped(groups, 400, 9)), "g", ["a", "b"])
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext._jsc.clearJobGroup()
    assert 0 < jobs[1] <= jobs[0] + 8


def test_folds_with_nulls_one_class_separable_rows_and_no_rows(spark):
    schema = "g string, id bigint, a double, y double"
    assert ML.logreg_group_cv(spark.createDataFrame([], schema), "g", ["a"]).count() == 0
    rows = [("p", 1, 1.0, 1.0), ("p", 2, 2.0, 1.0), ("q", 3, 3.0, 0.0), ("q", 4, 5.0, 0.0), ("q", 5, None, 1.0), (None, 6, 1.0, 1.0), ("q", 7, float("nan"), 0.0)]
    got = {r.id: r.prob for r in ML.logreg_group_cv(spark.createDataFrame(rows, schema), "g", ["a"]).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0}
    apart = [(g, i, float(i), float(i > 9)) for i in range(20) for g in ("p", "q", "r")]
    far = {(r.g, r.id): r.prob for r in ML.logreg_group_cv(spark.createDataFrame(apart, schema), "g", ["a"], l2=0.01).collect()}
    assert far["p", 0] < 0.01 and far["q", 19] > 0.99
    alone = ML.logreg_group_cv(spark.createDataFrame(rows[:2], schema), "g", ["a"]).collect()
    assert [np.isnan(r.prob) for r in alone] == [True, True]


def test_replicates_are_spread_and_drawn_row_by_row(spark):
    """Few distinct values still make many tasks, and a draw is compiled, not looked up in an array for each row."""
    df = spark.createDataFrame([("a", i, float(i % 3), i % 2) for i in range(40)], "k string, clip bigint, score double, y int")
    for out in (V.bootstrap_mean_ci(df, ["k"], "clip", "score", b=100), V.bootstrap_auc_ci(df, ["k"], "clip", b=100)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [k" in plan and "_block" in plan and "lambda" not in plan.split("Generate")[1]
        assert out.count() == 1
    m = [1, 15, 16, 37]
    both = spark.createDataFrame([(x, i) for x in m for i in range(30)], "m bigint, id bigint")
    total = {(r.m, r.id): r.w for r in both.select("m", "id", V.poisson_total(F.col("m"), F.col("id")).alias("w")).collect()}
    rows = both.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), V.poisson_draws(F.col("m")) - 1)))
    drawn = rows.groupBy("m", "id").agg(F.sum(V.poisson_draw(F.col("m"), F.col("i"), F.col("id"))).alias("w")).collect()
    assert total == {(r.m, r.id): r.w for r in drawn}
