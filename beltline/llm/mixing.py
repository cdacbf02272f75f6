"""Mixing documents to target weights with soft domains, in DataFrame operations only.

A labelled table names the domain of some documents. A classifier with Gaussian class densities over a few measures of
the text gives every document a posterior over the domains. Rates r >= 0 then minimise

    1/2 sum_k (S_k / N - w_k)^2 + ridge/2 sum_i (n_i / N) (r_i - 1)^2,    S_k = sum_i r_i n_i p_ik

where n are tokens, N their total, p posteriors and w the target shares: expected domain token totals match the targets,
with rates as near to 1 as that allows. Accelerated projected gradient steps need only the K totals S in the driver; the
rates stay distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import words
from .frames import let, stored, table

#: The domains of the labels table, by quality, and the token shares asked for.
TARGETS = {"high": 0.9, "low": 0.1}
MEASURES = ("length", "word", "variety", "line")


def measured(docs: DataFrame) -> DataFrame:
    """row, doc_id, h (a hash of the text), tokens and the measures of every whole text; null texts are empty. Written."""
    text = F.coalesce("text", F.lit(""))

    def of(w: Column) -> Column:
        n, m = F.size(w), F.greatest(F.size(w), F.lit(1))
        return F.struct(n.cast("bigint").alias("tokens"), F.log1p(n.cast("double")).alias("length"), (F.length(text) / m).alias("word"),
                        (F.size(F.array_distinct(w)) / m).alias("variety"), F.log1p(m / F.size(F.split(text, "\n"))).alias("line"))

    return stored(docs.select("doc_id", F.xxhash64("text").alias("h"), let(words(text), of).alias("m")).select("doc_id", "h", "m.*").withColumn("row", F.monotonically_increasing_id()), "measures")


def posteriors(rows: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """``rows`` with p, an array of one probability for each of ``domains``; ``labels`` has doc_id and domain.

    All labelled rows are used. A domain without labelled rows has probability 0; without any label all are alike.
    """
    fitted = rows.join(labels.where(F.col("domain").isin(*domains)), "doc_id").groupBy("domain").agg(
        F.count("*").alias("n"), *(f(m).alias(f"{k}_{m}") for m in MEASURES for k, f in (("mean", F.avg), ("var", F.var_pop)))).collect()
    if not fitted:
        return rows.withColumn("p", F.array(*(F.lit(1.0 / len(domains)) for _ in domains)))
    total, by = sum(r["n"] for r in fitted), {r["domain"]: r for r in fitted}

    def density(d: str) -> Column:
        if d not in by:
            return F.lit(-math.inf)
        r, out = by[d], F.lit(math.log(by[d]["n"] / total))
        for m in MEASURES:
            var = r[f"var_{m}"] + 1e-3
            out = out - (F.col(m) - r[f"mean_{m}"]) * (F.col(m) - r[f"mean_{m}"]) / (2 * var) - 0.5 * math.log(var)
        return out

    logs = F.array(*(density(d) for d in domains))
    shares = let(logs, lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z))))
    return rows.withColumn("p", let(shares, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))


def rates(rows: DataFrame, weights: list[float], ridge: float = 1e-4, tolerance: float = 1e-3, steps: int = 200, keep: int = 8) -> DataFrame:
    """``rows`` (tokens, p) with rate. Stops when every domain's share is within ``tolerance`` of its target, or when a
    step no longer moves a share by a thousandth of that: the targets are then out of reach. ``keep`` steps are done
    between two writes of the state."""
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return rows.withColumn("rate", F.lit(1.0))
    size = 1.0 / (1.0 + ridge)

    def stepped(y: Column, gap: list[float]) -> Column:
        push = sum((F.col("p")[k] * float(g) for k, g in enumerate(gap)), F.lit(0.0))
        return F.greatest(F.lit(0.0), y - size * (push + ridge * (y - 1.0)))

    def gaps(df: DataFrame, r: str) -> list[float]:
        got = df.agg(*(F.sum(F.col(r) * F.col("tokens") * F.col("p")[k]).alias(f"s{k}") for k in range(len(weights)))).first()
        return [(got[k] or 0.0) / total - w for k, w in enumerate(weights)]

    state = rows.withColumn("rate", F.lit(1.0)).withColumn("y", F.lit(1.0))
    t, gap, before = 1.0, gaps(state, "y"), None
    for step in range(steps):
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        new = state.withColumn("next", stepped(F.col("y"), gap))
        new = new.withColumn("y", F.col("next") + (t - 1) / after * (F.col("next") - F.col("rate"))).withColumn("rate", F.col("next")).drop("next")
        state = stored(new, "rates") if step % keep == keep - 1 else new
        miss = gaps(state, "rate")
        if max(map(abs, miss)) <= tolerance or before and max(abs(a - b) for a, b in zip(miss, before)) < tolerance / 1000:
            break
        # momentum that overshoots starts anew
        if before and sum(x * x for x in miss) > sum(x * x for x in before):
            after, state = 1.0, state.withColumn("y", F.col("rate"))
        t, before, gap = after, miss, gaps(state, "y")
    return state.drop("y")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """row, doc_id, h, tokens, p, rate for every row of ``docs``, row numbering them. ``labels`` has quality.

    Rows without words have no tokens and the rate their posterior implies. Conflicting labels of one doc_id count as
    the worse one. Unlabelled and null ids are predicted like all others.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).select(
        "doc_id", F.when(F.col("q") == 0, "low").otherwise("high").alias("domain"))
    rows = posteriors(measured(docs), named, domains).select("row", "doc_id", "h", "tokens", "p")
    whole = sum(targets.values())
    return rates(stored(rows, "posteriors"), [targets[d] / whole for d in domains], **options)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS))), "rate")
