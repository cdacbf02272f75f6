"""Spark helpers shared by the corpus operators: inputs, written intermediates, components."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later passes and lost executors start from there.

    The folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = run_dir(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that is still to run reads it."""
    _written.remove((df.sparkSession, df.written_to))
    _delete(df.sparkSession, df.written_to)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM ended first: the cluster clears its shared folder
            return


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], value: str, share: float = 1e-4, how: str = "inner") -> DataFrame:
    """``rows`` with ``value`` of ``values`` (keys, n, value: not null), where n counts the rows of each key in ``rows``.

    Keys with more than ``share`` of all of n, at most 1 / share of them, are joined as a broadcast; no other is hot. ``how``
    is inner or left, for rows without a value.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > share * total
    known = rows.join(F.broadcast(values.where(often).select(*keys, value)), keys, "left")
    rest = known.where(F.col(value).isNull()).drop(value).join(values.where(~often).select(*keys, value), keys, how)
    return known.where(F.col(value).isNotNull()).unionByName(rest)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root), root the smallest node of its component.

    Two-phase star contraction: every node hooks its larger neighbours (then its smaller ones) to the smallest node it
    sees. The number of rounds grows with the logarithm of the longest path. Nodes with very many neighbours cost no
    more than their edges, as each phase is a grouped minimum and a join.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        pairs = stored(small.select("a", F.col("m").alias("b"))
                       .unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        seen = pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(pairs.groupBy("a").agg(F.min("b").alias("root")), nodes["node"] == F.col("a"), "left") \
        .select("node", F.coalesce("root", "node").alias("root"))


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the edges behind ``roots`` and ``links`` (a, b) together.

    Only links between different components count, and they join the roots: the earlier edges are not walked again.
    """
    def root_of(end: str) -> DataFrame:
        return roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))

    open_ = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left") \
        .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = stored(components(open_), "tops")
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left") \
        .select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(tops.join(roots, "node", "left_anti").select("node", "root"))
