"""Ordered computations that never put a whole key into one task.

``lag``, forward fill, running sums, islands and frames over ``PARTITION BY device`` would send a
device's whole history to one task.  Here every key is cut into chunks along its order (time
slices, score bands, ...).  Rows are only ever windowed inside ``(key, chunk)``; what has to cross
a chunk border is one summary row per chunk, and only those summary rows are windowed per key.
Both levels agree with the single-window definition exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def slot(value, width) -> Column:
    """Floor division on integers (Spark's ``div`` truncates toward zero)."""
    v, w = col(value), F.lit(int(width)).cast("bigint")
    return F.call_function("div", v - F.pmod(v, w), w)


@dataclass(frozen=True)
class Seq:
    """Rows of each key in ``order``, cut into chunks by ``chunk`` (monotone along ``order``)."""

    keys: Sequence[str]
    order: Sequence[str]
    chunk: Column | str
    name: str = "_chunk"

    @staticmethod
    def by_time(keys, time, ties=(), chunk_us=24 * 3600 * 1_000_000, name="_chunk") -> "Seq":
        w = f"{int(chunk_us)}L"
        return Seq(tuple(keys), (time, *ties), f"({time} - pmod({time}, {w})) div {w}", name)

    def tag(self, df: DataFrame) -> DataFrame:
        return df if self.name in df.columns else df.withColumn(self.name, col(self.chunk))

    @property
    def group(self) -> list[str]:
        return [*self.keys, self.name]

    @property
    def position(self) -> Column:
        return F.struct(*self.order)

    def inner(self, backward: bool = False):
        order = [F.desc(o) for o in self.order] if backward else self.order
        return Window.partitionBy(*self.group).orderBy(*order)

    def outer(self, backward: bool = False):
        return Window.partitionBy(*self.keys).orderBy(F.desc(self.name) if backward else self.name)


_PAST = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Spec:
    out: str
    expr: Column | str = field(default_factory=lambda: F.lit(1))
    backward = False

    @property
    def value(self) -> Column:
        return col(self.expr)


class Lag(Spec):
    """Value on the previous row of the key."""

    def summary(self, pos):
        return F.max_by(F.struct(self.value.alias("v")), pos)

    def carry(self, s, w):
        return F.lag(s).over(w)

    def local(self, w):
        return F.lag(F.struct(self.value.alias("v"))).over(w)

    def combine(self, local, carry):
        return F.coalesce(local, carry)["v"]


class Lead(Spec):
    """Value on the next row of the key."""

    def summary(self, pos):
        return F.min_by(F.struct(self.value.alias("v")), pos)

    def carry(self, s, w):
        return F.lead(s).over(w)

    def local(self, w):
        return F.lead(F.struct(self.value.alias("v"))).over(w)

    combine = Lag.combine


class Fill(Spec):
    """Last non-null value up to and including this row."""

    def summary(self, pos):
        return F.max_by(self.value, F.when(self.value.isNotNull(), pos))

    def carry(self, s, w):
        return F.last(s, True).over(w.rowsBetween(*_BEFORE))

    def local(self, w):
        return F.last(self.value, True).over(w.rowsBetween(*_PAST))

    def combine(self, local, carry):
        return F.coalesce(local, carry)


class BackFill(Spec):
    """First non-null value from this row on.

    Runs over the reversed order: a frame that ends at UNBOUNDED FOLLOWING would be rescanned for
    every row.
    """

    backward = True

    def summary(self, pos):
        return F.min_by(self.value, F.when(self.value.isNotNull(), pos))

    def carry(self, s, w):
        return F.last(s, True).over(w.rowsBetween(*_BEFORE))

    def local(self, w):
        return F.last(self.value, True).over(w.rowsBetween(*_PAST))

    combine = Fill.combine


class RunSum(Spec):
    """Running sum including this row."""

    def summary(self, pos):
        return F.sum(self.value)

    def carry(self, s, w):
        return F.sum(s).over(w.rowsBetween(*_BEFORE))

    def local(self, w):
        return F.sum(self.value).over(w.rowsBetween(*_PAST))

    def combine(self, local, carry):
        zero = F.lit(0)
        return F.coalesce(local, zero) + F.coalesce(carry, zero)


class RunMax(Spec):
    """Running maximum including this row."""

    def summary(self, pos):
        return F.max(self.value)

    def carry(self, s, w):
        return F.max(s).over(w.rowsBetween(*_BEFORE))

    def local(self, w):
        return F.max(self.value).over(w.rowsBetween(*_PAST))

    def combine(self, local, carry):
        return F.greatest(local, carry)


class RowNo(RunSum):
    """1-based position in the key."""


def ordered(df: DataFrame, seq: Seq, *specs: Spec) -> DataFrame:
    """Add one column per spec, computed along the whole key."""
    rows = seq.tag(df)
    borders = rows.groupBy(*seq.group).agg(
        *[s.summary(seq.position).alias(f"_s{i}") for i, s in enumerate(specs)]
    )
    carried = borders.select(
        *seq.group,
        *[s.carry(F.col(f"_s{i}"), seq.outer(s.backward)).alias(f"_k{i}") for i, s in enumerate(specs)],
    )
    local = rows.withColumns({f"_l{i}": s.local(seq.inner(s.backward)) for i, s in enumerate(specs)})
    # chunks may be as many as rows: their summaries are dealt like the rows, never broadcast whole
    joined = local.join(carried.hint("merge"), seq.group, "left")
    done = joined.withColumns(
        {s.out: s.combine(F.col(f"_l{i}"), F.col(f"_k{i}")) for i, s in enumerate(specs)}
    )
    return done.drop(*[f"_{p}{i}" for p in "lk" for i in range(len(specs))])


def islands(df: DataFrame, seq: Seq, watch: Sequence[str], breaks: str, out: str,
            first: str | None = None) -> DataFrame:
    """Number the runs of each key; a row opens a run when ``breaks`` holds.

    ``breaks`` is SQL over ``cur.<col>`` and ``prev.<col>`` for the columns in ``watch``; the
    first row of a key always opens a run.  ``first`` names a struct column that is to hold the
    watched columns of the run's opening row.
    """
    inner = seq.inner()
    flag = F.coalesce(F.expr(breaks).cast("int"), F.lit(0))
    rows = (
        seq.tag(df)
        .withColumn("cur", F.struct(*watch))
        .withColumn("prev", F.lag("cur").over(inner))
        .withColumn("_open", F.when(F.col("prev").isNull(), 0).otherwise(flag))
    )
    opened = F.when(F.col("_open") == 1, F.col("cur"))
    borders = rows.groupBy(*seq.group).agg(
        F.sum("_open").alias("_n"),
        F.min_by("cur", seq.position).alias("cur"),
        F.max_by("cur", seq.position).alias("_last"),
        F.max_by(opened, F.when(F.col("_open") == 1, seq.position)).alias("_newest"),
    )
    outer = seq.outer()
    carried = (
        borders.withColumn("prev", F.lag("_last").over(outer))
        .withColumn("_first", F.when(F.col("prev").isNull(), 1).otherwise(flag))
        .withColumn("_entry", F.when(F.col("_first") == 1, F.col("cur")))
        .withColumn("_base", F.sum(F.col("_n") + F.col("_first")).over(outer.rowsBetween(*_BEFORE)))
        .withColumn("_held", F.last(F.coalesce("_newest", "_entry"), True).over(outer.rowsBetween(*_BEFORE)))
        .select(*seq.group, (F.coalesce("_base", F.lit(0)) + F.col("_first")).alias("_base"),
                F.coalesce("_entry", "_held").alias("_held"))
    )
    done = (
        rows.withColumn("_within", F.sum("_open").over(inner.rowsBetween(*_PAST)))
        .withColumn("_start", F.last(opened, True).over(inner.rowsBetween(*_PAST)))
        .join(carried.hint("merge"), seq.group, "left")
        .withColumn(out, F.col("_base") + F.col("_within"))
    )
    if first:
        done = done.withColumn(first, F.coalesce("_start", "_held"))
    return done.drop("cur", "prev", "_open", "_within", "_base", "_start", "_held")


def row_frame(df: DataFrame, keys, index: str, before: int, after: int, exprs: dict[str, Column],
              block: int = 65_536) -> DataFrame:
    """Aggregates over ``ROWS before PRECEDING .. after FOLLOWING`` by a dense 1-based index.

    Keys are cut into blocks of ``block`` rows; a row is copied into the next or previous block
    only where that block's frames reach it.
    """
    block = max(block, 4 * (before + after) + 1)
    i = F.col(index) - 1
    w = Window.partitionBy(*keys, "_b").orderBy(index).rowsBetween(-before, after)
    return (
        df.withColumn("_own", slot(i, block))
        .withColumn("_b", F.explode(F.sequence(slot(i - after, block), slot(i + before, block))))
        .withColumns({name: e.over(w) for name, e in exprs.items()})
        .filter("_b = _own")
        .drop("_b", "_own")
    )


def range_frame(df: DataFrame, keys, time: str, before: int, after: int, exprs: dict[str, Column],
                block: int) -> DataFrame:
    """Aggregates over ``RANGE before PRECEDING .. after FOLLOWING`` of an integer column."""
    t = F.col(time)
    w = Window.partitionBy(*keys, "_b").orderBy(time).rangeBetween(-before, after)
    return (
        df.withColumn("_own", slot(t, block))
        .withColumn("_b", F.explode(F.sequence(slot(t - after, block), slot(t + before, block))))
        .withColumns({name: e.over(w) for name, e in exprs.items()})
        .filter("_b = _own")
        .drop("_b", "_own")
    )


def beside(df: DataFrame, found: DataFrame, on) -> DataFrame:
    """``df`` with the columns of ``found``, at most one row per ``on``; null keys meet as in ``PARTITION BY``."""
    other = found.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in found.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(other, same, "left").drop(*[f"_k_{c}" for c in on])


def frame_moments(points: DataFrame, targets: DataFrame, keys, time: str, before: int, after: int,
                  values: dict[str, Column]) -> DataFrame:
    """Count, mean and population variance of the points in ``[t - before, t + after]`` of each distinct target time.

    Time is cut into cells as wide as the frame, so a frame is the end of one cell and the beginning of the next.
    Both are running aggregates over rows in order, whatever the number of rows in a frame; the two parts are merged
    by counts, means and squared deviations, nothing is subtracted.  Returns ``keys``, ``time``, ``rows`` and per value
    ``<name>_n``, ``<name>_mean``, ``<name>_var`` (nulls left out); targets without a point in reach have no row.
    """
    keys, names = list(keys), list(values)
    width = before + after + 1
    t, at = F.col(time), F.col("_at")
    fill = [F.lit(None).cast("double").alias(n) for n in names]
    side = F.explode(F.array(F.lit(-1), F.lit(1)))

    def placed(df):
        # _side -1: the end of a cell, read backwards; 1: its beginning
        return df.withColumn("_cell", slot(F.col("_p"), width)).withColumn("_o", F.col("_p") * F.col("_side"))

    data = placed(points.select(*keys, t.alias("_p"), F.lit(None).cast("bigint").alias("_at"),
                                *[v.cast("double").alias(n) for n, v in values.items()], side.alias("_side")).filter("_p IS NOT NULL"))
    asked = targets.select(*keys, t.cast("bigint").alias("_at")).filter("_at IS NOT NULL").distinct()
    ends = asked.withColumn("_side", side).withColumn("_p", F.when(F.col("_side") == -1, at - before).otherwise(at + after))
    # a frame that is exactly one cell has no second part
    ends = ends.filter((F.col("_side") == -1) | (F.pmod(at - before, F.lit(width).cast("bigint")) != 0))
    both = data.unionByName(placed(ends.select(*keys, "_p", "_at", *fill, "_side")))
    w = Window.partitionBy(*keys, "_cell", "_side").orderBy("_o", F.col("_at").isNotNull(), *names).rowsBetween(*_PAST)
    aggs = {"rows": F.count(F.when(at.isNull(), 1)).over(w)}
    for n in names:
        aggs |= {f"{n}_n": F.count(n).over(w), f"{n}_mean": F.avg(n).over(w), f"{n}_var": F.var_pop(n).over(w)}
    parts = both.withColumns(aggs).filter("_at IS NOT NULL")

    def part(c, s):
        return F.max(F.when(F.col("_side") == s, F.col(c)))

    merged = parts.groupBy(*keys, "_at").agg(F.sum("rows").alias("rows"), *[
        part(f"{n}_{f}", s).alias(f"{n}_{f}{s}") for n in names for f in ("n", "mean", "var") for s in (-1, 1)])
    out = [F.col("_at").alias(time), "rows"]
    for n in names:
        a, b = F.coalesce(f"{n}_n-1", F.lit(0)), F.coalesce(f"{n}_n1", F.lit(0))
        ma, mb = F.col(f"{n}_mean-1"), F.col(f"{n}_mean1")
        one = F.when(b == 0, F.lit(-1)).when(a == 0, F.lit(1))
        d = mb - ma
        out += [(a + b).alias(f"{n}_n"),
                F.when(one == -1, ma).when(one == 1, mb).otherwise((ma * a + mb * b) / (a + b)).alias(f"{n}_mean"),
                F.when(one == -1, F.col(f"{n}_var-1")).when(one == 1, F.col(f"{n}_var1")).otherwise(
                    (F.col(f"{n}_var-1") * a + F.col(f"{n}_var1") * b + d * d * a * b / (a + b)) / (a + b)).alias(f"{n}_var")]
    return merged.select(*keys, *out).filter("rows > 0")


def cumulative_by_value(df: DataFrame, keys, value: str, sums: dict[str, str], bands: int = 256,
                        descending: bool = False) -> DataFrame:
    """Running totals over the distinct values of each key (ranks, ECDF, ROC).

    ``sums`` maps output names to SQL aggregates per distinct value.  Ties collapse first; the
    distinct values are then cut into ``bands`` of about equal size taken from a bounded quantile
    sketch, so that neither a popular value nor a large key is one task.  Null values are left out.
    """
    keys = list(keys)
    per_value = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *[F.expr(e).alias(n) for n, e in sums.items()]
    )
    cuts = per_value.groupBy(*keys).agg(
        F.percentile_approx(value, [i / bands for i in range(1, bands)], 4 * bands).alias("_cuts")
    )
    if keys:
        banded = per_value.join(cuts, keys)
    else:
        banded = per_value.withColumn("_one", F.lit(1)).join(
            F.broadcast(cuts.withColumn("_one", F.lit(1))), "_one").drop("_one")
    v = F.col(value)
    banded = banded.withColumn(
        "_chunk", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c <= v)).cast("bigint")
    ).drop("_cuts")
    key = value
    if descending:
        banded = banded.withColumn("_chunk", -F.col("_chunk")).withColumn("_neg", -v)
        key = "_neg"
    seq = Seq(tuple(keys), (key,), F.col("_chunk"))
    done = ordered(banded, seq, *[RunSum(f"cum_{n}", n) for n in sums])
    return done.drop("_chunk", "_neg")
