"""Sequential rules with small state, run chunk by chunk.

A rule that must see rows in order (a severity machine, "skip everything for 8 s after a hit")
cannot be written as a window aggregate.  Instead of handing a whole key to one task, each chunk
is first reduced to what it does to *every* possible entering state; those small summaries are
chained per key; then each chunk is computed from its now-known entering state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import maps
from .ordered import Seq, slot


def _field(df: DataFrame, names) -> list[T.StructField]:
    return [df.schema[n] for n in names]


#: Chunks whose maps are composed in one group of the second level.
FAN = 1024


def _matched(left: DataFrame, right: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """``left`` with the columns ``keep`` of ``right``, whose rows have unique ``on``; null keys match."""
    other = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *keep)
    cond = [left[c].eqNullSafe(other[f"_on{i}"]) for i, c in enumerate(on)]
    return left.join(other, cond).drop(*[f"_on{i}" for i in range(len(on))])


def finite_state_scan(df: DataFrame, seq: Seq, symbol: str, table: np.ndarray, out: str, start: int = 0) -> DataFrame:
    """``state[i] = table[symbol[i], state[i-1]]`` along every key, ``state[-1] = start``.

    A tree of two levels: the maps of a chunk's symbols are composed into one, those of up to ``FAN`` chunks into one
    again, and only the latter are chained along a key. The state that enters each of them is then handed
    down. All compositions go pair by pair (``maps``), each group of either level in a task of its own; only symbols and states
    pass through Python, the rows stay where they are.
    """
    table = np.asarray(table, dtype=np.int32)
    keys, group, upper = list(seq.keys), seq.group, [*seq.keys, "_top"]
    rows = seq.tag(df).withColumn("_top", slot(F.col(seq.name), FAN))
    order = [c for c in seq.order if c not in group]

    def gathered(frame: DataFrame, by: list[str], first: list[str], value: str) -> DataFrame:
        return frame.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*first, value))).alias("_r"))

    @F.pandas_udf("array<int>")
    def symbols_to_map(series: pd.Series) -> pd.Series:
        return series.map(lambda s: maps.whole(table[s]))

    @F.pandas_udf("array<int>")
    def maps_to_map(series: pd.Series) -> pd.Series:
        return series.map(lambda m: maps.whole(np.stack(m)))

    @F.pandas_udf("array<int>")
    def entries(series: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([maps.entering(np.stack(m), s) for m, s in zip(series, first)])

    @F.pandas_udf("array<int>")
    def states(series: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([maps.states(table[x], s) for x, s in zip(series, first)])

    def entered(frame: DataFrame, by: list[str], name: str, first) -> DataFrame:
        """The state that enters each element of the groups ``by``, given the one that enters the group."""
        both = frame.select(*by, F.arrays_zip(F.col(f"_r.{name}").alias("c"), entries("_r._map", first).alias("e")).alias("z"))
        return both.select(*by, F.explode("z").alias("z")).select(*by, F.col("z.c").alias(name), F.col("z.e").alias("_entry"))

    chunks = gathered(rows.select(*group, "_top", *order, symbol), [*group, "_top"], order, symbol) \
        .select(*group, "_top", symbols_to_map(f"_r.{symbol}").alias("_map"))
    chunks = cut_lineage(chunks)
    tops = gathered(chunks, upper, [seq.name], "_map")
    chain = gathered(tops.select(*upper, maps_to_map("_r._map").alias("_map")), keys, ["_top"], "_map")
    first = entered(chain, keys, "_top", F.lit(start))
    first = entered(_matched(tops, first, upper, ["_entry"]), upper, seq.name, F.col("_entry")).drop("_top")
    rest = [c for c in rows.columns if c not in (*group, *order, symbol, "_top")]
    whole = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, symbol, *rest))).alias("_r"))
    done = _matched(whole, first, group, ["_entry"]).select(
        *group, F.arrays_zip("_r", states(f"_r.{symbol}", "_entry").alias("s")).alias("z"))
    flat = done.select(*group, F.explode("z").alias("z")).select(*group, "z._r.*", F.col("z.s").cast("bigint").alias(out))
    return flat.select(*[c for c in rows.columns if c != "_top"], out)


def _greedy(pos: np.ndarray, sep: int, allowed: int):
    """Take the first position >= allowed, then the next one at least ``sep`` later, and so on."""
    taken, i = [], int(np.searchsorted(pos, allowed))
    while i < len(pos):
        taken.append(i)
        allowed = int(pos[i]) + sep
        i = int(np.searchsorted(pos, allowed))
    return taken, allowed


def greedy_spacing(df: DataFrame, seq: Seq, pos: str, sep: int) -> DataFrame:
    """Keep each row whose ``pos`` is at least ``sep`` after the last kept one (greedy, in order)."""
    group = seq.group
    rows = seq.tag(df)
    far_past = -(2**62)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.sort(pdf[pos].to_numpy())
        # Only rows before first + sep can be the first kept one, whatever came before.
        n_first = int(np.searchsorted(p, p[0] + sep, side="left")) + 1
        firsts = p[:n_first]
        leave = [_greedy(p, sep, int(f))[1] for f in firsts]
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in group}, "firsts": firsts.tolist(), "leave": leave}])

    long_list = T.ArrayType(T.LongType())
    schema = T.StructType(_field(rows, group) + [T.StructField("firsts", long_list), T.StructField("leave", long_list)])
    summary = rows.select(*group, F.col(pos).cast("bigint").alias(pos)).groupBy(*group).applyInPandas(summarise, schema)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq.name)
        allowed, entry = far_past, []
        for firsts, leave in zip(pdf["firsts"], pdf["leave"]):
            entry.append(allowed)
            i = int(np.searchsorted(np.asarray(firsts), allowed))
            if i < len(firsts):
                allowed = int(leave[i])
        return pdf[group].assign(_entry=entry)

    entry_schema = T.StructType(_field(rows, group) + [T.StructField("_entry", T.LongType())])
    entries = summary.groupBy(*seq.keys).applyInPandas(chain, entry_schema)

    def replay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf = left.sort_values(pos)
        taken, _ = _greedy(pdf[pos].to_numpy(), sep, int(right["_entry"].iloc[0]))
        return pdf.iloc[taken]

    return rows.groupBy(*group).cogroup(entries.groupBy(*group)).applyInPandas(replay, rows.schema)
