"""Keyed state machines over streams whose rows may come late and out of order.

Rows wait in the state store until the watermark has passed them and are then handed over in event order, one sorted slice
after another. A processor turns slices into arrays, so its result depends on the order of events alone: not on how
rows were dealt to micro-batches, nor on what arrived first. Rows later than the allowed delay are dropped by the engine and
counted in its progress.

Keys that stay idle for long enough (in event time) are evicted: their state goes, what they report on leaving comes
out, and a row that comes after the pause finds a new key. That also holds where the pause and the row are released together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Event time of the mark that ends a drained stream: the start of the year 2200 (nanoseconds end in 2262).
END_US = 7_258_118_400_000_000
TIME = "ts_us"
SHARD = "shard"
#: Keys are dealt to so many shards. A stream keeps its number, as its state lies under the shards.
SHARDS = 1024
#: Rows of one table that waits, and spans of time to which waiting tables are dealt at once.
PIECE, SPANS = 4096, 32


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Ordered(StatefulProcessor):
    """Sorted slices of keys' rows through ``advance``; the state of a key between them is one small JSON record.

    The engine calls a processor once for a shard of keys (``shard_of``), not once for each key: what a call costs does not
    grow with the number of keys. Each key still has its own record, and its rows alone decide what comes out for it.
    """

    key_names: tuple[str, ...] = ()
    #: After the event time.
    ties: tuple[str, ...] = ("kind", "event_id")
    out_schema = ""
    #: Microseconds without a row after which a key goes; None keeps it.
    idle_us: int | None = None
    #: About so many rows are sorted and processed at once; more are dealt to shorter spans of time in the state store first.
    slice_rows: int = 1 << 17

    def start(self) -> dict:
        return {}

    def advance(self, state: dict, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Outputs of the next rows, in event order; ``state`` changes in place."""
        raise NotImplementedError

    def leave(self, state: dict, last_us: int) -> pd.DataFrame | None:
        """Outputs of a key that goes."""
        return None

    def forgetting(self, idle_us: int) -> "Ordered":
        self.idle_us = idle_us
        return self

    def stays(self, states: list[dict], rows: pd.DataFrame, cuts: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Outputs, each with the places of the rows whose keys they have, of stays that begin at ``cuts`` and follow one another in ``rows``.

        One at a time; processors that take all at once define this and call it from ``advance``.
        """
        for state, a, b in zip(states, cuts, np.r_[cuts[1:], len(rows)]):
            out = self.advance(state, rows.iloc[a:b].reset_index(drop=True))
            if out is not None and len(out):
                yield out, np.full(len(out), a)

    def left(self, states: list[dict], lasts: list[int]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Outputs of states that go, each with the places of their states."""
        if type(self).leave is not Ordered.leave:
            for i, (state, last) in enumerate(zip(states, lasts)):
                out = self.leave(state, last)
                if out is not None and len(out):
                    yield out, np.full(len(out), i)

    # what follows is the same for all processors ------------------------------------------------

    def processed(self, memory: dict, rows: pd.DataFrame, recall) -> Iterator[pd.DataFrame]:
        """Outputs of ``rows`` of any keys, later than all before; ``memory`` has (state, last event time) by key, ``recall`` those not in it yet."""
        code = np.zeros(len(rows), np.int64)
        for c in self.key_names:
            mine, values = pd.factorize(rows[c], use_na_sentinel=False)
            code = pd.factorize(code * max(1, len(values)) + mine)[0]
        rows = rows.iloc[np.lexsort([rows[c].to_numpy() for c in (*self.ties[::-1], TIME)] + [code])].reset_index(drop=True)
        code, t = np.sort(code), rows[TIME].to_numpy(np.int64)
        first = np.r_[True, code[1:] != code[:-1]]
        cuts = np.flatnonzero(first if self.idle_us is None else first | np.r_[True, np.diff(t) > self.idle_us])
        ends = np.r_[cuts[1:], len(t)] - 1
        named = rows[list(self.key_names)].iloc[cuts]
        keys = [tuple(None if pd.isna(v) else v for v in k) for k in zip(*(named[c].tolist() for c in self.key_names))] if self.key_names else [()] * len(cuts)
        fresh, begins, lasts = first[cuts], t[cuts].tolist(), t[ends].tolist()
        states, gone = [], []
        for i, key in enumerate(keys):
            if fresh[i]:
                known = memory[key] if key in memory else recall(key)
                if known is not None and self.idle_us is not None and begins[i] - known[1] > self.idle_us:
                    gone.append((*known, i))
                    known = None
                states.append(self.start() if known is None else known[0])
            else:
                states.append(self.start())
        outputs = list(self.stays(states, rows, cuts))
        for i, key in enumerate(keys):
            if i + 1 < len(keys) and not fresh[i + 1]:
                gone.append((states[i], lasts[i], i))
            else:
                memory[key] = (states[i], lasts[i])
        where = cuts[[i for _, _, i in gone]] if gone else cuts[:0]
        outputs += [(out, where[at]) for out, at in self.left([s for s, _, _ in gone], [x for _, x, _ in gone])]
        for out, at in outputs:
            yield self.titled(out, {c: rows[c].to_numpy()[at] for c in self.key_names})

    def evicted(self, memory: dict, until_us: int) -> Iterator[pd.DataFrame]:
        """Outputs of the keys in ``memory`` that have been idle long enough; they become None there."""
        if self.idle_us is None:
            return
        keys = [k for k, known in memory.items() if known is not None and until_us >= known[1] + self.idle_us]
        outputs = list(self.left([memory[k][0] for k in keys], [memory[k][1] for k in keys]))
        memory.update(dict.fromkeys(keys))
        for out, at in outputs:
            yield self.titled(out, {c: [keys[i][n] for i in at] for n, c in enumerate(self.key_names)})

    def titled(self, out: pd.DataFrame, keys: dict) -> pd.DataFrame:
        return out.assign(**keys)[[c.split()[0] for c in self.out_schema.split(", ")]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "first bigint, last bigint, n bigint, piece string", "rows binary")
        self._memory = handle.getMapState("memory", "key string", "json string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        held = [self.put_away(pdf.drop(columns=[SHARD, "event_time"])) for pdf in rows if key[0] >= 0]
        if held:
            self.wake(min(first for first, *_ in held))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        pieces = list(self._waiting.keys())
        due = [p for p in pieces if p[0] <= until]
        memory = {}
        if self.idle_us is not None:
            memory = {tuple(json.loads(k[0])): tuple(json.loads(v[0])) for k, v in self._memory.iterator()}
        before = set(memory)
        touched = set()

        def recall(k):
            if self.idle_us is not None:
                return None
            found = self._memory.getValue((json.dumps(k),))
            return None if found is None else tuple(json.loads(found[0]))

        later = [p[0] for p in pieces if p[0] > until]
        for rows in self.in_order(due, until, later):
            touched.update(zip(*(rows[c].tolist() for c in self.key_names)))
            yield from self.processed(memory, rows, recall)
        touched = {tuple(None if pd.isna(v) else v for v in k) for k in touched}
        yield from self.evicted(memory, until)
        for k, known in memory.items():
            if known is None:
                if k in before:
                    self._memory.removeKey((json.dumps(k),))
            elif k in touched:
                self._memory.updateValue((json.dumps(k),), (json.dumps(known),))
        if later:
            self.wake(min(later))
        kept = [known[1] for known in memory.values() if known is not None]
        if self.idle_us is not None and kept:
            self.wake(min(kept) + self.idle_us)

    def wake(self, at_us: int) -> None:
        self._handle.registerTimer(-(-at_us // 1000))

    def put_away(self, rows: pd.DataFrame) -> tuple:
        """Keep ``rows`` in the state store under the name that is returned: first and last event time, number, unique name."""
        t = rows[TIME]
        name = (int(t.min()), int(t.max()), len(rows), uuid.uuid4().hex)
        self._waiting.updateValue(name, (packed(rows),))
        return name

    def taken(self, name: tuple) -> pd.DataFrame:
        rows = unpacked(self._waiting.getValue(name)[0])
        self._waiting.removeKey(name)
        return rows

    def in_order(self, pieces: list[tuple], until: int, later: list[int]) -> Iterator[pd.DataFrame]:
        """The rows of ``pieces`` up to ``until``, each table later than the one before; ``later`` gets the first times of rows that stay.

        What is too much for one table is dealt to spans of time, a piece at a time, so at most some tables are in memory. Only rows
        of one instant are not cut.
        """
        if not pieces:
            return
        low, high, n = min(p[0] for p in pieces), max(p[1] for p in pieces), sum(p[2] for p in pieces)
        if n <= self.slice_rows or low >= high:
            rows = pd.concat([self.taken(p) for p in pieces], ignore_index=True)
            wait = rows[TIME] > until
            if wait.any():
                later.append(self.put_away(rows[wait])[0])
                rows = rows[~wait]
            yield rows.reset_index(drop=True)
            return
        parts = min(SPANS, 2 * n // self.slice_rows + 1)
        width = (min(until, high) - low) // parts + 1
        spans = [[] for _ in range(parts + 1)]
        open_ = [[] for _ in range(parts + 1)]
        size = [0] * (parts + 1)

        def close(b):
            spans[b].append(self.put_away(pd.concat(open_[b], ignore_index=True)))
            open_[b], size[b] = [], 0

        for p in pieces:
            rows = self.taken(p)
            t = rows[TIME].to_numpy(np.int64)
            span = np.where(t > until, parts, (t - low) // width)
            for b in np.unique(span).tolist():
                open_[b].append(rows[span == b])
                size[b] += len(open_[b][-1])
                if size[b] >= PIECE:
                    close(b)
        for b in range(parts + 1):
            if size[b]:
                close(b)
        later.extend(p[0] for p in spans[parts])
        for b in range(parts):
            yield from self.in_order(spans[b], until, later)


def shard_of(keys) -> Column:
    """The shard of a key; marks have their own."""
    return F.when(F.col(TIME) == END_US, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int"))


def keyed(stream: DataFrame, processor: Ordered, delay: str = "10 minutes", mode: str = "append", marks: DataFrame | None = None) -> DataFrame:
    """``processor`` over ``stream`` (keys, ts_us, ties, ...), where rows come at most ``delay`` later than newer ones.

    ``marks`` (a stream of the same columns) ends a bounded stream: a row at ``END_US`` releases all that waits.
    """
    if marks is not None:
        stream = stream.unionByName(marks)
    timed = stream.withColumn("event_time", F.timestamp_micros(TIME)).withWatermark("event_time", delay)
    return timed.withColumn(SHARD, shard_of(processor.key_names)).groupBy(SHARD).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.out_schema, outputMode=mode, timeMode="EventTime")


def replayed(rows: pd.DataFrame, processor: Ordered, key: tuple = ()) -> pd.DataFrame:
    """The outputs of one key's whole table at once: the batch form of ``keyed``."""
    memory = {}
    named = rows.assign(**dict(zip(processor.key_names, key)))
    outputs = [*(processor.processed(memory, named, lambda k: None) if len(rows) else ()), *processor.evicted(memory, END_US)]
    names = [c.split()[0] for c in processor.out_schema.split(", ")]
    return pd.concat(outputs, ignore_index=True)[names] if outputs else pd.DataFrame(columns=names)
