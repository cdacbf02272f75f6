"""Conversation structure repair: the cheapest edits that give a conversation the turns ``(system? (user assistant)+)?``.

Rows are kept (0), given the role user or assistant (3), deleted (4) or preceded by an inserted empty turn (3). A row whose
text is blank, or whose role and text came earlier, must go; one that does not end a sentence costs 3 more if it stays.
The automaton has four states: nothing yet, after system, after user, after assistant.

Square-root checkpoints. Going backward over the rows of a conversation gives the cost to the end from each state; these
vectors are stored at every c-th row only, c the square root of the number of rows. Going forward, a block's vectors are computed again
from its checkpoint, and the walk takes the ASCII-least letter (D, I, K, R) among the tight edits, those whose cost plus
the vector behind them is the vector before. All conversations of a batch are walked at once, one numpy step for
the rows that are equally far from their ends.

Rows are dealt by ranges of (conversation, turn, ...), so a conversation with a third of all rows lies on many
partitions. The part on each of them is a matrix of costs, from each state to each; a chain over these matrices gives the
vectors at the borders, a second one the state that enters each part, and then all parts are walked independently.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import looked_up, stored, table

KEEP, RETURN, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: State after the turn that a state asks for (user after nothing, system and assistant; assistant after user), and that turn.
NEXT, TURN = np.array([2, 2, 3, 2]), np.array([1, 1, 2, 1])
NAMES = np.array(["system", "user", "assistant"])
FAR = 1 << 40
#: Where a whole conversation may end.
DONE = np.array([0, FAR, FAR, 0])
FAULTS = ("", "blank", "duplicate", "truncated")


def with_inserts(v: np.ndarray) -> np.ndarray:
    """Costs from each state if up to two turns may be inserted first; a third would be where the first was."""
    one = v[:, NEXT]
    return np.minimum(np.minimum(v, INSERT + one), 2 * INSERT + one[:, NEXT])


def choices(code: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Costs (row, state, D K R) of going on with each row, ``v`` (row, state) being those behind it.

    A code is the role's class (0 system, 1 user, 2 assistant, 3 other) plus 4 times the fault (1 blank, 2 duplicate, 3 truncated).
    """
    role, fault = code & 3, code >> 2
    out = np.full((len(code), 4, 3), FAR)
    out[:, :, 0] = DELETE + v
    on = v[:, NEXT] + np.where(fault == 3, CUT, 0)[:, None]
    stays = ((fault == 0) | (fault == 3))[:, None]
    out[:, :, 1] = np.where(stays & (role[:, None] == TURN), KEEP + on, FAR)
    out[:, 0, 1] = np.where(stays[:, 0] & (role == 0), KEEP + v[:, 1] + np.where(fault == 3, CUT, 0), out[:, 0, 1])
    out[:, :, 2] = np.where(stays, RETURN + on, FAR)
    return out


class Walk:
    """Conversations (``codes`` one after another, ``sizes`` rows each) that end with the costs ``after`` (conversation, state)."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, after: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.ends = np.cumsum(sizes)[self.order]
        self.sizes, self.codes = sizes[self.order], codes
        self.longest = int(self.sizes[0]) if len(sizes) else 0
        self.every = max(1, int(np.ceil(np.sqrt(self.longest))))
        v = with_inserts(after[self.order])
        self.marks = [v]
        for t in range(1, self.longest + 1):
            v = self.before(t, v)
            if t % self.every == 0:
                self.marks.append(v)

    def alive(self, t: int) -> int:
        """How many conversations have at least ``t`` rows; they come first."""
        return int(np.searchsorted(-self.sizes, -t, side="right"))

    def before(self, t: int, v: np.ndarray) -> np.ndarray:
        """The vectors before the rows that are ``t`` from the end, from those behind them."""
        n = self.alive(t)
        return with_inserts(choices(self.codes[self.ends[:n] - t], v[:n]).min(2))

    def blocks(self):
        """The vectors of each block of rows by distance from the end, the farthest first; only one block is held."""
        for j in range(len(self.marks) - 1, -1, -1):
            low, high = j * self.every, min((j + 1) * self.every, self.longest)
            block = [self.marks[j]]
            for t in range(low + 1, high + 1):
                block.append(self.before(t, block[-1]))
            yield low, block

    def first(self) -> np.ndarray:
        """The costs from each state before the first row of each conversation."""
        out = np.zeros((len(self.sizes), 4), np.int64)
        for low, block in self.blocks():
            for t in range(low, low + len(block)):
                here = np.flatnonzero(self.sizes == t)
                out[self.order[here]] = block[t - low][here]
        return out

    def edits(self, start: np.ndarray):
        """op (0 delete, 1 keep, 2 other role), state and inserts before each row; state and inserts after the last; final state."""
        op, at, extra = (np.zeros(len(self.codes), np.int8) for _ in range(3))
        state = start[self.order].copy()
        for low, block in self.blocks():
            for t in range(low + len(block) - 1, low, -1):
                n = self.alive(t)
                row, v, s = self.ends[:n] - t, block[t - low], state[:n]
                after = choices(self.codes[row], block[t - low - 1][:n])
                at[row] = s
                open_ = np.arange(n)
                while len(open_):
                    now = v[open_, s[open_]]
                    cost = after[open_, s[open_]]
                    tight = cost == now[:, None]
                    put = ~tight[:, 0] & (v[open_, NEXT[s[open_]]] + INSERT == now)
                    took = open_[~put]
                    op[row[took]] = np.argmax(tight[~put], 1)
                    extra[row[open_[put]]] += 1
                    s[open_[put]] = NEXT[s[open_[put]]]
                    open_ = open_[put]
                role, what = self.codes[row] & 3, op[row]
                s = np.where(what == 0, s, np.where((what == 1) & (role == 0), 1, NEXT[s]))
                state[:n] = s
        last, more, v = state.copy(), np.zeros(len(state), np.int8), self.marks[0]
        open_ = np.arange(len(state))
        while len(open_):
            put = v[open_, NEXT[state[open_]]] + INSERT == v[open_, state[open_]]
            open_ = open_[put]
            more[open_] += 1
            state[open_] = NEXT[state[open_]]
        back = np.argsort(self.order)
        return op, at, extra, last[back], more[back], state[back]


def parts(batches):
    """Record batches of whole stretches of equal (blk, key), from batches in that order; a stretch may span several of them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        blk, key = b.column("blk").to_numpy(), np.array(b.column("key").to_pylist(), object)
        new = np.flatnonzero(np.r_[last is not None and last != (blk[0], key[0]), (blk[1:] != blk[:-1]) | (key[1:] != key[:-1])])
        last = (blk[-1], key[-1])
        if len(new):
            yield pa.Table.from_batches([*held, b[: new[-1]]]).combine_chunks()
            held = [b[new[-1] :]]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def stretches(t: pa.Table):
    """codes, sizes, [(blk, key) of each stretch]."""
    blk, key = t.column("blk").to_numpy(), np.array(t.column("key").to_pylist(), object)
    new = np.flatnonzero(np.r_[True, (blk[1:] != blk[:-1]) | (key[1:] != key[:-1])])
    return t.column("code").to_numpy().astype(np.int64), np.diff(np.r_[new, len(blk)]), [(int(blk[i]), key[i]) for i in new]


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("blk").sortWithinPartitions("blk", "at")


def borders(rows: DataFrame) -> dict:
    """(blk, key) -> costs behind, state before, class and turn of the row before, last; for each part of a conversation on several blocks.

    At most two such parts lie on a block, so the result is bounded by the number of partitions.
    """
    over = rows.groupBy("key").agg(F.min("blk").alias("lo"), F.max("blk").alias("hi")).where("lo < hi").select("key")
    light = rows.select("blk", "key", "at", "code", F.col("turn").cast("string").alias("turn"))
    light = stored(in_order(light.join(F.broadcast(over), "key", "left_semi")), "spans")
    if light.isEmpty():
        return {}

    def matrices(batches):
        for t in parts(batches):
            codes, sizes, names = stretches(t)
            ends = np.cumsum(sizes)
            costs = [Walk(codes, sizes, np.where(np.arange(4) == j, 0, FAR)[None, :].repeat(len(sizes), 0)).first() for j in range(4)]
            flat = np.stack(costs, 2).reshape(len(sizes), 16)
            turn = t.column("turn").take(pa.array(ends - 1))
            yield pa.RecordBatch.from_pydict({"blk": [b for b, _ in names], "key": [k for _, k in names], "cost": flat.tolist(),
                                              "role": (codes[ends - 1] & 3).tolist(), "turn": turn.to_pylist()})

    found = in_order(light).mapInArrow(matrices, "blk bigint, key string, cost array<bigint>, role bigint, turn string").collect()
    chain: dict[str, list] = {}
    for r in sorted(found, key=lambda r: r.blk):
        chain.setdefault(r.key, []).append(r)
    behind = {}
    for key, links in chain.items():
        v = DONE
        for r in reversed(links):
            behind[r.blk, key] = v
            v = np.minimum(np.array(r.cost).reshape(4, 4) + v, FAR).min(1)

    def exits(batches):
        for t in parts(batches):
            codes, sizes, names = stretches(t)
            after = np.array([behind[x] for x in names])
            walk = Walk(codes, sizes, after)
            out = [walk.edits(np.full(len(sizes), s))[3] for s in range(4)]  # inserts at the border are the next part's
            yield pa.RecordBatch.from_pydict({"blk": [b for b, _ in names], "key": [k for _, k in names], "out": np.stack(out, 1).tolist()})

    leave = {(r.blk, r.key): r.out for r in in_order(light).mapInArrow(exits, "blk bigint, key string, out array<bigint>").collect()}
    result = {}
    for key, links in chain.items():
        state, role, turn = 0, -1, None
        for i, r in enumerate(links):
            result[r.blk, key] = (behind[r.blk, key], state, role, turn, i + 1 == len(links))
            state, role, turn = leave[r.blk, key][state], r.role, r.turn
    return result


EDITS = "at bigint, step int, edit string, turn {turn}, new_turn boolean, role string, text string, fault string, illegal boolean, cost bigint"


def repair(messages: DataFrame) -> DataFrame:
    """The edits of every conversation of ``messages`` (conv, turn, role, text): the cheapest, of these the ASCII-least in order.

    One row for each edit, in order of (at, step): conv; edit (Delete, Insert, Keep or Rerole by its initial); turn, role and
    text after the edit (a deleted row's own); fault (blank, duplicate, truncated or empty; null if inserted); illegal (this row's
    role and the role of the row before do not follow each other: su, ua, au); new_turn (the first row of its turn); cost.

    Rows are taken by turn, nulls first, then role and md5 of the text; equal rows are neighbours and all but the first are duplicates.
    Null roles and texts are one space, a null conv is one conversation. An empty table has no edits. Other columns are not read.
    """
    space, key = F.lit(" "), F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    own = messages.select("conv", key.alias("key"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")) \
        .withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    order = ["key", "turn", "role", "digest"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(dealt.withColumns({"blk": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "turns")
    same = ["key", "role", "digest"]
    again = rows.groupBy(*same).agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1")
    rows = looked_up(rows, again, same, "first", how="left")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(F.col("at") > F.col("first"), 2) \
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = stored(rows.select("blk", "at", "key", "conv", "turn", "role", "text", (role + 4 * fault).cast("int").alias("code")), "coded")
    known = borders(rows)
    kind = rows.schema["turn"].dataType.simpleString()

    def run(batches):
        for t in parts(batches):
            codes, sizes, names = stretches(t)
            given = [known.get(x, (DONE, 0, -1, None, True)) for x in names]
            op, at, extra, last, more, _ = Walk(codes, sizes, np.array([g[0] for g in given])).edits(np.array([g[1] for g in given]))
            ends = np.cumsum(sizes)
            more = np.where([g[4] for g in given], more, 0)
            after = np.zeros(len(codes), np.int64)
            after[ends - 1] = more
            many = extra + 1 + after
            row = np.repeat(np.arange(len(codes)), many)
            step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            put = step != extra[row]
            tail = step > extra[row]
            of = np.repeat(np.arange(len(sizes)), sizes)[row]
            state = np.where(tail, last[of], at[row])
            turns = step - np.where(tail, extra[row] + 1, 0)
            first, second = TURN[state], TURN[NEXT[state]]
            asked = np.where(put, np.where(turns == 0, first, second), TURN[np.where(extra[row] == 0, at[row], np.where(extra[row] == 1, NEXT[at[row]], NEXT[NEXT[at[row]]]))])
            role, fault = codes & 3, codes >> 2
            before = np.r_[-1, role[:-1]]
            starts = ends - sizes
            before[starts] = [g[2] for g in given]
            wrong = (before >= 0) & ~(((before == 0) & (role == 1)) | ((before == 1) & (role == 2)) | ((before == 2) & (role == 1)))
            named = [None if x is None else str(x) for x in t.column("turn").to_pylist()]
            ahead = np.array([None, *named[:-1]], object)
            ahead[starts] = [g[3] for g in given]
            fresh = np.array([x is not None and x != y for x, y in zip(named, ahead)], bool)
            letter = np.where(put, "I", np.array(["D", "K", "R"])[op[row]])
            cost = np.where(put, INSERT, np.choose(op[row], [DELETE, KEEP, RETURN]) + np.where((op[row] > 0) & (fault[row] == 3), CUT, 0))
            taken = t.take(pa.array(row))
            roles = np.where(put | (letter == "R"), NAMES[asked], taken.column("role").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [taken.column("conv").combine_chunks(), taken.column("at").combine_chunks(), pa.array(step, pa.int32()), pa.array(letter.tolist()),
                 _where(put, None, taken.column("turn")), pa.array(~put & fresh[row]), pa.array(roles.tolist()), _where(put, "", taken.column("text")),
                 pa.array(np.where(put, None, np.array(FAULTS, object)[fault[row]]).tolist(), pa.string()), pa.array(~put & wrong[row]), pa.array(cost, pa.int64())],
                ["conv", "at", "step", "edit", "turn", "new_turn", "role", "text", "fault", "illegal", "cost"])

    return in_order(rows).mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, {EDITS.format(turn=kind)}")


def _where(put: np.ndarray, value, column: pa.ChunkedArray) -> pa.Array:
    import pyarrow.compute as pc

    column = column.combine_chunks()
    return pc.if_else(pa.array(put), pa.scalar(value, column.type), column)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text of ``conversations`` with the fault that crc32 of ``conv_id:turn`` modulo 20 deals to each row.

    0 drops it, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user. Null ids and turns are one space
    in the hashed text, null roles and texts one space.
    """
    space = F.lit(" ")
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                (F.crc32(named.cast("binary")) % 20).alias("deal")).where("deal <> 0")
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    """The faults, cost and repaired digest of every conversation after ``damaged``; the digest needs a conversation's text in one row."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    edits = repair(damaged(given)).withColumn("all_at", F.struct("at", "step", "edit", F.concat_ws(":", "role", "text").alias("turn")))
    every = given.select(F.col("conv_id").alias("conv")).distinct()
    n = lambda c: F.count(F.when(c, 1))
    out = every.unionByName(edits, allowMissingColumns=True).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - n(F.col("new_turn")), F.lit(0)).cast("long").alias("gaps"),
        *(n(F.col("fault") == x).alias(x) for x in FAULTS[1:]), n(F.col("illegal")).alias("illegal"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.sort_array(F.collect_list("all_at")).alias("e"))
    left = F.filter("e", lambda e: e["edit"] != "D")
    return out.select(F.col("conv").alias("conv_id"), "gaps", *FAULTS[1:], "illegal", "cost", F.array_join("e.edit", "").alias("audit"),
                      F.sha2(F.array_join(F.transform(left, lambda e: e["turn"]), "\n"), 256).alias("repaired_sha256"))
