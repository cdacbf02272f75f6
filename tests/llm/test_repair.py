"""Structure repair against a plain search over (cost, edits), and the query against the contract's steps row by row."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest

from beltline.llm import repair as R

ROLES = {"s": 0, "u": 1, "a": 2}
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired turns) by carrying for each state the least (cost, audit) over the rows."""
    best = {0: (0, "", [])}

    def put(into, state, cost, audit, turns):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, turns)

    def inserts(now):
        for _ in range(3):
            for s, (c, a, t) in list(now.items()):
                letter = "a" if s == 2 else "u"
                put(now, STEP[s, letter], c + 3, a + "I", t + [("assistant" if letter == "a" else "user", "")])
        return now

    for (_, role, text), f in zip(rows, faults(rows)):
        after = {}
        for s, (c, a, t) in inserts(dict(best)).items():
            put(after, s, c + 4, a + "D", t)
            if f in ("", "truncated"):
                more = 3 * (f == "truncated")
                if (s, role[:1]) in STEP:
                    put(after, STEP[s, role[:1]], c + more, a + "K", t + [(role, text)])
                letter = "a" if s == 2 else "u"
                put(after, STEP[s, letter], c + 3 + more, a + "R", t + [("assistant" if letter == "a" else "user", text)])
        best = after
    return min(v for s, v in inserts(dict(best)).items() if s in (0, 3))


def pairs(rows):
    letters = [r[1][:1] for r in rows]
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:]))


def random_rows(rng, n):
    texts = ["Yes.", "No", "", " \t", "Why?", "ü!", "one", "two."]
    return [(rng.choice([None, *range(max(1, n))]), rng.choice(["user", "assistant", "system", "tool", "", "ux"]), rng.choice(texts) + (str(rng.random()) + "." if rng.random() < 0.6 else "")) for _ in range(n)]


def codes(rows):
    f = {x: i for i, x in enumerate(R.FAULTS)}
    return [ROLES.get(r[1][:1], 3) + 4 * f[x] for r, x in zip(rows, faults(rows))]


def test_walk_equals_search():
    rng = random.Random(2)
    for _ in range(60):
        convs = [order(random_rows(rng, rng.choice([0, 1, 2, 3, 7, 20]))) for _ in range(12)]
        flat, sizes = np.array([c for rows in convs for c in codes(rows)], np.int64), np.array([len(x) for x in convs])
        walk = R.Walk(flat, sizes, R.DONE[None].repeat(len(convs), 0))
        op, _, extra, _, more, end = walk.edits(np.zeros(len(convs), int))
        cost, at = walk.first()[:, 0], 0
        assert set(end) <= {0, 3}
        for i, rows in enumerate(convs):
            here = range(at, at + len(rows))
            audit = "".join("I" * extra[k] + "DKR"[op[k]] for k in here) + "I" * more[i]
            assert (cost[i], audit) == brute(rows)[:2]
            at += len(rows)


def test_only_checkpoints_are_kept():
    n = 10_000
    walk = R.Walk(np.array([1, 2] * (n // 2)), np.array([n]), R.DONE[None])
    assert len(walk.marks) == 101 and max(len(b) for _, b in walk.blocks()) == 101
    op, _, extra, _, more, _ = walk.edits(np.zeros(1, int))
    assert set(op) == {1} and not extra.any() and not more.any()


def expected(rows):
    rows = order(rows)
    cost, audit, turns = brute(rows)
    known = [r[0] for r in rows if r[0] is not None]
    f = faults(rows)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(f.count(x) for x in R.FAULTS[1:]), pairs(rows), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def given():
    rng = random.Random(9)
    convs = {i: random_rows(rng, rng.choice([1, 2, 4, 9])) for i in range(150)}
    convs[500] = [(i, "user" if i % 2 else "assistant", f"Turn {i}.") for i in range(3000)]
    convs[None] = random_rows(rng, 40)
    convs[501] = [(1, "user", "Same.")] * 30
    convs[502] = [(1, "user", None), (None, None, "x."), (2, None, None)]
    return [(k, t, r, x) for k, rows in convs.items() for t, r, x in rows]


def spoiled(k, t, role, text):
    name = f"{' ' if k is None else k}:{' ' if t is None else t}"
    deal = zlib.crc32(name.encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = {1: "", 2: re.sub("[.!?]", "", text)}.get(deal, text)
    return [] if deal == 0 else [(t, "user" if deal == 4 else role, text)] * (2 if deal == 3 else 1)


def wanted():
    rows = sorted(given(), key=lambda r: repr(r[0]))
    return [(k, *expected([x for r in g for x in spoiled(*r)])) for k, g in groupby(rows, key=lambda r: r[0])]


SCHEMA = "conv_id long, turn long, role string, text string, key string, blk int"


@pytest.mark.parametrize("partitions", [3, 40])
def test_query_equals_brute_force(spark, tmp_path, partitions):
    """With many partitions the long conversation lies on several of them."""
    spark.createDataFrame([(*r, "own", 1) for r in given()], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.op11_structure_repair(spark, str(tmp_path))
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        rows = sorted(map(tuple, got.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rows == sorted(wanted(), key=repr)


def test_a_conversation_on_several_blocks(spark):
    rows = [(None, i, random.Random(i).choice(["user", "assistant", "system"]), random.Random(-i).choice(["Hm.", f"{i}.", f"{i}", ""])) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        messages = spark.createDataFrame(rows, "conv string, turn long, role string, text string")
        got = sorted(R.repair(messages).collect(), key=lambda r: (r["at"], r["step"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    cost, audit, turns = brute(order([r[1:] for r in rows]))
    assert (sum(r.cost for r in got), "".join(r.edit for r in got)) == (cost, audit)
    assert [(r.role, r.text) for r in got if r.edit != "D"] == turns and len({r["at"] >> 33 for r in got}) > 5


def test_empty_table(spark):
    assert R.repair(spark.createDataFrame([], "conv long, turn long, role string, text string")).collect() == []
