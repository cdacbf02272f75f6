"""Toxicity: the composed grammar, the choice of lexicon units, the draw, and the query's columns."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from beltline.llm import toxicity


LEX = toxicity.Lexicon({"moron": 2.0, "morons": 2.0, "burn": 1.0}, {})


def matches(text: str):
    out, state = [], 0
    for part in toxicity.clauses(toxicity.TOKEN.findall(text)):
        found, state = toxicity.clause_matches(part, LEX, state)
        out += found
    return out


def test_target_on_both_sides_of_the_match():
    assert matches("you are a moron") == [(0, 2.0, 1)]
    assert matches("morons like you") == [(0, 2.0, 1)]
    assert matches("a moron and morons like you, moron") == [(0, 2.0, 1)] * 3
    assert matches("what a moron. you know") == [(0, 2.0, 0)]
    assert matches("you know. what a moron") == [(0, 2.0, 0)]


def test_threats_are_armed_by_an_intent_in_their_clause():
    assert matches("i will kill you") == [(0, 3.0, 1)]
    assert matches("kill the lights") == [] and matches("i will go. kill the lights") == []
    assert matches("i will not hurt them") == [(1, 3.0, 0)]
    assert matches("he wrote that he will destroy it") == [(2, 3.0, 0)]
    assert matches("burn it") == [(0, 1.0, 0)] and matches("i will burn it") == [(0, 3.0, 0)]
    assert matches('"i will kill them. moron" she never was a moron') == [(2, 3.0, 0), (2, 2.0, 0), (1, 2.0, 0)]


def test_product_automaton_equals_its_machines():
    rng = random.Random(2)
    machines = (toxicity.INSULTING, toxicity.THREATENING, toxicity.ADDRESSING, toxicity.NEGATING, toxicity.REPORTING)
    for _ in range(100):
        state, apart = 0, [0] * len(machines)
        for x in rng.choices(toxicity.SYMBOLS, k=30):
            state, said = toxicity.GRAMMAR[state][x]
            steps = [m.step(q, x) for m, q in zip(machines, apart)]
            apart = [q for q, _ in steps]
            assert said.weight == max(e.weight for _, e in steps) and said.person == max(e.person for _, e in steps)
            assert said.context == sum({e.context for _, e in steps}) and said.backward == max(e.backward for _, e in steps)


def test_cover_equals_counting_every_unit_each_time():
    rng = np.random.default_rng(4)
    for _ in range(30):
        toxic = rng.random(120) < 0.5
        units = sorted({f"u{k}{'*' if k % 3 == 0 else ''}" for k in range(25)})
        docs_of = [np.sort(rng.choice(120, rng.integers(1, 25), replace=False)) for _ in units]
        docs_of = [d[toxic[d] | (rng.random(len(d)) < 0.1)] for d in docs_of]
        open_, left, want = set(np.flatnonzero(toxic)), dict(zip(units, docs_of)), []
        while left:
            gain = {u: len(open_ & set(d)) for u, d in left.items()}
            left = {u: d for u, d in left.items() if gain[u] >= 2}
            if not left:
                break
            clean = {u: int((~toxic[d]).sum()) for u, d in left.items()}
            best = max(left, key=lambda u: (gain[u] - 5 * clean[u] - (0.1 if u.endswith("*") else 0), u))
            if gain[best] <= 5 * clean[best]:
                break
            want.append((best, gain[best], clean[best]))
            open_ -= set(left.pop(best))
        assert toxicity.cover(units, docs_of, toxic, 2) == want


def test_draw(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    many = docs.unionByName(spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("again "), "id").alias("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = {r["toxic"]: r["n"] for r in toxicity.sample(many, labels, 200, 5).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert 140 < got[0] < 260 and 140 < got[1] < 260
    # a share far below a millionth still is a share of the hash range
    assert (1 << 62) * 8000 // 10**13 > 10**9


def test_query(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(80)]
    texts = [(i, " ".join(rng.choices(words, k=20)) + (" vexling" if i % 4 == 0 else "") + (" you" if i % 8 < 3 else "")) for i in range(400)]
    texts += [(400, None), (401, ""), (402, " ".join(rng.choices(words, k=60_000)) + " vexling"), (None, "vexling you"), (4, texts[4][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit(7)).withColumn("toxic", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) and got[0].asDict().keys() >= {"doc_id", "held_out", "score", "predicted"}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by[i] == int(i % 4 == 0) for i in range(400)) and by[400] == by[401] == 0 and by[402] == by[None] == 1
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
