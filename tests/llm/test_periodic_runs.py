"""Periodic runs against brute force, and the query's columns recomputed from the texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from beltline.llm import periodic_runs as P


def brute(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                s, n = i, j + q - i
                smaller = any(all(w[x] == w[x + d] for x in range(s, s + n - d)) for d in range(1, q))
                if n >= max(least, times * q) and not smaller:
                    out.append((s, n, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("times", [3, 4, 5])
def test_runs_equal_brute_force(times):
    rng = random.Random(times)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            k, w = rng.choice((1, 2, 3, 5)), []
            for _ in range(rng.randint(0, 5)):
                w += [rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
                w = w[: max(0, len(w) - rng.randint(0, 2))]
            texts.append(w)
        got = P.runs(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts]), 6, times)
        assert [tuple(map(int, r)) for r in got] == [(i, *r) for i, w in enumerate(texts) for r in brute(w, 6, times)]


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        P.runs(np.zeros(9, np.int64), np.array([9]), 6, 2)


def test_work_is_linear_in_a_long_run():
    found = P.runs(np.zeros(2_000_000, np.int64), np.array([2_000_000]))
    assert found.tolist() == [[0, 0, 2_000_000, 1]]
    steps = [len(x) for _, x, _ in P.seeds(np.arange(1_000_000) % 3, np.zeros(1_000_000, np.int64), np.arange(1_000_000, 0, -1))]
    assert sum(steps) <= 1_000_000


def cases():
    rng = random.Random(7)
    word = lambda: rng.choice(["ka", "lo", "mi", "Ärger", "漢字", "x"])
    out = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(120)]
    out += [(200 + i, "\t".join(["a", "b", "c"] * 9) + "\n\x0b" + " ".join([word() for _ in range(5)] * 6)) for i in range(20)]
    out += [(300, None), (301, ""), (302, " \n\r\x0c\t "), (303, "no break " * 8), (304, "q" * 5000), (305, "tick tock " * 3000), (None, "na " * 30), (None, None)]
    return out + out[:5]


def want(k, t):
    w = words(t)
    if k is not None and zlib.crc32(str(k).encode()) % 10 == 0 and w:
        g, n = zlib.crc32(str(k).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (k, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join("%d,%d,%d\n" % r for r in found)), digest(collapsed(w, found)))


def test_query_equals_brute_force(spark, tmp_path):
    spark.createDataFrame([(k, t, "own") for k, t in cases()], "doc_id long, text string, runs string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = [want(k, t) for k, t in cases()]
    assert sum(r[1] for r in expected) > 40
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_operator_keeps_rows_and_takes_an_empty_table(spark):
    docs = spark.createDataFrame(cases(), "doc_id long, text string")
    got = P.periodic_runs(docs).collect()
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in got), key=repr) == sorted(
        ((k, brute(words(t)), collapsed(words(t), brute(words(t))), len(words(t))) for k, t in cases()), key=repr)
    assert P.periodic_runs(docs.limit(0)).collect() == []
    assert P.looped(docs.where(F.col("doc_id").isNull())).collect() == docs.where(F.col("doc_id").isNull()).collect()
