"""Secrets: repositories and owners both decide, spans as a plain search finds them, the query's columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from beltline.llm import secret_scan

KEY = "aZ3kQ9xW7mB2tR5vN8pL"


def token(k: int) -> str:
    return hashlib.sha256(str(k).encode()).hexdigest()[:10] + f"Zx{k:03d}QwErTyUiOp"


def found_by(rows, doc):
    return [f for r in rows if r["doc"] == doc for f in r["found"]]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, k, "one", f"x {token(1)} y") for k in range(11)]                       # 11 repositories of one owner
    data += [(100 + k, k, "two", f"{token(2)}, {token(2)}") for k in range(10)]        # 10 repositories, twice in each
    data += [(200, 1, "two", token(3)), (201, 1, "three", token(3))]                   # two owners
    data += [(300, 7, "four", f"password={KEY}")] * 30                                 # one repository, repeated rows
    data += [(400 + k, k, None, f"token: {KEY}{KEY}") for k in range(12)]              # many repositories, no owner
    data += [(500, None, None, None), (501, 1, "five", ""), (None, None, "six", token(4))]
    return secret_scan.find_secrets(spark.createDataFrame(data, "doc long, repo long, owner string, text string")).collect()


def test_repositories_and_owners_both_decide(rows):
    assert len(rows) == 11 + 10 + 2 + 30 + 12 + 3
    assert not any(found_by(rows, k) for k in range(11))  # an example of one owner
    assert [(f["live"], f["n_repos"], f["n_owners"]) for f in found_by(rows, 104)] == [(True, 10, 1)] * 2
    assert not found_by(rows, 200) and not found_by(rows, 201)
    assert {(f["kind"], f["live"], f["n_repos"]) for f in found_by(rows, 300)} == {("assign", True, 1)}
    assert [(f["kind"], f["live"], f["n_repos"], f["n_owners"]) for f in found_by(rows, 403)] == [("assign", False, 12, 1)]
    assert not found_by(rows, 500) and not found_by(rows, 501)
    assert [f["kind"] for f in found_by(rows, None)] == ["token"]


def test_tokens_avoid_base_spans():
    draw = random.Random(3)
    parts = [f"password={KEY}", token(7), "AKIA" + "A1B2C3D4" * 3, "ab12" * 8, "word", f"secret: {token(8)}/{token(9)}", token(10) + "=" + token(11)]
    for _ in range(200):
        text = draw.choice([" ", ",", "+"]).join(draw.choices(parts, k=8))
        got = secret_scan.spans(text, 3.5)
        base = [x for x in got if x[2] != "token"]
        want = [(m.start(), m.end()) for m in secret_scan.TOKEN.finditer(text)
                if secret_scan.random_looking(m[0], 3.5) and not any(s < m.end() and m.start() < e for s, e, _, _ in base)]
        assert [(s, e) for s, e, k, _ in got if k == "token"] == want


def test_query(spark, tmp_path):
    texts = [(1, f"a {token(1)}", "s"), (2, f"b {token(1)} password = hunter22", "t"), (3, f"c {token(2)}", "s"), (None, None, None), (4, "", "s")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").withColumn("row", F.lit(1)).withColumn("value", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secret_scan.op8_secret_ownership(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    at = texts[1][1].index("password")
    base = f"assign:{at}:{at + len('password = hunter22')}"
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == sha("") and got[1]["n_live"] == 0
    assert (got[2]["n_assign"], got[2]["spans"], got[2]["base_sha256"], got[2]["holders"]) == (1, base, sha(base), "1/1")
    assert got[3]["spans"] == f"token:2:{2 + len(token(2))}" and got[3]["holders"] == "1/1" and got[3]["n_live"] == 1
    assert got[None]["spans"] == got[4]["spans"] == "" and len(got) == 5
