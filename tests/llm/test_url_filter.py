"""The URL filter against a plain version of rules, interpolated models and threshold."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from beltline.llm import frames, url_filter as U

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "example.org", "/es/1"), ("block", "com", "/bad"), ("allow", "com", "/bad")]


def parts(url):
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = re.match(r"([^/?#]*)([^?#]*)", rest)
    return re.sub("[A-Z]", lambda m: m[0].lower(), cut[1]), cut[2]


def rule_of(url, rules=RULES):
    host, path = parts(url)
    fits = [(-len(h + p), a != "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[2:] if fits else (None, None)


def brute(urls, order):
    """{url: score}, threshold of the different ``urls``."""
    held = {u: int(hashlib.md5(u.encode()).hexdigest()[:4], 16) % 5 == 0 for u in urls}
    cut = lambda u: [("\x02" * order + u + "\x03")[i : i + order + 1] for i in range(len(u) + 1)]
    letters = {w[-1] for u in urls for w in cut(u)}
    models = []
    for action in ("allow", "block"):
        seen = [Counter() for _ in range(order + 1)]
        for u in urls:
            if rule_of(u)[1] == action and not held[u]:
                for w in cut(u):
                    for k in range(order + 1):
                        seen[k][w[order - k :]] += 1
        models.append(seen)

    def p(seen, w, k):
        if k < 0:
            return 1 / len(letters)
        g, less = w[order - k :], p(seen, w, k - 1)
        follow = [n for x, n in seen[k].items() if x[:-1] == g[:-1]]
        return (seen[k][g] + len(follow) * less) / (sum(follow) + len(follow)) if follow else less

    memo = {}
    for u in urls:
        for w in cut(u):
            if w not in memo:
                memo[w] = math.log(p(models[0], w, order)) - math.log(p(models[1], w, order))
    scores = {u: sum(memo[w] for w in cut(u)) / (len(u) + 1) for u in urls}
    good = [scores[u] for u in urls if held[u] and rule_of(u)[1] == "allow"]
    bad = [scores[u] for u in urls if held[u] and rule_of(u)[1] == "block"]
    edges = sorted(range(-U.BINS, U.BINS + 2), key=lambda t: (abs(t), t))
    ok = lambda t: sum(math.floor(s / U.BIN) >= t for s in good) * len(bad) + sum(math.floor(s / U.BIN) < t for s in bad) * len(good)
    return scores, max(edges, key=ok) * U.BIN if good and bad else 0.0


def cases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioknst") for _ in range(rng.randint(2, 6)))
    urls = [f"http{rng.choice(['', 's'])}://{word()}.{rng.choice(['example.org', 'EXAMPLE.com', 'net'])}/{rng.choice(['es/', 'es/1', 'bad', 'en/', 'fr/'])}{word()}{rng.choice(['', '?q=1', '#top'])}"
            for _ in range(150)]
    urls += [None, "", "no scheme", "://", "http://", "http://org", "http://org/", "http://a.org?x/y", "http://notorg/x", "ftp://example.org/es/1/://x", "http://🙂漢.org/ü🙂",
             "http://long.net/" + "spam" * 3000, "http://x.org:80/a", "http://borg/es/", "http://com/badly"]
    return list(enumerate(urls)) + [(None, urls[0]), (3, urls[3]), (None, None)] + [(1000 + i, "http://hot.net/same") for i in range(80)]


def test_equals_brute_force(spark):
    rows = cases()
    pages = spark.createDataFrame([(k, u, "h", "mine") for k, u in rows], "page_id long, url string, html string, rule string").repartition(4)
    got = U.judged(pages, RULES, order=3).collect()
    scores, least = brute({u or "" for _, u in rows}, 3)
    want = []
    for k, u in rows:
        (rule, action), s = rule_of(u or ""), scores[u or ""]
        want.append((k, *parts(u or ""), rule, action or ("allow" if s >= least else "block"), round(s, 6)))
    assert sorted((tuple(r)[:5] + (round(r.score, 6),) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_no_evidence_allows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {(r.verdict, r.score) for r in U.judged(pages, []).collect()} == {("allow", 0.0)}
    assert U.judged(pages.limit(0), RULES).collect() == []


def test_often_looked_up_keys_are_joined_once(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id < 700 THEN 0 ELSE id END AS k")
    values = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS x")
    assert sorted(map(tuple, frames.looked_up(rows, values, ["k"], "x", 0.1).collect())) == sorted([(0, 0)] * 700 + [(i, 2 * i) for i in range(700, 1000)])


@pytest.mark.parametrize("accepted,rejected,want", [([0.055, 0.2], [-0.3, 0.004], 0.01), ([0.1], [], 0.0), ([-0.5], [0.5], -0.5)])
def test_threshold(spark, accepted, rejected, want):
    rows = spark.createDataFrame([(x, True) for x in accepted] + [(x, False) for x in rejected], "score double, accepted boolean")
    assert U.threshold(rows) == pytest.approx(want)
