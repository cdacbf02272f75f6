"""URL filters: rules for hosts and paths, and a ratio of character language models for the URLs that no rule judges.

Two variable-order Markov models of characters, one of accepted and one of rejected URLs, are learned from the URLs that
rules judge. A character's probability after the ``ORDER`` characters before it is interpolated down to shorter contexts
(Witten-Bell): after context h with N characters seen, T of them different,

    P(c | h) = (n(h c) + T * P(c | h less its first character)) / (N + T),

and the shortest context falls back to an equal share for each character of the table. A URL's score is the sum over its
characters and its end of log P(accepted) - log P(rejected), divided by their number. The threshold is calibrated on a fifth of the
judged URLs that the models do not see: the score that parts their accepted from their rejected ones best.

The models are tables, one for each order, that grow with the URLs. The table of order k has one row for each string of k + 1
characters; it gets its shorter contexts by a join on the last k of them, which as many rows share as there are
characters, so no key of these joins is hot. URLs meet the models by their own windows of ``ORDER`` + 1 characters: windows
that make up a large share of all, which can only be few, are joined as a broadcast, the others by a shuffle (``frames.looked_up``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import looked_up, stored, table

#: Characters of context; width of a calibration bin and their number on each side.
ORDER, BIN, BINS = 5, 0.01, 1000
#: Stand before the first and after the last character of a URL.
BEGIN, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.

    Both are empty for a null URL and one without ``://``.
    """
    rest = F.when(url.contains("://"), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching(rules, host: Column, path: Column) -> Column:
    """The rule (struct rule, action) that judges a host and path, or null.

    ``rules`` are (action, host, path) of a list that the caller holds, so its size does not grow with the table. A rule
    fits its host and all hosts below it if the path starts with the rule's. The longest rule wins (host and path
    together); of equally long ones ``block``, then the ASCII-least.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(a).alias("action"))) for a, h, p in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,action:string>")


def windows(url: Column, order: int) -> Column:
    """For each character of ``url`` and its end, it and the ``order`` characters before it (marks before the first)."""
    text = F.concat(F.lit(BEGIN * order), url, F.lit(END))
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{%d}))." % (order + 1)), F.lit(1))


def grams(rows: DataFrame, order: int) -> list[DataFrame]:
    """Tables of order 0 to ``order``: w (its last ``order`` + 1 characters), h (w less the last), a and r (its counts in accepted and rejected URLs)."""
    out = [stored(rows.select(F.explode(windows(F.col("url"), order)).alias("w"), F.col("a").cast("long").alias("a"), F.col("r").cast("long").alias("r"))
                  .groupBy("w").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count("*").alias("n")), "grams")]
    for k in range(order - 1, -1, -1):
        out.append(stored(out[-1].groupBy(F.right("w", F.lit(k + 1)).alias("w")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("n").alias("n")), "grams"))
    return out[::-1]


def ratios(tables: list[DataFrame]) -> DataFrame:
    """w, n, lr = log P(accepted) - log P(rejected) of its last character, in units of 1e-9, for each window of the longest order."""
    share = 1.0 / max(1, tables[0].count())
    below = None
    for k, counts in enumerate(tables):
        # as many rows as there are characters share a context
        context = Window.partitionBy(F.left("w", F.lit(k)))
        rows = counts.select("w", "n", *(x for c in "ar" for x in (
            F.col(c), F.sum(c).over(context).alias(f"all_{c}"), F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"kinds_{c}"))))
        if below is None:
            rows = rows.withColumns({"less_a": F.lit(share), "less_r": F.lit(share)})
        else:
            rows = rows.withColumn("v", F.right("w", F.lit(k))).join(below.select(F.col("w").alias("v"), F.col("p_a").alias("less_a"), F.col("p_r").alias("less_r")), "v")
        # without a row of this context the shorter one stands alone
        p = [F.when(F.col(f"all_{c}") == 0, F.col(f"less_{c}")).otherwise((F.col(c) + F.col(f"kinds_{c}") * F.col(f"less_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))) for c in "ar"]
        below = stored(rows.select("w", "n", p[0].alias("p_a"), p[1].alias("p_r")), "model")
    return below.select("w", "n", F.round((F.ln("p_a") - F.ln("p_r")) * 1e9).cast("long").alias("lr"))


def threshold(scored: DataFrame, bin_: float = BIN, bins: int = BINS) -> float:
    """The edge of a bin that parts accepted (at or above it) from rejected scores with the least sum of error rates.

    ``scored`` has score and accepted. Of equally good edges the one nearest to 0 is taken, the lower of two; 0 if a class is empty.
    """
    cell = F.greatest(F.least(F.floor(F.col("score") / bin_), F.lit(bins)), F.lit(-bins))
    rows = scored.groupBy(cell.alias("cell")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")).collect()
    good, bad = {x["cell"]: x["a"] for x in rows}, {x["cell"]: x["r"] for x in rows}
    n_good, n_bad = sum(good.values()), sum(bad.values())
    if not n_good or not n_bad:
        return 0.0
    kept, best, edge = n_good, None, 0
    stopped = 0
    for t in range(-bins, bins + 2):  # at edge t everything in cells below t is blocked
        right = (kept * n_bad + stopped * n_good, -abs(t), -t)
        if best is None or right > best:
            best, edge = right, t
        kept, stopped = kept - good.get(t, 0), stopped + bad.get(t, 0)
    return edge * bin_


def judged(pages: DataFrame, rules, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages`` (page_id, url).

    verdict is the rule's action (allow, block) and rule its host and path; where no rule fits, rule is null and the models
    allow what scores at or above the threshold. score is the models' for all URLs. Learned from the different URLs that rules judge, each
    once: but for the fifth whose md5 begins with a multiple of 5 (first four hex digits), which sets the threshold. If
    no URL is accepted or none is rejected there, the threshold is 0, and without any judged URL all scores are 0: allowed.
    A null URL is scored as an empty one. Ids may be null or repeat, as rows meet their verdict by their URL (two 64-bit hashes); other columns are not read.
    """
    ids = [F.xxhash64("url").alias("u"), F.xxhash64(F.lit(1), "url").alias("v")]
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    own = own.select("page_id", *ids, "url", host.alias("host"), path.alias("path")).withColumn("match", matching(rules, F.col("host"), F.col("path")))
    held = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("long") % 5 == 0
    urls = stored(own.groupBy("url").agg(F.count("*").alias("n"), F.first("match.action").alias("action"))
                  .select("url", "n", *ids, "action", held.alias("held")), "urls")
    seen = urls.select("url", *(F.coalesce((F.col("action") == x) & ~F.col("held"), F.lit(False)).alias(c) for x, c in (("allow", "a"), ("block", "r"))))
    model = ratios(grams(seen, order))
    places = urls.select("u", "v", F.explode(windows(F.col("url"), order)).alias("w"))
    mean = (F.sum("lr") / F.count("*") / 1e9).alias("score")
    scores = stored(looked_up(places, model, ["w"], "lr").groupBy("u", "v").agg(mean).join(urls.select("u", "v", "n", "action", "held"), ["u", "v"]), "scores")
    least = threshold(scores.where("held AND action IS NOT NULL").select("score", (F.col("action") == "allow").alias("accepted")))
    out = looked_up(own.drop("url"), scores.select("u", "v", "n", "score"), ["u", "v"], "score")
    verdict = F.coalesce("match.action", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), "score")


#: Fixed values of the query: action, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), RULES).drop("score")


def _oracle(order: int = ORDER) -> str:
    order_of_rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in order_of_rules]
    case = lambda k: "CASE " + " ".join(f + "'" + v[k] + "'" for f, v in zip(fits, ((h + p, a) for a, h, p in order_of_rules))) + " END"
    parts = [f"""
WITH given AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM given),
ruled AS (SELECT *, {case(0)} AS rule, {case(1)} AS action FROM cut),
urls AS (SELECT url, min(action) AS action, ('0x' || substr(md5(url), 1, 4))::INT % 5 = 0 AS held FROM ruled GROUP BY url),
marked AS (SELECT *, repeat(chr(2), {order}) || url || chr(3) AS t FROM urls),
places AS (SELECT url, substr(t, i, {order + 1}) AS w, (coalesce(action, '') = 'allow' AND NOT held)::INT AS a, (coalesce(action, '') = 'block' AND NOT held)::INT AS r
  FROM (SELECT *, unnest(range(1, length(url) + 2)) AS i FROM marked)),
g{order} AS (SELECT w, sum(a) AS a, sum(r) AS r FROM places GROUP BY w)"""]
    for k in range(order - 1, -1, -1):
        parts.append(f"g{k} AS (SELECT right(w, {k + 1}) AS w, sum(a) AS a, sum(r) AS r FROM g{k + 1} GROUP BY 1)")
    for k in range(order + 1):
        less, join = (f"m{k - 1}.p_{{c}}", f"JOIN m{k - 1} ON right(s.w, {k}) = m{k - 1}.w") if k else ("1.0::DOUBLE / (SELECT count(*) FROM g0)", "")
        p = ", ".join(f"CASE WHEN all_{c} = 0 THEN {less.format(c=c)} ELSE (s.{c} + kinds_{c} * {less.format(c=c)}) / (all_{c} + kinds_{c})::DOUBLE END AS p_{c}" for c in "ar")
        parts.append(f"m{k} AS (SELECT s.w, {p} FROM (SELECT *, " + ", ".join(
            f"sum({c}) OVER (PARTITION BY left(w, {k})) AS all_{c}, sum(({c} > 0)::INT) OVER (PARTITION BY left(w, {k})) AS kinds_{c}" for c in "ar") + f" FROM g{k}) s {join})")
    parts.append(f"""
scores AS (SELECT url, sum(round((ln(p_a) - ln(p_r)) * 1e9)::BIGINT)::DOUBLE / count(*) / 1e9 AS score FROM places JOIN m{order} USING (w) GROUP BY url),
cells AS (SELECT least(greatest(floor(score / {BIN}), {-BINS}), {BINS}) AS cell, sum((action = 'allow')::INT) AS a, sum((action = 'block')::INT) AS r
  FROM scores JOIN urls USING (url) WHERE held AND action IS NOT NULL GROUP BY 1),
edges AS (SELECT t, (SELECT coalesce(sum(a), 0) FROM cells WHERE cell >= t) * (SELECT sum(r) FROM cells) + (SELECT coalesce(sum(r), 0) FROM cells WHERE cell < t) * (SELECT sum(a) FROM cells) AS good
  FROM (SELECT unnest(range({-BINS}, {BINS + 2})) AS t)),
edge AS (SELECT CASE WHEN (SELECT coalesce(sum(a), 0) = 0 OR coalesce(sum(r), 0) = 0 FROM cells) THEN 0 ELSE (SELECT t FROM edges ORDER BY good DESC, abs(t), t LIMIT 1) * {BIN} END AS least)
SELECT page_id, host, path, rule, coalesce(ruled.action, CASE WHEN score >= (SELECT least FROM edge) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled JOIN scores USING (url)""")
    return ",\n".join(parts)


ORACLE = _oracle()
