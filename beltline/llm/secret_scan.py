"""Secrets in texts, told apart by who has them.

Patterns propose candidates. The corpus decides: the value of a candidate, as a hash, is counted by distinct
repositories and distinct owners, and both decide. A value that several owners hold, or that one owner has in many
repositories, is an example everybody copied; one that stays with a few of both looks like a live credential. Undeclared
tokens (long random strings outside the patterns) are reported only if they are owner-specific.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored, table
from .text import batches, joined

#: The base patterns and their order.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What no pattern names: 20 or more characters of the usual encodings.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX, _TOKEN = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


def random_looking(value: str, bits: float) -> bool:
    """Letters in both cases and digits, at least ``bits`` of entropy per character."""
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    _, n = np.unique(list(value), return_counts=True)
    p = n / len(value)
    return float(-(p * np.log2(p)).sum()) >= bits


def spans(text: str, bits: float, runs: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of all candidates of a text, base kinds first at the same start."""
    low = text.lower()
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if runs:
        out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
        base = sorted((s, e) for s, e, _, _ in out)
        starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
        for m in TOKEN.finditer(text):
            before = bisect_left(starts, m.end())  # base spans that start before the token ends
            if random_looking(m[0], bits) and not (before and reach[before - 1] > m.start()):
                out.append((m.start(), m.end(), "token", m[0]))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def long_runs(raw: list[bytes]) -> np.ndarray:
    """Which texts hold a run of 24 hex digits or 20 token characters."""
    data, starts = joined(raw)
    hit = np.zeros(len(raw), bool)
    for table_, least in ((_HEX, 24), (_TOKEN, 20)):
        edge = np.flatnonzero(np.diff(table_[data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        begin, end = edge[0::2], edge[1::2]
        hit[np.searchsorted(starts, begin[end - begin >= least], "right") - 1] = True
    return hit


CANDIDATES = "array<struct<start:long,end:long,kind:string,value:string>>"


def scan(docs: DataFrame, bits: float = 3.5) -> DataFrame:
    """doc, repo, owner (passed through) and the candidates of every whole text; values are SHA-256 digests."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))
        for part in parts:
            raw = part.column("text").cast(pa.binary()).to_pylist()
            found = []
            for a, b in batches([len(x) for x in raw], 4 << 20):
                for x, runs in zip(raw[a:b], long_runs(raw[a:b]).tolist()):
                    found.append([{"start": s, "end": e, "kind": k, "value": hashlib.sha256(v.encode()).hexdigest()}
                                  for s, e, k, v in spans(x.decode("utf-8", "replace"), bits, runs)])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "repo", "owner")), pa.array(found, kind)],
                                             ["doc", "repo", "owner", "found"])

    kept = docs.select("doc", "repo", "owner", F.coalesce("text", F.lit("")).alias("text"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:3])
    return kept.mapInArrow(run, f"{shape}, found {CANDIDATES}")


def ownership(candidates: DataFrame) -> DataFrame:
    """value, n_rows, n_repos, n_owners over the corpus. Counted by (value, owner, repo) first, so that hot values meet combined."""
    rows = candidates.select("repo", "owner", F.explode(F.array_distinct("found.value")).alias("value")).groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    owners = rows.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return owners.groupBy("value").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, max_owners: int = 1, max_repos: int = 10, bits: float = 3.5) -> DataFrame:
    """One row for each row of ``docs`` (doc, repo, owner, text): its candidates, each with ``n_repos``, ``n_owners`` and ``live``.

    live: at most ``max_owners`` owners hold the value, in at most ``max_repos`` repositories together (a repository of
    two owners counts for each). Null and empty texts have no candidates; null repositories and owners each count as
    one, so a value of many repositories without a named owner is no live one. Repeated rows are reported each and
    count as one repository. ``token`` candidates that are not live are dropped.
    """
    found = stored(scan(docs.withColumn("repo", F.coalesce(F.col("repo").cast("string"), F.lit("")))
                        .withColumn("owner", F.coalesce(F.col("owner").cast("string"), F.lit(""))), bits)
                   .withColumn("row", F.monotonically_increasing_id()), "secrets")
    held = stored(ownership(found), "holders")
    total = held.agg(F.sum("n_rows")).first()[0] or 0
    # fewer than 1000 values can lie in more than a thousandth of the rows; no other one is hot
    often = F.broadcast(held.where(F.col("n_rows") * 1000 > total))
    flat = found.select("row", F.explode(F.array_distinct("found.value")).alias("value"))
    counts = flat.join(often, "value").unionByName(flat.join(often.select("value"), "value", "left_anti").join(held, "value"))
    by_row = counts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("n_repos", "n_owners")))).alias("held"))
    marked = found.join(by_row, "row", "left")
    return marked.select("doc", "repo", "owner", F.expr(
        "filter(transform(found, f -> named_struct('start', f.start, 'end', f.end, 'kind', f.kind, 'value', f.value,"
        " 'n_repos', held[f.value].n_repos, 'n_owners', held[f.value].n_owners,"
        f" 'live', held[f.value].n_owners <= {int(max_owners)} AND held[f.value].n_repos <= {int(max_repos)})),"
        " f -> f.kind <> 'token' OR f.live)").alias("found"))


def op8_secret_ownership(spark, sf_dir: str) -> DataFrame:
    """Every document is a repository of its own; its source is the owner. ``holders``: repositories/owners of each span."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("repo"), F.col("source").alias("owner"), "text")
    one = "concat(f.kind, ':', f.start, ':', f.end)"
    return find_secrets(docs).select(
        F.col("doc").alias("doc_id"),
        *(F.expr(f"CAST(size(filter(found, f -> f.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.expr(f"sha2(array_join(transform(filter(found, f -> f.kind <> 'token'), f -> {one}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(found, f -> {one}), ',')").alias("spans"),
        F.expr("CAST(size(filter(found, f -> f.live)) AS LONG)").alias("n_live"),
        F.expr("array_join(transform(found, f -> concat(f.n_repos, '/', f.n_owners)), ',')").alias("holders"))
