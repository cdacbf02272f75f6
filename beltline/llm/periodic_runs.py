"""Periodic runs of words: stretches that repeat a block of q words at least four times over.

Seed and extend. A run of smallest period q and length of at least 4 q lies on the diagonal of lag q: words i and i + q are
equal over at least 3 q neighbouring i. Lags are dealt into classes, q in (k/2, k] for k = 1, 2, 4, ..., and the index of a
class holds the k-grams of the text: every diagonal stretch of the class is longer than k, so its k-grams are seeds. A seed
pairs an occurrence of a k-gram with the next one of the same text, never all pairs, and counts if their distance is in the
class. That is enough: if a k-gram inside the stretch came again at d < q, then k + d words would have the periods q and d
and hence, as k >= q, their greatest common divisor, and q would not be smallest. So all k-grams of a run's stretch are
seeds of lag q, and a seed's extension is the next seed: sorted by lag and place, a seed that the furthest word covered so
far for its lag reaches goes on with that stretch, and only one beyond it opens another.

k-grams are numbered exactly, by pairs of numbers of k/2-grams, and a k-gram can only come again if both halves do, so after
two or three classes little but repeated passages is left. The work is linear in the words, apart from sorting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import let, table
from .text import batches

#: The shortest run and the least number of periods in one.
LEAST, TIMES = 6, 4


def numbered(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers from 0."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def seeds(words: np.ndarray, text: np.ndarray, left: np.ndarray):
    """(k, place, lag) arrays of every lag class, for numbered ``words`` of numbered texts.

    ``left`` counts the words from each place to the end of its text.
    """
    at, gram, k = np.arange(len(words)), numbered(text, words), 1
    while len(at):
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        here, lag = at[order[:-1][same]], at[order[1:][same]] - at[order[:-1][same]]
        fits = (lag <= k) & (2 * lag > k)
        yield k, here[fits], lag[fits]
        # k-grams that come again, and from them those of 2 k words
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        number = np.full(len(words) + k, -1)
        number[at[again]] = gram[again]
        at = at[again]
        at = at[(number[at + k] >= 0) & (left[at] >= 2 * k)]
        gram, k = numbered(number[at], number[at + k]), 2 * k


def runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of at least max(``least``, ``times`` * period) words, in that order.

    ``words`` are the numbered words of all texts, one after another, ``sizes`` their counts; ``times`` is 3 at least, so
    that a diagonal stretch has seeds. The smallest period counts, and no run can be made longer with it.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods may have no seed")
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    found = [np.zeros((0, 4), np.int64)]
    for k, place, lag in seeds(words, text, ends[text] - np.arange(len(words))):
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # the last seed of a lag covers k words: a later seed within them is the same stretch
        opens = np.r_[True, (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + k) | (text[place[1:]] != text[place[:-1]])][: len(place)]
        first = np.flatnonzero(opens)
        last = np.r_[first[1:], len(place)][: len(first)] - 1
        length = place[last] + k + lag[first] - place[first]
        long = length >= np.maximum(least, times * lag[first])
        start = place[first][long]
        found.append(np.stack([text[start], start - (ends - sizes)[text[start]], length[long], lag[first][long]], 1))
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def split_words(raw: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words, their numbers one after another, counts): words are parted by blanks, tabs, line ends and form feeds."""
    words = [x.split() for x in raw]
    flat = pa.array([w for x in words for w in x], pa.binary()).dictionary_encode()
    return words, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(x) for x in words], np.int64)


def repeated(found: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words stand in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 1] + found[:, 3], 1)
    np.add.at(change, found[:, 1] + found[:, 2], -1)
    return np.cumsum(change[:n]) > 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed for every row of (doc_id, text).

    ``collapsed`` joins by one blank the words that no run has after its first period. Words are counted from 0. Null and
    blank texts have no words, no runs and an empty ``collapsed``. Every row is judged alone: ids may be null or repeat,
    equal texts have equal results, other columns are not read. A text is one task's, as it is one row's; memory follows
    the longest text, beside a few megabytes.
    """
    fields = [pa.field(x, pa.int64()) for x in ("start", "length", "period")]

    def run(parts):
        for part in parts:
            ids, raw = part.column("doc_id"), [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            for a, b in batches([len(x) for x in raw]):
                words, flat, sizes = split_words(raw[a:b])
                found = runs(flat, sizes, least, times)
                cut = np.searchsorted(found[:, 0], np.arange(b - a + 1))
                items = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=fields)
                left = [b" ".join(x for x, g in zip(w, repeated(found[cut[i] : cut[i + 1]], len(w))) if not g) if cut[i] < cut[i + 1] else b" ".join(w)
                        for i, w in enumerate(words)]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(sizes), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items),
                                                  pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words bigint, "
                                "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` with a tenth of the texts made periodic: those whose h = crc32 of the decimal doc_id is a multiple of 10.

    With n words and g = floor(h / 10), word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    Texts under a null id, and those without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    new = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), let(words, periodic)).otherwise(F.col("text"))
    return docs.withColumn("text", new)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of them made periodic (``looped``), as counts, the steepest run and digests."""
    found = periodic_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # runs are in order, so that only a steeper one replaces the best so far
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length / best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
