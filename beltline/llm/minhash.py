"""Near-duplicate documents by ProbMinHash.

Every distinct shingle of a text, weighted by its count, is a Poisson process of that rate: its points arrive at
exponential distances and each falls on one of m registers. A register keeps the shingle of its earliest point. Two
texts agree in a register with probability equal to their probability Jaccard similarity. A shingle stops producing
points once its next arrival is later than every register of its text, so long texts cost about one point a shingle.

Registers are banded; texts that share a band are candidates, and the Jaccard similarity of their shingle sets decides.
Counts can part texts of equal sets, so every text has the bands of unit weights too: there the probability Jaccard
similarity is that of the sets, and a link of similarity s is a candidate with probability 1 - (1 - s**4)**20 at least.
Candidates of a band are compared with the band's pivot only, for a few pivots. Then texts of one band that are still in
different classes are compared with each other, unless a bound rules a link out: their sizes, their distances to the pivot
(the Jaccard distance is a metric), or parity sketches, which never tell more different shingles than there are. Equal
texts are one node throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import components, extended, stored, table
from .text import batches, mix, shingles

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: 64-bit parts of a parity sketch.
PARITY = 16


def counted(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts, in order of text."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])]) if len(text) else np.zeros(0, int)
    return text[new], value[new], np.diff(np.r_[new, len(text)])


def probminhash(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """n_texts x m registers, each the shingle of the earliest arrival; 0 in texts without shingles."""
    first = np.full(n_texts * m, np.inf)
    owner = np.zeros(n_texts * m, np.uint64)
    limit = np.full(n_texts, np.inf)
    at = np.zeros(len(text))
    seed, turn = mix(value + np.uint64(0x51ED)), 0
    while len(text):
        turn += 1
        draw = mix(seed + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        live = at < limit[text]
        text, value, weight, at, seed, draw = (x[live] for x in (text, value, weight, at, seed, draw))
        slot = text * m + (mix(draw) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        owner[slot[won]] = value[won]
        limit = first.reshape(n_texts, m).max(1)
    return owner.reshape(n_texts, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = registers.reshape(len(registers), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def all_keys(text: np.ndarray, value: np.ndarray, count: np.ndarray, n_texts: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_texts x 2 * bands keys, which of them are new): the bands by counts, then those by unit weights.

    Without a repeated shingle both are the same registers, so only texts with one have more than ``bands`` keys.
    """
    keys = band_keys(probminhash(text, value, count.astype(float), n_texts, bands * rows), bands, rows)
    again = np.unique(text[count > 1])
    own = np.isin(text, again)
    unit = keys.copy()
    unit[again] = band_keys(probminhash(np.searchsorted(again, text[own]), value[own], np.ones(own.sum()), len(again), bands * rows), bands, rows)
    return np.concatenate([keys, unit], 1), np.concatenate([np.ones(keys.shape, bool), unit != keys], 1)


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest (of the text), n (distinct shingles) and bands (by counts and by sets) of (doc_id, text)."""

    def run(parts):
        for part in parts:
            raw = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            n, keys, many = np.zeros(len(raw), np.int32), [np.zeros(0, np.int64)], np.zeros(len(raw) + 1, np.int32)
            for a, b in batches([len(x) for x in raw]):
                t, v, c = counted(*shingles(raw[a:b], width))
                n[a:b] = np.bincount(t, minlength=b - a)
                key, new = all_keys(t, v, c, b - a, bands, rows)
                keys.append(key[new])
                many[a + 1 : b + 1] = new.sum(1)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(many, dtype=np.int32)), pa.array(np.concatenate(keys)))
            digest = pa.array([hashlib.md5(x).digest() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), digest, pa.array(n), lists], ["doc_id", "digest", "n", "bands"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, digest binary, n int, bands array<bigint>")


def parities(text: np.ndarray, value: np.ndarray, n_texts: int) -> np.ndarray:
    """n_texts x PARITY: every shingle flips one of 64 * PARITY bits.

    Shingles that two texts share flip the same bits, so at least as many shingles differ as bits do. With as many bits
    as shingles the bound is nearly the count; for much longer texts it is weak, never wrong.
    """
    out = np.zeros(n_texts * PARITY, np.uint64)
    bit = mix(value) % np.uint64(64 * PARITY)
    np.bitwise_xor.at(out, text * PARITY + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n_texts, PARITY).view(np.int64)


def shingle_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, set (sorted 32-bit shingle hashes), parity (of the set) of (node, text)."""

    def run(parts):
        for part in parts:
            raw = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            out, odd = [], []
            for a, b in batches([len(x) for x in raw]):
                t, v = shingles(raw[a:b], width)
                t, v, _ = counted(t, v >> np.uint64(32))
                edge = np.searchsorted(t, np.arange(b - a + 1))
                values = v.astype(np.uint32).view(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values)))
                odd.append(parities(t, v, b - a))
            lists = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
            flat = np.concatenate(odd) if odd else np.zeros((0, PARITY), np.int64)
            parity = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), PARITY).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists, parity], ["node", "set", "parity"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, set array<int>, parity array<bigint>")


def compared(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """a, b, sim of ``pairs`` (a, b), written."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("sim")), name)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, pivots: int = 3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, digest, root, class_id, n_links_found.

    root numbers the classes of this run. class_id is the smallest doc_id of the class of texts joined by links of at least ``similarity``; n_links_found
    counts the links that the search came across, each once: those that decide the class, not all there are, and which
    ones depends on how the rows are dealt. Texts without words (null, empty, punctuation) are in a class
    with equal texts only. Null doc_ids are kept and name a class only if it has no other: as ids may repeat or be null, different classes can have one class_id, never one root.
    """
    seen = stored(signatures(docs, width, bands, rows), "signatures")
    nodes = stored(seen.groupBy("digest").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows_ = nodes.where("n > 0").select("node", "n", F.explode("bands").alias("key"))
    busy = rows_.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("low")).where("many > 1")
    members = stored(rows_.join(busy.select("key", "low"), "key"), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "digest", "doc_id"), "node")
    texts = docs.select("doc_id", "text").join(wanted.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))) \
        .where(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))) == F.col("digest")).dropDuplicates(["node"])
    sets = stored(shingle_sets(texts, width), "sets")

    fits = f"least(n, n2) >= {similarity} * greatest(n, n2)"
    sizes = nodes.select(F.col("node").alias("node2"), F.col("n").alias("n2"))
    known, roots = None, None
    for r in range(pivots):
        if r == 0:
            pairs = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"), "n").distinct()
            pairs = pairs.join(sizes, pairs["a"] == sizes["node2"]).where(fits).select("a", "b")
        else:
            # bands whose members are in several classes get another pivot
            split = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            pick = split.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                            F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "root", "n")).alias("p")).where("lo < hi").select("key", "p.node", "p.root", "p.n")
            pairs = split.join(pick.select("key", F.col("node").alias("p"), F.col("root").alias("proot"), F.col("n").alias("n2")), "key").where("root <> proot").where(fits) \
                .select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        new = compared(pairs, sets, "compared")
        known = new if known is None else known.unionByName(new)
        near = new.where(F.col("sim") >= similarity).select("a", "b")
        roots = stored(components(near) if roots is None else extended(roots, near), "roots")

    split = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = split.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    to_low = known.select(F.col("a").alias("low"), F.col("b").alias("node"), "sim")
    rest = stored(split.join(mixed, "key", "left_semi").where("node <> low").join(to_low, ["low", "node"], "left")
                  .join(nodes.select("node", "bands"), "node").join(sets.select("node", F.size("set").alias("size"), *(F.col("parity")[k].alias(f"p{k}") for k in range(PARITY))), "node"), "rest")
    one, two = rest.alias("o"), rest.alias("t")
    differ = sum((F.bit_count(F.col(f"o.p{k}").bitwiseXOR(F.col(f"t.p{k}"))) for k in range(PARITY)), F.lit(0))
    both = F.col("o.size") + F.col("t.size")
    # each pair once, in the first band that it shares
    on = (F.col("o.key") == F.col("t.key")) & (F.col("o.node") < F.col("t.node")) & (F.col("o.root") != F.col("t.root")) \
        & (F.least("o.n", "t.n") >= similarity * F.greatest("o.n", "t.n")) \
        & ((F.abs(F.col("o.sim") - F.col("t.sim")) <= 1 - similarity) | F.col("o.sim").isNull() | F.col("t.sim").isNull()) \
        & (both - differ >= similarity * (both + differ)) \
        & (F.array_intersect("o.bands", "t.bands")[0] == F.col("o.key"))
    last = one.join(two, on).select(F.col("o.node").alias("a"), F.col("t.node").alias("b")).distinct() \
        .join(known.select("a", "b"), ["a", "b"], "left_anti")
    near = compared(last, sets, "compared").where(F.col("sim") >= similarity).select("a", "b")
    roots = extended(roots, near)
    found = known.where(F.col("sim") >= similarity).select("a", "b").unionByName(near)
    links = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links_found"))
    named = nodes.select("node", "digest", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = named.join(names, "root").join(links, "node", "left").select("digest", "root", "class_id", F.coalesce("n_links_found", F.lit(0)).alias("n_links_found"))
    return seen.select("doc_id", "digest").join(classes, "digest").select("doc_id", "digest", "root", "class_id", "n_links_found")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links_found")
