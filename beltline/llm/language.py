"""Language identification: averaged embeddings of hashed subwords under a linear softmax, trained by SGD in numpy.

Subwords are the byte pairs, triples and quadruples of the lower-cased text. A text's vector is the mean of its subword
vectors, so its class scores are the mean of ``embedding @ output`` rows: for prediction the two matrices collapse into
one score table, which every task holds (2**bits rows of one float per language).

Confidence is the softmax after temperature scaling on training documents that the SGD did not see; the rejection
threshold is the lowest one at which the accepted of those are right often enough.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import table
from .text import batches, joined

SIZES = (2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_FACTOR = np.uint32(2654435761)


def subwords(data: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the bucket of the subword that begins at each byte; the last size - 1 bytes have none."""
    code = data.astype(np.uint32)
    run = code
    for size in range(2, max(SIZES) + 1):
        run = (run[:-1] << np.uint32(8)) | code[size - 1 :]
        if size in SIZES:
            yield size, ((run ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * _FACTOR) >> np.uint32(32 - bits)


@dataclass
class LanguageModel:
    names: list[str]
    scores: np.ndarray  # 2**bits x languages
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int

    def logits(self, raw: list[bytes]) -> np.ndarray:
        """Of every whole text; subwords across two texts do not count."""
        data, starts = joined(raw)
        total, n = np.zeros((len(raw), len(self.names))), np.zeros(len(raw))
        size_of = np.diff(starts) - 1
        for size, bucket in subwords(data, self.bits):
            count = np.maximum(size_of - size + 1, 0)
            n += count
            for k in range(len(self.names)):
                sums = np.concatenate([[0.0], np.cumsum(self.scores[:, k].astype(np.float64)[bucket])])
                total[:, k] += sums[np.minimum(starts[:-1] + count, len(bucket))] - sums[np.minimum(starts[:-1], len(bucket))]
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        z = self.logits(raw) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def snippets(raw: bytes, rng: np.random.Generator, lengths: tuple[int, ...]) -> list[bytes]:
    """One piece of each length from a random place of the whole text."""
    out = []
    for n in lengths:
        at = int(rng.integers(0, max(1, len(raw) - n + 1)))
        out.append(raw[at : at + n])
    return out


def training_pieces(docs: DataFrame, per_language: int, lengths: tuple[int, ...], seed: int) -> DataFrame | None:
    """(lang, fold, piece) of about ``per_language`` different texts of each language: those of the lowest hashes, copies once.

    The hashes are compared on 62 bits with the share that is wanted of a language's different texts, so a language of
    any size has its texts drawn. None if there is no labelled text.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("lang", "text", F.xxhash64("text", F.lit(seed)).alias("h"))
    counts = labelled.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return None
    limit = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 62, (per_language << 62) // r["n"]))])
    drawn = labelled.where(F.col("h").bitwiseAND(F.lit((1 << 62) - 1)) < limit[F.col("lang")]).dropDuplicates(["lang", "h"])

    def run(parts):
        for part in parts:
            lang, fold, piece = [], [], []
            for name, h, text in zip(part.column("lang").to_pylist(), part.column("h").to_pylist(), part.column("text").to_pylist()):
                raw = text.lower().encode()
                rng = np.random.default_rng(h & 0x7FFFFFFF)
                mine = int(rng.integers(5))
                for x in snippets(raw, rng, lengths):
                    lang.append(name), fold.append(mine), piece.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(fold, pa.int64()), pa.array(piece, pa.binary())],
                                             ["lang", "fold", "piece"])

    return drawn.select("lang", "h", "text").mapInArrow(run, "lang string, fold long, piece binary")


def fit(docs: DataFrame, per_language: int = 1500, lengths: tuple[int, ...] = (24, 80, 240, 700), bits: int = 15, dim: int = 12,
        epochs: int = 4, rate: float = 0.4, precision: float = 0.99, most_rejecting: float = 0.5, seed: int = 7) -> LanguageModel | None:
    """Train on (text, lang). ``per_language`` bounds the labelled texts drawn (about so many different ones for each
    language), ``lengths`` the bytes kept of each, 1,044 in all by default. One task trains on these pieces, whose number does
    not grow with the table; only the model reaches the driver. None if there is no labelled text."""
    pieces = training_pieces(docs, per_language, lengths, seed)
    if pieces is None:
        return None

    def run(parts):
        rows = sorted(x for part in parts for x in zip(*(part.column(c).to_pylist() for c in ("lang", "fold", "piece"))))
        if rows:
            m = trained(rows, bits, dim, epochs, rate, precision, most_rejecting, seed)
            yield pa.RecordBatch.from_pydict({"names": [m.names], "scores": [m.scores.tobytes()], "bias": [m.bias.tobytes()], "temperature": [m.temperature],
                                              "reject_below": [m.reject_below]})

    found = pieces.repartition(1).mapInArrow(run, "names array<string>, scores binary, bias binary, temperature double, reject_below double").collect()
    if not found:
        return None
    m = found[0]
    scores = np.frombuffer(bytes(m["scores"]), np.float32).reshape(1 << bits, len(m["names"]))
    return LanguageModel(list(m["names"]), scores, np.frombuffer(bytes(m["bias"]), np.float32), m["temperature"], m["reject_below"], bits)


def trained(rows: list[tuple[str, int, bytes]], bits: int, dim: int, epochs: int, rate: float, precision: float, most_rejecting: float, seed: int) -> LanguageModel:
    """The model of sorted (lang, fold, piece): SGD on the folds from 1, temperature and threshold from fold 0. Subwords are held in two flat arrays."""
    names = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)

    def bag(raw: bytes):
        ids = np.concatenate([b for _, b in subwords(np.frombuffer(raw, np.uint8), bits)] or [np.zeros(0, np.uint32)])
        u, c = np.unique(ids, return_counts=True)
        return u, (c / max(1, len(ids))).astype(np.float32)

    ids, weights, ends = array("H" if bits <= 16 else "I"), array("f"), [0]
    for r in rows:
        u, c = bag(r[2])
        ids.frombytes(u.astype(ids.typecode).tobytes())
        weights.frombytes(c.tobytes())
        ends.append(len(ids))
    ids, weights = np.frombuffer(ids, ids.typecode), np.frombuffer(weights, np.float32)
    label = np.array([names.index(r[0]) for r in rows])
    train = np.flatnonzero([r[1] > 0 for r in rows])
    held = np.flatnonzero([r[1] == 0 for r in rows])
    embed = rng.normal(0, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, at = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            u, c = ids[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]]
            step = np.float32(rate * (1 - at / steps))
            h = c @ embed[u]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = out @ p
            out -= step * np.outer(h, p)
            bias -= step * np.float32(0.1) * p
            embed[u] -= step * 20 * np.outer(c, back)
            at += 1
    model = LanguageModel(names, (embed @ out).astype(np.float32), bias, 1.0, 0.0, bits)
    if len(held):
        z, y = model.logits([rows[i][2] for i in held]), label[held]

        def loss(t: float) -> float:
            s = z / t - (z / t).max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        best, conf = model.predict([rows[i][2] for i in held])
        order = np.argsort(-conf)
        right = np.cumsum(best[order] == y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        model.reject_below = float(min(most_rejecting, conf[order][good[-1]] if len(good) else most_rejecting))
    return model


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to every row of ``docs``, whatever its other columns are named.

    Text that is null or has no letter, and every text without a model, is ``und`` with score 0, rejected. ``rejected``
    also holds where the score is under the model's threshold; the most likely language is named all the same.
    """
    fields = docs.schema.fields
    names = [f.name for f in fields]
    at = names.index(text)

    def run(parts):
        for part in parts:
            texts = part.column(at).to_pylist()
            has = [x is not None and model is not None and _LETTER.search(x) is not None for x in texts]
            lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            rows = [i for i, ok in enumerate(has) if ok]
            raw = [texts[i].lower().encode() for i in rows]
            for a, b in batches([len(x) for x in raw], 1 << 20):
                best, conf = model.predict(raw[a:b])
                for i, k, s in zip(rows[a:b], best.tolist(), conf.tolist()):
                    lang[i], score[i], rejected[i] = model.names[k], min(1.0, s), s < model.reject_below
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             [*(f"c{i}" for i in range(len(names))), "lang_pred", "score", "rejected"])

    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    done = inner.mapInArrow(run, ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", lang_pred string, score double, rejected boolean")
    return done.toDF(*names, "lang_pred", "score", "rejected")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(~held).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
