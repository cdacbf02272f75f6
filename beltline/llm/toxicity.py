"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens become symbols: insults (weighted by the lexicon), threat words, intent words, targets, negators, reporters,
quotes, breaks, others. Five small transducers read them: insult (emits the token's weight), threat (an intent word
arms the threat words of its clause), target (an addressed person before the match or after it), negation (a negator
governs the next tokens of its clause) and reported speech (a reporter or an open quote governs the rest). Their
composition is one automaton; running it over a clause yields, for each insult or threat, its weight, the context that
governs it and whether it addresses somebody.

The grammar's frame is fixed; the insult lexicon is learned from labelled documents. Units are words and word stems
(leading 4 to 6 characters), weighed by log-odds, strongest first, each on the toxic documents that no stronger unit
explains. A logistic layer over the clause scores by context gives the probability, so that the data decide how much a
negated or a reported insult counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import product
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored, table

#: The grammar's closed word classes (English, German, French, Spanish).
INSULT_SEED = "idiot moron scum trash clown loser stupid worthless disgusting pathetic".split()
THREAT = "kill hurt destroy beat burn attack töten verletzen tuer frapper matar golpear".split()
INTENT = "will gonna shall werde wirst vais voy".split()
TARGET = "you your yours u du dich dir dein ihr tu toi te ton vous votre tú te ti tu usted".split()
NEGATION = "not no never neither nor without isn aren wasn don doesn nicht kein keine nie ne pas jamais non nunca ni sin".split()
REPORT = "said says say wrote writes claimed called quoted according reportedly sagte schrieb nannte dit écrit dijo escribió".split()

TOKEN = re.compile(r"[^\W_]+|[.!?;\n\"“”«»]", re.U)
BREAK, QUOTE = set(".!?;\n"), set("\"“”«»")
STEMS = (4, 5, 6)
CONTEXTS = 4  # plain, negated, reported, both


class Emit(NamedTuple):
    """What an arc says about the token it reads."""

    share: float = 0.0    # of the token's lexicon weight
    weight: float = 0.0   # of its own
    context: int = 0      # 1 negated, 2 reported
    person: int = 0       # 1: somebody was addressed before
    backward: int = 0     # 1: this token addresses the matches before it


class Transducer:
    """arcs[state][symbol] -> (next state, emission); ``*`` stands for symbols without an arc, which else keep the state."""

    def __init__(self, *arcs: dict[str, tuple[int, Emit]], always: tuple[Emit, ...] = ()):
        self.arcs, self.always = arcs, always or (Emit(),) * len(arcs)

    def step(self, state: int, symbol: str) -> tuple[int, Emit]:
        to, said = self.arcs[state].get(symbol) or self.arcs[state].get("*") or (state, Emit())
        return to, joint(said, self.always[state])


def joint(*said: Emit) -> Emit:
    return Emit(*(max(x) if name != "context" else reduce(or_, x) for name, x in zip(Emit._fields, zip(*said))))


def to(state: int, **said) -> tuple[int, Emit]:
    return state, Emit(**said)


#: Symbols: insult, threat word, both, intent, target, negator, reporter, quote, break, other.
SYMBOLS = ("i", "t", "b", "w", "p", "n", "r", '"', ".", "*")
THREAT_WEIGHT = 3.0
INSULTING = Transducer({"i": to(0, share=1.0), "b": to(0, share=1.0)})
#: An intent word arms the threat words after it, up to the break.
THREATENING = Transducer({"w": to(1)}, {"t": to(1, weight=THREAT_WEIGHT), "b": to(1, weight=THREAT_WEIGHT), ".": to(0)})
#: States: nobody yet, somebody addressed, a match that waits for its target.
ADDRESSING = Transducer(
    {"p": to(1), "i": to(2), "t": to(2), "b": to(2)},
    {"i": to(1, person=1), "t": to(1, person=1), "b": to(1, person=1), ".": to(0)},
    {"p": to(1, backward=1), ".": to(0)})
#: A negator reaches three tokens on; a break ends its reach.
NEGATING = Transducer({"n": to(3)}, *({"n": to(3), ".": to(0), "*": to(left)} for left in (0, 1, 2)), always=(Emit(), *(Emit(context=1),) * 3))
#: A reporter governs its clause, a quote what it encloses.
REPORTING = Transducer({"r": to(1), '"': to(2)}, {".": to(0), '"': to(2)}, {'"': to(0)}, always=(Emit(), Emit(context=2), Emit(context=2)))


def compose(*machines: Transducer) -> list[dict[str, tuple[int, Emit]]]:
    """All machines reading the same symbols: arcs of the product automaton with joint emissions; state 0 is the start."""
    states = list(product(*(range(len(m.arcs)) for m in machines)))
    number = {s: k for k, s in enumerate(states)}

    def arc(state, symbol):
        steps = [m.step(q, symbol) for m, q in zip(machines, state)]
        return number[tuple(q for q, _ in steps)], joint(*(said for _, said in steps))

    return [{x: arc(s, x) for x in SYMBOLS} for s in states]


GRAMMAR = compose(INSULTING, THREATENING, ADDRESSING, NEGATING, REPORTING)
_THREAT = set(THREAT)
_CLASS = {w: c for c, ws in (("p", TARGET), ("r", REPORT), ("n", NEGATION), ("w", INTENT), ("t", THREAT), (".", BREAK), ('"', QUOTE)) for w in ws}


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, token: str) -> float:
        got = self.words.get(token, 0.0)
        for n in STEMS:
            if len(token) > n:
                got = max(got, self.stems.get(token[:n], 0.0))
        return got

    def hits(self, tokens: set[str]) -> set[str]:
        found = {t for t in tokens if t in self.words or t in _THREAT}
        if self.stems:
            found |= {t for t in tokens if any(len(t) > n and t[:n] in self.stems for n in STEMS)}
        return found


def clauses(tokens: list[str]) -> list[list[str]]:
    out, part = [], []
    for t in tokens:
        part.append(t)
        if t in BREAK:
            out.append(part)
            part = []
    return [*out, part] if part else out


def clause_matches(part: list[str], lexicon: Lexicon, state: int = 0) -> tuple[list[tuple[int, float, int]], int]:
    """((context 0-3, weight, addressed 0/1) of every insult and threat of a clause, the state after it)."""
    out: list[tuple[int, float, int]] = []
    for t in part:
        own, symbol = lexicon.weight(t), _CLASS.get(t, "*")
        if own > 0:
            symbol = "b" if symbol == "t" else "i"
        state, said = GRAMMAR[state][symbol]
        weight = max(said.share * own, said.weight)
        if weight > 0:
            out.append((said.context, weight, said.person))
        if said.backward:
            out = [(context, w, 1) for context, w, _ in out]
    return out, state


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Of a whole text: by context the summed (as a logarithm) and the largest clause score; addressed matches."""
    tokens = TOKEN.findall(text.lower())
    got = lexicon.hits(set(tokens))
    if not got:
        return [0.0] * (2 * CONTEXTS + 1)
    total, most, addressed, state = [0.0] * CONTEXTS, [0.0] * CONTEXTS, 0, 0
    for part in clauses(tokens):
        found, state = clause_matches(part, lexicon, state) if not got.isdisjoint(part) or state or not QUOTE.isdisjoint(part) else ([], state)
        by = defaultdict(float)
        for context, weight, person in found:
            by[context] += weight
            addressed += person
        for context, weight in by.items():
            total[context] += weight
            most[context] = max(most[context], weight)
    return [*(float(np.log1p(x)) for x in total), *most, float(np.log1p(addressed))]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    coef: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> list[float]:
        none = 1 / (1 + np.exp(-self.intercept))
        out = []
        for x in texts:
            f = features(x, self.lexicon)
            out.append(float(1 / (1 + np.exp(-(self.intercept + float(np.dot(self.coef, f)))))) if any(f) else float(none))
        return out


def units_of(text: str) -> set[str]:
    """Words and stems (marked by a trailing *) of a text."""
    words = {t for t in TOKEN.findall(text.lower()) if len(t) > 2 and not t.isdigit()}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def sample(docs: DataFrame, labels: DataFrame, most: int, seed: int) -> DataFrame:
    """(text, toxic) of about ``most`` labelled documents of each class, drawn by a hash of the id, one text for each id
    (the one with the least hash), equal texts once. The draw is fine enough for any number of labels."""
    lab = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 62))
    limit = F.lit(0).cast("bigint")
    for k, n in count.items():
        limit = F.when(F.col("toxic") == k, F.lit((1 << 62) * min(most, n) // n)).otherwise(limit)
    ids = lab.where(draw < limit)
    text = F.coalesce("text", F.lit(""))
    # bounded: about most rows of two numbers for each class
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("x.h", "x.text", "toxic")
    return stored(rows.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic")


def unit_counts(rows: DataFrame) -> DataFrame:
    def run(parts):
        for part in parts:
            seen: Counter[str] = Counter()
            bad: Counter[str] = Counter()
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                u = units_of(text)
                seen.update(u)
                if toxic:
                    bad.update(u)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()),
                                              pa.array([bad[u] for u in seen], pa.int64())], ["unit", "n", "t"])

    return rows.mapInArrow(run, "unit string, n long, t long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def cover(units: list[str], docs_of: list[np.ndarray], toxic: np.ndarray, least: int) -> list[tuple[str, int, int]]:
    """(unit, toxic documents that no earlier unit explains, clean documents) in the order of choice.

    The unit with the most unexplained toxic documents for few clean ones comes next, a word before its stems, later
    names before earlier ones. Gains only fall, so a unit is counted again only when it comes to the top.
    """
    open_ = toxic.copy()
    clean = [int((~toxic[d]).sum()) for d in docs_of]

    def entry(u: int) -> tuple[float, int, int]:
        gain = int(open_[docs_of[u]].sum())
        return -(gain - 5 * clean[u] - (0.1 if units[u].endswith("*") else 0)), -u, gain

    heap, out = [entry(u) for u in range(len(units))], []
    heapify(heap)
    while heap:
        known = heappop(heap)
        u = -known[1]
        now = entry(u)
        if now[2] < least:
            continue
        if now != known:
            heappush(heap, now)
            continue
        if now[2] <= 5 * clean[u]:
            break
        out.append((units[u], now[2], clean[u]))
        open_[docs_of[u]] = False
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = 8000, least: int = 3, seed: int = 5) -> ToxicityModel:
    """``most`` bounds the documents drawn of each class; the driver holds the units of these that are frequent (in
    ``least`` toxic documents) and far more so in toxic ones, and which documents have them, as numbers. Without labels
    of both classes the seed lexicon alone decides."""
    rows = sample(docs, labels, most, seed)
    size = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    seeds = Lexicon({w: 3.0 for w in INSULT_SEED}, {})
    if not bad or not good:
        return ToxicityModel(seeds, np.array([2.0, 0, 0, 0, 0, 0, 0, 0, 0.5]), -2.0)
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (good + 1))
    rate = F.col("t") / bad * good
    listed = unit_counts(rows).where((F.col("t") >= least) & (odds > 1.5) & ((F.col("n") - F.col("t")) * 10 <= rate)).select("unit").collect()
    units = sorted(r["unit"] for r in listed)
    place = {u: i for i, u in enumerate(units)}

    def have(parts):
        for part in parts:
            got = [np.array(sorted(place[u] for u in units_of(x) & place.keys()), np.int32).tobytes() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(got, pa.binary())], ["toxic", "units"])

    seen = rows.mapInArrow(have, "toxic int, units binary").where("length(units) > 0").collect()
    toxic = np.array([r["toxic"] > 0 for r in seen], bool)
    numbers = [np.frombuffer(r["units"], np.int32) for r in seen]
    flat = np.concatenate([*numbers, np.zeros(0, np.int32)])
    doc = np.repeat(np.arange(len(seen)), [len(x) for x in numbers])
    order = np.argsort(flat, kind="stable")
    docs_of = np.split(doc[order], np.searchsorted(flat[order], np.arange(1, len(units)))) if units else []
    words, stems = {w: 3.0 for w in INSULT_SEED}, {}
    for unit, gain, clean in cover(units, docs_of, toxic, least):
        weight = max(float(np.log((gain + 0.5) / (bad + 1)) - np.log((clean + 0.5) / (good + 1))), 0.5)
        if unit.endswith("*"):
            stems[unit[:-1]] = weight
        else:
            words[unit] = weight
    lexicon = Lexicon(words, stems)

    def table_(parts):
        for part in parts:
            got = [features(x, lexicon) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(got, pa.list_(pa.float64()))], ["toxic", "x"])

    fitted = rows.mapInArrow(table_, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count("*").alias("n")).collect()
    x, y, n = np.array([r["x"] for r in fitted]), np.array([r["toxic"] > 0 for r in fitted], float), np.array([r["n"] for r in fitted], float)
    return ToxicityModel(lexicon, *logistic(x, y, n))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weighted ridge-penalised logistic regression by Newton steps; the intercept is free."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (n * p * (1 - p) + 1e-9)[:, None]) + np.diag(keep), a.T @ (n * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Of (doc_id, text): doc_id, score, one row for each row. Null and empty texts have no clause, so the model's score
    for none; equal texts have equal scores; a text of any length is read whole, and other columns are not looked at."""

    def run(parts):
        for part in parts:
            got = model.scores([x or "" for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents. A null doc_id has no label to learn from and is not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
