"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, harm verb, target, negation, report, speaker, future, vow (speaker and future in one word),
clause end, other. Small transducers read the symbols: one passes on insults' weights, the second of a row at half; one
recognises threats, "speaker future harm target" or, as verbs come last in some languages, "speaker future target harm",
with few words between and none that negates; three hold context, whether a target was named, a negation is near, or the
clause reports speech, on either side of what is said. Their composition is one table of product states, so a clause is
scored in one pass: a negated insult counts little, a reported clause less, and one aimed at a target more. A text's score
is a logistic function of what its clauses add up to.

The insult lexicon, of words and of stems, is learned from a bounded sample of labelled rows (SAMPLE): entries whose texts
are nearly all toxic, chosen so that every toxic text is covered several times. Near copies in the sample count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, in_small_batches
from .gam import labelled_sample
from .minhash import minhash
from .shingle import shingle_sets

#: Labelled rows that are used for learning, at most. All that comes to the driver is of these.
SAMPLE = 12_000
STEMS = (4, 5, 6)
COVER, PURITY = 3, 0.9
#: Texts not yet covered that an entry has to add.
LEAST_GAIN = 2
THRESHOLD = 0.5

OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, SPEAKER, FUTURE, VOW, END = range(10)
#: Function words of the grammar, in four languages.
WORDS = {
    HARM: "kill hurt beat destroy shoot stab töten schlagen umbringen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself u du dich dir dein deine euch tu te toi ton ta vous votre tú ti usted ustedes tus",
    NEGATION: "not no never isn aren wasn don doesn won wouldn couldn shouldn cannot nicht kein keine nie pas jamais aucun nunca jamás tampoco",
    REPORT: "said says saying claimed reported quoted wrote alleged sagte sagt behauptete berichtete dit disait affirme écrit dijo dice afirmó escribió",
    SPEAKER: "i we ich wir je nous yo nosotros",
    FUTURE: "will shall gonna going ll",
    VOW: "werde werden vais allons voy vamos",
}
SYMBOLS = {word: symbol for symbol, words in WORDS.items() for word in words.split()}
#: Words, ends of clauses, and ends of quoted speech, which do not end the clause that reports it.
_TOKENS = re.compile(r"[^\W_]+|[.!?]+[\"'”’»](?=\s*[^\W_])|[.!?;\n]")
#: Words over which a negation reaches, and words that may stand between the parts of a threat.
NEAR, GAP = 3, 3
NEGATED, REPORTED, AIMED, THREAT, AGAIN = 0.35, 0.5, 1.4, 4.0, 0.5


class Transducer(NamedTuple):
    """step(state, symbol) -> state. Clause ends return every transducer to its start."""

    start: Hashable
    states: tuple[Hashable, ...]
    step: Callable[[Hashable, int], Hashable]


#: Parts of a threat that were read, and words since the last one: stage 1 has a speaker, 2 a future, 3 harm and wants a
#: target, 4 a target and wants harm, 5 is a threat.
_THREATS = [(0, 0), *((stage, gap) for stage in range(1, 5) for gap in range(GAP + 1)), (5, 0)]


def _threat_step(state: tuple[int, int], symbol: int) -> tuple[int, int]:
    stage, gap = state
    if stage == 5:
        return state
    if symbol == NEGATION:
        return 0, 0
    if symbol == VOW:
        return 2, 0
    if symbol == SPEAKER and stage < 3:
        return 1, 0
    onward = {(1, FUTURE): 2, (2, HARM): 3, (2, TARGET): 4, (3, TARGET): 5, (4, HARM): 5}.get((stage, symbol))
    if onward:
        return onward, 0
    return (stage, gap + 1) if stage and gap < GAP else (0, 0)


TRANSDUCERS = {
    "insult": Transducer(0, (0, 1), lambda s, x: int(x == INSULT)),
    "threat": Transducer((0, 0), tuple(_THREATS), _threat_step),
    "target": Transducer(0, (0, 1), lambda s, x: 1 if x == TARGET else s),
    "negation": Transducer(0, tuple(range(NEAR + 1)), lambda s, x: NEAR if x == NEGATION else max(0, s - 1)),
    "report": Transducer(0, (0, 1), lambda s, x: 1 if x == REPORT else s),
}


class Grammar(NamedTuple):
    """next[state][symbol]; factor[state]: of an insult read in it; closing[state]: (added, factor) at the clause's end."""

    start: int
    next: list[list[int]]
    factor: list[float]
    closing: list[tuple[float, float]]


def compose(parts: dict[str, Transducer] = TRANSDUCERS) -> Grammar:
    """The product of the transducers as one table."""
    states = list(product(*(t.states for t in parts.values())))
    number = {s: i for i, s in enumerate(states)}
    start = number[tuple(t.start for t in parts.values())]
    table, factor, closing = [], [], []
    for s in states:
        at = dict(zip(parts, s, strict=True))
        table.append([start if x == END else number[tuple(t.step(k, x) for t, k in zip(parts.values(), s, strict=True))] for x in range(END + 1)])
        factor.append((NEGATED if at["negation"] else 1.0) * (AGAIN if at["insult"] else 1.0))
        told = REPORTED if at["report"] else 1.0
        closing.append((THREAT * told if at["threat"] == (5, 0) else 0.0, told * (AIMED if at["target"] else 1.0)))
    return Grammar(start, table, factor, closing)


class Lexicon:
    """Weights of words and stems; a stem, written with *, fits longer words that begin with it."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[token] = self._look(token)
        return found

    def _look(self, token: str) -> tuple[int, float]:
        if not token[0].isalnum():
            return (END if len(token) == 1 else OTHER), 0.0
        for name in (token, *(token[:k] + "*" for k in reversed(STEMS) if len(token) > k)):
            if name in self.weights:
                return INSULT, self.weights[name]
        return SYMBOLS.get(token, OTHER), 0.0


def clause_scores(text: str, lexicon: Lexicon, grammar: Grammar) -> tuple[list[float], int]:
    """The scores above 0 of the clauses of a text, and its number of tokens."""
    tokens = _TOKENS.findall(text.lower())
    symbols = [lexicon.symbol(t) for t in tokens]
    if not any(s in (INSULT, HARM) for s, _ in symbols):
        return [], len(tokens)
    out, state, held = [], grammar.start, 0.0
    for symbol, weight in [*symbols, (END, 0.0)]:
        if symbol == INSULT:
            held += weight * grammar.factor[state]
        elif symbol == END:
            added, factor = grammar.closing[state]
            if held or added:
                out.append(held * factor + added)
            held = 0.0
        state = grammar.next[state][symbol]
    return out, len(tokens)


def _inputs(scores: list[float], tokens: int) -> list[float]:
    total = sum(scores)
    return [1.0, float(bool(scores)), np.log1p(total), max(scores, default=0.0), np.log1p(100 * total / max(tokens, 1))]


@dataclass
class Model:
    weights: dict[str, float]
    coefficients: np.ndarray

    def score(self, rows: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array(rows).reshape(-1, len(self.coefficients)) @ self.coefficients, -30, 30)))


def _entries(text: str) -> set[str]:
    words = {t for t in _TOKENS.findall(text.lower()) if len(t) > 2 and t not in SYMBOLS}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _strings(column: pa.Array) -> Iterator[str]:
    return ((x or b"").decode("utf-8", "replace") for x in column.to_pylist())


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:  # uid, label, data, key
        sig = [minhash(s)[:8].astype(np.int64) if len(s) else np.zeros(8, np.int64) for s in shingle_sets(b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([s.tolist() for s in sig], pa.list_(pa.int64()))], ["uid", "label", "key", "sig"])


def _counts(kept: set[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (seen[1], seen[0]))], ["entry", "pos", "neg"])
            seen[0].clear(), seen[1].clear()
            return batch

        for b in batches:
            for uid, label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _strings(b.column(2)), strict=True):
                if uid in kept:
                    seen[int(label > 0)].update(_entries(text))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield out()
        yield out()

    return run


def _holders(kept: set[int], names: set[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(uid, sorted(_entries(text) & names)) for uid, text in zip(b.column(0).to_pylist(), _strings(b.column(2)), strict=True) if uid in kept]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["uid", "entries"])

    return run


def _describe(weights: dict[str, float], chosen: set[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, grammar = Lexicon(weights), compose()
        for b in batches:
            b = b.filter(pa.array([uid in chosen for uid in b.column(0).to_pylist()], pa.bool_()))
            x = [_inputs(*clause_scores(t, lexicon, grammar)) for t in _strings(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["uid", "label", "x"])

    return run


def support(n: int) -> int:
    """Toxic texts that an entry has to be in, of n: 2 of few, one more for every tenfold from 20 on."""
    return 2 + int(np.log10(1 + n / 20))


def choose_entries(holders: dict[int, list[str]], counts: dict[str, tuple[int, int]], cover: int = COVER) -> dict[str, float]:
    """Entries that cover every toxic text of holders cover times where they can, the most useful first, with their weights.

    What an entry is good for only falls as others are chosen, so a heap of what it was good for when last looked at finds
    the best ones without looking at all.
    """
    texts: dict[str, list[int]] = {}
    for uid, entries in holders.items():
        for e in entries:
            texts.setdefault(e, []).append(uid)
    missing = dict.fromkeys(holders, cover)
    chosen: dict[str, float] = {}
    heap = [(-len(held), e) for e, held in texts.items()]
    heapify(heap)

    def covered(e: str) -> bool:
        """A chosen stem has e's words among its own, or e's stem has a chosen one's."""
        root = e.rstrip("*")
        return any(root.startswith(c.rstrip("*")) if c.endswith("*") else c.startswith(root) and e.endswith("*") for c in chosen) or e in chosen

    while heap:
        ready: list[tuple[int, str]] = []  # entries with what they are good for now, all that may be near the best
        while heap and (not ready or -heap[0][0] >= 0.97 * max(g for g, _ in ready)):
            _, e = heappop(heap)
            if not covered(e):
                ready.append((sum(missing[u] > 0 for u in texts[e]), e))
        if not ready or (top := max(g for g, _ in ready)) < LEAST_GAIN:
            break
        # a whole word is preferred to a stem that hardly does more
        best = min((x for x in ready if x[0] >= 0.97 * top), key=lambda x: (x[1].endswith("*"), -x[0], x[1]))[1]
        for g, e in ready:
            if e != best:
                heappush(heap, (-g, e))
        pos, neg = counts[best]
        chosen[best] = float(np.clip(np.log((pos + 0.5) / (neg + 0.5)), 1, 6))
        for u in texts[best]:
            missing[u] -= 1
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = SAMPLE) -> Model:
    """Learned from at most bound labelled rows that are not held out; the sample is written once and read by each step.

    Of rows that share an id one counts, the first by its hashes. To the driver come, of the sampled rows alone, eight hashes
    each, the counts of pure entries, the entries of the toxic texts among those, and five numbers a row. Null ids and labels
    are passed over; a null or empty text has no words, and a very long one is read whole. Without toxic rows the lexicon is
    empty. Columns other than those named are not looked at, whatever their names.
    """
    sample = cut(labelled_sample(docs, labels, id_col, text_col, label_col, bound).withColumn("uid", F.monotonically_increasing_id()).select("uid", "label", "data", "key"))
    prints = sample.mapInArrow(_prints, "uid bigint, label double, key string, sig array<bigint>").groupBy("key").agg(F.min(F.struct("sig", "label", "uid")).alias("x")).select("x.*").collect()
    chosen = {r["uid"] for r in prints}
    kept, toxic, seen = set(), set(), set()
    for r in sorted(prints, key=lambda r: (r["sig"], r["label"], r["uid"])):
        marks = {(i, v, r["label"]) for i, v in enumerate(r["sig"])}
        if not marks & seen:
            kept.add(r["uid"])
            if r["label"] > 0:
                toxic.add(r["uid"])
        seen |= marks
    weights: dict[str, float] = {}
    if toxic:
        counted = sample.mapInArrow(_counts(kept), "entry string, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        pure = counted.filter((F.col("pos") >= support(len(toxic))) & (F.col("pos") >= PURITY * (F.col("pos") + F.col("neg"))))
        counts = {r["entry"]: (r["pos"], r["neg"]) for r in pure.collect()}
        held = sample.mapInArrow(_holders(toxic, set(counts)), "uid bigint, entries array<string>").collect()
        weights = choose_entries({r["uid"]: r["entries"] for r in sorted(held)}, counts)
    rows = sorted((tuple(r["x"]), r["label"]) for r in sample.mapInArrow(_describe(weights, chosen), "uid bigint, label double, x array<double>").collect())
    if not rows:
        return Model(weights, np.array([-2.0, 0, 0, 0, 0]))
    x, y = np.array([r[0] for r in rows]), np.array([float(r[1] > 0) for r in rows])
    return Model(weights, _logistic(x, y))


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, grammar = Lexicon(model.weights), compose()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = [clause_scores(t or "", lexicon, grammar) for t in b.column(2).to_pylist()]
                score = model.score([_inputs(*f) for f in found])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array([len(f[0]) for f in found], pa.int64())], [*b.schema.names[:2], "score", "n_clauses"])

    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, n_clauses, predicted) of every row; n_clauses counts clauses that scored.

    A null or empty text has no clause and gets the score of a text without matches; a very long one is read whole, clause
    by clause. Repeated rows and ties get equal scores, and a score at the threshold is toxic. An empty table gives an empty
    result; columns other than id_col and text_col are not looked at, whatever their names.
    """
    rows = in_small_batches(docs).select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)[id_col]
    scored = rows.mapInArrow(_score(model), f"`{id_col}` {kind}, held_out boolean, score double, n_clauses bigint")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
