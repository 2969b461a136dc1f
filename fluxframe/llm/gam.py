"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles. Boosting goes round the features; each step fits a tree of three leaves over
one feature's bins to the gradient of the logistic loss and adds a small part of it to that feature's lookup table. The
pairs of features whose coarse grid explains most of what is left get tables of their own, learned the same way. A score is
the sum of one entry of each table, so a batch is scored by vectorised lookups and additions.

The model is fitted on a sample of labelled rows of bounded size (SAMPLE), chosen by the hash of their ids; held-out rows
are never in it. Features are computed where the text is, in one pass, and every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, in_small_batches

#: Labelled rows that are used for fitting, at most.
SAMPLE = 30_000
BINS, COARSE, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 48, 8, 4, 150, 60, 0.1
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_next", "dup_lines", "symbols", "bars", "marks", "upper", "digits",
    "stops", "short_words", "non_ascii", "line_length",
)
_SPLIT = re.compile(rb"[^ \t-\r]+")
_CLASS = np.zeros((256, 7))
for _i, _chars in enumerate((b"#*$%&<>", b"|", b"!?", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:")):
    _CLASS[list(_chars), _i] = 1
_CLASS[128:, 6] = 1


def features(text: bytes) -> list[float]:
    """The features of one whole text; all zero without a word."""
    words = _SPLIT.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = sum(map(len, words))
    symbols, bars, marks, upper, digits, stops, high = (counts @ _CLASS / chars).tolist()
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n
    short = sum(len(w) < 4 for w in words) / n
    return [np.log1p(n), min(chars / n, 1e3), len(set(words)) / n, repeated, 1 - len(set(lines)) / len(lines), symbols, bars, marks, upper, digits, stops, short, high, np.log1p(n / len(lines))]


@dataclass
class Model:
    """edges[f]: the inner edges of feature f's bins; tables[f]: an entry per bin; pairs: ((f, g), edges, edges, grid)."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        z = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], "right")]
        for (f, g), ef, eg, t in self.pairs:
            z += t[np.searchsorted(ef, x[:, f], "right"), np.searchsorted(eg, x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values per bin of a tree that splits the bins in order, best gain first."""
    parts = [(0, len(g))]
    gain_of = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
                gain = np.where((hl > 0.5) & (hr > 0.5), gl**2 / (hl + 1) + gr**2 / (hr + 1) - gain_of(a, b), 0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, a + at + 1))
        if best[1] is None:
            break
        k, at = best[1]
        a, b = parts[k]
        parts[k : k + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four leaves, as (gain, values)."""
    gc, hc = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    best = (0.0, np.zeros_like(g))
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            q = [(gc[a, b] - gc[a0, b] - gc[a, b0] + gc[a0, b0], hc[a, b] - hc[a0, b] - hc[a, b0] + hc[a0, b0]) for a0, a in ((0, i), (i, len(g))) for b0, b in ((0, j), (j, g.shape[1]))]
            gain = sum(x**2 / (y + 1.0) for x, y in q) - gc[-1, -1] ** 2 / (hc[-1, -1] + 1.0)
            if gain > best[0]:
                v = np.empty_like(g)
                (v[:i, :j], v[:i, j:], v[i:, :j], v[i:, j:]) = (x / (y + 1.0) for x, y in q)
                best = (gain, v)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of features x and labels y; of the labels' mean alone where there are none or one kind."""
    n = len(y)
    rate = (y.sum() + 0.5) / (n + 1)
    model = Model(float(np.log(rate / (1 - rate))), [np.empty(0)] * x.shape[1], [np.zeros(1) for _ in range(x.shape[1])], [])
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(n, model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size))
            model.tables[f] += step
            z += step[b]
    coarse = [np.unique(e[np.linspace(0, len(e) - 1, COARSE - 1).astype(int)]) if len(e) else e for e in model.edges]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grid(f: int, k: int, w: np.ndarray) -> np.ndarray:
        shape = len(coarse[f]) + 1, len(coarse[k]) + 1
        return np.bincount(cells[f] * shape[1] + cells[k], w, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quadrants(grid(*p, g), grid(*p, h))[0])[:PAIRS]
    tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for p in ranked:
            g, h = slopes()
            step = RATE * _quadrants(grid(*p, g), grid(*p, h))[1]
            tables[p] += step
            z += step[cells[p[0]], cells[p[1]]]
    model.pairs = [(p, coarse[p[0]], coarse[p[1]], t) for p, t in tables.items()]
    return model


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            x = [features(t) for t in _bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["key", "label", "x"])


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = np.array([features(t) for t in _bytes(batch.column(batch.num_columns - 1))]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], [*batch.schema.names[:-1], "score"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int = SAMPLE) -> DataFrame:
    """(key, label, data): the rows of at most bound labelled ids that are not held out, by the hash of the id; texts as bytes.

    The sampled ids, of bounded number, are broadcast, so the documents are not shuffled. key is the id as text; where rows
    share one, the caller takes one of them by what it measures, so that never more than bound count.
    """
    chosen = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("double").alias("label")).filter("_lid is not null and label is not null")
    chosen = chosen.filter(~held_out("_lid")).groupBy("_lid").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_lid"), "_lid").limit(bound)
    return in_small_batches(docs).select(F.col(id_col).alias("_did"), F.col(text_col).cast("string").cast("binary").alias("data")).join(F.broadcast(cut(chosen)), F.col("_did") == F.col("_lid")).select(F.col("_lid").cast("string").alias("key"), "label", "data")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = SAMPLE) -> Model:
    """Fitted on at most bound labelled rows, which is documented as SAMPLE; only their features and labels come to the driver.

    Of rows that share an id, and of labels that do, one counts: the least features, the greatest label. Null ids and labels
    are passed over, a null or empty text has zero features, a very long one is measured whole. Without labelled rows, or
    with one kind of label, the model is their mean. Columns other than those named are not looked at, whatever their names.
    """
    measured = labelled_sample(docs, labels, id_col, text_col, label_col, bound).mapInArrow(_measure, "key string, label double, x array<double>")
    sample = measured.groupBy("key").agg(F.max("label").alias("label"), F.min("x").alias("x")).toArrow()
    x = np.array(sample.column("x").combine_chunks().flatten(), float).reshape(-1, len(FEATURES))
    y = np.array(sample.column("label"), float)
    order = np.lexsort([*x.T, y])  # the same model whatever the order in which rows arrived
    return fit(x[order], y[order])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; null, empty and blank texts are scored by their zero features.

    A very long text is scored whole; repeated rows and ties get equal scores, and a score at the threshold is accepted. An
    empty table gives an empty result, and columns other than id_col and text_col are not looked at, whatever their names.
    """
    rows = in_small_batches(docs).select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("_data"))
    kind = dict(rows.dtypes)[id_col]
    scored = rows.mapInArrow(_score(model), f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model accepts, in the columns they had; texts are scored as classify scores them."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                x = np.array([features((t or "").encode()) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return in_small_batches(docs).mapInArrow(run, schema)


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
