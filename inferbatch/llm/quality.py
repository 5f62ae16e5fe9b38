"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a row of plain text statistics. Training is cyclic boosting: round after
round, every feature in turn gets one small tree on the current residuals, added with a low rate
to the feature's lookup table; then the most useful pairs of features get two-dimensional tables
the same way. A score is the intercept plus one table entry per feature and pair, looked up for a
whole batch at once.

Training uses at most `most_rows` labelled documents (those with the smallest hash of their id), a
documented bound; only their statistics, some twenty numbers each, reach the driver. Scoring reads
every whole text.

Defined results: a null text counts as empty and gets the score of an empty text; rows with a null
id or label are not trained on; of several labels for one id the largest counts; with no usable
labels every score is 0.5, with labels of one class only that class's smoothed share; repeated rows
and texts get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
RATE = 0.12
RIDGE = 2.0
SYMBOL = re.compile(r"[#$%&*|@^~_=+<>{}\[\]\\/]")
END = (".", "!", "?")

FEATURES = (
    "log_words", "mean_word", "long_words", "symbols", "bars", "exclaims", "upper", "digits", "distinct_words",
    "distinct_pairs", "top_word", "repeated_lines", "words_per_line", "longest_line", "ends", "non_ascii", "commas",
    "short_words",
)


def statistics(text: str) -> list[float]:
    """The features of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    line_words = [x.count(" ") + 1 for x in lines]
    upper = sum(w.isupper() for w in words)
    return [
        float(np.log1p(n)),
        chars / n,
        float((lengths > 12).mean()),
        len(SYMBOL.findall(text)) / chars,
        counts.get("|", 0) / n,
        text.count("!") / chars,
        upper / n,
        sum(text.count(d) for d in "0123456789") / chars,
        len(counts) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(np.log1p(max(line_words))),
        sum(w.endswith(END) for w in words) / n,
        1 - len(text.encode("ascii", "ignore")) / len(text),
        text.count(",") / n,
        float((lengths <= 2).mean()),
    ]


@dataclass(frozen=True)
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: one addition per table."""
        z = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], side="right") for p in self.pairs for k in p[:2]}
        for i, j, table in self.pairs:
            z += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins: split the best segment until `leaves`."""
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = None
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gains = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(np.argmax(gains))
            if gains[k] > 1e-9 and (best is None or gains[k] > best[0]):
                best = (gains[k], a + k + 1)
        if best is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree on two features: the best cut of the first, then the best cut of the second on each side."""
    best, out = 0.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        total, value = 0.0, np.zeros_like(g)
        for side in (slice(0, cut), slice(cut, None)):
            gs, hs = g[side].sum(0), h[side].sum(0)
            leaf = _tree(gs, hs, 2)
            total += float((2 * leaf * gs - leaf * leaf * (hs + RIDGE / len(hs))).sum())
            value[side] = leaf
        if total > best:
            best, out = total, value
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Train on rows of features and 0/1 labels."""
    if not len(y):
        return Model(0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model(intercept)
    n_features = x.shape[1]
    edges = [_edges(x[:, k], BINS) for k in range(n_features)]
    binned = [np.searchsorted(edges[k], x[:, k], side="right") for k in range(n_features)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(n_features):
            g, h = gradients()
            size = len(tables[k])
            step = RATE * _tree(np.bincount(binned[k], g, size), np.bincount(binned[k], h, size))
            tables[k] += step
            z += step[binned[k]]
    pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(n_features)]
    coarse = [np.searchsorted(pair_edges[k], x[:, k], side="right") for k in range(n_features)]
    sizes = [len(e) + 1 for e in pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = gradients()
    ranked = sorted(
        (-_pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(n_features) for j in range(i + 1, n_features)
    )
    chosen = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in ranked[:PAIRS] if gain < 0]
    for _ in range(ROUNDS // 2):
        for i, j, table in chosen:
            g, h = gradients()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[0]
            table += step
            z += step[coarse[i], coarse[j]]
    return Model(intercept, edges, tables, pair_edges, chosen)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the array of its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, x array<double>")


def training_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", most_rows: int = MOST_ROWS
) -> DataFrame:
    """The columns of `docs` plus `label`, for at most `most_rows` labelled ids."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    # At most `most_rows` ids and labels: small enough to send to every task.
    return docs.join(F.broadcast(known), docs[id_col] == known["__id"]).drop("__id")


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    most_rows: int = MOST_ROWS,
) -> Model:
    """Fit on a bounded sample of the labelled documents."""
    picked = training_sample(docs.select(id_col, text_col), labels, label_col, id_col, most_rows)
    # The label travels in place of the id; the id itself is no input.
    rows = features(picked.select("label", text_col), "label", text_col).orderBy("doc_id", "x").collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["doc_id"] for r in rows], dtype=float))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column(1)], dtype=float)
            score = pa.array(model.score(x.reshape(batch.num_rows, len(FEATURES))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column(at)], dtype=float)
            yield batch.filter(pa.array(model.score(x.reshape(batch.num_rows, len(FEATURES))) >= threshold))

    return docs.select(*columns).mapInArrow(run, docs.schema)
