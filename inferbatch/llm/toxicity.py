"""Toxicity: a linear classifier trained to ignore which group a sentence names.

A document is the set of its words and of the beginnings of its words, which hold the stem of inflected
and compounded words. Their counts per label over all labelled documents pick a bounded vocabulary; a logistic model is fitted on at most `most_rows` labelled documents (those with the
smallest hash of their id), a documented bound. For every sentence of those documents that names a
group, counterfactual copies name another group of the same kind, or no group, instead; the squared
change of the score between a sentence and its copies is added to the loss, so naming a group moves
the score as little as the labels allow. Scoring reads every whole text.

Defined results: a null or empty text gets the score of a text without known parts; rows with a null
id or label are not trained on; of several labels for one id the largest counts; without usable labels
every score is 0.5; repeated rows and texts get equal scores; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferbatch.llm.quality import training_sample
from inferbatch.llm.sizes import broadcast_if_small
from inferbatch.session import materialize

# Words that name a group, by kind, and neutral words for none.
GROUPS = {
    "faith": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists",
    "gender": "woman women man men girl girls boy boys transgender frauen männer femmes hommes mujeres hombres",
    "orientation": "gay lesbian straight bisexual queer",
    "origin": "black white asian african latino mexican immigrant immigrants foreigner foreigners arab arabs",
    "ability": "blind deaf disabled autistic",
    "age": "old young elderly",
}
NEUTRAL = ("person", "people")
TERMS = frozenset([*NEUTRAL, *" ".join(GROUPS.values()).split()])

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = (3, 4, 5)
VOCABULARY = 1_000
LEAST_COUNT = 5
LEAST_ERRORS = 6.0
MOST_ROWS = 20_000
STEPS = 300
RATE = 0.1
RIDGE = 0.1
COUNTERFACTUAL = 50.0


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def parts_of(text: str) -> set[str]:
    """The distinct words of a text, and the beginnings of its longer words, marked by an asterisk.

    Words that name a group have no other part than themselves, so a swap changes one part only.
    """
    words = words_of(text)
    stems = words - TERMS
    return words.union(*({w[:n] + "*" for w in stems if len(w) > n} for n in PREFIXES))


def identity_terms() -> dict[str, str]:
    """Each group word with its kind."""
    return {w: kind for kind, names in GROUPS.items() for w in names.split()}


def counterfactuals(text: str, kinds: dict[str, str]) -> Counter:
    """Swaps (word, other word) in the sentences of a text; the words of a sentence stay otherwise."""
    swaps = Counter()
    if kinds.keys().isdisjoint(words_of(text)):
        return swaps
    for sentence in SENTENCE.split(text):
        present = words_of(sentence)
        for word in present & kinds.keys():
            others = [w for w, kind in kinds.items() if kind == kinds[word] and w not in present]
            swaps.update((word, other) for other in [*others, *NEUTRAL] if other not in present)
    return swaps


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: dict[str, float]

    def score(self, text: str) -> float:
        z = self.intercept + sum(self.weights[w] for w in sorted(parts_of(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def vocabulary(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> list[str]:
    """The words whose document counts differ most between the labels, over all labelled documents."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = materialize(known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y")), "known")
    size = known.agg(F.count(F.lit(1)), F.sum("__y")).first()
    n, n1 = size[0], size[1] or 0
    rows = docs.select(id_col, text_col).join(broadcast_if_small(known, 16), docs[id_col] == known["__id"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_, ones = Counter(), Counter()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = parts_of(text or "")
                all_.update(found)
                if y:
                    ones.update(found)
            columns = [pa.array(all_.keys(), pa.string()), pa.array(all_.values(), pa.int64()), pa.array([ones[w] for w in all_], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["w", "n", "n1"])

    counts = rows.select("__y", text_col).mapInArrow(split, "w string, n bigint, n1 bigint").groupBy("w")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).filter(F.col("n") >= LEAST_COUNT)
    # How many standard errors the two shares of documents lie apart.
    share, other, all_ = F.col("n1") / (n1 + 1), (F.col("n") - F.col("n1")) / (n - n1 + 1), F.col("n") / (n + 1)
    spread = F.sqrt((all_ * (1 - all_) + 1e-3) * (1 / (n1 + 1) + 1 / (n - n1 + 1)))
    weight = F.round(F.abs(share - other) / spread, 6)
    chosen = counts.withColumn("z", weight).filter(F.col("z") >= LEAST_ERRORS)
    return [r["w"] for r in chosen.orderBy(F.desc("z"), "w").limit(most).select("w").collect()]


def fit(rows: list[list[int]], y: np.ndarray, words: list[str], swaps: Counter) -> Model:
    """Logistic regression with a ridge, and the counterfactual penalty over word swaps."""
    if not len(y):
        return Model(0.0, {})
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    at = {w: k for k, w in enumerate(words)}
    pairs = [(at[a], at[b], n) for (a, b), n in sorted(swaps.items()) if a in at and b in at]
    pa_, pb, pn = (np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
    lengths = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), lengths)
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(doc) else np.empty(0, np.int64)
    w, b = np.zeros(len(words)), start
    m1, m2 = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(doc, w[col], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(col, error[doc], len(words)) + RIDGE * w, error.sum())
        if len(pairs):
            change = 2 * COUNTERFACTUAL * pn * (w[pa_] - w[pb])
            grad[:-1] += np.bincount(pa_, change, len(words)) - np.bincount(pb, change, len(words))
        grad /= len(y)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), {x: float(v) for x, v in zip(words, w)})


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    most_words: int = VOCABULARY,
    most_rows: int = MOST_ROWS,
) -> Model:
    """Fit on the labelled documents: word counts of all, weights on a bounded sample."""
    kinds = identity_terms()
    chosen = vocabulary(docs, labels, label_col, id_col, text_col, most_words)
    words = sorted({*chosen, *kinds, *NEUTRAL})
    at = {w: k for k, w in enumerate(words)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [sorted(at[w] for w in parts_of(t) & at.keys()) for t in texts]
            swaps = [[f"{a} {b} {n}" for (a, b), n in sorted(counterfactuals(t, kinds).items())] for t in texts]
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(swaps, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "ids", "swaps"])

    picked = training_sample(docs.select(id_col, text_col), labels, label_col, id_col, most_rows)
    rows = picked.select(F.col("label").cast("int"), text_col).mapInArrow(known, "y int, ids array<bigint>, swaps array<string>")
    rows = rows.orderBy("y", "ids").collect()
    swaps = Counter()
    for r in rows:
        for swap in r["swaps"]:
            a, b, n = swap.split(" ")
            swaps[a, b] += int(n)
    return fit([r["ids"] for r in rows], np.array([r["y"] for r in rows], float), words, swaps)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([model.score(t.as_py() or "") for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
