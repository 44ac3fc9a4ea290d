"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its
words; the document's score is their noisy-or with a leak, which stands for
labels that no sentence explains. Only document labels are known: the weights
are those that make the labels likeliest, and the sentences that score high in
a document are then the ones that offend.

Features of a word are the word and its beginnings. A first pass over the
labelled sample keeps the features that go with the label; the fit sees, per
document, its number of sentences and the kept features of the others, never
texts.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import kind, narrow
from inkwell.llm.common import SLICE, bound_batches, map_slices
from inkwell.session import written

#: Labelled documents in the sample to which the model is fitted, and features it may have.
SAMPLE, FEATURES = 20_000, 4_096
#: Documents that must hold a feature, and how far (in standard deviations) its share of the label must stand out.
LEAST_DOCS, STANDS_OUT = 3, 3.0
STEPS, RATE, SHRINK = 300, 0.15, 0.02
#: Beginnings of words that are features beside the whole word.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: The leak stays well below the threshold, or it would put every text over it.
MOST_LEAK = 0.05
REMEMBERED = 200_000

WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")


def features(word: str) -> list[str]:
    """Features of a lower-case word: itself, and its beginnings marked with a hyphen."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) >= n]]


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence that has any."""
    found = (WORD.findall(s) for s in SENTENCE_END.split(text.lower())) if text else ()
    return [s for s in found if s]


def training_rows(
    docs: DataFrame, labels: DataFrame, trainable: Column, key: str, text: str, label: str, sample: int
) -> DataFrame:
    """``text, y`` of the documents of at most ``sample`` labelled keys, chosen by the hash of the key.

    ``trainable`` is a condition on ``key``. A key with several labels counts as
    labelled 1 if one of them is.
    """
    known = labels.where(trainable & F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("y"))
    # At most ``sample`` keys, so they may be broadcast.
    chosen = F.broadcast(known.orderBy(F.xxhash64("_key"), "_key").limit(sample))
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(chosen, "_key").select("text", "y")


def screened(rows: DataFrame, limit: int) -> list[tuple[str, int, int]]:
    """Features whose share of the label stands out, with their documents and those labelled 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {f for s in sentences(text) for w in set(s) for f in features(w)}
                docs.update(own)
                if y:
                    toxic.update(own)
        found = list(docs)
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({
                "f": pa.array(part, pa.string()),
                "n": pa.array([docs[f] for f in part], pa.int64()),
                "t": pa.array([toxic[f] for f in part], pa.int64()),
            })

    all_, toxic = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not toxic or toxic == all_:
        return []
    share = toxic / all_
    spread = F.sqrt(F.col("n") * F.lit(share * (1 - share)))
    found = (
        rows.mapInArrow(count, "f string, n bigint, t bigint").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        .where(F.col("n") >= LEAST_DOCS)
        .withColumn("z", (F.col("t") - F.col("n") * F.lit(share)) / spread)
        .where(F.col("z") >= STANDS_OUT).orderBy(F.desc("z"), "f").limit(limit)
    )
    return [(r["f"], r["n"], r["t"]) for r in found.collect()]


def bags(rows: DataFrame, number: dict[str, int]) -> DataFrame:
    """``y, n, at, f``: sentences, and for those with kept features the sentence and feature numbers."""

    def run(batch: pa.RecordBatch):
        columns: tuple[list, ...] = ([], [], [], [])
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cut, at, found = sentences(text), [], []
            kept = 0
            for s in cut:
                own = {number[f] for w in set(s) for f in features(w) if f in number}
                if own:
                    at += [kept] * len(own)
                    found += sorted(own)
                    kept += 1
            for column, value in zip(columns, (y, len(cut), at, found)):
                column.append(value)
        return columns

    return map_slices(rows, run, "y int, n int, at array<int>, f array<int>")


def starts(y: np.ndarray, doc: np.ndarray, f: np.ndarray, n_features: int) -> np.ndarray:
    """Log-odds of label 1 among the documents with a feature, less those of all; none below 0."""
    own = np.unique(doc * np.int64(n_features) + f)
    n = np.bincount(own % n_features, minlength=n_features)
    t = np.bincount(own % n_features, y[own // n_features], minlength=n_features)
    all_ = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return np.maximum(np.log((t + 0.5) / (n - t + 0.5)) - all_, 0.0)


def fit(bag_rows: list, n_features: int) -> dict:
    """Weights, bias and leak that make the labels likeliest, by full-batch steps with decaying averages (Adam).

    Of 1 - P = (1 - leak) * product of (1 - p_s), the gradient of the logarithm
    is simple: for a document labelled 1 the step of a sentence is
    -p_s (1 - P) / P, for one labelled 0 it is p_s.

    The leak is at most ``MOST_LEAK``, so it cannot come to explain the labels in
    place of the sentences, however common label 1 is. Weights start from how
    far a feature's documents are labelled 1 more often than all.
    """
    y = np.array([r["y"] for r in bag_rows], float)
    doc, row, f = [], [], []
    base = 0
    for d, r in enumerate(bag_rows):
        n = (max(r["at"]) + 1) if r["at"] else 0
        doc += [d] * n
        row += [base + a for a in r["at"]]
        f += r["f"]
        base += n
    doc, row, f = (np.array(x, np.int64) for x in (doc, row, f))
    most_leak = math.log(MOST_LEAK / (1 - MOST_LEAK))
    plain = np.array([r["n"] for r in bag_rows], float) - np.bincount(doc, minlength=len(y))
    weight = np.zeros(n_features + 2)  # then the bias of a sentence and the leak, both as logits
    weight[-2], weight[-1] = -6.0, math.log(0.02 / 0.98)
    weight[:-2] = starts(y, doc[row], f, n_features)
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weight[f], minlength=base) + weight[-2]
        p, p0, leak = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-weight[-2])), 1 / (1 + math.exp(-weight[-1]))
        log_rest = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        log_rest += plain * math.log1p(-p0) + math.log1p(-leak)
        rest = np.exp(log_rest)
        by_doc = np.where(y == 1, -rest / np.maximum(1 - rest, 1e-9), 1.0) / len(y)
        by_row = by_doc[doc] * p
        gradient = np.zeros_like(weight)
        gradient[:-2] = np.bincount(f, by_row[row], minlength=n_features) + SHRINK * weight[:-2] / len(y)
        gradient[-2] = by_row.sum() + (by_doc * plain).sum() * p0
        gradient[-1] = by_doc.sum() * leak
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = RATE * min(1.0, 3 * (1 - step / STEPS) + 0.05)
        weight -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        # A sentence without any kept feature stays near harmless however many of them a document has.
        weight[-2] = min(weight[-2], -6.0)
        weight[-1] = min(weight[-1], most_leak)
    return {"weights": weight[:-2], "bias": float(weight[-2]), "leak": float(1 / (1 + math.exp(-weight[-1])))}


def train(
    docs: DataFrame, labels: DataFrame, trainable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE, limit: int = FEATURES,
) -> dict:
    """The model: ``words`` (feature to weight), ``bias`` and ``leak``.

    Fitted to at most ``sample`` labelled documents. Without labels of both
    values there are no features and the leak is the share of label 1, at most ``MOST_LEAK``.
    """
    bound_batches(docs.sparkSession)
    rows = written(training_rows(docs, labels, trainable, key, text, label, sample), "training")
    kept = screened(rows, limit)
    if not kept:
        n, toxic = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
        return {"words": {}, "bias": -20.0, "leak": min((toxic or 0) / n, MOST_LEAK) if n else 0.0}
    number = {f: i for i, (f, _, _) in enumerate(kept)}
    model = fit(bags(rows, number).collect(), len(kept))
    words = {f: float(w) for (f, _, _), w in zip(kept, model["weights"]) if abs(w) > 1e-4}
    return {"words": words, "bias": model["bias"], "leak": model["leak"]}


class Scorer:
    """Scores sentences and texts; remembers what words weigh."""

    def __init__(self, model: dict):
        self.words, self.bias, self.leak = model["words"], model["bias"], model["leak"]
        self.known: dict[str, float] = {}
        self.plain = math.log1p(-1 / (1 + math.exp(-self.bias)))

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = sum(self.words.get(f, 0.0) for f in features(word))
        return found

    def sentence(self, words: list[str]) -> float:
        """Log-odds of a sentence. Each feature counts once, as in the fit."""
        if not any(map(self.weight, words)):
            return self.bias
        own = {f for w in set(words) for f in features(w) if f in self.words}
        return self.bias + sum(self.words[f] for f in sorted(own))

    def text(self, text: str | None) -> tuple[float, int, float]:
        """Score of a text, and the number (-1: none) and score of its likeliest sentence."""
        rest, best, where = math.log1p(-min(self.leak, 1 - 1e-12)), -1.0, -1
        for n, words in enumerate(sentences(text)):
            z = self.sentence(words)
            p = 1 / (1 + math.exp(-z)) if z < 30 else 1 - 1e-13
            rest += self.plain if z == self.bias else math.log1p(-p)
            if p > best:
                best, where = p, n
        return -math.expm1(rest), where, max(best, 0.0)


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, score, predicted, sentence, sentence_score`` of every whole text, one row per row.

    ``sentence`` is the number of the likeliest sentence among those with words.
    NULL, empty and wordless texts have the leak as score and sentence -1. Equal
    rows stay; other columns, whatever their names, are not read.
    """
    bound_batches(docs.sparkSession)
    shared = shared_model(docs, model)

    def run(batch: pa.RecordBatch):
        scorer = scorer_of(shared)
        found = [scorer.text(t) for t in batch.column(1).to_pylist()]
        scores = [s for s, _, _ in found]
        return batch.column(0), scores, [int(s >= threshold) for s in scores], [w for _, w, _ in found], [b for *_, b in found]

    ddl = f"{key} {kind(docs, key)}, score double, predicted int, sentence int, sentence_score double"
    return map_slices(narrow(docs, key, text), run, ddl)


def keep_harmless(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below ``threshold``."""
    bound_batches(docs.sparkSession)
    shared = shared_model(docs, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                kept = [scorer.text(t)[0] < threshold for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def shared_model(docs: DataFrame, model: dict) -> Broadcast:
    """The model has at most ``FEATURES`` words."""
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))


_SCORERS: dict[bytes, Scorer] = {}


def scorer_of(shared: Broadcast) -> Scorer:
    if shared.value not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[shared.value] = Scorer(pickle.loads(shared.value))
    return _SCORERS[shared.value]
