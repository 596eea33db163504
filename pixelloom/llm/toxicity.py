"""Toxicity by multiple-instance learning.

Only documents have labels; a document is toxic if any of its sentences is. A
sentence's probability is a logistic function of the words and word starts it
holds, and the document's is their noisy-or, 1 - prod(1 - p). The gradient of
the documents' likelihood trains the weights, so the sentences that explain
the labels get high scores, and are returned as the offending ones. Whether
classes weigh alike, and which weak weights are dropped, is chosen by folds of
the training rows.

Scale: training reads a bounded sample (toxic_docs and clean_docs labelled
texts, by a hash of the id); features are counted with grouped sums and the
top_features best are kept, which bounds what the driver gets. Scoring is one pass without a shuffle; a text's
sentences are looked at only if one of its words has a weight.

Cases: null and empty texts, and those without a known word, score 0; equal
texts score alike; if the labels hold one class only, all texts score 0; rows
with a null label or id don't train; of several training texts of one id one
trains; a text of any length is read a sentence at a time; a null id stays null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TOXIC_DOCS, CLEAN_DOCS, TOP_FEATURES = 2000, 4000, 1000
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\s.!?]+")
_STRIP = re.compile(r"[\W\d_]+")


def features(word: str) -> list[str]:
    """The letters of a word in lower case, and its starts of four to six letters."""
    w = _STRIP.sub("", word).lower()
    return [f"={w}", *(f"^{w[:n]}" for n in (4, 5, 6) if len(w) >= n)] if w else []


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence with a word; a sentence ends at . ! ? or a line's end."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m[0])
        if words:
            out.append((m.start(), m.end(), words))
    return out


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None, cache: dict[str, tuple[str, ...]]) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's probability, and (start, end, probability) of each sentence with a known word."""
        if not text:
            return 0.0, []
        hot = False
        for w in set(_WORD.findall(text)):
            known = cache.get(w)
            if known is None:
                known = cache[w] = tuple(f for f in features(w) if f in self.weights)
            hot = hot or bool(known)
        if not hot:
            return 0.0, []
        found, none = [], 1.0
        for start, end, words in sentences(text):
            own = {f for w in words for f in cache[w]}
            if own:
                z = self.bias + sum(self.weights[f] for f in sorted(own))
                p = 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
                found.append((start, end, float(p)))
                none *= 1 - p
        return float(1 - none), found


class Bags:
    """Labelled documents as sentences of feature numbers, in flat arrays."""

    def __init__(self, bags: list[tuple[int, list[list[int]]]]):
        self.label = np.array([y for y, _ in bags], float)
        flat = [s for _, ss in bags for s in ss]
        self.bag = np.array([b for b, (_, s) in enumerate(bags) for _ in s], np.int64)
        self.which = np.array([i for i, s in enumerate(flat) for _ in s], np.int64)
        self.feature = np.array([f for s in flat for f in s], np.int64)

    def none(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each sentence, and of each document the logarithm of the chance that none offends; x ends with the bias."""
        z = np.clip(x[-1] + np.bincount(self.which, x[self.feature], len(self.bag)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        return p, np.bincount(self.bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(self.label))

    def loss(self, x: np.ndarray, weight: np.ndarray, shrink: float) -> tuple[float, np.ndarray]:
        """The mean negative log-likelihood of the labels under the noisy-or, with a ridge, and its gradient."""
        p, none = self.none(x)
        some = np.maximum(-np.expm1(none), 1e-6)
        value = -(weight * np.where(self.label == 1, np.log(some), none)).sum() / len(self.label) + shrink / 2 * (x[:-1] ** 2).sum()
        slope = np.where(self.label == 1, -np.exp(none) / some, 1.0) * weight
        dz = slope[self.bag] * p
        grad = np.r_[np.bincount(self.feature, dz[self.which], len(x) - 1), dz.sum()] / len(self.label)
        grad[:-1] += shrink * x[:-1]
        return float(value), grad


def _minimum(bags: Bags, n: int, balanced: bool, steps: int, rate: float, shrink: float) -> np.ndarray:
    """Weights and bias by Adam."""
    x = np.r_[np.full(n, 0.5), -1.5]
    m, v = np.zeros_like(x), np.zeros_like(x)
    share = bags.label.mean()
    weight = np.where(bags.label == 1, 0.5 / share, 0.5 / (1 - share)) if balanced else np.ones(len(bags.label))
    for t in range(1, steps + 1):
        _, grad = bags.loss(x, weight, shrink)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def _without_weak(x: np.ndarray, least_weight: float) -> np.ndarray:
    """Weights of less than least_weight of the largest one set to zero: many weak ones would add up over a long clean text."""
    return np.r_[np.where(x[:-1] > least_weight * max(0.0, x[:-1].max(initial=0.0)), x[:-1], 0.0), x[-1]]


#: Whether classes weigh alike, and the least weight that is kept; folds of the training rows choose between them.
CHOICES = [(balanced, least) for balanced in (False, True) for least in (0.0, 0.1, 0.2, 0.3)]


def choose(bags: list[tuple[int, list[list[int]]]], n: int, folds: int = 3, steps: int = 300, rate: float = 0.1, shrink: float = 1e-3) -> tuple[bool, float]:
    """The choice with the best F1 on folds of bags that it wasn't trained on; the first of equals."""
    hits = {c: np.zeros(3) for c in CHOICES}  # true, predicted, both
    for k in range(folds):
        rest, own = Bags([b for i, b in enumerate(bags) if i % folds != k]), Bags(bags[k::folds])
        if not len(rest.bag) or not len(own.label) or rest.label.min() == rest.label.max():
            continue
        for balanced in (False, True):
            x = _minimum(rest, n, balanced, steps, rate, shrink)
            for least in dict.fromkeys(c[1] for c in CHOICES):
                kept = _without_weak(x, least)
                known = np.bincount(own.which, kept[own.feature] != 0, len(own.bag)) > 0  # a sentence without a known feature isn't looked at
                p, _ = own.none(kept)
                told = -np.expm1(np.bincount(own.bag[known], np.log1p(-np.minimum(p[known], 1 - 1e-9)), len(own.label))) >= 0.5
                hits[balanced, least] += [own.label.sum(), told.sum(), (told & (own.label == 1)).sum()]
    return max(CHOICES, key=lambda c: 2 * hits[c][2] / max(1.0, hits[c][0] + hits[c][1]))


def fit(bags: list[tuple[int, list[list[int]]]], names: list[str], steps: int = 300, rate: float = 0.1, shrink: float = 1e-3, choice: tuple[bool, float] | None = None) -> Model:
    """Weights from bags (label, sentences as lists of feature numbers); unless given, the choice is made by folds of them."""
    all_ = Bags(bags)
    if not len(all_.bag) or all_.label.min() == all_.label.max():
        return Model({}, 0.0)
    balanced, least = choice or choose(bags, len(names), steps=steps, rate=rate, shrink=shrink)
    x = _without_weak(_minimum(all_, len(names), balanced, steps, rate, shrink), least)
    return Model({n: float(w) for n, w in zip(names, x) if w > 0}, float(x[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, top_features: int = TOP_FEATURES, least_share: float = 0.01, least_lift: float = 2.0) -> Model:
    """A model from labelled texts; docs and labels hold what may be learned from.

    A feature is used if least_share of the toxic texts hold it and they do so
    exp(least_lift) times as often as the others.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    picked = [own.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, toxic_docs), (0, clean_docs))]
    chosen = picked[0].unionByName(picked[1])
    # Of several texts of an id the one with the smallest hash, so that the sample has toxic_docs + clean_docs rows at most.
    text = F.struct(F.xxhash64("text").alias("key"), "text")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id").select("id", "label", text.alias("text"))
    sample, path = C.cut(found.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text.text"), "toxicity-sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for y, text in zip(*(c.to_pylist() for c in batch.columns)):
                found.update((f, y) for f in {f for w in set(_WORD.findall(text)) for f in features(w)})
        cols = list(zip(*((f, y, n) for (f, y), n in found.items()))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()))], names=["feature", "label", "n"])

    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(size) < 2:
        C.drop(docs.sparkSession, path)
        return Model({}, 0.0)
    by = sample.mapInArrow(tally, "feature string, label int, n long").groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    lift = F.log((F.col("bad") + 0.5) / (size[1] + 1)) - F.log((F.col("good") + 0.5) / (size[0] + 1))
    names = [r["feature"] for r in by.where(F.col("bad") >= max(3, size[1] * least_share)).withColumn("lift", lift).where(F.col("lift") > least_lift).orderBy(F.desc(F.col("bad") * F.col("lift")), "feature").limit(top_features).collect()]
    index = {n: i for i, n in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, out = [], []
            for y, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = ({index[f] for w in words for f in features(w) if f in index} for _, _, words in sentences(text))
                ys.append(y)
                out.append([sorted(r) for r in rows if r])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["label", "sentences"])

    rows = sample.mapInArrow(bags, "label int, sentences array<array<int>>").collect()  # toxic_docs + clean_docs rows, without their texts
    C.drop(docs.sparkSession, path)
    return fit(sorted((r["label"], r["sentences"]) for r in rows), names)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", most_kept: int = 300_000) -> DataFrame:
    """One row per row of docs: id, score, predicted, offending (start, end, score of sentences scored 0.5 or more)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                if len(cache) > most_kept:
                    cache.clear()
                p, spans = sent.value.score(text.as_py(), cache)
                scores.append(p)
                found.append([{"start": a, "end": b, "score": s} for a, b, s in spans if s >= 0.5])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32()), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], names=["id", "score", "predicted", "offending"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, predicted int, offending array<struct<start: int, end: int, score: double>>")
