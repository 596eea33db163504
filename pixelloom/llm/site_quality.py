"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on the shape of a text gives its evidence. Hosts, and
paths within hosts, get posterior means of that evidence: a path is shrunk
toward its host and a host toward the whole, the more the fewer documents it
has, with a strength that the spread between the groups sets. The document's
posterior is its own log-odds plus those of its path without it, relative to
the whole. How far a site moves its texts is up to the data: sites that hardly
differ beyond chance are shrunk to the whole and move nothing.

Scale: training reads a bounded sample (sample_docs labelled texts, by a hash of
the id); evidence is one pass; hosts and paths are sums that are added up
before the shuffle, whatever share of the rows one host has.

Cases: null and empty texts have the evidence of empty ones; a null host or
path is a group of its own; without labels of both classes the evidence is one
half; repeated rows count as often as they occur, but of several training texts
of one id one trains; of posteriors of exactly keep_from the text is kept; a null id stays null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE_DOCS = 4000
KEEP_FROM = 0.5
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]{2}")


def shape(text: str | None) -> list[float]:
    """The numbers that the classifier sees of a text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [1.0, *[0.0] * 11]
    letters = sum(map(len, words))
    kinds = len(set(words))
    twins = sum(map(str.__eq__, words, words[1:]))
    signs = sum(map(text.count, "#*$%&<>"))
    bars, bangs = text.count("|"), text.count("!")
    lines = [x for x in text.split("\n") if x]
    return [
        1.0, math.log1p(n) / 5, float(n < 20), min(letters / n, 30) / 10, min(signs / n, 1), min(bars / n, 1), min(bangs / n, 1), min(len(_UPPER.findall(text)) / n, 3),
        twins / n, kinds / n, 1 - len(set(lines)) / max(1, len(lines)), min(sum(map(text.count, "0123456789")) / max(1, chars), 1),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic classifier by Newton's steps; classes weigh alike."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return w
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, abs(step).max()))
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """The classifier's weights from at most sample_docs labelled texts of either class."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    picked = [own.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample_docs) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    # Of several texts of an id the one with the smallest hash, so that the sample has 2 * sample_docs rows at most.
    text = F.struct(F.xxhash64("text").alias("key"), "text")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", text.alias("text"))
    sample = found.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shape(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], names=["label", "x"])

    rows = sorted((r["label"], list(r["x"])) for r in sample.mapInArrow(run, "label int, x array<double>").collect())
    return fit(np.array([x for _, x in rows]).reshape(len(rows), -1), np.array([y for y, _ in rows], float)) if rows else np.zeros(12)


def evidence(docs: DataFrame, weights: np.ndarray, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, id, host, path, p) for each row of docs; p is the classifier's probability of good quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shape(t.as_py()) for t in batch.column(4)]).reshape(-1, len(weights))
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -12, 12)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p)], names=["row", "id", "host", "path", "p"])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    key = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    return docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), *key, F.col(text_col).alias("text")).mapInArrow(run, "row long, id long, host string, path string, p double")


def _strength(groups: DataFrame) -> float:
    """How many documents the level above counts for, from the spread of group means beyond chance."""
    mean = F.col("s") / F.col("n")
    total = groups.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * mean * mean).alias("nmm"), F.sum(F.col("q") - F.col("n") * mean * mean).alias("inside")).first()
    n, k = total["n"] or 0, total["k"] or 0
    if k < 2 or n <= k:
        return 1000.0
    mu = total["s"] / n
    within = total["inside"] / (n - k)
    between = max(0.0, (total["nmm"] - n * mu * mu - (k - 1) * within) / max(1e-9, n - total["nn"] / n))
    return float(min(10000.0, max(1.0, within / max(between, 1e-9))))


def classify(docs: DataFrame, weights: np.ndarray, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per row of docs: row, id, evidence, host_mean, path_mean, posterior, kept."""
    rows, _ = C.cut(evidence(docs, weights, host, path, id_col, text_col, row_col), "evidence")
    paths, p1 = C.cut(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts, p2 = C.cut(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("q").alias("q")), "hosts")
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mu = (whole["s"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    k_host, k_path = _strength(hosts), _strength(paths)
    host_means = hosts.select("host", ((F.col("s") + k_host * mu) / (F.col("n") + k_host)).alias("host_mean"))
    sites, _ = C.cut(paths.join(host_means, "host").select("host", "path", "s", "n", "host_mean"), "sites")
    C.drop(docs.sparkSession, p1, p2)
    # The document's own evidence is taken out of its path.
    own = ((F.col("s") - F.col("p") + k_path * F.col("host_mean")) / (F.col("n") - 1 + k_path)).alias("path_mean")
    joined = rows.join(sites, ["host", "path"]).select("row", "id", "p", "host_mean", own)
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    shift = logit(F.col("path_mean")) - math.log(mu / (1 - mu))
    posterior = 1 / (1 + F.exp(-(logit(F.col("p")) + shift)))
    return joined.select("row", "id", F.col("p").alias("evidence"), "host_mean", "path_mean", posterior.alias("posterior"), (posterior >= keep_from).alias("kept"))
