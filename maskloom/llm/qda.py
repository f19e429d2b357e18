"""Operator 8: quality classifier by regularised quadratic discriminant analysis.

A text becomes a vector of transformed statistics (logarithms of counts, square
roots of shares). Each class has a mean and a covariance, shrunk towards the
pooled covariance and the identity; the score is the posterior of class 1 from
the difference of the class log densities, with Mahalanobis distances through
Cholesky factors that are computed once. Means and covariances come from sums over all
training rows, taken in Spark.

Nulls and edges: a null text is empty and gets the vector of an empty text. A
row whose label or id is null trains nothing. Repeated rows count each. With one class only,
or none, the score is that class's share (one half without labels). Ids, sources,
languages and labels are never inputs of a score. Columns other than the id and
text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import LOWER, column, held_out, prefix_hash, range_hash, save, text_slices, word_spans

NAMES = ("log_words", "log_bytes", "word_length", "upper", "digit", "symbol", "mark", "other_punct", "high", "lines",
         "distinct", "same_as_before", "dup_bigrams")
_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in "#*$%&|<>"]] = True
_CLASS[3, [33, 63]] = True
_CLASS[4, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>!?"]] = True
_CLASS[5, 128:] = True


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a slice."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    words = range_hash(prefix_hash(LOWER[data]), starts, ends) if len(data) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    n_bytes, n_words = np.diff(offsets).astype(float), np.diff(first).astype(float)
    solid = np.maximum(_sums(ends - starts, first), 1)
    out = np.zeros((n, len(NAMES)))
    out[:, 0], out[:, 1] = np.log1p(n_words), np.log1p(n_bytes)
    out[:, 2] = np.log1p(_sums(ends - starts, first) / np.maximum(n_words, 1))
    for k in range(6):
        out[:, 3 + k] = np.sqrt(_sums(_CLASS[k][data], offsets) / solid)
    out[:, 9] = np.sqrt(_sums(data == 10, offsets) / np.maximum(n_words, 1))
    order = np.lexsort((words, doc))
    new = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(words[order].view(np.int64)) != 0))[:len(order)]
    out[:, 10] = np.sqrt(np.bincount(doc[order][new], minlength=n) / np.maximum(n_words, 1))
    if len(words) > 1:
        pair = doc[1:] == doc[:-1]
        same = pair & (words[1:] == words[:-1])
        out[:, 11] = np.sqrt(np.bincount(doc[1:][same], minlength=n) / np.maximum(n_words, 1))
        two = (words[:-1] * np.uint64(0x9FB21C651E98DF25) ^ words[1:])[pair]
        owner = doc[1:][pair]
        order = np.lexsort((two, owner))
        again = (np.diff(owner[order]) == 0) & (np.diff(two[order].view(np.int64)) == 0)
        out[:, 12] = np.sqrt(np.bincount(owner[order][1:][again], minlength=n) / np.maximum(n_words, 1))
    return out


@dataclass
class Gaussian:
    log_prior: float
    mean: np.ndarray
    inverse_factor: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse_factor.T
        return self.log_prior - 0.5 * (z * z).sum(1) - 0.5 * self.log_det


def vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the feature vector ``x`` of each row."""
    source = docs.select("doc_id", F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            for row, n, data, offsets in text_slices(batch, "_text"):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([
                    column(batch, "doc_id").slice(row, n), pa.ListArray.from_arrays(
                        pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))],
                    names=["doc_id", "x"])

    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit(rows: DataFrame, *, shrink_pooled: float = 0.1, shrink_identity: float = 0.02) -> dict[int, Gaussian]:
    """Class Gaussians from labelled vectors (x, y); only sums of products reach the driver."""
    d = len(NAMES)
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)],
                                *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    stats = {}
    for r in got:
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        product = np.zeros((d, d))
        for i, j in pairs:
            product[i, j] = product[j, i] = r[f"p{i}_{j}"] / r["n"]
        stats[int(r["y"])] = (r["n"], mean, product - np.outer(mean, mean))
    total = sum(s[0] for s in stats.values())
    pooled = sum((s[0] / total * s[2] for s in stats.values()), np.zeros((d, d)))
    out = {}
    for y, (n, mean, cov) in stats.items():
        cov = (1 - shrink_pooled) * cov + shrink_pooled * pooled
        cov = (1 - shrink_identity) * cov + shrink_identity * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        out[y] = Gaussian(float(np.log(n / total)), mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))
    return out


def posterior(model: dict[int, Gaussian], x: np.ndarray) -> np.ndarray:
    if len(model) < 2:
        return np.full(len(x), 0.5 if not model else float(1 in model))
    gap = np.clip(model[1].log_density(x) - model[0].log_density(x), -500, 500)
    return 1 / (1 + np.exp(-gap))


def score(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", mod: int = 5,
          threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    table = save(vectors(docs, text), "vectors")
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
    rows = table.where(~held_out(F.col("doc_id"), mod)).join(marks, F.col("doc_id") == F.col("_id")).select("x", "y")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = column(batch, "x").flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(posterior(shared.value, x))],
                                                 names=["doc_id", "score"])

    out = table.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), mod).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
