"""Histogram gradient-boosted trees for a yes/no label, and isotonic calibration.

The fit runs on a bounded sample of labelled rows that Spark has turned into feature vectors. Features are
cut into quantile bins; each level of a tree sums gradients per node, feature and bin and takes the
best split. Trees are complete and lie flattened in arrays, so a batch of documents walks down all trees with a
few numpy operations per level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import row_batches


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if the feature is above
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of ``x`` reaches, plus the base."""
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Logistic loss; with one class only, the trees are empty and the base is the smoothed log odds."""
    y = y.astype(float)
    inner = 2**depth - 1
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))  # 0 without rows
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])  # above an edge: its number
    n_features, margin = x.shape[1], np.full(len(y), base)
    flat = binned + (np.arange(n_features) * bins)[:, None]
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        features, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            cell = (flat + (node - first) * (n_features * bins)).ravel()
            shape = (width, n_features, bins)
            g = np.bincount(cell, np.tile(gradient, n_features), width * n_features * bins).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.tile(weight, n_features), width * n_features * bins).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < 1) | (ht - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k, cut in enumerate(best.tolist()):
                feature, at = divmod(cut, bins)
                if gain[k, feature, at] > 1e-9 and at < len(edges[feature]):
                    features[first + k], thresholds[first + k] = feature, edges[feature][at]
            rows = np.arange(len(y))
            node = 2 * node + 1 + (x[rows, features[node]] > thresholds[node])
        leaf_of = node - inner
        leaves = rate * np.bincount(leaf_of, gradient, inner + 1) / (np.bincount(leaf_of, weight, inner + 1) + ridge)
        margin += leaves[leaf_of]
        all_features.append(features)
        all_thresholds.append(thresholds)
        all_leaves.append(leaves)
    return Trees(np.array(all_features), np.array(all_thresholds), np.array(all_leaves), base)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to ``y`` over ``x`` (pool adjacent violators)."""
    blocks: list[list[float]] = []  # sum of y, sum of x, rows
    for value in np.unique(x):
        own = y[x == value]
        blocks.append([float(own.sum()), float(value) * len(own), len(own)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def sample(docs: DataFrame, labels: DataFrame, label: str, eligible, max_rows: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``max_rows`` labelled documents, the same in every run.

    Labels of one id are merged by their maximum, documents of one id by their least text.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & eligible).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def scored(docs: DataFrame, features: Callable[[list[str | None]], np.ndarray], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` (which has ``text``) with ``score``."""
    docs = docs.drop("score")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            values = score(features(batch.column(batch.schema.get_field_index("text")).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(add, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"]))


def vectors(sampled: DataFrame, features: Callable[[list[str | None]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a bounded sample, in the order of document ids."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            x = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = sampled.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int")).mapInArrow(measure, "doc_id bigint, label int, x array<double>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return np.array([r["x"] for r in rows], float).reshape(len(rows), len(rows[0]["x"]) if rows else 0), np.array([r["label"] for r in rows], int)
