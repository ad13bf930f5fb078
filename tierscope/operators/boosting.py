"""Histogram boosting of shallow trees on ranks, many models at once.

Ranks are quantiles already, so 256 equal bins of them serve every feature. The rows stay
where they are, as cached blocks with their models' current scores. A pass over the blocks adds up
gradients by (model, tree, node, feature, bin); the sums, whose size doesn't depend on the
rows, meet in a tree of merges, and the driver picks the splits. A tree of depth d takes d passes, for
all models, targets and classes together. Every some rounds the blocks are checkpointed, which
cuts their lineage; a lost block is computed again from there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch_dir

BINS = 256
#: Rounds between checkpoints of the blocks.
CHECKPOINT = 25


@dataclass
class Boosted:
    """Trees of every model: feature and last left bin of each inner node, value of each leaf, by (model, round, output)."""

    models: list[int]
    start: np.ndarray  # (models, outputs)
    feature: np.ndarray  # (models, rounds, outputs, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (models, rounds, outputs, leaves)

    def scores(self, bins: np.ndarray, m: int) -> np.ndarray:
        """(rows, outputs) raw scores under the model at place ``m``."""
        out = np.repeat(self.start[m][None, :], len(bins), 0)
        for r in range(self.feature.shape[1]):
            for k in range(self.feature.shape[2]):
                out[:, k] += self.leaf[m, r, k][_leaf_of(bins, self.feature[m, r, k], self.cut[m, r, k])]
        return out

    def predict(self, features: Column, model: Column | None = None) -> Column:
        """An array of raw scores for each row, by the model whose number ``model`` gives (the first one without)."""
        held = self

        @F.pandas_udf("array<double>")
        def run(x: pd.Series, m: pd.Series) -> pd.Series:
            bins, out = binned(np.array(x.tolist(), np.float64)) if len(x) else np.zeros((0, 0), np.uint8), [None] * len(x)
            for place, number in enumerate(held.models):
                at = np.flatnonzero(m.to_numpy() == number)
                for i, s in zip(at.tolist(), held.scores(bins[at], place).tolist() if len(at) else [], strict=True):
                    out[i] = s
            return pd.Series(out)

        return run(vector_to_array(features), model if model is not None else F.lit(self.models[0]))


def binned(ranks: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(ranks * BINS), 0, BINS - 1).astype(np.uint8)


def _leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Leaf (or, of a tree still growing, node of the next level) of each row; nodes lie level by level."""
    node, at = np.zeros(len(bins), np.int64), 0
    rows = np.arange(len(bins))
    while at < len(feature):
        right = bins[rows, feature[at + node]] > cut[at + node]
        at, node = 2 * at + 1, 2 * node + right
    return node


def _gradients(score: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, outputs) first and second derivatives."""
    if loss == "squared":
        return score - y, np.ones_like(score)
    p = np.exp(score - score.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p - (y[:, :1].astype(np.int64) == np.arange(score.shape[1])), np.maximum(p * (1 - p), 1e-6)


def _splits(hist: np.ndarray, least: int, l2: float, step: float, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Best (feature, bin) of each node of ``hist`` (nodes, features, bins, 3), and the leaves' values if this is the last level.

    A node without an allowed split sends all rows left.
    """
    left = hist.cumsum(2)
    total = left[:, :, -1:, :]
    right = total - left
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2 + 1e-12)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), value(left) + value(right) - value(total), -np.inf)
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(1)
    fine = flat[np.arange(len(hist)), best] > 1e-12
    feature, cut = np.where(fine, best // hist.shape[2], 0), np.where(fine, best % hist.shape[2], BINS)
    if not last:
        return feature, cut, None
    nodes = np.arange(len(hist))
    sides = np.stack([np.where(fine[:, None], left[nodes, feature, np.minimum(cut, BINS - 1)], total[:, 0, 0]), np.where(fine[:, None], right[nodes, feature, np.minimum(cut, BINS - 1)], 0)], 1).reshape(-1, 3)
    return feature, cut, -step * sides[:, 0] / (sides[:, 1] + l2 + 1e-12)


def fit_boosted(df: DataFrame, targets: list[str], features: str = "features", model: str | None = None, loss: str = "squared", classes: int = 3, weight: str | None = None, rounds: int = 200, depth: int = 3, step: float = 0.06, least: int = 20, l2: float = 0.0) -> Boosted:
    """One model for each value of ``model`` (one in all without), each on its own rows of ``df``.

    ``loss``: ``squared`` fits every target by itself; ``multinomial`` fits the classes 0, 1, ..
    of the one target. ``least`` rows at least lie in every leaf.
    """
    spark, outputs = df.sparkSession, classes if loss == "multinomial" else len(targets)
    rows = df.select(vector_to_array(features).alias("x"), (F.col(model) if model else F.lit(0)).cast("long").alias("m"), *[F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)], (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    ys = [f"y{i}" for i in range(len(targets))]
    means = {r["m"]: [r[y] for y in ys] for r in rows.groupBy("m").agg(*[(F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias(y) for y in ys]).collect()}  # a row for each model
    models = sorted(means)
    place = {m: i for i, m in enumerate(models)}
    start = np.array([means[m] if loss == "squared" else [0.0] * classes for m in models], np.float64).reshape(len(models), outputs)

    def pack(part):
        held = list(part)
        if held:
            m = np.array([place[r["m"]] for r in held])
            yield m, binned(np.array([r["x"] for r in held], np.float64)), np.array([[r[y] for y in ys] for r in held], np.float64), np.array([r["w"] for r in held]), start[m].copy()

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    blocks = rows.rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)
    n_inner, n_models = (1 << depth) - 1, len(models)
    feature, cut, leaf = np.zeros((n_models, rounds, outputs, n_inner), np.int64), np.full((n_models, rounds, outputs, n_inner), BINS), np.zeros((n_models, rounds, outputs, n_inner + 1))

    def histogram(level: int, f: np.ndarray, c: np.ndarray):
        """Sums over a partition's blocks for the nodes of one level of the trees that grow."""

        def run(part):
            total = None
            for m, bins, y, w, score in part:
                g, h = _gradients(score, y, loss)
                hist = np.zeros((n_models, outputs, 1 << level, bins.shape[1], BINS, 3))
                for i in np.unique(m):
                    at = np.flatnonzero(m == i)
                    own = bins[at]
                    for k in range(outputs):
                        node = _leaf_of(own, f[i, k, : (1 << level) - 1], c[i, k, : (1 << level) - 1]) * BINS
                        for j in range(bins.shape[1]):
                            cell, size = node + own[:, j], BINS << level
                            for s, v in enumerate((g[at, k] * w[at], h[at, k] * w[at], None)):
                                hist[i, k, :, j, :, s] += np.bincount(cell, v, size).reshape(-1, BINS)
                total = hist if total is None else total + hist
            if total is not None:
                yield total

        return run

    def moved(f: np.ndarray, c: np.ndarray, v: np.ndarray):
        """Blocks with the finished trees' values added to their scores."""

        def run(block):
            m, bins, y, w, score = block
            score = score.copy()
            for i in np.unique(m):
                at = np.flatnonzero(m == i)
                for k in range(outputs):
                    score[at, k] += v[i, k][_leaf_of(bins[at], f[i, k], c[i, k])]
            return m, bins, y, w, score

        return run

    before: list = []
    try:
        for r in range(rounds):
            for level in range(depth if n_models else 0):
                lo, hi = (1 << level) - 1, (2 << level) - 1
                hist = blocks.mapPartitions(histogram(level, feature[:, r], cut[:, r])).treeReduce(np.add)
                for i in range(n_models):
                    for k in range(outputs):
                        feature[i, r, k, lo:hi], cut[i, r, k, lo:hi], values = _splits(hist[i, k], least, l2, step, level + 1 == depth)
                        if values is not None:
                            leaf[i, r, k] = values
            before.append(blocks)
            blocks = blocks.map(moved(feature[:, r].copy(), cut[:, r].copy(), leaf[:, r].copy())).persist(StorageLevel.MEMORY_AND_DISK)
            if (r + 1) % CHECKPOINT == 0:
                blocks.checkpoint()
                blocks.count()
            while len(before) > 2:  # the next round's blocks are made from the last ones
                before.pop(0).unpersist()
    finally:
        for held in (*before, blocks):
            held.unpersist()
    return Boosted(models, start, feature, cut, leaf)
