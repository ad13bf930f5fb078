"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its hashed words, hashed shapes of its characters (n-grams over letter
case, digits, spaces and each sign) and rates of repeated words. TF-IDF weights and a
truncated singular value decomposition of the labelled sample give the latent space. The labelled vectors go to all
executors; every document is compared with all of them in blocked products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import label_share, labelled_sample
from .scan import chunks, fold_ascii, hashed_words, mixed, text_bytes
from .shared import held_out

SHAPES, WORDS = 1 << 10, 1 << 10
EXTRA = 4
WIDTH = SHAPES + WORDS + EXTRA
#: Bytes of a long text that are counted at a time.
SLICE = 1 << 20
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_CLASS[[9, 11, 12]] = 32
_CLASS[13] = 10


def terms(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of term rates: shapes of three characters, words, then words that repeat the last, the one before, any earlier one, and the number of words."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    for at in range(0, max(len(raw) - 2, 0), SLICE):
        kind = _CLASS[raw[at : at + SLICE + 2]].astype(np.uint64)
        row = np.searchsorted(offsets, np.arange(at, at + len(kind)), side="right") - 1
        size = len(kind) - 2
        same = row[:size] == row[2:]
        slot = mixed((kind[:size] * np.uint64(256) + kind[1 : size + 1]) * np.uint64(256) + kind[2:]) >> np.uint64(40)
        slot = (slot & np.uint64(SHAPES - 1)).astype(np.int64)
        out[:, :SHAPES] += np.bincount((row[:size] * SHAPES + slot)[same], minlength=n * SHAPES).reshape(n, SHAPES)
    out[:, :SHAPES] /= np.maximum(out[:, :SHAPES].sum(axis=1, keepdims=True), 1)
    hashes, bounds = hashed_words(fold_ascii(raw), offsets)
    rates = out[:, SHAPES + WORDS :]
    for i in range(n):
        h = hashes[bounds[i] : bounds[i + 1]]
        if len(h):
            out[i, SHAPES : SHAPES + WORDS] = np.bincount((h >> np.uint64(40)).astype(np.int64) & (WORDS - 1), minlength=WORDS) / len(h)
        if len(h) > 2:
            rates[i] = (h[1:] == h[:-1]).mean(), (h[2:] == h[:-2]).mean(), max(0.0, 1 - len(np.unique(h)) / len(h) ** 0.9), len(h) / (len(h) + 1000)
    return np.sqrt(out)


class Voters:
    """The latent space and the labelled vectors in it."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float, neighbours: int):
        self.idf, self.axes, self.vectors, self.labels, self.prior, self.neighbours = idf, axes, vectors, labels, prior, neighbours

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours; the prior where nothing is similar."""
        cosine = self.latent(x) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8
        total = weight.sum(axis=1)
        share = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-9)
        return np.where(total > 1e-9, np.clip(share, 0, 1), self.prior).astype(np.float64)


def fit(x: np.ndarray, labels: np.ndarray, prior: float, dims: int = 48, neighbours: int = 25) -> Voters:
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    weighted = x * idf
    values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    axes = vectors[:, ::-1][:, :dims].astype(np.float32)
    made = Voters(idf, axes, np.zeros((0, dims), np.float32), labels.astype(np.float32), prior, neighbours)
    made.vectors = made.latent(x)
    return made


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, dims: int = 48, neighbours: int = 25) -> Voters | None:
    """Fit on a sample of about ``most_labelled`` labelled documents; None when there are none. The driver holds their term rows only."""

    def scan(batches):
        for part in chunks(batches, limit=1 << 20):
            x = terms(*text_bytes(part.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    found = labelled_sample(docs, labels, "quality", most_labelled).select("doc_id", "label", "text").mapInArrow(scan, "doc_id long, label int, x binary").orderBy("doc_id", "x").limit(2 * most_labelled).collect()
    if not found:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32)
    return fit(x, np.array([r["label"] for r in found]), label_share(labels, "quality"), dims, neighbours)


def score(docs: DataFrame, model: Voters | None, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts have no terms and score the share of label 1 in training; without
    labels every score is 0.5. Whole texts count. Repeated rows get equal scores; an empty
    table gives no rows; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by most_labelled and dims

    def scan(batches):
        own = sent.value
        for part in chunks(batches, limit=1 << 20):
            if own is None:
                s = np.full(len(part), 0.5)
            else:
                s = np.concatenate([own.scores(terms(*text_bytes(p.column("text")))) for p in (part.slice(at, 256) for at in range(0, len(part), 256))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000) -> DataFrame:
    return score(docs, train(docs, labels, most_labelled))
