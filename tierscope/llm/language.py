"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of n-gram presence: for each n the cosine
of the sets of byte n-grams that occur, averaged over n. Landmark texts span a Nyström
feature space, in which one ridge regression for each language is fitted. Scoring is two
matrix products a batch: presence times landmarks, kernel rows times weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import chunks, mixed, text_bytes
from .shared import held_out

ORDERS = (1, 2, 3)
BUCKETS = (1 << 9, 1 << 12, 1 << 13)
#: Bytes of a long text that are looked at at a time.
SLICE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# Spaces, digits and signs are one symbol, so that n-grams tell about letters and word ends only.
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def presence(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of hashed n-gram presence; each order's part has length 1 over the square root of the number of orders."""
    n, parts = len(offsets) - 1, []
    seen = [np.zeros((n, buckets), np.float32) for buckets in BUCKETS]
    for at in range(0, len(raw), SLICE):  # slices overlap by the longest n-gram
        part = raw[at : at + SLICE + max(ORDERS) - 1]
        folded = _FOLD[part].astype(np.uint64)
        row = np.searchsorted(offsets, np.arange(at, at + len(part)), side="right") - 1
        # A capital of U+00C0 to U+00DE folds onto its small letter.
        lead = np.concatenate((raw[at - 1 : at] if at else np.zeros(1, np.uint8), part[:-1]))
        folded[(lead == 0xC3) & (part >= 0x80) & (part <= 0x9E)] += np.uint64(0x20)
        for order, buckets, own in zip(ORDERS, BUCKETS, seen, strict=True):
            size = len(folded) - order + 1
            if size > 0:
                key = folded[:size].copy()
                for k in range(1, order):
                    key = key * np.uint64(256) + folded[k : k + size]
                same = row[:size] == row[order - 1 :]
                slot = (key if order == 1 else mixed(key) >> np.uint64(16)) & np.uint64(buckets - 1)
                own[row[:size][same], slot[same].astype(np.int64)] = 1
    for own in seen:
        norm = np.sqrt(own.sum(axis=1, keepdims=True))
        parts.append(own / np.maximum(norm, 1) / np.float32(np.sqrt(len(ORDERS))))
    return np.hstack(parts)


def _letters(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    return np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)


class LanguageModel:
    """Landmarks and one-versus-rest ridge weights in their Nyström space."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, langs: list[str]):
        self.landmarks, self.weights, self.langs = landmarks, weights, langs

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of each language, 0 to 1: its regression value, clipped, over the sum."""
        value = np.clip((x @ self.landmarks.T) @ self.weights, 1e-6, 1)
        return value / value.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, langs: list[str], n_landmarks: int = 160, ridge: float = 1e-2) -> LanguageModel:
    """``x``: presence rows; landmarks are taken evenly over the languages, in the order given."""
    names = sorted(set(langs))
    rank, turn = [0] * len(langs), {n: 0 for n in names}
    for i, lang in enumerate(langs):
        rank[i] = turn[lang]
        turn[lang] += 1
    chosen = sorted(range(len(langs)), key=lambda i: (rank[i], langs[i]))[:n_landmarks]
    marks = x[chosen]
    inner = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values.max()
    project = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T).astype(np.float64) @ project
    y = np.array([[float(lang == n) for n in names] for lang in langs])
    weight = np.linalg.solve(z.T @ z + ridge * len(langs) * np.eye(z.shape[1]) / 100, z.T @ y)
    return LanguageModel(marks, (project @ weight).astype(np.float32), names)


def train(docs: DataFrame, most_labelled: int = 3000, n_landmarks: int = 160) -> LanguageModel | None:
    """Fit on about ``most_labelled`` labelled rows outside the held-out fold, chosen evenly over the languages by hash.

    Every language gives two rows at least and one landmark, so with very many languages the
    sample and the landmarks grow with their number, never with the documents. None when there
    is no such row. The driver holds the presence rows of that sample only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = rows.groupBy("lang").count().orderBy("lang").collect()
    if not langs:
        return None
    # Each language gives its share of the rows: a hash under a threshold that its count sets.
    most_labelled, n_landmarks = max(most_labelled, 2 * len(langs)), max(n_landmarks, len(langs))
    each = -(-most_labelled // len(langs))
    cut = docs.sparkSession.createDataFrame([(r["lang"], max(each * 1.2, each + 4.0) / r["count"]) for r in langs], "lang string, cut double")
    unit = (F.xxhash64("doc_id", F.lit("language")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    chosen = rows.withColumn("u", unit).join(F.broadcast(cut), "lang").filter(F.col("u") < F.col("cut"))

    def scan(batches):
        for part in chunks(batches, limit=1 << 20):
            x = presence(*text_bytes(part.column("text")))
            packed = np.packbits(x > 0, axis=1)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("u"), pa.array([p.tobytes() for p in packed], pa.binary())], ["lang", "u", "bits"])

    found = sorted(chosen.select("lang", "u", "text").mapInArrow(scan, "lang string, u double, bits binary").orderBy("u", "lang").limit(2 * most_labelled + 8 * len(langs)).collect(), key=lambda r: (r["u"], r["lang"]))
    kept, count = [], {}
    for r in found:
        if count.setdefault(r["lang"], 0) < each:
            count[r["lang"]] += 1
            kept.append(r)
    if not kept:
        return None
    seen = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in kept), np.uint8).reshape(len(kept), -1), axis=1).astype(np.float32)
    at, parts = 0, []
    for buckets in BUCKETS:
        own = seen[:, at : at + buckets]
        parts.append(own / np.maximum(np.sqrt(own.sum(axis=1, keepdims=True)), 1) / np.float32(np.sqrt(len(ORDERS))))
        at += buckets
    return fit(np.hstack(parts), [r["lang"] for r in kept], n_landmarks)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter, empty ones too, are ``und`` with score 0; so is every text when there
    was nothing to learn from. Whole texts count, however long. Ties go to the first language
    by name. Repeated rows get equal results; an empty table gives no rows; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: their number is a parameter

    def scan(batches):
        own = sent.value
        for part in chunks(batches, limit=1 << 20):
            known = _letters(part.column("text"))
            if own is None:
                langs, score = ["und"] * len(part), np.zeros(len(part))
            else:
                p = np.vstack([own.scores(presence(*text_bytes(piece.column("text")))) for piece in (part.slice(at, 128) for at in range(0, len(part), 128))])
                best = p.argmax(axis=1)
                langs = [own.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
                score = np.where(known, p[np.arange(len(p)), best], 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_language(docs: DataFrame, most_labelled: int = 3000, n_landmarks: int = 160) -> DataFrame:
    return identify(docs, train(docs, most_labelled, n_landmarks))
