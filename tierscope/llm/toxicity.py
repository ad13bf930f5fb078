"""Toxicity scores by weak supervision.

Many voters look at a text: lexicon voters (a word, or words that begin alike) and pattern
voters. A generative label model estimates by expectation maximisation how often each
votes on toxic and on clean texts, and from what is left unexplained how strongly voters
repeat each other, which lowers their weight. The posterior labels train a linear classifier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import label_share, labelled_sample
from .scan import chunks, mixed, text_bytes, token_hashes
from .shared import held_out

#: General insults; the voters learned from labels join them.
LEXICON = ("asshole", "bastard", "bitch", "clown", "coward", "cretin", "disgusting", "dumb", "dumbass", "filth", "freak", "fuck", "idiot", "imbecile", "jerk", "loser", "moron", "parasite", "pathetic", "retard", "scum", "shit", "slut", "stupid", "trash", "vermin", "whore", "worthless")
PREFIXES = (4, 5, 6)
PATTERNS = 4
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _latin_lower(raw: np.ndarray) -> np.ndarray:
    low = _FOLD[raw]
    if len(raw) > 1:
        second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1
        low[second] += 0x20
    return low


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every term: each word (letters and bytes over 127, lower case), and its first bytes where it is longer."""
    low = _latin_lower(raw)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(letter & (~np.concatenate(([False], letter[:-1])) | edge[:-1]))
    ends = np.flatnonzero(letter & (~np.concatenate((letter[1:], [False])) | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    rows, keys = [row], [token_hashes(low, starts, ends)]
    size, head = ends - starts, np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        longer = size > k
        head[longer] = head[longer] * np.uint64(256) + low[starts[longer] + k].astype(np.uint64)
        if k + 1 in PREFIXES:
            own = size > k + 1
            rows.append(row[own])
            keys.append(mixed(head[own] * np.uint64(8) + np.uint64(k + 1)))
    return np.concatenate(rows), np.concatenate(keys)


def patterns(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters: more capitals than small letters, exclamations, runs of signs, a short text."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    count = lambda mask: np.bincount(row[mask], minlength=n)
    upper = count((raw >= 65) & (raw <= 90))
    lower = count((raw >= 97) & (raw <= 122))
    sign = ((raw >= 33) & (raw < 48)) | ((raw >= 58) & (raw < 65))
    run = np.zeros(len(raw), bool)
    if len(raw) > 2:
        run[2:] = sign[2:] & sign[1:-1] & sign[:-2]
    return np.stack([upper > lower, count(raw == 33) * 50 > size, count(run) * 50 > size, size < 60], axis=1)


def lexicon_keys() -> np.ndarray:
    data = " ".join(LEXICON).encode()
    return np.unique(terms(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1])


def label_model(votes: np.ndarray, abstains: np.ndarray, gold: np.ndarray, prior: float, gold_accuracy: float = 0.95, steps: int = 25) -> np.ndarray:
    """Posterior of label 1 for each row of ``votes`` (0 or 1), with the given labels as one more voter of known accuracy.

    A voter that abstains says nothing by a 0; the 0 of the others is evidence too.
    """
    v = votes.astype(np.float64)
    given = np.log(gold_accuracy / (1 - gold_accuracy)) * (2.0 * gold - 1)
    start = np.log(prior / (1 - prior))
    posterior = 1 / (1 + np.exp(-(start + given)))
    weight = np.ones(v.shape[1])
    for _ in range(steps):
        on = (v.T @ posterior + 0.5) / (posterior.sum() + 1)
        off = (v.T @ (1 - posterior) + 0.5) / ((1 - posterior).sum() + 1)
        left = v - np.outer(posterior, on) - np.outer(1 - posterior, off)
        scale = np.sqrt((left**2).mean(axis=0)) + 1e-9
        together = np.maximum((left.T @ left) / len(v) / np.outer(scale, scale), 0)
        np.fill_diagonal(together, 0)
        weight = 1 / (1 + np.where(together > 0.3, together, 0).sum(axis=1))
        yes, no = np.log(on / off) * weight, np.where(abstains, 0, np.log((1 - on) / (1 - off)) * weight)
        logit = start + given + v @ yes + (1 - v) @ no
        now = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(now - posterior).max() < 1e-4:
            break
        posterior = now
    return posterior


class Linear:
    """Weights of term keys (sorted), of the patterns, and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, patterns: np.ndarray, bias: float):
        self.keys, self.weights, self.patterns, self.bias = keys, weights, patterns, bias

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, key = terms(raw, offsets)
        value = np.full(n, self.bias) + patterns(raw, offsets) @ self.patterns
        if len(key) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            pair, count = np.unique(row[hit] * len(self.keys) + at[hit], return_counts=True)
            np.add.at(value, pair // len(self.keys), self.weights[pair % len(self.keys)] * _level(count))
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def _level(count: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.log2(np.maximum(count, 1)), 4) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, steps: int = 1000, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum on soft labels."""
    w, b, move, slide = np.zeros(x.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 0.0, 0.0
    step = np.maximum((x**2).sum(axis=0) / len(x), 0.01)
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        move = 0.9 * move - rate * (x.T @ g / len(x) + ridge * w) / np.sqrt(step)
        slide = 0.9 * slide - rate * g.mean()
        w, b = w + move, b + slide
    return w, b


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], gold: np.ndarray, prior: float, voters: int = 192, inputs: int = 512) -> Linear:
    """``rows``: each text's distinct term keys, their counts, and its pattern votes."""
    n = len(rows)
    keys, which = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r[0]) for r in rows])
    count = np.concatenate([r[1] for r in rows])
    ones, every = np.bincount(which, weights=gold[row], minlength=len(keys)), np.bincount(which, minlength=len(keys))
    share = gold.mean()
    z = (ones - every * share) / np.sqrt(every * share * (1 - share) + 1)
    listed = np.isin(keys, lexicon_keys())
    ranked = np.argsort(-z, kind="stable")
    first = ranked[:voters]
    known = np.union1d(first[(z[first] > 3) & (2 * ones[first] > every[first])], np.flatnonzero(listed & (every >= 2)))
    shown = np.stack([r[2] for r in rows])
    votes = np.zeros((n, len(known) + PATTERNS), np.float32)
    place = np.full(len(keys), -1)
    place[known] = np.arange(len(known))
    hit = place[which] >= 0
    votes[row[hit], place[which[hit]]] = 1
    votes[:, len(known) :] = shown
    # One more voter says whether any lexicon voter spoke.
    spoke = votes[:, : len(known)].any(axis=1, keepdims=True)
    posterior = label_model(np.hstack([votes, spoke]), np.arange(votes.shape[1] + 1) < len(known), gold, prior)
    used = np.union1d(known, np.argsort(-np.abs(z), kind="stable")[:inputs])
    used = used[np.isin(used, known) | (np.abs(z[used]) > 3)]
    place[:] = -1
    place[used] = np.arange(len(used))
    x = np.zeros((n, len(used) + PATTERNS), np.float32)
    hit = place[which] >= 0
    x[row[hit], place[which[hit]]] = _level(count[hit])
    x[:, len(used) :] = shown
    w, b = _logistic(x, np.clip(posterior, 1e-3, 1 - 1e-3))
    return Linear(keys[used], w[: len(used)], w[len(used) :], b)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000) -> Linear | None:
    """Fit on a sample of about ``most_labelled`` labelled documents; None without labels of both kinds."""

    def scan(batches):
        for part in chunks(batches, limit=1 << 20):
            raw, offsets = text_bytes(part.column("text"))
            row, key = terms(raw, offsets)
            shown, out = patterns(raw, offsets), []
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(len(part) + 1))
            for i in range(len(part)):
                k, c = np.unique(key[order[cuts[i] : cuts[i + 1]]], return_counts=True)
                out.append((k.tobytes(), c.astype(np.int32).tobytes(), shown[i].astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *[pa.array(c, pa.binary()) for c in zip(*out, strict=True)]], ["doc_id", "label", "keys", "counts", "patterns"])

    # The limit on rows bounds what the driver holds: 12 bytes for each distinct term of a sampled text.
    found = labelled_sample(docs, labels, "toxic", most_labelled).select("doc_id", "label", "text").mapInArrow(scan, "doc_id long, label int, keys binary, counts binary, patterns binary").orderBy("doc_id", "keys").limit(2 * most_labelled).collect()
    gold = np.array([r["label"] for r in found], np.float64)
    if not len(gold) or gold.min() == gold.max():
        return None
    rows = [(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int32), np.frombuffer(r["patterns"], np.uint8)) for r in found]
    del found
    return fit(rows, gold, min(max(label_share(labels, "toxic"), 0.01), 0.99))


def score(docs: DataFrame, model: Linear | None, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts have no terms; the patterns and the bias alone score them. Without labels of both kinds
    every score is 0. Whole texts count. Repeated rows get equal scores; an empty table gives
    no rows; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the numbers of voters and inputs

    def scan(batches):
        own = sent.value
        for part in chunks(batches, limit=1 << 20):
            s = np.zeros(len(part)) if own is None else own.scores(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000) -> DataFrame:
    return score(docs, train(docs, labels, most_labelled))


def keep_civil(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`toxicity_scores` does not predict toxic, with all their columns; each row by its own text."""
    sent, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_labelled)), docs.columns.index("text")

    def scan(batches):
        own = sent.value
        for part in chunks(batches, limit=1 << 20):
            yield part if own is None else part.filter(pa.array(own.scores(*text_bytes(part.column(at))) < threshold))

    return docs.mapInArrow(scan, docs.schema)
