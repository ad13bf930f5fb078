"""Quantile cuts of many scores of the same rows, without a row for each score.

Scores (say, of 100 random orders) are made batch by batch in the tasks and thrown away. A
first pass counts them in cells of their range; of each score's counts follow the few cells
that hold a quantile's neighbours. A second pass makes the scores again: rows in other
cells are added up between those cells, and only rows within them travel. The quantiles are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From a batch of rows: (key, scores, the rows that they belong to); each key's scores of a batch at once.
Scores = Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray, np.ndarray]]]
#: Counters of a task in the first pass; rows that a task holds in the second before it sends them.
_COUNTERS, _HELD = 1 << 24, 1 << 20
_SUMS = ("n", "c1", "c2", "c3")


def _place(shares: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place below, place above) of quantiles among ``n`` sorted values."""
    at = shares * (n - 1)
    return at, np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows (score, class, n, c1, c2, c3) by score and class, equal ones added up."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.flatnonzero(np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)])
    return np.concatenate([rows[new, :2], np.add.reduceat(rows[:, 2:], new, axis=0)], axis=1)


def cut_cells(rows: DataFrame, scores: Scores, n_keys: int, shares: list[float], low: float, high: float) -> DataFrame:
    """(key, _bin, c1, c2, c3, w1, w2, n1, n2, n): the rows' sums by key and number of the score's quantiles below theirs.

    ``rows``: class (0 to 2, difficulty less one), c1, c2, c3 without nulls and whatever
    ``scores`` reads; they are read twice, so they should be written. ``low`` and ``high`` bound the scores.
    """
    cells = 1 << max(4, min(16, (_COUNTERS // max(n_keys, 1)).bit_length() - 1))
    wanted = np.asarray(shares, np.float64)

    def cell(s: np.ndarray) -> np.ndarray:
        return np.clip((s - low) * (cells / (high - low)), 0, cells - 1).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, s, _ in scores(batch):
                if not len(s):
                    continue
                own = found.setdefault(key, np.zeros(cells, np.int32))
                own += np.bincount(cell(s), minlength=cells).astype(np.int32)
        for key, own in found.items():
            small = own.astype(np.min_scalar_type(own.max()))
            yield pd.DataFrame([(key, small.itemsize, zlib.compress(small.tobytes(), 1))], columns=["key", "width", "n"])

    def choose(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(cells, np.int64)
        for width, n in zip(parts["width"], parts["n"], strict=True):
            total += np.frombuffer(zlib.decompress(n), f"u{width}").astype(np.int64)
        upto = np.cumsum(total)
        _, below, above = _place(wanted, int(upto[-1]))
        held = np.unique(np.searchsorted(upto, np.r_[below, above], "right"))
        return pd.DataFrame([(parts["key"].iloc[0], int(upto[-1]), held.astype(np.int32).tobytes(), (upto - total)[held].tobytes())], columns=["key", "n", "cells", "before"])

    counted = rows.mapInPandas(count, "key long, width int, n binary").groupBy("key").applyInPandas(choose, "key long, n long, cells binary, before binary")
    known = {r.key: (r.n, np.frombuffer(r.cells, np.int32), np.frombuffer(r.before, np.int64)) for r in counted.collect()}  # a few hundred cells a key
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def sent() -> Iterator[pd.DataFrame]:
            for key, parts in held.items():
                yield pd.DataFrame([(key, None, _merged(np.concatenate(parts)).tobytes())], columns=["key", "sums", "held"])
            held.clear()

        for batch in batches:
            kind, values = batch["class"].to_numpy(np.int64), batch[["c1", "c2", "c3"]].to_numpy(np.float64)
            for key, s, which in scores(batch):
                if not len(s):
                    continue
                mine = np.zeros(cells, np.int64)
                mine[shared.value[key][1]] = 1
                upto = np.cumsum(mine)
                region = (2 * upto - mine)[cell(s)]  # 2i ahead of the i-th cell, 2i + 1 within it
                k, v = kind[which], values[which]
                spot, size_of = region * 3 + k, 3 * (2 * int(upto[-1]) + 1)
                own = sums.setdefault(key, np.zeros((len(_SUMS), size_of)))
                own[0] += np.bincount(spot, minlength=size_of)
                for i in range(3):
                    own[i + 1] += np.bincount(spot, v[:, i], size_of)
                inside = np.flatnonzero(region & 1)
                if len(inside):
                    held.setdefault(key, []).append(np.column_stack([s[inside], k[inside], np.ones(len(inside)), v[inside]]))
                    size += len(inside)
            if size > _HELD:
                yield from sent()
                size = 0
        yield from sent()
        for key, own in sums.items():
            yield pd.DataFrame([(key, own.tobytes(), None)], columns=["key", "sums", "held"])

    def finish(parts: pd.DataFrame) -> pd.DataFrame:
        key = parts["key"].iloc[0]
        n, own, before = shared.value[key]
        sums = np.sum([np.frombuffer(x).reshape(len(_SUMS), -1, 3) for x in parts["sums"] if x is not None], axis=0)
        inside = _merged(np.concatenate([np.frombuffer(x).reshape(-1, 6) for x in parts["held"] if x is not None]))
        # Where each value ends among all rows: those before its cell and those up to it within.
        at = np.searchsorted(own, cell(inside[:, 0]))
        run = np.cumsum(inside[:, 2])
        first = np.searchsorted(at, np.arange(len(own)))
        ends = before[at] + run - np.r_[0.0, run][first][at]
        place, below, above = _place(wanted, n)
        lower, upper = (inside[np.searchsorted(ends, p, "right"), 0] for p in (below, above))
        share = place - below
        q = np.where(share == 0, lower, (above - place) * lower + share * upper)
        # No quantile lies in a gap between the cells, so a gap's rows share their number of quantiles.
        gaps = np.searchsorted(cell(lower), np.r_[own, cells])
        bins = np.r_[gaps, np.searchsorted(q, inside[:, 0], "left")]
        made = np.zeros((len(wanted) + 1, 3, len(_SUMS)))
        for k in range(3):
            for i in range(len(_SUMS)):
                mine = inside[:, 1] == k
                made[:, k, i] = np.bincount(bins, np.r_[sums[i, ::2, k], np.where(mine, inside[:, 2 + i], 0.0)], len(wanted) + 1)
        total = made.sum(axis=1)
        out = pd.DataFrame({"key": key, "_bin": np.arange(len(total)), "c1": total[:, 1], "c2": total[:, 2], "c3": total[:, 3], "w1": made[:, 0, 3], "w2": made[:, :2, 3].sum(axis=1), "n1": made[:, 0, 0], "n2": made[:, :2, 0].sum(axis=1), "n": total[:, 0]})
        return out[out["n"] > 0]

    schema = "key long, _bin int, " + ", ".join(f"{c} double" for c in ("c1", "c2", "c3", "w1", "w2", "n1", "n2", "n"))
    return rows.mapInPandas(add, "key long, sums binary, held binary").groupBy("key").applyInPandas(finish, schema)


def classed(df: DataFrame, *cols, label: str = "difficulty") -> DataFrame:
    """``cols`` of ``df`` with class, c1, c2 and c3 as :func:`cut_cells` reads them; sums leave nulls out."""
    kind = F.when(F.col(label) <= 1, 0).when(F.col(label) <= 2, 1).otherwise(2)
    return df.select(*cols, kind.alias("class"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("c1", "c2", "c3")])


# ---- md5 of many short texts ------------------------------------------------------
_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


@cache
def _sines() -> list[int]:
    return [int(abs(np.sin(i + 1)) * (1 << 32)) for i in range(64)]


def _first_word(words: list) -> np.ndarray:
    """The first four bytes of md5 as a big-endian number; ``words`` are the block's 16 words, arrays or plain numbers."""
    size = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # the last three steps change the other words only
        kind, g = i >> 4, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i >> 4] & 15
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(_sines()[i])
        else:
            f += np.uint32((_sines()[i] + words[g]) & 0xFFFFFFFF)
        turn = _TURNS[kind][i & 3]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        t |= f
        t += b
        a, b, c, d, t = d, t, b, c, a  # the old a is free
    return (b + np.uint32(_START[0])).byteswap()


def unit_draws(prefixes: list[str], endings: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the ending, numbers in 0..1, the prefixes that they belong to): md5 of each prefix followed by each ending, as ``evaluate.unit_draw`` takes it.

    Texts of up to 55 bytes, which fill one block, are hashed side by side.
    """
    import hashlib

    raw = [p.encode() for p in prefixes]
    sizes = np.array([len(p) for p in raw], np.int64)
    longest = max(len(e.encode()) for e in endings)
    groups = []
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        if size + longest <= 55:
            block = np.zeros((len(which), 64), np.uint8)
            block[:, :size] = np.frombuffer(b"".join(raw[i] for i in which), np.uint8).reshape(len(which), size)
            groups.append((which, int(size), np.ascontiguousarray(block.view("<u4").T)))
        else:
            groups.append((which, int(size), None))
    for e, ending in enumerate(endings):
        out = np.empty(len(raw), np.float64)
        for which, size, base in groups:
            if base is None:
                out[which] = [int.from_bytes(hashlib.md5(raw[i] + ending.encode()).digest()[:4], "big") for i in which]
                continue
            tail = np.zeros(64, np.uint8)
            text = ending.encode() + b"\x80"
            tail[size : size + len(text)] = np.frombuffer(text, np.uint8)
            tail[56:60] = np.frombuffer(np.array([8 * (size + len(text) - 1)], "<u4").tobytes(), np.uint8)
            fixed = tail.view("<u4")
            if size == 0:
                out[which] = int.from_bytes(hashlib.md5(ending.encode()).digest()[:4], "big")
                continue
            words = [base[j] + fixed[j] if 4 * j < size else int(fixed[j]) for j in range(16)]
            out[which] = _first_word(words)
        out /= float(1 << 32)
        yield e, out, np.arange(len(raw))
