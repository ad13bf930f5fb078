"""Vectorised scans of UTF-8 text: token bounds and 64-bit token hashes over Arrow buffers.

Texts are read in place from Arrow string arrays, in chunks of a few MB, so the memory
needed does not depend on how many rows an Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each, or one longer row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(batch):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, mult: np.uint64) -> np.ndarray:
    have = _POWERS.get(int(mult))
    if have is None or len(have) < n:
        size = max(1024, 2 * n)
        have = np.full(size, mult, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POWERS[int(mult)] = have
    return have


def token_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: np.uint64 = _MULT) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each token ``raw[starts[i]:ends[i]]``; starts ascend, tokens don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    codes = raw[inside].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(codes), dtype=np.int64) - np.repeat(first, lengths)
    codes *= _powers(int(lengths.max()), mult)[place]
    return mixed(np.add.reduceat(codes, first) ^ (lengths.astype(np.uint64) << np.uint64(48)))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and the n + 1 word offsets of the texts."""
    solid = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(raw) else solid
    after = np.concatenate((solid[1:], [False])) if len(raw) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def fold_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _ASCII_LOWER[raw]


_RUN_STEP = np.uint64(0xD1342543DE82EF95)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of every ``n`` consecutive values, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, size, part, width = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            own = part[size : size + len(h) - n + 1]
            out = own.copy() if out is None else out * _RUN_STEP + own
            size += width
        left >>= 1
        if left:
            part = mixed(part[:-width] * _RUN_STEP + part[width:])
            width *= 2
    return mixed(out)


def hashed_words(raw: np.ndarray, offsets: np.ndarray, limit: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the n + 1 word offsets of the texts; long texts are hashed in slices cut at spaces."""
    if len(raw) <= limit:
        starts, ends, bounds = words(raw, offsets)
        return token_hashes(raw, starts, ends), bounds
    out, counts = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = 0
        while a < b:
            to = min(b, a + limit)
            if to < b:
                spaces = np.flatnonzero(_IS_SPACE[raw[a:to]])
                while not len(spaces) and to < b:  # one word longer than a slice
                    to = min(b, to + limit)
                    spaces = np.flatnonzero(_IS_SPACE[raw[a:to]])
                to = a + int(spaces[-1]) + 1 if to < b else to
            starts, ends, _ = words(raw[a:to], np.array([0, to - a]))
            out.append(token_hashes(raw[a:to], starts, ends))
            n, a = n + len(starts), to
        counts.append(n)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))
