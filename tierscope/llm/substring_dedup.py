"""Removal of word passages that occur earlier in the corpus, by seed and extend.

Winnowing picks anchors: hashes of short word runs, at least one within any passage of the
threshold length. Each anchor is extended to both sides, to every passage of that length
around it, and occurrences of the same anchor meet. An anchor is long enough that a short
common line is no crowded key. Of equal passages all but the earliest occurrence are
repeats; runs of overlapping repeats merge into maximal ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import CHUNK_BYTES, chunks, runs, text_bytes, token_hashes, words
from .shared import shuffle_partitions

SEEDS = "anchor long, doc_id long, text_key long, pos int, first int, windows binary"
SPANS = "doc_id long, text_key long, start int, end int"
#: Repeated windows that a task remembers across its chunks.
REMEMBERED = 1 << 18


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Places of the least of every ``n`` consecutive values, the leftmost of equal ones."""
    best, width = np.arange(len(h)), 1
    left, parts, at = n, None, 0

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] < h[a], b, a)

    m = len(h) - n + 1
    while left:
        if left & 1:
            own = best[at : at + m]
            parts = own if parts is None else lower(parts, own)
            at += width
        left >>= 1
        if left:
            best = lower(best[:-width], best[width:])
            width *= 2
    return parts


def seeds(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """(key, window hash, row, start, anchor's place) of every window of each text.

    ``hashes`` are the word hashes of all texts end to end, ``bounds`` the word offsets.
    Windows do not cross texts. The key is the anchor's hash.
    """
    starts = np.arange(max(0, len(hashes) - window + 1))
    row = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + window <= bounds[row + 1] if len(starts) else np.zeros(0, bool)
    starts, row = starts[inside], row[inside]
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    whole = runs(hashes, window)[starts]
    grams = runs(hashes, gram)
    place = _least(grams, window - gram + 1)[starts]
    key = grams[place]
    return key, whole, row, starts, place


def _merged(row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions (row, start, end) of windows given in order of (row, start)."""
    if not len(row):
        return row, start, start
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return row[first], start[first], start[last] + window


def _later(keys: list[np.ndarray], order_by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then ``order_by``; and whether each row in that order differs from the first of its keys."""
    order = np.lexsort((*order_by[::-1], *keys[::-1]))
    same = np.ones(len(order) - 1 if len(order) else 0, bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    lead = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)
    first = np.repeat(lead, np.diff(np.concatenate((lead, [len(order)]))))
    later = np.zeros(len(order), bool)
    for v in order_by:
        v = v[order]
        later |= v != v[first]
    return order, later


def _spans_batch(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "text_key", "start", "end"])


class _Seen:
    """Earliest known occurrences (doc, text, pos) of windows that repeated in earlier chunks of the task.

    What is not remembered is only sent on once more; results do not depend on it.
    """

    def __init__(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)

    def later(self, whole: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which windows are remembered with an earlier occurrence; earlier ones are remembered instead."""
        if not len(self.keys) or not len(whole):
            return np.zeros(len(whole), bool)
        place = np.minimum(np.searchsorted(self.keys, whole), len(self.keys) - 1)
        known, old = self.keys[place] == whole, self.at[place]
        before = np.zeros(len(whole), bool)
        for k in (2, 1, 0):
            before = (old[:, k] < at[:, k]) | ((old[:, k] == at[:, k]) & before)
        move = known & ~before
        self.at[place[move]] = at[move]
        return known & before

    def add(self, whole: np.ndarray, at: np.ndarray) -> None:
        if len(self.keys) + len(whole) <= REMEMBERED:
            keys, first = np.unique(np.concatenate((self.keys, whole)), return_index=True)
            self.keys, self.at = keys, np.concatenate((self.at, at))[first]


def repeated_spans(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """(doc_id, text_key, start, end): word spans covered by windows whose words also start earlier in the corpus.

    A window is known by its key (64 bits), its anchor's place in it and its own hash (64
    bits). Tasks compare the windows of their own chunks first and send on only the earliest,
    so a passage that many documents share arrives about once from each task.
    """

    def local(batches):
        seen = _Seen()
        for part in chunks(batches, limit=3 << 20):
            ids, texts = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            order = np.lexsort((texts, ids))
            part, ids, texts = part.take(pa.array(order)), ids[order], texts[order]
            raw, offsets = text_bytes(part.column("text"))
            a, b, bounds = words(raw, offsets)
            key, whole, row, start, place = seeds(token_hashes(raw, a, b), bounds, window, gram)
            if not len(key):
                continue
            pos = start - bounds[row]
            by, later = _later([key, whole, start - place], [ids[row], texts[row], pos])
            keep = np.sort(by[~later])
            at = np.stack([ids[row[keep]], texts[row[keep]], pos[keep]], axis=1)
            old = seen.later(whole[keep], at)
            repeated = np.isin(whole[keep], whole[by[later]])
            seen.add(whole[keep][repeated & ~old], at[repeated & ~old])
            out = np.sort(np.concatenate((by[later], keep[old])))
            r, s, e = _merged(row[out], pos[out], window)
            yield _seeds_batch(None, ids[r], texts[r], s, e, None)
            keep = keep[~old]
            key, whole, row, pos, place = key[keep], whole[keep], row[keep], pos[keep], place[keep]
            if not len(key):
                continue
            # Windows of one key occurrence start at consecutive words, save for local repeats.
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1))))
            yield _seeds_batch(key[new], ids[row[new]], texts[row[new]], pos[new], (place - bounds[row])[new] - pos[new], (whole, np.concatenate((new, [len(whole)]))))

    def shared(batches):
        # Batches gather until the key changes, then all whole keys are decided.
        held: list[list[np.ndarray]] = []
        for batch in batches:
            now = _arrays(batch)
            if not len(now[0]):
                continue
            if held and held[0][0][-1] == now[0][-1]:
                held.append(now)
                continue
            rows = _joined([*held, now])
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from _decided(rows, cut, window)
            held = [_from(rows, cut)]
        if held:
            rows = _joined(held)
            yield from _decided(rows, len(rows[0]), window)

    text_key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key, F.col("text").alias("text")).filter("doc_id is not null").mapInArrow(local, SEEDS)
    sent = found.repartition(shuffle_partitions(docs.sparkSession), F.col("anchor"), F.when(F.col("windows").isNull(), F.col("doc_id"))).sortWithinPartitions("anchor")
    return sent.mapInArrow(shared, SPANS)


def _seeds_batch(anchor, doc, text, pos, first, windows) -> pa.RecordBatch:
    """Seeds; or, with anchor None, spans (doc, text, start, end) that are decided already."""
    n = len(doc)
    if anchor is None:
        keys, blobs = pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
    else:
        whole, cuts = windows
        keys = pa.array(anchor.view(np.int64), pa.int64())
        blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole))])
    return pa.RecordBatch.from_arrays([keys, pa.array(doc, pa.int64()), pa.array(text, pa.int64()), pa.array(pos, pa.int32()), pa.array(first, pa.int32()), blobs], ["anchor", "doc_id", "text_key", "pos", "first", "windows"])


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """[anchor, doc, text, pos, first, count, hashes end to end]; decided spans have count 0 and sort first."""
    anchor = batch.column(0)
    known = np.asarray(anchor.is_valid())
    blobs = pc.fill_null(batch.column(5), b"")
    sizes = np.asarray(pc.binary_length(blobs), dtype=np.int64) // 8
    raw = b"".join(blobs.to_pylist()) if blobs.offset else None
    if raw is None:
        offsets = np.frombuffer(blobs.buffers()[1], np.int32)[: len(blobs) + 1]
        raw = memoryview(blobs.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    lowest = np.iinfo(np.int64).min
    keys = np.where(known, np.asarray(pc.fill_null(anchor, 0)), lowest)
    return [keys, *[batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)], np.where(known, sizes, 0), np.frombuffer(raw, np.uint64)]


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts, strict=True)]


def _from(x: list[np.ndarray], cut: int) -> list[np.ndarray]:
    return [*[c[cut:] for c in x[:6]], x[6][int(x[5][:cut].sum()) :]]


def _decided(x: list[np.ndarray], cut: int, window: int):
    """Spans of the rows before ``cut`` whose windows also start earlier."""
    key, doc, text, pos, first, count, hashes = x
    known = np.flatnonzero(count[:cut] == 0)
    if len(known):
        yield _spans_batch(doc[known], text[known], pos[known], first[known])
    key = key[:cut]
    if len(key) < 2:
        return
    same = np.zeros(len(key), bool)
    equal = key[1:] == key[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    same &= count[:cut] > 0
    rows = np.flatnonzero(same)
    if not len(rows):
        return
    begin = np.concatenate(([0], np.cumsum(count[:cut])))[rows]
    n = count[rows]
    base = np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    shift = np.arange(int(n.sum())) - base
    rep = np.repeat(rows, n)
    start = pos[rep] + shift
    order, later = _later([key[rep], hashes[np.repeat(begin, n) + shift], first[rep] - shift], [doc[rep], text[rep], start])
    out = order[later]
    out = out[np.lexsort((start[out], text[rep[out]], doc[rep[out]]))]
    # Documents by (doc, text): a row number stands for them while spans merge.
    d, t = doc[rep[out]], text[rep[out]]
    which = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))) if len(out) else np.zeros(0, np.int64)
    w, s, e = _merged(which, start[out], window)
    lead = np.searchsorted(which, w)
    yield _spans_batch(d[lead], t[lead], s, e)


def packed_texts(batches):
    """(doc_id, text_key, packed, n_bytes): the texts in Zstandard frames, which shuffle in two thirds of the bytes that Spark's blocks of plain rows take."""
    pack = pa.Codec("zstd", 1).compress
    for part in chunks(batches):
        texts = [t.as_buffer() for t in part.column("text")]
        packed = [None if t is None else pack(t, asbytes=True) for t in texts]
        sizes = [None if t is None else t.size for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "text_key", "packed", "n_bytes"])


def drop_repeats(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed word ranges), kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes when a window of ``window`` words that covers
    it occurs with an earlier start too (smaller doc_id, or same document); windows are
    judged on the input. ``kept_text`` joins the words that stay by one space. Null and empty
    texts have no words. A row without doc_id is neither compared nor changed. Repeated
    rows (same doc_id and text) are the same document: what stays in one stays in all of them.
    Rows that share a doc_id but not the text are different documents, in order of the text's hash.
    Extra columns are ignored; an empty table gives no rows.
    """
    spans = repeated_spans(docs, window, gram).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("text").alias("text"))

    def cut(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])
        unpack = pa.Codec("zstd").decompress
        out, held = [], 0
        for batch in batches:
            for doc_id, packed, size, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = unpack(packed.as_buffer(), size, asbytes=True).split() if size else []
                merged: list[dict] = []
                for s in sorted(found or [], key=lambda s: s["start"]):
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(s["end"], merged[-1]["end"])
                    else:
                        merged.append(dict(s))
                kept, at = [], 0
                for s in merged:
                    kept += own[at : s["start"]]
                    at = s["end"]
                kept += own[at:]
                out.append((doc_id, len(own), len(own) - len(kept), merged, b" ".join(kept).decode("utf-8", "surrogatepass")))
                held += size or 0
                if held >= CHUNK_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)
                out, held = [], 0

    packed = texts.mapInArrow(packed_texts, "doc_id long, text_key long, packed binary, n_bytes long")
    return packed.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "packed", "n_bytes", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")

