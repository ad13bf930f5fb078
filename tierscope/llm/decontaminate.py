"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. The search looks at the last block
of words under the pattern's length: the shift table tells how far the next possible
occurrence is; where the shift is zero, the block's hash bucket names the patterns that end
in it, and their words are compared with the document's. Tables are sorted arrays, made once
on the driver and sent to the executors; all stretches of a chunk of documents are searched
side by side.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import chunks, mixed, runs, text_bytes, token_hashes, words
from .shared import drop_written, written

#: Bytes of [\x00-\x2F\x3A-\x60\x7B-\x7F] become spaces after A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FOLD = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in _FOLD)
_FOLDED = np.frombuffer(_FOLD, np.uint8)
_STEP = np.uint64(0xD1342543DE82EF95)
OUT = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, n_hit long, items array<string>"
#: Ends of windows that one cursor walks over.
STRETCH = 256


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Words:
    """The folded words of the texts of a column, end to end."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        self.raw = _FOLDED[raw]
        self.starts, self.ends, self.bounds = words(self.raw, offsets)
        self.hashes = token_hashes(self.raw, self.starts, self.ends)

    def joined(self, at: int, n: int) -> bytes:
        return b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True))


class WuManber:
    """Shift table and suffix buckets over blocks of two words (one for patterns of one word), for patterns of one length."""

    def __init__(self, patterns: pa.Array, items: pa.Array, length: int):
        """``patterns``: words joined by one space, ``length`` in each; ``items``: a list for each."""
        own = Words(patterns)
        h = own.hashes.reshape(-1, length)
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        blocks = np.stack([self._block(h[:, at], h[:, at + self.block - 1]) for at in range(self.far)], axis=1)
        shift = np.broadcast_to(np.arange(self.far - 1, -1, -1), blocks.shape)
        order = np.lexsort((shift.ravel(), blocks.ravel()))
        flat = blocks.ravel()[order]
        first = np.concatenate(([True], flat[1:] != flat[:-1]))
        self.keys, self.shifts = flat[first], shift.ravel()[order][first].astype(np.int16)
        tails = np.argsort(blocks[:, -1], kind="stable")
        self.tails, self.whole = blocks[tails, -1], runs(own.hashes, length)[::length][tails]
        self.patterns, self.items = patterns.take(pa.array(tails)), items.take(pa.array(tails))

    def _block(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed(before * _STEP + last) if self.block == 2 else last

    def search(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence, in no order."""
        first_end = text.bounds[:-1] + self.length - 1
        room = np.maximum(text.bounds[1:] - first_end, 0)
        pieces = -(-room // STRETCH)
        begin = np.repeat(first_end - np.concatenate(([0], np.cumsum(pieces)[:-1])) * STRETCH, pieces) + np.arange(int(pieces.sum())) * STRETCH
        stop = np.minimum(begin + STRETCH, np.repeat(text.bounds[1:], pieces))
        at, ends = begin, []
        while len(at):
            block = self._block(text.hashes[at - self.block + 1], text.hashes[at])
            place = np.minimum(np.searchsorted(self.keys, block), len(self.keys) - 1)
            by = np.where(self.keys[place] == block, self.shifts[place], self.far)
            ends.append(at[by == 0])
            at = at + np.maximum(by, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        block = self._block(text.hashes[end - self.block + 1], text.hashes[end])
        low, high = np.searchsorted(self.tails, block), np.searchsorted(self.tails, block, side="right")
        count = high - low
        start = np.repeat(end - self.length + 1, count)
        pattern = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        if len(start):
            same = self.whole[pattern] == runs(text.hashes, self.length)[start]
            start, pattern = start[same], pattern[same]
            same = np.array([text.joined(a, self.length) == p.as_py().encode() for a, p in zip(start.tolist(), self.patterns.take(pa.array(pattern)), strict=True)], bool)
            start, pattern = start[same], pattern[same]
        return start, pattern


def _windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(words, n, items): each distinct window, its number of words, and the items that hold it, made in tasks."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [w.decode("utf-8", "surrogatepass") for w in fold_words(text.as_py())]
                for at in range(0, max(1, len(own) - width + 1) if own else 0, 4096):
                    rows = [own[i : i + width] for i in range(at, min(at + 4096, max(1, len(own) - width + 1)))]
                    yield pa.RecordBatch.from_arrays([pa.array([" ".join(r) for r in rows], pa.string()), pa.array([len(r) for r in rows], pa.int32()), pa.array([item] * len(rows), pa.string())], ["words", "n", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").alias("text"))
    return items.mapInArrow(cut, "words string, n int, item string").groupBy("words", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _tables(windows: DataFrame) -> list[WuManber]:
    """Tables of the windows, one for each length. The driver holds them in Arrow form."""
    found = windows.toArrow().combine_chunks()
    lengths = found.column("n").to_numpy()
    out = []
    for n in np.unique(lengths).tolist():
        own = found.filter(pa.array(lengths == n)).combine_chunks()
        out.append(WuManber(own.column("words").combine_chunks(), own.column("items").combine_chunks(), n))
    return out


def _occurrences(tables: list[WuManber], column: pa.Array):
    """(words of the texts; per text: {start: end} of windows, items) by all tables."""
    text = Words(column)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    items: list[set[str]] = [set() for _ in range(len(column))]
    for table in tables:
        start, pattern = table.search(text)
        row = np.searchsorted(text.bounds, start, side="right") - 1
        for r, s, p in zip(row.tolist(), (start - text.bounds[row]).tolist(), pattern.tolist(), strict=True):
            spans[r].append((s, s + table.length))
            items[r].update(table.items[p].as_py())
    return text, spans, items


def _search(docs: DataFrame, tables: list[WuManber]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(tables)  # bounded by max_bytes

    def scan(batches):
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64(), pa.list_(pa.string()))
        for part in chunks(batches):
            text, spans, items = _occurrences(sent.value, part.column("text"))
            out = []
            for doc_id, n, own, found in zip(part.column(0).to_pylist(), np.diff(text.bounds).tolist(), spans, items, strict=True):
                merged: list[list[int]] = []
                for start, end in sorted(own):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([start, end])
                out.append((doc_id, n, [{"start": a, "end": b} for a, b in merged], sum(b - a for a, b in merged), sorted(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "hits", "n_hit", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(scan, OUT)


def _blocks(benchmark: DataFrame, width: int, max_bytes: int) -> list[DataFrame]:
    """The benchmark's windows in blocks whose tables take about ``max_bytes`` each."""
    windows = written(_windows(benchmark, width), "windows")
    # A window takes its words, its items, and about 24 bytes a block of words in the arrays.
    size = F.octet_length("words") + F.octet_length(F.array_join("items", ",")) + F.col("n") * 10 + 64
    total = windows.agg(F.sum(size)).first()[0] or 0
    n = -(-int(total * 1.1) // max_bytes) or 1
    return [windows] if n == 1 else [windows.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == k) for k in range(n)]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, hits (merged word spans), n_hit, items (sorted ids).

    Texts lose A-Z's case and are cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window
    is ``width`` consecutive words of an item, or the whole of a shorter one. Null and empty
    texts have no words and no hits; an item without words has no window; a null item_id
    counts as ''. Items that share a window are all reported. Repeated documents are searched
    one by one; extra columns are ignored; an empty benchmark gives no hits.

    Tables of up to ``max_bytes`` go to the executors at once; a larger benchmark is searched
    in blocks of that size and the spans of all blocks are joined, so no window is left out.
    """
    blocks = _blocks(benchmark, width, max_bytes)
    if len(blocks) == 1:
        return _search(docs, _tables(blocks[0]))
    keyed = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "searched")
    found = None
    for block in blocks:
        part = written(_search(keyed.select(F.col("row").alias("doc_id"), "text"), _tables(block)), "block")
        found = part if found is None else found.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_list("hits"))).alias("spans")
    last = F.element_at  # of the merged spans so far
    merged = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), lambda acc, s: F.when((F.size(acc) > 0) & (last(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc, -1)["start"].alias("start"), F.greatest(last(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))
    one = found.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), spans, F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    one = one.select("row", "n_words", merged.alias("hits"), "items")
    total_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return keyed.select("row", "doc_id").join(one, "row").select("doc_id", "n_words", "hits", total_hit.alias("n_hit"), "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, with all their columns; see :func:`find_benchmark`."""
    at, old = docs.columns.index("text"), None
    blocks = _blocks(benchmark, width, max_bytes)
    for k, block in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(_tables(block))

        def scan(batches, sent=sent):
            for part in chunks(batches):
                _, spans, _ = _occurrences(sent.value, part.column(at))
                yield part.filter(pa.array([not s for s in spans], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
        if k + 1 < len(blocks):
            docs = written(docs, "clean")
            if old is not None:
                drop_written(old)
            old = docs
    return docs
