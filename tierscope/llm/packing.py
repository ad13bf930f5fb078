"""Packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

Documents are tokenised and cut where they are longer than a sequence. Pieces are dealt at
random into blocks of bounded size. Several islands evolve packings of the same block:
crossover injects whole well-filled bins of one parent into another, bins that hold an
injected piece lose it with all their others, and displaced pieces are placed by best fit.
After each epoch an island's elite moves to the next island of its ring. A block evolves
until its packing has as few bins as its total length allows, or its epochs are over. What the best
packings leave in bins with room is dealt into new blocks and packed again.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import chunks, text_bytes, token_hashes
from .shared import broadcast_if_small, written

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"

# Byte classes of the texts whose token bounds the scan can tell by itself: 0 space, 1 letter,
# 2 digit, 3 other printable ASCII; 9 sends a text to the tokenizer as a whole.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
#: The second byte of U+00C0 to U+00FF (after 0xC3) that is a letter: all but the signs times and division.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_SPECIAL = re.compile(rb"<\|")


class Tokens:
    """Token ids of texts. Tokens seen before are looked up by hash; only new ones are encoded.

    The tokenizer splits a text at white space and between letters, single digits and other
    signs, and encodes each part alone. A part with an apostrophe, which may split
    otherwise, is kept together up to white space; a text with bytes outside the classes
    above is encoded whole.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        #: Sorted hashes and the slot of each: a few bytes an entry, where a dict takes over a hundred.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.used, self.size = np.zeros(1 << 16, np.uint32), 0, 0
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _add(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """Encode new tokens (their hashes in order)."""
        slots = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        for at in range(0, len(texts), 4096):
            for made in self.tokenizer.encode_batch_fast([t.decode() for t in texts[at : at + 4096]], add_special_tokens=False):
                ids, k = made.ids, self.size
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
                if k == len(self.first):
                    self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
                self.ids[self.used : self.used + len(ids)] = ids
                self.first[k], self.count[k] = self.used, len(ids)
                self.used += len(ids)
                self.size += 1
        place = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, place, keys), np.insert(self.slots, place, slots)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        raw, offsets = text_bytes(column)
        kind = _CLASS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)
        lead = lead[_LATIN[raw[lead + 1]]]
        kind[lead] = kind[lead + 1] = 1
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, np.flatnonzero(kind == 9), side="right") - 1] = True
        data = raw.tobytes()
        if b"<|" in data:
            odd[[int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in _SPECIAL.finditer(data)]] = True
        for i in np.flatnonzero(odd):
            kind[offsets[i] : offsets[i + 1]] = 0
        solid = kind > 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([0], kind[:-1])).astype(np.uint8) if len(raw) else kind
        before[edge[:-1]] = 0
        begins = solid & (before == 0)
        bound = solid & ((kind != before) | (kind == 2))
        quotes = np.flatnonzero((raw == 39) & solid)
        if len(quotes):
            chunk = np.cumsum(begins)
            tied = np.zeros(int(chunk[-1]) + 1, bool)
            tied[chunk[quotes]] = True
            bound &= begins | ~tied[chunk]
        starts = np.flatnonzero(bound)
        last = np.concatenate((kind[1:] == 0, [True])) | edge[1:] if len(raw) else edge[1:]
        stops = solid & last
        stops[starts[1:] - 1] |= solid[starts[1:] - 1]
        ends = np.flatnonzero(stops) + 1
        codes, unique = pd.factorize(token_hashes(raw, starts, ends))
        before = self.keys, self.slots, self.used, self.size
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            where = np.zeros(len(unique), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            new = new[np.argsort(unique[new])]
            sample = where[new]
            self._add(unique[new], [data[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)])
            at = np.searchsorted(self.keys, unique)
        slot = self.slots[at][codes]
        count = self.count[slot]
        done = np.concatenate(([0], np.cumsum(count)))
        flat = self.ids[np.repeat(self.first[slot] - done[:-1], count) + np.arange(done[-1])]
        cuts = done[np.searchsorted(starts, offsets)]
        out = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if self.size > self.most:  # a full table keeps what came first, mostly the frequent tokens
            self.keys, self.slots, self.used, self.size = before
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return out


_LOADED: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One tokenizer and table for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32[, ids]): each document's ids, then ``end_id``, in pieces of at most ``capacity``.

    ``copy`` tells repeated rows apart. Null and empty texts hold ``end_id`` alone.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def scan(batches):
        tokens = tokens_of(tokenizer_path)
        for part in chunks(batches):
            rows = []
            for doc_id, copy, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), tokens.encode(part.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((doc_id, copy, k, at, len(own), zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if with_ids else [])))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "copy", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(scan, schema)


# A packing is a list of bins; a bin is a list of item numbers.


def best_fit(bins: list[list[int]], room: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Place items into the bin with the least room that suffices, else into a new one."""
    open_bins = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        at = bisect_left(open_bins, (sizes[i], -1))
        if at == len(open_bins):
            bins.append([i])
            room.append(capacity - sizes[i])
            b = len(bins) - 1
        else:
            r, b = open_bins.pop(at)
            bins[b].append(i)
            room[b] = r - sizes[i]
        if room[b]:
            insort(open_bins, (room[b], b))


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    """Mean squared fill: rewards full bins beside nearly empty ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def _fill(bin_: list[int], sizes: list[int]) -> int:
    return sum(sizes[i] for i in bin_)


def _exchanged(bins: list[list[int]], room: list[int], loose: list[int], sizes: list[int]) -> list[int]:
    """Swap displaced pieces for smaller ones, or pairs of them, of a bin where that fills it better; what is loose then."""
    loose = sorted(loose, key=lambda i: -sizes[i])
    for b in range(len(bins)):
        if not room[b] or not loose:
            continue
        own = sorted(bins[b], key=lambda i: sizes[i])[:8]
        best = (0, None, None)
        for out in [(i,) for i in own] + [(i, j) for x, i in enumerate(own) for j in own[x + 1 :]]:
            gone = _fill(list(out), sizes)
            # The largest loose piece that the bin can hold without them.
            at = bisect_left(loose, -(gone + room[b]), key=lambda i: -sizes[i])
            if at < len(loose) and sizes[loose[at]] - gone > best[0]:
                best = (sizes[loose[at]] - gone, out, at)
        if best[0]:
            gain, out, at = best
            bins[b] = [i for i in bins[b] if i not in out] + [loose.pop(at)]
            room[b] -= gain
            for i in out:
                insort(loose, i, key=lambda k: -sizes[k])
    return loose


def crossover(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: random.Random, share: float = 0.3) -> list[list[int]]:
    """Inject whole well-filled bins of ``other`` into ``one``; bins that hold an injected piece go, their other pieces are displaced.

    As a mutation, some of the least filled bins that stay are opened too.
    """
    ranked = sorted(other, key=lambda b: -_fill(b, sizes))
    good = ranked[: max(1, int(len(ranked) * share))]
    taken = [b for b in good if rng.random() < 0.5]
    inside = {i for b in taken for i in b}
    stay = sorted((b for b in one if inside.isdisjoint(b)), key=lambda b: -_fill(b, sizes))
    opened = stay[len(stay) - min(len(stay), rng.randrange(1, 4 + len(stay) // 10)) :]
    stay = stay[: len(stay) - len(opened)]
    loose = [i for b in one if not inside.isdisjoint(b) for i in b if i not in inside] + [i for b in opened for i in b]
    bins = [list(b) for b in taken] + [list(b) for b in stay]
    room = [capacity - _fill(b, sizes) for b in bins]
    best_fit(bins, room, sorted(_exchanged(bins, room, loose, sizes), key=lambda i: -sizes[i]), sizes, capacity)
    return bins


def first_packing(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> list[list[int]]:
    bins: list[list[int]] = []
    best_fit(bins, [], sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random())), sizes, capacity)
    return bins


def evolve(population: list[list[list[int]]], sizes: list[int], capacity: int, rng: random.Random, generations: int) -> list[list[list[int]]]:
    """Some generations on one island, best first; ends early at the lower bound of bins."""
    least = -(-sum(sizes) // capacity)
    order = lambda p: (len(p), -fitness(p, sizes, capacity))
    ranked = sorted(population, key=order)
    for _ in range(generations):
        if len(ranked[0]) <= least:
            break
        one, other = sorted(rng.sample(range(len(ranked)), 2)) if len(ranked) > 1 else (0, 0)
        child = crossover(ranked[one], ranked[other], sizes, capacity, rng)
        ranked = sorted([*ranked, child], key=order)[: len(population)]
    return ranked


def _packing(rows: pd.DataFrame) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(rows["bin"].tolist()):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


def _islands(pieces: DataFrame, capacity: int, block_size: int, islands: int, epochs: int, generations: int, salt: int, population: int = 5) -> DataFrame:
    """One round: deal pieces into blocks, pack each, evolve islands for the blocks above their bound, keep the best packing.

    Returns (doc_id, copy, piece, length, block, bin). The migration between the islands of a
    block crosses a shuffle: each epoch's output holds every island's elite, and the next
    epoch starts each island from its own and its neighbour's.
    """
    total = pieces.count()
    blocks = max(1, -(-total // block_size))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(salt)), F.lit(blocks)).cast("long"))
    schema = "doc_id long, copy long, piece int, length long, block long, island int, bin int, bins int, least int"

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["doc_id", "copy", "piece"], na_position="first", ignore_index=True)

    def written_out(rows: pd.DataFrame, island: int, bins: list[list[int]]) -> pd.DataFrame:
        number = np.zeros(len(rows), np.int32)
        for b, items in enumerate(bins):
            number[items] = b
        least = -(-int(rows["length"].sum()) // capacity)
        return rows[["doc_id", "copy", "piece", "length", "block"]].assign(island=np.int32(island), bin=number, bins=np.int32(len(bins)), least=np.int32(least))

    def start(rows: pd.DataFrame) -> pd.DataFrame:
        rows = order(rows)
        return written_out(rows, 0, first_packing(rows["length"].tolist(), capacity, random.Random(0), 0.0))

    def epoch(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One island: its elite, the neighbour's, and new packings make its population."""
        island = int(key[1])
        elites = {int(origin): order(own) for origin, own in rows.groupby("origin")}
        rows = elites.get(island, next(iter(elites.values())))
        sizes, rng = rows["length"].tolist(), random.Random(f"{salt}/{key[0]}/{island}/{len(elites)}")
        bred = [_packing(e) for _, e in sorted(elites.items())]
        bred += [first_packing(sizes, capacity, rng, noise) for noise in (0.02, 0.05, 0.1, 0.2, 0.4)[: max(0, population - len(bred))]]
        return written_out(rows, island, evolve(bred, sizes, capacity, rng, generations)[0])

    now = written(dealt.groupBy("block").applyInPandas(start, schema), "islands")
    done = []
    for k in range(epochs + 1):
        best = now.groupBy("block").agg(F.min_by("island", F.struct("bins", "island")).alias("island"), F.min(F.col("bins") - F.col("least")).alias("above"))
        best = written(best, "best")
        closed = best.filter("above <= 0") if k < epochs else best
        done.append(now.join(closed.select("block", "island"), ["block", "island"]).select("doc_id", "copy", "piece", "length", "block", "bin"))
        still = best.filter("above > 0").select("block")
        n_still = still.count()
        if k == epochs or not n_still:
            break
        left = now.join(broadcast_if_small(still, n_still), "block", "left_semi").withColumn("origin", F.col("island"))
        # The first packing starts all islands; later each elite stays and moves to the next of the ring.
        to = F.array(*[F.lit(i) for i in range(islands)]) if not k else F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        moved = left.withColumn("island", F.explode(F.array_distinct(to)))
        now = written(moved.groupBy("block", "island").applyInPandas(epoch, schema), "islands")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


#: Of a sequence's number: three bits for the round, forty for the block, twenty for the bin.
_BIN, _BLOCK = 20, 40


def pack(pieces: DataFrame, capacity: int = 4096, block_size: int = 2048, islands: int = 3, epochs: int = 2, generations: int = 30, rounds: int = 2, full: float = 0.995) -> DataFrame:
    """``pieces`` with sequence_id and offset: few sequences of at most ``capacity``, gapless from 0.

    A piece as long as a sequence is one by itself (a negative sequence_id). Blocks hold about
    ``block_size`` pieces whatever the input's size, so memory is bounded. Bins filled less
    than ``full`` are emptied after each round but the last, and their pieces dealt into new
    blocks. Which pieces share a block depends on how the input is partitioned, so
    packings of one input may differ, not their validity. An empty table gives no rows.
    """
    pieces = written(pieces, "pieces")
    whole = pieces.filter(F.col("length") >= capacity).select("copy", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, placed = pieces.filter(F.col("length") < capacity).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "copy", "piece", "length"), []
    for k in range(rounds):
        packed = _islands(left, capacity, block_size, islands, epochs, generations, k)
        fills = packed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        packed = written(packed.join(fills, ["block", "bin"]), "packed")
        done = packed if k == rounds - 1 else packed.filter(F.col("fill") >= full * capacity)
        left = packed.filter(F.col("fill") < full * capacity).select("doc_id", "copy", "piece", "length")
        number = F.shiftleft(F.lit(k).cast("long"), _BIN + _BLOCK) + F.shiftleft("block", _BIN) + F.col("bin")
        placed.append(done.select("doc_id", "copy", "piece", "length", number.alias("sequence_id")))
    bins = placed[0]
    for more in placed[1:]:
        bins = bins.unionByName(more)
    before = Window.partitionBy("sequence_id").orderBy("doc_id", "copy", "piece").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("copy", "piece", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    places = bins.unionByName(whole).select(F.col("copy").alias("_copy"), F.col("piece").alias("_piece"), "sequence_id", "offset")
    return pieces.join(places, (F.col("copy") == F.col("_copy")) & (F.col("piece") == F.col("_piece"))).drop("_copy", "_piece")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts hold the end id alone; repeated rows and null ids are packed row by
    row; extra columns are ignored; an empty table gives no rows.
    """
    return pack(cut_pieces(docs, tokenizer_path, capacity), capacity, **options).drop("copy")
