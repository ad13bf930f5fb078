"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint is cut into segments. Fingerprints that differ in few bits differ in fewer
still in one segment at least, so small Hamming balls around each segment's value are
enumerated: the table holds the ball of half the radius around every value, a query probes
the ball of the other half, and both meet in a common point. What meets is verified on
the whole fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scan import mixed
from .shared import shuffle_partitions, written

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = [0, 0x8C2F9D4A6B1E3705, 0x51D7348CB6F2E09B, 0xE6A90B57C41D832F]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``words`` words, repeats included."""
    tokens = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(tokens))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = (ends - sizes)[:n].tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, f0 .. f{lanes-1}): 64 bits a lane; the first lane is of the hashes themselves, others of scrambled ones."""
    names = [f"f{k}" for k in range(lanes)]

    def scan(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), words)
                rows.append([_majority(h if not k else mixed(h ^ np.uint64(_LANES[k]))) if len(h) else 0 for k in range(lanes)])
            cols = list(zip(*rows, strict=True)) or [()] * lanes
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", *names])

    schema = ", ".join(["doc_id long", *[f"{n} long" for n in names]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(scan, schema)


def _ball(radius: int, bits: int) -> list[int]:
    """Masks of at most ``radius`` of a segment's bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _segment(k: int, bits: int) -> Column:
    """Bits k * bits and on of the lanes end to end."""
    lane, at = divmod(k * bits, 64)
    own = F.shiftrightunsigned(F.col(f"f{lane}"), at)
    if at + bits > 64:
        own = own.bitwiseOR(F.shiftleft(F.col(f"f{lane + 1}"), 64 - at))
    return own.bitwiseAND(F.lit((1 << bits) - 1))


def _distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=-1, dtype=np.int64)


def _forest(prints: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that span the components of the fingerprints at ``most`` bits, without listing all pairs.

    Grows each component from a seed: what a member reaches leaves the open set at once, so
    every fingerprint is an edge's end once at most.
    """
    ids, first = np.unique(ids, return_index=True)
    prints = prints[first]
    edges, left = [], np.arange(len(ids))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _distances(prints[at], prints[left]) <= most
            for other in left[near]:
                edges.append((int(ids[at]), int(ids[other])))
                todo.append(other)
            left = left[~near]
    return edges


def _points(segment: int, value: Column, masks: Column) -> Column:
    return F.transform(masks, lambda m: F.struct(F.lit(segment).cast("long").alias("segment"), value.bitwiseXOR(m.cast("long")).alias("value")))


def links(classes: DataFrame, lanes: int, most: int, segment_bits: int = 32) -> DataFrame:
    """Edges (a, b) between class ids ``cid`` whose fingerprints lie within ``most`` bits and meet in a segment.

    The segments' radius is ``most // segments``, or 2 where that is larger. With 64 bits in
    two segments and up to 5 differing ones every link is found; with a larger ``most`` a link
    is found when one segment differs in 2 bits at most.
    """
    segments = lanes * 64 // segment_bits
    radius = min(2, most // segments)
    masks = F.array(*[F.lit(m) for m in _ball((radius + 1) // 2, segment_bits)])
    cols = [f"f{k}" for k in range(lanes)]
    parts = [_segment(k, segment_bits) for k in range(segments)]
    # A ball of half the radius on both sides covers the radius.
    points = F.flatten(F.array(*[_points(s, part, masks) for s, part in enumerate(parts)]))
    probes = classes.select("cid", *cols, F.explode(points).alias("p")).select(F.col("p.segment").alias("segment"), F.col("p.value").alias("value"), "cid", *cols)
    probes = probes.repartition(shuffle_partitions(classes.sparkSession), "segment", "value").sortWithinPartitions("segment", "value")

    def meet(batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = len(held[0])
            if cut:  # the last bucket may go on in the next batch
                same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                cut = int(np.argmax(same)) if not same.all() else 0
            yield from _met([x[:cut] for x in held], most)
            held = [x[cut:] for x in held]
        if held is not None:
            yield from _met(held, most)

    return probes.mapInArrow(meet, "a long, b long").distinct()


def _holds_links(bits: np.ndarray, cid: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int, large: int = 64) -> np.ndarray:
    """Which buckets hold a link; true unseen for those of more than ``large`` rows.

    Most buckets hold chance meetings alone. Rows ``step`` apart are compared in all buckets
    at once, for each step that the longest of them has.
    """
    found = sizes > large
    for step in range(1, int(sizes[~found].max(initial=1))):
        todo = np.flatnonzero(~found & (sizes > step))
        count = sizes[todo] - step
        a = np.repeat(starts[todo] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        b = a + step
        near = (_distances(bits[a], bits[b]) <= most) & (cid[a] != cid[b])
        found[np.repeat(todo, count)[near]] = True
    return found


def _met(cols: list[np.ndarray], most: int):
    segment, value, cid, *prints = cols
    if len(segment) < 2:
        return
    new = np.flatnonzero((segment[1:] != segment[:-1]) | (value[1:] != value[:-1])) + 1
    starts = np.concatenate(([0], new))
    sizes = np.diff(np.concatenate((starts, [len(segment)])))
    bits = np.stack([p.view(np.uint64) for p in prints], axis=1)
    edges: set[tuple[int, int]] = set()
    two = starts[sizes == 2]
    near = _distances(bits[two], bits[two + 1]) <= most
    edges.update((min(a, b), max(a, b)) for a, b in zip(cid[two[near]].tolist(), cid[two[near] + 1].tolist(), strict=True) if a != b)
    more = np.flatnonzero(sizes > 2)
    for k in more[_holds_links(bits, cid, starts[more], sizes[more], most)]:
        own = slice(starts[k], starts[k] + sizes[k])
        edges.update((min(e), max(e)) for e in _forest(bits[own], cid[own], most))
    if edges:
        a, b = zip(*edges, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def simhash_groups(docs: DataFrame, words: int = 4, lanes: int = 1, most: int = 4, segment_bits: int = 32) -> DataFrame:
    """One row per document: doc_id, f0 .. (fingerprint lanes), component_id, the smallest doc_id reachable.

    Shingles are ``words`` words of the text with A-Z lower-cased; a shorter text is one
    shingle. Texts without words, empty and null ones have fingerprint zero and link like any
    other. Documents with equal fingerprints are one class: only classes are compared. A null
    doc_id takes part, but names a component only when no other id is in it (then null).
    Repeated rows are classed together; an empty table gives no rows; extra columns are ignored.
    """
    cols = [f"f{k}" for k in range(lanes)]
    prints = written(fingerprints(docs, words, lanes), "prints")
    classes = prints.groupBy(*cols).agg(F.min("doc_id").alias("first"))
    # A class is known by a hash of its lanes; with one lane that is the fingerprint itself.
    named = written(classes.withColumn("cid", F.col("f0") if lanes == 1 else F.xxhash64(*cols)), "classes")
    member = components(links(named, lanes, most, segment_bits))
    placed = named.join(member, named["cid"] == member["node"], "left").select(*cols, "first", F.coalesce("component", "cid").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = placed.join(least, "component").select(*cols, "component_id")
    return prints.join(by_print, cols).select("doc_id", *cols, "component_id")
