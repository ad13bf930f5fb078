"""Near-duplicate groups: SimHash candidates by multi-index hashing, decided on whole shingle sets.

A document's set of shingles gives a fingerprint of several 64-bit lanes. Its bits are cut
into segments; around each segment's value the ball of radius 1 is enumerated on both
sides, so values that differ in up to 2 bits meet in a common point. What meets is verified
on two lanes, then on the complete fingerprints, then on the shingle sets themselves. One lane
would not do: what meets by chance grows with the square of the documents, and one such pair in 400 is near on 64 bits.

A fingerprint of a small set says little: of an even number of hashes many bits are ties, which
one more shingle flips. Sets of up to ``SMALL`` shingles therefore also meet exactly: sets that are
similar enough share one of each one's rarest shingles (prefix filtering), so those are points
too, and no fingerprint is compared between two small sets.

Points that very many documents share are never listed pair by pair. Each chunk of
documents, and then each point, first picks leaders and links the others to them; of these
links each document's nearest and first are verified and give components. A second pass
compares all documents of different components that share a point, so no link between
what meets is lost. Its pairs travel as small matrices between blocks of neighbouring documents, and
whole blocks of shingle sets meet, so a crowd of nearly similar documents costs few rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scan import chunks, fold_ascii, mixed, runs, text_bytes, token_hashes, words
from .shared import broadcast_if_small, drop_written, free_name, settings, shuffle_partitions, skew_join, written

#: Odd constants that scramble the shingle hashes anew for each lane.
_STEP = 0x9E3779B97F4A7C15
_SHORT = np.uint64(0xA24BAED4963EE407)
#: Points with more rows than this are split over tasks in the second pass.
CROWD = 512
#: Classes and bytes of shingle sets in a block of the second pass.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Pairs of two blocks from which on whole blocks are sent; fewer are sent pair by pair.
DENSE = 128
#: Two to this power blocks form a tile; dense block pairs of two tiles are decided together.
TILE = 3
#: Rows of points that a task holds at once, and classes whose points it makes at once (four megabytes of rows).
BUFFER, SLICE = 1 << 16, 512
#: Rows and bytes of an Arrow batch: shingle sets and blocks of them are long rows.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20
#: Sets of up to so many shingles meet by their rarest ones.
SMALL = 24
#: Of a lane the top bit says that the set is small; the others are compared.
_TOP = np.uint64(1 << 63)


@dataclass(frozen=True)
class Plan:
    """Shape of the fingerprints and of the search."""

    bits: int  #: of a segment
    segments: int
    lanes: int
    most: int  #: differing bits of the complete fingerprints
    lane_most: int  #: differing bits of the last two lanes


def plan_search(n: int, least: Fraction = Fraction(4, 5), recall: float = 0.98) -> Plan:
    """Segments of a width that follows from the number of documents, and as many as ``recall`` at ``least`` takes.

    Of sets with Jaccard similarity s the cosine is 2s / (1 + s) at least (equal sizes), and a
    bit differs with the angle's share of a half turn. A pair meets in a segment when 2 of its
    bits differ at most; the distance limits lie over three standard deviations above the mean.
    """
    s = float(least)
    p = math.acos(2 * s / (1 + s)) / math.pi
    bits = max(20, n.bit_length())
    meets = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    segments = math.ceil(math.log(1 - recall) / math.log(1 - meets))
    lanes = -(-segments * bits // 64)
    limit = lambda size: math.ceil(size * p + 3.3 * math.sqrt(size * p * (1 - p)))
    return Plan(bits, segments, lanes, limit(64 * lanes), limit(64 * min(lanes, 2)))


def shingle_sets(column: pa.Array, n_words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    raw, offsets = text_bytes(column)
    raw = fold_ascii(raw)
    starts, ends, bounds = words(raw, offsets)
    h = token_hashes(raw, starts, ends)
    whole = runs(h, n_words)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n_words:
            out.append(np.unique(whole[a : b - n_words + 1]))
        elif b > a:
            acc = np.array([b - a], np.uint64) ^ _SHORT
            for k in range(a, b):
                acc = mixed(acc) * np.uint64(_STEP) + h[k : k + 1]
            out.append(mixed(acc))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` values of 64 bits; a bit is set when over half of the (scrambled) hashes have it."""
    ones = np.zeros(lanes * 64, np.int64)
    salts = (np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(_STEP))[None, :]
    for at in range(0, len(shingles), 1 << 12):
        part = mixed(shingles[at : at + (1 << 12), None] ^ salts).view(np.uint8)
        # Per byte place, how often each byte value occurs; the values' bits are added up once.
        place = np.arange(part.shape[1], dtype=np.int32) << 8
        tally = np.bincount((part + place).ravel(), minlength=part.shape[1] << 8).reshape(-1, 256)
        ones += (tally @ _BITS).ravel()
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.uint64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _marked(docs: DataFrame, plan: Plan, n_words: int, extra: dict[str, str]) -> DataFrame:
    """``docs`` with a row number, the digest and size of the shingle set, and the fingerprint."""
    docs = docs.withColumn(extra["row"], F.monotonically_increasing_id())
    text = docs.columns.index("text")
    added = [T.StructField(extra["digest"], T.BinaryType()), T.StructField(extra["n"], T.LongType()), T.StructField(extra["print"], T.BinaryType())]

    def scan(batches):
        for part in chunks(batches):
            sets = shingle_sets(part.column(text), n_words)
            cols = [pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s, plan.lanes).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *added]))


def _points(prints: np.ndarray, plan: Plan) -> np.ndarray:
    """Rows of points: for each segment its value and all values one bit away, the segment in the upper bits."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : plan.segments * plan.bits]
    parts = bits.reshape(len(prints), plan.segments, plan.bits).astype(np.int64)
    value = (parts << np.arange(plan.bits)).sum(axis=2) | (np.arange(plan.segments, dtype=np.int64) << plan.bits)
    masks = np.concatenate(([0], 1 << np.arange(plan.bits, dtype=np.int64)))
    return (value[:, :, None] ^ masks).reshape(len(prints), plan.segments * len(masks))


def _spread(batch: pa.RecordBatch, plan: Plan, least: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``batch``, point, turned) of all points of its classes, and each class's last two lanes.

    A set whose similar ones are all small has its rarest shingles as points (``points``), a large
    one the segments' balls, one between them both. ``turned`` is the place, from 1, of the bit in which a point
    differs from its segment's value, or 0. Of two lanes by chance hardly two are near; of one, one in 400 is.
    """
    prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(-1, plan.lanes)
    n = batch.column("n").to_numpy(zero_copy_only=False)
    top = (prints[:, -1] & ~_TOP) | np.where(n <= SMALL, _TOP, np.uint64(0))
    lane = np.stack([top, prints[:, -2] if plan.lanes > 1 else np.zeros_like(top)], axis=1)
    wide = np.flatnonzero(n > SMALL * least.numerator // least.denominator)
    points = _points(prints[wide], plan)
    rare = batch.column("points")
    sizes = pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False)
    own = np.concatenate((np.repeat(wide, points.shape[1]), np.repeat(np.arange(len(n)), sizes)))
    turned = np.concatenate((np.tile(np.arange(plan.bits + 1, dtype=np.int8), len(wide) * plan.segments), np.zeros(int(sizes.sum()), np.int8)))
    return own, np.concatenate((points.ravel(), pc.list_flatten(rare).to_numpy(zero_copy_only=False))), turned, lane


def _apart(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits of the two lanes differ."""
    return np.bitwise_count((f[a, 0] ^ f[b, 0]) & ~_TOP).astype(np.int64) + np.bitwise_count(f[a, 1] ^ f[b, 1])


def _near(f: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return (_apart(f, a, b) <= most) | (f[a, 0] & f[b, 0] >= _TOP)


def _least_meeting(point: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether ``point`` is the only one of those that two values share in their segment to count; ``i`` and ``j`` are their ``turned``.

    Equal values count at their own point, others at the smaller of the two points between them.
    """
    upper = np.maximum(i, j).astype(np.int64)
    return np.where(i == j, i == 0, (point >> np.maximum(upper - 1, 0)) & 1 == 0)


def leaders(point: np.ndarray, f: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which rows lead, and the (leader, follower) pairs. Rows are in order of point; ``f`` has two lanes a row; ``n`` moves from followers to their leaders.

    In each point the first row left leads and takes all near rows; then the first of the rest does.
    """
    lead, pairs = np.ones(len(point), bool), []
    same = np.zeros(len(point) + 1, bool)
    same[1:-1] = point[1:] == point[:-1]
    left = np.flatnonzero(same[1:] | same[:-1])
    while len(left):
        new = np.concatenate(([True], point[left[1:]] != point[left[:-1]]))
        head = left[new][np.cumsum(new) - 1]
        near = _near(f, left, head, most) & ~new
        if near.any():
            a, b = head[near], left[near]
            pairs.append((a, b))
            lead[b] = False
            np.add.at(n, a, n[b])
        left = left[~near & ~new]
    return lead, pairs


MEETINGS = "point long, cid long, f long, g long, n long"


_NAMES = ["point", "cid", "f", "g", "n"]


def _distinct(cid: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of classes, and a place in ``pairs`` (end to end) of each."""
    a, b = (cid[np.concatenate([p[k] for p in pairs])] for k in (0, 1))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0, return_index=True)


def _edge_batch(cid: np.ndarray, f: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Pairs as rows without a point: (null, a, b, null, their distance on the last lanes)."""
    both, at = _distinct(cid, pairs)
    a, b = (np.concatenate([p[k] for p in pairs])[at] for k in (0, 1))
    none = pa.nulls(len(both), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(both[:, 0]), pa.array(both[:, 1]), none, pa.array(_apart(f, a, b))], _NAMES)


def _lanes(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.stack([f, g], axis=1).view(np.uint64)


def _rarest(marked: DataFrame, classes: DataFrame, n_words: int, least: Fraction, extra: dict[str, str]) -> tuple[DataFrame, list[DataFrame]]:
    """``classes`` with ``points``, and the tables it reads.

    ``points`` are the rarest shingles of small sets, one more than a similar set may lack; null without any that others
    share. Rarity is the number of small sets that hold a shingle; what only one holds comes first and makes no point.
    """
    small = classes.filter(F.col("n") <= SMALL)
    if small.isEmpty():
        return classes.withColumn("points", F.lit(None).cast("array<long>")), []
    held = _sets(marked, small, n_words, extra)

    def each(batches):
        for batch in batches:
            sizes = [len(b) // 8 for b in batch.column(1).to_pylist()]
            shingles = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)), pa.array(np.repeat(np.array(sizes, np.int64), sizes)), pa.array(shingles)], ["cid", "n", "s"])

    listed = held.mapInArrow(each, "cid long, n long, s long")
    shared = listed.groupBy("s").agg(F.count(F.lit(1)).alias("of")).filter("of > 1")
    known = skew_join(listed, shared, ["s"], "of").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("of", "s"))).alias("known"))
    needed = F.floor((F.col("n") * least.numerator + least.denominator - 1) / least.denominator)
    spare = F.size("known") - needed + 1
    # The top bit keeps them apart from the segments' points.
    points = F.transform(F.slice("known", F.lit(1), F.greatest(spare, F.lit(0)).cast("int")), lambda k: k["s"].bitwiseOR(F.lit(-(1 << 63))))
    rare = written(known.select("cid", points.alias("points")).filter(F.size("points") > 0), "rarest")
    drop_written(held)
    return classes.join(broadcast_if_small(rare, rare.count()), "cid", "left"), [rare]


def _first_meetings(classes: DataFrame, plan: Plan, least: Fraction) -> DataFrame:
    """Links of followers to leaders (point null: cid and f are the two classes, n their distance), and points of more than ``CROWD`` classes (cid null)."""

    def local(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                cid = part.column("cid").to_numpy(zero_copy_only=False)
                rep, flat, _, lane = _spread(part, plan, least)
                order = np.argsort(flat, kind="stable")
                point, own = flat[order], rep[order]
                f, n = lane[own], np.ones(len(own), np.int64)
                lead, pairs = leaders(point, f, n, plan.lane_most)
                if pairs:
                    yield _edge_batch(cid[own], f, pairs)
                f = f.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[lead]) for x in (point, cid[own], f[:, 0], f[:, 1], n)], _NAMES)

    def meet(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        for now, last in _buffered(batches):
            if now.num_rows and now.column(0).null_count:
                yield now.filter(now.column(0).is_null())
                now = now.filter(now.column(0).is_valid())
            rows = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, now.columns, strict=True)]
            point, cid, f, g, n = rows
            n, both = n.copy(), _lanes(f, g)
            lead, pairs = leaders(point, both, n, plan.lane_most)
            if pairs:
                yield _edge_batch(cid, both, pairs)
            point, cid, f, g, n = (x[lead] for x in (point, cid, f, g, n))
            # Of the last point, which may go on, the leaders stay.
            cut = len(point) if last else int(np.searchsorted(point, point[-1])) if len(point) else 0
            held = [x[cut:] for x in (point, cid, f, g, n)]
            if cut:
                heads = np.flatnonzero(np.concatenate(([True], point[1:cut] != point[: cut - 1])))
                total = np.add.reduceat(n[:cut], heads)
                big = total > CROWD
                none = pa.nulls(int(big.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(point[heads[big]]), none, none, none, pa.array(total[big])], _NAMES)

    found = classes.select("cid", "print", "n", "points").mapInArrow(local, MEETINGS)
    sent = found.repartition(shuffle_partitions(classes.sparkSession), F.col("point"), F.when(F.col("point").isNull(), F.col("f"))).sortWithinPartitions("point", "cid")
    return sent.mapInArrow(meet, MEETINGS)


def _buffered(batches):
    """(table as one batch, whether it is the last) of about ``BUFFER`` rows; one empty last batch at the end at least."""
    held, rows, schema = [], 0, None
    for batch in batches:
        schema = batch.schema
        held.append(batch)
        rows += len(batch)
        if rows >= BUFFER:
            yield _one(held, schema), False
            held, rows = [], 0
    if schema is not None:
        yield _one(held, schema), True


def _one(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    if not batches:
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], names=schema.names)
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0]


def _picked(links: DataFrame) -> DataFrame:
    """(a, b): of each class's links (cid, f, n), the nearest and the one to the first class."""
    both = links.select(F.col("cid").alias("x"), F.col("f").alias("y"), "n").unionByName(links.select(F.col("f").alias("x"), F.col("cid").alias("y"), "n"))
    best = both.groupBy("x").agg(F.min_by("y", F.struct("n", "y")).alias("near"), F.min("y").alias("low"))
    pairs = best.select("x", F.explode(F.array_distinct(F.array("near", "low"))).alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _blocked(classes: DataFrame, cluster: DataFrame) -> DataFrame:
    """``classes`` with ``block`` and ``slot``: runs of classes, those of a cluster side by side, of ``BLOCK`` classes and ``BLOCK_BYTES`` at most (or one larger class)."""
    rows = classes.join(cluster, "cid", "left").select("cid", "n", "print", "points", "first", F.coalesce("cluster", "cid").alias("cluster"))
    ordered = rows.repartitionByRange(shuffle_partitions(classes.sparkSession), "cluster", "cid").sortWithinPartitions("cluster", "cid")

    def number(batches):
        from pyspark import TaskContext

        block, used, room = TaskContext.get().partitionId() << 33, 0, BLOCK_BYTES
        for batch in batches:
            blocks, slots = [], []
            for n in batch.column("n").to_pylist():
                if used and (used == BLOCK or n * 8 > room):
                    block, used, room = block + 1, 0, BLOCK_BYTES
                blocks.append(block)
                slots.append(used)
                used, room = used + 1, room - n * 8
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(slots, pa.int32())], [*batch.schema.names, "block", "slot"])

    return ordered.mapInArrow(number, T.StructType([*ordered.schema.fields, T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType())]))


def _second_meetings(classes: DataFrame, comp: DataFrame, crowded: DataFrame, plan: Plan, least: Fraction) -> DataFrame:
    """(left, right, pairs, n): blocks, and which n pairs of their classes are of different components, share a point, are near on the last two lanes and of sizes that can be similar.

    ``pairs`` holds 16-bit numbers, the left slot times ``BLOCK`` plus the right one.

    A crowded point's rows of its largest component are only compared with the rest. Both
    sides are dealt into blocks of ``CROWD`` rows and every two blocks meet in a task of
    their own; a point of one component is left out.
    """
    known = classes.join(comp, "cid", "left")
    rows = known.select((F.col("block") * BLOCK + F.col("slot")).alias("cid"), "print", "n", "points", F.coalesce("component", "cid").alias("component"))
    schema = "point long, cid long, f long, component long, n int, g long, turned byte"

    told = ["cid", "f", "component", "n", "g", "turned"]

    def spread(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                own, points, turned, lane = _spread(part, plan, least)
                cid, component, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "component", "n"))
                f = lane[own].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(points), *[pa.array(x) for x in (cid[own], f[:, 0], component[own])], pa.array(n[own], pa.int32()), pa.array(f[:, 1]), pa.array(turned)], ["point", *told])

    def meet(batches):
        held, found = None, {}
        for now, last in _buffered(batches):
            rows = [c.to_numpy(zero_copy_only=False) for c in now.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            point, left, right = rows[0], rows[1], rows[2]
            new = np.concatenate(([True], (point[1:] != point[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))) if len(point) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            cut = len(point) if last else int(starts[-1]) if len(starts) else 0
            # A task's pairs of the same two blocks gather, as a bounded set of numbers for each.
            for key, code in _across(starts[starts < cut], cut, rows, plan.lane_most, least):
                found[key] = np.unique(np.concatenate((found[key], code))) if key in found else code
            if last or sum(map(len, found.values())) > BUFFER:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["left", "right", "pairs"])
                found = {}
            held = [x[cut:] for x in rows]

    points = rows.mapInArrow(spread, schema)
    crowd = crowded.select("point").distinct()
    n_crowd = crowd.count()
    plain = points
    if n_crowd:
        mark = broadcast_if_small(crowd, n_crowd)
        inside = points.join(mark, "point", "left_semi")
        tally = inside.groupBy("point", "component").agg(F.count(F.lit(1)).alias("c"))
        top = tally.groupBy("point").agg(F.sum("c").alias("every"), F.max("c").alias("top"), F.max_by("component", F.struct("c", "component")).alias("main")).filter("every > top")
        top = top.select("point", "main", F.ceil(F.col("every") / CROWD).cast("int").alias("lefts"), F.ceil((F.col("every") - F.col("top")) / CROWD).cast("int").alias("rights"))
        top = written(top, "crowded")
        mixed_rows = inside.join(broadcast_if_small(top, n_crowd), "point")
        salt = lambda k: F.pmod(F.xxhash64("cid"), F.col(k)).cast("int")
        lefts = mixed_rows.select("point", salt("lefts").alias("left"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("right"), F.lit(0).alias("side"), *told)
        rights = mixed_rows.filter("component != main").select("point", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"), salt("rights").alias("right"), F.lit(1).alias("side"), *told)
        plain = points.join(mark, "point", "left_anti")
    shaped = plain.select("point", F.lit(0).alias("left"), F.lit(-1).alias("right"), F.lit(0).alias("side"), *told)
    if n_crowd:
        shaped = shaped.unionByName(lefts).unionByName(rights)
    def unique(batches):
        for batch in batches:
            codes = [np.unique(np.frombuffer(b"".join(blobs), np.uint16)) for blobs in batch.column("pairs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([len(c) for c in codes], pa.int32())], ["left", "right", "pairs", "n"])

    dealt = shaped.repartition(shuffle_partitions(classes.sparkSession), "point", "left", "right").sortWithinPartitions("point", "left", "right", "side")
    gathered = dealt.mapInArrow(meet, "left long, right long, pairs binary").groupBy("left", "right").agg(F.collect_list("pairs").alias("pairs"))
    return gathered.mapInArrow(unique, "left long, right long, pairs binary, n int")


def _across(starts: np.ndarray, cut: int, rows: list[np.ndarray], most: int, least: Fraction):
    """Near pairs of different components, of sizes that can be similar, within each group of rows: ((left block, right block), numbers of the pairs). Rows without the columns g and turned have one lane and unturned points."""
    if not len(starts):
        return
    point, _, right, side, cid, f, comp, n, *more = rows
    g, turned = more or (np.zeros_like(f), np.zeros_like(n))
    f, n = _lanes(f, g), n.astype(np.int64)
    sizes = np.diff(np.concatenate((starts, [cut])))
    high, low = np.maximum.reduceat(comp[:cut], starts), np.minimum.reduceat(comp[:cut], starts)
    several = (sizes > 1) & (high != low)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        ok = (comp[a] != comp[b]) & _least_meeting(point[a], turned[a], turned[b])
        a, b = a[ok], b[ok]
        ok = _near(f, a, b, most) & _able(n[a], n[b], least)
        if ok.any():
            found.append((a[ok], b[ok]))

    plain = np.flatnonzero(several & (right[starts] < 0))
    for step in range(1, int(sizes[plain].max(initial=1))):
        plain = plain[sizes[plain] > step]
        count = sizes[plain] - step
        a = np.repeat(starts[plain] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        keep(a, a + step)
    for k in np.flatnonzero(several & (right[starts] >= 0)):
        own = np.arange(starts[k], starts[k] + sizes[k])
        one, other = own[side[own] == 0], own[side[own] == 1]
        for at in other:
            keep(one, np.full(len(one), at))
    if found:
        both, _ = _distinct(cid, found)
        blocks, slots = both // BLOCK, both % BLOCK
        order = np.lexsort((blocks[:, 1], blocks[:, 0]))
        blocks, code = blocks[order], (slots[:, 0] * BLOCK + slots[:, 1])[order].astype(np.uint16)
        cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]).any(axis=1), [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield (int(blocks[a, 0]), int(blocks[a, 1])), code[a:b]


def _able(n: np.ndarray, m: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether sets of n and m shingles can be as similar as ``least``."""
    return (n * least.denominator >= m * least.numerator) & (m * least.denominator >= n * least.numerator)


def _alike(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * least.denominator >= least.numerator * (len(x) + len(y) - both)


def _sets(marked: DataFrame, wanted: DataFrame, n_words: int, extra: dict[str, str]) -> DataFrame:
    """(cid, shingles) of the wanted classes (cid, first): one row stands for all of a class, so each wanted text is read once."""

    def sets(batches):
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), n_words)], pa.binary())], ["cid", "shingles"])

    rows = written(wanted.select("cid", F.col("first.row").alias(extra["row"])), "wanted")
    texts = marked.select(extra["row"], "text").join(broadcast_if_small(rows, rows.count()), extra["row"]).select("cid", "text")
    return written(texts.mapInArrow(sets, "cid long, shingles binary"), "sets")


def _verified(marked: DataFrame, classes: DataFrame, pairs: DataFrame, plan: Plan, n_words: int, least: Fraction, extra: dict[str, str]) -> DataFrame:
    """The pairs (a, b) within the complete distance, or both small, whose shingle sets are as similar as ``least``."""
    p, q = least.numerator, least.denominator

    def close(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, plan.lanes) for k in (2, 3))
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            ok = (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= plan.most) | (np.maximum(n, m) <= SMALL)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    def similar(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in zip(part.column(2), part.column(3), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, v, m: classes.select(F.col("cid").alias(c), F.col("print").alias(v), F.col("n").alias(m))
    # Sets of too different sizes cannot be similar.
    able = (F.col("na") * q >= F.col("nb") * p) & (F.col("nb") * q >= F.col("na") * p)
    near = written(pairs.join(side("a", "x", "na"), "a").join(side("b", "y", "nb"), "b").filter(able).select("a", "b", "x", "y", "na", "nb").mapInArrow(close, "a long, b long"), "near")
    wanted = classes.join(near.select(F.col("a").alias("cid")).unionByName(near.select(F.col("b").alias("cid"))).distinct(), "cid", "left_semi")
    held = _sets(marked, wanted, n_words, extra)
    whole = near.join(held.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    out = written(whole.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "links")
    drop_written(near, held)
    return out


def _numbers(batch: pa.RecordBatch):
    """(left, right, numbers of the pairs) of each row."""
    for left, right, blob in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
        yield left, right, np.frombuffer(blob, np.uint16).astype(np.int64)


def _single_pairs(met: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that block pairs (left, right, pairs) hold."""

    def each(batches):
        for batch in batches:
            for left, right, code in _numbers(batch):
                yield pa.RecordBatch.from_arrays([pa.array(left * BLOCK + code // BLOCK), pa.array(right * BLOCK + code % BLOCK)], ["x", "y"])

    at = lambda place, name: classes.select((F.col("block") * BLOCK + F.col("slot")).alias(place), F.col("cid").alias(name))
    return met.mapInArrow(each, "x long, y long").join(at("x", "p"), "x").join(at("y", "q"), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _across_blocks(marked: DataFrame, classes: DataFrame, comp: DataFrame, met: DataFrame, plan: Plan, n_words: int, least: Fraction, extra: dict[str, str]) -> DataFrame:
    """Links (a, b) among the pairs of blocks (left, right, pairs), decided like those of :func:`_verified`; as many as join the components, and between those (named by their least class)."""

    def named(batches):
        held = np.zeros(0, np.int64)
        for batch in batches:
            for left, right, code in _numbers(batch):
                held = np.unique(np.concatenate((held, left * BLOCK + code // BLOCK, right * BLOCK + code % BLOCK)))
                if len(held) > BUFFER:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["at"])
                    held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["at"])

    at = F.col("block") * BLOCK + F.col("slot")
    wanted = classes.join(met.mapInArrow(named, "at long").distinct(), at == F.col("at"), "left_semi")
    held = _sets(marked, wanted, n_words, extra)
    members = wanted.select("cid", "block", "slot", "print").join(held, "cid").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    blocks = written(members.groupBy("block").agg(F.collect_list(F.struct("slot", "component", "print", "shingles")).alias("rows")), "blocks")

    def decide(batches):
        tile, held = None, {}
        # What this task has linked already needs no more links.
        root: dict[int, int] = {}
        for batch in batches:
            for k, (one_tile, other_tile, left, right) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("tl", "tr", "left", "right")], strict=True)):
                if (one_tile, other_tile) != tile:
                    tile, held = (one_tile, other_tile), {}
                if right is None:
                    held[left] = _block_arrays(batch.column("rows")[k], plan.lanes)
                    continue
                code = np.frombuffer(batch.column("pairs")[k].as_py(), np.uint16).astype(np.int64)
                one, other = held[left], held[right]
                i, j = code // BLOCK, code % BLOCK
                n, m = one[2][i], other[2][j]
                near = (np.bitwise_count(one[1][i] ^ other[1][j]).sum(axis=1, dtype=np.int64) <= plan.most) | (np.maximum(n, m) <= SMALL)
                ok = near & _able(n, m, least)
                if len(root) > BUFFER:
                    root = {}
                found = []
                for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                    x, y = _root(root, int(one[0][a])), _root(root, int(other[0][b]))
                    if x != y and _alike(one[3][a], other[3][b], least):
                        root[max(x, y)] = min(x, y)
                        found.append((min(x, y), max(x, y)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    # A tile's blocks come first, then its block pairs, so a task holds the blocks of two tiles.
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    tiled = met.select(F.shiftright("left", TILE).alias("tl"), F.shiftright("right", TILE).alias("tr"), "left", "right", "pairs")
    needed = tiled.select("tl", "tr", F.explode(F.array("left", "right")).alias("block")).distinct()
    sent = needed.join(blocks, "block").select("tl", "tr", F.col("block").alias("left"), none("long", "right"), none("binary", "pairs"), "rows")
    both = sent.unionByName(tiled.withColumn("rows", F.lit(None).cast(blocks.schema["rows"].dataType)))
    dealt = both.repartition(shuffle_partitions(marked.sparkSession), "tl", "tr").sortWithinPartitions("tl", "tr", "right")
    out = written(dealt.mapInArrow(decide, "a long, b long"), "links")
    drop_written(held, blocks)
    return out


def _root(parents: dict[int, int], x: int) -> int:
    while (up := parents.get(x, x)) != x:
        parents[x] = parents.get(up, up)
        x = up
    return x


def _block_arrays(rows, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """By slot: component, fingerprint, set size, and the sets."""
    component, prints, n, sets = np.zeros(BLOCK, np.int64), np.zeros((BLOCK, lanes), np.uint64), np.zeros(BLOCK, np.int64), {}
    for slot, own, fp, shingles in zip(*[rows.values.field(k) for k in range(4)], strict=True):
        k = slot.as_py()
        sets[k] = np.frombuffer(shingles.as_buffer(), np.uint64)
        component[k], prints[k], n[k] = own.as_py(), np.frombuffer(fp.as_buffer(), np.uint64), len(sets[k])
    return component, prints, n, sets


def _order(doc_id: Column, row: Column) -> Column:
    """Smallest first: documents with an id by it, then those without, then by row."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), row.alias("row"))


def _grouped(docs: DataFrame, n_words: int, least: Fraction, recall: float) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(marked rows, classes with their component, names of the added columns); all written, by Arrow batches of ``BATCH_ROWS`` and ``BATCH_BYTES`` at most."""
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}):
        return _groups(docs, n_words, least, recall)


def _groups(docs: DataFrame, n_words: int, least: Fraction, recall: float) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    names = list(docs.columns)
    extra = {}
    for k in ("row", "digest", "n", "print"):
        extra[k] = free_name(f"_{k}", names)
        names.append(extra[k])
    plan = plan_search(docs.count(), least, recall)
    marked = written(_marked(docs, plan, n_words, extra), "marked")
    first = F.min(_order(F.col("doc_id").cast("long"), F.col(extra["row"])))
    grouped = marked.groupBy(F.col(extra["digest"]).alias("digest")).agg(first.alias("first"), F.first(extra["n"]).alias("n"), F.first(extra["print"]).alias("print"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    search = classes.filter("n > 0")
    pointed, rare = _rarest(marked, search, n_words, least, extra)
    met = written(_first_meetings(pointed, plan, least), "met")
    pairs = written(_picked(met.filter("point is null")), "pairs")
    links = _verified(marked, search, pairs, plan, n_words, least, extra)
    member = components(links)
    comp = lambda: member.select(F.col("node").alias("cid"), "component")
    cluster = components(pairs).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    blocked = written(_blocked(pointed, cluster), "blocked")
    more = written(_second_meetings(blocked, comp(), met.filter("cid is null"), plan, least), "blockpairs")
    found = []
    for part, decide in ((more.filter(F.col("n") > DENSE), lambda p: _across_blocks(marked, blocked, comp(), p, plan, n_words, least, extra)), (more.filter(F.col("n") <= DENSE), lambda p: _verified(marked, search, _single_pairs(p, blocked), plan, n_words, least, extra))):
        if not part.isEmpty():
            found.append(decide(part))
    if found:
        again = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        if not again.isEmpty():
            stars = member.select(F.col("node").alias("a"), F.col("component").alias("b"))
            member = components(stars.unionByName(again))
        drop_written(*found)
    drop_written(met, pairs, more, links, blocked, *rare)
    classes = classes.join(comp(), "cid", "left").select("digest", "first", F.coalesce("component", "cid").alias("component"))
    return marked, classes, extra


def near_groups(docs: DataFrame, n_words: int = 5, least: Fraction = Fraction(4, 5), recall: float = 0.98) -> DataFrame:
    """One row per document: doc_id, component_id, the smallest doc_id reachable by links of similarity ``least`` and above.

    Similarity is Jaccard's of the sets of ``n_words``-word shingles (64-bit hashes), A-Z
    lower-cased; a shorter text is one shingle. Every link is decided on the whole sets, so none
    lies below ``least``; of the pairs at ``least`` itself about ``recall`` meet in a segment, of
    more similar ones more, and of pairs whose smaller set has up to 19 shingles all. Texts of equal
    sets, and those without words, null ones too, are one class. A null doc_id takes part and
    names a component only when no other id is in it (then null). Repeated rows are in one
    class. An empty table gives no rows; extra columns are ignored.
    """
    marked, classes, extra = _grouped(docs.select("doc_id", "text"), n_words, least, recall)
    least_id = classes.groupBy("component").agg(F.min("first").alias("best"))
    named = classes.join(least_id, "component").select(F.col("digest").alias(extra["digest"]), F.col("best.doc_id").alias("component_id"))
    return marked.join(named, extra["digest"]).select(F.col("doc_id").cast("long").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, n_words: int = 5, least: Fraction = Fraction(4, 5), recall: float = 0.98) -> DataFrame:
    """One row of each group of :func:`near_groups`, with all columns of ``docs``: that of the smallest doc_id.

    Rows are told apart by an own number, so rows that share a doc_id are judged each by its
    own text; of repeated rows one stays. Columns may have any names.
    """
    marked, classes, extra = _grouped(docs, n_words, least, recall)
    best = classes.groupBy("component").agg(F.min("first").alias("best")).select(F.col("best.row").alias(extra["row"]))
    return marked.join(best, extra["row"], "left_semi").drop(*extra.values())
