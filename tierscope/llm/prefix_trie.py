"""Operator 13: the prefix trie of conversations, by union-find over sorted neighbours.

A conversation is a row of turn digests (16 bytes of SHA-256 over role and text). Equal
conversations are contracted first; the different ones are sorted over all partitions. The edge
between two neighbours has the number of turns that they share. Taking edges in falling depth,
union-find joins runs of neighbours: what is joined at depth d are exactly the conversations
below one node of depth d, so each merge is a branching node and the turns between two merges
of a run are its unary nodes.

Each partition builds its own forest. Whatever shares turns with a neighbouring partition stays
open and is passed on as sums (two borders a partition); a second pass merges equal open nodes
across borders and completes their sums from the deepest up.

Defined cases: rows without a conversation id take no part; null role or text is empty; a null
turn comes first, turns that share a place are in the order of their digests; a conversation
may have no turns and then ends at the root; an empty table has no nodes, not even a root.
A task holds one conversation's digests, and the borders' open nodes meet in one task; their
number follows the partitions and the turns shared across borders, not the conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, shuffle_partitions, written

WIDTH = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_PARTS = "open boolean, key binary, parent_key binary, width long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, t): each conversation's turns in order, as structs of place, digest and code points. Texts stay where they are."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH)
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.length(text).cast("long").alias("n")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("t"))


def rebuilt(turns: DataFrame, step: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, t): the first h turns of conversation c - c % step, then c's own turns after its first h; h = crc32(c) % most."""
    own, c, h = ordered_turns(turns), F.col("conv_id"), F.col("_h")
    bases = own.filter(c % step == 0).select(c.alias("_base"), F.slice("t", F.lit(1), F.lit(max(most - 1, 1))).alias("_head"))
    joined = own.select("*", (c - c % step).alias("_base"), (F.crc32(c.cast("string").cast("binary")) % most).cast("int").alias("_h")).join(bases, "_base", "left")
    first = F.slice(F.coalesce("_head", F.slice("t", F.lit(1), F.lit(0))), F.lit(1), h)
    rest = F.slice("t", h + 1, F.greatest(F.size("t") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(first, rest).alias("t"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, n, least, ends): a row for each run of equal conversations; ids stream through the digest one batch at a time."""
    key, digest, n, least = None, None, 0, 0
    schema = pa.schema([("same", pa.string()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    for batch in batches:
        done, keys, ids = [], batch["same"].to_pylist(), batch["conv_id"].to_pylist()
        at = 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            told = ",".join(map(str, ids[at:to])).encode()
            if keys[at] == key:
                digest.update(b"," + told)
                n += to - at
            else:
                if key is not None:
                    done.append((key, n, least, digest.hexdigest()))
                key, digest, n, least = keys[at], hashlib.sha256(told), to - at, ids[at]
            at = to
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((key, n, least, digest.hexdigest()), schema.types, strict=True)], schema=schema)


def shared_turns(a: bytes, b: bytes) -> int:
    return len(commonprefix([a, b])) // WIDTH


@dataclass
class _Run:
    """A component: conversations side by side that share the node at depth ``top``, whose sums these are."""

    top: int
    like: int
    n: int = 0
    least: int | None = None
    leaves: int = 0
    saved: int = 0
    children: int = 0
    ends: str | None = None
    open: bool = False
    below: list = field(default_factory=list)


def forest(keys: list[bytes], widths: list, copies: list[int], least: list[int], ends: list[str], left: int, right: int) -> Iterator[tuple]:
    """Rows of ``_PARTS`` for one partition's different conversations in order.

    ``left`` and ``right``: turns shared with the neighbours beyond the partition's borders, -1
    without a neighbour. Nodes of shared turns come out as open parts, all others whole; a
    whole node below an open one names its parent by key.
    """
    m = len(keys)
    runs = [_Run(len(k) // WIDTH, i, copies[i], least[i], ends=ends[i]) for i, k in enumerate(keys)]
    runs += [_Run(left, 0, open=True), _Run(right, m - 1, open=True)]
    named: dict[int, list[bytes]] = {}
    for i, depth in ((0, left), (m - 1, right)):
        h, names = hashlib.blake2b(digest_size=WIDTH), []
        for d in range(depth + 1):
            names.append(h.copy().digest())
            h.update(keys[i][d * WIDTH : (d + 1) * WIDTH])
        named[i] = max(named.get(i, []), names, key=len)
    out: list[tuple] = []
    root = list(range(m + 2))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def raised(run: _Run, depth: int) -> None:
        """Complete the nodes of ``run`` that lie deeper than ``depth``."""
        while run.top > depth:
            width = int(widths[run.like][run.top - 1]) if run.top else 0
            if run.open:
                key, up = named[run.like][run.top], named[run.like][run.top - 1] if run.top else None
                out.extend((False, None, key, None, *node[:2], None, *node[2:]) for node in run.below)
                out.append((True, key, up, width, run.least, run.top, None, run.n, run.children, run.leaves, run.saved, run.ends))
                run.n, run.least, run.leaves, run.saved, run.children, run.below = 0, None, 0, 0, 0, []
            else:
                out.extend((False, None, None, None, *node[:2], run.least, *node[2:]) for node in run.below)
                run.leaves, run.saved = run.leaves if run.children else 1, run.saved + (run.n - 1) * width
                run.below = [(run.least, run.top, run.n, run.children, run.leaves, run.saved, run.ends or _EMPTY)]
                run.children = 1
            run.ends, run.top = None, run.top - 1

    edges = [(shared_turns(keys[i - 1], keys[i]), i - 1, i) for i in range(1, m)]
    edges += [(left, m, 0)] * (left >= 0) + [(right, m - 1, m + 1)] * (right >= 0)
    for depth, i, j in sorted(edges, key=lambda e: -e[0]):
        i, j = find(i), find(j)
        raised(runs[i], depth), raised(runs[j], depth)
        if len(runs[i].below) < len(runs[j].below):
            i, j = j, i
        a, b = runs[i], runs[j]
        root[j] = i
        if b.open and not a.open:
            a.like = b.like
        a.n, a.leaves, a.saved, a.children, a.open = a.n + b.n, a.leaves + b.leaves, a.saved + b.saved, a.children + b.children, a.open or b.open
        a.least = b.least if a.least is None else a.least if b.least is None else min(a.least, b.least)
        a.ends = a.ends or b.ends
        a.below.extend(b.below)
        b.below = []
    last = runs[find(0)]
    raised(last, -1)
    out.extend((False, None, None, None, *node[:2], None, *node[2:]) for node in last.below if not last.open)
    yield from out


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """Open nodes, each with its sums over all partitions: children are added to their parents from the deepest up."""
    rows = {r.key: r for r in parts.itertuples(index=False)}
    own = {k: [None if pd.isna(r.conv_id) else int(r.conv_id), int(r.n_convs), int(r.n_children), int(r.n_leaves), int(r.saved_tokens)] for k, r in rows.items()}
    for key in sorted(rows, key=lambda k: -rows[k].depth):
        r, s = rows[key], own[key]
        s[4] += (s[1] - 1) * int(r.width)
        if r.parent_key is not None:
            up = own[r.parent_key]
            up[0] = s[0] if up[0] is None else min(up[0], s[0])
            up[1], up[2], up[3], up[4] = up[1] + s[1], up[2] + 1, up[3] + s[3], up[4] + s[4]
    found = [(k, own[k][0], r.depth, None if r.parent_key is None else own[r.parent_key][0], *own[k][1:], r.ends_sha256 or _EMPTY) for k, r in rows.items()]
    return pd.DataFrame(found, columns=["key", *_NODE]).astype({"parent_conv_id": "Int64"})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, t): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    blob = F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), ""))
    whole = conversations.select("conv_id", blob.alias("blob"), F.transform("t", lambda x: x["n"]).alias("widths"))
    whole = written(whole.withColumn("same", F.sha2("blob", 256)), "conversations")
    # Of a large group of copies only ids travel; its one blob is pre-aggregated where it lies.
    ends = whole.select("same", "conv_id").repartition(shuffle_partitions(spark), "same").sortWithinPartitions("same", "conv_id").mapInArrow(_ends, "same string, n long, least long, ends string")
    different = whole.groupBy("same").agg(F.first("blob").alias("blob"), F.first("widths").alias("widths")).join(ends, "same")
    placed = different.select("blob", "widths", "n", "least", "ends").repartitionByRange(shuffle_partitions(spark), "blob").sortWithinPartitions("blob")
    placed = written(placed.withColumn("part", F.spark_partition_id()), "ordered")

    def borders(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        first, last = rows["first"].tolist(), rows["last"].tolist()
        shared = [shared_turns(last[i - 1], first[i]) for i in range(1, len(rows))]
        return pd.DataFrame({"part": rows["part"].to_numpy(), "left": [-1, *shared], "right": [*shared, -1]})

    ranges = placed.groupBy("part").agg(F.min("blob").alias("first"), F.max("blob").alias("last"))  # a row for each partition
    shared = ranges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(borders, "part int, left int, right int")

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("blob")
        made = forest(rows["blob"].tolist(), rows["widths"].tolist(), rows["n"].tolist(), rows["least"].tolist(), rows["ends"].tolist(), int(rows["left"].iloc[0]), int(rows["right"].iloc[0]))
        out = pd.DataFrame(made, columns=[c.split()[0] for c in _PARTS.split(", ")])
        return out.astype({c: "Int64" for c in ("width", "conv_id", "parent_conv_id")})

    parts = written(placed.join(F.broadcast(shared), "part").groupBy("part").applyInPandas(grown, _PARTS), "forests")
    sums = parts.filter("open").groupBy("key", "parent_key", "depth", "width").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"))
    across = written(sums.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_merged, "key binary, " + ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in _NODE)), "borders")
    inner = parts.filter("not open and parent_key is null").select(_NODE)
    up = across.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    under = parts.filter("not open and parent_key is not null").drop("key", "parent_conv_id").join(broadcast_if_small(up, across.count()), "parent_key").withColumnRenamed("_up", "parent_conv_id").select(_NODE)
    return inner.unionByName(under).unionByName(across.select(_NODE))
