"""Shards of equal row counts along a Hilbert curve over document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ordered_places, skew_join, written


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer coordinates of ``bits`` bits each.

    Walks the levels from the coarsest: the coordinates' bits at a level name a sub-cube,
    seen in the frame (entry corner, axis) of its parent; its rank along the Gray code gives
    the next digits and the frame of the level below.
    """
    n = len(dims)
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    rank = [gray.index(g) for g in range(1 << n)]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # noqa: E731  trailing ones of i
    axis = [0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n for i in range(1 << n)]
    array = lambda v: F.array(*[F.lit(x) for x in v])
    turn = lambda x, by: F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftright", x, F.lit(n) - by)).bitwiseAND(F.lit(full))

    def step(acc: Column, level: Column) -> Column:
        corner = F.lit(0)
        for k, d in enumerate(dims):
            corner = corner.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", d.cast("int"), level).bitwiseAND(F.lit(1)), F.lit(k)))
        by = acc["d"] + 1
        seen = turn(corner.bitwiseXOR(acc["e"]), F.lit(n) - by % n)
        digit = F.element_at(array(rank), seen + 1)
        return F.struct(acc["e"].bitwiseXOR(turn(F.element_at(array(entry), digit + 1), by % n)).alias("e"), ((acc["d"] + F.element_at(array(axis), digit + 1) + 1) % n).alias("d"), F.call_function("shiftleft", acc["h"], F.lit(n)).bitwiseOR(digit.cast("long")).alias("h"))

    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    levels = F.array(*[F.lit(b) for b in reversed(range(bits))])
    return F.aggregate(levels, start, step, lambda acc: acc["h"])


def hilbert_order(rows: DataFrame, dims: list[str], bits: int = 5) -> DataFrame:
    """``rows`` with ``curve``: each dimension has 2**bits cells, nulls lowest.

    A value's cell is the place of its rows' middle among all rows in order of the value, so
    every dimension spans the grid however few values it has, and whole strings count.
    """
    total = rows.count()
    cells = []
    for k, d in enumerate(dims):
        tally = ordered_places(rows.groupBy(d).agg(F.count(F.lit(1)).alias(f"_n{k}")), [d], f"_n{k}")
        cell = F.call_function("div", (F.col("before") * 2 + F.col(f"_n{k}")) * (1 << bits), F.lit(2 * max(total, 1)).cast("long")).cast("int")
        values = written(tally.select(d, f"_n{k}", cell.alias(f"_g{k}")), "cells")
        keyed = values.select(F.col(d).alias(f"_d{k}"), f"_n{k}", f"_g{k}")
        n_values = values.count()
        if n_values <= 500_000:
            rows = rows.join(F.broadcast(keyed), F.col(d).eqNullSafe(F.col(f"_d{k}")))
        else:  # many values: a hot one, and null, is broadcast all the same
            known = skew_join(rows.filter(F.col(d).isNotNull()).withColumn(f"_d{k}", F.col(d)), keyed.filter(F.col(f"_d{k}").isNotNull()), [f"_d{k}"], f"_n{k}")
            rows = known.unionByName(rows.filter(F.col(d).isNull()).join(F.broadcast(keyed.filter(F.col(f"_d{k}").isNull())), F.lit(True)).select(*known.columns))
        rows = rows.drop(f"_d{k}", f"_n{k}")
        cells.append(f"_g{k}")
    return rows.withColumn("curve", hilbert_index([F.col(c) for c in cells], bits)).drop(*cells)


def hilbert_shards(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source"), n_shards: int = 40, bits: int = 5) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ``rows``, shard, slot, grown_shard null, curve.

    The curve runs over ``dims`` and the size. Rows of equal text share the smallest value of
    each dimension in their group, so they are neighbours on the curve; then the text's hash
    and doc_id decide. Shards are runs of the curve whose row counts differ by one at most;
    slots run from 0. Null text has no bytes (size 16) and crc32 0; null metadata sorts first; repeated rows
    take neighbouring slots; an empty table gives no rows; missing dims are skipped, extra columns ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    dims = [d for d in dims if d in docs.columns]
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash"), *[F.col(d).alias(f"dim_{d}") for d in dims]), "meta")
    group = ["size", "text_crc32", "hash"]
    if dims:
        shared = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("copies"), *[F.min(f"dim_{d}").alias(f"dim_{d}") for d in dims])
        rows = written(skew_join(rows.select("doc_id", *group), shared, group, "copies").drop("copies"), "shared")
    ordered = hilbert_order(rows, [*[f"dim_{d}" for d in dims], "size"], bits)
    placed = ordered_places(ordered.select("doc_id", "size", "text_crc32", "hash", "curve"), ["curve", "size", "text_crc32", "hash", "doc_id"])
    n = F.lit(max(rows.count(), 1)).cast("long")
    shard = F.call_function("div", F.col("before") * n_shards, n)
    first = F.call_function("div", F.col("shard").cast("long") * n + (n_shards - 1), F.lit(n_shards).cast("long"))
    return placed.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """Write whole documents (unique doc_id), one folder for each shard, sorted so that file statistics prune on every dimension."""
    shards = shards.select("doc_id", "shard", "slot")
    docs.join(shards, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
