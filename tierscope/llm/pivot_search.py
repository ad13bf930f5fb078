"""Operator 12: exact top-k search by inner product, by pivot-table elimination.

Every vector gets its distances to a few dozen pivots once. For a query q and a candidate c
the largest |d(q, p) - d(c, p)| over the pivots p is a lower bound of d(q, c), and since
2 q.c = |q|^2 + |c|^2 - d(q, c)^2 it is an upper bound of the score. A query is sent only to
the cells (vectors by nearest pivot) whose bound reaches the score that it has already; inside
a block of candidates it takes them in the order of their bounds and stops at the first bound
below its k-th score, so nothing that could be in the result is left out.

Defined cases: rows without an id, and vectors that are null or hold a null, NaN or infinite
component, take no part; an empty table gives an empty result; a shorter vector counts as
filled up with zeros. Repeated rows are rows of their own: a query's own row is left out, other
rows with its id are candidates. Ties go to the smaller id. Scores are exact as long as they
fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Bounds on what one task or the driver holds: pivots, rows of the sample that they are chosen from, rows of a block of candidates and of queries.
PIVOTS, SAMPLE, CANDIDATES, QUERIES = 48, 2048, 4096, 1024

_TABLE = "row long, id long, v binary, d binary, norm long, near int, query boolean, least long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale x component) of the vectors that take part."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("_v"), ok.alias("_ok")).filter("id is not null and _ok")
    return rows.select("id", F.transform("_v", lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` integers, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows of the sample, each the one farthest from those before."""
    if not len(sample):
        return sample
    x = sample.astype(np.float64)
    norms = (x * x).sum(1)
    at, far = [int(norms.argmax())], np.full(len(x), np.inf)
    while len(at) < n:
        far = np.minimum(far, norms + norms[at[-1]] - 2 * x @ x[at[-1]])
        if far.max() <= 0:
            break
        at.append(int(far.argmax()))
    return sample[at]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)).astype(np.float32)


def _scores(a: np.ndarray, b: np.ndarray, exact_float: bool) -> np.ndarray:
    """Inner products as integers: BLAS on doubles as long as every partial sum is exact in one."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact_float else a.astype(np.int64) @ b.astype(np.int64).T


def search_block(q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int, margin: float, exact_float: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """(query, query_id, row, id, score): for each query, at most ``k`` rows of the block that its result may hold."""
    wide = c["v"].astype(np.float64 if exact_float else np.int64)
    for at in range(len(q["row"])):
        low = np.maximum(np.abs(c["d"] - q["d"][at]).max(1).astype(np.float64) - margin, 0)
        bound = (q["norm"][at] + c["norm"] - low * low) / 2
        bound += 1 + 1e-9 * np.abs(bound)
        least = int(q["least"][at])
        alive = np.flatnonzero((bound >= least) & (c["row"] != q["row"][at]))
        order = alive[np.argsort(-bound[alive], kind="stable")]
        own, done, step = q["v"][at].astype(wide.dtype), 0, 64
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while done < len(order) and bound[order[done]] >= least:
            take = order[done : done + step]
            best_s, best_i = np.concatenate([best_s, (wide[take] @ own).astype(np.int64)]), np.concatenate([best_i, take])
            first = np.lexsort((c["row"][best_i], c["id"][best_i], -best_s))[:k]
            best_s, best_i = best_s[first], best_i[first]
            if len(best_s) == k:
                least = max(least, int(best_s[-1]))
            done, step = done + step, step * 2
        for s, i in zip(best_s.tolist(), best_i.tolist(), strict=True):
            if s >= least:
                yield int(q["row"][at]), int(q["id"][at]), int(c["row"][i]), int(c["id"][i]), s


def _unpacked(df: pd.DataFrame, dims: int, dtype: str, pivots: int) -> dict[str, np.ndarray]:
    return {
        "row": df["row"].to_numpy(np.int64), "id": df["id"].to_numpy(np.int64), "norm": df["norm"].to_numpy(np.int64), "least": df["least"].to_numpy(np.int64),
        "v": np.frombuffer(b"".join(df["v"]), dtype).reshape(len(df), dims), "d": np.frombuffer(b"".join(df["d"]), np.float32).reshape(len(df), pivots),
    }


def _lookup(values: dict[int, int], key: Column) -> Column:
    """The value of a key from a table of a row for each pivot; null without."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key) if values else F.lit(None).cast("int")


def nearest(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of every query row with all other rows.

    ``is_query`` is a condition on the column ``id``.
    """
    base = quantised(vectors, id_col, vec_col, scale)
    facts = base.agg(F.max(F.size("v")).alias("dims"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    dims, most = max(facts["dims"] or 1, 1), facts["most"] or 0
    exact_float = dims * most * most < 1 << 52
    dtype = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "int64"
    # The sample is bounded: pivots come from it, and its k-th score is where every query starts.
    chosen = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample, sample_ids = _matrix(chosen["v"], dims) if chosen.num_rows else np.zeros((0, dims), np.int64), chosen["id"].to_numpy()
    corners = _spread(sample, pivots) if exact_float and len(sample) else np.zeros((1, dims), np.int64)
    n_pivots = len(corners)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, ids, query = _matrix(batch["v"], dims), batch["id"].to_numpy(), batch["query"].to_numpy(zero_copy_only=False)
            d = _distances(x, corners)
            least = np.full(n, np.iinfo(np.int64).min)
            asked = np.flatnonzero(query)
            if len(asked):
                s = _scores(x[asked], sample, exact_float)
                s[ids[asked][:, None] == sample_ids[None, :]] = np.iinfo(np.int64).min  # at least the query's own row
                if len(sample) > k:
                    least[asked] = np.partition(s, -k, axis=1)[:, -k]
            small = x.astype(dtype)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch["id"], pa.array([r.tobytes() for r in small], pa.binary()), pa.array([r.tobytes() for r in d], pa.binary()), pa.array((x * x).sum(1)), pa.array(d.argmin(1).astype(np.int32)), batch["query"], pa.array(least)],
                names=["row", "id", "v", "d", "norm", "near", "query", "least"],
            )
            row += n

    table = written(base.withColumn("query", F.coalesce(is_query, F.lit(False))).mapInArrow(measured, _TABLE), "pivot-table")
    margin = 1e-6 * float(max(2.0, 2.0 * most * dims**0.5))

    # The cells: a row for each pivot, so small whatever the number of vectors.
    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((n_pivots, n_pivots), np.inf, np.float32), np.full((n_pivots, n_pivots), -np.inf, np.float32)
        norms, counts = np.zeros(n_pivots, np.int64), np.zeros(n_pivots, np.int64)
        for batch in batches:
            if batch.num_rows:
                d, near = np.frombuffer(b"".join(batch["d"].to_pylist()), np.float32).reshape(-1, n_pivots), batch["near"].to_numpy()
                np.minimum.at(low, near, d), np.maximum.at(high, near, d)
                np.maximum.at(norms, near, batch["norm"].to_numpy()), np.add.at(counts, near, 1)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(low[seen].tolist(), pa.list_(pa.float32())), pa.array(high[seen].tolist(), pa.list_(pa.float32())), pa.array(norms[seen]), pa.array(counts[seen])], names=["near", "low", "high", "norm", "n"])

    parts = table.select("near", "d", "norm").mapInArrow(extremes, "near int, low array<float>, high array<float>, norm long, n long")
    merged = parts.groupBy("near").agg(*[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(n_pivots)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(n_pivots)], F.max("norm").alias("norm"), F.sum("n").alias("n")).collect()
    cells = np.array([r["near"] for r in merged], np.int32)
    lows, highs = (np.array([[r[f"{side}{i}"] for i in range(n_pivots)] for r in merged], np.float64).reshape(len(merged), n_pivots) for side in "lh")
    cell_norm = np.array([r["norm"] for r in merged], np.float64)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the cells whose bound reaches their k-th score so far."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            d = np.frombuffer(b"".join(batch["d"].to_pylist()), np.float32).reshape(n, n_pivots).astype(np.float64)
            out = []
            for own, norm, least in zip(d, batch["norm"].to_numpy(), batch["least"].to_numpy(), strict=True):
                gap = np.maximum(np.maximum(lows - own, own - highs).max(1) - margin, 0)
                bound = (norm + cell_norm - gap * gap) / 2
                out.append(cells[bound + 1 + 1e-9 * np.abs(bound) >= least].tolist())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("row", "id", "v", "d", "norm", "least")], pa.array(out, pa.list_(pa.int32()))], names=["row", "id", "v", "d", "norm", "least", "cells"])

    asked = table.filter("query").select("row", "id", "v", "d", "norm", "least").mapInArrow(routed, "row long, id long, v binary, d binary, norm long, least long, cells array<int>")
    asked = written(asked, "routed")
    wanted = {r["near"]: r["n"] for r in asked.select(F.explode("cells").alias("near")).groupBy("near").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = {r["near"]: -(-r["n"] // CANDIDATES) for r in merged if r["near"] in wanted}
    chunks = {c: -(-n // QUERIES) for c, n in wanted.items()}
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ["near", "salt", "chunk"]
    q = asked.select("*", F.explode("cells").alias("near")).drop("cells")
    q = q.withColumn("chunk", F.pmod(F.xxhash64("row"), _lookup(chunks, F.col("near"))).cast("int")).select("*", each(_lookup(salts, F.col("near"))).alias("salt"))
    c = table.select("row", "id", "v", "d", "norm", "least", "near").filter(F.col("near").isin(*wanted) if wanted else F.lit(False))
    c = c.withColumn("salt", F.pmod(F.xxhash64("row"), _lookup(salts, F.col("near"))).cast("int")).select("*", each(_lookup(chunks, F.col("near"))).alias("chunk"))

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asking) and len(there):
            found = list(search_block(_unpacked(asking, dims, dtype, n_pivots), _unpacked(there, dims, dtype, n_pivots), k, margin, exact_float))
        return pd.DataFrame(found, columns=["query", "query_id", "row", "id", "score"], dtype="int64")

    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(meet, "query long, query_id long, row long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    top = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
