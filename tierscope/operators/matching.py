"""Greedy matching of two groups of rows along a score, without replacement, in ranges of the score.

Low rows take, in order of (score, id), the nearest free high row. What a low row leaves to the
next one is little: behind it the free high rows are a stack, since only the nearest can be
taken, and ahead of it the taken ones are an unbroken run. So a range of rows needs of all rows
before it only where that run ends and the top of the stack, no deeper than its own number of
low rows. All ranges are matched at once from a guess of what enters them, and those whose guess
was wrong again, until nothing that enters a range changes: then it is the sequential result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written

_CARRIED, _OWN, _AHEAD = 0, 1, 2
_PAIR, _LEFT, _END = 0, 1, 2
_OUT = "part int, kind int, place long, score double, n long, pops long, digest long"


def _placed(rows: DataFrame, by: list[str], parts: int) -> tuple[DataFrame, list[int]]:
    """``rows``, written, with ``part`` and ``place`` in the order of ``by``, and the first place of each part."""
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = written(ranged.withColumn("_at", at).withColumn("part", F.spark_partition_id()), "placed")
    counts = dict(table.groupBy("part").count().collect())
    starts = [0] * (parts + 1)
    for p in range(parts):
        starts[p + 1] = starts[p] + counts.get(p, 0)
    small = rows.sparkSession.createDataFrame(list(enumerate(starts)), "part int, _start long")
    return table.join(F.broadcast(small), "part").withColumn("place", F.col("_start") + F.col("_at")).drop("_start", "_at"), starts


def _matcher(entering: dict[int, int], ends: dict[int, int], max_gap: float):
    """One range: its pairs (low place, score taken), the high rows that it leaves free, and how it ends."""

    def match(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        group = group.sort_values(["role", "place"])
        carried, own = group[group.role == _CARRIED], group[group.role == _OWN]
        rights = group[group.high & (group.role != _CARRIED) & (group.place >= entering[part])]
        right_place, right_score = rights.place.tolist(), rights.score.tolist()
        behind, n_behind = carried.score.tolist(), len(carried)
        stack: list[tuple[int, float]] = []
        taken, r = entering[part], 0
        out = []
        for place, score, high in zip(own.place.tolist(), own.score.tolist(), own.high.tolist(), strict=True):
            if high:
                if place >= taken:
                    stack.append((place, score))
                    taken, r = place + 1, r + 1
                continue
            a = stack[-1][1] if stack else behind[n_behind - 1] if n_behind else None
            b = right_score[r] if r < len(right_score) else None
            left = a is not None and (b is None or score - a <= b - score)
            best = a if left else b
            if best is None or abs(best - score) > max_gap:
                continue
            out.append((place, best))
            if not left:
                taken, r = right_place[r] + 1, r + 1
            elif stack:
                stack.pop()
            else:
                n_behind -= 1
        digest = int.from_bytes(hashlib.blake2b(np.array([p for p, _ in stack], np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)
        rows = [(part, _PAIR, p, s, 0, 0, 0) for p, s in out] + [(part, _LEFT, p, s, n, 0, 0) for n, (p, s) in enumerate(stack)]
        rows.append((part, _END, max(taken, ends[part]), 0.0, len(stack), len(carried) - n_behind, digest))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return match


class _Ranges:
    """What the driver knows: a few numbers for each range, none for a row."""

    def __init__(self, placed: DataFrame, starts: list[int], max_gap: float):
        facts = placed.groupBy("part").agg(F.count_if("high").alias("high"), F.count_if(~F.col("high")).alias("low"), F.min("score").alias("least"), F.max("score").alias("most")).collect()
        self.of = {r.part: r for r in facts}
        self.parts = sorted(self.of)
        self.starts, self.max_gap = starts, max_gap
        self.ended: dict[int, tuple[int, int, int, int]] = {}  # part: taken up to, free rows left, pops of the carried stack, digest of the free rows

    def entering(self) -> dict[int, tuple]:
        """part: (taken up to, slices (part, from, to, digest) of free rows of earlier ranges, the top last)."""
        out: dict[int, tuple] = {}
        taken, stack = 0, []
        for p in self.parts:
            need, slices = self.of[p].low, []
            for q, lo, hi, digest in reversed(stack):
                if need <= 0 or self.of[q].most < self.of[p].least - self.max_gap:
                    break
                slices.append((q, max(lo, hi - need), hi, digest))
                need -= hi - lo
            out[p] = (max(taken, self.starts[p]), tuple(slices))
            end, left, pops, digest = self.ended.get(p, (0, 0, 0, 0))
            while pops > 0 and stack:
                q, lo, hi, d = stack.pop()
                if hi - lo > pops:
                    stack.append((q, lo, hi - pops, d))
                pops -= hi - lo
            if left:
                stack.append((p, 0, left, digest))
            taken = max(taken, end)
        return out

    def ahead(self, part: int, taken: int) -> list[int]:
        """Later ranges that hold the next high rows a range may need: as many as it has low rows."""
        need, out = self.of[part].low, []
        for q in self.parts[self.parts.index(part) + 1 :]:
            if need <= 0 or self.of[q].least > self.of[part].most + self.max_gap:
                break
            if self.starts[q + 1] > taken:
                out.append(q)
                need -= self.of[q].high if self.starts[q] >= taken else 0
        return out


def greedy_pairs(df: DataFrame, id_col: str, high: str, carry: list[str], max_gap: float, size: int = 250_000) -> DataFrame:
    """(low_id, high_id, low_ and high_ of ``carry``, low_score, score_gap, low_place) of the greedy matching of ``df``.

    ``high`` names a boolean column, ``score`` holds the score; rows without one (null or NaN), id or side take no
    part. Of high rows at equal distance the lower score wins, of equal scores the smaller id. Repeated ids are rows
    of their own. ``size`` is the number of rows of a range: a task holds its range and as many rows again from before
    and after it, whatever the scores' distribution. Rounds are few where low rows crowd or ranges are wider
    than the gap, and no more than there are ranges.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), (F.col("score").cast("double") + F.lit(0.0)).alias("score"), F.col(high).alias("high"), *carry)
    rows = written(rows.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("high").isNotNull() & F.col("id").isNotNull()), "match-rows")
    placed, starts = _placed(rows, ["score", "high", "id", *carry], max(1, math.ceil(rows.count() / size)))
    pairs = _matched(spark, placed, _Ranges(placed, starts, max_gap), max_gap)
    # Equal scores are one heap of high rows so far; the first of its takers gets the smallest id.
    ordered, _ = _placed(pairs, ["score", "low_place"], max(1, math.ceil(pairs.count() / size)))
    heap = placed.filter("high").groupBy("score").agg(F.min("place").alias("_first"))
    shift = ordered.groupBy("score").agg(F.min("place").alias("_pair")).join(heap, "score").select("score", (F.col("_first") - F.col("_pair")).alias("_shift"))
    told = ordered.join(shift, "score").select("low_place", (F.col("place") + F.col("_shift")).alias("high_place"))
    side = lambda s: placed.select(F.col("place").alias(f"{s}_place"), F.col("id").alias(f"{s}_id"), F.col("score").alias(f"{s}_score"), *[F.col(c).alias(f"{s}_{c}") for c in carry])
    out = told.join(side("low"), "low_place").join(side("high"), "high_place")
    return out.select("low_id", "high_id", *[f"{s}_{c}" for c in carry for s in ("low", "high")], "low_score", F.abs(F.col("high_score") - F.col("low_score")).alias("score_gap"), "low_place")


def _matched(spark: SparkSession, placed: DataFrame, ranges: _Ranges, max_gap: float) -> DataFrame:
    """(low_place, score): the score of the high row that each matched low row takes."""
    shape = "part int, to int, role int, first long, last long"
    rounds: list[DataFrame] = []
    last: dict[int, int] = {}
    seen: dict[int, tuple] = {}
    while True:
        now = ranges.entering()
        todo = [p for p in ranges.parts if seen.get(p) != now[p]]
        if not todo:
            break
        seen.update({p: now[p] for p in todo})
        wanted = [(p, p, _OWN, 0, 1 << 62) for p in todo]
        wanted += [(q, p, _AHEAD, now[p][0], 1 << 62) for p in todo for q in ranges.ahead(p, now[p][0])]
        rows = placed.select("part", "place", "score", "high").join(F.broadcast(spark.createDataFrame(wanted, shape)), "part").filter(f"role = {_OWN} OR (high AND place >= first)")
        given = rows.select("to", "role", "place", "score", "high")
        slices = [(q, p, _CARRIED, lo, hi) for p in todo for q, lo, hi, _ in now[p][1]]
        if slices:
            left = _current(spark, rounds, last).filter(f"kind = {_LEFT}").join(F.broadcast(spark.createDataFrame(slices, shape)), "part").filter("n >= first AND n < last")
            given = given.unionByName(left.select("to", "role", "place", "score", F.lit(True).alias("high")))
        match = _matcher({p: now[p][0] for p in todo}, {p: ranges.starts[p + 1] for p in todo}, max_gap)
        rounds.append(written(given.groupBy("to").applyInPandas(match, _OUT), "match-round"))
        last.update(dict.fromkeys(todo, len(rounds) - 1))
        ranges.ended.update({r.part: (r.place, r.n, r.pops, r.digest) for r in rounds[-1].filter(f"kind = {_END}").collect()})
    if not rounds:
        return spark.createDataFrame([], "low_place long, score double")
    return written(_current(spark, rounds, last).filter(f"kind = {_PAIR}").select(F.col("place").alias("low_place"), "score"), "match-pairs")


def _current(spark: SparkSession, rounds: list[DataFrame], last: dict[int, int]) -> DataFrame:
    """The rows of each range's last round."""
    out = None
    for n, table in enumerate(rounds):
        parts = [(p,) for p, at in last.items() if at == n]
        if parts:
            own = table.join(F.broadcast(spark.createDataFrame(parts, "part int")), "part")
            out = own if out is None else out.unionByName(own)
    return out
