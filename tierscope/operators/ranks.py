"""Empirical ranks fitted on some rows and applied to others, quantile cuts, halves.

Ranks are right-continuous ECDF values; a feature that is constant where it was fitted
ranks 0.5 everywhere. Everything runs in long form (feature, value) on counts of distinct
values, in one ordered pass that is written once: the counts are dealt in ranges of (feature,
value), each range adds up its own counts and starts from the sums of the ranges before it. So
no task holds a whole column, and ranks of ranks are a chain of tables, not a tree of plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def melt(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Long form: ids, feature, value."""
    return df.unpivot(ids, [F.col(f).cast("double").alias(f) for f in features], "feature", "value")


def over(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of a table of a row for each key; Spark decides how from the table's size. Without keys it is one row."""
    return df.join(small, keys) if keys else df.crossJoin(F.broadcast(small))


def _grouped(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def places(array: Column, size: int, ahead: Callable[[Column], Column]) -> Column:
    """How many of a sorted array's first ``size`` entries are ``ahead``, by halving."""
    steps = [1 << b for b in reversed(range(size.bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(ahead(F.get(array, at + s - 1)), at + s).otherwise(at))


def running(tally: DataFrame, keys: list[str], cols: tuple[str, ...] = ("n",)) -> DataFrame:
    """``tally`` (distinct keys and ``value``) with ``distinct`` and, for each of ``cols``, ``upto_`` (its sum up to the value) and ``total_``."""
    placed = written(tally.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()), "ordered")
    sums = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_k"), *[F.sum(c).alias(c) for c in cols])  # a row for each range, one more where a key ends within it
    key = Window.partitionBy(*(keys or [F.lit(1)]))
    earlier = key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_part", F.sum("_k").over(key).alias("distinct"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in cols], *[F.sum(c).over(key).alias(f"total_{c}") for c in cols])
    run = Window.partitionBy(*keys, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("*", *[F.sum(c).over(run).alias(f"_in_{c}") for c in cols])
    joined = within.join(before if keys else F.broadcast(before), [*keys, "_part"])
    return joined.select(*tally.columns, "distinct", *[(F.col(f"_before_{c}") + F.col(f"_in_{c}")).alias(f"upto_{c}") for c in cols], *[f"total_{c}" for c in cols])


def _tally(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def fit_ecdf(long: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """The fitted steps: by, value, upto, below, total, distinct."""
    keys = list(by)
    return running(_tally(long, keys), keys).select(*keys, "value", F.col("upto_n").alias("upto"), (F.col("upto_n") - F.col("n")).alias("below"), F.col("total_n").alias("total"), "distinct")


def self_rank(long: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """``long`` with ``rank`` among its own rows."""
    keys = list(by)
    steps = running(_tally(long, keys), keys)
    return long.join(steps.select(*keys, "value", F.when(F.col("distinct") == 1, 0.5).otherwise(F.col("upto_n") / F.col("total_n")).alias("rank")), [*keys, "value"])


def apply_ecdf(long: DataFrame, ecdf: DataFrame, by: tuple[str, ...] = ("feature",), mid: bool = False) -> DataFrame:
    """``long`` with ``rank`` under fitted steps; 0 below the least fitted value, 0.5 without a fit.

    New values enter the steps with a count of 0, so one running sum places both: an as-of join
    without a range condition. ``mid`` centres ties on their mass.
    """
    keys = list(by)
    steps = ecdf.select(*keys, "value", (F.col("upto") - F.col("below")).cast("long").alias("n"), F.lit(1).alias("kind"))
    new = long.select(*keys, "value").distinct().select(*keys, "value", F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind"))
    both = running(steps.unionByName(new).groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.sum("kind").alias("kind")), keys, ("n", "kind"))
    upto = 2 * F.col("upto_n") - F.col("n") if mid else 2 * F.col("upto_n")
    rank = F.when(F.col("total_kind") <= 1, 0.5).otherwise(F.try_divide(upto, 2 * F.col("total_n")))
    return long.join(both.select(*keys, "value", rank.alias("rank")), [*keys, "value"])


def fold_ranks(long: DataFrame, fold: str = "fold", by: tuple[str, ...] = ("feature",), folds: int | None = None) -> DataFrame:
    """``long`` for every test fold with ``rank`` fitted on the rows of all other folds; ``test`` names the fold left out.

    One ordered pass counts every fold at each value; the steps of the other folds are the total
    less the fold's own. A fold's rows, whatever their values, change no rank of its training rows.
    """
    keys, k = list(by), folds or 1 + (long.agg(F.max(fold)).first()[0] or 0)
    own = [f"_f{i}" for i in range(k)]
    tally = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(fold) == i).alias(c) for i, c in enumerate(own)])
    # A value counts as a step of the other folds where one of them holds it.
    tally = tally.select("*", *[(F.col("n") > F.col(c)).cast("long").alias(f"k{c}") for c in own])
    steps = running(tally, keys, ("n", *own, *[f"k{c}" for c in own]))
    rank = [F.when(F.col(f"total_k{c}") <= 1, 0.5).otherwise(F.try_divide(F.col("upto_n") - F.col(f"upto_{c}"), F.col("total_n") - F.col(f"total_{c}"))) for c in own]
    table = steps.select(*keys, "value", F.posexplode(F.array(*rank)).alias("test", "rank"))
    return long.join(table, [*keys, "value"])


def quantiles(df: DataFrame, value: str, shares, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, _q): the exact quantiles at rising ``shares``, linear between neighbours, as one array; empty without values.

    ``shares`` is a list, or a table (by, shares array of two) of each key's own.
    """
    keys = list(by)
    steps = running(_tally(df.select(*keys, F.col(value).cast("double").alias("value")).filter("value is not null"), keys), keys)
    if isinstance(shares, DataFrame):
        steps, size, known = over(steps, shares, keys), 2, F.col("shares")
    else:
        size, known = len(shares), F.array(*[F.lit(float(s)) for s in shares])
    top, upto = F.col("total_n") - 1, F.col("upto_n")
    below = upto - F.col("n")
    # A value covers the places of its rows, from below to upto - 1; shares whose place's floor, or ceiling, lies there form a run.
    count = lambda ahead: places(known, size, ahead)
    marked = steps.select(
        *keys, "value", top.alias("_top"),
        count(lambda s: s * top < below).alias("_a"), count(lambda s: s * top < upto).alias("_b"), count(lambda s: s * top <= below - 1).alias("_c"), count(lambda s: s * top <= upto - 1).alias("_d"),
        *(["shares"] if isinstance(shares, DataFrame) else []),
    ).filter("_a < _b or _c < _d")
    first, last = F.least(F.when(F.col("_a") < F.col("_b"), F.col("_a")), F.when(F.col("_c") < F.col("_d"), F.col("_c"))), F.greatest(F.when(F.col("_a") < F.col("_b"), F.col("_b")), F.when(F.col("_c") < F.col("_d"), F.col("_d")))
    each = marked.select("*", F.explode(F.sequence(first, last - 1)).alias("i")).select(*keys, "i", (F.get(known, F.col("i")) * F.col("_top")).alias("place"), F.when((F.col("i") >= F.col("_a")) & (F.col("i") < F.col("_b")), F.col("value")).alias("low"), F.when((F.col("i") >= F.col("_c")) & (F.col("i") < F.col("_d")), F.col("value")).alias("high"))
    ends = each.groupBy(*keys, "i").agg(F.max("place").alias("place"), F.max("low").alias("low"), F.max("high").alias("high"))
    share = F.col("place") - F.floor("place")
    q = F.when(share == 0, F.col("low")).otherwise((F.ceil("place") - F.col("place")) * F.col("low") + share * F.col("high"))
    return _grouped(ends, keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("_q"))


def rank_columns(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Wide ranks: ids and one column for each feature."""
    return self_rank(melt(df, ids, features)).groupBy(*ids).pivot("feature", features).agg(F.max("rank"))


def quantile_cut(df: DataFrame, score: str, cuts: tuple[float, float] = (0.55, 0.85), by: list[str] | None = None, out: str = "tier", scores: DataFrame | None = None) -> DataFrame:
    """Tier 1, 2 or 3 by the score's linear-interpolated quantiles; a score on a cut takes the cheaper tier.

    ``scores`` is a table that holds the same scores and is cheaper to read than ``df``.
    """
    joined = over(df, quantiles(df if scores is None else scores, score, cuts, tuple(by or ())), by or [])
    return joined.withColumn(out, F.when(F.col(score) <= F.col("_q")[0], 1).when(F.col(score) <= F.col("_q")[1], 2).otherwise(3)).drop("_q")


def quantile_bucket(df: DataFrame, score: str, qs: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8), out: str = "bucket") -> DataFrame:
    """How many of the score's quantiles a row reaches; a score on a quantile moves up."""
    reached: Column = sum(((F.col(score) >= F.col("_q")[i]).cast("int") for i in range(len(qs))), F.lit(0))
    return over(df, quantiles(df, score, qs), []).withColumn(out, reached).drop("_q")


def split_halves(df: DataFrame, order: str, out: str = "half") -> DataFrame:
    """Parity of each row's place by ``order`` (unique integers): 0 for the first row.

    Places are counts of the rows in earlier runs of 65,536 values plus the place within the
    run, so no task sorts all rows.
    """
    run = F.shiftright(F.col(order).cast("long"), 16)
    sizes = df.groupBy(run.alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_run", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_run").orderBy(order)) - 1
    return df.withColumn("_run", run).withColumn("_within", within).join(before, "_run").withColumn(out, F.pmod(F.col("_before") + F.col("_within"), F.lit(2)).cast("int")).drop("_run", "_within", "_before")
