"""Off-policy statistics: model tiers from matched struggle, bootstrap intervals, distribution shift."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .matching import greedy_pairs
from .ranks import apply_ecdf, fit_ecdf, quantile_bucket, quantiles, running, split_halves

#: P(Poisson(1) <= k) for k = 0, 1, ...
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def error_rate(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("err_rate", F.col("n_tool_errors") / F.greatest(F.col("n_tool_calls"), F.lit(1)))


def served_difficulty(df: DataFrame) -> DataFrame:
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("served_difficulty"))


def _poisson(ids: list[str], first: int, n: int) -> np.ndarray:
    """(rows, n) Poisson(1) weights by md5 of id and replicate."""
    steps = np.array([int(p * (1 << 32)) + (p * (1 << 32) > int(p * (1 << 32))) for p in _POISSON], np.uint64)
    tails = [f"|{r}".encode() for r in range(first, first + n)]
    drawn = bytearray()
    for i in ids:
        head = hashlib.md5(i.encode())
        for tail in tails:
            h = head.copy()
            h.update(tail)
            drawn += h.digest()[:4]
    return np.searchsorted(steps, np.frombuffer(bytes(drawn), ">u4").astype(np.uint64), "right").reshape(len(ids), n).astype(np.float64)


def replicate_sums(df: DataFrame, cells: list[str], values: list[str], n: int, id_col: str = "trajectory_id", block: int = 500) -> DataFrame:
    """(cells, replicate, w, values): of each resample, every cell's sum of weights and weighted sums of the values (nulls count as 0).

    A resample gives every row a Poisson(1) weight by md5 of its id and the replicate. A task
    adds its rows' weights x values into one matrix a cell, so what is shuffled is a row for each
    task, cell and replicate, however many rows there are.
    """
    names = ["w", *values]
    schema = ", ".join([*[f"{c} {t}" for c, t in df.select(*cells).dtypes], "first int", *[f"{v} array<double>" for v in names]])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def sent() -> pd.DataFrame:
            rows = [(*cell, first, *m[:, first : first + block].tolist()) for cell, m in sums.items() for first in range(0, n, block)]
            return pd.DataFrame(rows, columns=[*cells, "first", *names])

        for df in batches:
            own = df[values].to_numpy(np.float64, na_value=np.nan) if values else np.zeros((len(df), 0))
            own = np.column_stack([np.ones(len(df)), np.nan_to_num(own)])
            groups = df.groupby(cells, dropna=False, sort=False).indices if cells else {(): np.arange(len(df))}
            for cell, at in groups.items():
                cell = cell if isinstance(cell, tuple) else (cell,)
                m = sums.setdefault(tuple(None if c is None or c != c else c for c in cell), np.zeros((len(names), n)))
                for i in range(0, len(at), 256):
                    some = at[i : i + 256]
                    for first in range(0, n, block):
                        m[:, first : first + block] += own[some].T @ _poisson(df[id_col].iloc[some].astype(str).tolist(), first, min(block, n - first))
            if len(sums) * len(names) * n > 20_000_000:
                yield sent()
                sums.clear()
        if sums:
            yield sent()

    parts = df.select(F.col(id_col).cast("string").alias(id_col), *cells, *values).mapInPandas(add, schema)
    each = parts.select(*cells, "first", F.posexplode(F.arrays_zip(*names)).alias("at", "x")).select(*cells, (F.col("first") + F.col("at")).alias("replicate"), *[F.col(f"x.{v}").alias(v) for v in names])
    return each.groupBy(*cells, "replicate").agg(*[F.sum(v).alias(v) for v in names])


def struggle(df: DataFrame, signals: tuple[str, ...] = ("err_rate", "streak")) -> DataFrame:
    """(model, struggle): mean z-score of the signals within score buckets; a bucket without spread is left out.

    Sums only: two small aggregates, whatever the number of rows. ``df`` holds model, bucket
    and the signals.
    """
    v = {s: F.col(s).cast("double") for s in signals}
    cell = df.groupBy("model", "bucket").agg(F.count(F.lit(1)).cast("double").alias("w"), *[F.sum(v[s]).alias(s) for s in signals], *[F.sum(v[s] * v[s]).alias(f"{s}_2") for s in signals])
    return _struggle(cell, [], signals)


def _struggle(cell: DataFrame, by: list[str], signals: tuple[str, ...]) -> DataFrame:
    """(by, model, struggle) of cell sums (by, model, bucket, w, signals and their squares)."""
    long = cell.select(*by, "model", "bucket", F.col("w").alias("n"), F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("s"), F.col(f"{s}_2").alias("s2")) for s in signals])).alias("x")).select(*by, "model", "bucket", "n", "x.*").filter("n > 0")
    own = Window.partitionBy(*by, "bucket", "signal")
    mean = F.sum("s").over(own) / F.sum("n").over(own)
    sd = F.sqrt(F.greatest(F.sum("s2").over(own) / F.sum("n").over(own) - mean * mean, F.lit(0.0)))
    z = long.withColumn("_m", mean).withColumn("_sd", sd)
    live = F.col("_sd") >= 1e-9
    return z.groupBy(*by, "model").agg(F.coalesce(F.try_divide(F.sum(F.when(live, (F.col("s") - F.col("n") * F.col("_m")) / F.col("_sd"))), F.sum(F.when(live, F.col("n")))), F.lit(0.0)).alias("struggle"))


def _terciles(place: Column, count: Column) -> Column:
    """3 for the first third of places from 0, then 2, then 1."""
    return F.when(place < count / 3, 3).when(place < 2 * count / 3, 2).otherwise(1)


def _ranked(table: DataFrame, by: list[str], min_n: int) -> DataFrame:
    """``table`` (by, model, struggle, n) with pos, solid, and the tier of solid models; all are solid where none reaches ``min_n``."""
    own = Window.partitionBy(*(by or [F.lit(1)]))
    order = own.orderBy(F.round("struggle", 9), "model")
    table = table.withColumn("pos", F.row_number().over(order) - 1).withColumn("solid", (F.col("n") >= min_n) | (F.max("n").over(own) < min_n))
    nth = F.sum(F.col("solid").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return table.withColumn("tier", F.when(F.col("solid"), _terciles(nth, F.sum(F.col("solid").cast("int")).over(own))))


def tier_map(struggles: DataFrame, counts: DataFrame, min_n: int = 15) -> DataFrame:
    """(model, n, struggle, tier, solid): terciles of solid models, least struggle in tier 3; others take the nearest solid one's tier."""
    ranked = _ranked(struggles.join(counts, "model"), [], min_n)
    solid = ranked.filter("solid").select(F.col("pos").alias("_pos"), F.col("tier").alias("_tier"))
    near = ranked.filter("not solid").crossJoin(F.broadcast(solid)).groupBy("model").agg(F.min_by("_tier", F.struct(F.abs(F.col("pos") - F.col("_pos")), "_pos")).alias("_near"))
    return ranked.join(near, "model", "left").select("model", "n", "struggle", F.coalesce("tier", "_near").alias("tier"), "solid")


def tier_stability(df: DataFrame, mapped: DataFrame, n: int = 200, min_n: int = 15, id_col: str = "trajectory_id") -> DataFrame:
    """``mapped`` with ``stability``: the share of resamples that give a model its tier; 0 for models that are not solid."""
    signals = ("err_rate", "streak")
    squared = df.select(id_col, "model", "bucket", *signals, *[(F.col(s) * F.col(s)).alias(f"{s}_2") for s in signals])
    cells = replicate_sums(squared, ["model", "bucket"], [*signals, *[f"{s}_2" for s in signals]], n, id_col)
    each = _struggle(cells, ["replicate"], signals).join(mapped.select("model", "n", F.col("tier").alias("_own"), F.col("solid").alias("_solid")), "model")
    votes = _ranked(each, ["replicate"], min_n).filter("_solid")
    share = votes.groupBy("model").agg(F.avg((F.col("tier") == F.col("_own")).cast("double")).alias("stability"))
    return mapped.join(share, "model", "left").withColumn("stability", F.coalesce("stability", F.lit(0.0)))


def with_bucket(df: DataFrame) -> DataFrame:
    return quantile_bucket(df, "score")


def split_half_map(df: DataFrame, min_n: int = 8, id_col: str = "trajectory_id") -> DataFrame:
    """The tier map fitted on the even-placed rows alone."""
    even = with_bucket(split_halves(df, id_col).filter("half = 0"))
    return tier_map(struggle(even), even.groupBy("model").agg(F.count(F.lit(1)).alias("n")), min_n)


def matched_cells(df: DataFrame) -> DataFrame:
    """``df`` (score, tier, signals) with ``hard`` (score at the 60th percentile or above) and ``low`` (tier 1 or 2)."""
    limit = quantiles(df, "score", (0.6,))
    return df.crossJoin(F.broadcast(limit)).withColumn("hard", F.col("score") >= F.col("_q")[0]).withColumn("low", F.col("tier").isin(1, 2)).drop("_q")


def cell_table(cells: DataFrame, least: int = 10) -> DataFrame:
    """(hard, low, n, err_rate, streak): means of each cell, null below ``least`` rows."""
    enough = F.count(F.lit(1)) >= least
    return cells.groupBy("hard", "low").agg(F.count(F.lit(1)).alias("n"), F.when(enough, F.round(F.avg("err_rate"), 4)).alias("err_rate"), F.when(enough, F.round(F.avg("streak"), 2)).alias("streak"))


def diff_in_diff(cells: DataFrame) -> DataFrame:
    """(did_err, did_streak, least): low minus high tier on hard tasks, less the same on easy ones; least is the smallest cell."""
    return _did(cells.groupBy("hard", "low").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("err_rate").alias("err_rate"), F.sum("streak").alias("streak")), [])


def _did(sums: DataFrame, by: list[str]) -> DataFrame:
    """The interactions of cell sums (by, hard, low, w, err_rate, streak)."""

    def mean(v: str, hard: bool, low: bool) -> Column:
        own = (F.col("hard") == hard) & (F.col("low") == low)
        return F.try_divide(F.sum(F.when(own, F.col(v))), F.sum(F.when(own, F.col("w"))))

    did = lambda v: (mean(v, True, True) - mean(v, True, False)) - (mean(v, False, True) - mean(v, False, False))
    sizes = [F.coalesce(F.sum(F.when((F.col("hard") == h) & (F.col("low") == lo), F.col("w"))), F.lit(0.0)) for h in (True, False) for lo in (True, False)]
    return sums.groupBy(*by).agg(did("err_rate").alias("did_err"), did("streak").alias("did_streak"), F.least(*sizes).alias("least"))


def diff_in_diff_ci(cells: DataFrame, n: int = 5000, id_col: str = "trajectory_id") -> DataFrame:
    """One row: both interactions, their 95 % intervals, significance and a verdict. Replicates with a cell below 5 are left out."""
    parts = _did(replicate_sums(cells, ["hard", "low"], ["err_rate", "streak"], n, id_col), ["replicate"]).filter("least >= 5")
    limits = parts.agg(*[F.percentile(f"did_{v}", F.array(F.lit(0.025), F.lit(0.975))).alias(f"_{v}") for v in ("err", "streak")], F.count(F.lit(1)).alias("n_boot"))
    out = diff_in_diff(cells).crossJoin(limits)
    for v in ("err", "streak"):
        lo, hi = F.col(f"_{v}")[0], F.col(f"_{v}")[1]
        out = out.withColumn(f"{v}_low", lo).withColumn(f"{v}_high", hi).withColumn(f"{v}_significant", F.coalesce((lo > 0) | (hi < 0), F.lit(False)))
    up = lambda v: F.col(f"{v}_significant") & (F.col(f"did_{v}") > 0)
    down = lambda v: F.col(f"{v}_significant") & (F.col(f"did_{v}") < 0)
    verdict = F.when(up("err") & up("streak"), "SUPPORTED").when(up("err") | up("streak"), "PARTIALLY SUPPORTED").when(down("err") | down("streak"), "REFUTED-DIRECTION").otherwise("INCONCLUSIVE")
    return out.withColumn("verdict", verdict).drop("_err", "_streak", "least")


def matched_pairs(df: DataFrame, max_gap: float = 0.05, limit: int | None = 50, id_col: str = "trajectory_id", size: int = 250_000) -> DataFrame:
    """(low_id, high_id, low_model, high_model, score_gap): each low-tier row in score order takes the nearest free high-tier row within ``max_gap``.

    Matched in ranges of ``size`` rows, see :func:`tierscope.operators.matching.greedy_pairs`. Rows
    without a tier count as tier 2. ``limit`` keeps the first pairs in score order, a report's top.
    """
    rows = df.select(F.col(id_col), "model", "score", F.coalesce("tier", F.lit(2)).alias("tier")).filter("tier <= 3")
    pairs = greedy_pairs(rows.withColumn("high", F.col("tier") == 3), id_col, "high", ["model"], max_gap, size)
    return (pairs.orderBy("low_place").limit(limit) if limit else pairs).withColumn("score_gap", F.round("score_gap", 4)).drop("low_score", "low_place")


def ks_statistic(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(by, ks): largest distance of the two samples' distribution functions."""
    keys = list(by)
    both = a.select(*keys, "value", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, "value", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    tally = both.groupBy(*keys, "value").agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    gap = F.abs(F.col("upto_na") / F.col("total_na") - F.col("upto_nb") / F.col("total_nb"))
    return running(tally, keys, ("na", "nb")).groupBy(*keys).agg(F.max(gap).alias("ks"))


def shift_report(fit: DataFrame, new: DataFrame) -> DataFrame:
    """(feature, fit_median, new_median, ks, mean_fit_rank, shift): how far each feature moved; order by shift for the top."""
    ranks = apply_ecdf(new, fit_ecdf(fit), mid=True).groupBy("feature").agg(F.round(F.avg("rank"), 3).alias("mean_fit_rank"))
    median = lambda df, name: quantiles(df, "value", (0.5,), ("feature",)).select("feature", F.round(F.get("_q", F.lit(0)), 3).alias(name))
    old = median(fit, "fit_median").join(median(new, "new_median"), "feature")
    ks = ks_statistic(fit, new).withColumn("ks", F.round("ks", 3))
    return old.join(ranks, "feature").join(ks, "feature").withColumn("shift", F.round(F.abs(F.col("mean_fit_rank") - 0.5), 3))


def top_shifts(report: DataFrame, k: int = 12) -> DataFrame:
    return report.orderBy(F.desc("shift"), "feature").limit(k)


def shift_summary(report: DataFrame, fit_shape: DataFrame, new_shape: DataFrame) -> DataFrame:
    """One row: features moved by more than 0.15, the median shift, and whether call sampling differs between the logs."""
    pct = lambda df, n: df.select(F.col("one_call_only_pct").alias(n))
    one = report.agg(F.count_if(F.col("shift") > 0.15).alias("moved"), F.median("shift").alias("median_shift"))
    return one.crossJoin(pct(fit_shape, "_f")).crossJoin(pct(new_shape, "_n")).withColumn("sampling_differs", F.abs(F.col("_f") - F.col("_n")) > 40).drop("_f", "_n")


def compare_detectors(outputs: DataFrame, text: str = "output") -> DataFrame:
    """One row: outputs, flagged by the word rule and the older substring rule, by one alone."""
    new, old = X.is_error_output(F.col(text)), X.is_error_output_substring(F.col(text))
    return outputs.select(new.alias("_n"), old.alias("_o")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_n").alias("flagged_new"), F.count_if("_o").alias("flagged_old"), F.count_if(F.col("_n") & ~F.col("_o")).alias("new_only"), F.count_if(F.col("_o") & ~F.col("_n")).alias("old_only"))


def sample_outputs(outputs: DataFrame, id_col: str, n: int = 30, seed: int = 7) -> DataFrame:
    """A reproducible sample: the ``n`` least md5 values of id and seed."""
    return outputs.orderBy(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary")), id_col).limit(n)
