"""Agreement reports, sweeps over operating points, cost-quality frontiers and baselines."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import scoring
from .draws import classed, cut_cells, unit_draws
from .ranks import melt, over, places, quantile_cut, quantiles, running, self_rank

BUDGETS = [0.25 + 0.01 * i for i in range(76)]


def own_cost(tier: str = "tier") -> Column:
    return F.when(F.col(tier) == 1, F.col("c1")).when(F.col(tier) == 2, F.col("c2")).otherwise(F.col("c3"))


def _share(when: Column) -> Column:
    return F.avg(when.cast("double"))


def confusion(df: DataFrame, tier: str = "tier", label: str = "difficulty") -> DataFrame:
    """(tier, d1, d2, d3): counts for tiers 1 to 3, zero where none."""
    counts = [F.count_if(F.col(label) == d).alias(f"d{d}") for d in (1, 2, 3)]
    tiers = df.sparkSession.range(1, 4).select(F.col("id").cast("int").alias(tier))
    return tiers.join(df.groupBy(tier).agg(*counts), tier, "left").na.fill(0)


def report(df: DataFrame, tier: str = "tier", label: str = "difficulty") -> DataFrame:
    """One row: agreement, served shares (plain and weighted by top-tier cost), policy and all-top cost, savings.

    ``df`` holds tier, difficulty and c1, c2, c3.
    """
    t, d, w = F.col(tier), F.col(label), F.col("c3")
    cost, top = F.sum(own_cost(tier)), F.sum(w)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        _share(t == d).alias("exact_agreement"),
        _share(F.abs(t - d) <= 1).alias("adjacent_agreement"),
        _share(t < d).alias("under_routed"),
        _share(t > d).alias("over_routed"),
        _share(t >= d).alias("served"),
        F.try_divide(F.sum(F.when(t >= d, w).otherwise(0.0)), top).alias("served_token_weighted"),
        F.round(cost, 2).alias("est_cost_policy_usd"),
        F.round(top, 2).alias("est_cost_all_tier3_usd"),
        F.bround(100 * (1 - F.try_divide(cost, top)), 1).alias("est_savings_pct"),
    )


def class_report(df: DataFrame, tier: str = "tier", label: str = "difficulty") -> DataFrame:
    """One row: exact and balanced accuracy, adjacent share, recall of difficulty 3; an absent class has recall 0."""
    t, d = F.col(tier), F.col(label)
    recall = [F.count_if((t == k) & (d == k)) / F.greatest(F.count_if(d == k), F.lit(1)) for k in (1, 2, 3)]
    return df.agg(_share(t == d).alias("exact"), ((recall[0] + recall[1] + recall[2]) / 3).alias("balanced"), _share(F.abs(t - d) <= 1).alias("adjacent"), recall[2].alias("d3_recall"))


def spearman(df: DataFrame, a: str, b: str, id_col: str = "trajectory_id") -> DataFrame:
    """One row: correlation of right-ECDF ranks; ties are not averaged."""
    ranks = self_rank(melt(df, [id_col], [a, b]))
    return ranks.groupBy(id_col).agg(F.max(F.when(F.col("feature") == a, F.col("rank"))).alias("x"), F.max(F.when(F.col("feature") == b, F.col("rank"))).alias("y")).agg(F.corr("x", "y").alias("spearman"))


def operating_point(df: DataFrame, by: tuple[str, ...] = (), tier: str = "tier", label: str = "difficulty") -> DataFrame:
    """(cost_share, served, weighted_served), for each value of ``by``."""
    ok, top = F.col(tier) >= F.col(label), F.sum("c3")
    return df.groupBy(*by).agg((F.sum(own_cost(tier)) / top).alias("cost_share"), _share(ok).alias("served"), (F.sum(F.when(ok, F.col("c3")).otherwise(0.0)) / top).alias("weighted_served"))


def default_grid(kind: str) -> list[tuple[float, ...]]:
    """The knobs of a sweep: cut pairs, thresholds, or weights spaced evenly in their logarithm."""
    spaced = lambda lo, hi, n: [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)]
    if kind == "cuts":
        return [(c2 * r, c2) for c2 in (round(0.20 + 0.02 * i, 2) for i in range(41)) for r in (0.45, 0.6, 0.75)]
    if kind == "tau":
        return [(round(0.30 + 0.02 * i, 2),) for i in range(35)] + [(0.995,)]
    if kind == "alpha":
        return [(round(0.05 * i, 2),) for i in range(21)]
    return [(x,) for x in (spaced(1e-4, 30, 40) if kind == "lambda" else spaced(0.02, 50, 40))]


def sweep_tiers(df: DataFrame, kind: str, grid: list | None = None, score: str = "score", costs: tuple[str, str, str] = ("c1", "c2", "c3")) -> DataFrame:
    """``df`` for every knob of the grid: knob, knob2 (of cuts), tier. One job for all knobs."""
    spark, grid = df.sparkSession, grid or default_grid(kind)
    rows = [(i, float(g[0]), float(g[1]) if len(g) > 1 else None) for i, g in enumerate(grid)]
    if kind == "cuts":
        shares = sorted({min(x, 1.0) for g in grid for x in g})
        at = {s: i for i, s in enumerate(shares)}
        q = quantiles(df, score, shares)
        knobs = spark.createDataFrame([(*r, at[min(r[1], 1.0)], at[min(r[2], 1.0)]) for r in rows], "point int, knob double, knob2 double, _i int, _j int")
        wide = df.crossJoin(F.broadcast(knobs.crossJoin(q)))
        return wide.withColumn("tier", F.when(F.col(score) <= F.get("_q", "_i"), 1).when(F.col(score) <= F.get("_q", "_j"), 2).otherwise(3)).drop("_q", "_i", "_j")
    wide = df.crossJoin(F.broadcast(spark.createDataFrame(rows, "point int, knob double, knob2 double")))
    if kind == "tau":
        return scoring.dispatch_tau(wide, F.col("knob"))
    if kind in ("lambda", "lambda_sized"):
        return scoring.dispatch_lambda(wide, F.col("knob"), costs, sized=kind == "lambda_sized")
    raise ValueError(f"no such sweep: {kind}")


def cut_points(df: DataFrame, score: str, cuts: list, by: tuple[str, ...] = (), label: str = "difficulty") -> DataFrame:
    """(by, point, knob, knob2, cost_share, served, weighted_served) of every pair of quantile cuts.

    Rows are tallied once by the number of cut scores below theirs. Sums up to each tally, one
    short array a key, then give every pair as differences at two places.
    """
    keys = list(by)
    shares = sorted({min(x, 1.0) for g in cuts for x in g})
    marked = over(df, quantiles(df, score, shares, by), keys).withColumn("_bin", places(F.col("_q"), len(shares), lambda x: x < F.col(score)))
    enough = lambda t, v: F.sum(F.when(F.col(label) <= t, v).otherwise(F.lit(0.0)))
    one, top = F.lit(1.0), F.col("c3")
    cells = marked.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(c) for c in ("c1", "c2", "c3")], enough(1, top).alias("w1"), enough(2, top).alias("w2"), enough(1, one).alias("n1"), enough(2, one).alias("n2"), F.sum(one).alias("n"))
    return _points(cells, cuts, keys)


def _points(cells: DataFrame, cuts: list, keys: list[str]) -> DataFrame:
    """The points of :func:`cut_points` from a row for each key and number of cut scores below."""
    shares = sorted({min(x, 1.0) for g in cuts for x in g})
    at = {s: i for i, s in enumerate(shares)}
    upto = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_bin")  # a row for each cut at most
    sums = ("c1", "c2", "c3", "w1", "w2", "n1", "n2", "n")
    run = cells.select(*keys, "_bin", *[F.sum(c).over(upto).alias(c) for c in sums])
    each = (run.groupBy(*keys) if keys else run.groupBy()).agg(F.array_sort(F.collect_list(F.struct("_bin", *sums))).alias("_l")).withColumn("_bins", F.transform("_l", lambda x: x["_bin"])).filter(F.size("_l") > 0)
    knobs = cells.sparkSession.createDataFrame([(i, float(a), float(b), at[min(a, 1.0)], at[min(b, 1.0)]) for i, (a, b) in enumerate(cuts)], "point int, knob double, knob2 double, _i int, _j int")
    found = lambda k: F.get("_l", places(F.col("_bins"), len(shares) + 1, lambda b: b <= F.col(k)) - 1)
    wide = each.crossJoin(F.broadcast(knobs)).select(*keys, "point", "knob", "knob2", found("_i").alias("a"), found("_j").alias("b"), F.element_at("_l", -1).alias("t"))
    v = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0))
    # Tier 1 up to the first cut, tier 2 between the cuts, tier 3 beyond.
    parts = lambda x, y, z: v("a", x) + (v("b", y) - v("a", y)) + (v("t", z) - v("b", z))
    return wide.select(*keys, "point", "knob", "knob2", (parts("c1", "c2", "c3") / v("t", "c3")).alias("cost_share"), (parts("n1", "n2", "n") / v("t", "n")).alias("served"), (parts("w1", "w2", "c3") / v("t", "c3")).alias("weighted_served"))


def sweep_alpha(df: DataFrame, ml: str, heuristic: str, grid: list | None = None, id_col: str = "trajectory_id") -> DataFrame:
    """``df`` for every blend weight, cut at the default quantiles of each blend."""
    ranks = self_rank(melt(df, [id_col], [ml, heuristic])).groupBy(id_col).agg(F.max(F.when(F.col("feature") == ml, F.col("rank"))).alias("_m"), F.max(F.when(F.col("feature") == heuristic, F.col("rank"))).alias("_h"))
    knobs = df.sparkSession.createDataFrame([(i, float(g[0]), None) for i, g in enumerate(grid or default_grid("alpha"))], "point int, knob double, knob2 double")
    wide = df.join(ranks, id_col).crossJoin(F.broadcast(knobs)).withColumn("_b", F.round(F.col("knob") * F.col("_m") + (1 - F.col("knob")) * F.col("_h"), 12))
    return quantile_cut(wide, "_b", scoring.CUTS, by=["point"]).drop("_m", "_h", "_b")


def sweep(df: DataFrame, kind: str, grid: list | None = None, **options) -> DataFrame:
    """(point, knob, knob2, cost_share, served, weighted_served) for every knob."""
    if kind == "cuts":
        return cut_points(df, options.get("score", "score"), grid or default_grid(kind))
    return operating_point(sweep_tiers(df, kind, grid, **options), ("point", "knob", "knob2"))


def frontier_metrics(points: DataFrame, quality: str = "served", by: tuple[str, ...] = ()) -> DataFrame:
    """Normalized area under the upper envelope over cost shares .25 to 1, quality at half the budget, cost at 90 % quality, and the knee.

    Null where a target is out of reach.
    """
    keys = list(by)
    pts = points.select(*keys, F.col("cost_share").alias("x"), F.col(quality).alias("y")).distinct()
    grid = points.sparkSession.createDataFrame([(i, x) for i, x in enumerate(BUDGETS)], "i int, budget double")
    env = pts.crossJoin(F.broadcast(grid)).groupBy(*keys, "i", "budget").agg(F.coalesce(F.max(F.when(F.col("x") <= F.col("budget"), F.col("y"))), F.lit(0.0)).alias("best"))
    step = (F.lead("best").over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("i")) + F.col("best")) / 2 * 0.01
    area = env.withColumn("_a", step).groupBy(*keys).agg((F.sum("_a") / 0.75).alias("auc"))
    knee = F.max_by(F.struct("x", "y"), F.struct(F.col("y") - F.col("x"), -F.col("x")))
    marks = pts.groupBy(*keys).agg(F.max(F.when(F.col("x") <= 0.5, F.col("y"))).alias("at_half_budget"), F.min(F.when(F.col("y") >= 0.9, F.col("x"))).alias("cost_at_90"), knee.alias("_k"))
    joined = area.join(marks, keys) if keys else area.crossJoin(marks)
    return joined.select(*keys, "auc", "at_half_budget", "cost_at_90", F.col("_k.x").alias("knee_cost"), F.col("_k.y").alias("knee_quality"))


def reference_points(df: DataFrame, label: str = "difficulty") -> DataFrame:
    """(method, cost_share, served, weighted_served) of the oracle and of each constant tier."""
    options = F.array(*[F.struct(F.lit(n).alias("method"), t.cast("int").alias("tier")) for n, t in (("oracle", F.col(label)), ("always-1", F.lit(1)), ("always-2", F.lit(2)), ("always-3", F.lit(3)))])
    wide = df.withColumn("_o", F.explode(options)).withColumn("method", F.col("_o.method")).withColumn("tier", F.col("_o.tier")).drop("_o")
    return operating_point(wide, ("method",), label=label)


def random_baseline(df: DataFrame, cuts: list, n: int = 100, id_col: str = "trajectory_id") -> DataFrame:
    """One row: mean and 95 % interval of the frontier area of ``n`` random orders, drawn by md5 of id and draw.

    A random order is a uniform score, so its quantiles are those of the draws themselves. The
    draws are made in the tasks, twice, and no row is repeated for them.
    """
    shares = sorted({min(x, 1.0) for g in cuts for x in g})
    rows = written(classed(df, F.concat(F.col(id_col).cast("string"), F.lit("|")).alias("_id")), "policy")  # md5 leaves a null id out
    names = [str(i) for i in range(n)]
    cells = cut_cells(rows, lambda batch: unit_draws(batch["_id"].fillna("").tolist(), names), n, shares, 0.0, 1.0).withColumnRenamed("key", "draw")
    area = frontier_metrics(written(_points(cells, cuts, ["draw"]), "points"), by=("draw",))
    ends = area.groupBy().agg(F.avg("auc").alias("auc_mean"), F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))  # a row a draw
    return ends.select("auc_mean", F.col("_q")[0].alias("auc_low"), F.col("_q")[1].alias("auc_high"))


def unit_draw(*parts: Column) -> Column:
    """A number in 0..1 from the md5 of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def weight_draws(spark, n: int, groups: dict | None = None) -> DataFrame:
    """(draw, grp, sign, weight): the default weights as draw 0, then ``n`` draws of 0 to 2."""
    groups = groups or scoring.GROUPS
    table = spark.createDataFrame([(g, s, float(scoring.GROUP_WEIGHTS.get(g, 1.0))) for g, (s, _) in groups.items()], "grp string, sign int, own double")
    return table.crossJoin(spark.range(n + 1).select(F.col("id").alias("draw"))).select("draw", "grp", "sign", F.when(F.col("draw") == 0, F.col("own")).otherwise(2 * unit_draw(F.col("draw"), F.col("grp"))).alias("weight"))


def search_group_weights(group_means: DataFrame, labelled: DataFrame, draws: DataFrame, cuts: list, by: tuple[str, ...] = (), id_col: str = "trajectory_id") -> DataFrame:
    """(by, draw, auc): the draw of group weights with the largest frontier area, for each value of ``by`` (say, each test fold's training rows).

    ``group_means``: (id, by, grp, mean_rank); ``labelled``: (id, difficulty, c1..c3). The tasks
    score a row with all draws, twice, and no row is repeated for them.
    """
    spark, keys = labelled.sparkSession, list(by)
    table = draws.select("draw", "grp", "sign", "weight").collect()  # a row for each draw and group
    names, at = sorted({r["grp"] for r in table}), {d: i for i, d in enumerate(sorted({r["draw"] for r in table}))}
    weight = np.zeros((len(names), len(at)))
    signed = np.zeros((len(names), len(at)))
    for r in table:
        i, j = names.index(r["grp"]), at[r["draw"]]
        weight[i, j], signed[i, j] = r["weight"], r["sign"] * r["weight"]
    # A null for a group without a rank, whose weight does not count.
    means = group_means.filter(F.col("grp").isin(*names)).groupBy(id_col, *keys).agg(*[F.max(F.when(F.col("grp") == g, F.col("mean_rank"))).alias(f"_m{i}") for i, g in enumerate(names)])
    wide = labelled.join(means, id_col)
    ends = [f"_m{i}" for i in range(len(names))]
    rows = written(classed(wide, id_col, *keys, *ends).repartitionByRange(*keys, id_col), "draws")  # a task has few values of by
    kinds = rows.select(*keys).distinct().collect() if keys else [()]
    known = {tuple(r): i for i, r in enumerate(kinds)}

    def scores(batch):
        mean = batch[ends].to_numpy(np.float64)
        own = np.array([known[tuple(r)] for r in batch[keys].itertuples(index=False, name=None)], np.int64) if keys else np.zeros(len(batch), np.int64)
        for k in np.unique(own):
            which = np.flatnonzero((own == k) & ~np.isnan(mean).all(axis=1))
            m = mean[which]
            there = ~np.isnan(m)
            m = np.where(there, m, 0.0)
            for j in range(len(at)):
                total, whole = np.zeros(len(which)), np.zeros(len(which))
                for i in range(len(names)):
                    total += signed[i, j] * m[:, i]
                    whole += weight[i, j] * there[:, i]
                s = total / whole
                yield int(k) * len(at) + j, np.sign(s) * np.floor(np.abs(s) * 1e9 + 0.5) / 1e9, which

    shares = sorted({min(x, 1.0) for g in cuts for x in g})
    cells = cut_cells(rows, scores, max(len(kinds), 1) * len(at), shares, -1.0, 1.0)
    found = spark.createDataFrame([(i * len(at) + j, *r, d) for i, r in enumerate(kinds) for d, j in at.items()], ", ".join(["key long", *[f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema], "draw long"]))
    points = written(_points(cells, cuts, ["key"]).join(F.broadcast(found), "key"), "points")
    area = frontier_metrics(points, by=(*keys, "draw"))
    return area.groupBy(*keys).agg(F.max_by("draw", F.struct(F.round("auc", 9), -F.col("draw"))).alias("draw"), F.max("auc").alias("auc"))


def consensus_weights(picks: DataFrame, draws: DataFrame) -> DataFrame:
    """(grp, weight): the mean weight of each group over the folds' picks, to two digits."""
    return picks.join(draws, "draw").groupBy("grp").agg(F.round(F.avg("weight"), 2).alias("weight"))


def evaluator_sensitivity(metrics: DataFrame, graded: DataFrame, n: int = 30, id_col: str = "trajectory_id") -> DataFrame:
    """(draw, agreement): share of labels that stay when metric weights vary by x0.5 to x2 and cuts by 5 points.

    ``graded`` holds difficulty and, as ``tier``, the routed tiers; their agreement with each
    draw's labels is ``exact``.
    """
    spark, names = metrics.sparkSession, list(scoring.METRIC_WEIGHTS)
    ranks = self_rank(melt(metrics, [id_col], names))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in scoring.METRIC_WEIGHTS.items() for x in kv]), F.col("feature"))
    weighted = ranks.crossJoin(F.broadcast(spark.range(n).select(F.col("id").alias("draw")))).withColumn("w", base * (0.5 + 1.5 * unit_draw(F.col("draw"), F.col("feature"))))
    scored = weighted.groupBy(id_col, "draw").agg(F.round(F.sum(F.col("w") * F.col("rank")) / F.sum("w"), 12).alias("score"))
    clip = lambda c: F.greatest(F.lit(0.3), F.least(F.lit(0.95), c))
    low = clip(scoring.CUTS[0] + 0.1 * unit_draw(F.col("_test"), F.lit("low")) - 0.05)
    high = clip(scoring.CUTS[1] + 0.1 * unit_draw(F.col("_test"), F.lit("high")) - 0.05)
    shares = spark.range(n).select(F.col("id").alias("_test")).select(F.col("_test").alias("draw"), low.alias("p1"), F.greatest(low + 0.02, high).alias("p2"))
    q = scoring._interpolated(scored, "score", shares, ["draw"])
    own = over(scored, q, ["draw"]).withColumn("_d", F.when(F.col("score") <= F.col("q1"), 1).when(F.col("score") <= F.col("q2"), 2).otherwise(3))
    joined = own.join(graded.select(id_col, "difficulty", "tier", *scoring.OVERRIDES), id_col)
    joined = joined.withColumn("_d", scoring.overridden(F.col("_d")))
    return joined.groupBy("draw").agg(_share(F.col("_d") == F.col("difficulty")).alias("agreement"), _share(F.col("_d") == F.col("tier")).alias("exact"))


def pick_winner(results: DataFrame, value: str = "auc") -> DataFrame:
    """The method with the largest value, oracles and random baselines aside."""
    fair = results.filter(~F.col("method").rlike("(?i)oracle|random"))
    return fair.agg(F.max_by("method", F.struct(value, "method")).alias("method"), F.max(value).alias(value))


def rescored_winner(aware: DataFrame, blind: DataFrame, kinds: tuple[str, ...] = ("tau", "lambda", "lambda_sized"), id_col: str = "trajectory_id") -> DataFrame:
    """(method, auc, knee_quality, knee_cost, auc_blind): the best sweep under cache-aware costs, and what it comes to under cache-blind ones.

    Both tables hold the same rows (id, p_d1, p_d2, difficulty, c1..c3) with their own costs;
    a rule that reads costs reads those of its table.
    """
    def scored(df: DataFrame) -> DataFrame:
        made = [frontier_metrics(sweep(df, k)).select(F.lit(k).alias("method"), "*") for k in kinds]
        return reduce(DataFrame.unionByName, made)

    first = written(scored(aware), "frontiers")  # a row for each method
    best = pick_winner(first.withColumn("auc", F.round("auc", 9))).select("method")
    return first.join(best, "method").select("method", "auc", "knee_quality", "knee_cost").join(scored(blind).select("method", F.col("auc").alias("auc_blind")), "method")


def adoption_frontier(routes: DataFrame, quality: Column | None = None, steps: int = 10) -> DataFrame:
    """(adopt_frac, cost_usd, quality): the cheapest share of trajectories adopts its route, the rest stays.

    ``quality`` is a column over the route table; by default the share of calls that stay on
    the logged model.
    """
    own = quality if quality is not None else F.size(F.filter("route", lambda r: r == F.col("logged_model"))) / F.size("route")
    # Ranks by cost from counts of cheaper costs, then places among equal ones.
    tally = routes.groupBy(F.col("cost_logged_usd").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    below = running(tally, []).select(F.col("value").alias("cost_logged_usd"), (F.col("upto_n") - F.col("n")).alias("_below"))
    placed = routes.withColumn("_q", own.cast("double")).join(below, "cost_logged_usd").withColumn("_rank", F.col("_below") + F.row_number().over(Window.partitionBy("cost_logged_usd").orderBy("trajectory_id")))
    total = routes.agg(F.count(F.lit(1)).alias("_all"))
    fracs = routes.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("adopt_frac")).crossJoin(total)
    adopted = F.col("_rank") <= F.bround(F.col("adopt_frac") * F.col("_all"))
    wide = placed.crossJoin(F.broadcast(fracs))
    return wide.groupBy("adopt_frac").agg(F.round(F.sum(F.when(adopted, F.col("cost_routed_usd")).otherwise(F.col("cost_logged_usd"))), 4).alias("cost_usd"), F.round(F.sum(F.when(adopted, F.col("_q")).otherwise(1.0) * F.col("n_calls")) / F.sum("n_calls"), 3).alias("quality"))


def selection_bias(grid: DataFrame, nested: DataFrame, value: str = "exact") -> DataFrame:
    """Best pooled figure of a grid less the nested one."""
    return grid.agg(F.max(value).alias("best")).crossJoin(nested.agg(F.max(value).alias("nested"))).withColumn("bias", F.col("best") - F.col("nested"))


def logged_policy(df: DataFrame, tier_map: DataFrame) -> DataFrame:
    """The operating point of the logged dispatch under a model-to-tier map; an unknown model is tier 2."""
    tiers = tier_map.select("model", F.col("tier").alias("_t"))
    return operating_point(df.join(tiers, "model", "left").withColumn("tier", F.coalesce("_t", F.lit(2))).drop("_t"))


def matched_points(points: DataFrame, target: float, on: str = "cost_share") -> DataFrame:
    """The swept point nearest to a budget or quality."""
    order = F.struct(F.abs(F.col(on) - target), "point")
    return points.agg(F.min_by(F.struct(*points.columns), order).alias("p")).select("p.*")


def bootstrap_point(df: DataFrame, n: int = 2000, id_col: str = "trajectory_id") -> DataFrame:
    """Mean and 95 % interval of served and cost share over ``n`` resamples with Poisson weights."""
    from .offpolicy import replicate_sums

    rows = df.select(id_col, (F.col("tier") >= F.col("difficulty")).cast("double").alias("ok"), own_cost().alias("own"), F.col("c3").alias("top"))
    each = replicate_sums(rows, [], ["ok", "own", "top"], n, id_col).select((F.col("ok") / F.col("w")).alias("served"), (F.col("own") / F.col("top")).alias("cost_share"))
    return each.agg(*[f(c).alias(f"{c}_{k}") for c in ("served", "cost_share") for k, f in (("mean", F.avg), ("low", lambda c: F.percentile(c, 0.025)), ("high", lambda c: F.percentile(c, 0.975)))])
