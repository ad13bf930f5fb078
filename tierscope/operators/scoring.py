"""Composite scores, difficulty grades and dispatch rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import written
from .ranks import melt, over, quantile_cut, quantiles, self_rank

# ---- fixed values -------------------------------------------------------------
GROUPS = {
    "ask": (1, ("usr_n_pii_refs", "usr_n_questions", "usr_n_action_verbs", "usr_n_coord_markers", "usr_n_urls", "usr_tokens", "usr_n_attachments", "usr_audio", "usr_has_image", "usr_n_code_fences")),
    "harness": (1, ("sys_n_sections", "sys_n_flags", "sys_n_skills", "sys_tokens", "tool_subagent")),
    "breadth": (-1, ("n_tools", "tools_tokens", "tool_background", "tool_memory_search")),
    "midthread": (-1, ("usr_truncated_ctx", "usr_n_ctx_blocks", "usr_n_parts", "trig_thread_activity")),
}
EXTRA_FEATURES = ("usr_n_words", "usr_n_lines", "usr_n_bullets", "usr_n_todo", "usr_n_deliverable_kw", "usr_n_file_ext", "usr_n_numbers", "usr_has_deadline", "usr_exclaim", "usr_sys_ratio", "tool_has_bash", "tool_has_write", "tools_n_params", "trig_slack", "trig_teams", "trig_scheduled", "usr_has_attachment", "tool_slack", "tool_msteams")
GROUP_WEIGHTS = {"ask": 1.5, "harness": 0.7, "breadth": 0.8, "midthread": 0.8}
METRIC_WEIGHTS = {"n_tool_calls": 0.22, "n_llm_calls": 0.18, "gen_tokens": 0.16, "context_tokens": 0.10, "n_tool_errors": 0.10, "n_distinct_tools": 0.08, "tool_output_tokens": 0.06, "max_repeat_streak": 0.04, "n_user_turns": 0.03, "reasoning_tokens": 0.03}
POLICY_SENSITIVE = ("n_tool_errors", "max_repeat_streak")
CUTS = (0.55, 0.85)
OVERRIDES = {"n_tool_errors": 5, "n_tool_calls": 40}
ALPHA, TAU, LAMBDA = 0.85, 0.80, 0.3
# -------------------------------------------------------------------------------


def group_table(spark, groups: dict | None = None, weights: dict | None = None) -> DataFrame:
    """(feature, grp, sign, weight): one row for each feature of the composite."""
    groups, weights = groups or GROUPS, GROUP_WEIGHTS | (weights or {})
    rows = [(f, g, sign, float(weights[g])) for g, (sign, names) in groups.items() for f in names]
    return spark.createDataFrame(rows, "feature string, grp string, sign int, weight double")


def composite_score(ranks: DataFrame, groups: DataFrame, id_col: str = "trajectory_id", normalize: bool = True) -> DataFrame:
    """(id, composite): signed weighted mean over groups of the mean rank in each; spread over 0 to 1 when normalized."""
    joined = ranks.join(F.broadcast(groups), "feature")
    by_group = joined.groupBy(id_col, "grp", "sign", "weight").agg(F.avg("rank").alias("mean_rank"))
    total = groups.select("grp", "weight").distinct().agg(F.sum("weight").alias("total"))
    score = by_group.groupBy(id_col).agg(F.sum(F.col("sign") * F.col("weight") * F.col("mean_rank")).alias("signed")).crossJoin(F.broadcast(total)).select(id_col, (F.col("signed") / F.col("total")).alias("composite"))
    if not normalize:
        return score
    span = score.agg(F.min("composite").alias("lo"), F.max("composite").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("composite") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("composite"))
    return score.crossJoin(F.broadcast(span)).select(id_col, scaled.alias("composite"))


def _difficulty(metrics: DataFrame, weights: dict | None, residual_tier: str | None, id_col: str) -> DataFrame:
    """(id, score), written."""
    w = METRIC_WEIGHTS | (weights or {})
    ids = [id_col, *([residual_tier] if residual_tier else [])]
    ranks = self_rank(melt(metrics, ids, list(w)))
    if residual_tier:
        ranks = written(ranks, "ranks")
        medians = quantiles(ranks.filter(F.col("feature").isin(*POLICY_SENSITIVE)), "rank", (0.5,), ("feature", residual_tier)).select("feature", residual_tier, F.get("_q", F.lit(0)).alias("mid"))
        ranks = ranks.join(medians, ["feature", residual_tier], "left")
        ranks = ranks.withColumn("rank", F.when(F.col("mid").isNull(), F.col("rank")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rank") - F.col("mid") + 0.5))))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in w.items() for x in kv]), F.col("feature"))
    # The sum's order varies; scores that are equal must also compare equal.
    return written(ranks.groupBy(id_col).agg(F.round(F.sum(F.col("rank") * weight) / sum(w.values()), 12).alias("score")), "difficulty")


def difficulty_score(metrics: DataFrame, weights: dict | None = None, residual_tier: str | None = None, id_col: str = "trajectory_id") -> DataFrame:
    """``metrics`` with ``score``, the weighted mean of metric ranks.

    With ``residual_tier``, the ranks of policy-sensitive metrics lose the median of their
    tier, are centred on 0.5 and clipped to 0..1.
    """
    return metrics.join(_difficulty(metrics, weights, residual_tier, id_col), id_col)


def overridden(tier: Column, limits: dict | None = None) -> Column:
    """``tier``, or 3 for rows at a limit of :data:`OVERRIDES`."""
    hard = F.lit(False)
    for name, least in (OVERRIDES if limits is None else limits).items():
        hard = hard | (F.col(name) >= least)
    return F.when(hard, 3).otherwise(tier)


def grade(metrics: DataFrame, weights: dict | None = None, cuts: tuple[float, float] = CUTS, overrides: dict | None = None, residual_tier: str | None = None, id_col: str = "trajectory_id") -> DataFrame:
    """``metrics`` with ``score`` and ``difficulty`` (1 to 3); rows at an override's threshold are 3."""
    scores = _difficulty(metrics, weights, residual_tier, id_col)
    graded = quantile_cut(metrics.join(scores, id_col), "score", cuts, out="difficulty", scores=scores)
    return graded.withColumn("difficulty", overridden(F.col("difficulty"), overrides))


def _blended(df: DataFrame, ml: str, heuristic: str, alpha: float, id_col: str, out: str) -> DataFrame:
    """(id, blend), written."""
    ranks = self_rank(melt(df, [id_col], [ml, heuristic]))
    return written(ranks.groupBy(id_col).agg(F.round(F.sum(F.when(F.col("feature") == ml, F.lit(alpha) * F.col("rank")).otherwise((1 - alpha) * F.col("rank"))), 12).alias(out)), "blend")


def blend(df: DataFrame, ml: str, heuristic: str, alpha: float = ALPHA, id_col: str = "trajectory_id", out: str = "blend") -> DataFrame:
    """``df`` with alpha x rank of one score + (1 - alpha) x rank of the other."""
    return df.join(_blended(df, ml, heuristic, alpha, id_col, out), id_col)


def blend_tiers(df: DataFrame, ml: str, heuristic: str, alpha: float = ALPHA, cuts: tuple[float, float] = CUTS, id_col: str = "trajectory_id") -> DataFrame:
    """``df`` with ``blend`` and the ``tier`` that its quantiles give."""
    mixed = _blended(df, ml, heuristic, alpha, id_col, "blend")
    return quantile_cut(df.join(mixed, id_col), "blend", cuts, scores=mixed)


def score_of(p1: Column, p2: Column) -> Column:
    """Expected-difficulty score of cumulative probabilities P(D<=1), P(D<=2)."""
    return 1 - (p1 + p2) / 2


def dispatch_tau(df: DataFrame, tau: float | Column = TAU, p1: str = "p_d1", p2: str = "p_d2", out: str = "tier") -> DataFrame:
    """The cheapest tier whose probability of sufficing reaches ``tau``."""
    return df.withColumn(out, F.when(F.col(p1) >= tau, 1).when(F.col(p2) >= tau, 2).otherwise(3))


def _least(a: Column, b: Column, c: Column) -> Column:
    return F.when((a <= b) & (a <= c), 1).when(b <= c, 2).otherwise(3)


def dispatch_lambda(df: DataFrame, lam: float | Column = LAMBDA, costs: tuple[str, str, str] = ("c1", "c2", "c3"), sized: bool = False, p1: str = "p_d1", p2: str = "p_d2", out: str = "tier") -> DataFrame:
    """The tier of least cost plus lambda x probability of falling short; ties to the cheaper.

    ``costs`` are the columns the rule sees: predicted ones, or the realized ones for an
    oracle. ``sized`` scales the penalty with the task's own top-tier cost.
    """
    c1, c2, c3 = (F.col(c) for c in costs)
    weight = (lam if isinstance(lam, Column) else F.lit(lam)) * (c3 if sized else F.lit(1.0))
    return df.withColumn(out, _least(c1 + weight * (1 - F.col(p1)), c2 + weight * (1 - F.col(p2)), c3))


def class_probabilities(df: DataFrame, p1: str = "p_d1", p2: str = "p_d2") -> tuple[Column, Column, Column]:
    return F.col(p1), F.col(p2) - F.col(p1), 1 - F.col(p2)


def dispatch_argmax(df: DataFrame, p1: str = "p_d1", p2: str = "p_d2", out: str = "tier") -> DataFrame:
    a, b, c = class_probabilities(df, p1, p2)
    return df.withColumn(out, F.when((a >= b) & (a >= c), 1).when(b >= c, 2).otherwise(3))


def dispatch_expected_l1(df: DataFrame, p1: str = "p_d1", p2: str = "p_d2", out: str = "tier") -> DataFrame:
    """The tier of least expected absolute distance from the difficulty."""
    a, b, c = class_probabilities(df, p1, p2)
    return df.withColumn(out, _least(b + 2 * c, a + c, 2 * a + b))


def average_probs(a: DataFrame, b: DataFrame, w: float, id_col: str = "trajectory_id") -> DataFrame:
    """w x first + (1 - w) x second source of (p_d1, p_d2)."""
    other = b.select(id_col, F.col("p_d1").alias("_q1"), F.col("p_d2").alias("_q2"))
    return a.join(other, id_col).withColumn("p_d1", w * F.col("p_d1") + (1 - w) * F.col("_q1")).withColumn("p_d2", w * F.col("p_d2") + (1 - w) * F.col("_q2")).drop("_q1", "_q2")


def _interpolated(df: DataFrame, score: str, shares: DataFrame, by: list[str]) -> DataFrame:
    """(by, q1, q2): quantiles of ``score`` at data-driven shares (by, p1, p2), linear between neighbours."""
    own = shares.select(*by, F.array("p1", "p2").alias("shares"))
    return quantiles(df, score, own, tuple(by)).select(*by, F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("q2"))


def _marginals(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.avg((F.col(label) == 1).cast("double")).alias("p1"), F.avg((F.col(label) <= 2).cast("double")).alias("p2"))


def cuts_known_marginals(df: DataFrame, score: str, label: str, out: str = "tier") -> DataFrame:
    """Tiers cut at the label mix of all rows. Uses every label, so it is an oracle's figure."""
    q = _interpolated(df, score, _marginals(df, label, []), [])
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.when(F.col(score) <= F.col("q1"), 1).when(F.col(score) <= F.col("q2"), 2).otherwise(3)).drop("q1", "q2")


def cuts_by_fold(df: DataFrame, score: str, label: str, fold: str, out: str = "tier") -> DataFrame:
    """Tiers cut at the label mix and score quantiles of the other folds."""
    folds = df.select(F.col(fold).alias("_test")).distinct()
    train = df.select(fold, score, label).join(F.broadcast(folds), F.col(fold) != F.col("_test"))  # a row a fold
    q = _interpolated(train, score, _marginals(train, label, ["_test"]), ["_test"]).withColumnRenamed("_test", fold)
    return over(df, q, [fold]).withColumn(out, F.when(F.col(score) <= F.col("q1"), 1).when(F.col(score) <= F.col("q2"), 2).otherwise(3)).drop("q1", "q2")


def blend_by_fold(df: DataFrame, ml: str, heuristic: str, label: str, fold: str, alpha: float = 0.5, id_col: str = "trajectory_id") -> DataFrame:
    """``df`` with an even blend of both scores' ranks and the ``tier`` that the other folds' labels and blends give."""
    return cuts_by_fold(blend(df, ml, heuristic, alpha, id_col), "blend", label, fold)


def cluster_tiers(df: DataFrame, features: list[str], score: str, method: str = "kmeans", seed: int = 13, weights: dict | None = None, fit_on: Column | None = None) -> DataFrame:
    """``df`` with ``tier``: three clusters of the (weighted) features, ordered by their mean score on the fitted rows; an empty cluster comes last."""
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.feature import VectorAssembler

    scaled = [(F.col(f) * float((weights or {}).get(f, 1.0))).alias(f"_f{i}") for i, f in enumerate(features)]
    made = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(df.select("*", *scaled))
    train = made.filter(fit_on) if fit_on is not None else made
    kind = KMeans(k=3, seed=seed, featuresCol="_x", predictionCol="_c") if method == "kmeans" else GaussianMixture(k=3, seed=seed, featuresCol="_x", predictionCol="_c", probabilityCol="_p")
    model = kind.fit(train.cache())
    means = {r["_c"]: r["m"] for r in model.transform(train).groupBy("_c").agg(F.avg(score).alias("m")).collect()}
    order = sorted(range(3), key=lambda c: (c not in means, means.get(c, 0.0)))
    train.unpersist()
    tier = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i + 1)]), F.col("_c").cast(T.IntegerType()))
    return model.transform(made).withColumn("tier", tier).drop("_x", "_c", "_p", *[f"_f{i}" for i in range(len(features))])
