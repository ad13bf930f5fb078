"""Fit once, apply to new batches and streams without refitting."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, scoring
from ..operators.ml import assembled
from ..operators.ranks import apply_ecdf, fit_ecdf, melt, quantiles, self_rank
from ..sources.tables import written

METHODS = ("blend", "score", "ml-tau", "ml-lambda")
SIZES = ("context_tokens", "gen_tokens", "n_llm_calls")


@dataclass
class Frozen:
    """Fitted ECDF steps, cuts and models.

    ``ecdf``: (kind, feature, value, upto, below, total, distinct) with kinds feature, metric,
    composite and ml; ``cuts``: (kind, q1, q2) of tier scores and difficulty.
    """

    ecdf: DataFrame
    cuts: DataFrame
    features: list[str]
    groups: DataFrame
    heads: list[PipelineModel]
    sizes: dict[str, PipelineModel]
    prices: DataFrame

    def _ecdf(self, kind: str) -> DataFrame:
        return self.ecdf.filter(F.col("kind") == kind).drop("kind")

    def ranks(self, df: DataFrame, id_col: str = "trajectory_id") -> DataFrame:
        return written(apply_ecdf(melt(df, [id_col], self.features), self._ecdf("feature")), "frozen-ranks")

    def _cut(self, df: DataFrame, score: str, kind: str, out: str) -> DataFrame:
        q = F.broadcast(self.cuts.filter(F.col("kind") == kind).select("q1", "q2"))
        return df.crossJoin(q).withColumn(out, F.when(F.col(score) <= F.col("q1"), 1).when(F.col(score) <= F.col("q2"), 2).otherwise(3)).drop("q1", "q2")

    def _scored(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, features, composite, p_d1, p_d2, ml), written."""
        long = self.ranks(df, id_col)
        rows = _with_composite(long, self.features, self.groups, id_col)
        return written(_with_probabilities(assembled(rows, self.features), self.heads), "frozen-scores")

    def route(self, df: DataFrame, method: str = "blend", id_col: str = "trajectory_id") -> DataFrame:
        """(id, composite, p_d1, p_d2, blend, tier) of new rows."""
        rows = self._scored(df, id_col)
        both = apply_ecdf(melt(rows, [id_col], ["composite", "ml"]), self._ecdf("score")).groupBy(id_col).agg(F.round(F.sum(F.when(F.col("feature") == "ml", scoring.ALPHA * F.col("rank")).otherwise((1 - scoring.ALPHA) * F.col("rank"))), 12).alias("blend"))
        rows = rows.join(both, id_col)
        if method == "score":
            rows = self._cut(rows, "composite", "composite", "tier")
        elif method == "ml-tau":
            rows = scoring.dispatch_tau(rows)
        elif method == "ml-lambda":
            from ..operators.costs import tier_costs

            sized = rows
            for name, model in self.sizes.items():
                sized = model.transform(sized).withColumn(name, F.greatest(F.expm1("prediction"), F.lit(1.0 if name == "n_llm_calls" else 0.0))).drop("prediction")
            rows = scoring.dispatch_lambda(rows.join(tier_costs(sized, self.prices, id_col=id_col), id_col))
        elif method == "blend":
            rows = self._cut(rows, "blend", "blend", "tier")
        else:
            raise ValueError(f"method must be one of {METHODS}")
        return rows.select(id_col, "composite", "p_d1", "p_d2", "blend", "tier")

    def grade(self, metrics: DataFrame, id_col: str = "trajectory_id") -> DataFrame:
        """Difficulty of new rows under the fitted ranks and cuts."""
        names = list(scoring.METRIC_WEIGHTS)
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in scoring.METRIC_WEIGHTS.items() for x in kv]), F.col("feature"))
        scores = apply_ecdf(melt(metrics, [id_col], names), self._ecdf("metric")).groupBy(id_col).agg(F.round(F.sum(F.col("rank") * weight) / sum(scoring.METRIC_WEIGHTS.values()), 12).alias("score"))
        graded = self._cut(metrics.join(scores, id_col), "score", "difficulty", "difficulty")
        return graded.withColumn("difficulty", scoring.overridden(F.col("difficulty")))

    def report(self, df: DataFrame, metrics: DataFrame, costs: DataFrame, method: str = "blend", id_col: str = "trajectory_id") -> DataFrame:
        """The held-out report; its rank correlation is that of the blend score whatever the method."""
        graded = self.grade(metrics, id_col).select(id_col, "difficulty", "score")
        rows = written(self.route(df, method, id_col).join(graded, id_col).join(costs, id_col), "held-out")
        return evaluate.report(rows).crossJoin(evaluate.spearman(rows, "blend", "score", id_col))

    def save(self, path: str) -> int:
        """Write the next version under ``path``; a version is whole once its number is in ``versions``."""
        spark = self.ecdf.sparkSession
        version = 1 + max(_versions(spark, path), default=0)
        to = f"{path}/{version}"
        for name, table in (("ecdf", self.ecdf), ("cuts", self.cuts), ("groups", self.groups), ("prices", self.prices), ("features", spark.createDataFrame(list(enumerate(self.features)), "i int, feature string"))):
            table.write.mode("overwrite").parquet(f"{to}/{name}")
        for k, model in enumerate(self.heads):
            model.write().overwrite().save(f"{to}/head{k}")
        for name, model in self.sizes.items():
            model.write().overwrite().save(f"{to}/size_{name}")
        spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{path}/versions")
        return version


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return []
    return [r["version"] for r in spark.read.parquet(f"{path}/versions").collect()]


def _with_composite(ranks: DataFrame, features: list[str], groups: DataFrame, id_col: str) -> DataFrame:
    """Wide ranks (id, features) with the raw composite."""
    heuristic = scoring.composite_score(ranks, groups, id_col, normalize=False).withColumn("composite", F.round("composite", 12))
    return ranks.groupBy(id_col).pivot("feature", features).agg(F.max("rank")).join(heuristic, id_col)


def _with_probabilities(rows: DataFrame, heads: list[PipelineModel]) -> DataFrame:
    for k, model in ((1, heads[0]), (2, heads[1])):
        rows = model.transform(rows).withColumn(f"p_d{k}", _second("probability")).drop("rawPrediction", "probability", "prediction")
    return rows.withColumn("p_d1", F.least("p_d1", "p_d2")).withColumn("ml", F.round(scoring.score_of(F.col("p_d1"), F.col("p_d2")), 12))


def _second(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)[1]


def freeze(df: DataFrame, metrics: DataFrame, features: list[str], groups: DataFrame, prices: DataFrame, id_col: str = "trajectory_id", c: float = 1.0, rounds: int = 20) -> Frozen:
    """Fit everything on one batch: feature and metric ECDFs, cuts, the ordinal head, size regressors.

    Every fitted table is written before anything reads it, so no later plan holds the fit.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import GBTRegressor

    long = melt(df, [id_col], features)
    graded = scoring.grade(metrics, id_col=id_col)
    rows = _with_composite(written(self_rank(long), "fit-ranks"), features, groups, id_col)
    train = written(assembled(rows.join(graded, id_col), features), "fit-rows")
    n = train.count()
    fits = [LogisticRegression(featuresCol="features", labelCol=f"_y{k}", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=50) for k in (1, 2)]
    fits += [GBTRegressor(featuresCol="features", labelCol=f"_{t}", maxDepth=3, maxIter=rounds, stepSize=0.3, seed=13) for t in SIZES]
    rows = train.select("*", *[(F.col("difficulty") <= k).cast("double").alias(f"_y{k}") for k in (1, 2)], *[F.log1p(t).alias(f"_{t}") for t in SIZES])
    with ThreadPoolExecutor(len(fits)) as pool:  # each has many small jobs
        models = [PipelineModel([m]) for m in pool.map(inheritable_thread_target(df.sparkSession)(lambda f: f.fit(rows)), fits)]
    heads, sizes = models[:2], dict(zip(SIZES, models[2:], strict=True))
    scored = written(_with_probabilities(train, heads).select(id_col, "composite", "ml"), "fit-scores")
    tagged = lambda steps, kind: steps.withColumn("kind", F.lit(kind))
    ecdf = tagged(fit_ecdf(long), "feature").unionByName(tagged(fit_ecdf(melt(metrics, [id_col], list(scoring.METRIC_WEIGHTS))), "metric")).unionByName(tagged(fit_ecdf(melt(scored, [id_col], ["composite", "ml"])), "score"))
    blended = scoring.blend(scored, "ml", "composite", id_col=id_col)
    cut = lambda rows, col, kind: quantiles(rows, col, scoring.CUTS).select(F.lit(kind).alias("kind"), F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("q2"))
    cuts = cut(scored, "composite", "composite").unionByName(cut(blended, "blend", "blend")).unionByName(cut(train, "score", "difficulty"))
    return Frozen(written(ecdf, "ecdf"), written(cuts, "cuts"), features, groups, heads, sizes, prices)


def load(spark: SparkSession, path: str, version: int | None = None) -> Frozen:
    """A saved version, by default the latest whole one."""
    at = f"{path}/{version or max(_versions(spark, path))}"
    features = [r["feature"] for r in spark.read.parquet(f"{at}/features").orderBy("i").collect()]
    sizes = {t: PipelineModel.load(f"{at}/size_{t}") for t in SIZES}
    return Frozen(spark.read.parquet(f"{at}/ecdf"), spark.read.parquet(f"{at}/cuts"), features, spark.read.parquet(f"{at}/groups"), [PipelineModel.load(f"{at}/head{k}") for k in (0, 1)], sizes, spark.read.parquet(f"{at}/prices"))
