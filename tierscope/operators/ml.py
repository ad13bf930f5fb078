"""Folds, relational TF-IDF, ordinal heads, out-of-fold predictions and model selection on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .boosting import fit_boosted
from .evaluate import class_report
from .ranks import fold_ranks, melt, quantiles
from .scoring import cuts_by_fold, cuts_known_marginals, score_of
from .termhash import repeated_ids
from .textsvd import fit_svd, sparse_rows, with_slots

Fitter = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def group_folds(df: DataFrame, group: str, k: int = 5, mode: str = "hash", out: str = "fold") -> DataFrame:
    """``df`` with a fold that keeps groups whole.

    ``hash`` deals groups by md5. ``balanced`` deals them by falling size, to and fro over the
    folds; both use no more folds than there are groups.
    """
    if mode == "hash":
        fold = F.pmod(F.conv(F.substring(F.md5(F.col(group).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
        return df.withColumn(out, F.coalesce(fold, F.lit(0)))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1
    kinds = sizes.withColumn("_p", place).crossJoin(F.broadcast(sizes.agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_k"))))
    lap, at = F.floor(F.col("_p") / F.col("_k")), F.col("_p") % F.col("_k")
    dealt = kinds.select(F.col(group).alias("_g"), F.when(lap % 2 == 0, at).otherwise(F.col("_k") - 1 - at).cast("int").alias(out))
    return df.join(dealt, df[group].eqNullSafe(dealt["_g"])).drop("_g")


def _terms(df: DataFrame, text: str, analyzer: str, ngrams: tuple[int, int], id_col: str, once: bool = False) -> DataFrame:
    """(id, term): every occurrence, or ``once`` for each row. The words are a column of their own, so runs over them don't split the text again."""
    lo, hi = ngrams
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    if analyzer == "word":
        words = text_words(text)
        made = [_word_runs(F.col("_words"), n) for n in range(lo, hi + 1)]
    else:
        words = F.transform(F.filter(F.split(lower, r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        words = F.array_distinct(words) if once else words
        made = [F.flatten(F.transform("_words", _char_runs(n))) for n in range(lo, hi + 1)]
    terms = F.array_distinct(F.concat(*made)) if once else F.concat(*made)
    return df.select(id_col, words.alias("_words")).select(id_col, F.explode(terms).alias("term"))


def text_words(text: str) -> Column:
    """The words of two characters and more of a text column, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\W+"), lambda w: F.length(w) >= 2)


def _word_runs(words: Column, n: int) -> Column:
    """Runs of ``n`` words, each built by joining the run before with the word behind it."""
    runs = words
    for k in range(1, n):
        left = F.greatest(F.size(words) - k, F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(words, F.lit(k + 1), left), lambda a, b: F.concat(a, F.lit(" "), b))
    return runs


def _char_runs(n: int):
    """Runs of ``n`` characters of a padded word; a shorter word is one run."""
    return lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))


def term_counts(df: DataFrame, text: str, ngrams: tuple[int, int] = (1, 2), analyzer: str = "word", id_col: str = "id") -> DataFrame:
    """(id, term, tf), written: the fit and the weights read it instead of splitting the texts again."""
    return written(_terms(df, text, analyzer, ngrams, id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")), "terms")


def _document_frequencies(df: DataFrame, text: str, ngrams: tuple[int, int], analyzer: str, id_col: str) -> DataFrame:
    """(term, df): a text's distinct terms are found in its row, so only each task's sums move; texts of one id count once."""
    many, rows = repeated_ids(df, id_col), df
    if many is not None:
        rows = df.join(many, df[id_col].eqNullSafe(many["_id"]), "left_anti")
    found = _terms(rows, text, analyzer, ngrams, id_col, once=True).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if many is None:
        return found
    again = _terms(df.join(many, df[id_col].eqNullSafe(many["_id"]), "left_semi"), text, analyzer, ngrams, id_col, once=True)
    return found.unionByName(again.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))


def tfidf_fit(df: DataFrame, text: str, ngrams: tuple[int, int] = (1, 2), analyzer: str = "word", min_df: int = 2, max_features: int | None = None, id_col: str = "id", counts: DataFrame | None = None) -> DataFrame:
    """(term, idf): ln((1+n)/(1+df))+1 of terms in ``min_df`` texts or more, the most frequent ``max_features`` of them."""
    if counts is None and not max_features:
        tally = _document_frequencies(df, text, ngrams, analyzer, id_col).filter(F.col("df") >= min_df)
    else:
        counts = counts if counts is not None else _terms(df, text, analyzer, ngrams, id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
        tally = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if max_features:
        tally = tally.orderBy(F.desc("total"), "term").limit(max_features)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return tally.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, text: str, fit: DataFrame, ngrams: tuple[int, int] = (1, 2), analyzer: str = "word", id_col: str = "id", counts: DataFrame | None = None) -> DataFrame:
    """(id, term, weight): sublinear term frequency times idf, each text scaled to length 1."""
    counts = counts if counts is not None else _terms(df, text, analyzer, ngrams, id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = counts.join(fit.select("term", "idf"), "term").select(id_col, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / length).alias("weight"))


def hashed_vectors(weights: DataFrame, width: int = 1024, id_col: str = "id") -> DataFrame:
    """(id, text_vec): sparse vectors of the weights summed by hashed term."""
    slots = weights.groupBy(id_col, F.pmod(F.xxhash64("term"), F.lit(width)).cast("int").alias("slot")).agg(F.sum("weight").alias("w"))
    packed = slots.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return packed.select(id_col, array_to_vector(dense).alias("text_vec"))


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


def fold_features(df: DataFrame, features: list[str], keep: list[str], fold: str = "fold", id_col: str = "trajectory_id") -> DataFrame:
    """(id, test, keep, fold, features), written: every row for each test fold, with its ranks among the rows of all other folds.

    Cross-validation takes a fold's training rows where ``fold`` differs from ``test`` and its
    test rows where they are equal; both are ranked by the same steps, which no test row moves.
    """
    rows = written(df.select(id_col, fold, *keep, *features), "fold-rows")
    long = fold_ranks(melt(rows, [id_col, fold], features), fold)
    wide = long.groupBy(id_col, "test").pivot("feature", features).agg(F.max("rank"))
    return written(assembled(wide, features).select(id_col, "test", "features").join(rows.select(id_col, fold, *keep), id_col), "fold-ranks")


def sides(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) of one test fold; of :func:`fold_features` those with its ranks."""
    own = df.filter(F.col("test") == k).drop("test") if "test" in df.columns else df
    return own.filter(F.col(fold) != k), own.filter(F.col(fold) == k)


def each_fold(df: DataFrame, run: Callable[[int], DataFrame], fold: str = "fold", at_once: int = 4) -> DataFrame:
    """The union of ``run(k)`` over all folds; a few folds are fitted side by side, since each has many small jobs."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    with ThreadPoolExecutor(at_once) as pool:
        made = [f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(run), k) for k in folds]]
    return reduce(DataFrame.unionByName, made)


def _logistic(c: float, n: int, **options) -> LogisticRegression:
    """``c`` is an inverse penalty on the summed loss; Spark penalises the mean loss."""
    return LogisticRegression(featuresCol="features", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=50, **options)


def fit_ordinal(train: DataFrame, c: float = 1.0, label: str = "difficulty", make=None) -> Callable[[DataFrame], DataFrame]:
    """Two cumulative binary models; a frame -> with p_d1 <= p_d2. A fold with one class gives a constant."""
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high")).first()
    models = []
    for k in (1, 2):
        if seen["n"] == 0 or seen["low"] > k or seen["high"] <= k:
            models.append(float(seen["n"] > 0 and seen["high"] <= k))
        else:
            models.append((make() if make else _logistic(c, seen["n"])).fit(train.withColumn("label", (F.col(label) <= k).cast("double"))))

    def apply(df: DataFrame) -> DataFrame:
        for k, m in ((1, models[0]), (2, models[1])):
            if isinstance(m, float):
                df = df.withColumn(f"p_d{k}", F.lit(m))
            else:
                df = m.transform(df).withColumn(f"p_d{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        return df.withColumn("p_d1", F.least("p_d1", "p_d2"))

    return apply


def fit_multinomial(train: DataFrame, c: float = 1.0, label: str = "difficulty", weight: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """One softmax model; an absent class has probability 0. ``weight`` may be ``balanced`` or a column."""
    rows = train.withColumn("label", (F.col(label) - 1).cast("double"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total, options = sum(sizes.values()), {}
    if weight == "balanced":
        share = F.element_at(F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, total / (len(sizes) * n))]), F.col("label"))
        rows, options["weightCol"] = rows.withColumn("_w", share), "_w"
    elif weight:
        mean = rows.agg(F.avg(weight)).first()[0] or 1.0
        rows, options["weightCol"] = rows.withColumn("_w", F.col(weight) / float(mean)), "_w"
    constant = next(iter(sizes), 0.0) if len(sizes) < 2 else None
    model = None if constant is not None else _logistic(c, total, family="multinomial", **options).fit(rows)

    def apply(df: DataFrame) -> DataFrame:
        if model is None:
            return df.withColumn("p_d1", F.lit(float(constant <= 0))).withColumn("p_d2", F.lit(float(constant <= 1)))
        p = vector_to_array("probability")
        first, second = F.coalesce(F.get(p, F.lit(0)), F.lit(0.0)), F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))
        return model.transform(df).withColumn("p_d1", first).withColumn("p_d2", first + second).drop("rawPrediction", "probability", "prediction")

    return apply


def _balanced(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """``df`` with ``_w``: rows of each class weigh as much as those of any other."""
    sizes = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(F.broadcast(sizes), [*by, label]).withColumn("_w", 1.0 / F.col("_c"))  # a row for each class and fold


def _cumulative(df: DataFrame, scores: Column) -> DataFrame:
    """``df`` with p_d1 and p_d2 from an array of three raw class scores."""
    rows = df.withColumn("_s", scores)
    e = [F.exp(F.col("_s")[k] - F.array_max("_s")) for k in range(3)]
    total = e[0] + e[1] + e[2]
    return rows.withColumn("p_d1", e[0] / total).withColumn("p_d2", (e[0] + e[1]) / total).drop("_s")


def fit_gbt(train: DataFrame, label: str = "difficulty", balanced: bool = False, depth: int = 3, rounds: int = 200) -> Callable[[DataFrame], DataFrame]:
    """Boosted trees on the three classes."""
    rows = train.withColumn("_y", F.col(label) - 1)
    model = fit_boosted(_balanced(rows, [], label) if balanced else rows, ["_y"], loss="multinomial", weight="_w" if balanced else None, rounds=rounds, depth=depth)
    return lambda df: _cumulative(df, model.predict(F.col("features")))


def oof_boosted(df: DataFrame, fold: str = "fold", label: str = "difficulty", balanced: bool = False, rounds: int = 200) -> DataFrame:
    """The test rows of :func:`fold_features` with p_d1 and p_d2 of boosted trees; all folds' models grow side by side."""
    train = df.filter(F.col(fold) != F.col("test")).withColumn("_y", F.col(label) - 1)
    model = fit_boosted(_balanced(train, ["test"], label) if balanced else train, ["_y"], model="test", loss="multinomial", weight="_w" if balanced else None, rounds=rounds)
    return _cumulative(df.filter(F.col(fold) == F.col("test")), model.predict(F.col("features"), F.col("test").cast("long")))


def svd_text_head(train: DataFrame, counts: DataFrame, ranks: str | None = "features", dims: int = 80, c: float = 1.0, label: str = "difficulty", id_col: str = "trajectory_id", min_df: int = 3, max_features: int = 20_000) -> Callable[[DataFrame], DataFrame]:
    """Texts reduced to ``dims`` and scaled to length 1, beside the vector of ``ranks`` if there is one, into an ordinal head.

    ``counts`` are the :func:`term_counts` of training and test rows alike; vocabulary, inverse
    frequencies and reduction are fitted on the training rows. Rows without a known term are zeros.
    """
    own = lambda df: counts.join(df.select(id_col), id_col, "left_semi")
    slots = with_slots(tfidf_fit(train, "", min_df=min_df, max_features=max_features, id_col=id_col, counts=own(train)), max_features)
    packed = lambda df: sparse_rows(tfidf(df, "", slots, id_col=id_col, counts=own(df)), slots, id_col)
    rows = packed(train)
    svd = fit_svd(rows, slots.count(), dims)

    def reduced(df: DataFrame, rows: DataFrame) -> DataFrame:
        text = svd.transform(df.select(id_col).join(rows, id_col, "left"), "_u", unit=True).select(id_col, array_to_vector("_u").alias("_u"))
        wide = df.join(text, id_col)
        wide = wide.withColumnRenamed(ranks, "_ranks") if ranks else wide.drop("features")
        return assembled(wide, ["_u", *(["_ranks"] if ranks else [])])

    head = fit_ordinal(written(reduced(train, rows), "svd-train"), c, label)

    def apply(df: DataFrame) -> DataFrame:
        made = head(reduced(df, packed(df)))
        return (made.drop("features").withColumnRenamed("_ranks", ranks) if ranks else made).drop("_u")

    return apply


def oof_probs(df: DataFrame, fitter: Fitter, fold: str = "fold", id_col: str = "trajectory_id") -> DataFrame:
    """``df`` with p_d1 and p_d2 from models that did not see the row's fold."""

    def one(k: int) -> DataFrame:
        train, own = sides(df, k, fold)
        return fitter(train)(own)

    return each_fold(df, one, fold)


def oof_costs(df: DataFrame, tier_prices: DataFrame, fold: str = "fold", id_col: str = "trajectory_id", depth: int = 3, rounds: int = 200) -> DataFrame:
    """(id, c1, c2, c3) from sizes predicted at routing time: boosted regressors of their logarithms for each fold, all side by side.

    ``df`` comes from :func:`fold_features`, or holds features that were not fitted on any rows.
    """
    from .costs import tier_costs

    targets = ("context_tokens", "gen_tokens", "n_llm_calls")
    if "test" not in df.columns:
        df = df.crossJoin(F.broadcast(df.select(F.col(fold).alias("test")).distinct()))
    train = df.filter(F.col(fold) != F.col("test")).select("features", "test", *[F.log1p(t).alias(f"_{t}") for t in targets])
    model = fit_boosted(train, [f"_{t}" for t in targets], model="test", rounds=rounds, depth=depth)
    own = df.filter(F.col(fold) == F.col("test")).select(id_col, model.predict(F.col("features"), F.col("test").cast("long")).alias("_s"))
    sized = own.select(id_col, *[F.greatest(F.expm1(F.col("_s")[i]), F.lit(1.0 if t == "n_llm_calls" else 0.0)).alias(t) for i, t in enumerate(targets)])
    return tier_costs(sized, tier_prices, id_col=id_col)


def stack(df: DataFrame, level0: dict[str, Fitter], fold: str = "fold", inner: int = 4, group: str = "workspace", id_col: str = "trajectory_id") -> DataFrame:
    """Nested stacking: inner out-of-fold probabilities of every level-0 model train a meta model; both see outer-train rows only."""
    names = [f"{n}_{p}" for n in level0 for p in ("p_d1", "p_d2")]

    def widened(base: DataFrame, predict: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
        for n, f in predict.items():
            base = f(base).withColumnRenamed("p_d1", f"{n}_p_d1").withColumnRenamed("p_d2", f"{n}_p_d2")
        return base

    def one(k: int) -> DataFrame:
        rows, own = sides(df, k, fold)
        train = meta = group_folds(rows, group, inner, out="_inner")
        for n, fitter in level0.items():
            inside = oof_probs(train, fitter, "_inner").select(id_col, F.col("p_d1").alias(f"{n}_p_d1"), F.col("p_d2").alias(f"{n}_p_d2"))
            meta = meta.join(inside, id_col)
        head = fit_multinomial(written(assembled(meta.drop("features"), names), "stack"))
        test = widened(own, {n: fitter(train) for n, fitter in level0.items()})
        return head(assembled(test.drop("features"), names)).select(*own.drop("features").columns, "p_d1", "p_d2")

    return each_fold(df, one, fold, 2)


def ladder(df: DataFrame, fitters: dict[str, Fitter], fold: str = "fold", label: str = "difficulty") -> DataFrame:
    """(method, exact, balanced, adjacent, d3_recall, exact_known): every candidate under one protocol, with fold cuts and known-marginal cuts."""
    out = None
    for name, fitter in fitters.items():
        scored = written(oof_probs(df, fitter, fold).select(fold, label, F.round(score_of(F.col("p_d1"), F.col("p_d2")), 12).alias("score")), "oof")
        known = class_report(cuts_known_marginals(scored, "score", label), label=label).select(F.col("exact").alias("exact_known"))
        own = class_report(cuts_by_fold(scored, "score", label, fold), label=label).crossJoin(known).select(F.lit(name).alias("method"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def text_grid(df: DataFrame, channels: dict[str, str], cs: tuple[float, ...] = (1.0,), ordinal: tuple[bool, ...] = (True,), numeric: str | None = None, fold: str = "fold") -> DataFrame:
    """The ladder over text vectors (name -> column) x inverse penalties x heads, with or without numeric ranks."""
    fitters: dict[str, Fitter] = {}
    for name, column in channels.items():
        for c in cs:
            for cumulative in ordinal:
                cols = [column, *(["_numeric"] if numeric else [])]

                def fitter(train: DataFrame, cols=cols, c=c, cumulative=cumulative):
                    prepared = lambda d: assembled((d.withColumnRenamed(numeric, "_numeric") if numeric else d).drop("features"), cols)
                    made = (fit_ordinal if cumulative else fit_multinomial)(prepared(train), c)
                    return lambda test: made(prepared(test))

                fitters[f"{name} C={c} {'ordinal' if cumulative else 'multinomial'}"] = fitter
    return ladder(df, fitters, fold)


def nested_selection(df: DataFrame, grid: dict[str, Fitter], group: str = "workspace", outer: int = 5, inner: int = 4, label: str = "difficulty", id_col: str = "trajectory_id") -> tuple[DataFrame, DataFrame]:
    """(outer predictions with tiers, pooled score of every configuration).

    For each outer fold, inner folds of its training rows pick the configuration and give the
    scores that its cuts come from; the outer rows only score.
    """
    df = written(group_folds(df, group, outer), "outer")

    def one(k: int) -> tuple[DataFrame, list[tuple[int, str, float]]]:
        train = written(group_folds(df.filter(F.col("fold") != k).drop("fold"), group, inner), "inner")
        best, kept, picks = None, None, []
        for name, fitter in grid.items():
            scored = written(oof_probs(train, fitter).select("fold", label, F.round(score_of(F.col("p_d1"), F.col("p_d2")), 12).alias("score")), "oof")
            exact = float(class_report(cuts_by_fold(scored, "score", label, "fold"), label=label).first()["exact"] or 0)
            picks.append((k, name, exact))
            if best is None or exact > best[0]:
                best, kept = (exact, name, fitter), scored
        shares = kept.agg(F.avg((F.col(label) == 1).cast("double")).alias("a"), F.avg((F.col(label) <= 2).cast("double")).alias("b")).first()
        q1, q2 = quantiles(kept, "score", [shares["a"], shares["b"]]).first()[0]
        own = best[2](train)(df.filter(F.col("fold") == k)).withColumn("score", F.round(score_of(F.col("p_d1"), F.col("p_d2")), 12))
        return own.withColumn("tier", F.when(F.col("score") <= q1, 1).when(F.col("score") <= q2, 2).otherwise(3)).withColumn("method", F.lit(best[1])), picks

    told: list[tuple[int, str, float]] = []

    def predictions(k: int) -> DataFrame:
        own, picks = one(k)
        told.extend(picks)
        return own

    out = each_fold(df, predictions, at_once=2)
    picks = df.sparkSession.createDataFrame(told, "fold int, method string, exact double")
    return out, picks.groupBy("method").agg(F.avg("exact").alias("exact"))
