"""Ordered passes, resampling and chain splits against the sequential rules they stand for."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierscope.operators import boosting, evaluate, ml, offpolicy, ranks, scoring, trajectories
from tierscope.plans import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_ranges(spark):
    """Small tables too are dealt over several ranges."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    told = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in told.items():
        spark.conf.set(k, v)


def test_quantiles_over_ranges(many_ranges):
    rng = np.random.default_rng(3)
    groups = {"a": rng.integers(0, 9, 200) / 4, "b": rng.normal(size=173), "c": np.array([2.0])}
    df = many_ranges.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.55, 0.85, 0.999, 1.0]
    got = {r.k: r._q for r in ranks.quantiles(df, "x", shares, ("k",)).collect()}
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, shares), rtol=0, atol=1e-12)
    every = np.concatenate(list(groups.values()))
    assert np.allclose(ranks.quantiles(df, "x", shares).first()[0], np.quantile(every, shares), rtol=0, atol=1e-12)
    assert ranks.quantiles(df.limit(0), "x", shares).first()[0] == []
    own = many_ranges.createDataFrame([("a", [0.2, 0.7]), ("b", [0.5, 0.5])], "k string, shares array<double>")
    got = {r.k: r._q for r in ranks.quantiles(df, "x", own, ("k",)).collect()}
    assert np.allclose(got["a"], np.quantile(groups["a"], [0.2, 0.7])) and np.allclose(got["b"], np.quantile(groups["b"], [0.5, 0.5]))


def test_ranks_over_ranges(many_ranges):
    rng = np.random.default_rng(4)
    fit, new = rng.integers(0, 30, 120).astype(float), rng.integers(-5, 40, 90).astype(float)
    long = lambda v: many_ranges.createDataFrame([(i, "f", x) for i, x in enumerate(v.tolist())], "id int, feature string, value double")
    steps = ranks.fit_ecdf(long(fit))
    right = {r.id: r["rank"] for r in ranks.apply_ecdf(long(new), steps).collect()}
    mid = {r.id: r["rank"] for r in ranks.apply_ecdf(long(new), steps, mid=True).collect()}
    for i, x in enumerate(new):
        assert right[i] == pytest.approx((fit <= x).mean()) and mid[i] == pytest.approx(((fit < x).mean() + (fit <= x).mean()) / 2)
    self_ = {r.id: r["rank"] for r in ranks.self_rank(long(fit)).collect()}
    assert all(self_[i] == pytest.approx((fit <= x).mean()) for i, x in enumerate(fit))
    none = ranks.apply_ecdf(long(new), steps.filter("feature = 'g'"))
    assert {r["rank"] for r in none.collect()} == {0.5}


def test_no_test_row_moves_a_training_rank(spark):
    rows = [(i, i % 3, "f", float(i * 7 % 11)) for i in range(60)]
    schema = "id int, fold int, feature string, value double"
    before = {(r.id, r.test): r["rank"] for r in ranks.fold_ranks(spark.createDataFrame(rows, schema)).collect()}
    moved = [(i, k, f, 1e6 + i if k == 1 else v) for i, k, f, v in rows]
    after = {(r.id, r.test): r["rank"] for r in ranks.fold_ranks(spark.createDataFrame(moved, schema)).collect()}
    assert all(before[i, 1] == after[i, 1] for i, k, _, _ in rows if k != 1)
    assert any(before[i, 0] != after[i, 0] for i, k, _, _ in rows if k != 0)
    for i, _, _, v in rows:
        for t in range(3):
            others = [x for _, k, _, x in rows if k != t]
            assert before[i, t] == pytest.approx(sum(x <= v for x in others) / len(others))


def test_cross_validation_reads_its_fold_ranks(spark):
    rows = ml.group_folds(A.tasks(spark, SF), "workspace", 3)
    made = ml.fold_features(rows, A.FEATURES[:3], ["workspace", "difficulty"])
    train, own = ml.sides(made, 1)
    assert "test" not in train.columns and train.filter("fold = 1").count() == 0 and own.filter("fold <> 1").count() == 0
    scored = ml.oof_probs(made, ml.fit_ordinal)
    assert scored.count() == rows.count() and scored.filter("p_d1 > p_d2").count() == 0


def test_plans_stay_flat(spark):
    """A graded table reads its source three times at most, and no plan holds the ranks' own steps."""
    from tierscope.operators import effort

    plan = scoring.grade(effort.log_metrics(A.message_rows(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("conversations.parquet") <= 3 and len(plan) < 60_000


def test_replicates_are_what_repeated_rows_give(spark):
    rows = [(i, "ab"[i % 2], float(i), None if i == 5 else float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "trajectory_id int, cell string, x double, y double").repartition(3)
    got = {(r.cell, r.replicate): (r.w, r.x, r.y) for r in offpolicy.replicate_sums(df, ["cell"], ["x", "y"], 25, block=10).collect()}
    for b in range(25):
        want = defaultdict(lambda: [0.0, 0.0, 0.0])
        for i, c, x, y in rows:
            u = int(hashlib.md5(f"{i}|{b}".encode()).hexdigest()[:8], 16) / (1 << 32)
            w = sum(u >= p for p in offpolicy._POISSON)
            want[c][0] += w
            want[c][1] += w * x
            want[c][2] += w * (y or 0)
        for c in "ab":
            assert got[c, b] == pytest.approx(tuple(want[c]))


def test_cut_points_are_those_of_each_pair(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(20) / 4, rng.randrange(1, 4), 1.0 + i % 3, 2.0 + i % 5, 9.0 + i % 7) for i in range(120)]
    df = spark.createDataFrame(rows, "trajectory_id int, score double, difficulty int, c1 double, c2 double, c3 double")
    cuts = [(0.1, 0.2), (0.3, 0.9), (0.0, 1.0), (0.5, 0.5), (1.2, 1.5)]
    for r in evaluate.cut_points(df, "score", cuts).collect():
        q = np.quantile([x[1] for x in rows], [min(c, 1.0) for c in cuts[r.point]])
        tier = [1 if x[1] <= q[0] else 2 if x[1] <= q[1] else 3 for x in rows]
        ok = [t >= x[2] for t, x in zip(tier, rows, strict=True)]
        top = sum(x[5] for x in rows)
        assert r.cost_share == pytest.approx(sum(x[2 + t] for t, x in zip(tier, rows, strict=True)) / top)
        assert r.served == pytest.approx(sum(ok) / len(rows)) and r.weighted_served == pytest.approx(sum(x[5] for x, o in zip(rows, ok, strict=True) if o) / top)


def greedy(rows):
    """Each request, by length and place, joins the chain whose tail is its longest prefix."""
    out, groups = {}, defaultdict(list)
    for pos, key, h in rows:
        groups[key].append((len(h), pos, tuple(h)))
    for own in groups.values():
        tails = []
        for _, pos, h in sorted(own):
            fits = [(len(t), -k) for k, (_, t) in enumerate(tails) if h[: len(t)] == t]
            k = -max(fits)[1] if fits else len(tails)
            tails[k:k + 1] = [(tails[k][0] if fits else pos, h)]
            out[pos] = tails[k][0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_split_is_the_greedy_one(many_ranges, seed):
    rnd = random.Random(seed)
    rows = [(pos, rnd.choice("xyz"), [rnd.choice([-1, 0, 5]) for _ in range(rnd.randrange(7))]) for pos in rnd.sample(range(10_000), 300)]
    df = many_ranges.createDataFrame(rows, "pos long, key string, hashes array<long>").withColumn("n", F.size("hashes"))
    assert {r.pos: r.head for r in trajectories.split_chains(df).collect()} == greedy(rows)


def boost_rows(spark, n=400):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    x = rng.random((n, 3))
    y, c = np.sin(6 * x[:, 0]) + (x[:, 1] > 0.6), (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.7)
    df = spark.createDataFrame([(i % 2, x[i].tolist(), float(y[i]), float(c[i])) for i in range(n)], "m int, a array<double>, y double, c double")
    return x, y, c, df.withColumn("features", array_to_vector("a"))


def test_first_split_is_the_best_of_all(spark):
    x, y, _, df = boost_rows(spark)
    model = boosting.fit_boosted(df, ["y"], rounds=1, depth=1, step=1.0)
    bins, best = boosting.binned(x), None
    for f in range(3):
        for b in range(256):
            left = bins[:, f] <= b
            if 20 <= left.sum() <= len(y) - 20:
                loss = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, f, b)
    assert (model.feature[0, 0, 0, 0], model.cut[0, 0, 0, 0]) == best[1:]
    got = np.array([r.p[0] for r in df.select(model.predict(F.col("features")).alias("p")).collect()])
    assert ((got - y) ** 2).sum() == pytest.approx(best[0])


def test_boosting_is_the_same_however_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CHECKPOINT", 2)
    x, _, c, df = boost_rows(spark)
    one, many = (boosting.fit_boosted(df.repartition(k), ["c"], model="m", loss="multinomial", rounds=6) for k in (1, 5))
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all() and np.allclose(one.leaf, many.leaf)
    bins = boosting.binned(x)
    hits = [np.mean(one.scores(bins[m::2], m).argmax(1) == c[m::2]) for m in (0, 1)]
    assert min(hits) > 0.9
    alone = boosting.fit_boosted(df.filter("m = 1"), ["c"], loss="multinomial", rounds=6)
    assert (alone.cut[0] == many.cut[1]).all()  # models side by side don't touch each other
    assert boosting.fit_boosted(df.limit(0), ["y"], rounds=2).models == []


def test_matching_in_ranges_is_the_sequential_one(spark):
    """Few and many ranges, crowds on either side, ties, one score that holds a third of the rows, rows without a score."""
    from test_operators import brute_pairs

    draw = random.Random(5)
    for n, share, decimals, gap, size in ((100, 0.5, 2, 0.05, 18), (90, 0.2, 3, 0.05, 30), (90, 0.8, 1, 0.2, 18), (60, 0.5, 6, 0.02, 1000)):
        rows = [(i, "m", round(draw.random(), decimals) if i % 3 else 0.5, 3 if draw.random() < share else draw.choice((1, 2))) for i in range(n)]
        df = spark.createDataFrame([*rows, (n, "m", None, 3), (n + 1, "m", float("nan"), 1)], "trajectory_id long, model string, score double, tier int")
        got = offpolicy.matched_pairs(df, gap, None, size=size).collect()
        scores = {r[0]: r[2] for r in rows}
        assert sorted((r.low_id, r.high_id) for r in got) == sorted(brute_pairs(rows, gap))
        assert all(r.score_gap == round(abs(scores[r.low_id] - scores[r.high_id]), 4) for r in got)
    first = offpolicy.matched_pairs(df, gap, 5).collect()
    assert [r.low_id for r in first] == [i for i, _ in brute_pairs(rows, gap)][:5]
    assert offpolicy.matched_pairs(df.limit(0), gap, None).count() == 0
    assert offpolicy.matched_pairs(df.filter("tier = 3"), gap, None).count() == 0


def test_matching_rounds_and_needs(spark, monkeypatch):
    """No more rounds than ranges, and a range asks for no more high rows ahead than it has low rows, in whole ranges."""
    from tierscope.operators import matching

    seen = []
    n, size = 160, 20
    df = spark.range(n).select("id", (F.col("id") % 7 / 7).alias("score"), (F.col("id") % 2 == 0).alias("high"))
    monkeypatch.setattr(matching, "written", lambda t, name, w=matching.written: (seen.append(w(t, name)) or seen[-1]) if name == "match-round" else w(t, name))
    matching.greedy_pairs(df, "id", "high", [], 0.3, size).count()
    placed, starts = matching._placed(df, ["score", "high", "id"], n // size)
    ranges_of = matching._Ranges(placed, starts, 0.3)
    now = ranges_of.entering()
    assert 1 <= len(seen) <= len(ranges_of.parts)
    assert max(r["count"] for r in placed.groupBy("part").count().collect()) <= 3 * size
    assert all(sum(ranges_of.of[q].high for q in ranges_of.ahead(p, now[p][0])) <= ranges_of.of[p].low + 3 * size for p in ranges_of.parts)


def test_cut_cells_match_the_rows_of_every_draw(many_ranges):
    """Sums by quantiles of many scores, made in the tasks, against a row for each score; ties, few rows, no rows, several cells and sends."""
    from tierscope.operators import draws

    rng = np.random.default_rng(8)
    n, shares = 700, [0.0, 0.1, 0.25, 0.5, 0.55, 0.85, 0.999, 1.0]
    data = [(i, float(rng.integers(0, 6)) / 4 - 0.5, float(rng.normal()), int(rng.integers(0, 3)), *map(float, rng.random(3))) for i in range(n)]
    df = many_ranges.createDataFrame(data, "id long, a double, b double, class int, c1 double, c2 double, c3 double").repartition(3)

    def scores(batch):
        every = np.arange(len(batch))
        yield 0, batch["a"].to_numpy(), every
        yield 1, np.tanh(batch["b"].to_numpy()), every
        odd = np.flatnonzero(batch["id"].to_numpy() % 2)
        yield 5, np.tanh(batch["b"].to_numpy())[odd], odd

    for counters, held in ((1 << 24, 1 << 20), (100, 10)):
        old = draws._COUNTERS, draws._HELD
        draws._COUNTERS, draws._HELD = counters, held
        try:
            got = {(r.key, r["_bin"]): r for r in draws.cut_cells(df, scores, 6, shares, -1.0, 1.0).collect()}
            assert draws.cut_cells(df.limit(0), scores, 6, shares, -1.0, 1.0).count() == 0
            lone = draws.cut_cells(df.filter("id = 4"), scores, 6, shares, -1.0, 1.0).collect()
        finally:
            draws._COUNTERS, draws._HELD = old
        assert {(r.key, r["_bin"], r.n) for r in lone} == {(0, 0, 1.0), (1, 0, 1.0)}
        want = defaultdict(lambda: np.zeros(8))
        for key, own in ((0, [(r[1], r) for r in data]), (1, [(np.tanh(r[2]), r) for r in data]), (5, [(np.tanh(r[2]), r) for r in data if r[0] % 2])):
            q = np.quantile([s for s, _ in own], shares)
            for s, r in own:
                d, c = r[3], r[4:]
                want[key, int((q < s).sum())] += [*c, c[2] * (d == 0), c[2] * (d <= 1), d == 0, d <= 1, 1]
        assert set(got) == set(want)
        for k, v in want.items():
            assert np.allclose([got[k][c] for c in ("c1", "c2", "c3", "w1", "w2", "n1", "n2", "n")], v)


def test_md5_side_by_side():
    from tierscope.operators import draws

    prefixes, endings = [f"{i}|" for i in (1, 22, 333, 4444, 10**9)] + ["", "é|", "x" * 54, "x" * 55], ["0", "7", "99"]
    for e, u, which in draws.unit_draws(prefixes, endings):
        assert u.tolist() == [int(hashlib.md5((p + endings[e]).encode()).hexdigest()[:8], 16) / 2**32 for p in prefixes] and which.tolist() == list(range(len(prefixes)))


def test_random_orders_repeat_no_row(spark):
    """No plan of the query has a row for each draw: the largest written table has one for each task."""
    df = spark.range(400).select(F.col("id").alias("trajectory_id"), (F.col("id") % 3 + 1).cast("int").alias("difficulty"), *[F.lit(float(i)).alias(f"c{i}") for i in (1, 2, 3)])
    sizes, own = [], evaluate.written

    def counted(df, name):
        made = own(df, name)
        sizes.append((name, made.count()))
        return made

    evaluate.written = counted
    try:
        row = evaluate.random_baseline(df, evaluate.default_grid("cuts"), 20).first()
    finally:
        evaluate.written = own
    assert dict(sizes)["policy"] == 400 and 0 < row.auc_low <= row.auc_mean <= row.auc_high


def test_weight_search_repeats_no_row(spark):
    """The picks of a row for each draw, from a table of one row a task and fold; a group without a rank does not count."""
    rng = np.random.default_rng(5)
    groups = {"ask": (1, ()), "harness": (1, ()), "breadth": (-1, ())}
    means = [(i, t, g, float(rng.integers(1, 40)) / 40) for i in range(150) for t in (0, 2) for g in groups if (i + t) % 9 or g == "ask"]
    labelled = spark.createDataFrame([(i, int(rng.integers(1, 4)), *sorted(map(float, rng.random(3)))) for i in range(150)], "trajectory_id long, difficulty int, c1 double, c2 double, c3 double")
    group_means = spark.createDataFrame(means, "trajectory_id long, test int, grp string, mean_rank double")
    draws, cuts, sizes, own = evaluate.weight_draws(spark, 4, groups), evaluate.default_grid("cuts")[::9], {}, evaluate.written
    scored = group_means.join(draws, "grp").groupBy("trajectory_id", "test", "draw").agg(F.round(F.sum(F.col("sign") * F.col("weight") * F.col("mean_rank")) / F.sum("weight"), 9).alias("score"))
    rows = labelled.join(scored, "trajectory_id")
    area = evaluate.frontier_metrics(evaluate.cut_points(rows, "score", cuts, ("test", "draw")), by=("test", "draw")).collect()
    want = {t: max((round(r.auc, 9), -r.draw) for r in area if r.test == t) for t in (0, 2)}

    def counted(df, name):
        made = own(df, name)
        sizes[name] = made.count()
        return made

    evaluate.written = counted
    try:
        got = {r.test: (r.auc, -r.draw) for r in evaluate.search_group_weights(group_means, labelled, draws, cuts, ("test",)).collect()}
    finally:
        evaluate.written = own
    assert set(got) == set(want) and all(got[t][1] == want[t][1] and got[t][0] == pytest.approx(want[t][0], abs=1e-8) for t in want)
    assert sizes["draws"] == 300
