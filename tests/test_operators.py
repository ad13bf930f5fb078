"""Hand-written cases of each operator, degenerate ones included."""

import json

import pytest
from pyspark.sql import functions as F

from tierscope.functions import text as X
from tierscope.operators import costs, effort, evaluate, ml, offpolicy, ranks, scoring, trajectories
from tierscope.sources import io


def user(text):
    return {"role": "user", "content": text}


REQUESTS = [
    {"model": "m", "input": [{"role": "system", "content": "sys"}, user("ask")], "tools": []},
    {"model": "m", "input": [{"role": "system", "content": "sys"}, user("ask"), {"role": "assistant", "content": "B"}, user("b")], "tools": []},
    {"model": "m", "input": [{"role": "system", "content": "sys"}, user("ask"), {"role": "assistant", "content": "C"}, user("c"), user("d")], "tools": []},
    {"model": "n", "input": [{"role": "user", "content": [{"type": "input_image", "image_url": "x"}]}], "tools": []},
    {"model": "n", "input": [user("other")], "tools": [{"type": "function", "name": "bash", "parameters": {"type": "object", "properties": {"a": {"t": 1}, "b": {}}}}]},
    {"model": "n", "input": [user("other")], "tools": []},
]

ITEMS = [
    {"role": "system", "content": [{"type": "text", "text": "s"}, "bare"]},
    user("[Slack message] please build the report by fri é😀"),
    {"type": "reasoning", "id": "r", "summary": [{"text": "12345678"}]},
    {"type": "function_call", "name": "bash", "arguments": "{\"cmd\": \"ls\"}", "call_id": "1"},
    {"type": "function_call_output", "call_id": "1", "output": "12 passed, 0 failed"},
    {"type": "function_call", "name": "bash", "arguments": {"z": 1, "a": [1, 2]}, "call_id": "2"},
    {"type": "function_call_output", "call_id": "2", "output": "Traceback: ValueError, exit code 1"},
    {"role": "assistant", "content": "done now"},
    {"type": "custom_tool_call", "name": "bash", "input": "x"},
    {"type": "custom_tool_call_output", "output": {"errors": []}},
    {"role": "user", "content": [{"type": "input_image"}, {"type": "text", "text": "thanks"}]},
]


@pytest.fixture
def log(tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in REQUESTS[:3]) + "\n\n")
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in REQUESTS[3:]))
    return str(tmp_path)


def test_reconstruction(spark, log):
    rows = trajectories.with_hashes(trajectories.with_group_key(io.read_requests(spark, log)))
    chains = trajectories.reconstruct(rows).orderBy("pos").collect()
    # B extends A; C is a sibling of the extended tail and opens its own chain; the empty key is alone; duplicates chain.
    assert [(c.pos, c.trajectory_id, c.call_index, c.request_id) for c in chains] == [(0, 1, 1, 1), (1, 1, 2, 2), (2, 2, 1, 3), (3, 3, 1, 4), (4, 4, 1, 5), (5, 4, 2, 6)]
    keys = [c.trajectory_key for c in chains]
    assert keys[0] == keys[1] and keys[2] == keys[0] + ".1" and keys[3] == "solo:0" and keys[4] == keys[5]
    stats = trajectories.reconstruction_stats(trajectories.reconstruct(rows)).first()
    assert (stats.n_requests, stats.n_trajectories, stats.n_singleton_empty_key, stats.n_groups_split, stats.calls_min, stats.calls_median, stats.calls_max) == (6, 4, 1, 1, 1, 2, 2)


def test_link_write_and_read(spark, log, tmp_path):
    raw = trajectories.with_hashes(trajectories.with_group_key(io.read_requests(spark, log)))
    linked = trajectories.link(raw, trajectories.reconstruct(raw))
    assert trajectories.mixed_models(linked).count() == 0
    assert trajectories.multi_call(linked).count() == 4
    replies = {(r.trajectory_id, r.call_index): r.reply for r in trajectories.recovered_replies(linked).collect()}
    assert json.loads(replies[1, 1])[0]["content"] == "B" and replies[1, 2] is None
    one = trajectories.first_and_deepest(linked.withColumn("n_items", F.size("input")), ["pos", "input"]).orderBy("trajectory_id").first()
    assert (one["first"]["pos"], one["deepest"]["pos"], one.n_calls, one.model) == (0, 1, 2, "m")
    with pytest.raises(ValueError):
        io.read_linked(spark, log)
    out = str(tmp_path / "out")
    linked.select("dataset", "model", "trajectory_id").transform(lambda d: io.write_linked(d, out) or d)
    assert io.list_datasets(spark.read.parquet(out)).count() == 2


def test_audit(spark, log):
    lines = spark.createDataFrame([('{"model": 1, "x": 2}',), ("{}",)], "value string")
    assert [(r.missing, r.extra) for r in io.audit_schema(lines).collect()] == [(["input", "tools"], ["x"]), (["model", "input", "tools"], [])]


def test_effort(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"model": "m", "trajectory_id": 7, "call_index": 1, "input": ITEMS, "tools": []}))
    rows = io.read_linked(spark, str(tmp_path)).withColumn("n_calls", F.lit(1))
    m = effort.effort_metrics(rows).first()
    assert (m.n_llm_calls, m.n_tool_calls, m.n_tool_errors, m.n_assistant_msgs, m.n_user_turns, m.n_distinct_tools, m.max_repeat_streak) == (4, 3, 1, 1, 2, 1, 2)
    assert (m.n_reasoning_items, m.reasoning_tokens) == (1, 2)
    gen = len(ITEMS[3]["arguments"]) // 4 + len(json.dumps(ITEMS[5]["arguments"])) // 4 + len("done now") // 4 + 0
    assert m.gen_tokens == gen
    assert m.tool_output_tokens == sum(len(json.dumps(i["output"])) // 4 for i in ITEMS if "output" in i)
    assert m.context_tokens == len(json.dumps(ITEMS)) // 4 + 1000


def test_features(spark, tmp_path):
    tools = [{"type": "function", "name": "slack_bash", "parameters": {"type": "object", "properties": {"a": {}, "b": {}}}}, {"type": "function", "name": "bash"}]
    (tmp_path / "c.jsonl").write_text(json.dumps({"model": "m", "trajectory_id": 7, "input": ITEMS, "tools": tools}))
    f = X.routing_features(io.read_linked(spark, str(tmp_path))).first()
    assert (f.usr_n_parts, f.usr_has_image, f.trig_slack, f.n_tools, f.tool_slack, f.tool_has_bash, f.tools_n_params, f.usr_has_deadline, f.usr_n_action_verbs, f.usr_n_deliverable_kw) == (1, 0, 1, 2, 1, 1, 2, 1, 1, 1)
    assert f.tools_tokens == len(json.dumps(tools)) // 4
    assert f.preview == "please build the report by fri é😀" and f.trigger == "Slack message"
    c = X.text_channels(io.read_linked(spark, str(tmp_path))).first()
    assert c.tools == "bash slack_bash" and c.user.startswith("[Slack")


@pytest.mark.parametrize(("text", "found"), [("12 passed, 0 failed", False), ('{"errors": []}', False), ("x" * 2000 + " Traceback", True), ("exit code 1", True), ("exit code: 0", False), ("no errors", False), ("\\nfailed", True)])
def test_error_rule(spark, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(X.is_error_output(F.col("t"))).first()[0] is found


@pytest.mark.parametrize("value", ["a\"b\\c\n\t", "é😀\x01", [1, {"k": [True, None, "x, y: z"]}, []], {"a": {}, "b": "c"}])
def test_json_length(spark, value):
    assert spark.createDataFrame([(json.dumps(value),)], "t string").select(X.json_length(F.to_json(F.parse_json("t")))).first()[0] == len(json.dumps(value))


def test_ranks(spark):
    long = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate([0, 0, 1, 5])] + [(i, "g", 3.0) for i in range(4)], "id int, feature string, value double")
    got = {(r.id, r.feature): r["rank"] for r in ranks.self_rank(long).collect()}
    assert [got[i, "f"] for i in range(4)] == [0.5, 0.5, 0.75, 1.0] and all(got[i, "g"] == 0.5 for i in range(4))
    probe = spark.createDataFrame([(0, "f", -1.0), (1, "f", 0.0), (2, "f", 3.0), (3, "g", 9.0), (4, "h", 1.0)], "id int, feature string, value double")
    fit = ranks.fit_ecdf(long)
    assert [r["rank"] for r in ranks.apply_ecdf(probe, fit).orderBy("id").collect()] == [0.0, 0.5, 0.75, 0.5, 0.5]
    assert [r["rank"] for r in ranks.apply_ecdf(probe, fit, mid=True).orderBy("id").collect()] == [0.0, 0.25, 0.75, 0.5, 0.5]


def test_cuts(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "id int, s double")
    assert [r.tier for r in ranks.quantile_cut(df, "s", (0.5, 0.8)).orderBy("id").collect()] == [1] * 6 + [2] * 3 + [3] * 2
    assert [r.bucket for r in ranks.quantile_bucket(df, "s").orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4]
    labelled = df.withColumn("d", F.when(F.col("id") < 3, 1).when(F.col("id") < 7, 2).otherwise(3)).withColumn("fold", F.col("id") % 2)
    assert [r.tier for r in scoring.cuts_known_marginals(labelled, "s", "d").orderBy("id").collect()] == [1] * 3 + [2] * 4 + [3] * 4
    assert scoring.cuts_by_fold(labelled, "s", "d", "fold").count() == 11


def test_costs(spark):
    prices = io.read_prices(spark)
    names = spark.createDataFrame([("claude-opus-5",), ("claude-opus-5-x",), ("unknown",)], "model string")
    assert {r.model: r.uncached for r in costs.price_of(names, prices).collect()} == {"claude-opus-5": 5.0, "claude-opus-5-x": 5.0, "unknown": 2.0}
    calls = spark.createDataFrame([(1, 1, "a", [1, 2], [10, 20]), (1, 2, "a", [1, 2, 3], [10, 20, 30]), (1, 3, "b", [1, 9], [10, 5])], "trajectory_id int, call_index int, model string, hashes array<bigint>, toks array<bigint>")
    prof = costs.call_profiles(calls)
    assert [(r.tokens, r.shared) for r in prof.orderBy("call_index").collect()] == [(30, 0), (60, 30), (15, 10)]
    r = costs.route_costs(prof, prices, "model").first()
    assert r.switches == 1 and r.uncached_tokens == 30 + 30 + 15
    none = costs.cache_trap_measured(costs.call_policies(prof.limit(0).withColumn("mechanical", F.lit(False)), calls.select("trajectory_id", F.lit(1).alias("tier"))), io.tier_prices(spark))
    assert none.count() == 0


def test_evaluate(spark):
    rows = spark.createDataFrame([(i, t, d, 1.0, 2.0, 4.0) for i, (t, d) in enumerate([(1, 1), (2, 3), (3, 2), (3, 3)])], "trajectory_id int, tier int, difficulty int, c1 double, c2 double, c3 double")
    r = evaluate.report(rows).first()
    assert (r.n, r.exact_agreement, r.adjacent_agreement, r.served, r.est_cost_policy_usd, r.est_savings_pct) == (4, 0.5, 1.0, 0.75, 11.0, 31.2)
    assert [tuple(x) for x in evaluate.confusion(rows).orderBy("tier").collect()] == [(1, 1, 0, 0), (2, 0, 0, 1), (3, 0, 1, 1)]
    points = {x.method: x for x in evaluate.reference_points(rows).collect()}
    assert points["always-3"].cost_share == 1.0 and points["oracle"].served == 1.0
    f = evaluate.frontier_metrics(spark.createDataFrame([(0.2, 0.5, 0.5), (0.6, 0.8, 0.8)], "cost_share double, served double, weighted_served double")).first()
    assert f.at_half_budget == 0.5 and f.cost_at_90 is None and (f.knee_cost, f.knee_quality) == (0.2, 0.5)
    assert evaluate.pick_winner(spark.createDataFrame([("lambda oracle", 0.9), ("a", 0.5), ("b", 0.7)], "method string, auc double")).first().method == "b"


def test_offpolicy(spark):
    rows = spark.createDataFrame([(i, f"m{i % 3}", float(i % 10), 0.1 * (i % 3), float(i % 4)) for i in range(60)], "trajectory_id int, model string, score double, err_rate double, streak double")
    bucketed = offpolicy.with_bucket(rows)
    counts = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    solid = offpolicy.tier_map(offpolicy.struggle(bucketed), counts, 15)
    assert sorted(r.tier for r in solid.collect()) == [1, 2, 3]
    thin = offpolicy.tier_map(offpolicy.struggle(bucketed), counts, 500)
    assert all(r.solid for r in thin.collect())  # none reaches the least count, so all are ranked
    flat = offpolicy.struggle(bucketed.withColumn("err_rate", F.lit(1.0)).withColumn("streak", F.lit(1.0)))
    assert all(r.struggle == 0.0 for r in flat.collect())
    cells = offpolicy.cell_table(offpolicy.matched_cells(rows.limit(12).withColumn("tier", F.col("trajectory_id") % 3 + 1)))
    assert all(r.err_rate is None for r in cells.collect() if r.n < 10)
    w = offpolicy.replicate_sums(rows, [], [], 50)
    assert w.count() == 50 and 0.9 < w.agg(F.sum("w")).first()[0] / 3000 < 1.1


def brute_pairs(rows, gap):
    low = sorted((r for r in rows if r[3] <= 2), key=lambda r: (r[2], r[0]))
    high = sorted((r for r in rows if r[3] == 3), key=lambda r: (r[2], r[0]))
    used, out = set(), []
    for c in low:
        best = min((h for h in high if h[0] not in used), key=lambda h: (abs(h[2] - c[2]), high.index(h)), default=None)
        if best and abs(best[2] - c[2]) <= gap:
            used.add(best[0])
            out.append((c[0], best[0]))
    return out


def test_matched_pairs(spark):
    rows = [(i, "m", ((i * 37) % 101) / 100, 3 if i % 3 == 0 else 1) for i in range(60)]
    df = spark.createDataFrame(rows, "trajectory_id long, model string, score double, tier int")
    got = {(r.low_id, r.high_id) for r in offpolicy.matched_pairs(df, 0.05, None).collect()}
    assert got == set(brute_pairs(rows, 0.05))


def test_folds_and_heads(spark):
    df = spark.createDataFrame([(i, f"w{i % 7}", 1 + (i % 3), float(i % 3), float(i % 5)) for i in range(63)], "trajectory_id int, workspace string, difficulty int, a double, b double")
    for mode in ("hash", "balanced"):
        folds = ml.group_folds(df, "workspace", 3, mode)
        assert folds.groupBy("workspace").agg(F.count_distinct("fold").alias("k")).filter("k > 1").count() == 0
    assert ml.group_folds(df.filter("workspace = 'w1'"), "workspace", 5, "balanced").select("fold").distinct().count() == 1
    rows = ml.assembled(df, ["a", "b"])
    p = ml.fit_ordinal(rows)(rows)
    assert p.filter("p_d1 > p_d2").count() == 0
    one = ml.fit_ordinal(rows.withColumn("difficulty", F.lit(2)))(rows).first()
    assert (one.p_d1, one.p_d2) == (0.0, 1.0)
    m = ml.fit_multinomial(rows, weight="balanced")(rows)
    assert scoring.dispatch_argmax(m).filter("tier = difficulty").count() > 50


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, None)], "id int, text string")
    fit = ml.tfidf_fit(df, "text", (1, 2), min_df=1)
    assert {r.term: r.df for r in fit.collect()} == {"aa": 1, "bb": 2, "cc": 1, "aa bb": 1, "bb aa": 1, "bb cc": 1}
    norms = ml.tfidf(df, "text", fit).groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms) and len(norms) == 2
    chars = ml.tfidf_fit(df, "text", (3, 5), "char_wb", min_df=1)
    assert {" aa", "aa ", " aa "} <= {r.term for r in chars.collect()}


def test_frozen_and_stream(spark, tmp_path):
    from tierscope.plans.frozen import freeze, load
    from tierscope.streaming.routing import route_stream, stream_requests

    names = [f for _, fs in scoring.GROUPS.values() for f in fs]
    feats = spark.range(40).select(F.col("id").alias("trajectory_id"), *[(F.hash("id", F.lit(f)) % 5).cast("double").alias(f) for f in names])
    mets = spark.range(40).select(F.col("id").alias("trajectory_id"), *[F.abs(F.hash("id", F.lit(m)) % 4).alias(m) for m in scoring.METRIC_WEIGHTS])
    frozen = freeze(feats, mets, names, scoring.group_table(spark), io.tier_prices(spark))
    graded = scoring.grade(mets).select("trajectory_id", "difficulty")
    assert frozen.grade(mets).select("trajectory_id", "difficulty").exceptAll(graded).count() == 0  # on the fitted rows nothing changes
    frozen.save(str(tmp_path / "f"))
    again = load(spark, str(tmp_path / "f"))
    assert again.route(feats, "score").exceptAll(frozen.route(feats, "score")).count() == 0
    assert again.route(feats, "ml-lambda").filter("tier between 1 and 3").count() == 40
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in REQUESTS))
    route_stream(again, stream_requests(spark, str(tmp_path / "in")), str(tmp_path / "routes"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "routes")).count() == len(REQUESTS)
