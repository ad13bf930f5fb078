"""Effort counters of trajectories, from item arrays or from rows of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

IMAGE_TOKENS = 1000


def _count(items: Column, when) -> Column:
    return F.size(F.filter(items, when)).cast("long")


def _sum(items: Column, when, value) -> Column:
    return F.aggregate(F.filter(items, when), F.lit(0).cast("long"), lambda acc, i: acc + value(i))


def effort_metrics(deepest: DataFrame) -> DataFrame:
    """13 counters for each trajectory's deepest call (trajectory_id, input, items_raw, n_calls), without a shuffle."""
    items = F.col("input")
    is_type = lambda *names: lambda i: F.coalesce(i["type"].isin(*names), F.lit(False))
    plain = lambda role: lambda i: ~F.coalesce(i["type"].isin(*X.CALLS, *X.OUTPUTS, "reasoning"), F.lit(False)) & F.coalesce(i["role"] == role, F.lit(False))
    call_name = lambda i: F.coalesce(F.nullif(i["name"], F.lit("")), F.lit("custom"))

    def payload_tokens(i: Column) -> Column:
        v = F.when(i["type"] == "function_call", i["arguments"]).otherwise(i["input"])
        falsy = v.isNull() | F.to_json(v).isin("null", "{}", "[]", "0", "false")
        return F.when(falsy, F.lit(0).cast("long")).when(F.schema_of_variant(v) == "STRING", X.token_estimate(v.cast("string"))).otherwise(X.json_token_estimate(F.to_json(v)))

    def step(acc: Column, i: Column) -> Column:
        """Runs of model items and same-tool streaks within a burst of work."""
        model, call = X.is_model_item(i), is_type(*X.CALLS)(i)
        broken = plain("assistant")(i) | plain("user")(i)
        streak = F.when(call, F.when(acc["tool"] == call_name(i), acc["streak"] + 1).otherwise(1)).when(broken, 0).otherwise(acc["streak"])
        return F.struct((acc["runs"] + (model & ~acc["model"]).cast("long")).alias("runs"), model.alias("model"), F.when(call, call_name(i)).when(broken, F.lit("\0")).otherwise(acc["tool"]).alias("tool"), streak.cast("long").alias("streak"), F.greatest(acc["most"], streak.cast("long")).alias("most"))

    zero = F.lit(0).cast("long")
    state = F.aggregate(items, F.struct(zero.alias("runs"), F.lit(False).alias("model"), F.lit("\0").alias("tool"), zero.alias("streak"), zero.alias("most")), step)
    images = F.aggregate(F.filter(items, lambda i: F.coalesce(i["role"] == "user", F.lit(False)) & F.coalesce(F.schema_of_variant(i["content"]).startswith("ARRAY"), F.lit(False))), zero, lambda acc, i: acc + F.size(F.filter(i["content"].cast("array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string") == "input_image", F.lit(False)))))
    summary_text = lambda i: X.content_text(i["summary"])
    return deepest.withColumn("_s", state).select(
        "trajectory_id",
        (F.col("_s.runs") + 1).alias("n_llm_calls"),
        _count(items, is_type(*X.CALLS)).alias("n_tool_calls"),
        _count(items, lambda i: X.is_output_item(i) & X.is_error_output(F.coalesce(F.to_json(i["output"]), F.lit("null")))).alias("n_tool_errors"),
        _count(items, plain("assistant")).alias("n_assistant_msgs"),
        _count(items, plain("user")).alias("n_user_turns"),
        F.size(F.array_distinct(F.transform(F.filter(items, is_type(*X.CALLS)), call_name))).cast("long").alias("n_distinct_tools"),
        F.col("_s.most").alias("max_repeat_streak"),
        _count(items, is_type("reasoning")).alias("n_reasoning_items"),
        _sum(items, is_type("reasoning"), lambda i: X.token_estimate(summary_text(i))).alias("reasoning_tokens"),
        (_sum(items, is_type(*X.CALLS), payload_tokens) + _sum(items, plain("assistant"), lambda i: X.token_estimate(X.content_text(i["content"])))).alias("gen_tokens"),
        _sum(items, X.is_output_item, lambda i: X.json_token_estimate(F.coalesce(F.to_json(i["output"]), F.lit("null")))).alias("tool_output_tokens"),
        (X.items_json_tokens(F.col("items_raw")) + images * IMAGE_TOKENS).alias("context_tokens"),
        F.col("n_calls").cast("long").alias("n_logged_calls"),
    )


def log_metrics(rows: DataFrame) -> DataFrame:
    """The counters from rows of a log: trajectory_id, pos, kind, name, is_error, tokens.

    ``kind`` is user, assistant, call, output or reasoning. Runs and streaks come from windows
    over each trajectory's order.
    """
    order = Window.partitionBy("trajectory_id").orderBy("pos")
    model = F.col("kind").isin("assistant", "call", "reasoning")
    marked = rows.withColumn("_run", (model & ~F.coalesce(F.lag(model).over(order), F.lit(False))).cast("int"))
    marked = marked.withColumn("_burst", F.sum(F.col("kind").isin("user", "assistant").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    calls = Window.partitionBy("trajectory_id", "_burst", F.col("kind") == "call").orderBy("pos")
    new = (F.coalesce(F.lag("name").over(calls), F.lit("\0")) != F.col("name")).cast("int")
    marked = marked.withColumn("_new", new)
    marked = marked.withColumn("_island", F.sum("_new").over(calls.rowsBetween(Window.unboundedPreceding, 0)))
    is_call = F.col("kind") == "call"
    streaks = marked.filter(is_call).groupBy("trajectory_id", "_burst", "_island").agg(F.count(F.lit(1)).alias("n")).groupBy("trajectory_id").agg(F.max("n").alias("max_repeat_streak"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("tokens"))), F.lit(0)).cast("long")
    made = marked.groupBy("trajectory_id").agg(
        (F.sum("_run") + 1).cast("long").alias("n_llm_calls"),
        F.count_if(is_call).alias("n_tool_calls"),
        F.count_if("is_error").alias("n_tool_errors"),
        F.count_if(F.col("kind") == "assistant").alias("n_assistant_msgs"),
        F.count_if(F.col("kind") == "user").alias("n_user_turns"),
        F.count_distinct(F.when(is_call, F.col("name"))).alias("n_distinct_tools"),
        F.count_if(F.col("kind") == "reasoning").alias("n_reasoning_items"),
        total(F.col("kind") == "reasoning").alias("reasoning_tokens"),
        total(F.col("kind").isin("assistant", "call")).alias("gen_tokens"),
        total(F.col("kind") == "output").alias("tool_output_tokens"),
        total(F.lit(True)).alias("context_tokens"),
    )
    return made.join(streaks, "trajectory_id", "left").withColumn("max_repeat_streak", F.coalesce("max_repeat_streak", F.lit(0)))


def shape_stats(trajectories: DataFrame) -> DataFrame:
    """One row: trajectories, requests, median and most calls, percentage with a single call."""
    return trajectories.agg(F.count(F.lit(1)).alias("n_trajectories"), F.sum("n_calls").alias("n_requests"), F.median("n_calls").alias("logged_calls_median"), F.max("n_calls").alias("logged_calls_max"), F.round(100 * F.avg((F.col("n_calls") == 1).cast("double")), 1).alias("one_call_only_pct"))


def class_mix(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
