"""Queries over nested requests: JSON lines made from the given conversations, parsed and measured like a request log."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import effort
from ..sources import io
from . import adapters as A

TOOLS = '[{"type": "function", "name": "bash", "parameters": {"properties": {"a": {"type": "string"}, "b": {"type": "string"}}}}, {"type": "function", "name": "slack_send", "parameters": {"properties": {}}}]'


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, value): a JSON line for each conversation.

    User contents are strings on even turns and parts with an image on odd ones. An assistant
    turn is a call and its output, with reasoning before it and a message behind it where
    the length of its text says so. Every tenth conversation's line is cut off and thus corrupt, every
    other one has an unknown field.
    """
    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n, text = F.length("text"), F.col("text")
    item = lambda **parts: F.to_json(F.struct(*[v.alias(k) if isinstance(v, Column) else F.lit(v).alias(k) for k, v in parts.items()]))
    image = F.to_json(F.struct(F.lit("input_image").alias("type"), F.lit("x").alias("image_url")))
    parts = F.concat(F.lit('{"role":"user","content":['), item(type="input_text", text=text), F.lit(","), image, F.lit("]}"))
    output = F.when(n % 5 == 0, "Traceback: it failed").otherwise(F.concat(F.lit("fine, "), n))
    made = F.array(
        F.when(n % 2 == 0, F.concat(F.lit('{"type":"reasoning","summary":['), item(text=F.substring(text, 1, 40)), F.lit("]}"))),
        item(type="function_call", name=F.concat(F.lit("tool"), n % 3), arguments=F.struct(n.alias("q"))),
        item(type="function_call_output", output=output),
        F.when(n % 3 != 0, item(role="assistant", content=text)),
    )
    items = F.when(F.col("role") == "assistant", F.filter(made, lambda x: x.isNotNull())).when((F.col("role") == "user") & (F.col("turn") % 2 == 1), F.array(parts)).otherwise(F.array(item(role=F.col("role"), content=text)))
    lines = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", items.alias("i")))).alias("t"))
    body = F.array_join(F.flatten(F.transform("t", lambda x: x["i"])), ",")
    tools = F.when(F.col("conv_id") % 2 == 0, TOOLS).otherwise("[]")
    extra = F.when(F.col("conv_id") % 2 == 1, ',"note":1').otherwise("")
    line = F.concat(F.lit('{"model":"m","input":['), body, F.lit('],"tools":'), tools, extra, F.lit("}"))
    return lines.select("conv_id", F.when(F.col("conv_id") % 10 == 9, F.substring(line, 1, 40)).otherwise(line).alias("value"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io.parsed(request_lines(spark, sf_dir)).drop("trajectory_id", "request_id", "call_index", "trajectory_key")
    return rows.withColumnRenamed("conv_id", "trajectory_id").withColumn("n_calls", F.lit(1))


def request_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the fields that they lack or have beyond the known ones."""
    found = io.audit_schema(request_lines(spark, sf_dir).withColumnRenamed("conv_id", "pos"))
    return found.groupBy(F.array_join(F.array_sort("missing"), ",").alias("missing"), F.array_join(F.array_sort("extra"), ",").alias("extra")).agg(F.count(F.lit(1)).alias("n"))


_FEATURES = ("usr_n_parts", "usr_has_image", "sys_tokens", "usr_tokens", "usr_n_lines", "usr_exclaim", "usr_n_questions", "n_tools", "tools_tokens", "tools_n_params", "tool_has_bash", "tool_slack", "tool_has_write", "usr_sys_ratio", "workspace")


def request_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing features of each request that parses."""
    return X.routing_features(requests(spark, sf_dir).filter("model is not null")).select("trajectory_id", *_FEATURES)


def request_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effort counters of each request that parses."""
    return effort.effort_metrics(requests(spark, sf_dir).filter("model is not null"))


def _spaces(template: dict) -> int:
    """Characters of an item around its text."""
    return len(json.dumps(template)) - 2


_ROWS = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id % 10 <> 9)"
_JSON = "(length(to_json({t})::VARCHAR) + 5 * len(regexp_extract_all({t}, '[^\\x00-\\x7F]')))"
_ITEMS = f"""{_ROWS}, it AS (
SELECT conv_id, turn, 0 AS k, role AS kind, NULL AS name, text AS t, CASE WHEN role = 'user' AND turn % 2 = 1 THEN {_spaces({"role": "user", "content": [{"type": "input_text", "text": ""}, {"type": "input_image", "image_url": "x"}]})} ELSE {_spaces({"role": "", "content": ""})} + length(role) END + {_JSON.format(t="text")} AS size FROM c WHERE role <> 'assistant'
UNION ALL SELECT conv_id, turn, 1, 'reasoning', NULL, substr(text, 1, 40), {_spaces({"type": "reasoning", "summary": [{"text": ""}]})} + {_JSON.format(t="substr(text, 1, 40)")} FROM c WHERE role = 'assistant' AND length(text) % 2 = 0
UNION ALL SELECT conv_id, turn, 2, 'call', 'tool' || (length(text) % 3), repeat('x', 7 + length(length(text)::VARCHAR)), {len(json.dumps({"type": "function_call", "name": "tool0", "arguments": {"q": 1}})) - 1} + length(length(text)::VARCHAR) FROM c WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, 3, 'output', NULL, o, {_spaces({"type": "function_call_output", "output": ""})} + {_JSON.format(t="o")} FROM (SELECT *, CASE WHEN length(text) % 5 = 0 THEN 'Traceback: it failed' ELSE 'fine, ' || length(text) END AS o FROM c WHERE role = 'assistant')
UNION ALL SELECT conv_id, turn, 4, 'assistant', NULL, text, {_spaces({"role": "assistant", "content": ""})} + {_JSON.format(t="text")} FROM c WHERE role = 'assistant' AND length(text) % 3 <> 0),
o AS (SELECT *, kind IN ('reasoning', 'call', 'assistant') AS model, sum((kind IN ('assistant', 'user'))::INT) OVER w AS burst FROM it WINDOW w AS (PARTITION BY conv_id ORDER BY turn, k)),
r AS (SELECT *, model AND NOT coalesce(lag(model) OVER (PARTITION BY conv_id ORDER BY turn, k), false) AS opens FROM o),
cl AS (SELECT *, (name IS DISTINCT FROM lag(name) OVER (PARTITION BY conv_id, burst ORDER BY turn, k))::INT AS fresh FROM o WHERE kind = 'call'), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, burst ORDER BY turn, k) AS i FROM cl),
st AS (SELECT conv_id, max(n) AS streak FROM (SELECT conv_id, burst, i, count(*) AS n FROM isl GROUP BY ALL) GROUP BY conv_id)"""

QUERIES = {q.__name__: q for q in (request_audit, request_features, request_effort)}

SQL = {
    "request_audit": """WITH c AS (SELECT DISTINCT conv_id FROM conversations), f AS (SELECT CASE WHEN conv_id % 10 = 9 THEN 'input,model,tools' ELSE '' END AS missing, CASE WHEN conv_id % 10 <> 9 AND conv_id % 2 = 1 THEN 'note' ELSE '' END AS extra FROM c) SELECT missing, extra, count(*) AS n FROM f GROUP BY ALL""",
    "request_features": f"""WITH {_ROWS}, s AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'system'), '') AS sys, arg_min(CASE WHEN turn % 2 = 1 THEN text || chr(10) ELSE text END, turn) FILTER (role = 'user') AS u, arg_min(turn, turn) FILTER (role = 'user') AS ut FROM c GROUP BY conv_id), z AS (SELECT *, coalesce(u, '') AS usr, conv_id % 2 = 0 AS tools FROM s)
SELECT conv_id AS trajectory_id, CASE WHEN ut IS NULL THEN 0 WHEN ut % 2 = 1 THEN 2 ELSE 1 END AS usr_n_parts, coalesce(ut % 2 = 1, false)::INT AS usr_has_image, length(sys) // 4 AS sys_tokens, length(usr) // 4 AS usr_tokens, length(usr) - length(replace(usr, chr(10), '')) + 1 AS usr_n_lines, length(usr) - length(replace(usr, '!', '')) AS usr_exclaim, length(usr) - length(replace(usr, '?', '')) AS usr_n_questions,
CASE WHEN tools THEN 2 ELSE 0 END AS n_tools, CASE WHEN tools THEN {len(TOOLS) // 4} ELSE 0 END AS tools_tokens, CASE WHEN tools THEN 2 ELSE 0 END AS tools_n_params, tools::INT AS tool_has_bash, tools::INT AS tool_slack, 0 AS tool_has_write, round_even((length(usr) // 4) / greatest(length(sys) // 4, 1)::DOUBLE, 3) AS usr_sys_ratio, substr(md5(sys), 1, 8) AS workspace FROM z""",
    "request_effort": f"""WITH {_ITEMS} SELECT conv_id AS trajectory_id, count_if(opens)::BIGINT + 1 AS n_llm_calls, count_if(kind = 'call')::BIGINT AS n_tool_calls, count_if(kind = 'output' AND t LIKE 'Traceback%')::BIGINT AS n_tool_errors, count_if(kind = 'assistant')::BIGINT AS n_assistant_msgs, count_if(kind = 'user')::BIGINT AS n_user_turns,
count(DISTINCT name) AS n_distinct_tools, coalesce(any_value(streak), 0)::BIGINT AS max_repeat_streak, count_if(kind = 'reasoning')::BIGINT AS n_reasoning_items, coalesce(sum(length(t) // 4) FILTER (kind = 'reasoning'), 0)::BIGINT AS reasoning_tokens, coalesce(sum(length(t) // 4) FILTER (kind IN ('call', 'assistant')), 0)::BIGINT AS gen_tokens,
coalesce(sum((length(t) + 2) // 4) FILTER (kind = 'output'), 0)::BIGINT AS tool_output_tokens, ((sum(size) + 2 * count(*)) // 4 + 1000 * count_if(kind = 'user' AND turn % 2 = 1))::BIGINT AS context_tokens, 1::BIGINT AS n_logged_calls FROM r LEFT JOIN st USING (conv_id) GROUP BY conv_id""",
}
