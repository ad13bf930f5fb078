"""Column functions over requests: item contents, token estimates, error detection, routing features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------
SYSTEM_TAGS = ("available_skills", "slack_history", "teams_history", "structured_output", "voice", "personalization", "custom_instructions", "personality", "thread_instructions", "core_philosophy", "operating_rules", "work_approach")
USER_TAGS = ("auto_read_learnings", "auto_read_execution_log", "auto_read_channel_instructions", "auto_read_personal_skill", "auto_read_recent_activity", "delivery_note", "summary_so_far")
PII = r"PII_[A-Z_]+_\d+"
SKILL = r"(?m)^\-\s\*\*([a-zA-Z0-9_\- ]+)\*\*"
HEADER = r"(?m)^\[((?:Slack|Microsoft Teams|Email|Cron|Scheduled|New)[^\]\n]{0,160})\]"
COUNTED = {
    "usr_n_attachments": r"\((?:application|image|text|audio|video|font|model|message|multipart)/[a-zA-Z0-9.+-]+\)",
    "usr_n_action_verbs": r"(?iU)\b(?:create|build|write|generate|analy[sz]e|summari[sz]e|research|prepare|draft|review|update|fix|implement|compare|plan|schedule|organize|extract|convert|translate|deploy)\b",
    "usr_n_coord_markers": r"(?iU)\b(?:and then|after that|once done|as well as|also|finally|steps?:)\b",
    "usr_n_bullets": r"(?mU)^\s*[-*•]\s",
    "usr_n_todo": r"(?iU)\bTODO\b|\bto-?do\b|\[ \]",
    "usr_n_deliverable_kw": r"(?iU)\b(?:report|pdf|pptx?|deck|slide|email|summar\w+|dashboard|csv|xlsx?|document|invoice|spreadsheet|presentation)\b",
    "usr_n_file_ext": r"(?U)[\w-]\.[A-Za-z][A-Za-z0-9]{1,3}\b",
    "usr_n_numbers": r"(?U)\b\d[\d,.]*\b",
}
AUDIO = r"audio/|\.wav\b|\.mp3\b|\.m4a\b"
DEADLINE = r"(?iU)\b(?:today|tomorrow|asap|deadline|by (?:mon|tue|wed|thu|fri|end)|eod|eow)\b"
NEGATED = r'(?i)\b(?:0|no|zero|without)\s+(?:tool\s+)?(?:errors?|failures?|failed|exceptions?)\b|\b\d+\s+passed,?\s*0\s+failed\b|\berrors?\W{0,4}(?:\[\s*\]|0\b|none\b|null\b|false\b)'
ERROR = r"(?i)\berror(?:s|ed)?\b|\btraceback\b|\bexceptions?\b|\bfail(?:ed|ure)s?\b|\bexit code:?\s*[1-9]\d*\b"
OLD_MARKERS = ("error", "traceback", "exit code 1", "failed", "exception")
CALLS = ("function_call", "custom_tool_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")
# -------------------------------------------------------------------------------


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded down; null counts as empty."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def json_length(compact: Column) -> Column:
    """Length of a JSON text as written with ``", "`` and ``": "`` separators and ``\\uXXXX`` escapes.

    ``compact`` has no spaces between tokens. Strings are skipped with a possessive match,
    which needs no recursion on long ones.
    """
    outside = F.regexp_replace(F.regexp_replace(compact, r"\\.", ""), r'"[^"]*+"', "")
    escapes = 5 * F.regexp_count(compact, F.lit(r"[^\x{20}-\x{7e}]")) + 6 * F.regexp_count(compact, F.lit(r"[\x{10000}-\x{10ffff}]"))
    return F.length(compact) + escapes + F.regexp_count(outside, F.lit("[,:]"))


def json_token_estimate(compact: Column) -> Column:
    return F.floor(F.coalesce(json_length(compact), F.lit(0)) / 4).cast("long")


def items_json_tokens(raw_items: Column) -> Column:
    """Token estimate of a whole list given as its items' compact JSON texts: commas and brackets included."""
    inner = F.aggregate(raw_items, F.lit(0).cast("long"), lambda acc, x: acc + json_length(x).cast("long"))
    return F.floor((inner + 2 * F.greatest(F.size(raw_items) - 1, F.lit(0)) + 2) / 4).cast("long")


def variant_text(v: Column) -> Column:
    """The JSON text of a variant; a string variant keeps its quotes."""
    return F.to_json(v)


def _parts(v: Column, bare: bool) -> Column:
    """The texts of a parts list; ``bare`` tells whether plain strings count."""
    parts = v.try_cast("array<variant>") if hasattr(v, "try_cast") else v.cast("array<variant>")
    text = lambda p: F.coalesce(F.when(F.schema_of_variant(p) == "STRING", (p.cast("string") if bare else F.lit(None).cast("string"))).when(F.schema_of_variant(p).startswith("OBJECT"), F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), F.lit("") if bare else F.lit(None).cast("string"))
    return F.filter(F.transform(parts, text), lambda t: t.isNotNull())


def content_text(content: Column, bare: bool = True) -> Column:
    """A content's text: the string itself, or the texts of its parts, one a line; anything else is empty."""
    kind = F.schema_of_variant(content)
    return F.coalesce(F.when(kind == "STRING", content.cast("string")).when(kind.startswith("ARRAY"), F.array_join(_parts(content, bare), "\n")), F.lit(""))


def first_with_role(items: Column, role: str) -> Column:
    return F.get(F.filter(items, lambda i: i["role"] == role), F.lit(0))


def role_text(items: Column, role: str) -> Column:
    return F.coalesce(content_text(first_with_role(items, role)["content"]), F.lit(""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_pii(text: Column) -> Column:
    return F.regexp_replace(text, PII, "<E>")


def first_user_text(items: Column, limit: int = 12000) -> Column:
    """Text of the first user message without personal data; plain-string parts don't count here."""
    return F.substring(without_pii(F.coalesce(content_text(first_with_role(items, "user")["content"], bare=False), F.lit(""))), 1, limit)


def preview(user_text: Column) -> Column:
    """The text behind the header, on one line, without personal data, 140 characters."""
    header = F.regexp_extract(user_text, HEADER, 0)
    body = F.when(header != "", F.substr(user_text, F.instr(user_text, header) + F.length(header))).otherwise(user_text)
    return F.substring(without_pii(squeezed(body)), 1, 140)


def trigger_label(user_text: Column) -> Column:
    return F.substring(without_pii(F.regexp_extract(user_text, HEADER, 1)), 1, 60)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def distinct_matches(text: Column, pattern: str, group: int) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group)))


def word_count(text: Column) -> Column:
    flat = squeezed(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def skills_of(system_text: Column) -> Column:
    """Names in the last available_skills block, to its closing tag or the end."""
    after = F.substring_index(system_text, "<available_skills>", -1)
    block = F.substring_index(after, "</available_skills>", 1)
    return F.when(F.contains(system_text, F.lit("<available_skills>")), F.regexp_extract_all(block, F.lit(SKILL), 1)).otherwise(F.array().cast("array<string>"))


def workspace_of(system_text: Column) -> Column:
    """Fingerprint of the sorted skills of the whole system text, or of the text where it lists none."""
    skills = F.array_join(F.array_sort(F.regexp_extract_all(system_text, F.lit(SKILL), 1)), ",")
    return F.substring(F.md5(F.when(skills != "", skills).otherwise(system_text).cast("binary")), 1, 8)


def is_model_item(item: Column) -> Column:
    return F.coalesce(item["type"].isin(*CALLS, "reasoning"), F.lit(False)) | F.coalesce(item["role"] == "assistant", F.lit(False))


def is_output_item(item: Column) -> Column:
    return F.coalesce(item["type"].isin(*OUTPUTS), F.lit(False))


def is_error_output(text: Column) -> Column:
    """Whether the first 400 or last 800 characters tell of an error, negated phrases aside."""
    head, tail = F.substring(text, 1, 400), F.right(text, F.lit(800))
    window = F.when(F.contains(head, tail), head).otherwise(F.concat(head, F.lit("\n"), tail))
    window = F.regexp_replace(window, r'\\+[ntr"]', " ")
    return F.regexp_replace(window, NEGATED, " ").rlike(ERROR)


def is_error_output_substring(text: Column) -> Column:
    """The older rule: any marker within the first 400 characters."""
    head = F.lower(F.substring(text, 1, 400))
    found = F.lit(False)
    for m in OLD_MARKERS:
        found = found | F.contains(head, F.lit(m))
    return found


def text_flags(system: Column, user: Column) -> dict[str, Column]:
    """The features that two texts alone give; columns in no table's order."""
    trigger = F.regexp_extract(user, HEADER, 1)
    flag = lambda c: c.cast("int")
    return {
        "sys_tokens": token_estimate(system),
        "sys_n_skills": F.size(skills_of(system)),
        "sys_n_sections": distinct_matches(system, "<([a-z_]{3,40})>", 1),
        "sys_n_flags": sum((flag(F.contains(system, F.lit(f"<{t}>"))) for t in SYSTEM_TAGS), F.lit(0)),
        "usr_tokens": token_estimate(user),
        "usr_has_attachment": flag(F.contains(user, F.lit("Attachments:"))),
        "usr_audio": flag(user.rlike(AUDIO)),
        "usr_n_pii_refs": distinct_matches(user, PII, 0),
        "usr_n_urls": occurrences(user, "PII_URL_"),
        "usr_n_questions": occurrences(user, "?"),
        "usr_n_code_fences": occurrences(user, "```"),
        "usr_truncated_ctx": occurrences(user, "[... truncated"),
        "usr_n_ctx_blocks": sum((flag(F.contains(user, F.lit(f"<{t}"))) for t in USER_TAGS), F.lit(0)),
        "trig_slack": flag(F.startswith(trigger, F.lit("Slack"))),
        "trig_teams": flag(F.startswith(trigger, F.lit("Microsoft Teams"))),
        "trig_scheduled": flag(F.startswith(trigger, F.lit("Cron")) | F.startswith(trigger, F.lit("Scheduled"))),
        "trig_thread_activity": flag(F.contains(user, F.lit("New thread activity"))),
        "usr_n_words": word_count(user),
        "usr_n_lines": occurrences(user, "\n") + 1,
        "usr_has_deadline": flag(user.rlike(DEADLINE)),
        "usr_exclaim": occurrences(user, "!"),
        "usr_sys_ratio": F.bround(token_estimate(user) / F.greatest(token_estimate(system), F.lit(1)), 3),
        **{name: matches(user, pattern) for name, pattern in COUNTED.items()},
    }


def tool_flags(tools: Column, tools_raw: Column) -> dict[str, Column]:
    """The features that the tool definitions give."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    named = lambda *names: flag(F.exists(tools, lambda t: t["name"].isin(*names)))
    params = F.aggregate(tools, F.lit(0), lambda acc, t: acc + F.coalesce(F.size(F.map_keys(t["parameters"]["properties"])), F.lit(0)))
    return {
        "n_tools": F.size(tools),
        "tools_tokens": json_token_estimate(tools_raw),
        "tool_slack": flag(F.exists(tools, lambda t: F.contains(t["name"], F.lit("slack")))),
        "tool_msteams": flag(F.exists(tools, lambda t: F.contains(t["name"], F.lit("teams")))),
        "tool_subagent": named("submit_subagent_result"),
        "tool_memory_search": named("memory_search"),
        "tool_background": named("wait_for_background_work"),
        "tool_view_image": named("view_image"),
        "tool_has_bash": named("bash", "shell_command"),
        "tool_has_write": named("file_edit", "file_write", "apply_patch"),
        "tools_n_params": params,
    }


def routing_features(first_calls: DataFrame) -> DataFrame:
    """One row of features for each trajectory's earliest call (trajectory_id, input, tools, tools_raw).

    Only what is known before the agent runs counts: system text, first user message, tools.
    """
    user_item = first_with_role(F.col("input"), "user")
    content = user_item["content"]
    is_list = F.schema_of_variant(content).startswith("ARRAY")
    parts = content.cast("array<variant>")
    texts = first_calls.select(
        "trajectory_id", "tools", "tools_raw",
        role_text(F.col("input"), "system").alias("system"),
        role_text(F.col("input"), "user").alias("user"),
        F.when(user_item.isNull(), 0).when(is_list, F.size(parts)).otherwise(1).alias("usr_n_parts"),
        F.coalesce(F.when(is_list, F.exists(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string") == "input_image", F.lit(False)))), F.lit(False)).cast("int").alias("usr_has_image"),
    )
    flags = text_flags(F.col("system"), F.col("user")) | tool_flags(F.coalesce("tools", F.array().cast(first_calls.schema["tools"].dataType)), F.coalesce("tools_raw", F.lit("[]")))
    return texts.select("trajectory_id", "usr_n_parts", "usr_has_image", *[c.alias(n) for n, c in flags.items()], workspace_of(F.col("system")).alias("workspace"), preview(F.col("user")).alias("preview"), trigger_label(F.col("user")).alias("trigger"))


def text_channels(first_calls: DataFrame) -> DataFrame:
    """(trajectory_id, user, system, tools): the texts that the text models read."""
    content = first_with_role(F.col("input"), "system")["content"]
    system = F.coalesce(F.when(F.schema_of_variant(content) == "STRING", content.cast("string")).otherwise(F.to_json(content)), F.lit(""))
    names = F.array_join(F.array_sort(F.transform("tools", lambda t: F.coalesce(t["name"], F.lit("")))), " ")
    return first_calls.select("trajectory_id", first_user_text(F.col("input")).alias("user"), F.substring(without_pii(system), 1, 6000).alias("system"), F.coalesce(names, F.lit("")).alias("tools"))
