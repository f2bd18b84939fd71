"""Queries over records of tools, as three tools would write the given conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.commands import FAILURES
from ..sources.transcripts import turns_of_records
from .queries import query, redacted_sql

_BEGUN = 1704067200
_CALL = "array(struct('Bash' AS name, '{\"command\": \"git commit -m x\"}' AS args), struct('Edit' AS name, '{\"file_path\": \"/w/app/src/ui/page.tsx\"}' AS args), struct('ToolSearch' AS name, '{}' AS args))"


def _rows(spark: SparkSession, sf_dir: str, tool: int) -> DataFrame:
    """The conversations of one tool: each turn with its time and, for three of four turns of the assistant, a call."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.col("conv_id") % 3 == tool)
    call = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 > 0), F.get(F.expr(_CALL), (F.col("turn") % 4 - 1).cast("int")))
    return c.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("said"), (F.col("turn") + _BEGUN).alias("at"), call.alias("call"), F.concat(F.lit("/w/app-"), F.col("conv_id") % 7).alias("folder"))


def _lines(rows: DataFrame, source: Column, *records: Column) -> DataFrame:
    """(source, line, value): the records of each turn, those that are null left out."""
    each = F.posexplode(F.array(*(F.to_json(r) for r in records))).alias("k", "value")
    return rows.select(source.alias("source"), "turn", each).select("source", (F.col("turn") * len(records) + F.col("k")).alias("line"), "value")


def blocks(rows: DataFrame) -> DataFrame:
    """Lines whose messages are lists of blocks; some turns are a side chain, and results of commands are a user's record."""
    said, call = F.col("said"), F.col("call")
    text = F.struct(F.lit("text").alias("type"), said.alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("input"))
    use = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), call["name"].alias("name"), F.parse_json(call["args"]).alias("input"))
    head = [F.concat(F.lit("c"), F.col("conv_id")).alias("sessionId"), F.col("folder").alias("cwd"), F.col("at").alias("timestamp"), (F.col("turn") % 11 == 5).alias("isSidechain")]
    content = F.when(call.isNotNull(), F.array(text, use)).otherwise(F.array(text))
    turn = F.struct(F.col("role").alias("type"), *head, F.struct(F.col("role").alias("role"), content.alias("content")).alias("message"))
    result = F.struct(F.lit("user").alias("type"), *head, F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), said.alias("content"))).alias("content")).alias("message"))
    return _lines(rows, F.concat(F.lit("/s/"), F.col("conv_id"), F.lit(".jsonl")), turn, F.when(call["name"] == "Bash", result))


def payloads(rows: DataFrame) -> DataFrame:
    """Lines that hold a payload each: what the session is, messages, calls with their arguments as text, and results."""
    call, head = F.col("call"), [(F.col("at") * 1000).alias("timestamp"), F.lit("response_item").alias("type")]
    meta = F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("c"), F.col("conv_id")).alias("id"), F.col("folder").alias("cwd")).alias("payload"))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    turn = F.struct(*head, F.struct(F.lit("message").alias("type"), role.alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.col("said").alias("text"))).alias("content")).alias("payload"))
    use = F.struct(*head, F.struct(F.lit("function_call").alias("type"), call["name"].alias("name"), call["args"].alias("arguments")).alias("payload"))
    result = F.struct(*head, F.struct(F.lit("function_call_output").alias("type"), F.col("said").alias("output")).alias("payload"))
    return _lines(rows, F.concat(F.lit("/s/rollout-"), F.col("conv_id"), F.lit(".jsonl")), meta, turn, F.when(call.isNotNull(), use), F.when(call["name"] == "Bash", result))


def events(rows: DataFrame) -> DataFrame:
    """A log of events; prompts, counts of tokens, and messages of the assistant with calls beside them. Path and folder tell the session."""
    call, time = F.col("call"), (F.col("at") * 1000).alias("time")
    prompt = F.when(F.col("role") == "user", F.struct(F.lit("turn.prompt").alias("type"), time, F.col("said").alias("text")))
    usage = F.struct(F.lit("usage.record").alias("type"), time, F.lit("12 tokens").alias("text"))
    calls = F.when(call.isNotNull(), F.array(F.struct(F.struct(call["name"].alias("name"), call["args"].alias("arguments")).alias("function"))))
    message = F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("said").alias("text"))).alias("content"), calls.alias("tool_calls"))
    turn = F.when(F.col("role") == "assistant", F.struct(F.lit("context.append_message").alias("type"), time, F.struct(message.alias("message")).alias("event")))
    source = F.concat(F.lit("/s/"), F.replace("folder", F.lit("/"), F.lit("%2F")), F.lit("/c"), F.col("conv_id"), F.lit("/agents/main/wire.jsonl"))
    return _lines(rows, source, prompt, usage, turn)


TOOLS = [("claude", blocks), ("codex", payloads), ("kimi", events)]

_SPACED = r"regexp_replace(said, '^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$', '', 'g')"
_FAILED = " OR ".join(f"contains(lower(substr(said, 1, 400)), '{m}')" for m in FAILURES)


@query(f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS said, ['claude', 'codex', 'kimi'][1 + conv_id % 3] AS agent FROM conversations
  WHERE role IN ('user', 'assistant') AND NOT (conv_id % 3 = 0 AND turn % 11 = 5)),
p AS (
  SELECT *, 1 AS part, role AS actor, 'message' AS kind, NULL AS tool, NULL AS command, '' AS paths, CASE WHEN role = 'user' THEN {_SPACED} WHEN agent = 'claude' THEN said ELSE trim(said) END AS shown, false AS is_error FROM t
  UNION ALL SELECT *, 2, 'assistant', 'tool_call', CASE turn % 4 WHEN 1 THEN 'shell' ELSE 'edit' END, CASE turn % 4 WHEN 1 THEN 'git commit' END, CASE turn % 4 WHEN 2 THEN 'src/ui/*.tsx' ELSE '' END, NULL, false FROM t WHERE role = 'assistant' AND turn % 4 IN (1, 2)
  UNION ALL SELECT *, 3, 'tool', 'tool_result', NULL, NULL, '', said, {_FAILED} FROM t WHERE role = 'assistant' AND turn % 4 = 1 AND agent <> 'kimi'),
r AS (SELECT *, {redacted_sql("shown")} AS safe FROM p WHERE kind <> 'message' OR shown <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY agent, conv_id ORDER BY turn, part) AS idx FROM r)
SELECT agent, 'c' || conv_id AS session, 'app-' || (conv_id % 7) AS repo, idx, actor, kind, {_BEGUN} + turn AS at, sha256(CASE WHEN length(safe) > 8000 THEN substr(safe, 1, 8000) || '…' ELSE safe END) AS said, tool, command, paths, is_error
FROM n WHERE idx <= 4000""")
def record_turns(spark, sf_dir):
    """All conversations as records of three tools, read as turns: cleaned, redacted, calls canonical, sessions and folders found."""
    out = None
    for k, (agent, written_as) in enumerate(TOOLS):
        t = turns_of_records(written_as(_rows(spark, sf_dir, k)), agent)
        t = t.select(
            "agent", "session", "repo", F.col("idx").cast("long").alias("idx"), "actor", "kind", F.unix_seconds("at").alias("at"), F.sha2(F.col("text").cast("binary"), 256).alias("said"), "tool",
            "command", F.array_join(F.coalesce("paths", F.array().cast("array<string>")), ",").alias("paths"), "is_error",
        )
        out = t if out is None else out.union(t)
    return out
