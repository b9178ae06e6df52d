"""What models say: texts with tool calls, and streams of JSON lines, as captured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Inputs: texts with {} for the conversation's number.
SAID = [
    'ok <tool_call>call:run{cmd: <|"|>echo {}<|"|>, n: 3}</tool_call> done',
    '<|tool_call>call:find_files{path: "/a/{}", deep: true}<tool_call|><|tool_call|>call:run{cmd: "ls"}<|/tool_call|>',
    'I think <tool_call>call:run{cmd: "a {}", opts: {x: 1, y: {z: 2}}} and no end',
    "<tool_call>call:run{cmd: 'single {}', ok: True}</tool_call>",
    "<tool_call>not a call</tool_call> <tool_call>call:{x: 1}</tool_call> <tool_call>call:run{broken</tool_call>",
    '{"tool": "run", "arguments": {"cmd": "echo {}", "n": 2}}',
    'Sure:\n```json\n{"name": "read", "args": {"path": "/x/{}"}}\n```\nbye',
    'text {"name": "run", "arguments": {"cmd": "x {y} {}"}} more {"name": "no"}',
    "{'tool': 'run', 'arguments': {'cmd': 'quoted {}', 'all': True}}",
    '"name": "bare", "arguments": {"cmd": "{}"}',
    '{"arguments": {"cmd": "no name"}}',
    'call:execute_shell_command{cmd:<|"|>ls -la /{}<|"|>,intent:<|"|>list',
    'call:execute_shell_command{intent:x,cmd:<|"|>du -sh {},commands_used:[du]',
    'call:execute_shell_command{cmd:<|"|> <|"|>} call:other',
    'deep {"name": "nest", "args": {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": [{"i": {}}]}}}}}}}}} end',
    'open { never {"name": "inner", "args": {}}',
    'closed } first {"name": "after", "args": {"cmd": "{}"}} }',
    '<tool_call>call:deep{a: {b: {c: {d: {e: {f: {g: {h: 1}}}}}}}}</tool_call> <|tool_call>call:run{cmd: "two {}"}',
    "nothing to do with {}",
    "",
]


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, said: the answers of a conversation."""
    chosen = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") * 7 + F.col("turn")) % len(SAID) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace(chosen, F.lit("{}"), F.col("conv_id").cast("string")).alias("said"))
    return rows


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SAID_SQL = f"said AS (SELECT conv_id, turn, replace([{', '.join(map(_literal, SAID))}][(conv_id * 7 + turn) % {len(SAID)} + 1], '{{}}', CAST(conv_id AS VARCHAR)) AS said FROM conversations)"

# Inputs: lines of a chat stream.
CHUNKS = [
    '{"message":{"thinking":"hm {}"},"done":false}',
    '{"message":{"content":"Hel","thinking":""},"done":false}',
    '{"message":{"thinking":"a","content":"b","tool_calls":[{"function":{"name":"run","arguments":{"cmd":"ls {}"}}},{"function":{"name":"read","arguments":{}}}]},"done":false}',
    "   ",
    '{"message":{"content":""},"done":true,"prompt_eval_count":12,"eval_count":34}',
    '{"done":true,"eval_count":5}',
    '{"done":true}',
    '{"done":false,"eval_count":9}',
    '{"message":{"content":"lo","tool_calls":[]}}',
    '{"error":"out of memory {}"}',
    "no json",
]


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, line_no, line."""
    chosen = F.element_at(F.array(*map(F.lit, CHUNKS)), ((F.col("conv_id") * 5 + F.col("turn") * 3) % len(CHUNKS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("line_no"), F.replace(chosen, F.lit(" {}"), F.concat(F.lit(" "), "conv_id")).alias("line"))


CHAT_SQL = f"chat_lines AS (SELECT conv_id AS stream_id, turn AS line_no, replace([{', '.join(map(_literal, CHUNKS))}][(conv_id * 5 + turn * 3) % {len(CHUNKS)} + 1], ' {{}}', ' ' || conv_id) AS line FROM conversations)"
