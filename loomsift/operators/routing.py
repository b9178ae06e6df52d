"""Prompt classification, tool exposure and context under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, tokens_down, trim_to_tokens
from ..registry import query
from ..sources.tables import PROMPTS_SQL, prompts, table

# Fixed values: (label, score, phrases of which any counts once).
PHRASES = [
    ("debug", 2.0, ["why did", "debug", "that didn't work", "what happened", "fix the error", "try again", "failed", "error", "traceback", "stderr", "stack trace"]),
    ("web", 1.8, ["latest", "current", "today", "news", "release", "https://", "http://", "search the web", "online"]),
    ("docs", 1.6, ["what does", "explain", "what is", "what are", "why is", "why does", "why did", "should i", "is it safe", "best way", "recommend", "documentation", "docs", "man page", "--help", "syntax", "flag", "option", "difference between", "how do i tell", "what command", "which command"]),
    ("referential", 2.2, ["did i just run", "what command did i just run", "what did i just run", "last command", "previous command", "recent command", "just ran"]),
    ("referential", 1.4, ["that", "those", "it", "again", "previous", "before", "just run", "last thing"]),
    ("explore", 1.2, ["how do i", "how to", "explore", "options", "which command", "what command", "what version", "where am i", "what directory", "how many", "how much"]),
]
STARTS = [("debug", 0.5, ["why ", "debug "]), ("docs", 0.6, ["what does ", "docs for "]), ("web", 0.6, ["latest ", "current "])]
CLASSES = {
    "debug": "diagnostic_debugging", "docs": "documentation_question", "explore": "exploratory_shell_question", "fresh": "fresh_command_request", "referential": "referential_followup", "web": "web_current_info_question",
}
# Tools per class (execute, docs, files, terminal, web).
EXPOSURE = {
    "fresh_command_request": (1, 1, 1, 0, 1), "diagnostic_debugging": (1, 1, 1, 1, 1), "web_current_info_question": (0, 1, 0, 0, 1),
    "documentation_question": (0, 1, 0, 0, 0), "referential_followup": (1, 1, 1, 1, 1), "exploratory_shell_question": (1, 1, 1, 1, 1),
}


def any_of(text: Column, phrases: list[str], test=F.contains) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | test(text, F.lit(p))
    return hit


def classify(prompt: Column) -> Column:
    """struct<class, confidence>.  Ties go to the label that comes first in the alphabet; a prompt
    that nothing matches gets the alphabet's first label at 0.55, and no rule scores "fresh"."""
    p = ascii_lower(prompt)
    ranked = []
    for label, name in CLASSES.items():
        score = F.lit(0.0)
        for own, weight, phrases in PHRASES:
            if own == label:
                score = score + F.when(any_of(p, phrases), weight).otherwise(0.0)
        for own, weight, phrases in STARTS:
            if own == label:
                score = score + F.when(any_of(p, phrases, F.startswith), weight).otherwise(0.0)
        ranked.append(F.struct((-F.round(score, 3)).alias("s"), F.lit(label).alias("l"), F.lit(name).alias("name")))
    best = F.array_sort(F.array(*ranked))
    top, second = -best[0]["s"], -best[1]["s"]
    confidence = F.when(top <= 0, 0.55).otherwise(F.least(F.greatest(top / F.greatest(top + second, F.lit(0.01)), F.lit(0.51)), F.lit(0.99)))
    return F.struct(best[0]["name"].alias("class"), F.round(confidence, 4).alias("confidence"))


def _score_sql(label: str) -> str:
    parts = ["0.0"]
    for own, weight, phrases in PHRASES:
        if own == label:
            parts.append("CASE WHEN " + " OR ".join(f"contains(p, '{x.replace(chr(39), chr(39) * 2)}')" for x in phrases) + f" THEN {weight} ELSE 0 END")
    for own, weight, phrases in STARTS:
        if own == label:
            parts.append("CASE WHEN " + " OR ".join(f"starts_with(p, '{x}')" for x in phrases) + f" THEN {weight} ELSE 0 END")
    return " + ".join(parts)


_CLASSIFY = (
    f"WITH {PROMPTS_SQL}, l AS (SELECT prompt_id, lower(prompt) AS p FROM prompts), u AS (" + " UNION ALL ".join(f"SELECT prompt_id, '{label}' AS label, '{name}' AS name, ({_score_sql(label)})::DOUBLE AS s FROM l" for label, name in CLASSES.items())
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY round(s, 3) DESC, label) AS k, coalesce(lead(s) OVER (PARTITION BY prompt_id ORDER BY round(s, 3) DESC, label), 0) AS s2 FROM u), "
    "c AS (SELECT prompt_id, name AS class, round(CASE WHEN s <= 0 THEN 0.55 ELSE least(greatest(s / greatest(s + s2, 0.01), 0.51), 0.99) END, 4) AS confidence FROM r WHERE k = 1) "
)


@query(_CLASSIFY + "SELECT * FROM c")
def a1_classify(spark, sf_dir):
    got = prompts(spark, sf_dir).select("prompt_id", classify(F.col("prompt")).alias("c"))
    return got.select("prompt_id", "c.class", "c.confidence")


_TOOLS = ["execute", "docs", "files", "terminal", "web"]


@query(_CLASSIFY + "SELECT prompt_id, class, " + ", ".join("class NOT IN (" + (", ".join(f"'{k}'" for k, v in EXPOSURE.items() if not v[i]) or "''") + f") AS {t}" for i, t in enumerate(_TOOLS)) + " FROM c")
def a8_tool_exposure(spark, sf_dir):
    """Join with a table of six rows."""
    rows = [(k, *map(bool, v)) for k, v in EXPOSURE.items()]
    dim = spark.createDataFrame(rows, "class string, " + ", ".join(f"{t} boolean" for t in _TOOLS))
    return a1_classify(spark, sf_dir).join(F.broadcast(dim), "class").select("prompt_id", "class", *_TOOLS)


# Prompts, without punctuation around them, that say too little, and what is asked.
VAGUE = [
    (["do the usual", "usual"], "What usual action should I run here?"),
    (["fix it", "fix this"], "What should I fix, and what outcome should the command produce?"),
    (["clean this up", "clean up this"], "What should I clean up, and which files or directories are in scope?"),
    (["make this faster", "speed this up"], "What should I measure or change to make this faster?"),
    (["rename my files", "rename files"], "Which files should I rename, and what naming pattern should I use?"),
    (["delete the old ones", "remove the old ones"], "Which files should I delete, and how should I identify the old ones?"),
]
_EMPTY, _SNIPPET = "What exact command behavior should run?", "The command snippet looks incomplete. What exact complete command should I run?"
_WHICH = "Which exact files should I operate on, and what rule should select them?"
_EDGES = r"^[\s!-/:-@\[-`{-~]+|[\s!-/:-@\[-`{-~]+$"


def unbalanced(text: Column, quote: str) -> Column:
    """An odd number of unescaped quotes."""
    return F.regexp_count(F.regexp_replace(text, r"\\.", ""), F.lit(quote)) % 2 == 1


def clarification(prompt: Column) -> Column:
    """What has to be asked before anything is run, or null."""
    p = ascii_lower(F.trim(prompt))
    bare = F.regexp_replace(p, _EDGES, "")

    def incomplete(line: Column) -> Column:
        cmd = F.trim(F.substring(F.trim(line), 2, 10_000))
        return F.trim(line).startswith("$") & (cmd.endswith("|") | cmd.endswith("&&") | unbalanced(cmd, "'") | unbalanced(cmd, '"'))

    out = F.when(bare == "", _EMPTY).when(F.exists(F.split(F.trim(prompt), "\n"), incomplete), _SNIPPET)
    for texts, ask in VAGUE:
        out = out.when(bare.isin(texts), ask)
    return out.when(any_of(p, ["delete", "remove", "move", "rename"]) & any_of(p, [" old ones", " these ", " those "]), _WHICH)


@query(
    f"WITH {PROMPTS_SQL}, n AS (SELECT prompt_id, prompt, lower(trim(prompt)) AS p, regexp_replace(lower(trim(prompt)), '{_EDGES}', '', 'g') AS bare FROM prompts) SELECT prompt_id, CASE WHEN bare = '' THEN '{_EMPTY}' WHEN starts_with(prompt, '$ ') THEN '{_SNIPPET}' "
    + " ".join(f"WHEN bare IN ({', '.join(repr(t) for t in texts)}) THEN '{ask}'" for texts, ask in VAGUE)
    + f" WHEN regexp_matches(p, 'delete|remove|move|rename') AND regexp_matches(p, ' old ones| these | those ') THEN '{_WHICH}' END AS question FROM n"
)
def a3_clarification(spark, sf_dir):
    """Every snippet among these prompts is incomplete (A3, A4)."""
    return prompts(spark, sf_dir).select("prompt_id", clarification(F.col("prompt")).alias("question"))


# Verbs that ask for an action, and starts of questions.
VERBS = [
    "list", "show", "print", "find", "search", "create", "make", "delete", "remove", "copy", "move", "rename", "open", "run", "execute", "install", "uninstall", "upgrade", "compress", "archive", "extract", "replace", "change", "edit",
]
ASKING = ["what ", "what's ", "whats ", "why ", "how ", "where ", "which ", "should ", "can i ", "is ", "are ", "does ", "do "]
_ACTION = "^(please |can you |could you |i want you to )(" + "|".join(VERBS) + ") |^(" + "|".join(VERBS) + ")( |$)"
_DIRECT = "('documentation_question', 'web_current_info_question', 'diagnostic_debugging')"


@query(
    _CLASSIFY + ", w AS (SELECT prompt_id, prompt, lower(trim(prompt)) AS p, class FROM prompts JOIN c USING (prompt_id)) SELECT prompt_id, p <> '' AND NOT regexp_matches(p, '" + _ACTION + f"') AND (class IN {_DIRECT} OR "
    + " OR ".join(f"starts_with(p, '{a.replace(chr(39), chr(39) * 2)}')" for a in ASKING) + " OR p LIKE '%?') AS direct FROM w"
)
def a5_direct_answer(spark, sf_dir):
    """Prompts that want an answer rather than a command."""
    p = ascii_lower(F.trim("prompt"))
    rows = prompts(spark, sf_dir).select("prompt_id", p.alias("p"), classify(F.col("prompt"))["class"].alias("class"))
    wants = F.expr(f"class in {_DIRECT}") | any_of(F.col("p"), ASKING, F.startswith) | F.col("p").endswith("?")
    return rows.select("prompt_id", ((F.col("p") != "") & ~F.col("p").rlike(_ACTION) & wants).alias("direct"))


@query(f"WITH {PROMPTS_SQL} SELECT prompt_id, regexp_matches(lower(prompt), 'again|retry|re-run|rerun') AS retry, regexp_matches(lower(prompt), 'earlier|before|previous|last time|prior|that output') AS older FROM prompts")
def a12_intents(spark, sf_dir):
    p = ascii_lower("prompt")
    return prompts(spark, sf_dir).select("prompt_id", p.rlike("again|retry|re-run|rerun").alias("retry"), p.rlike("earlier|before|previous|last time|prior|that output").alias("older"))


@query(
    "WITH k AS (SELECT conv_id, turn, role || ': ' || CASE WHEN length(text) <= 400 THEN text ELSE left(text, 399) || '…' END AS entry, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), "
    "t AS (SELECT *, sum(greatest(length(entry) // 4, 1)) OVER (PARTITION BY conv_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS used FROM k WHERE r <= 25) "
    "SELECT conv_id, count(*) AS entries, CAST(max(used) AS BIGINT) AS used, sha256(string_agg(entry, chr(10) ORDER BY r)) AS digest FROM t WHERE used <= 300 GROUP BY conv_id"
)
def a9_context_budget(spark, sf_dir):
    """Newest entries of a conversation, each trimmed, as many as a token budget holds."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(newest)).where("r <= 25")
    rows = rows.select("conv_id", "r", F.concat("role", F.lit(": "), trim_to_tokens("text", 100)).alias("entry"))
    used = F.sum(tokens_down("entry")).over(Window.partitionBy("conv_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("used", used).where("used <= 300").groupBy("conv_id").agg(F.count(F.lit(1)).alias("entries"), F.max("used").alias("used"), F.sort_array(F.collect_list(F.struct("r", "entry"))).alias("x"))
    return kept.select("conv_id", "entries", "used", F.sha2(F.array_join(F.transform("x", lambda v: v["entry"]), "\n").cast("binary"), 256).alias("digest"))


@query("SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, conv_id, role AS source, sha256(text) AS ref FROM conversations")
def a13_source_ledger(spark, sf_dir):
    """References of a session in the order in which they were appended."""
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return table(spark, sf_dir, "conversations").select(seq.alias("seq"), "conv_id", F.col("role").alias("source"), F.sha2(F.col("text").cast("binary"), 256).alias("ref"))
