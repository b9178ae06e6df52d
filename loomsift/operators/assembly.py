"""The prompt of a question with what fits of its session: recent terminal entries, then older memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, tokens_down
from ..registry import query
from ..sources.tables import table

#: Entries and items of memory that count.
RECENT, OLDER, FAILED_LINES = 25, 20, 8
WITH_TERMINAL = ["diagnostic_debugging", "referential_followup"]
RETRY, EARLIER = "again|retry|re-run|rerun", "earlier|before|previous|last time|prior|that output"


def trimmed(c: Column, most: Column) -> Column:
    """Four characters a token; a cut text ends with an ellipsis; nothing for no tokens."""
    return F.when(most <= 0, "").when(F.char_length(c) <= 4 * most, c).otherwise(F.concat(F.left(c, 4 * most - 1), F.lit("…")))


def entry_text(exact: Column) -> Column:
    """One terminal entry as lines; ``exact`` says whether its error output is repeated line by line."""
    line = lambda name, value, shown: F.when(shown, F.concat(F.lit(f"  {name}: "), value, F.lit("\n"))).otherwise("")
    listed = lambda name, column, by: line(name, F.array_join(column, by), F.size(column) > 0)
    output = lambda name: line(name, F.replace(F.col(name), F.lit("\n"), F.lit("\\n")), F.btrim(F.col(name), F.lit(" \t\n\r")) != "")
    tail = F.slice(F.split(F.regexp_replace("stderr_tail", r"\r?\n\z", ""), r"\r?\n", -1), 1, FAILED_LINES)
    repeated = F.concat(F.lit("  recent_failed_stderr_exact:\n"), F.array_join(F.transform(tail, lambda x: F.concat(F.lit("    "), x, F.lit("\n"))), ""))
    head = F.concat(
        F.lit("- "), F.date_format(F.timestamp_seconds("started"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" | cwd="), "cwd", F.lit(" | exit="), F.col("exit").cast("string"),
        F.lit(" | duration_ms="), F.col("duration").cast("string"), F.lit(" | capture="), "capture", F.lit("\n  $ "), "command", F.lit("\n"),
    )
    cut = F.concat(F.lit("  truncation: stdout="), F.col("stdout_cut").cast("string"), F.lit(" stderr="), F.col("stderr_cut").cast("string"), F.lit("\n"))
    return F.concat(
        head,
        F.when(F.col("stdout_cut") | F.col("stderr_cut"), cut).otherwise(""),
        F.when(F.col("redacted"), "  redaction: true\n").otherwise(""),
        listed("detected_commands", F.col("commands"), ", "),
        listed("detected_paths", F.col("paths"), ", "),
        listed("detected_urls", F.col("urls"), ", "),
        listed("error_lines", F.col("errors"), " | "),
        output("stdout_head"),
        output("stdout_tail"),
        output("stderr_head"),
        output("stderr_tail"),
        F.when(exact, repeated).otherwise(""),
        *[F.coalesce(F.concat(F.lit(f"  {name}: "), name, F.lit("\n")), F.lit("")) for name in ("stdout_ref", "stderr_ref")],
    )


def _block(rows: DataFrame, title: str, name: str) -> DataFrame:
    """Texts in the order of ``k`` under a title; a session's rows are bounded before they are gathered."""
    return rows.groupBy("session").agg(F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")).alias(name))


def assembled(asked: DataFrame, entries: DataFrame, memory: DataFrame) -> DataFrame:
    """session, prompt, blocks: the question, then each section within the least of its own cap and what is left.

    ``asked`` has session, question, label, confidence and the limits in tokens: total, reserve, for_question,
    for_recent, for_older.  ``entries`` are newest first, ties as they came (``n``); ``memory`` (session, n, item) keeps
    the last items.  Recent entries go with the labels in ``WITH_TERMINAL``; memory too, if the question speaks
    of earlier state or of trying again, or nothing was observed."""
    newest = Window.partitionBy("session").orderBy(F.desc("started"), "n")
    ranked = entries.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= RECENT)
    failed = (F.col("exit") != 0) & (F.btrim(F.col("stderr_tail"), F.lit(" \t\n\r")) != "")
    first = F.min(F.when(failed, F.col("k"))).over(Window.partitionBy("session"))
    ranked = ranked.withColumn("first", first).select("session", "k", entry_text(failed & (F.col("k") == F.col("first"))).alias("text"))
    last = memory.withColumn("back", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("n")))).where(F.col("back") <= OLDER)
    last = last.select("session", F.col("n").alias("k"), F.concat(F.lit("- "), "item", F.lit("\n")).alias("text"))
    rows = asked.join(_block(ranked, "Recent terminal context", "recent"), "session", "left").join(_block(last, "Older session memory", "older"), "session", "left")
    used = lambda c, left: F.least(tokens_down(c), left)
    left = F.greatest(F.col("total") - F.col("reserve"), F.lit(0))
    rows = rows.withColumn("left", F.when(left == 0, F.greatest("for_question", F.lit(256))).otherwise(left))
    rows = rows.withColumn("own", trimmed(F.col("question"), F.least("for_question", "left"))).withColumn("left", F.col("left") - used("own", F.col("left")))
    low = ascii_lower("question")
    with_recent = F.col("label").isin(WITH_TERMINAL)
    with_older = with_recent & (low.rlike(EARLIER) | low.rlike(RETRY) | F.col("recent").isNull())
    # A session without entries has the section's title alone.
    recent = trimmed(F.coalesce("recent", F.lit("## Recent terminal context\n")), F.least("for_recent", "left"))
    rows = rows.withColumn("shown", F.when(with_recent & (F.col("left") > 0), recent).otherwise(""))
    rows = rows.withColumn("left", F.when(F.col("shown") != "", F.col("left") - used("shown", F.col("left"))).otherwise(F.col("left")))
    rows = rows.withColumn("kept", F.when(with_older & (F.col("left") > 0) & F.col("older").isNotNull(), trimmed(F.col("older"), F.least("for_older", "left"))).otherwise(""))
    part = lambda c: F.when(F.col(c) != "", F.concat(F.lit("\n\n"), c)).otherwise("")
    suffix = F.format_string("\n\n[task_classification=%s confidence=%.2f]", "label", "confidence")
    blocks = F.concat_ws(",", F.lit("current_question"), F.when(F.col("shown") != "", "recent_terminal"), F.when(F.col("kept") != "", "older_session"))
    return rows.select("session", F.concat("own", part("shown"), part("kept"), suffix).alias("prompt"), blocks.alias("blocks"))


# Inputs: questions, labels and limits by session number; sessions of six conversations, whose turns are entries.
QUESTIONS = ["why did that fail", "run it again", "show the previous output", "list files"]
LABELS = ["diagnostic_debugging", "referential_followup", "diagnostic_debugging", "fresh_command_request"]
LIMITS = [(2600, 600, 60, 900, 500), (900, 600, 12, 900, 500), (500, 600, 40, 200, 30), (4000, 100, 400, 1200, 100), (700, 690, 4, 900, 500)]
_LIMIT_NAMES = ["total", "reserve", "for_question", "for_recent", "for_older"]
CAPTURES = ["captured", "excluded_interactive", "skipped_interactive_tty"]


def sessions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").withColumn("session", F.floor(F.col("conv_id") / 6).cast("long")).withColumn("n", F.col("conv_id") * 100 + F.col("turn"))
    n, s = F.col("n"), F.col("session")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    some = lambda cond, *values: F.when(cond, F.array(*values)).otherwise(F.array().cast("array<string>"))
    number = n.cast("string")
    entries = turns.where("session % 9 <> 4").select(
        "session", "n", (F.lit(1_700_000_000) + (n * 37) % 50 * 60).alias("started"), F.concat(F.lit("/w/"), (F.col("conv_id") % 7).cast("string")).alias("cwd"), (n % 3).alias("exit"), (n * 13 % 5000).alias("duration"),
        pick(CAPTURES, n).alias("capture"), F.concat("role", F.lit(" run "), number).alias("command"), (n % 5 == 0).alias("stdout_cut"), (n % 7 == 0).alias("stderr_cut"), (n % 4 == 0).alias("redacted"),
        F.slice(F.regexp_extract_all("text", F.lit("th[a-z]+"), F.lit(0)), F.lit(1), (n % 3).cast("int")).alias("commands"), some(n % 2 == 0, F.concat(F.lit("/p/"), number), F.lit("/q")).alias("paths"), some(n % 6 == 0, F.concat(F.lit("https://u/"), number)).alias("urls"),
        some(n % 3 == 1, F.concat(F.lit("error: "), number), F.lit("at line 2")).alias("errors"), F.left("text", F.lit(40)).alias("stdout_head"), F.when(n % 2 == 1, F.right("text", F.lit(30))).otherwise(" \n ").alias("stdout_tail"), F.lit("").alias("stderr_head"),
        F.when((n % 3 != 0) & (n % 4 != 1), F.left("text", F.lit(300))).otherwise("").alias("stderr_tail"), F.when(n % 9 == 0, F.concat(F.lit("ref:"), number)).alias("stdout_ref"), F.lit(None).cast("string").alias("stderr_ref"),
    )
    memory = turns.where("turn % 2 = 0 and session % 7 <> 3").select("session", "n", F.concat("role", F.lit(": "), F.left("text", F.lit(30))).alias("item"))
    asked = turns.select("session").distinct().select("session", F.concat(pick(QUESTIONS, s), F.when(s % 5 == 1, F.repeat(F.lit(" please"), 20)).otherwise("")).alias("question"), pick(LABELS, s).alias("label"), (s % 100 / 100).alias("confidence"), F.array(*[F.array(*map(F.lit, x)) for x in LIMITS])[(s % len(LIMITS)).cast("int")].alias("limits"))
    return asked.select("session", "question", "label", "confidence", *[F.col("limits")[i].alias(c) for i, c in enumerate(_LIMIT_NAMES)]), entries, memory


def _trim_sql(c: str, most: str) -> str:
    return f"CASE WHEN {most} <= 0 THEN '' WHEN length({c}) <= 4 * {most} THEN {c} ELSE left({c}, 4 * {most} - 1) || '…' END"


_OUT_SQL = lambda name: f"CASE WHEN regexp_matches({name}, '\\S') THEN '  {name}: ' || replace({name}, chr(10), '\\n') || chr(10) ELSE '' END"
_LIST_SQL = lambda name, c, by: f"CASE WHEN len({c}) > 0 THEN '  {name}: ' || array_to_string({c}, '{by}') || chr(10) ELSE '' END"
_ENTRIES_SQL = (
    "turns AS (SELECT *, conv_id // 6 AS session, conv_id * 100 + turn AS n FROM conversations), "
    "e AS (SELECT session, n, 1700000000 + (n * 37) % 50 * 60 AS started, '/w/' || (conv_id % 7) AS cwd, n % 3 AS ex, n * 13 % 5000 AS duration, ['captured', 'excluded_interactive', 'skipped_interactive_tty'][n % 3 + 1] AS capture, role || ' run ' || n AS command, "
    "n % 5 = 0 AS so, n % 7 = 0 AS se, n % 4 = 0 AS red, regexp_extract_all(text, 'th[a-z]+')[1:n % 3] AS commands, CASE WHEN n % 2 = 0 THEN ['/p/' || n, '/q'] ELSE [] END AS paths, CASE WHEN n % 6 = 0 THEN ['https://u/' || n] ELSE [] END AS urls, CASE WHEN n % 3 = 1 THEN ['error: ' || n, 'at line 2'] ELSE [] END AS errors, "
    "left(text, 40) AS stdout_head, CASE WHEN n % 2 = 1 THEN right(text, 30) ELSE ' ' END AS stdout_tail, CASE WHEN n % 3 <> 0 AND n % 4 <> 1 THEN left(text, 300) ELSE '' END AS stderr_tail, CASE WHEN n % 9 = 0 THEN 'ref:' || n END AS stdout_ref FROM turns WHERE session % 9 <> 4), "
    "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY started DESC, n) AS k FROM e) WHERE k <= 25), "
    "x AS (SELECT *, k = min(CASE WHEN ex <> 0 AND regexp_matches(stderr_tail, '\\S') THEN k END) OVER (PARTITION BY session) AS exact FROM r), "
    "t AS (SELECT session, k, '- ' || strftime(make_timestamp(started * 1000000), '%Y-%m-%dT%H:%M:%SZ') || ' | cwd=' || cwd || ' | exit=' || ex || ' | duration_ms=' || duration || ' | capture=' || capture || chr(10) || '  $ ' || command || chr(10) "
    "|| CASE WHEN so OR se THEN '  truncation: stdout=' || so || ' stderr=' || se || chr(10) ELSE '' END || CASE WHEN red THEN '  redaction: true' || chr(10) ELSE '' END || "
    + " || ".join([_LIST_SQL("detected_commands", "commands", ", "), _LIST_SQL("detected_paths", "paths", ", "), _LIST_SQL("detected_urls", "urls", ", "), _LIST_SQL("error_lines", "errors", " | "), _OUT_SQL("stdout_head"), _OUT_SQL("stdout_tail"), _OUT_SQL("stderr_tail")])
    + " || CASE WHEN exact THEN '  recent_failed_stderr_exact:' || chr(10) || array_to_string(list_transform(string_split(regexp_replace(stderr_tail, '\\n$', ''), chr(10))[1:8], lambda v: '    ' || v || chr(10)), '') ELSE '' END || coalesce('  stdout_ref: ' || stdout_ref || chr(10), '') AS text FROM x), "
    "recent AS (SELECT session, '## Recent terminal context' || chr(10) || string_agg(text, '' ORDER BY k) AS recent FROM t GROUP BY session), "
    "m AS (SELECT session, n, '- ' || role || ': ' || left(text, 30) || chr(10) AS item, row_number() OVER (PARTITION BY session ORDER BY n DESC) AS back FROM turns WHERE turn % 2 = 0 AND session % 7 <> 3), "
    "older AS (SELECT session, '## Older session memory' || chr(10) || string_agg(item, '' ORDER BY n) AS older FROM m WHERE back <= 20 GROUP BY session), "
    f"q AS (SELECT DISTINCT session, [{', '.join(repr(x) for x in QUESTIONS)}][session % 4 + 1] || CASE WHEN session % 5 = 1 THEN repeat(' please', 20) ELSE '' END AS question, [{', '.join(repr(x) for x in LABELS)}][session % 4 + 1] AS label, session % 100 / 100 AS confidence, {[list(x) for x in LIMITS]}[session % 5 + 1] AS l FROM turns), "
    "b AS (SELECT *, CASE WHEN greatest(l[1] - l[2], 0) = 0 THEN greatest(l[3], 256) ELSE l[1] - l[2] END AS b0, label IN ('diagnostic_debugging', 'referential_followup') AS term FROM q LEFT JOIN recent USING (session) LEFT JOIN older USING (session)), "
    f"o AS (SELECT *, {_trim_sql('question', 'least(l[3], b0)')} AS own FROM b), b1 AS (SELECT *, b0 - least(greatest(length(own) // 4, 1), b0) AS b1 FROM o), "
    f"s AS (SELECT *, CASE WHEN term AND b1 > 0 THEN {_trim_sql('rr', 'least(l[4], b1)')} ELSE '' END AS shown FROM (SELECT *, coalesce(recent, '## Recent terminal context' || chr(10)) AS rr FROM b1)), b2 AS (SELECT *, CASE WHEN shown <> '' THEN b1 - least(greatest(length(shown) // 4, 1), b1) ELSE b1 END AS b2 FROM s), "
    f"k AS (SELECT *, CASE WHEN term AND (regexp_matches(question, 'again|retry|re-run|rerun|earlier|before|previous|last time|prior|that output') OR recent IS NULL) AND b2 > 0 AND older IS NOT NULL THEN {_trim_sql('older', 'least(l[5], b2)')} ELSE '' END AS kept FROM b2)"
)


@query(
    f"WITH {_ENTRIES_SQL} SELECT session, own || CASE WHEN shown <> '' THEN chr(10) || chr(10) || shown ELSE '' END || CASE WHEN kept <> '' THEN chr(10) || chr(10) || kept ELSE '' END || chr(10) || chr(10) || format('[task_classification={{}} confidence={{:.2f}}]', label, confidence) AS prompt, "
    "'current_question' || CASE WHEN shown <> '' THEN ',recent_terminal' ELSE '' END || CASE WHEN kept <> '' THEN ',older_session' ELSE '' END AS blocks FROM k"
)
def a10_context_assembly(spark, sf_dir):
    """Prompts of sessions with their three sections, entry format and error output once."""
    return assembled(*sessions(spark, sf_dir))
