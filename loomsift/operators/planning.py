"""One validation round over drafted commands: all findings of a draft, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, ascii_lower_sql
from ..registry import query
from ..sources.tables import COMMANDS_SQL
from .drafts import ALL_RULES, DRAFTS_SQL, _text, drafts, effect_findings
from .scanner import scanned, scanned_sql
from .shell import _FLAGS_SQL, flags

# Kinds of findings and what they say.
EMPTY = "draft command is empty"
UNKNOWN = "first significant token is not installed in this shell context"
AMBIGUOUS = "shell parse was ambiguous"
RISKY = "ambiguous parse intersects pipelines/redirections/control operators"
UNGROUNDED = "proposal has no local grounding evidence"
MISSING = "flags missing from local docs: "
UNSORTED = "request asked for sorted/mtime behavior but draft lacks sort flags"


def missing_flags(command: Column, docs: Column) -> Column:
    """Flags that a documentation does not name in either case, sorted, each once."""
    low = ascii_lower(docs)
    return F.array_sort(F.array_distinct(F.filter(flags(command), lambda x: ~x.isin("-", "--") & ~F.contains(low, ascii_lower(x)))))


def wants_sorting(prompt: Column, command: Column) -> Column:
    asked = ascii_lower(prompt).rlike("modified|mtime|sorted") & ascii_lower(command).startswith("ls ")
    return asked & ~F.exists(flags(command), lambda x: x.isin("-t", "--sort"))


def validated(df: DataFrame) -> DataFrame:
    """``df`` (command, prompt, command_exists, docs, grounding: array) with findings: array<struct<kind, detail>>.

    An empty draft has that one finding; drafts without documentation have no flags to check."""
    df = scanned(df.withColumn("command", F.trim(F.regexp_replace(F.coalesce("command", F.lit("")), r"^\s+|\s+\z", ""))))
    command, prompt = F.col("command"), F.coalesce("prompt", F.lit(""))
    finding = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    gone = missing_flags(command, F.col("docs"))
    rules = [
        F.when(~F.col("command_exists"), finding("unknown_command", UNKNOWN)),
        F.when(F.col("ambiguous"), finding("parse_ambiguous", F.when(F.size("warnings") > 0, F.array_join("warnings", "; ")).otherwise(AMBIGUOUS))),
        F.when(F.col("ambiguous") & F.col("risky"), finding("parse_ambiguous_risky", RISKY)),
        F.when(F.size("grounding") == 0, finding("missing_grounding", UNGROUNDED)),
        F.when((F.coalesce("docs", F.lit("")) != "") & (F.size(gone) > 0), finding("unsupported_flag", F.concat(F.lit(MISSING), F.array_join(gone, ", ")))),
        F.when(wants_sorting(prompt, command), finding("insufficient_for_prompt", UNSORTED)),
    ]
    effects = F.transform(effect_findings(prompt, command), lambda says: finding("insufficient_for_prompt", says))
    found = F.concat(F.array_compact(F.array(*rules)), effects)
    return df.withColumn("findings", F.when(command == "", F.array(finding("insufficient_draft", EMPTY))).otherwise(found))


# Inputs: commands that exist here, and documentation of every third draft but one.
INSTALLED = ["ls", "cat", "echo", "find", "sort", "git", "tar", "grep", "rm", "cp", "mv", "du", "wc", "head", "tail", "mkdir", "chmod"]
DOCS = "usage: NAME -a -r -l -H -n --name --strip -x -z -f -type -maxdepth"


def context(df: DataFrame) -> DataFrame:
    n = F.col("cmd_id")
    docs = F.when(n % 3 == 0, "").otherwise(DOCS)
    return df.select("cmd_id", "prompt", "command", F.split_part(F.trim("command"), F.lit(" "), F.lit(1)).isin(INSTALLED).alias("command_exists"), docs.alias("docs"), F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("man"))).alias("grounding"))


_EFFECTS = ", ".join(f"CASE WHEN {wanted.sql()} AND NOT {met.sql()} THEN 'insufficient_for_prompt: ' || {_text(says)} END" for wanted, met, says in ALL_RULES)
_PLAN_FLAGS = _FLAGS_SQL.replace(COMMANDS_SQL, DRAFTS_SQL)


@query(
    _PLAN_FLAGS + f", {scanned_sql('shell_commands')}, s AS (SELECT cmd_id, {ascii_lower_sql('prompt')} AS p, {ascii_lower_sql('command')} AS c, command AS raw, array_to_string(flags, ' ') AS f, flags, "
    f"list_sort(list_distinct(list_filter(flags, lambda x: x NOT IN ('-', '--') AND NOT contains({ascii_lower_sql(repr(DOCS))}, {ascii_lower_sql('x')})))) AS gone FROM f JOIN (SELECT cmd_id, prompt FROM shell_commands) USING (cmd_id)) "
    f"SELECT cmd_id, CASE WHEN trim(raw) = '' THEN 'insufficient_draft: {EMPTY}' ELSE concat_ws(' | ', CASE WHEN split_part(trim(raw), ' ', 1) NOT IN ({', '.join(map(repr, INSTALLED))}) THEN 'unknown_command: {UNKNOWN}' END, "
    f"CASE WHEN ambiguous THEN 'parse_ambiguous: ' || CASE WHEN len(warnings) > 0 THEN array_to_string(warnings, '; ') ELSE '{AMBIGUOUS}' END END, CASE WHEN ambiguous AND risky THEN 'parse_ambiguous_risky: {RISKY}' END, "
    f"CASE WHEN cmd_id % 5 = 0 THEN 'missing_grounding: {UNGROUNDED}' END, CASE WHEN cmd_id % 3 <> 0 AND len(gone) > 0 THEN 'unsupported_flag: {MISSING}' || array_to_string(gone, ', ') END, "
    f"CASE WHEN regexp_matches(p, 'modified|mtime|sorted') AND starts_with(c, 'ls ') AND NOT list_has_any(flags, ['-t', '--sort']) THEN 'insufficient_for_prompt: {UNSORTED}' END, {_EFFECTS}) END AS findings FROM s JOIN scan USING (cmd_id)"
)
def p1_validation_round(spark, sf_dir):
    found = F.transform("findings", lambda f: F.concat_ws(": ", f["kind"], f["detail"]))
    return validated(context(drafts(spark, sf_dir))).select("cmd_id", F.array_join(found, " | ").alias("findings"))
