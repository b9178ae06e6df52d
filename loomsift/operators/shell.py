"""Shell commands: safety rules, parsing, flags and checks of a command against its prompt."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import COMMANDS_SQL, shell_commands

# Patterns of commands that are never run; the first match is reported.
FLOOR = [
    r"^\s*rm\s+-[a-zA-Z]*r[a-zA-Z]*\s+/(\s|$)",
    r"^\s*rm\s+-[a-zA-Z]*r[a-zA-Z]*\s+(\$HOME|~)(/|\s|$)",
    r"^\s*rm\s+-[a-zA-Z]*r[a-zA-Z]*\s+/\*",
    r"^\s*:\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:",
    r"\bdd\s+.*of=/dev/(disk|rdisk|sd|nvme)",
    r">\s*/dev/(disk|rdisk|sd|nvme)",
    r"\bmkfs(\.\w+)?\s+/dev/",
    r"^\s*sudo\s+rm\s+-[a-zA-Z]*r",
    r"\brm\s+-[a-zA-Z]*r[a-zA-Z]*\s+/(System|Library|usr|bin|sbin|etc|var)(/|\s|$)",
    r"\b(chmod|chown)\s+-R\s+\S+\s+/(\s|$)",
    r">\s*/(System|Library|usr|bin|sbin|etc)/",
    r"\bdiskutil\s+(eraseDisk|eraseVolume|secureErase)",
    r"\bcsrutil\s+disable",
    r"\bspctl\s+--master-disable",
    r"\bnvram\s+-c",
]
# Patterns of commands that need approval, in either case.
CRITICAL = [
    r"^\s*sudo\b",
    r"\brm\s+-[a-zA-Z]*r",
    r"\bgit\s+(push\s+--force|push\s+-f|reset\s+--hard|clean\s+-fdx)",
    r"\b(curl|wget)\b.*\|\s*(sh|bash|zsh)",
    r">\s*/dev/(disk|sd|nvme|rdisk)",
    r"\bchmod\s+(-R\s+)?777\b",
    r"\bchown\s+-R\b",
    r"\bmv\s+.*\s+/dev/null\b",
    r"\bdrop\s+(table|database)\b",
    r"\bkillall?\b",
    r"\bdocker\s+system\s+prune",
    r"\bbrew\s+uninstall\s+--force",
]
# Options of one dash that are a whole word.
WORD_OPTIONS = [
    "-maxdepth", "-mindepth", "-type", "-name", "-iname", "-regex", "-iregex", "-exec", "-path", "-prune", "-print", "-print0", "-mtime", "-mmin", "-size", "-empty", "-newer", "-perm", "-user", "-group", "-delete",
]


def floor_match(command: Column) -> Column:
    """Number of the first floor pattern that matches, or null."""
    return F.coalesce(*[F.when(command.rlike(p), F.lit(i)) for i, p in enumerate(FLOOR)])


def compiles(pattern: str) -> bool:
    """Whether the engine that runs a pattern accepts it."""
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return False
    return True


def is_critical(command: Column, patterns: list[str] = CRITICAL) -> Column:
    """Any pattern matches; patterns that don't compile are left out."""
    hit = F.lit(False)
    for p in patterns:
        if compiles("(?i)" + p):
            hit = hit | command.rlike("(?i)" + p)
    return hit


_q = lambda p: p.replace("'", "''")
_FLOOR_SQL = "CASE " + " ".join(f"WHEN regexp_matches(command, '{_q(p)}') THEN {i}" for i, p in enumerate(FLOOR)) + " END"
_CRITICAL_SQL = "(" + " OR ".join(f"regexp_matches(command, '(?i){_q(p)}')" for p in CRITICAL) + ")"


@query(f"WITH {COMMANDS_SQL} SELECT cmd_id, command, {_FLOOR_SQL} AS floor FROM shell_commands")
def g4_safety_floor(spark, sf_dir):
    return shell_commands(spark, sf_dir).select("cmd_id", "command", floor_match(F.col("command")).alias("floor"))


@query(f"WITH {COMMANDS_SQL}, c AS (SELECT cmd_id, {_CRITICAL_SQL} AS critical FROM shell_commands) SELECT cmd_id, critical, CASE WHEN cmd_id % 3 = 0 THEN 'ask' WHEN cmd_id % 3 = 1 AND critical THEN 'ask' ELSE 'run' END AS decision FROM c")
def g6_critical(spark, sf_dir):
    """Critical or not (G6), and what an approval mode (manual, manual_critical, auto) makes of it."""
    mode = F.element_at(F.array(F.lit("manual"), F.lit("manual_critical"), F.lit("auto")), (F.col("cmd_id") % 3 + 1).cast("int"))
    rows = shell_commands(spark, sf_dir).select("cmd_id", is_critical(F.col("command")).alias("critical"), mode.alias("mode"))
    ask = (F.col("mode") == "manual") | ((F.col("mode") == "manual_critical") & F.col("critical"))
    return rows.select("cmd_id", "critical", F.when(ask, "ask").otherwise("run").alias("decision"))


def first_significant(command: Column) -> Column:
    """The first word that is no sudo (with its options), env or assignment; null if none."""
    return first_of(F.filter(F.split(command, r"\s+"), lambda w: w != ""))


def first_of(words: Column) -> Column:
    """``first_significant`` of a command that is split into words."""

    def step(s: Column, w: Column) -> Column:
        skip = w.isin("sudo", "env") | w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=") | (s["sudo"] & w.startswith("-"))
        return F.struct(F.coalesce(s["found"], F.when(~skip, w)).alias("found"), ((w == "sudo") | (s["sudo"] & w.startswith("-"))).alias("sudo"))

    return F.aggregate(words, F.struct(F.lit(None).cast("string").alias("found"), F.lit(False).alias("sudo")), step)["found"]


@query(
    rf"WITH {COMMANDS_SQL} SELECT cmd_id, nullif(regexp_extract(regexp_replace(command, '^\s*((sudo(\s+-\S+)*|env|[A-Za-z_][A-Za-z0-9_]*=\S*)\s+)*', ''), '^\S+', 0), '') AS first FROM shell_commands"
)
def g2_first_token(spark, sf_dir):
    return shell_commands(spark, sf_dir).select("cmd_id", first_significant(F.col("command")).alias("first"))


@query(f"WITH {COMMANDS_SQL}, f AS (SELECT cmd_id, split_part(command, ' ', 1) AS first FROM shell_commands) SELECT cmd_id, first IN ('ls', 'cat', 'echo', 'find', 'sort', 'cd') AS known FROM f")
def g8_command_exists(spark, sf_dir):
    """First words that an index or the builtins know, by a join on the union of names."""
    names = spark.createDataFrame([(n,) for n in ("ls", "cat", "echo", "find")], "first string").union(spark.createDataFrame([("sort",), ("cd",)], "first string")).distinct()
    rows = shell_commands(spark, sf_dir).select("cmd_id", F.split_part("command", F.lit(" "), F.lit(1)).alias("first"))
    return rows.join(F.broadcast(names.withColumn("known", F.lit(True))), "first", "left").select("cmd_id", F.coalesce("known", F.lit(False)).alias("known"))


def flags(command: Column) -> Column:
    """Long options up to ``=``, word options whole, short clusters letter by letter; ``--`` ends."""
    words = F.filter(F.split(command, r"\s+"), lambda w: w != "")
    end = F.array_position(words, "--")
    words = F.when(end > 0, F.slice(words, F.lit(1), (end - 1).cast("int"))).otherwise(words)
    dashed = F.filter(words, lambda w: w.startswith("-") & (F.length(w) > 1))

    def expand(w: Column) -> Column:
        letters = F.transform(F.filter(F.split(F.substring(w, 2, 1000), ""), lambda c: c != ""), lambda c: F.concat(F.lit("-"), c))
        cluster = ~w.isin(WORD_OPTIONS) & (F.length(w) > 2) & ~F.contains(w, F.lit("="))
        return F.when(w.startswith("--"), F.array(F.split_part(w, F.lit("="), F.lit(1)))).when(cluster, letters).otherwise(F.array(w))

    return F.flatten(F.transform(dashed, expand))


_WORDS_SQL = r"list_filter(regexp_split_to_array(command, '\s+'), lambda w: w <> '')"
_FLAGS_SQL = (
    f"WITH {COMMANDS_SQL}, w AS (SELECT cmd_id, command, {_WORDS_SQL} AS w FROM shell_commands), d AS (SELECT cmd_id, command, list_filter(CASE WHEN list_position(w, '--') > 0 THEN w[1:list_position(w, '--') - 1] ELSE w END, lambda x: starts_with(x, '-') AND length(x) > 1) AS d FROM w), "
    f"f AS (SELECT cmd_id, command, flatten(list_transform(d, lambda x: CASE WHEN starts_with(x, '--') THEN [split_part(x, '=', 1)] WHEN x NOT IN ({', '.join(repr(o) for o in WORD_OPTIONS)}) AND length(x) > 2 AND NOT contains(x, '=') "
    "THEN list_transform(string_split(substr(x, 2), ''), lambda c: '-' || c) ELSE [x] END)) AS flags FROM d) "
)


@query(_FLAGS_SQL + "SELECT cmd_id, array_to_string(flags, ' ') AS flags FROM f")
def p6_flags(spark, sf_dir):
    return shell_commands(spark, sf_dir).select("cmd_id", F.array_join(flags(F.col("command")), " ").alias("flags"))


_DOCS = "usage: -a -r --name --strip -x -z -f NAME"


@query(_FLAGS_SQL + f"SELECT cmd_id, array_to_string(list_sort(list_distinct(list_filter(flags, lambda x: NOT contains('{_DOCS}', x)))), ' ') AS missing FROM f")
def p7_missing_flags(spark, sf_dir):
    """Flags that a command's documentation doesn't name, sorted."""
    missing = F.array_sort(F.array_distinct(F.filter(flags(F.col("command")), lambda x: ~F.contains(F.lit(_DOCS), x))))
    return shell_commands(spark, sf_dir).select("cmd_id", F.array_join(missing, " ").alias("missing"))


@query(rf"WITH {COMMANDS_SQL} SELECT cmd_id, regexp_replace(command, '\s*(\s*(&&|\|\||\||;|&))+\s*$', '') AS command FROM shell_commands")
def p9_stripped_operators(spark, sf_dir):
    return shell_commands(spark, sf_dir).select("cmd_id", F.regexp_replace("command", r"\s*(\s*(&&|\|\||\||;|&))+\s*$", "").alias("command"))
