"""Shell command lines taken apart: lexemes by one expression, words and structure by expressions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import SCANNED_SQL, scanned_commands
from .shell import _FLOOR_SQL, FLOOR, first_of, floor_match

#: What a command line is made of: escaped characters, quoted runs (the last may be open), groups,
#: operators, white space, and runs of anything else.
LEXEME = r"""(?s)\\.|\\|'[^']*'?|"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|\$\(|[()]|\|\|?|&&?|;|[<>][<>]?|\s+|[^\\'"$()|&;<>\s]+|\$"""
OPERATOR = r"^[|&;<>]"
CLOSED = r'(?s)^"(?:[^"\\]++|\\.)*+"\z'
#: Loops that never give back are not recursive, so a quoted run may be of any length; SQL's engine knows no others.
_SQL_LEXEME, _SQL_CLOSED = (p.replace("++", "").replace("*+", "*") for p in (LEXEME, CLOSED))
STRUCTURE = ["pipeline", "control", "redirection", "substitution", "grouping", "unbalanced_group", "unbalanced_quotes", "trailing_operator"]


def lexemes(command: Column) -> Column:
    return F.regexp_extract_all(command, F.lit(LEXEME), F.lit(0))


def _open_quote(x: Column) -> Column:
    return x.isin("\\", "'", '"') | (x.startswith("'") & ~x.endswith("'")) | (x.startswith('"') & ~x.rlike(CLOSED))


def _said(x: Column) -> Column:
    """A lexeme without its quotes and escapes."""
    inside = F.regexp_replace(F.when(_open_quote(x), F.substring(x, 2, 1 << 30)).otherwise(F.regexp_replace(x, r'^"|"\z', "")), r"(?s)\\(.?)", "$1")
    return F.when(x.startswith("'"), F.regexp_replace(x, r"^'|'\z", "")).when(x.startswith('"'), inside).when(x.startswith("\\"), F.substring(x, 2, 1 << 30)).otherwise(x)


def words_of(parts: Column) -> Column:
    """Words of a line's lexemes: operators and white space part words, a parenthesis alone begins none."""

    def step(s: Column, x: Column) -> Column:
        ends = x.rlike(OPERATOR) | x.rlike(r"^\s")
        done = F.when(ends & (s["word"] != ""), F.array_append(s["words"], s["word"])).otherwise(s["words"])
        grown = F.when(x.isin("(", ")") & (s["word"] == ""), "").otherwise(F.concat(s["word"], _said(x)))
        return F.struct(done.alias("words"), F.when(ends, "").otherwise(grown).alias("word"))

    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit("").alias("word"))
    return F.aggregate(parts, start, step, lambda s: F.when(s["word"] != "", F.array_append(s["words"], s["word"])).otherwise(s["words"]))


def _groups(parts: Column) -> Column:
    """struct<open, bad>: parentheses that stay open, and whether one closes that none has opened."""

    def step(s: Column, x: Column) -> Column:
        now = F.when(x.isin("$(", "("), s["open"] + 1).when(x == ")", F.greatest(s["open"] - 1, F.lit(0))).otherwise(s["open"])
        return F.struct(now.alias("open"), (s["bad"] | ((x == ")") & (s["open"] == 0))).alias("bad"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("open"), F.lit(False).alias("bad")), step)


def scanned(df: DataFrame, command: str = "command") -> DataFrame:
    """``df`` with words, first, the flags in ``STRUCTURE``, ambiguous, risky and warnings of each command.

    A substitution inside double quotes is not seen, as ``$(`` there is plain text."""
    x = F.col("_x")
    df = df.withColumn("_x", lexemes(F.col(command))).withColumn("words", words_of(x)).withColumn("_group", _groups(x)).withColumn("first", first_of(F.col("words")))
    last = F.try_element_at(x, F.lit(-1))
    blank = F.coalesce(last.rlike(r"^\s"), F.lit(False))
    final = F.when(~blank, last).when(F.size("words") == 0, F.try_element_at(x, F.lit(-2)))
    has = lambda *of: F.exists(x, lambda v: v.isin(*of))
    found = {
        "pipeline": has("|"),
        "control": has("||", "&", "&&", ";"),
        "redirection": F.exists(x, lambda v: v.rlike("^[<>]")),
        "substitution": has("$("),
        "grouping": has("$(", "(", ")"),
        "unbalanced_group": F.col("_group.bad") | (F.col("_group.open") > 0),
        "unbalanced_quotes": F.coalesce(_open_quote(last), F.lit(False)),
        "trailing_operator": F.coalesce(final.rlike(OPERATOR), F.lit(False)),
    }
    df = df.withColumns(found)
    warnings = [
        F.when(F.col("_group.bad"), F.lit("unbalanced closing parenthesis")),
        F.when(F.col("unbalanced_quotes"), F.lit("unbalanced or unterminated quoting")),
        F.when(F.col("_group.open") > 0, F.lit("unbalanced grouping parentheses")),
        F.when(F.col("trailing_operator"), F.lit("command ends with a shell operator")),
    ]
    ambiguous = F.col("unbalanced_group") | F.col("unbalanced_quotes") | F.col("trailing_operator") | F.col("first").isNull()
    risky = F.col("pipeline") | F.col("control") | F.col("redirection") | F.col("substitution")
    return df.withColumns({"ambiguous": ambiguous, "risky": risky, "warnings": F.array_compact(F.array(*warnings))}).drop("_x", "_group")


_q = lambda p: p.replace("'", "''")


def scanned_sql(source: str) -> str:
    """CTEs that end in ``scan``: the same for a relation with cmd_id and command."""
    found = f"regexp_extract_all(command, '{_q(_SQL_LEXEME)}')"
    is_open = rf"""x IN ('\', '''', '"') OR (starts_with(x, '''') AND NOT ends_with(x, '''')) OR (starts_with(x, '"') AND NOT regexp_matches(x, '{_SQL_CLOSED}'))"""
    inside = r"""regexp_replace(CASE WHEN open_quote THEN substr(x, 2) ELSE regexp_replace(x, '^"|"\z', '', 'g') END, '(?s)\\(.?)', '\1', 'g')"""
    said = rf"""CASE WHEN starts_with(x, '''') THEN regexp_replace(x, '^''|''\z', '', 'g') WHEN starts_with(x, '"') THEN {inside} WHEN starts_with(x, '\') THEN substr(x, 2) ELSE x END"""
    none = r"^((sudo( -\S*)*|env|[A-Za-z_][A-Za-z0-9_]*=\S*)( |\z))*\z"
    return (
        f"lex AS (SELECT cmd_id, unnest({found}) AS x, generate_subscripts({found}, 1) AS pos FROM {source}), "
        rf"lq AS (SELECT *, {is_open} AS open_quote, regexp_matches(x, '{OPERATOR}') AS op, regexp_matches(x, '^\s') AS blank FROM lex), "
        f"lg AS (SELECT *, sum(CASE WHEN op OR blank THEN 1 ELSE 0 END) OVER (PARTITION BY cmd_id ORDER BY pos) AS g, CASE WHEN op OR blank THEN '' ELSE {said} END AS said FROM lq), "
        "lw AS (SELECT *, max(CASE WHEN said <> '' AND x NOT IN ('(', ')') THEN 1 ELSE 0 END) OVER (PARTITION BY cmd_id, g ORDER BY pos) AS begun FROM lg), "
        "ww AS (SELECT cmd_id, g, string_agg(CASE WHEN begun = 1 THEN said ELSE '' END, '' ORDER BY pos) AS word FROM lw GROUP BY ALL), "
        "wl AS (SELECT cmd_id, list(word ORDER BY g) AS words FROM ww WHERE word <> '' GROUP BY cmd_id), "
        "ld AS (SELECT *, sum(CASE WHEN x IN ('$(', '(') THEN 1 WHEN x = ')' THEN -1 ELSE 0 END) OVER (PARTITION BY cmd_id ORDER BY pos) AS s, count(*) OVER (PARTITION BY cmd_id) AS n FROM lq), "
        "lf AS (SELECT cmd_id, bool_or(x = '|') AS pipeline, bool_or(x IN ('||', '&', '&&', ';')) AS control, bool_or(regexp_matches(x, '^[<>]')) AS redirection, bool_or(x = '$(') AS substitution, "
        "bool_or(x IN ('$(', '(', ')')) AS in_groups, min(s) < 0 AS bad, max(CASE WHEN pos = n THEN s END) - least(0, min(s)) > 0 AS left_open, bool_or(pos = n AND open_quote) AS unbalanced_quotes, "
        "bool_or(pos = n AND op) AS op_last, bool_or(pos = n AND blank) AS blank_last, bool_or(pos = n - 1 AND op) AS op_before FROM ld GROUP BY cmd_id), "
        'sj AS (SELECT c.cmd_id, coalesce(words, []) AS words, coalesce(pipeline, false) AS pipeline, coalesce(control, false) AS control, coalesce(redirection, false) AS redirection, coalesce(substitution, false) AS substitution, coalesce(in_groups, false) AS "grouping", '
        "coalesce(bad, false) AS bad, coalesce(left_open, false) AS left_open, coalesce(unbalanced_quotes, false) AS unbalanced_quotes, coalesce(op_last OR (blank_last AND op_before AND words IS NULL), false) AS trailing_operator "
        f"FROM {source} c LEFT JOIN lf USING (cmd_id) LEFT JOIN wl USING (cmd_id)), "
        'scan AS (SELECT cmd_id, words, pipeline, control, redirection, substitution, "grouping", bad OR left_open AS unbalanced_group, unbalanced_quotes, trailing_operator, '
        f"bad OR left_open OR unbalanced_quotes OR trailing_operator OR regexp_matches(array_to_string(words, ' '), '{none}') AS ambiguous, pipeline OR control OR redirection OR substitution AS risky, "
        "list_filter([CASE WHEN bad THEN 'unbalanced closing parenthesis' END, CASE WHEN unbalanced_quotes THEN 'unbalanced or unterminated quoting' END, CASE WHEN left_open THEN 'unbalanced grouping parentheses' END, "
        "CASE WHEN trailing_operator THEN 'command ends with a shell operator' END], lambda w: w IS NOT NULL) AS warnings FROM sj)"
    )


_COLUMNS = [*STRUCTURE, "ambiguous", "risky"]


@query(f"WITH {SCANNED_SQL}, {scanned_sql('scanned_commands')} SELECT cmd_id, array_to_string(words, '¦') AS words, array_to_string(warnings, '; ') AS warnings, " + ", ".join(f'"{c}"' for c in _COLUMNS) + " FROM scan")
def g1_shell_scan(spark, sf_dir):
    """cmd_id and the structure of every command."""
    rows = scanned(scanned_commands(spark, sf_dir))
    return rows.select("cmd_id", F.array_join("words", "¦").alias("words"), F.array_join("warnings", "; ").alias("warnings"), *_COLUMNS)


def portable(pattern: str) -> str:
    """A floor pattern as an extended POSIX expression: named classes, and word starts as the place after
    white space."""
    for own, posix in ((r"[a-zA-Z]", "[[:alpha:]]"), (r"\S", "[^[:space:]]"), (r"\s", "[[:space:]]"), (r"\w", "[[:alnum:]_]")):
        pattern = pattern.replace(own, posix)
    return "(^|[[:space:]])" + pattern[2:] if pattern.startswith(r"\b") else pattern


def _named(pattern: str) -> str:
    """A POSIX expression for an engine that writes named classes as properties."""
    for posix, own in (("[^[:space:]]", r"\P{Space}"), ("[[:alpha:]]", r"\p{Alpha}"), ("[[:space:]]", r"\p{Space}"), ("[[:alnum:]_]", r"[\p{Alnum}_]")):
        pattern = pattern.replace(posix, own)
    return pattern


_PORTABLE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(command, '{_q(portable(p))}') THEN {i}" for i, p in enumerate(FLOOR)) + " END"


@query(f"WITH {SCANNED_SQL} SELECT cmd_id, {_PORTABLE_SQL} AS floor, ({_PORTABLE_SQL}) IS NOT DISTINCT FROM ({_FLOOR_SQL}) AS same FROM scanned_commands")
def g5_portable_floor(spark, sf_dir):
    """The floor in the shell's own syntax, and whether it finds what the floor finds."""
    command = F.col("command")
    found = F.coalesce(*[F.when(command.rlike(_named(portable(p))), F.lit(i)) for i, p in enumerate(FLOOR)])
    return scanned_commands(spark, sf_dir).select("cmd_id", found.alias("floor"), found.eqNullSafe(floor_match(command)).alias("same"))
