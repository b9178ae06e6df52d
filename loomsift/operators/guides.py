"""What a guide says about commands: option purposes, combinations, phrases, and texts cut to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import cut_bytes, tokens_up
from ..registry import query
from ..sources.tables import table

# Commands, flags, and what such a flag is for.
KNOWN_OPTIONS = [
    (("ls",), ("-a", "--all", "-A", "--almost-all"), "hidden files and all entries"),
    (("ls",), ("-l", "--long"), "long detailed listings"),
    (("grep", "rg"), ("-i", "--ignore-case"), "case-insensitive matching"),
    (("grep", "rg"), ("-n", "--line-number"), "line numbers"),
    (("grep", "rg"), ("-v", "--invert-match"), "excluding or inverted matches"),
    (("grep", "rg"), ("-E", "--extended-regexp"), "extended regular expressions"),
    (("grep", "rg"), ("-F", "--fixed-strings"), "literal string matching"),
    (("grep", "rg"), ("-H", "--with-filename"), "showing filenames with matches"),
    (("grep", "rg"), ("-l", "--files-with-matches"), "showing filenames with matches"),
    (("grep", "rg"), ("-R", "-r", "--recursive"), "recursive traversal"),
    (("du", "df", "ls"), ("--human-readable",), "human-readable sizes"),
    (("du",), ("-s", "--summarize"), "total summary output"),
    (("mkdir",), ("-p", "--parents"), "creating parent directories"),
    (("tail",), ("-f", "--follow"), "following appended output"),
    (("tail",), ("-n",), "line counts"),
    (("find",), ("-name", "--name"), "filename matching"),
    (("find",), ("-type",), "files only, directories only, or file type filtering"),
    (("find",), ("-size",), "file size filters"),
    (("find",), ("-mtime", "-mmin", "-newer"), "modified time filters"),
    (("find",), ("-maxdepth", "-mindepth"), "depth-limited searches"),
    (("find",), ("-empty",), "empty files or directories"),
    (("find",), ("-exec", "-execdir"), "running a command for each match"),
    (("find",), ("-print", "-print0"), "printing matching paths"),
]
# Words in an option's line, and the purpose that they show.
OPTION_WORDS = [
    ("recursive", "recursive traversal"),
    ("ignore case", "case-insensitive matching"),
    ("case-insensitive", "case-insensitive matching"),
    ("hidden", "hidden files"),
    ("all files", "hidden files"),
    ("file name", "filename matching"),
    ("filename", "filename matching"),
    ("modification", "modified time filters"),
    ("human", "human-readable output"),
    ("summary", "total summary output"),
    ("line number", "line numbers"),
    ("parents", "parent directory creation"),
    ("empty", "empty files or directories"),
    ("size", "size filters"),
    ("larger", "larger-than size filters"),
    ("newer", "modified time filters"),
    ("older", "modified time filters"),
]
# Commands, groups of flags (one of each group must be there), and the combination's line.
COMBINATIONS = [
    (("find",), (("-type",), ("-name",)), "`find PATH -type f -name PATTERN`: find files only, not directories, whose filenames match a pattern."),
    (("find",), (("-type",), ("-empty",)), "`find PATH -type d -empty`: find empty directories; use `-type f -empty` for empty files."),
    (("find",), (("-type",), ("-mtime", "-mmin")), "`find PATH -type f -mtime N`: find files by modification age."),
    (("find",), (("-maxdepth",), ("-type",)), "`find PATH -maxdepth N -type f`: limit recursive search depth while selecting files."),
    (("find",), (("-type",), ("-size",)), "`find PATH -type f -size +N`: find files larger than a size threshold; use `-size -N` for smaller files."),
    (("grep", "rg"), (("-r", "-R", "--recursive"),), "`{} -R PATTERN PATH`: recursively search file contents for text."),
    (("grep", "rg"), (("-i", "--ignore-case"),), "`{} -i PATTERN PATH`: search text case-insensitively."),
    (("grep", "rg"), (("-l", "--files-with-matches"),), "`{} -l PATTERN PATH`: list filenames containing matches, not matching lines."),
    (("ls",), (("-a", "--all"),), "`ls -la PATH`: list all entries including hidden files with long details."),
    (("ls",), (("-S",),), "`ls -lhS PATH`: list entries sorted by size with human-readable sizes."),
    (("ls",), (("-t",),), "`ls -lt PATH`: list entries sorted by modification time."),
    (("du",), (("-s",), ("-h", "--human-readable")), "`du -sh PATH`: show total disk usage for a path in human-readable form."),
    (("mkdir",), (("-p", "--parents"),), "`mkdir -p PATH`: create a directory and any missing parent directories without error if it already exists."),
    (("tail",), (("-n",),), "`tail -n N FILE`: show the last N lines of a file or stream."),
    (("tail",), (("-f",),), "`tail -f FILE`: follow a growing log file as new lines arrive."),
]
# What a command is for, in the words of a task.
TASK_PHRASES = {
    "pwd": ["`pwd`: print the current working directory; answer where am I, what directory am I in, and show this folder path."],
    "ls": ["`ls`: list directory contents, files in a folder, hidden files, long details, sorted listings, and entries in a path."],
    "find": ["`find`: search for files or directories by name, type, size, age, emptiness, depth, or other filesystem metadata.", "`find -type f`: select files only, not directories.", "`find -type d`: select directories only, not files."],
    "grep": ["`grep`: search file contents for text, patterns, matches, case-insensitive matches, and names of files whose contents match."],
    "rg": ["`rg`: recursively search file contents for text, patterns, matches, case-insensitive matches, and names of files whose contents match."],
    "wc": ["`wc`: count lines, words, bytes, characters, or records in files or command output."],
    "head": ["`head`: show the first lines or first bytes of a file or command output."],
    "tail": ["`tail`: show the last lines, follow logs, or watch appended output from files."],
    "du": ["`du`: summarize disk usage for files or directories, including total size and human-readable size."],
    "df": ["`df`: show filesystem capacity, mounted disk free space, available space, and usage percentages."],
    "mkdir": ["`mkdir`: create directories, including missing parent directories when requested."],
    "touch": ["`touch`: create empty files or update file access and modification timestamps."],
    "cp": ["`cp`: copy files or directories, preserving the original source."],
    "mv": ["`mv`: move files, move directories, or rename paths."],
    "rm": ["`rm`: remove files or directories; recursive directory removal is destructive."],
    "cat": ["`cat`: print, concatenate, or inspect complete file contents."],
    "sort": ["`sort`: sort lines alphabetically, numerically, reverse order, or by selected keys."],
    "uniq": ["`uniq`: collapse adjacent duplicate lines; usually pair with `sort` for global duplicate removal."],
    "date": ["`date`: print or format the current date and time, including ISO dates like YYYY-MM-DD."],
    "chmod": ["`chmod`: change file permission bits or executable permissions."],
    "chown": ["`chown`: change file owner or group."],
    "tar": ["`tar`: create, extract, or list archive files such as .tar, .tar.gz, and .tgz."],
    "curl": ["`curl`: make HTTP requests, download URLs, send headers, inspect response codes, or post data."],
    "sed": ["`sed`: transform text streams, especially substitutions, deletions, and line-based edits."],
    "awk": ["`awk`: process structured text by fields and records, including filtering and calculations."],
}
# How a command differs from its neighbours.
RELATED = {
    "find": ["`find` locates filesystem paths by metadata such as name, type, size, and time; use `grep` or `rg` to search file contents.", "`find` walks directories recursively by default; `ls` lists directory entries without predicate filtering."],
    "grep": ["`grep` searches file contents; use `find` to search by filename or filesystem metadata.", "`rg` is a faster recursive grep-like searcher with smart defaults when installed."],
    "rg": ["`rg` searches file contents recursively with ignore-file awareness; `grep` is more universally available.", "`find` searches paths and metadata, not text contents."],
    "ls": ["`ls` lists directory entries; use `find` for recursive predicate-based filesystem searches.", "`du` reports disk usage; `ls -lh` reports apparent file sizes in listings."],
    "du": ["`du` estimates disk usage of paths; `df` reports filesystem free space and capacity.", "`ls -lh` shows file sizes in listings but does not summarize directory disk usage."],
    "df": ["`df` reports filesystem capacity and free space; `du` estimates usage for specific paths."],
    "head": ["`head` shows the first lines; `tail` shows the last lines or follows appended log output."],
    "tail": ["`tail` shows the last lines or follows logs; `head` shows the first lines."],
    "mkdir": ["`mkdir` creates directories; `touch` creates files or updates timestamps."],
    "touch": ["`touch` creates files or updates timestamps; `mkdir` creates directories."],
    "cp": ["`cp` copies files; `mv` moves or renames files."],
    "mv": ["`mv` moves or renames files; `cp` leaves the source in place."],
    "rm": ["`rm` removes files; `rmdir` removes empty directories only."],
    "wc": ["`wc` counts lines, words, and bytes; `grep -c` counts matching lines for a pattern."],
    "sort": ["`sort` orders lines; `uniq` only collapses adjacent duplicate lines, usually after sorting."],
    "uniq": ["`uniq` collapses adjacent duplicate lines; use `sort` first when duplicates are not already grouped."],
    "date": ["`date` formats dates and times; `time` measures how long a command takes."],
    "cat": ["`cat` prints whole files; `head` and `tail` show only the beginning or end."],
    "sed": ["`sed` edits streams line by line, especially substitutions; `awk` is better for field-aware records and calculations."],
    "awk": ["`awk` processes fields and records; `sed` is lighter for simple substitutions."],
}

# Inputs: options of commands; page n (a nation) leaves out every third one, from another start.
OPTIONS = [
    ("ls", "-a --all", "do not ignore hidden entries"), ("ls", "-S", "sort by file size, larger first"), ("ls", "-t", "sort by time, newer first"), ("ls", "--human-readable", "print human sizes"),
    ("grep", "-i --ignore-case", "ignore case distinctions"), ("grep", "-n --line-number", "print line number with output"), ("grep", "-R -r --recursive", "read all files, recursive"), ("rg", "-l", "print only each filename"),
    ("find", "-type", "file is of a type"), ("find", "-name", "base of file name matches"), ("find", "-mmin", "modification age in minutes"), ("find", "-empty", "file is empty"), ("find", "-maxdepth", "descend at most so many levels"), ("find", "-size", "file uses so much space"),
    ("du", "-s --summarize", "display only a summary"), ("du", "-h --human-readable", "Human readable"), ("mkdir", "-p --parents", "make parents as needed"), ("tail", "-n", "output the last lines"), ("tail", "-f --follow", "follow a file"), ("yes", "-x", "nothing known"),
]


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _list(v: list[str]) -> str:
    return "[" + ", ".join(map(_text, v)) + "]"


def command_options(spark, sf_dir) -> DataFrame:
    """page_id, command_name, pos, flags, description."""
    rows = F.array(*[F.struct(F.lit(c).alias("command_name"), F.split(F.lit(f), " ").alias("flags"), F.lit(d).alias("description")) for c, f, d in OPTIONS])
    each = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.posexplode(rows).alias("pos", "o"))
    return each.where((F.col("page_id") + F.col("pos")) % 3 != 0).select("page_id", F.col("pos").cast("long").alias("pos"), "o.*")


OPTIONS_SQL = (
    "options AS (SELECT CAST(n_nationkey AS BIGINT) AS page_id, pos, command_name, string_split(f, ' ') AS flags, description FROM nation, (VALUES "
    + ", ".join(f"({i}, {_text(c)}, {_text(f)}, {_text(d)})" for i, (c, f, d) in enumerate(OPTIONS))
    + ") v(pos, command_name, f, description) WHERE (n_nationkey + pos) % 3 <> 0)"
)


def option_intents(command: Column, flags: Column, description: Column) -> Column:
    """Purposes of an option, each once: those of its flags, then those of the words in its line."""
    by_flag = F.create_map(*[F.lit(x) for commands, names, intent in KNOWN_OPTIONS for c in commands for n in names for x in (f"{c} {n}", intent)])
    of_flags = F.transform(flags, lambda f: F.try_element_at(by_flag, F.concat_ws(" ", command, F.regexp_replace(f, r"^[\[\]]+|[\[\]]+$", ""))))
    line = F.lower(F.concat_ws(" ", command, F.array_join(flags, ", "), description))
    of_words = let(line, lambda line: F.array(*[F.when(F.contains(line, F.lit(word)), F.lit(label)) for word, label in OPTION_WORDS]))
    return F.array_distinct(F.array_compact(F.concat(of_flags, of_words)))


@query(
    f"WITH {OPTIONS_SQL}, known AS (SELECT unnest(string_split(c, ' ')) AS command_name, f, intent FROM (VALUES "
    + ", ".join(f"({_text(' '.join(c))}, {_text(' '.join(f))}, {_text(i)})" for c, f, i in KNOWN_OPTIONS)
    + ") k(c, f, intent)), flag AS (SELECT command_name, unnest(string_split(f, ' ')) AS flag, intent FROM known), words AS (SELECT * FROM (VALUES "
    + ", ".join(f"({100 + i}, {_text(w)}, {_text(label)})" for i, (w, label) in enumerate(OPTION_WORDS))
    + ") w(ord, word, intent)), own AS (SELECT page_id, pos, command_name, unnest(flags) AS flag, generate_subscripts(flags, 1) AS ord FROM options), "
    "hit AS (SELECT page_id, pos, ord, intent FROM own JOIN flag USING (command_name, flag) UNION ALL SELECT page_id, pos, ord, intent FROM options JOIN words ON contains(lower(command_name || ' ' || array_to_string(flags, ', ') || ' ' || description), word)), "
    "once AS (SELECT page_id, pos, intent, min(ord) AS ord FROM hit GROUP BY ALL) SELECT page_id, pos, string_agg(intent, '|' ORDER BY ord) AS intents FROM once GROUP BY ALL"
)
def k20_option_intents(spark, sf_dir):
    """Purposes of each option that has any; rules are an expression, so nothing is joined."""
    rows = command_options(spark, sf_dir).select("page_id", "pos", option_intents(F.col("command_name"), F.col("flags"), F.col("description")).alias("i"))
    return rows.where(F.size("i") > 0).select("page_id", "pos", F.array_join("i", "|").alias("intents"))


def combinations(command: Column, flags: Column) -> Column:
    """Lines of the combinations that a command's flags allow, in the rules' order."""
    out = []
    for commands, groups, line in COMBINATIONS:
        met = command.isin(list(commands))
        for group in groups:
            met = met & F.arrays_overlap(flags, F.array(*map(F.lit, group)))
        out.append(F.when(met, F.replace(F.lit(line), F.lit("{}"), command)))
    return F.array_compact(F.array(*out))


@query(
    f"WITH {OPTIONS_SQL}, own AS (SELECT page_id, command_name, flatten(list(flags)) AS flags FROM options GROUP BY ALL), rules AS (SELECT ord, unnest(string_split(c, ' ')) AS command_name, g, line FROM (VALUES "
    + ", ".join(f"({i}, {_text(' '.join(c))}, {_text(', '.join(map(' '.join, g)))}, {_text(line)})" for i, (c, g, line) in enumerate(COMBINATIONS))
    + ") r(ord, c, g, line)), met AS (SELECT page_id, command_name, ord, replace(line, '{}', command_name) AS line FROM own JOIN rules USING (command_name) WHERE len(list_filter(string_split(g, ', '), lambda x: NOT list_has_any(flags, string_split(x, ' ')))) = 0) "
    "SELECT page_id, command_name, string_agg(line, chr(10) ORDER BY ord) AS combinations FROM met GROUP BY ALL"
)
def k21_combinations(spark, sf_dir):
    """Combinations per command of a page; a page lists at most 48 options, which bounds the group."""
    own = command_options(spark, sf_dir).groupBy("page_id", "command_name").agg(F.array_distinct(F.flatten(F.collect_list("flags"))).alias("flags"))
    return own.select("page_id", "command_name", combinations(F.col("command_name"), F.col("flags")).alias("c")).where(F.size("c") > 0).select("page_id", "command_name", F.array_join("c", "\n").alias("combinations"))


def command_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def command_notes(spark) -> DataFrame:
    """name, phrases, related: a table of fixed size, a row per known command."""
    return spark.createDataFrame([(c, p, RELATED.get(c, [])) for c, p in TASK_PHRASES.items()], "name string, phrases array<string>, related array<string>")


_PATHS = [f"/usr/bin/{c}" for c in TASK_PHRASES] + ["/opt/own/tool", "plain"]


@query(
    f"WITH p AS (SELECT o_orderkey AS cmd_id, {_list(_PATHS)}[o_orderkey % {len(_PATHS)} + 1] AS path FROM orders), notes AS (SELECT * FROM (VALUES "
    + ", ".join(f"({_text(c)}, {_text('|'.join(p))}, {_text('|'.join(RELATED.get(c, [])))})" for c, p in TASK_PHRASES.items())
    + ") n(name, phrases, related)), c AS (SELECT cmd_id, string_split(path, '/')[-1] AS name FROM p) SELECT cmd_id, name, coalesce(phrases, '') AS phrases, coalesce(related, '') AS related FROM c LEFT JOIN notes USING (name)"
)
def k22_command_notes(spark, sf_dir):
    """Name of each path (K24), its task phrases (K22) and related commands (K23), empty where none is known."""
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("o_orderkey") % len(_PATHS) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cmd_id"), command_name(path).alias("name"))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return rows.join(F.broadcast(command_notes(spark)), "name", "left").select("cmd_id", "name", joined("phrases"), joined("related"))


# White space by Unicode, and the text that stands for an empty one.
SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NO_SENTENCE = "See local documentation for exact behavior."


def trim_sentence(text: Column, most: int) -> Column:
    """White space collapsed, then at most ``most`` bytes of whole characters; what is cut ends with an
    ASCII letter or digit.  An empty text, as a null one, gets a fixed sentence."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    whole = lambda c: F.when(c == "", F.lit(NO_SENTENCE)).otherwise(c)
    cut = lambda c: F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(cut_bytes(c, most), "[^A-Za-z0-9]+$", ""))
    return let(clean, lambda c: let(whole(c), cut))


@query(
    f"WITH a AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) AS c FROM documents), b AS (SELECT doc_id, CASE WHEN c = '' THEN '{NO_SENTENCE}' ELSE c END AS c FROM a) "
    "SELECT doc_id, CASE WHEN strlen(c) <= 120 THEN c ELSE regexp_replace(left(c, list_max(list_filter(range(0, 121), lambda n: strlen(left(left(c, 120), n)) <= 120))), '[^A-Za-z0-9]+$', '') END AS sentence FROM b"
)
def k19_trim_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", trim_sentence(F.col("text"), 120).alias("sentence"))


def wrap_names(names: Column, most: int) -> Column:
    """Names in order, each once, joined by commas into lines of at most ``most`` bytes."""

    def add(lines: Column, name: Column) -> Column:
        full = F.octet_length(F.substring_index(lines, "\n", -1)) + 2 + F.octet_length(name) > most
        return F.when(lines == "", name).when(full, F.concat(lines, F.lit("\n"), name)).otherwise(F.concat(lines, F.lit(", "), name))

    return F.aggregate(F.array_sort(F.array_distinct(names)), F.lit(""), add)


_WRAP_SQL = "list_reduce(list_sort(list_distinct({names})), lambda a, x: CASE WHEN strlen(string_split(a, chr(10))[-1]) + 2 + strlen(x) > {most} THEN a || chr(10) || x ELSE a || ', ' || x END)"


@query(f"SELECT n_regionkey, {_WRAP_SQL.format(names='list(n_name)', most=30)} AS lines FROM nation GROUP BY n_regionkey")
def l25_wrapped_names(spark, sf_dir):
    """Names of a session's functions in wrapped lines; here the nations of each region."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(wrap_names(F.collect_list("n_name"), 30).alias("lines"))


def sheet(commands: Column, aliases: Column, functions: Column, n_aliases: Column, n_functions: Column) -> Column:
    """A cheat sheet with the first so many aliases (``name = text`` lines) and functions."""
    more = lambda all_, n, what: F.when(n < F.size(all_), F.concat(F.lit("\n… (and "), (F.size(all_) - n).cast("string"), F.lit(f" more {what})"))).otherwise("")
    a = F.concat(F.lit("\n## Your aliases\n"), F.array_join(F.slice(aliases, F.lit(1), n_aliases), "\n"), more(aliases, n_aliases, "aliases"), F.lit("\n"))
    f = F.concat(F.lit("\n## Your functions\n"), wrap_names(F.slice(functions, F.lit(1), n_functions), 100), more(functions, n_functions, "functions"), F.lit("\n"))
    return F.concat(commands, F.when(n_aliases > 0, a).otherwise(""), F.when(n_functions > 0, f).otherwise(""))


def shrink(commands: Column, aliases: Column, functions: Column, most: int) -> Column:
    """The sheet within ``most`` tokens: functions go first, from the end, then aliases; when nothing
    fits, the whole sheet is cut hard and says so."""
    a, f = F.size(aliases), F.size(functions)
    whole = sheet(commands, aliases, functions, a, f)
    # Step k leaves out k functions, and once these are gone k - f aliases.
    steps = F.transform(F.sequence(F.lit(0), a + f), lambda k: sheet(commands, aliases, functions, F.least(a, a + f - k), F.greatest(f - k, F.lit(0))))
    fit = F.try_element_at(F.filter(steps, lambda s: tokens_up(s) <= most), F.lit(1))
    hard = F.concat(F.substring(whole, 1, 4 * most), F.lit("\n… (truncated for context budget)"))
    return F.coalesce(fit, hard)


def _sheet_sql(a: str, f: str) -> str:
    more = lambda all_, n, what: f"CASE WHEN {n} < len({all_}) THEN chr(10) || '… (and ' || (len({all_}) - {n}) || ' more {what})' ELSE '' END"
    return (
        f"commands || CASE WHEN {a} > 0 THEN chr(10) || '## Your aliases' || chr(10) || array_to_string(aliases[1:{a}], chr(10)) || {more('aliases', a, 'aliases')} || chr(10) ELSE '' END || "
        f"CASE WHEN {f} > 0 THEN chr(10) || '## Your functions' || chr(10) || {_WRAP_SQL.format(names=f'functions[1:{f}]', most=100)} || {more('functions', f, 'functions')} || chr(10) ELSE '' END"
    )


@query(
    "WITH r AS (SELECT n_regionkey, '# Commands' || chr(10) || n_regionkey AS commands, list('a' || n_nationkey || ' = run ' || lower(n_name) ORDER BY n_nationkey) AS aliases, list(lower(n_name) ORDER BY n_name) AS functions FROM nation GROUP BY n_regionkey), "
    "b AS (SELECT *, unnest([0, 3, 25, 40, 50, 200]) AS most FROM r), k AS (SELECT *, unnest(range(0, len(aliases) + len(functions) + 1)) AS k FROM b), "
    "n AS (SELECT *, least(len(aliases), len(aliases) + len(functions) - k) AS na, greatest(len(functions) - k, 0) AS nf FROM k), "
    f"s AS (SELECT *, {_sheet_sql('na', 'nf')} AS sheet FROM n) "
    "SELECT n_regionkey, most, coalesce(min_by(sheet, k) FILTER ((length(sheet) + 3) // 4 <= most), left(min_by(sheet, k), 4 * any_value(most)) || chr(10) || '… (truncated for context budget)') AS sheet FROM s GROUP BY n_regionkey, most"
)
def l24_shrunk_sheets(spark, sf_dir):
    """Cheat sheets under several budgets, from one that fits all to one that fits nothing."""
    own = F.struct("n_nationkey", F.concat(F.lit("a"), "n_nationkey", F.lit(" = run "), F.lower("n_name")).alias("x"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(own)), lambda v: v["x"]).alias("aliases"), F.sort_array(F.collect_list(F.lower("n_name"))).alias("functions"))
    rows = rows.withColumn("commands", F.concat(F.lit("# Commands\n"), "n_regionkey"))
    fits = F.array(*[F.struct(F.lit(m).alias("most"), shrink(F.col("commands"), F.col("aliases"), F.col("functions"), m).alias("sheet")) for m in (0, 3, 25, 40, 50, 200)])
    return rows.select("n_regionkey", F.inline(fits))
