"""What a drafted command lacks for its prompt, and how findings revise it.

A rule pairs a test of what the prompt asks with a test that the command meets it.  Tests are regular
expressions over the folded prompt (``p``), the folded command (``c``), the command as it is (``raw``)
or its flags (``f``), joined by ``&``, ``|`` and ``~``; they compile to a column or to SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, ascii_lower_sql
from ..registry import query
from ..sources.tables import COMMANDS_SQL, table
from .shell import _FLAGS_SQL, flags


@dataclass(frozen=True)
class Test:
    op: str
    args: tuple

    def __and__(self, other: Test) -> Test:
        return Test("AND", (self, other))

    def __or__(self, other: Test) -> Test:
        return Test("OR", (self, other))

    def __invert__(self) -> Test:
        return Test("NOT", (self,))

    def column(self, subjects: dict[str, Column]) -> Column:
        if self.op == "match":
            return F.rlike(subjects[self.args[0]], F.lit(self.args[1]))
        parts = [a.column(subjects) for a in self.args]
        return ~parts[0] if self.op == "NOT" else parts[0] & parts[1] if self.op == "AND" else parts[0] | parts[1]

    def sql(self) -> str:
        if self.op == "match":
            return f"regexp_matches({self.args[0]}, {_text(self.args[1])})"
        parts = [a.sql() for a in self.args]
        return f"(NOT {parts[0]})" if self.op == "NOT" else f"({f' {self.op} '.join(parts)})"


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def p(pattern: str) -> Test:
    return Test("match", ("p", pattern))


def c(pattern: str) -> Test:
    return Test("match", ("c", pattern))


def raw(pattern: str) -> Test:
    return Test("match", ("raw", pattern))


def flag(letter: str) -> Test:
    return Test("match", ("f", f"(^| )-{letter}( |$)"))


def asks(words: str) -> Test:
    """One of the words stands in the prompt as a whole."""
    return p(f"(^|[^a-z0-9])({words})([^a-z0-9]|$)")


def runs(words: str) -> Test:
    """One of the words stands in the command as a whole; ``-`` and ``_`` belong to words."""
    return c(f"(^|[^a-z0-9_-])({words})([^a-z0-9_-]|$)")


FILES = c("-type f")
FINDS = c("^find ")
COPIES, MOVES = runs("cp|rsync|ditto"), runs("mv") | c("--remove-source-files")
LISTS_OR_TRANSFERS = p("list|show|find|search|copy|move|open")
WANTS_COPY, WANTS_MOVE = asks("copy|duplicate"), asks("move|rename")
WANTS_FOLDER = asks("folders?|directory|directories") & (
    p("new (folder|directory)|(folder|directory) (named|called|on)|into (a|the) (folder|directory)") | (asks("create|make") & p(" (named|called) "))
)
WANTS_DEPTH = p("recursive|subfolder|subdirector|under")
GOES_DEEP = (runs("find") & ~c("-maxdepth 1")) | c(r"\*\*") | runs("rsync|rg") | (runs("grep") & c(r"(^|\s)(--recursive(\s|$)|-r|-[^-\s]\S*r)")) | c(" -r ")
TRANSFERS = (WANTS_COPY | WANTS_MOVE) & (WANTS_FOLDER | WANTS_DEPTH)
COUNTS = p("how many|count") & p("file")
SEARCHES = (
    ~p("search web|search the web|web search|internet|online")
    & ~(asks("directory|directories|folders?") & p("containing") & ~p("content|text|todo"))
    & p("search|grep|matches|containing|contains")
    & ~p("files? named|filename|file name|named |called ")
    & p(" for |todo|text|phrase|content|case[ -]insensitive")
)
PLAIN_LISTING = (
    p("list|show")
    & p("files|contents|everything|entries")
    & ~p("(not|no|exclude|without) (directories|files)|only (directories|files)|(directories|directory|files) only")
    & ~p(r"recursive|subfolder|subdirectories|image|photo|picture|markdown|\.md|count|how many|oldest|newest|recent|open|copy|move|largest|biggest|larger|smaller|modified|created|sort|by size")
)
FILES_ALONE = ~p("file") | raw(r"-type f|\*\(\.\)|grep -v '?/")
BY_SIZE = (
    (Test("match", ("raw", "(^|[^A-Za-z0-9_-])ls([^A-Za-z0-9_-]|$)")) & flag("S") & FILES_ALONE)
    | (runs("du") & runs("sort") & FILES_ALONE & (~p("file") | raw("-type f")))
    | (runs("find") & raw("-size"))
    | (runs("find") & raw("stat") & raw("%z") & runs("sort"))
)
LARGEST_MET = BY_SIZE & (~p(" (3|three|10|ten) largest|top ") | runs("head") | raw("-n (3|10)"))
RANKED_FILE_MET = runs("find") & FILES & c("stat -f") & c("%m") & ((p("oldest") & c("sort -n")) | (~p("oldest") & c("sort -nr"))) & c("head -n 1") & c("cut ") & c("-f2-")
HOMES = {"download": "downloads", "desktop": "desktop", "document": "documents", "picture": "pictures", "movie": "movies", "music": "music"}


def _wrong_home() -> Test:
    """The first folder of the list that the prompt names is not in the command."""
    wrong, before = None, []
    for word, folder in HOMES.items():
        here = p(word) & ~c(rf"(\$home|~)/{folder}")
        here = here & ~p("|".join(before)) if before else here
        wrong = wrong | here if wrong else here
        before.append(word)
    return wrong


WRONG_HOME = _wrong_home()

# In order: what the prompt asks, what meets it, and the finding where it is not met.  Texts are fixed values.
RULES = [
    (PLAIN_LISTING, ~(c(r" \| (grep|awk|sed|xargs) ") | (FINDS & FILES)), "plain listing request should not add filtering, recursion, or transformation"),
    (p("largest") & p("file"), LARGEST_MET, "largest-file request needs size sorting or filtering and should limit results when a count is requested"),
    (p("oldest|newest|most recent") & asks("file") & ~p("subdirectories|subdirectory"), RANKED_FILE_MET, "oldest/newest-file request should select one regular file path using mtime sorting, not dump a directory listing"),
    (p("only directories|directories,? not files|folders,? not files") & p("show|list|find"), (runs("find") & c("-type d")) | (runs("ls") & flag("d") & c(r"\*/")), "directories-only request must select directories rather than all entries"),
    (p("empty (directory|directories)") & asks("delete|remove|rmdir"), runs("find") & c("-type d") & c("-empty") & (c("-delete") | runs("rmdir|rm")), "empty-directory deletion request must find empty directories and delete/rmdir them"),
    (p("most recently modified file") & p("subdirectory|subdirectories"), (runs("for") & runs("head")) | (runs("find") & runs("sort|stat")) | (runs("ls") & flag("t") & runs("head")), "per-subdirectory newest-file request needs per-directory traversal and modification-time sorting"),
    (p("file") & p("since the last commit|changed files|what files i('ve| have) changed"), runs("git") & runs("status|diff"), "git changed-files request should use git status or git diff"),
    (p("disk usage by filesystem|disk space free"), runs("df"), "filesystem disk-usage request should use df, not a directory listing"),
    (p("backup") & p("folder|directory") & p("today|date"), runs("tar|cp|ditto") & c("date"), "dated backup request should create a backup/archive and include today's date"),
    (p("cd into|change into|enter it|go into") & p("directory|folder"), (runs("mkdir") & runs("cd")) | runs("mkcd"), "create-and-cd request must both create the directory and cd into it"),
    (COUNTS, c("wc -l"), "file-count request needs a count-producing command such as wc -l"),
    (COUNTS, (FINDS & FILES) | (c(r" \| grep ") & c("grep -v ('/[$]'|\"/[$]\")")), "file-count request must count regular files, not directories or all entries"),
    (SEARCHES, runs("grep|rg|ag|ack") | c("git grep"), "text-search request needs a content-search command such as grep or rg"),
    (SEARCHES & p("case[ -]insensitive"), c(r"(^|\s)(--ignore-case(\s|$)|-i|-[^-\s]\S*i)"), "case-insensitive text search needs an ignore-case flag"),
    (p("image|photo|picture") & LISTS_OR_TRANSFERS, c("jpg|jpeg|png|gif|webp|heic|tif|bmp"), "image-file request needs an image extension filter"),
    (p("image|photo|picture") & LISTS_OR_TRANSFERS & FINDS, FILES, "image-file request must restrict results to regular files"),
    (p(r"markdown|\.md") & LISTS_OR_TRANSFERS, c(r"\.md|\.markdown"), "Markdown-file request needs a .md or .markdown filter"),
    (p(r"markdown|\.md") & LISTS_OR_TRANSFERS & FINDS, FILES, "Markdown-file request must restrict results to regular files"),
    (WANTS_DEPTH & LISTS_OR_TRANSFERS, GOES_DEEP, "recursive request has no recursive traversal or selection step"),
]
# The same for prompts that transfer files into a new or deep place.
TRANSFER_RULES = [
    (WANTS_FOLDER, runs("mkdir"), "compound request creates a destination folder but draft has no mkdir step"),
    (WANTS_FOLDER & (WANTS_COPY | WANTS_MOVE) & runs("mkdir"), c("&&"), "destination creation should be chained before the transfer with &&"),
    (WANTS_COPY, COPIES, "compound copy request has no copy operation"),
    (WANTS_MOVE, MOVES, "compound move request has no move operation"),
    (WANTS_DEPTH, GOES_DEEP, "recursive request has no recursive traversal or selection step"),
    (p("file") & c("find "), FILES, "file transfer should select regular files, not directories"),
    (c("find ") & c("xargs"), (c("-print0") & c("xargs -0")) | c("-exec "), "find-to-xargs transfer should be null-delimited or use -exec"),
    (p("|".join(HOMES)), ~WRONG_HOME, "draft does not mention the requested standard home folder"),
]
ALL_RULES = RULES + [(TRANSFERS & wanted, met, says) for wanted, met, says in TRANSFER_RULES]

# Inputs: the n-th order gets a prompt and a draft, so that every prompt meets every draft.
ASKS = [
    "list files here", "show the 3 largest files", "open the newest file", "list only directories", "delete every empty directory", "show the most recently modified file in each subdirectory",
    "which files changed since the last commit", "disk usage by filesystem", "backup this folder with the date", "make a folder and cd into it", "how many files are here", "search for TODO in text, case insensitive",
    "show images", "find markdown notes", "copy files recursively into a new folder on the Desktop", "move photos under Downloads into a folder named old", "rename things", "list everything containing text",
]
DRAFTS = [
    "ls -la", "ls -lS | head -n 3", "find . -type f | wc -l", "find . -type d -empty -delete", "git status", "df -h", "tar -czf a-$(date +%F).tgz .", "mkdir x && cd x", "grep -Rni TODO .", "rg todo",
    "find . -name '*.md'", "find . -type f -name '*.png'", "mkdir -p ~/Desktop/new && cp -r . ~/Desktop/new", "mkdir d; mv *.jpg d", "find . -type f -print0 | xargs -0 cp -t x", "find . | xargs mv -t $HOME/Downloads", "ls -d */", "du -a | sort -n",
    "find . -type f -exec stat -f '%m %N' {} + | sort -nr | head -n 1 | cut -d' ' -f2-", "ls | grep -v '/$' | wc -l", "",
]


def drafts(spark, sf_dir) -> DataFrame:
    """cmd_id, prompt, command."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("cmd_id"), pick(ASKS, n).alias("prompt"), pick(DRAFTS, F.floor(n / len(ASKS))).alias("command"))


DRAFTS_SQL = f"shell_commands AS (SELECT o_orderkey AS cmd_id, [{', '.join(map(_text, ASKS))}][o_orderkey % {len(ASKS)} + 1] AS prompt, [{', '.join(map(_text, DRAFTS))}][o_orderkey // {len(ASKS)} % {len(DRAFTS)} + 1] AS command FROM orders)"


def effect_findings(prompt: Column, command: Column) -> Column:
    """array<string>: what a command lacks for its prompt, in the order of the rules; a null prompt or
    command counts as empty."""
    prompt, command = F.coalesce(prompt, F.lit("")), F.coalesce(command, F.lit(""))
    subjects = {"p": ascii_lower(prompt), "c": ascii_lower(command), "raw": command, "f": F.array_join(flags(command), " ")}
    return F.array_compact(F.array(*[F.when(wanted.column(subjects) & ~met.column(subjects), F.lit(says)) for wanted, met, says in ALL_RULES]))


@query(
    _FLAGS_SQL.replace(COMMANDS_SQL, DRAFTS_SQL)
    + f", s AS (SELECT cmd_id, {ascii_lower_sql('prompt')} AS p, {ascii_lower_sql('command')} AS c, command AS raw, array_to_string(flags, ' ') AS f FROM f JOIN (SELECT cmd_id, prompt FROM shell_commands) USING (cmd_id)) SELECT cmd_id, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {wanted.sql()} AND NOT {met.sql()} THEN {_text(says)} END" for wanted, met, says in ALL_RULES)
    + ") AS findings FROM s"
)
def p2_effect_findings(spark, sf_dir):
    """Findings of every rule."""
    return drafts(spark, sf_dir).select("cmd_id", F.array_join(effect_findings(F.col("prompt"), F.col("command")), "; ").alias("findings"))


def _words(command: Column) -> Column:
    return F.filter(F.split(command, r"\s+"), lambda w: w != "")


def with_flag(command: Column, letter: str) -> Column:
    """The letter joins the first cluster of short flags, or becomes a flag of its own."""
    words = _words(command)
    first = F.try_element_at(words, F.lit(2))
    rest = F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), " ")
    short = first.startswith("-") & ~first.startswith("--")
    grown = F.when(F.contains(first, F.lit(letter)), first).otherwise(F.concat(first, F.lit(letter)))
    second = F.when(short, grown).otherwise(F.concat(F.lit(f"-{letter} "), first))
    out = F.concat_ws(" ", F.element_at(words, 1), second, F.when(rest != "", rest))
    return F.when(F.size(words) < 2, command).otherwise(out)


def revised(command: Column, prompt: Column, findings: Column, suggestion: Column) -> Column:
    """The command after each finding (kind, detail) in turn had its effect; null where nothing changes,
    the command is empty, or a finding forbids a revision."""
    own, asked = F.trim(F.coalesce(command, F.lit(""))), ascii_lower(F.coalesce(prompt, F.lit("")))

    def step(text: Column, finding: Column) -> Column:
        kind = finding["kind"]
        renamed = F.concat_ws(" ", suggestion, F.array_join(F.slice(_words(text), F.lit(2), F.size(_words(text))), " "))
        gone = F.transform(F.split(F.coalesce(F.split_part(finding["detail"], F.lit(":"), F.lit(2)), F.lit("")), ","), lambda x: F.trim(x))
        gone = F.filter(gone, lambda x: x.startswith("-"))
        stripped = F.when(F.size(gone) > 0, F.array_join(F.filter(_words(text), lambda w: ~F.array_contains(gone, w)), " ")).otherwise(text)
        lists = text.startswith("ls ")
        timed = F.when(lists & asked.rlike("modified|mtime|sorted") & ~F.arrays_overlap(flags(text), F.array(F.lit("-t"), F.lit("--sort"))), with_flag(text, "t")).otherwise(text)
        full = F.when(lists & F.contains(asked, F.lit("all")) & ~F.arrays_overlap(flags(timed), F.array(F.lit("-a"), F.lit("--all"))), with_flag(timed, "a")).otherwise(timed)
        plain = F.regexp_replace(text, r"\s*(\s*(&&|\|\||\||;|&))+\s*$", "")
        return (
            F.when((kind == "unknown_command") & suggestion.isNotNull(), F.trim(renamed))
            .when(kind == "unsupported_flag", stripped)
            .when(kind == "insufficient_for_prompt", full)
            .when((kind == "parse_ambiguous") & (plain != ""), plain)
            .otherwise(text)
        )

    out = F.aggregate(findings, own, step)
    forbidden = F.exists(findings, lambda f: f["kind"] == "parse_ambiguous_risky")
    return F.when((own != "") & ~forbidden & (out != own), out)


# Inputs with what must come out: command, prompt, findings, suggestion, revision.
REVISIONS = [
    ("lss -la x", "list", [("unknown_command", "")], "ls", "ls -la x"),
    ("lss -la x", "list", [("unknown_command", "")], None, None),
    ("sort -u --wild a", "sort", [("unsupported_flag", "unsupported flags: --wild, -z")], None, "sort -u a"),
    ("sort -u a", "sort", [("unsupported_flag", "nothing named")], None, None),
    ("ls -l /x", "show all, by modified time", [("insufficient_for_prompt", "")], None, "ls -lta /x"),
    ("ls /x", "sorted", [("insufficient_for_prompt", "")], None, "ls -t /x"),
    ("ls -la |", "list", [("parse_ambiguous", "")], None, "ls -la"),
    ("echo a && ;", "say", [("parse_ambiguous", "")], None, "echo a"),
    ("rm a |", "drop", [("parse_ambiguous", ""), ("parse_ambiguous_risky", "")], None, None),
    ("lss -q |", "all", [("parse_ambiguous", ""), ("unknown_command", ""), ("unsupported_flag", "x: -q"), ("insufficient_for_prompt", "")], "ls", "ls"),
    ("  ", "x", [("parse_ambiguous", "")], None, None),
]


@query(
    f"SELECT o_orderkey AS cmd_id, [{', '.join('NULL' if r is None else _text(r) for *_, r in REVISIONS)}][o_orderkey % {len(REVISIONS)} + 1] AS revised FROM orders"
)
def p8_revised_commands(spark, sf_dir):
    """Revisions by kinds of findings, in their order; SQL has what must come out, worked by hand."""
    kind = "array<struct<kind:string,detail:string>>"
    cases = spark.createDataFrame([(i, a, b, f, s) for i, (a, b, f, s, _) in enumerate(REVISIONS)], f"k long, command string, prompt string, findings {kind}, suggestion string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cmd_id"), (F.col("o_orderkey") % len(REVISIONS)).alias("k"))
    out = revised(F.col("command"), F.col("prompt"), F.col("findings"), F.col("suggestion"))
    return rows.join(F.broadcast(cases), "k").select("cmd_id", out.alias("revised"))
