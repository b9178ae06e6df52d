"""Small rules over rows: encodings, names of a workspace, limits, files, freshness, command names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, ascii_lower_sql
from ..registry import query
from ..sources.tables import PROMPTS_SQL, prompts, table

_q = lambda p: p.replace("'", "''")
_list = lambda v: "[" + ", ".join(f"'{_q(x)}'" for x in v) + "]"


def _nth(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


# Spellings of encodings.
SPELLINGS = {"utf8": ["utf-8", "utf8"], "utf16": ["utf-16", "utf16", "utf-16le", "utf16le", "utf-16be", "utf16be"]}


def encoding_allowed(accepted: Column, encoding: Column) -> Column:
    """Whether a list names an encoding in any spelling; an empty list allows all."""
    low, wanted = F.transform(accepted, lambda a: F.lower(F.trim(a))), F.lower(encoding)
    known = F.lit(False)
    for name, spellings in SPELLINGS.items():
        known = known | ((wanted == name) & F.arrays_overlap(low, F.array(*map(F.lit, spellings))))
    return (F.size(accepted) == 0) | known | (~wanted.isin(list(SPELLINGS)) & F.array_contains(low, wanted))


# Inputs: lists of accepted encodings and encodings found.
_ACCEPTED = ["", "UTF-8", " utf8 ,latin1", "utf-16LE", "Latin1", "utf16,utf-8"]
_FOUND = ["utf8", "UTF16", "latin1", "binary"]


@query(
    f"WITH e AS (SELECT doc_id, {_list(_ACCEPTED)}[doc_id % {len(_ACCEPTED)} + 1] AS a, lower({_list(_FOUND)}[doc_id // {len(_ACCEPTED)} % {len(_FOUND)} + 1]) AS w FROM documents), l AS (SELECT doc_id, w, list_transform(list_filter(string_split(a, ','), lambda x: x <> ''), lambda x: lower(trim(x))) AS l FROM e) "
    f"SELECT doc_id, len(l) = 0 OR CASE w WHEN 'utf8' THEN list_has_any(l, {_list(SPELLINGS['utf8'])}) WHEN 'utf16' THEN list_has_any(l, {_list(SPELLINGS['utf16'])}) ELSE list_contains(l, w) END AS allowed FROM l"
)
def x2_encodings(spark, sf_dir):
    """Encodings against lists of accepted ones."""
    n = F.col("doc_id")
    accepted = F.filter(F.split(_nth(_ACCEPTED, n), ","), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", encoding_allowed(accepted, _nth(_FOUND, F.floor(n / len(_ACCEPTED)))).alias("allowed"))


# Names in a workspace.
NOISE_DIRS = [".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "vendor", ".cache", "__pycache__", ".venv", "venv", "tmp", ".next", ".turbo"]
MANIFESTS = [
    "cargo.toml", "package.json", "pyproject.toml", "go.mod", "makefile", "justfile", "taskfile.yml", "taskfile.yaml", "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".tool-versions", ".nvmrc", ".python-version", ".env.example",
]
SOURCE_DIRS = ["src", "lib", "app", "cmd", "scripts", "config", "configs", "docs", "test", "tests"]


def listing_rank(name: Column, is_dir: Column, depth: Column) -> Column:
    """0 manifests and top documents, 1 source folders near the root, 2 what is near the root, 3 the rest;
    null for folders of noise, which are not listed."""
    low = F.lower(name)
    top = low.isin(MANIFESTS) | low.startswith("readme") | low.startswith("license")
    near = depth <= 2
    return F.when(is_dir & low.isin(NOISE_DIRS), None).when(~is_dir & top, 0).when(is_dir & near & low.isin(SOURCE_DIRS), 1).when(near, 2).otherwise(3)


_NAMES = ["Cargo.toml", "README.md", "src", "node_modules", "Tmp", "main.c", "docs", "LICENSE", "deep", ".env.example", "tests", "Makefile"]


@query(
    f"WITH n AS (SELECT doc_id, {_list(_NAMES)}[doc_id % {len(_NAMES)} + 1] AS name, doc_id % 2 = 0 AS is_dir, doc_id % 4 + 1 AS depth FROM documents), l AS (SELECT *, lower(name) AS low FROM n) "
    f"SELECT doc_id, name, CASE WHEN is_dir AND list_contains({_list(NOISE_DIRS)}, low) THEN NULL WHEN NOT is_dir AND (list_contains({_list(MANIFESTS)}, low) OR starts_with(low, 'readme') OR starts_with(low, 'license')) THEN 0 "
    f"WHEN is_dir AND depth <= 2 AND list_contains({_list(SOURCE_DIRS)}, low) THEN 1 WHEN depth <= 2 THEN 2 ELSE 3 END AS rank FROM l"
)
def x7_name_sets(spark, sf_dir):
    """Names of noise, manifests and sources (X7) as ranks of a listing."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", _nth(_NAMES, n).alias("name"), listing_rank(_nth(_NAMES, n), n % 2 == 0, n % 4 + 1).alias("rank"))


def limited(df: DataFrame, most: int, *by) -> DataFrame:
    """The first ``most`` rows, and whether there were more: one row more is taken, not all counted."""
    some = df.orderBy(*by).limit(most + 1)
    k = F.row_number().over(Window.orderBy(*by))
    return some.withColumn("_k", k).withColumn("truncated", F.max("_k").over(Window.partitionBy()) > most).where(F.col("_k") <= most).drop("_k")


@query("SELECT 'all' AS setup, doc_id, true AS truncated FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25) UNION ALL SELECT 'few', r_regionkey, (SELECT count(*) FROM region) > 10 FROM (SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 10)")
def o3_limited(spark, sf_dir):
    """The first rows of a long and a short table, with a flag where rows are left out."""
    long_ = limited(table(spark, sf_dir, "documents").select("doc_id"), 25, "doc_id").select(F.lit("all").alias("setup"), "doc_id", "truncated")
    short = limited(table(spark, sf_dir, "region").select("r_regionkey"), 10, "r_regionkey").select(F.lit("few").alias("setup"), F.col("r_regionkey").cast("long").alias("doc_id"), "truncated")
    return long_.unionByName(short)


def walk(spark, root: str, ignore: list[str], hidden: bool = False) -> DataFrame:
    """path, name, length of the files under a folder, at any depth; contents are not read.

    Paths that match an ignored pattern (an expression on the path below the root) and, unless ``hidden``,
    those with a part that begins with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.regexp_extract("path", r"/([^/]*(?:/[^/]*){0,64})$", 1)
    tail = F.substring_index("path", root.rstrip("/").rpartition("/")[2] + "/", -1)
    rows = files.withColumn("name", F.coalesce(F.nullif(tail, F.lit("")), below))
    out = F.lit(False) if hidden else F.col("name").rlike(r"(^|/)\.")
    for p in ignore:
        out = out | F.col("name").rlike(p)
    return rows.where(~out)


_FILES = ["documents", "embeddings", "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "benchmark", "labels", "conversations"]


@query(f"SELECT unnest({_list([f for f in _FILES if not f.startswith('e')])}) AS name")
def s10_file_walk(spark, sf_dir):
    """Tables of a folder, found by a walk that leaves out what begins with e."""
    found = walk(spark, sf_dir, [r"^e"]).select(F.regexp_extract("name", r"^([^/.]+)", 1).alias("name")).distinct()
    return found.where(F.col("name").isin(_FILES))


# Words that ask for something fresh where a configuration names none.
FRESH = ["latest", "current", "today", "recent", "release", "version", "new", "now"]


def asks_fresh(prompt: Column, terms: Column) -> Column:
    """Whether a prompt holds a configured term, or a default one where none is configured."""
    low, own = ascii_lower(prompt), F.transform(terms, lambda t: ascii_lower(F.trim(t)))
    default = F.exists(F.array(*map(F.lit, FRESH)), lambda t: F.contains(low, t))
    return F.when(F.size(terms) == 0, default).otherwise(F.exists(own, lambda t: (t != "") & F.contains(low, t)))


_CONFIGURED = ["", " Files ,fail", "  ", "zzz", "docs,LIST"]


@query(
    f"WITH {PROMPTS_SQL}, c AS (SELECT prompt_id, {ascii_lower_sql('prompt')} AS p, {_list(_CONFIGURED)}[prompt_id % {len(_CONFIGURED)} + 1] AS c FROM prompts) SELECT prompt_id, CASE WHEN c = '' THEN len(list_filter({_list(FRESH)}, lambda t: contains(p, t))) > 0 "
    f"ELSE len(list_filter(string_split(c, ','), lambda t: trim(t) <> '' AND contains(p, {ascii_lower_sql('trim(t)')}))) > 0 END AS fresh FROM c"
)
def a2_freshness(spark, sf_dir):
    """Freshness terms of a configuration instead of the defaults (A2)."""
    terms = _nth(_CONFIGURED, F.col("prompt_id"))
    terms = F.when(terms == "", F.array().cast("array<string>")).otherwise(F.split(terms, ","))
    return prompts(spark, sf_dir).select("prompt_id", asks_fresh(F.col("prompt"), terms).alias("fresh"))


# Commands that a question is likely to be about, and how such questions begin.
LIKELY = ["ls", "find", "mkdir", "grep", "sed", "tar", "git", "rm", "cp", "mv", "du", "awk", "cut", "tr", "wc", "head", "tail", "chmod", "ln", "touch", "cat"]
OPENINGS = ["what does ", "explain ", "docs for "]
_TRIM = r"^[^A-Za-z0-9._-]+|[^A-Za-z0-9._-]+$"


def asked_command(prompt: Column) -> Column:
    """The command that a question is about: the word after a usual opening, else the first known one."""
    low = ascii_lower(F.trim(prompt))
    words_ = lambda c: F.filter(F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, _TRIM, "")), lambda w: w.isin(LIKELY))
    after = [F.when(low.startswith(o), F.regexp_replace(F.regexp_extract(F.substring(low, len(o) + 1, 1 << 20), r"^\s*(\S+)", 1), _TRIM, "")) for o in OPENINGS]
    return F.coalesce(*[F.when(a.isin(LIKELY), a) for a in after], F.try_element_at(words_(low), F.lit(1)))


_QUESTIONS = ["What does grep do?", "explain (tar) to cat", "docs for unknown, or `ls`", "how do I use awk.", "what does it do with find", "nothing here", "Explain  sed", "is head, tail?", "rm"]


@query(
    f"WITH q AS (SELECT doc_id, {_list(_QUESTIONS)}[doc_id % {len(_QUESTIONS)} + 1] AS prompt FROM documents), l AS (SELECT doc_id, {ascii_lower_sql('trim(prompt)')} AS p FROM q), "
    "a AS (SELECT doc_id, p, "
    + ", ".join(rf"CASE WHEN starts_with(p, '{o}') THEN regexp_replace(regexp_extract(substr(p, {len(o) + 1}), '^\s*(\S+)', 1), '{_TRIM}', '', 'g') END AS a{i}" for i, o in enumerate(OPENINGS))
    + rf", list_filter(list_transform(regexp_split_to_array(p, '\s+'), lambda w: regexp_replace(w, '{_TRIM}', '', 'g')), lambda w: list_contains({_list(LIKELY)}, w))[1] AS any_ FROM l) "
    + "SELECT doc_id, coalesce("
    + ", ".join(f"CASE WHEN list_contains({_list(LIKELY)}, a{i}) THEN a{i} END" for i in range(len(OPENINGS)))
    + ", any_) AS command FROM a"
)
def a6_asked_command(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", asked_command(_nth(_QUESTIONS, F.col("doc_id"))).alias("command"))
