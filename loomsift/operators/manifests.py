"""What kind of project a folder holds: presence rules for files, and script names read from manifests."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

# What a file's presence says, whether or not it can be read; manifests that must be read, in the order in
# which they are; what stands for scripts where there are none.
PRESENT = [
    ("Cargo.toml", "language", "rust"), ("Cargo.toml", "manager", "cargo"), ("Cargo.toml", "script", "cargo build"), ("Cargo.toml", "script", "cargo test"),
    ("go.mod", "language", "go"), ("go.mod", "manager", "go"), ("go.mod", "script", "go test ./..."),
    ("package-lock.json", "manager", "npm"), ("yarn.lock", "manager", "yarn"), ("pnpm-lock.yaml", "manager", "pnpm"), ("bun.lockb", "manager", "bun"),
    ("Cargo.lock", "manager", "cargo"), ("poetry.lock", "manager", "poetry"), ("Pipfile.lock", "manager", "pipenv"), ("go.sum", "manager", "go"),
    (".github/workflows", "ci", ".github/workflows"), (".gitlab-ci.yml", "ci", ".gitlab-ci.yml"), (".circleci/config.yml", "ci", ".circleci/config.yml"), ("azure-pipelines.yml", "ci", "azure-pipelines.yml"), ("buildkite.yml", "ci", "buildkite.yml"),
    ("Makefile", "fallback", "make"), ("justfile", "fallback", "just"), ("Justfile", "fallback", "just"), ("Taskfile.yml", "fallback", "task"),
]
READ = [("package.json", "language", "javascript"), ("package.json", "manager", "npm"), ("pyproject.toml", "language", "python"), ("pyproject.toml", "manager", "pip")]
READ_ORDER = ["Cargo.toml", "package.json", "pyproject.toml"]
MOST_SCRIPTS = 50


def toml_scripts(files: DataFrame) -> DataFrame:
    """root, value: scripts that project files (root, text) name, at most ``MOST_SCRIPTS`` of either table, by name.  A file that is no
    TOML has none."""

    def names(text: str) -> list[str]:
        try:
            whole = tomllib.loads(text)
        except (tomllib.TOMLDecodeError, RecursionError):
            return []
        out = []
        for path, call in ((("project", "scripts"), "python -m "), (("tool", "poetry", "scripts"), "poetry run ")):
            found: object = whole
            for part in path:
                found = found.get(part) if isinstance(found, dict) else None
            out += [call + key for key in sorted(found)[:MOST_SCRIPTS]] if isinstance(found, dict) else []
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(root, name) for root, text in zip(batch[0].to_pylist(), batch[1].to_pylist()) for name in names(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["root", "value"])

    return files.select("root", "text").mapInArrow(read, "root string, value string")


def project_metadata(files: DataFrame, most_files: int = 50, most_bytes: int = 65_536) -> DataFrame:
    """root, languages, managers, scripts, ci_files, files_read, files_scanned, truncated of every root of ``files`` (root, path, size,
    text): sorted sets as texts.

    Of the manifests the first ``most_files`` that are not longer than ``most_bytes`` are read; what is left out for
    either reason makes the result truncated."""
    spark = files.sparkSession
    rule = "path string, kind string, value string"
    present, read, order = spark.createDataFrame(PRESENT, rule), spark.createDataFrame(READ, rule), F.array(*map(F.lit, READ_ORDER))
    # Few manifests per root: which of them are within the budget is told by the sizes of those before.
    held = files.where(F.col("path").isin(READ_ORDER)).groupBy("root").agg(F.sort_array(F.collect_list(F.struct(F.array_position(order, F.col("path")).alias("at"), "path", "size"))).alias("m"))
    small = lambda m: F.filter(m, lambda f: f["size"] <= most_bytes)
    held = held.withColumn("taken", F.transform(F.slice(small(F.col("m")), 1, most_files), lambda f: f["path"]))
    # The two manifests that must be read are looked for everywhere, the other one where it is.
    scanned = F.lit(2) + F.when(F.exists("m", lambda f: f["path"] == READ_ORDER[0]), 1).otherwise(0)
    counts = held.select("root", "taken", F.size("taken").alias("n_read"), scanned.alias("n_scanned"), (F.size("m") > F.size("taken")).alias("left_out"))
    texts = files.where(F.col("path").isin(READ_ORDER[1:])).join(counts.select("root", "taken"), "root").where(F.array_contains("taken", F.col("path"))).select("root", "path", "text")
    npm = texts.where(F.col("path") == "package.json").select("root", F.explode(F.slice(F.array_sort(F.json_object_keys(F.get_json_object("text", "$.scripts"))), 1, MOST_SCRIPTS)).alias("name"))
    facts = (
        files.select("root", "path").join(F.broadcast(present), "path").select("root", "kind", "value")
        .unionByName(texts.select("root", "path").join(F.broadcast(read), "path").select("root", "kind", "value"))
        .unionByName(npm.select("root", F.lit("script").alias("kind"), F.concat(F.lit("npm run "), "name").alias("value")))
        .unionByName(toml_scripts(texts.where(F.col("path") == "pyproject.toml")).select("root", F.lit("script").alias("kind"), "value"))
    )
    every = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("value"))))
    sets = facts.groupBy("root").agg(*[every(k).alias(k) for k in ("language", "manager", "script", "ci", "fallback")])
    rows = files.select("root").distinct().join(sets, "root", "left").join(counts, "root", "left")
    said = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    scripts = F.when(F.size("script") > 0, F.col("script")).otherwise(F.col("fallback"))
    return rows.select(
        "root", said("language").alias("languages"), said("manager").alias("managers"), said(scripts).alias("scripts"), said("ci").alias("ci_files"),
        F.coalesce("n_read", F.lit(0)).cast("long").alias("files_read"), F.coalesce("n_scanned", F.lit(2)).cast("long").alias("files_scanned"), F.coalesce("left_out", F.lit(False)).alias("truncated"),
    )


# Inputs: files of a folder by the number of a customer, with {n} for it; a file is there where its bit of the number is set.
FILES = [
    ("package.json", '{"name": "p{n}", "scripts": {"test": "t", "build": "b {n}", "a:{n}": "x"}}'), ("pyproject.toml", '[project]\nname = "p{n}"\n[project.scripts]\nrun{n} = "m:f"\nall = "m:g"\n[tool.poetry.scripts]\nserve = "m:h"\n[other]\nno = 1\n'),
    ("Makefile", "all:\n"), ("Cargo.toml", "[package]"), ("go.mod", "module m"), (".github/workflows", ""), ("yarn.lock", ""), ("justfile", ""), ("poetry.lock", ""), ("Taskfile.yml", ""), ("README.md", "read"),
]
BROKEN = {"package.json": "{no json", "pyproject.toml": "[project\nscripts = 1"}
LARGE = 70_000


def project_files(spark, sf_dir) -> DataFrame:
    n = F.col("c_custkey")
    many = F.concat(F.lit('{"scripts": {'), F.array_join(F.transform(F.sequence(F.lit(100), F.lit(160)), lambda i: F.concat(F.lit('"s'), i.cast("string"), F.lit('": "x"'))), ", "), F.lit("}}"))
    cases = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(p).alias("path"), F.lit(t).alias("text"), F.lit(BROKEN.get(p)).alias("broken")) for i, (p, t) in enumerate(FILES)])
    rows = table(spark, sf_dir, "customer").select(n, F.explode(cases).alias("f")).where((F.call_function("shiftright", n * 37, F.col("f.bit")) % 2 == 1) | (F.col("f.path") == "README.md"))
    text = F.when((n % 5 == 0) & F.col("f.broken").isNotNull(), F.col("f.broken")).when((n % 7 == 0) & (F.col("f.path") == "package.json"), many).otherwise(F.replace("f.text", F.lit("{n}"), n.cast("string")))
    size = F.when((n % 11 == 0) & F.col("f.path").isin(READ_ORDER[1:]), LARGE).otherwise(F.octet_length(text))
    return rows.select(F.concat(F.lit("/p/"), n.cast("string")).alias("root"), F.col("f.path").alias("path"), size.cast("long").alias("size"), text.alias("text"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_FILES_SQL = (
    "f AS (SELECT '/p/' || c_custkey AS root, c_custkey AS n, path, CASE WHEN c_custkey % 5 = 0 AND broken IS NOT NULL THEN broken WHEN c_custkey % 7 = 0 AND path = 'package.json' THEN '{\"scripts\": {' || (SELECT string_agg('\"s' || i || '\": \"x\"', ', ') FROM range(100, 161) r(i)) || '}}' ELSE replace(t, '{n}', CAST(c_custkey AS VARCHAR)) END AS text "
    f"FROM customer, (VALUES {', '.join(f'({i}, {_sql_text(p)}, {_sql_text(t)}, {_sql_text(BROKEN[p]) if p in BROKEN else None})' for i, (p, t) in enumerate(FILES)).replace('None)', 'NULL)')}) AS v(bit, path, t, broken) WHERE ((c_custkey * 37) >> bit) % 2 = 1 OR path = 'README.md'), "
    "g AS (SELECT *, n % 11 = 0 AND path IN ('package.json', 'pyproject.toml') AS big FROM f)"
)


def _pairs(rows: list[tuple]) -> str:
    return ", ".join(f"('{p}', '{k}', '{v}')" for p, k, v in rows)


@query(
    f"WITH {_FILES_SQL}, "
    "ok AS (SELECT * FROM g WHERE NOT big AND path IN ('package.json', 'pyproject.toml')), "
    f"a AS (SELECT root, kind, value FROM g JOIN (VALUES {_pairs(PRESENT)}) AS v(path, kind, value) USING (path) UNION SELECT root, kind, value FROM ok JOIN (VALUES {_pairs(READ)}) AS v(path, kind, value) USING (path) "
    "UNION SELECT root, 'script', 'npm run ' || unnest(list_sort(json_keys(text, '$.scripts'))[1:50]) FROM (SELECT root, CASE WHEN json_valid(text) THEN text ELSE '{}' END AS text FROM ok WHERE path = 'package.json') "
    "UNION SELECT root, 'script', 'python -m ' || unnest(regexp_extract_all(regexp_extract(text, '(?s)\\[project.scripts\\]\\n(.*?)\\[', 1), '([a-z0-9]+) = ', 1)) FROM ok WHERE path = 'pyproject.toml' AND n % 5 <> 0 "
    "UNION SELECT root, 'script', 'poetry run ' || unnest(regexp_extract_all(regexp_extract(text, '(?s)\\[tool.poetry.scripts\\]\\n(.*?)\\[', 1), '([a-z0-9]+) = ', 1)) FROM ok WHERE path = 'pyproject.toml' AND n % 5 <> 0), "
    "s AS (SELECT root, string_agg(value, ',' ORDER BY value) FILTER (kind = 'language') AS languages, string_agg(value, ',' ORDER BY value) FILTER (kind = 'manager') AS managers, string_agg(value, ',' ORDER BY value) FILTER (kind = 'script') AS scripts, "
    "string_agg(value, ',' ORDER BY value) FILTER (kind = 'ci') AS ci, string_agg(value, ',' ORDER BY value) FILTER (kind = 'fallback') AS fallback FROM a GROUP BY root), "
    "c AS (SELECT root, count(*) FILTER (path IN ('Cargo.toml', 'package.json', 'pyproject.toml') AND NOT big) AS files_read, 2 + count(*) FILTER (path = 'Cargo.toml') AS files_scanned, bool_or(big) AS truncated FROM g GROUP BY root) "
    "SELECT root, coalesce(languages, '') AS languages, coalesce(managers, '') AS managers, coalesce(scripts, fallback, '') AS scripts, coalesce(ci, '') AS ci_files, files_read, files_scanned, truncated FROM c LEFT JOIN s USING (root)"
)
def x10_project_metadata(spark, sf_dir):
    """Languages, package managers, scripts and CI files of folders with manifests of every kind."""
    return project_metadata(project_files(spark, sf_dir))
