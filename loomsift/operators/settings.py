"""Queries over configuration files and test suites, one per customer or supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.config import DYNAMIC, RESTART, effective_settings, suite_cases
from ..sources.tables import table

# Inputs: settings by the number of a customer, with {n} for it; every fifth file is no TOML, every seventh is empty.
FILE = """
[approval]
mode = "auto{n}"
[indexer]
embed_dim = {n}
embed_dims = 1
[web]
provider = "custom_json"
[inference]
provider = "local"
[inference.options]
temperature = {n}
[ollama.options.deep]
x = [1, {n}]
[model]
path = "/m/{n}"
"""
_OWN = [("approval.mode", '"auto{n}"'), ("indexer.embed_dim", "{n}"), ("indexer.embed_dims", "1"), ("web.provider", '"custom_json"'), ("inference.provider", '"local"'), ("inference.options.temperature", "{n}"), ("ollama.options.deep.x", "[1, {n}]"), ("model.path", '"/m/{n}"')]
_BASE = [("approval.mode", '"manual"'), ("indexer.embed_dim", "384"), ("indexer.vector_storage", '"f16"'), ("indexer.max_chunks", "50000"), ("web.enabled", "true"), ("web.provider", '"duckduckgo_html"'), ("performance.profile", '"balanced"')]
_list = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_values = lambda v: ", ".join(f"('{p}', '{x}')" for p, x in v)


@query(
    f"WITH c AS (SELECT c_custkey AS id, c_custkey % 5 <> 0 AS valid FROM customer), o AS (SELECT id, path, replace(v, '{{n}}', CAST(id AS VARCHAR)) AS value FROM c, (VALUES {_values(_OWN)}) AS t(path, v) WHERE valid AND id % 7 <> 0), "
    f"b AS (SELECT id, path, v AS base FROM c, (VALUES {_values(_BASE)}) AS t(path, v)), j AS (SELECT id, path, value, base FROM o FULL JOIN b USING (id, path)) "
    "SELECT id, valid, path, coalesce(value, base) AS value, CASE WHEN value IS NULL THEN 'default' ELSE 'file' END AS origin, "
    f"base IS NOT NULL OR len(list_filter({_list(DYNAMIC)}, lambda d: path = d OR starts_with(path, d || '.'))) > 0 AS known, CASE WHEN len(list_filter({_list(RESTART)}, lambda r: starts_with(path, r))) > 0 THEN 'restart' ELSE 'hot' END AS reload FROM j JOIN c USING (id)"
)
def s14_settings(spark, sf_dir):
    """Settings of every file over the defaults, unknown keys marked, with what a change of each asks for."""
    n = F.col("c_custkey")
    text = F.when(n % 5 == 0, "[approval\nmode = 1").when(n % 7 == 0, "").otherwise(F.replace(F.lit(FILE), F.lit("{n}"), n.cast("string")))
    return effective_settings(table(spark, sf_dir, "customer").select(n.alias("id"), text.alias("text")))


# Inputs: a suite per supplier, with {n} for its number; odd ones have no default for the time limit.
SUITE = """
[suite]
version = "1.0.0"
{limit}
[[test]]
id = "T-{n}-1"
category = "listing"
prompt = "list files of {n}"
mode = "propose"
expected = { must_succeed = true, stdout_contains = ["foo", "bar{n}"] }
[[test]]
id = "T-{n}-2"
category = "docs"
prompt = "what is ls"
timeout_secs = 5
expected = { forbid_proposed_command = true }
[[test]]
id = "T-{n}-3"
"""


@query(
    "WITH s AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 30 END AS d FROM supplier WHERE s_suppkey % 11 <> 0) "
    "SELECT n AS suite, 'T-' || n || '-1' AS id, 'listing' AS category, 'propose' AS mode, d AS timeout_secs, true AS must_succeed, 'foo,bar' || n AS stdout, NULL::BOOLEAN AS forbidden FROM s "
    "UNION ALL SELECT n, 'T-' || n || '-2', 'docs', 'execute', 5, NULL, '', true FROM s UNION ALL SELECT n, 'T-' || n || '-3', NULL, 'execute', d, NULL, '', NULL FROM s"
)
def s15_test_suite(spark, sf_dir):
    """Cases of every suite with its defaults (S15); every eleventh file is no TOML."""
    n = F.col("s_suppkey")
    limit = F.when(n % 2 == 0, F.concat(F.lit("default_timeout_secs = "), (n + 30).cast("string"))).otherwise("")
    text = F.when(n % 11 == 0, "[[test").otherwise(F.replace(F.replace(F.lit(SUITE), F.lit("{limit}"), limit), F.lit("{n}"), n.cast("string")))
    e = F.col("expected")
    cases = suite_cases(table(spark, sf_dir, "supplier").select(n.alias("id"), text.alias("text")))
    return cases.select("suite", "id", "category", "mode", "timeout_secs", e["must_succeed"].alias("must_succeed"), F.coalesce(F.array_join(e["stdout_contains"], ","), F.lit("")).alias("stdout"), e["forbid_proposed_command"].alias("forbidden"))
