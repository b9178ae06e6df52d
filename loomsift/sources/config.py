"""Configuration and test suites in TOML, as rows: keys are flattened to dotted paths."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys, or beginnings of keys, whose change needs a restart, and those below which any key may stand.
RESTART = [
    "model.", "inference.provider", "ollama.endpoint", "performance.profile", "indexer.embed_filename", "indexer.embed_dim", "indexer.vector_storage", "indexer.embedding_provider", "indexer.lexical_index_impl", "indexer.embed_query_prefix", "indexer.embed_doc_prefix",
    "web.provider",
]
DYNAMIC = ["inference.options", "ollama.options"]

#: Settings of the engine where a file gives none.
DEFAULTS = """
[approval]
mode = "manual"
[indexer]
embed_dim = 384
vector_storage = "f16"
max_chunks = 50000
[web]
enabled = true
provider = "duckduckgo_html"
[performance]
profile = "balanced"
[inference.options]
"""


def leaves(value: dict, above: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of everything that is no table."""
    for key, inner in value.items():
        path = f"{above}.{key}" if above else key
        if isinstance(inner, dict) and inner:
            yield from leaves(inner, path)
        else:
            yield path, inner


def _parsed(files: DataFrame, rows_of: Callable[[dict], list[tuple]], columns: list[str]) -> DataFrame:
    """id, valid and ``columns`` (strings): rows of each TOML file (id, text), a single row without values for one that holds
    none or is no TOML."""
    kind = dict(files.dtypes)["id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, valid, out = [], [], []
            for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                try:
                    rows, good = rows_of(tomllib.loads(text or "")), True
                except (tomllib.TOMLDecodeError, RecursionError):
                    rows, good = [], False
                rows = rows or [(None,) * len(columns)]
                ids += [key] * len(rows)
                valid += [good] * len(rows)
                out += rows
            values = [pa.array([r[i] for r in out], pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch[0].type), pa.array(valid, pa.bool_()), *values], names=["id", "valid", *columns])

    return files.select("id", "text").mapInArrow(read, f"id {kind}, valid boolean, " + ", ".join(f"{c} string" for c in columns))


def effective_settings(files: DataFrame, defaults: str = DEFAULTS) -> DataFrame:
    """id, path, value (JSON), origin (default or file), known, reload (restart or hot): the settings of every file (id, text) over the
    defaults.  Unknown keys stay, marked as such; a file that is no TOML has the defaults, marked as invalid in ``valid``."""
    spark = files.sparkSession
    rows_of = lambda whole: [(p, json.dumps(v)) for p, v in leaves(whole) if v != {}]
    own = _parsed(files, rows_of, ["path", "value"])
    base = spark.createDataFrame(rows_of(tomllib.loads(defaults)), "path string, value string")  # as many rows as there are settings
    every = own.select("id", "valid").distinct().join(F.broadcast(base.withColumnRenamed("value", "base")), F.lit(True))
    both = every.join(own.where("path is not null").select("id", "path", "value"), ["id", "path"], "full")
    known = F.col("base").isNotNull()
    for d in DYNAMIC:
        known = known | (F.col("path") == d) | F.col("path").startswith(d + ".")
    restart = F.lit(False)
    for r in RESTART:
        restart = restart | F.col("path").startswith(r)
    return both.select(
        "id", F.coalesce("valid", F.lit(True)).alias("valid"), "path", F.coalesce("value", "base").alias("value"), F.when(F.col("value").isNotNull(), "file").otherwise("default").alias("origin"), known.alias("known"), F.when(restart, "restart").otherwise("hot").alias("reload"),
    )


CASE = "id string, category string, prompt string, mode string, timeout_secs long, expected struct<must_succeed:boolean,stdout_contains:array<string>,forbid_proposed_command:boolean>"


def suite_cases(files: DataFrame) -> DataFrame:
    """suite (the file's id) and a row per test case of every suite (id, text); what a case leaves out is the suite's default, or
    none.  A file that is no TOML has no cases."""

    def rows_of(whole: dict) -> list[tuple]:
        base = whole.get("suite", {})
        first = {"mode": base.get("default_mode", "execute"), "timeout_secs": base.get("default_timeout_secs")}
        return [(json.dumps({**first, **case}),) for case in whole.get("test", [])]

    rows = _parsed(files, rows_of, ["case"]).where(F.col("case").isNotNull())
    return rows.select(F.col("id").alias("suite"), F.from_json("case", CASE).alias("c")).select("suite", "c.*")
