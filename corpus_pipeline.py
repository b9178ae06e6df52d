"""The training-corpus pipeline: each stage is one operator of ``loomsift.llm`` applied to what the
stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet
in the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.llm import jaccard, packing, quality, secrets, substring
from loomsift.llm.common import materialize


def _by_id(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept`` (doc_id); a null id counts as one too.  Rows travel as a
    struct, so that no column of theirs can clash with the key."""
    rows = docs.select(F.col("doc_id").alias("_of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.join(kept.select(F.col("doc_id").alias("_kept")), F.col("_of").eqNullSafe(F.col("_kept")), "left_semi")
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _by_id(docs, quality.score_quality(docs, labels).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; a null id is no group's.  Of
    rows that repeat an id (or null) and its text, one is kept."""
    return _by_id(docs, jaccard.near_duplicates(docs, count_links=False).where("component_id is null or component_id = doc_id")).dropDuplicates(["doc_id", "text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start earlier."""
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by its kind."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids: texts as prompts and answers."""
    return packing.pack_instructions(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secrets", secret_redaction),
    ("packing", pack),
]

#: SQL expresses none of the stages: they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
