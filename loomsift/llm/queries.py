"""Registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_table, fingerprints, jaccard, licenses, media, packing, quality, sanitise, secrets, substring, token_counts, vector_codes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sha(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.BASE_RULES]
    found = secrets.secret_spans(_documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[secrets.counts_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.joined(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_coverage(_documents(spark, sf_dir))
    return found.withColumn("matches", F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], F.round(m["coverage"], 4).cast("string"))), ","))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.kept_words(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", _sha("kept").alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(_documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_table.encode_documents(_documents(spark, sf_dir))
    return coded.select("doc_id", "n_tokens", _sha("ids").alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"))


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.read_transport_stream(media.to_transport_stream(_documents(spark, sf_dir)))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        _sha("payload").alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        _sha("media").alias("media_sha256"),
        "feature",
        "continuity_errors",
        F.array_join(F.transform("units", lambda u: F.concat_ws(":", u["pts"], u["offset"], u["size"], u["random_access"].cast("int"))), ",").alias("units"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(_documents(spark, sf_dir)))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_instructions(_documents(spark, sf_dir))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


def op13_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.personal_spans(_documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[secrets.counts_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in sanitise.KINDS],
        F.sha2(sanitise.joined(F.col("spans"), sanitise.KINDS).cast("binary"), 256).alias("base_sha256"),
        sanitise.joined(F.col("spans")).alias("spans"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_secret_scan, op2_license_scan, op3_substring_dedup, op4_fingerprints, op5_quality, op6_bpe, op7_transport_stream, op8_token_counts, op9_jaccard_join, op10_packing, op11_alignment, op12_vector_codes, op13_sanitise, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op12_vector_codes": vector_codes.SQL, "op13_sanitise": sanitise.SQL}
