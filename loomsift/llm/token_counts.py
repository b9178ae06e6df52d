"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary
from .common import ids_and_text, materialize, public_id

#: Lengths per block of the two-level sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row's whole text (null: empty, 0 tokens)."""
    vocab = vocab or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = [np.diff(offsets) for _, _, offsets in coder.batches(part[1].to_pylist())]
                yield pa.RecordBatch.from_arrays([part[0], pa.array(np.concatenate(sizes).astype(np.int64))], names=["_id", "n_tokens"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(count, "_id long, n_tokens long").select(public_id(), "n_tokens")


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, the limits at which the answers change.

    For limit L: n_docs (of that length), docs_at_least, docs_total, tokens_total, tokens_at_least
    (in documents of L tokens or more), truncated_total (if all are cut to L tokens), cut_tokens
    (what such a cut loses) and share_within (share of documents of L tokens at most: the quantile
    that L is).  Null lengths don't count; no rows for an empty table.  The sums run over blocks of
    lengths first and inside each block then, so no task gets all lengths.
    """
    # A row per length: written, as two branches read it and lengths may come from encoding all texts.
    hist = materialize(lengths.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    hist = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        hist.groupBy("_block")
        .agg(F.sum("n_docs").alias("d"), F.sum("_tokens").alias("t"))
        .select(
            "_block",
            F.coalesce(F.sum("d").over(above), F.lit(0)).alias("_docs_above"),
            F.coalesce(F.sum("t").over(above), F.lit(0)).alias("_tokens_above"),
            F.sum("d").over(every).alias("docs_total"),
            F.sum("t").over(every).alias("tokens_total"),
        )
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        hist.join(blocks, "_block")
        .withColumn("docs_at_least", F.col("_docs_above") + F.sum("n_docs").over(inside))
        .withColumn("tokens_at_least", F.col("_tokens_above") + F.sum("_tokens").over(inside))
    )
    truncated = F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "docs_total",
        "tokens_total",
        "tokens_at_least",
        truncated.alias("truncated_total"),
        (F.col("tokens_total") - truncated).alias("cut_tokens"),
        (1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("docs_total")).alias("share_within"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """The answers for given context limits, from the histogram alone: limit, docs_within,
    docs_total, truncated_total, tokens_total."""
    limit = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    cross = histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")) if limits else histogram.select("n_tokens", "n_docs", F.lit(None).cast("long").alias("limit")).where("false")
    sums = cross.groupBy("limit").agg(
        F.sum(F.when(F.col("n_tokens") <= F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_within"),
        F.sum("n_docs").alias("docs_total"),
        F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"),
        F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens_total"),
    )
    return limit.join(sums, "limit", "left").na.fill(0)
