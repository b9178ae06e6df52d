"""The flagship plan: ranked retrieval for a table of queries in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieval import l11_hybrid_topk


def ranked_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l11_hybrid_topk(spark, sf_dir)
