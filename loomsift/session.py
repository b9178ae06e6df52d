"""SparkSession settings that the engine assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "loomsift", cores: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew handling on; local master unless one is configured already."""
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in conf and not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
