"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator; results carry null again.
NULL_ID = -(1 << 63)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  One is set only where none is and executors are threads of this
    machine (tests); on a cluster a missing folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomsift-")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows per Arrow batch for what is computed inside: rows with several texts fill memory fast."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``kernel`` for mapInArrow, after which the worker gives freed memory back to the system.

    Workers serve one task after the other; what the allocators keep would count against the
    executor while tasks of quite another kind run."""

    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


#: Shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """What is written inside is read from the shared folder from then on, so nothing reads its shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomsift-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = _new_path(df.sparkSession, name)
    with _cleaning(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, in as many buckets of ``key`` as there are shuffle partitions: a join on the key
    need not shuffle what is read back."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    called = path.rpartition("/")[2].replace("-", "_")
    with _cleaning(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).saveAsTable(called)
    return spark.table(called)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("loomsift-"):
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns ``_id`` and ``_text``: other columns go, so that none can clash."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )


def public_id(name: str = "doc_id"):
    """The id column of results: the stand-in for a null id becomes null again."""
    return F.when(F.col("_id") != NULL_ID, F.col("_id")).alias(name)
