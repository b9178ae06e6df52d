"""File formats, and index tables with a manifest."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.  One is set only where none is and executors are threads of this
    machine (tests); on a cluster a missing folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomsift-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Rows that an Arrow batch may have.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int | None) -> Iterator[None]:
    """What runs within gets Arrow batches of at most ``most`` rows: long rows take the memory of JVM and worker at once."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(most or before))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once in the shared folder and read back: what several branches use is computed
    once, and a lost executor doesn't bring its lineage back.  ``rows``: as in ``arrow_rows``."""
    path = scratch(df.sparkSession, name)
    with arrow_rows(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def round_trip(df: DataFrame, formats: list[str]) -> DataFrame:
    """The union of ``df`` as each format gives it back, under its own schema."""
    base = scratch(df.sparkSession, "formats")
    out = []
    for name in formats:
        options = {"header": "true"} if name == "csv" else {}
        df.write.format(name).options(**options).save(f"{base}/{name}")
        out.append(df.sparkSession.read.schema(df.schema).format(name).options(**options).load(f"{base}/{name}"))
    return reduce(DataFrame.unionByName, out)


def write_index(tables: dict[str, DataFrame], root: str, manifest: dict) -> str:
    """Write all tables of an index under a folder of its own, and the manifest that points there last:
    a reader sees the old index or the new one, never a mixture."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    row = {**{k: str(v) for k, v in manifest.items()}, "version": version, "tables": ",".join(sorted(tables))}
    spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return version


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The fields of an index's manifest, or none where there is no index."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.json(f"{root}/manifest").first().asDict()


def read_index(spark: SparkSession, root: str) -> tuple[dict, dict[str, DataFrame]]:
    manifest = read_manifest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"no index under {root}")
    return manifest, {name: spark.read.parquet(f"{root}/{manifest['version']}/{name}") for name in manifest["tables"].split(",")}


def require_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``df`` cut to the wanted columns; a column that misses or is of another kind is an error."""
    found = dict(df.dtypes)
    wrong = [f"{c} {k}" for c, k in wanted.items() if found.get(c) != k]
    if wrong:
        raise ValueError("stored table lacks " + ", ".join(wrong))
    return df.select(*wanted)
