"""A stored index: entries, chunks, postings and vectors as tables under one manifest, written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens_sql
from ..registry import query
from ..sources.formats import read_index, read_manifest, require_columns, scratch, write_index
from ..sources.tables import spread, table
from .guides import command_name
from .index import postings

INDEX_VERSION = 3
ENTRY = {"path": "string", "mtime_secs": "bigint", "size": "bigint", "inode": "bigint"}


def entries(docs: DataFrame) -> DataFrame:
    """path, mtime_secs, size, inode: a file per document."""
    return docs.select(F.concat(F.lit("/bin/"), "source", F.lit("/d"), "doc_id").alias("path"), F.lit(1000).cast("long").alias("mtime_secs"), F.col("n_chars").cast("long").alias("size"), F.col("doc_id").alias("inode"))


def read_entries(stored: DataFrame) -> DataFrame:
    """Stored entries with their names; columns that miss or are of another kind are an error."""
    return require_columns(stored, ENTRY).withColumn("name", command_name(F.col("path")))


def lexicon(posted: DataFrame) -> DataFrame:
    """token, df, and how many rows its postings take: what a reader checks them against."""
    return posted.groupBy("token").agg(F.countDistinct("doc_id").alias("df"), F.count(F.lit(1)).alias("n_rows"))


def read_postings(words: DataFrame, posted: DataFrame) -> DataFrame:
    """token, df of stored postings, each document once whatever is stored; the stored df is not used.

    Tokens without postings, postings without a token and rows that are too few are errors, found in the
    exchange that counts them."""
    held = posted.groupBy("token").agg(F.countDistinct("doc_id").alias("df"), F.count(F.lit(1)).alias("held"))
    both = words.select("token", "n_rows").join(held, "token", "full")
    wrong = F.when(F.col("n_rows").isNull() | F.col("held").isNull(), "lexicon and postings have different tokens").when(F.col("held") < F.col("n_rows"), "postings are cut off")
    return both.select("token", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("df")).alias("df"))


def build(spark: SparkSession, docs: DataFrame, lexical: bool = True, vectors: DataFrame | None = None) -> str:
    """The folder of a new index.  Without vectors, or without a lexical side, an index has no such tables."""
    root = scratch(spark, "index")
    tables = {"entries": entries(docs), "chunks": docs.select("doc_id", "source", "lang", "text")}
    if lexical:
        posted = postings(docs)
        tables |= {"postings": posted, "lexicon": lexicon(posted)}
    if vectors is not None:
        tables["vectors"] = vectors
    write_index(tables, root, {"index_version": INDEX_VERSION, "dim": 384, "lexical": lexical})
    return root


_DOCS = lambda spark, sf_dir: spread(table(spark, sf_dir, "documents"))


@query("SELECT '/bin/' || source || '/d' || doc_id AS path, 1000::BIGINT AS mtime_secs, n_chars AS size, doc_id AS inode, 'd' || doc_id AS name FROM documents")
def s4_index_entries(spark, sf_dir):
    """Entries of a stored index with names from their paths."""
    return read_entries(read_index(spark, build(spark, _DOCS(spark, sf_dir), lexical=False))[1]["entries"])


@query(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def s6_index_postings(spark, sf_dir):
    """Postings of a stored index, checked against its lexicon."""
    tables = read_index(spark, build(spark, _DOCS(spark, sf_dir)))[1]
    return read_postings(tables["lexicon"], tables["postings"])


@query(
    "SELECT setup, name, n FROM (SELECT 'whole' AS setup, unnest(['entries', 'chunks', 'vectors']) AS name, unnest([(SELECT count(*) FROM documents), (SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings)]) AS n UNION ALL SELECT 'bare', unnest(['entries', 'chunks']), (SELECT count(*) FROM documents) "
    f"UNION ALL SELECT 'whole', unnest(['lexicon', 'postings']), unnest([(SELECT count(DISTINCT token) FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents)), (SELECT count(*) FROM (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS token FROM documents))]))"
)
def s7_index_tables(spark, sf_dir):
    """Tables of an index with and without its lexical side and vectors, and their rows."""
    docs = _DOCS(spark, sf_dir)
    out = None
    for setup, lexical, vectors in (("whole", True, table(spark, sf_dir, "embeddings")), ("bare", False, None)):
        for name, df in read_index(spark, build(spark, docs, lexical, vectors))[1].items():
            rows = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(setup).alias("setup"), F.lit(name).alias("name"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "SELECT 'missing' AS setup, NULL::VARCHAR AS index_version, NULL::VARCHAR AS dim, NULL::VARCHAR AS first_table, NULL::BIGINT AS chunks, NULL::BIGINT AS chars "
    "UNION ALL SELECT 'written', '3', '384', 'entries', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents UNION ALL SELECT 'before', '2', '1', 'entries', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents WHERE lang = 'en'"
)
def s8_manifest(spark, sf_dir):
    """The manifest of a folder without an index (none), of an index of some documents, and of the whole one that is
    written over it: of two writes the last counts, and says what its index holds."""
    root = scratch(spark, "index")
    docs = table(spark, sf_dir, "documents")

    def write(part: DataFrame, version: int, dim: int) -> dict | None:
        size = part.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("chars")).first()
        write_index({"entries": entries(part)}, root, {"index_version": version, "dim": dim, **size.asDict()})
        return read_manifest(spark, root)

    seen = {"missing": read_manifest(spark, root), "before": write(docs.where("lang = 'en'"), INDEX_VERSION - 1, 1), "written": write(docs, INDEX_VERSION, 384)}
    number = lambda v: None if v is None else int(v)
    rows = [(k, *[(m or {}).get(c) for c in ("index_version", "dim", "tables")], *[number((m or {}).get(c)) for c in ("chunks", "chars")]) for k, m in seen.items()]
    return spark.createDataFrame(rows, "setup string, index_version string, dim string, first_table string, chunks long, chars long")


WANTED = {"index_version": "3", "model": "m1", "dim": "384", "prefix": "search_document: "}


def must_rebuild(manifest: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``manifest`` with rebuild: any field that is missing or not as wanted."""
    differs = F.lit(False)
    for name, value in wanted.items():
        differs = differs | ~F.col(name).eqNullSafe(F.lit(value))
    return manifest.withColumn("rebuild", differs)


@query(
    "WITH m AS (SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN '2' ELSE '3' END AS v, CASE doc_id % 5 WHEN 2 THEN 'm0' ELSE 'm1' END AS m, CASE doc_id % 11 WHEN 3 THEN NULL ELSE '384' END AS d, CASE doc_id % 3 WHEN 0 THEN '' ELSE 'search_document: ' END AS p FROM documents) "
    "SELECT doc_id, (v, m, d, p) IS DISTINCT FROM ('3', 'm1', '384', 'search_document: ') AS rebuild FROM m"
)
def b10_invalidation(spark, sf_dir):
    """Manifests of which any field may differ from the wanted one (B10), here one per document."""
    n = F.col("doc_id")
    manifest = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 7 == 1, "2").otherwise("3").alias("index_version"),
        F.when(n % 5 == 2, "m0").otherwise("m1").alias("model"),
        F.when(n % 11 != 3, "384").alias("dim"),
        F.when(n % 3 == 0, "").otherwise("search_document: ").alias("prefix"),
    )
    return must_rebuild(manifest, WANTED).select("doc_id", "rebuild")
