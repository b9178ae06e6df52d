"""Inverted index and index tables over chunks (here: documents)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, tokens_sql
from ..registry import query
from ..sources.tables import spread, table

#: Ids per block of two-level running sums: no task gets all rows.
BLOCK = 4096


def running_before(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``name``: sum of ``value`` over all rows with a smaller ``key`` (distinct integers).

    Blocks of keys are summed and accumulated first (one row per block), rows inside a block then."""
    df = df.withColumn("_block", F.floor(F.col(key) / BLOCK)).withColumn("_value", value)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("_block").agg(F.sum("_value").alias("_s")).select("_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_in", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(blocks, "_block")
    return out.withColumn(name, F.col("_base") + F.col("_in")).drop("_block", "_value", "_in", "_base")


def occurrences(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """doc_id, token: a row per occurrence."""
    return docs.select(id_col, F.explode(tokens(text)).alias("token"))


def postings(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """doc_id, token, once each; duplicates go inside the row, before anything is shuffled."""
    return docs.select(id_col, F.explode(F.array_distinct(tokens(text))).alias("token"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT doc_id, CAST(len({tokens_sql('text')}) AS BIGINT) AS n_tokens FROM documents")
def k1_token_counts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(tokens("text")).cast("long").alias("n_tokens"))


@query(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def b1_postings_df(spark, sf_dir):
    return document_frequency(postings(spread(table(spark, sf_dir, "documents"))))


@query(f"SELECT token, count(*) AS occurrences FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token")
def b2_postings_occurrences(spark, sf_dir):
    return occurrences(spread(table(spark, sf_dir, "documents"))).groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"))


@query(f"SELECT count(*) AS n FROM documents WHERE len({tokens_sql('text')}) > 0")
def b3_collection_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.size(tokens("text")) > 0).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH o AS (SELECT source, doc_id, strlen(text) AS n, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS off FROM documents) "
    "SELECT source, min(doc_id) AS first_doc, count(*) AS n_docs, CAST(arg_min(off, doc_id) AS BIGINT) AS first_byte, CAST(sum(n) AS BIGINT) AS n_bytes FROM o GROUP BY source"
)
def b4_entry_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("n"))
    at = running_before(docs, "doc_id", F.col("n"), "at")
    return at.groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"), F.min_by("at", "doc_id").alias("first_byte"), F.sum("n").alias("n_bytes"))


@query("SELECT lang, row_number() OVER (ORDER BY first_doc) - 1 AS section_id FROM (SELECT lang, min(doc_id) AS first_doc FROM documents GROUP BY lang)")
def b6_section_dictionary(spark, sf_dir):
    first = table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("doc_id").alias("first_doc"))
    return first.select("lang", (F.row_number().over(Window.orderBy("first_doc")) - 1).cast("long").alias("section_id"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS chunk_id, n_chars FROM documents WHERE doc_id % 10 <> 0")
def b9_compact(spark, sf_dir):
    """Tombstoned rows (here: every tenth id) go, the others are numbered anew."""
    live = table(spark, sf_dir, "documents").withColumn("tombstone", F.col("doc_id") % 10 == 0).where(~F.col("tombstone"))
    return running_before(live.select("doc_id", "n_chars"), "doc_id", F.lit(1), "chunk_id").select("doc_id", F.col("chunk_id").cast("long"), "n_chars")


_V1 = "SELECT doc_id AS inode, 'd/' || doc_id AS path, 1000 AS mtime_secs, n_chars AS size FROM documents"
_V2 = (
    "SELECT doc_id AS inode, 'd/' || doc_id AS path, 1000 AS mtime_secs, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 10 <> 0 "
    "UNION ALL SELECT doc_id AS inode, 'new/' || doc_id AS path, 1000 AS mtime_secs, n_chars AS size FROM documents WHERE doc_id % 9 = 0"
)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, updated or removed between two listings (path, mtime_secs, size, inode)."""
    seen = lambda d, n: d.select("path", F.struct("mtime_secs", "size", "inode").alias(n))
    both = seen(before, "a").join(seen(after, "b"), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "updated")
    return both.select("path", change.alias("change")).where("change is not null")


@query(
    f"WITH a AS ({_V1}), b AS ({_V2}) SELECT path, CASE WHEN a.inode IS NULL THEN 'added' WHEN b.inode IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b USING (path) "
    "WHERE a.inode IS NULL OR b.inode IS NULL OR (a.mtime_secs, a.size, a.inode) IS DISTINCT FROM (b.mtime_secs, b.size, b.inode)"
)
def b8_delta_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    row = lambda d, prefix, size: d.select(F.col("doc_id").alias("inode"), F.concat(F.lit(prefix), F.col("doc_id")).alias("path"), F.lit(1000).alias("mtime_secs"), size.alias("size"))
    after = row(docs.where("doc_id % 10 <> 0"), "d/", F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).union(row(docs.where("doc_id % 9 = 0"), "new/", F.col("n_chars")))
    return delta(row(docs, "d/", F.col("n_chars")), after)


@query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS total FROM documents) WHERE total <= 200000")
def b11_resource_cap(spark, sf_dir):
    """The first documents whose texts fit into a byte budget (the cap is the feature)."""
    before = running_before(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), "before")
    return before.where(F.col("before") + F.col("n_chars") <= 200000).select("doc_id")


# Codes of extraction methods.
METHODS = {"man": 1, "--help": 2, "-h": 3, "stub": 4, "heuristic": 5, "builtin": 6, "alias": 7, "function": 8}


_METHOD_NAMES = [*METHODS, "fixture", "", "unheard of"]


@query(
    f"WITH m AS (SELECT doc_id, [{', '.join(repr(m) for m in _METHOD_NAMES)}][doc_id % {len(_METHOD_NAMES)} + 1] AS written FROM documents), "
    "c AS (SELECT *, coalesce(list_position(['man', '--help', '-h', 'stub', 'heuristic', 'builtin', 'alias', 'function'], written), 0) AS code FROM m) "
    "SELECT doc_id, written, CAST(code AS INTEGER) AS code, CASE WHEN code > 0 THEN written ELSE 'unknown' END AS method FROM c"
)
def b13_method_codes(spark, sf_dir):
    """Methods as codes, and back; what has no code is unknown."""
    codes = F.create_map(*[x for k, v in METHODS.items() for x in (F.lit(k), F.lit(v))])
    names = F.create_map(*[x for k, v in METHODS.items() for x in (F.lit(v), F.lit(k))])
    written = F.element_at(F.array(*map(F.lit, _METHOD_NAMES)), (F.col("doc_id") % len(_METHOD_NAMES) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", written.alias("written")).withColumn("code", F.coalesce(F.try_element_at(codes, F.col("written")), F.lit(0)))
    return rows.withColumn("method", F.coalesce(F.try_element_at(names, F.col("code")), F.lit("unknown")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE sha256(text) END AS doc_hash FROM documents")
def b14_doc_hash(spark, sf_dir):
    """Hex hashes survive a round trip through bytes only at full length."""
    h = F.sha2(F.col("text").cast("binary"), 256)
    stored = F.when(F.col("doc_id") % 3 == 0, F.substring(h, 1, 12)).otherwise(h)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length(stored) < 64, "").otherwise(F.lower(F.hex(F.unhex(stored)))).alias("doc_hash"))
