"""Redaction, text detection, line search and listings."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import redact, redact_sql, tokens
from ..registry import query
from ..sources.tables import SECRETS_SQL, secret_lines, spread, table


@query(f"WITH {SECRETS_SQL}, r AS (SELECT doc_id, text, {redact_sql('text')} AS out FROM secret_lines) SELECT doc_id, sha256(out) AS digest, text <> out AS redacted, CAST(len(regexp_extract_all(out, '<redacted>')) AS BIGINT) AS n FROM r")
def r1_redacted(spark, sf_dir):
    """Redacted text (R1, R2), whether anything changed, and how often."""
    rows = spread(secret_lines(spark, sf_dir)).withColumn("out", redact(F.col("text")))
    return rows.select("doc_id", F.sha2(F.col("out").cast("binary"), 256).alias("digest"), (F.col("text") != F.col("out")).alias("redacted"), F.regexp_count("out", F.lit("<redacted>")).cast("long").alias("n"))


# How many bytes are looked at, and how files begin that are no text.
SAMPLE = 8_192
MAGIC = ["89504E47", "FFD8FF", "474946383961", "474946383761", "504B0304"]


def verdict(content: Column, reject_nul: bool = True) -> Column:
    """``binary``, ``utf8``, ``utf16`` or ``unknown`` by the first bytes: NUL bytes (if they are rejected) and known signatures
    are binary; what is no UTF-8 but has a zero in more than a third of its pairs, on one side, is UTF-16."""

    def of(sample: Column) -> Column:
        digits = F.hex(sample)
        magic = F.lit(False)
        for m in MAGIC:
            magic = magic | digits.startswith(m)
        half = F.floor(F.octet_length(sample) / 2)
        pairs = F.regexp_extract_all(digits, F.lit("...."), F.lit(0))
        zeros = let(pairs, lambda x: F.greatest(F.size(F.filter(x, lambda v: v.startswith("00"))), F.size(F.filter(x, lambda v: v.endswith("00")))))
        nul = F.contains(sample.cast("string"), F.char(F.lit(0))) if reject_nul else F.lit(False)
        wide = F.octet_length(sample) >= 2
        return F.when(nul | magic, "binary").when(F.is_valid_utf8(sample.cast("string")), "utf8").when(wide & (zeros > F.floor(half / 3)), "utf16").otherwise("unknown")

    return let(F.substring(content, 1, SAMPLE), of)


# Inputs: bytes before and after a document's own, as hexadecimal digits, by its number.
_BEFORE, _AFTER = ["", "504B0304", "", "FF", "474946383761", "C3", "47494638"], ["", "", "00", "", "", "A9", ""]
_list = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"


@query(
    f"WITH h AS (SELECT doc_id, left({_list(_BEFORE)}[doc_id % 7 + 1] || hex(encode(text)) || {_list(_AFTER)}[doc_id % 7 + 1], 16384) AS h FROM documents) "
    "SELECT doc_id, CASE WHEN regexp_matches(h, '^(..)*00') OR regexp_matches(h, '^(89504E47|FFD8FF|474946383961|474946383761|504B0304)') THEN 'binary' WHEN TRY(decode(unhex(h))) IS NOT NULL THEN 'utf8' ELSE 'unknown' END AS verdict FROM h"
)
def x1_text_detection(spark, sf_dir):
    """Documents with bytes put around them: signatures, NUL, halves of characters, a sample that cuts one."""
    at = (F.col("doc_id") % len(_BEFORE) + 1).cast("int")
    around = [F.unhex(F.element_at(F.array(*map(F.lit, v)), at)) for v in (_BEFORE, _AFTER)]
    return table(spark, sf_dir, "documents").select("doc_id", verdict(F.concat(around[0], F.encode("text", "UTF-8"), around[1])).alias("verdict"))


def glob_regex(pattern: str) -> str:
    """Anchored expression of a glob; ``*`` crosses folder separators."""
    return "^" + fnmatch.translate(pattern).removeprefix("(?s:").rsplit(")", 1)[0].replace("(?>", "(?:") + "$"


@query(
    "SELECT doc_id, pos, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE (contains(line, 'token') OR regexp_matches(line, 'the [a-z]+ing ')) AND regexp_matches(source || '.txt', '^src1.*\\.txt$')"
)
def x3_line_search(spark, sf_dir):
    """Lines that hold a literal or match an expression, in sources that match a glob."""
    docs = table(spark, sf_dir, "documents").where(F.concat("source", F.lit(".txt")).rlike(glob_regex("src1*.txt")))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.contains("line", F.lit("token")) | F.col("line").rlike("the [a-z]+ing ")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "line")


def encoding_summary(found: DataFrame, key: str, encoding: str = "encoding") -> DataFrame:
    """``none`` without plain text, the encoding if there is one, else ``mixed``; binary and unknown files don't count."""
    plain = F.when(F.col(encoding).isin("utf8", "utf16"), F.col(encoding))
    g = found.groupBy(key).agg(F.count_distinct(plain).alias("n"), F.min(plain).alias("one"))
    return g.select(key, F.when(F.col("n") == 0, "none").when(F.col("n") == 1, F.col("one")).otherwise("mixed").alias("encoding"))


@query(
    "WITH e AS (SELECT source, CASE WHEN source LIKE '%7' THEN 'binary' WHEN doc_id % 3 = 0 AND source NOT LIKE '%2' THEN 'utf16' WHEN source LIKE '%5' THEN 'utf16' ELSE 'utf8' END AS e FROM documents), "
    "g AS (SELECT source, count(DISTINCT e) FILTER (e <> 'binary') AS n, min(e) FILTER (e <> 'binary') AS one FROM e GROUP BY source) SELECT source, CASE n WHEN 0 THEN 'none' WHEN 1 THEN one ELSE 'mixed' END AS encoding FROM g"
)
def x5_encoding_summary(spark, sf_dir):
    """Encodings of a source's documents as found in their bytes: some are written as UTF-16, some have a signature."""
    wide = ((F.col("doc_id") % 3 == 0) & ~F.col("source").endswith("2")) | F.col("source").endswith("5")
    # A first letter that is no ASCII makes UTF-16 no UTF-8.
    own = F.when(wide, F.encode(F.concat(F.lit("é"), F.regexp_replace(F.left("text", F.lit(2000)), r"[^\x01-\x7F]", "e")), "UTF-16BE")).otherwise(F.encode(F.left("text", F.lit(1000)), "UTF-8"))
    content = F.when(F.col("source").endswith("7"), F.concat(F.unhex(F.lit("504B0304")), own)).otherwise(own)
    found = table(spark, sf_dir, "documents").select("source", verdict(content, reject_nul=False).alias("encoding"))
    return encoding_summary(found, "source")


@query("SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY source <> 'src1', doc_id % 3, n_chars DESC, doc_id) AS pos FROM documents ORDER BY pos LIMIT 40")
def x6_workspace_listing(spark, sf_dir):
    """Priority, depth, newest, path: a listing of 40 rows (O1, O2)."""
    keys = [F.col("source") != "src1", F.col("doc_id") % 3, F.desc("n_chars"), F.col("doc_id")]
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(*keys).limit(40)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*keys)).cast("long"))


@query(f"SELECT conv_id, turn, {redact_sql('text')} AS text FROM conversations WHERE contains(lower(text), 'the') AND role <> 'system' ORDER BY conv_id DESC, turn DESC LIMIT 50")
def x8_history_search(spark, sf_dir):
    """Newest turns that hold a text, redacted after the match."""
    rows = table(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("the")) & (F.col("role") != "system"))
    return rows.orderBy(F.desc("conv_id"), F.desc("turn")).limit(50).select("conv_id", "turn", redact(F.col("text")).alias("text"))


@query(
    "WITH RECURSIVE a AS (SELECT doc_id, 'r/' || source || '/' || lang || '/d' || doc_id AS path FROM documents), p AS (SELECT doc_id, path, unnest(range(1, len(string_split(path, '/')) + 1)) AS depth FROM a) "
    "SELECT doc_id, max_by(array_to_string(string_split(path, '/')[1:depth], '/'), depth) AS root FROM p WHERE array_to_string(string_split(path, '/')[1:depth], '/') IN (SELECT 'r/' || source FROM documents WHERE doc_id % 7 = 0 UNION SELECT 'r') GROUP BY doc_id"
)
def x9_workspace_root(spark, sf_dir):
    """The nearest ancestor folder that holds a marker."""
    docs = table(spark, sf_dir, "documents")
    marks = docs.where("doc_id % 7 = 0").select(F.concat(F.lit("r/"), "source").alias("folder")).distinct().union(spark.createDataFrame([("r",)], "folder string"))
    parts = docs.select("doc_id", F.split(F.concat(F.lit("r/"), "source", F.lit("/"), "lang", F.lit("/d"), "doc_id"), "/").alias("parts"))
    up = parts.select("doc_id", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").select("doc_id", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("folder"))
    return up.join(marks, "folder").groupBy("doc_id").agg(F.max_by("folder", "depth").alias("root"))


def git_status(lines: DataFrame, counts: DataFrame, most: int = 200) -> DataFrame:
    """root, staged, unstaged, untracked, conflicts (arrays in order), ahead, behind, dirty, truncated.

    ``lines`` has root, n and line (two letters of state, a blank, a path), ``counts`` root and what the comparison with
    the upstream says (behind, then ahead; null without one).  A path may be in several lists; each keeps its first
    ``most`` paths."""
    x, y, path = F.substring("line", 1, 1), F.substring("line", 2, 1), F.substring("line", 4, 1 << 30)
    kinds = {
        "staged": ~x.isin(" ", "?"),
        "unstaged": y != " ",
        "untracked": (x == "?") & (y == "?"),
        "conflicts": (x == "U") | (y == "U") | ((x == "A") & (y == "A")) | ((x == "D") & (y == "D")),
    }
    named = F.array_compact(F.array(*[F.when(on, F.lit(kind)) for kind, on in kinds.items()]))
    each = lines.where(F.octet_length("line") >= 4).select("root", "n", path.alias("path"), F.explode(named).alias("kind"))
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("root", "kind").orderBy("n")))
    # Only what is kept is gathered; that there was more is told by the first path beyond.
    each = each.where(F.col("k") <= most + 1)
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("k") <= most), F.struct("k", "path")))), lambda v: v["path"]).alias(kind)
    lists = each.groupBy("root").agg(*[listed(kind) for kind in kinds], F.bool_or(F.col("k") > most).alias("truncated"))
    words = F.split(F.trim(F.col("counts")), r"\s+")
    number = lambda i: F.coalesce(F.get(words, F.lit(i)).try_cast("long"), F.lit(0))
    rows = counts.join(lists, "root", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "root", *[F.coalesce(kind, none).alias(kind) for kind in kinds], number(1).alias("ahead"), number(0).alias("behind"), F.col("truncated").isNotNull().alias("dirty"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


# Inputs: states by document number; what the comparison with the upstream says, by source.
_STATES = ["M ", " M", "??", "UU", "A ", "R ", "AA", "DD", " D", "MM", "UD"]
_COUNTS = ["3\t5", "0\t0", None, "x\t2", "7"]


@query(
    f"WITH l AS (SELECT source, doc_id, 'd' || doc_id AS path, [{', '.join(repr(s) for s in _STATES)}][doc_id % {len(_STATES)} + 1] AS s FROM documents), "
    "e AS (SELECT source, doc_id, path, unnest(list_filter([CASE WHEN s[1] NOT IN (' ', '?') THEN 'staged' END, CASE WHEN s[2] <> ' ' THEN 'unstaged' END, CASE WHEN s = '??' THEN 'untracked' END, CASE WHEN contains(s, 'U') OR s IN ('AA', 'DD') THEN 'conflicts' END], lambda v: v IS NOT NULL)) AS kind FROM l), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY doc_id) AS k FROM e), "
    "j AS (SELECT source, " + ", ".join(f"coalesce(string_agg(path, ',' ORDER BY doc_id) FILTER (kind = '{k}' AND k <= 8), '') AS {k}" for k in ("staged", "unstaged", "untracked", "conflicts")) + ", bool_or(k > 8) AS truncated FROM r GROUP BY source), "
    "c AS (SELECT DISTINCT source, CAST(substr(source, 4) AS BIGINT) % 5 AS c FROM documents) "
    "SELECT source, staged, unstaged, untracked, conflicts, [5, 0, 0, 2, 0][c + 1] AS ahead, [3, 0, 0, 0, 7][c + 1] AS behind, true AS dirty, truncated FROM j JOIN c USING (source)"
)
def x11_git_status(spark, sf_dir):
    """States of every source's files in four lists of eight at most, and the distance to the upstream."""
    docs = table(spark, sf_dir, "documents")
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("doc_id") % len(_STATES) + 1).cast("int"))
    lines = docs.select(F.col("source").alias("root"), F.col("doc_id").alias("n"), F.concat(state, F.lit(" d"), "doc_id").alias("line"))
    said = F.element_at(F.array(*map(F.lit, _COUNTS)), (F.substring("source", 4, 20).cast("long") % len(_COUNTS) + 1).cast("int"))
    rows = git_status(lines, docs.select(F.col("source").alias("root"), said.alias("counts")).distinct(), 8)
    return rows.select(F.col("root").alias("source"), *[F.array_join(k, ",").alias(k) for k in ("staged", "unstaged", "untracked", "conflicts")], "ahead", "behind", "dirty", "truncated")
