"""Ignore files as rules: patterns compiled by expressions, and the last rule that matches a path or a folder above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..registry import query
from ..sources.tables import sent, table

#: What a pattern is made of: escaped characters, classes, ``**`` with its slash, wildcards, slashes and plain runs.
PARTS = r"\\.|\[[!^]?\]?[^\]]*\]|\*\*/|\*+|\?|/|[^\\\[*?/]+|."


def glob_expression(pattern: Column) -> Column:
    """A pattern without its marks as an expression: ``*`` and ``?`` stop at slashes, ``**`` between slashes does not."""

    def piece(parts: Column, t: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        after_slash = (i == 0) | (before == "/") | (before == "**/")
        last = i == F.size(parts) - 1
        quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
        inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\[[!^]", "[^"), r"\\?\\(?=.\])|\\", r"\\\\"), r"(?<=.)\[", r"\\[")
        return (
            F.when(t == "**/", F.when(after_slash, "(?:.*/)?").otherwise("[^/]*/"))
            .when(t.rlike(r"^\*\*+$") & after_slash & last, F.when(i == 0, ".*").otherwise(".+"))
            .when(t.rlike(r"^\*+$"), "[^/]*")
            .when(t == "?", "[^/]")
            .when(t == "/", "/")
            .when(t.rlike(r"^\\.$"), quoted(F.substring(t, 2, 1)))
            .when(t.rlike(r"^\[.+\]$"), F.concat(F.lit("(?!/)"), inner))
            .otherwise(quoted(t))
        )

    return let(F.regexp_extract_all(pattern, F.lit(PARTS), F.lit(0)), lambda parts: F.array_join(F.transform(parts, lambda t, i: piece(parts, t, i)), ""))


def ignore_rules(files: DataFrame) -> DataFrame:
    """folder, at, negated, dir_only, expression: a row per rule of ignore files (folder, text); a later rule has a larger ``at``.

    Blank lines and comments are none; spaces at the end go unless they are escaped.  A pattern with a slash
    before its end starts from the file's own folder, another one matches at any depth below."""
    line = F.regexp_replace(F.regexp_replace(F.col("raw"), r"\r$", ""), r"(?<!\\) +$", "")
    rows = files.select("folder", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("folder", "at", line.alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("negated", F.col("line").startswith("!"))
    body = F.when(F.col("negated"), F.substring("line", 2, 1 << 30)).otherwise(F.col("line"))
    rows = rows.withColumn("body", body).withColumn("dir_only", F.col("body").endswith("/")).withColumn("body", F.regexp_replace("body", "/$", ""))
    rows = rows.withColumn("anchored", F.contains("body", F.lit("/"))).withColumn("body", F.regexp_replace("body", "^/", "")).where("body <> ''")
    expression = F.concat(F.when(F.col("anchored"), "^").otherwise("^(?:.*/)?"), glob_expression(F.col("body")), F.lit("$"))
    return rows.select("folder", "at", "negated", "dir_only", expression.alias("expression"))


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, ignored: of the rules of a folder's ignore file and those of folders above, the last that matches decides,
    those of deeper files coming later.  What lies in an ignored folder is ignored whatever else is said.

    A path meets the rules of its own folders alone, by a join on the folder; a verdict is one maximum per
    path and folder above it, so no path's rules are gathered."""
    parts = F.split("path", "/")
    each = paths.select("path").distinct().select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    each = each.select("path", "depth", (F.col("depth") < F.size(parts)).alias("is_dir"), F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("prefix"))
    # A rule's folder is above the prefix that it judges.
    met = each.select("*", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("up"))
    own = F.split("prefix", "/")
    met = met.select("path", "depth", "is_dir", "up", F.array_join(F.slice(own, F.lit(1), F.col("up")), "/").alias("folder"), F.array_join(F.slice(own, F.col("up") + 1, F.col("depth")), "/").alias("below"))
    hits = met.join(sent(rules), "folder").where(F.rlike("below", F.col("expression")) & (~F.col("dir_only") | F.col("is_dir")))
    verdicts = hits.groupBy("path", "depth").agg(F.max_by(~F.col("negated"), F.struct("up", "at")).alias("out"))
    out = verdicts.groupBy("path").agg(F.bool_or("out").alias("ignored"))
    return paths.join(out, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


# Inputs: ignore files by folder; paths come from the documents.
IGNORES = [
    ("", "# everything\n*.tmp\n!keep.tmp\n/src1/\nsrc*/**/d1?.txt\nfr/\n!src2/fr\ndocs/**\n\n\\#odd\nsrc[3-4]/en/*[05].txt  \n"),
    ("src5", "*.txt\n!d1*.txt\n/en\n"),
    ("src6/en", "d*.txt\n!/d2*\n"),
]


def listed_paths(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    end = F.when(n % 11 == 0, "tmp").otherwise("txt")
    name = F.when(n % 13 == 0, F.lit("keep.tmp")).otherwise(F.concat(F.lit("d"), n, F.lit("."), end))
    path = F.concat_ws("/", F.concat(F.lit("src"), n % 8), "lang", name)
    return table(spark, sf_dir, "documents").select(path.alias("path")).distinct()


@query(
    "WITH p AS (SELECT DISTINCT 'src' || (doc_id % 8) || '/' || lang || '/' || CASE WHEN doc_id % 13 = 0 THEN 'keep.tmp' ELSE 'd' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '.tmp' ELSE '.txt' END END AS path FROM documents), "
    "s AS (SELECT path, split_part(path, '/', 1) AS src, split_part(path, '/', 2) AS lang, split_part(path, '/', 3) AS name FROM p) "
    # The root folder, the language's folder, then the file by its last rule.
    "SELECT path, src = 'src1' OR (lang = 'fr' AND src <> 'src2') OR (src = 'src5' AND lang = 'en') OR "
    "CASE WHEN src = 'src5' AND name LIKE 'd1%.txt' THEN false WHEN src = 'src5' AND name LIKE '%.txt' THEN true WHEN src = 'src6' AND lang = 'en' AND name LIKE 'd2%' THEN false WHEN src = 'src6' AND lang = 'en' AND name LIKE 'd%.txt' THEN true "
    "WHEN src IN ('src3', 'src4') AND lang = 'en' AND regexp_matches(name, '^[^/]*[05][.]txt$') THEN true WHEN regexp_matches(name, '^d1.[.]txt$') THEN true WHEN name = 'keep.tmp' THEN false WHEN name LIKE '%.tmp' THEN true ELSE false END AS ignored FROM s"
)
def s10_ignored_paths(spark, sf_dir):
    """Which paths of a tree a walk leaves out by its ignore files: anchors, negation, folders, nesting."""
    rules = ignore_rules(spark.createDataFrame(IGNORES, "folder string, text string"))
    return ignored_paths(listed_paths(spark, sf_dir), rules)
