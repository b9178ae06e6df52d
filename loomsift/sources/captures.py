"""Sources that hold what was captured elsewhere: listings of programs, manuals, files, pages, outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, redact

NO_DOCUMENTATION = "no documentation available"


def scan_path(listing: DataFrame, path_var: str, most: int) -> DataFrame:
    """folder, name, path, size, capped: regular files with an executable bit in the folders of a
    ``:``-separated list, in that list's order and by path, each path once, ``most`` at most.

    ``listing`` has folder, name, mode, is_file and size.  Folders are matched by a join with the
    short list; an unknown folder gives nothing, a folder named twice counts where it comes first."""
    spark, folders = listing.sparkSession, path_var.split(":")
    order = spark.createDataFrame([(f, folders.index(f)) for f in dict.fromkeys(folders)], "folder string, at int")
    files = listing.where(F.col("is_file") & (F.col("mode").bitwiseAND(0o111) != 0)).join(F.broadcast(order), "folder")
    files = files.withColumn("path", F.concat_ws("/", "folder", "name")).groupBy("path", "folder", "name", "at").agg(F.min("size").alias("size"))
    first = files.orderBy("at", "path").limit(most)
    return first.select("folder", "name", "path", "size", (F.count(F.lit(1)).over(Window.partitionBy()) >= most).alias("capped"))


def first_documentation(*captured: Column, most: int = 262_144) -> Column:
    """The first capture that holds more than white space, cut to bytes, or a stub."""
    kept = [F.when(F.trim(F.regexp_replace(c, r"\s", "")) != "", c) for c in captured]
    return cut_bytes(F.coalesce(*kept, F.lit(NO_DOCUMENTATION)), most)


# What is indexed first.
PRIORITIES = ["builtin", "alias", "cheatsheet", "recent", "prompt", "path"]


def priority(kind: Column) -> Column:
    """Rank of a kind of entry; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, PRIORITIES)), kind)
    return F.when(at > 0, at - 1).otherwise(len(PRIORITIES)).cast("long")


def text_of(content: Column) -> Column:
    """Bytes as text, what is no UTF-8 replaced."""
    return F.make_valid_utf8(content.cast("string"))


def bounded_read(content: Column, most: int) -> Column:
    """struct<text, truncated, bytes_read>: the first ``most`` bytes, secrets hidden; null for binary
    content, which NUL bytes among the bytes read show."""
    held = F.substring(content, 1, most)
    text = redact(text_of(held))
    out = F.struct(text.alias("text"), (F.octet_length(content) > most).alias("truncated"), F.octet_length(held).cast("long").alias("bytes_read"))
    return F.when(~F.contains(held.cast("string"), F.char(F.lit(0))), out)


def page_caps(html: Column, max_bytes: int, max_html_bytes: int) -> Column:
    """struct<html, fetched, truncated>: the bytes fetched, then those parsed; half characters at the
    end become replacement characters."""
    parse_cap = min(max(max_html_bytes, 1024), max(max_bytes, 1))
    raw = F.encode(html, "UTF-8")
    fetched = F.least(F.octet_length(html), F.lit(max(max_bytes, 1)))
    return F.struct(text_of(F.substring(raw, 1, parse_cap)).alias("html"), fetched.cast("long").alias("fetched"), (F.octet_length(html) > parse_cap).alias("truncated"))


def captured_output(content: Column, most: int) -> Column:
    """struct<base64, truncated>: the first ``most`` bytes."""
    return F.struct(F.replace(F.base64(F.substring(content, 1, most)), F.lit("\r\n"), F.lit("")).alias("base64"), (F.octet_length(content) > most).alias("truncated"))


def folder_snapshot(names: DataFrame, key: str, most_dirs: int, most_files: int) -> DataFrame:
    """key, dirs, files, hidden, truncated: names of a folder that don't start with a dot, sorted without
    regard to case, so many at most of each sort; the rest is only counted.

    ``names`` has key, name and is_dir.  Names are ranked before they are gathered, so a huge folder is
    never held as one row."""
    seen = names.withColumn("hidden", F.col("name").startswith(".")).groupBy(key, "name", "is_dir", "hidden").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(key, "hidden", "is_dir").orderBy(F.lower("name"), "name"))
    cap = F.when(F.col("is_dir"), most_dirs).otherwise(most_files)
    seen = seen.withColumn("k", rank).withColumn("kept", ~F.col("hidden") & (F.col("k") <= cap))
    listed = lambda d: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kept") & (F.col("is_dir") == d), F.struct("k", "name")))), lambda v: v["name"]), ", ")
    return seen.groupBy(key).agg(listed(True).alias("dirs"), listed(False).alias("files"), F.count_if("hidden").alias("hidden"), F.count_if(~F.col("hidden") & ~F.col("kept")).alias("left_out"))
