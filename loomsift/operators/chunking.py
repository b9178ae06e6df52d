"""Sections, option hints and sentence pieces of manual pages: sections by windows over lines, the rest within a page's row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..registry import query
from ..sources.tables import MANUAL_SQL, manual_pages


def lines(df: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, pos, line."""
    return df.select(key, F.posexplode(F.split(raw, "\n")).alias("pos", "line"))


def is_heading(line: Column) -> Column:
    """Something at column 0 without an ASCII lower-case letter."""
    return (line != "") & ~line.startswith(" ") & ~line.rlike("[a-z]")


def sections(df: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, section_no, name, body.  Text before the first heading joins the first section; a page
    without headings has none.  ``NAME`` comes first, the others keep their order."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines(df, key, raw).withColumn("heading", is_heading(F.col("line")))
    marked = marked.withColumn("no", F.sum(F.col("heading").cast("int")).over(order)).withColumn("no", F.greatest("no", F.lit(1)))
    name = F.max(F.when(F.col("heading"), F.struct("pos", "line")))["line"]
    body = F.sort_array(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "line"))))
    out = marked.groupBy(key, "no").agg(name.alias("name"), body.alias("x")).where("name is not null")
    text = F.regexp_replace(F.array_join(F.transform("x", lambda v: v["line"]), "\n"), r"^\s+|\s+$", "")
    out = out.select(key, "no", F.trim("name").alias("name"), text.alias("body"))
    place = Window.partitionBy(key).orderBy(F.when(F.upper("name") == "NAME", 0).otherwise(1), "no")
    return out.select(key, (F.row_number().over(place) - 1).cast("long").alias("section_no"), "name", "body")


_SECTIONS = (
    f"WITH {MANUAL_SQL}, l AS (SELECT part_key, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS pos FROM manual_pages), "
    "h AS (SELECT *, line <> '' AND NOT starts_with(line, ' ') AND NOT regexp_matches(line, '[a-z]') AS heading FROM l), "
    "n AS (SELECT *, greatest(1, sum(heading::INT) OVER (PARTITION BY part_key ORDER BY pos)) AS no FROM h), "
    "s AS (SELECT part_key, no, max(line) FILTER (heading) AS name, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT heading), '') AS body FROM n GROUP BY ALL), "
    "sec AS (SELECT part_key, row_number() OVER (PARTITION BY part_key ORDER BY CASE WHEN upper(name) = 'NAME' THEN 0 ELSE 1 END, no) - 1 AS section_no, trim(name) AS name, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS body FROM s WHERE name IS NOT NULL) "
)


@query(_SECTIONS + "SELECT * FROM sec")
def k7_sections(spark, sf_dir):
    return sections(manual_pages(spark, sf_dir), "part_key")


def flags_of(option: Column) -> Column:
    bare = F.transform(F.split(option, r"[,\s]"), lambda t: F.regexp_replace(t, r"^[\[\]():;,]+|[\[\]():;,]+$", ""))
    return F.filter(bare, lambda t: t.startswith("-") & t.rlike("[A-Za-z]"))


def trimmed_heading(text: Column) -> Column:
    """A heading as it is told from trimmed text, where no indentation speaks against it: no small ASCII letter."""
    return (text != "") & ~text.rlike("[a-z]")


def page_hints(raw: Column, most: int = 48) -> Column:
    """array<struct<pos, display, flags, description>> of a page, by position.  An option line starts a hint, later lines
    that are no headings or options go on with its description; of equal flags the first hint stays."""

    def told(line: Column, pos: Column) -> Column:
        def parted(t: Column, part: Column) -> Column:
            return let(
                flags_of(part),
                lambda flags: F.struct(
                    pos.alias("pos"), t.alias("t"), part.alias("part"), flags.alias("flags"),
                    (t.startswith("-") & ~t.startswith("---") & (F.length(t) >= 2) & (F.size(flags) > 0) & (F.octet_length(part) <= 96)).alias("option"),
                ),
            )

        split = lambda t: F.regexp_extract(t, r"^(..(?:(?!\s\s).)*)\s\s(.*)$", 1)
        return let(F.trim(F.replace(line, F.lit("\t"), F.lit("    "))), lambda t: let(split(t), lambda x: let(F.when(x != "", F.trim(x)).otherwise(t), lambda part: parted(t, part))))

    def says(row: Column) -> Column:
        own = F.trim(F.regexp_extract(row["t"], r"^..(?:(?!\s\s).)*\s\s(.*)$", 1))
        return F.when(row["option"], own).when((row["t"] != "") & ~trimmed_heading(row["t"]) & ~row["t"].startswith("-"), row["t"])

    bounded = lambda s, d: F.when(d.isNull() | (F.octet_length(s) >= 260), s).otherwise(F.trim(F.concat_ws(" ", s, d)))

    def hint(rows: Column, starts: Column) -> Callable[[Column, Column], Column]:
        def of(start: Column, i: Column) -> Column:
            own = F.slice(rows, start + 1, F.coalesce(F.get(starts, i + 1), F.size(rows)) - start)
            text = F.aggregate(F.transform(own, says), F.lit(""), bounded)
            return let(F.get(rows, start), lambda r: F.struct(r["pos"].cast("long").alias("pos"), F.regexp_replace(r["part"], ",+$", "").alias("display"), F.array_join(r["flags"], "|").alias("flags"), text.alias("description")))

        return of

    def first(hints: Column) -> Column:
        names = F.transform(hints, lambda h: h["flags"])
        return let(names, lambda names: F.transform(F.slice(F.array_distinct(names), 1, most), lambda x: F.get(hints, (F.array_position(names, x) - 1).cast("int"))))

    rows = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), told)
    starts = lambda rows: F.transform(F.filter(rows, lambda r: r["option"]), lambda r: r["pos"])
    hints = let(rows, lambda rows: let(starts(rows), lambda at: F.filter(F.transform(at, hint(rows, at)), lambda h: h["description"] != "")))
    return let(hints, first)


def option_hints(df: DataFrame, key: str, raw: str = "raw", most: int = 48) -> DataFrame:
    """key, pos, display, flags, description: a row per hint of every page."""
    return df.select(key, F.inline(page_hints(F.col(raw), most)))


@query(
    f"WITH {MANUAL_SQL}, o AS (SELECT part_key, p_size, p_brand, command_name FROM manual_pages JOIN part ON part_key = p_partkey), "
    "h AS (SELECT part_key, 8 AS pos, '-a, --all' AS display, '-a|--all' AS flags, 'Show all. Even hidden; really?' AS description FROM o "
    "UNION ALL SELECT part_key, 9, '-n, --number=NUM', '-n|--number=NUM', 'Limit to ' || p_size || ' lines of output.' FROM o "
    "UNION ALL SELECT part_key, 11, '--brand', '--brand', 'Uses ' || p_brand || ' Long text! More text. Tail' FROM o) SELECT * FROM h"
)
def k14_option_hints(spark, sf_dir):
    return option_hints(manual_pages(spark, sf_dir), "part_key")


@query(
    _SECTIONS + ", p AS (SELECT part_key, section_no, list_filter(list_transform(regexp_extract_all(body, '[^.!?;]*[.!?;]|[^.!?;]+$', 0), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS pieces FROM sec) "
    "SELECT part_key, section_no, CAST(len(pieces) AS BIGINT) AS n, array_to_string(pieces, '|') AS pieces FROM p"
)
def k10_sentences(spark, sf_dir):
    cut = F.regexp_extract_all("body", F.lit(r"[^.!?;]*[.!?;]|[^.!?;]+$"), F.lit(0))
    pieces = F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return sections(manual_pages(spark, sf_dir), "part_key").select("part_key", "section_no", F.size(pieces).cast("long").alias("n"), F.array_join(pieces, "|").alias("pieces"))


#: Bytes that a piece may have; a longer sentence stays whole.
LARGE = 2048
SENTENCE = r"[^.!?;]*[.!?;]|[^.!?;]+$"


def pieces(text: Column, most: int = LARGE) -> Column:
    """Greedy packing of paragraphs, and of sentences where a paragraph is too long, into pieces of
    about ``most`` bytes; a longer sentence stays whole."""
    sentences = lambda p: F.filter(F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: x != "")
    parts = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.when(F.octet_length(p) > most, sentences(p)).otherwise(F.array(p))))

    def step(s: Column, part: Column) -> Column:
        full = (F.size(s["held"]) > 0) & (s["n"] + F.octet_length(part) + 2 > most)
        grown = F.when(full, F.array(part)).otherwise(F.array_append(s["held"], part))
        n = F.when(full, 0).otherwise(s["n"]) + F.octet_length(part) + 2
        return F.struct(F.when(full, F.array_append(s["out"], F.array_join(s["held"], "\n\n"))).otherwise(s["out"]).alias("out"), grown.alias("held"), n.cast("int").alias("n"))

    none = F.array().cast("array<string>")
    out = F.aggregate(parts, F.struct(none.alias("out"), none.alias("held"), F.lit(0).alias("n")), step, lambda s: F.array_append(s["out"], F.array_join(s["held"], "\n\n")))
    return F.filter(F.transform(out, lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: x != "")


_LARGE_PARTS = (
    r"p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS p, generate_subscripts(string_split(coalesce(text, ''), chr(10) || chr(10)), 1) AS i FROM documents), "
    rf"x AS (SELECT doc_id, i, CASE WHEN strlen(p) > {LARGE} THEN list_filter(list_transform(regexp_extract_all(p, '{SENTENCE}'), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+\z', '', 'g')), lambda x: x <> '') ELSE [p] END AS parts FROM p), "
    "y AS (SELECT doc_id, i, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM x), parts AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM y)"
)


@query(
    f"WITH RECURSIVE {_LARGE_PARTS}, f AS (SELECT doc_id, k, 0 AS piece, strlen(part) + 2 AS n FROM parts WHERE k = 1 UNION ALL "
    f"SELECT f.doc_id, parts.k, CASE WHEN f.n + strlen(part) + 2 > {LARGE} THEN piece + 1 ELSE piece END, CASE WHEN f.n + strlen(part) + 2 > {LARGE} THEN 0 ELSE f.n END + strlen(part) + 2 FROM f JOIN parts ON parts.doc_id = f.doc_id AND parts.k = f.k + 1), "
    rf"g AS (SELECT doc_id, piece, regexp_replace(string_agg(part, chr(10) || chr(10) ORDER BY k), '^[\s\x0B]+|[\s\x0B]+\z', '', 'g') AS piece_text FROM f JOIN parts USING (doc_id, k) GROUP BY doc_id, piece) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS piece_no, strlen(piece_text) AS bytes, sha256(piece_text) AS digest FROM g WHERE piece_text <> ''"
)
def k9_large_pieces(spark, sf_dir):
    """Pieces of every whole document."""
    from ..sources.tables import spread, table

    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(pieces(F.col("text"))).alias("piece_no", "piece"))
    return rows.select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), F.octet_length("piece").cast("long").alias("bytes"), F.sha2(F.col("piece").cast("binary"), 256).alias("digest"))
