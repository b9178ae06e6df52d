"""Usage intents of a command's page, put together from its options, and pages cut into chunks with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..registry import query
from ..sources.tables import MANUAL_SQL, manual_pages
from .chunking import page_hints, pieces, sections
from .guides import COMBINATIONS, KNOWN_OPTIONS, OPTION_WORDS, OPTIONS_SQL, RELATED, TASK_PHRASES, _text, combinations, command_notes, command_options, option_intents, trim_sentence

# What a section of usage intents says.
TITLE = "USAGE INTENTS"
INTRODUCTION = "Generated retrieval hints from local command documentation and common command task phrases. These examples are bounded, not exhaustive; validate exact flags against OPTIONS.\nCommand: "
PHRASES, HINTS, COMMON, SIMILAR = "\nCommand task phrases:\n", "\nOption intent hints:\n", "\nCommon bounded combinations:\n", "\nSimilar command differences:\n"
MOST_HINTS, MOST_COMBINATIONS, MOST_BYTES = 24, 10, 220


def _listed(heading: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(heading), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))).otherwise("")


def usage_intents(command: Column, options: Column, phrases: Column, related: Column) -> Column:
    """The section of a command; ``options``: array<struct<display, flags, description>>.  Null without
    options, phrases and related commands."""

    def hint(o: Column) -> Column:
        says = lambda wants: F.when(F.size(wants) > 0, F.concat(F.lit(" Useful for requests about "), F.array_join(wants, ", "), F.lit("."))).otherwise("")
        return F.concat(F.lit("`"), command, F.lit(" "), o["display"], F.lit("`: "), trim_sentence(o["description"], MOST_BYTES), let(option_intents(command, o["flags"], o["description"]), says))

    hints = let(F.transform(F.slice(options, 1, MOST_HINTS), hint), lambda x: _listed(HINTS, x))
    common = lambda flags: let(F.slice(combinations(command, flags), 1, MOST_COMBINATIONS), lambda x: _listed(COMMON, x))
    whole = F.concat(F.lit(INTRODUCTION), command, F.lit("\n"), _listed(PHRASES, phrases), hints, let(F.flatten(F.transform(options, lambda o: o["flags"])), common), _listed(SIMILAR, related))
    return F.when((F.size(options) > 0) | (F.size(phrases) > 0) | (F.size(related) > 0), F.regexp_replace(whole, r"\s+\z", ""))


def with_section(raw: Column, section: Column) -> Column:
    """A page with its section at the end, unless it has one or there is none."""
    bare = F.regexp_replace(raw, r"\s+\z", "")
    whole = lambda section: let(bare, lambda bare: F.concat(bare, F.when(bare != "", F.lit("\n\n")).otherwise(""), F.lit(TITLE + "\n"), section, F.lit("\n")))
    return F.when(F.contains(raw, F.lit(f"\n{TITLE}\n")), raw).otherwise(let(section, lambda s: F.coalesce(whole(s), raw)))


def _noted(df: DataFrame) -> DataFrame:
    """``df`` (command_name) with phrases and related of known commands, a table of fixed size."""
    notes = command_notes(df.sparkSession).withColumnRenamed("name", "command_name")
    none = F.array().cast("array<string>")
    return df.join(F.broadcast(notes), "command_name", "left").withColumn("phrases", F.coalesce("phrases", none)).withColumn("related", F.coalesce("related", none))


_quoted = lambda v: "[" + ", ".join(map(_text, v)) + "]::VARCHAR[]"
_lit = lambda v: _text(v).replace("\n", "' || chr(10) || '")
_listed_sql = lambda heading, lines: f"CASE WHEN len({lines}) > 0 THEN {_lit(heading)} || array_to_string(list_transform({lines}, lambda x: '- ' || x || chr(10)), '') ELSE '' END"
#: Purposes per option, ordered: what ``option_intents`` gives, for a relation ``options`` with key columns page_id, pos.
_INTENTS_SQL = (
    "known AS (SELECT unnest(string_split(c, ' ')) AS command_name, f, intent FROM (VALUES "
    + ", ".join(f"({_text(' '.join(c))}, {_text(' '.join(f))}, {_text(i)})" for c, f, i in KNOWN_OPTIONS)
    + ") k(c, f, intent)), flag AS (SELECT command_name, unnest(string_split(f, ' ')) AS flag, intent FROM known), words AS (SELECT * FROM (VALUES "
    + ", ".join(f"({100 + i}, {_text(w)}, {_text(label)})" for i, (w, label) in enumerate(OPTION_WORDS))
    + ") w(ord, word, intent)), own AS (SELECT page_id, pos, command_name, unnest(flags) AS flag, generate_subscripts(flags, 1) AS ord FROM options), "
    "hit AS (SELECT page_id, pos, ord, intent FROM own JOIN flag USING (command_name, flag) UNION ALL SELECT page_id, pos, ord, intent FROM options JOIN words ON contains(lower(command_name || ' ' || array_to_string(flags, ', ') || ' ' || description), word)), "
    "once AS (SELECT page_id, pos, intent, min(ord) AS ord FROM hit GROUP BY ALL), intents AS (SELECT page_id, pos, string_agg(intent, ', ' ORDER BY ord) AS wants FROM once GROUP BY ALL), "
    "lines AS (SELECT page_id, command_name, list('`' || command_name || ' ' || display || '`: ' || description || CASE WHEN wants IS NULL THEN '' ELSE ' Useful for requests about ' || wants || '.' END ORDER BY pos) AS hints, flatten(list(flags)) AS flags "
    "FROM options LEFT JOIN intents USING (page_id, pos) GROUP BY ALL)"
)
_NOTES_SQL = "notes AS (SELECT * FROM (VALUES " + ", ".join(f"({_text(c)}, {_quoted(p)}, {_quoted(RELATED.get(c, []))})" for c, p in TASK_PHRASES.items()) + ") n(command_name, phrases, related))"
_COMMON_SQL = (
    "rules AS (SELECT ord, unnest(string_split(c, ' ')) AS command_name, g, line FROM (VALUES "
    + ", ".join(f"({i}, {_text(' '.join(c))}, {_text(', '.join(map(' '.join, g)))}, {_text(line)})" for i, (c, g, line) in enumerate(COMBINATIONS))
    + ") r(ord, c, g, line)), common AS (SELECT page_id, command_name, list(replace(line, '{}', command_name) ORDER BY ord)[1:10] AS common FROM lines JOIN rules USING (command_name) WHERE len(list_filter(string_split(g, ', '), lambda x: NOT list_has_any(flags, string_split(x, ' ')))) = 0 GROUP BY ALL)"
)


def _section_sql() -> str:
    return (
        f"trim({_lit(INTRODUCTION)} || command_name || chr(10) || {_listed_sql(PHRASES, 'coalesce(phrases, [])')} || {_listed_sql(HINTS, f'hints[1:{MOST_HINTS}]')} || {_listed_sql(COMMON, 'coalesce(common, [])')} || {_listed_sql(SIMILAR, 'coalesce(related, [])')}, chr(10))"
    )


@query(
    f"WITH {OPTIONS_SQL.replace('options AS (', 'listed AS (', 1)}, options AS (SELECT *, array_to_string(flags, ', ') AS display FROM listed), {_INTENTS_SQL}, {_NOTES_SQL}, {_COMMON_SQL} "
    f"SELECT page_id, command_name, {_section_sql()} AS section FROM lines LEFT JOIN notes USING (command_name) LEFT JOIN common USING (page_id, command_name)"
)
def k13_usage_intents(spark, sf_dir):
    """The section of every command of a page: phrases, hints, combinations and neighbours."""
    option = F.struct("pos", F.array_join("flags", ", ").alias("display"), "flags", "description")
    pages = command_options(spark, sf_dir).groupBy("page_id", "command_name").agg(F.sort_array(F.collect_list(option)).alias("options"))
    return _noted(pages).select("page_id", "command_name", usage_intents(F.col("command_name"), F.col("options"), F.col("phrases"), F.col("related")).alias("section"))


def augmented(pages: DataFrame) -> DataFrame:
    """``pages`` (command_name, raw) with doc: the page with its section (K12).  A page's hints are found within its row,
    so no line is shuffled and pages meet no one."""
    options = F.transform(page_hints(F.col("raw")), lambda h: F.struct(h["pos"].alias("pos"), h["display"].alias("display"), F.split(h["flags"], r"\|").alias("flags"), h["description"].alias("description")))
    section = let(options, lambda options: usage_intents(F.col("command_name"), options, F.col("phrases"), F.col("related")))
    return _noted(pages).withColumn("doc", with_section(F.col("raw"), section)).drop("phrases", "related")


_HINTS_SQL = (
    "o AS (SELECT part_key, p_size, p_brand, command_name, raw FROM manual_pages JOIN part ON part_key = p_partkey), "
    "options AS (SELECT part_key AS page_id, 8 AS pos, command_name, '-a, --all' AS display, ['-a', '--all'] AS flags, 'Show all. Even hidden; really?' AS description FROM o "
    "UNION ALL SELECT part_key, 9, command_name, '-n, --number=NUM', ['-n', '--number=NUM'], 'Limit to ' || p_size || ' lines of output.' FROM o "
    "UNION ALL SELECT part_key, 11, command_name, '--brand', ['--brand'], 'Uses ' || p_brand || ' Long text! More text. Tail' FROM o)"
)
_DOC_SQL = (
    f"{MANUAL_SQL}, {_HINTS_SQL}, {_INTENTS_SQL}, doc AS (SELECT part_key, rtrim(raw, ' ' || chr(10)) || chr(10) || chr(10) || '{TITLE}' || chr(10) || trim({_lit(INTRODUCTION)} || l.command_name || chr(10) || {_listed_sql(HINTS, 'hints')}, chr(10)) || chr(10) AS doc "
    "FROM manual_pages m JOIN lines l ON l.page_id = m.part_key)"
)


@query(f"WITH {_DOC_SQL} SELECT part_key, doc, sha256(doc) AS doc_hash FROM doc")
def k12_intent_augmentation(spark, sf_dir):
    """Pages with their usage intents; the hash is of the augmented page."""
    return augmented(manual_pages(spark, sf_dir)).select("part_key", "doc", F.sha2(F.col("doc").cast("binary"), 256).alias("doc_hash"))


def chunk_documents(pages: DataFrame, key: str) -> DataFrame:
    """key, chunk_index, total_chunks, section, text, doc_hash of every page (K11): its intents are put in, its
    sections found, and large sections cut; a page without sections is one chunk, or a stub if it is empty."""
    docs = augmented(pages).select(key, "doc", F.sha2(F.col("doc").cast("binary"), 256).alias("doc_hash"))
    cut = sections(docs, key, "doc").select(key, "section_no", F.col("name").alias("section"), "body")
    whole = docs.join(cut.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("section_no"), F.lit("").alias("section"), F.when(F.trim("doc") == "", "no documentation available").otherwise(F.col("doc")).alias("body"))
    parts = cut.unionByName(whole).select(key, "section_no", "section", F.posexplode(pieces(F.col("body"))).alias("k", "text"))
    by = Window.partitionBy(key)
    numbered = parts.withColumn("chunk_index", (F.row_number().over(by.orderBy("section_no", "k")) - 1).cast("long")).withColumn("total_chunks", F.count(F.lit(1)).over(by))
    return numbered.join(docs.select(key, "doc_hash"), key).select(key, "chunk_index", "total_chunks", "section", "text", "doc_hash")


@query(
    f"WITH {_DOC_SQL}, l AS (SELECT part_key, unnest(string_split(doc, chr(10))) AS line, generate_subscripts(string_split(doc, chr(10)), 1) AS pos FROM doc), h AS (SELECT *, line <> '' AND NOT starts_with(line, ' ') AND NOT regexp_matches(line, '[a-z]') AS heading FROM l), "
    "n AS (SELECT *, greatest(1, sum(heading::INT) OVER (PARTITION BY part_key ORDER BY pos)) AS no FROM h), s AS (SELECT part_key, no, max(line) FILTER (heading) AS name, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT heading), '') AS body FROM n GROUP BY ALL), "
    "b AS (SELECT part_key, no, trim(name) AS section, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS text, CASE WHEN upper(name) = 'NAME' THEN 0 ELSE 1 END AS late FROM s WHERE name IS NOT NULL), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY late, no) - 1 AS chunk_index, count(*) OVER (PARTITION BY part_key) AS total_chunks FROM b WHERE text <> '') "
    "SELECT part_key, chunk_index, total_chunks, section, text, sha256(doc) AS doc_hash FROM c JOIN doc USING (part_key)"
)
def k11_chunks(spark, sf_dir):
    return chunk_documents(manual_pages(spark, sf_dir), "part_key")
