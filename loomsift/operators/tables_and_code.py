"""Tables and code blocks of pages as Markdown, by splitting a page at its matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import squeeze, unescape, unescape_sql
from ..registry import query
from ..sources.tables import spread, table
from .web import _SELECTED, _markdown_sql, markdown, selected

TABLE = r"(?is)<table[^>]*>.*?</table>"
ROW, CELL = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"
BLOCK = r"(?is)<pre[^>]*>.*?</pre>"
INSIDE, TAG = r"(?is)^<pre[^>]*>(.*)</pre>$", r"(?is)<[^>]+>"
MOST_ROWS, MOST_CELLS = 20, 6
# Classes of code and the languages that they name; the first that stands there counts.
LANGUAGES = [
    ("language-bash", "bash"), ("language-sh", "bash"), ("language-zsh", "zsh"), ("language-python", "python"), ("language-rust", "rust"), ("language-js", "javascript"), ("language-ts", "typescript"),
]


def replaced(page: Column, pattern: str, by) -> Column:
    """``page`` with every match as ``by`` makes of it: what stands between matches is put together again."""
    found = F.regexp_extract_all(page, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(F.split(page, pattern), lambda x, i: F.concat(x, F.coalesce(by(F.get(found, i)), F.lit("")))), "")


def grid(match: Column) -> Column:
    """Rows of cells between bars, as many cells as the first row has; a blank for a table without rows."""
    clean = lambda c: squeeze(unescape(F.regexp_replace(c, TAG, " ")))
    cells = lambda r: F.transform(F.slice(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), 1, MOST_CELLS), clean)
    rows = F.filter(F.transform(F.slice(F.regexp_extract_all(match, F.lit(ROW), F.lit(1)), 1, MOST_ROWS), cells), lambda r: F.size(r) > 0)

    def drawn(all_: Column) -> Column:
        width = F.size(all_[0])
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        every = F.concat(F.array(line(all_[0]), rule), F.transform(F.slice(all_, F.lit(2), F.size(all_)), line))
        return F.concat(F.lit("\n"), F.array_join(every, "\n"), F.lit("\n"))

    return F.when(match.isNotNull(), F.transform(F.array(rows), lambda all_: F.when(F.size(all_) > 0, drawn(all_)).otherwise(" "))[0])


def language(attributes: Column) -> Column:
    low = F.lower(attributes)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in LANGUAGES], F.lit(""))


def fence(match: Column) -> Column:
    """A code block between fences, without tags, with its language where its tags name one."""
    body = F.regexp_extract(match, INSIDE, 1)
    tags = F.array_join(F.regexp_extract_all(match, F.lit(r"(?is)<(?:pre|code)[^>]*>"), F.lit(0)), " ")
    code = F.regexp_replace(F.replace(unescape(F.regexp_replace(body, TAG, "")), F.lit("\r"), F.lit("")), r"\n+\z", "")
    return F.when(match.isNotNull(), F.concat(F.lit("\n```"), language(tags), F.lit("\n"), code, F.lit("\n```\n")))


def with_tables_and_code(page: Column) -> Column:
    return replaced(replaced(page, TABLE, grid), BLOCK, fence)


# Inputs: what is put into a page, by its number.
PARTS = [
    "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><pre><code class='language-sh'>ls &lt; x\n\n</code></pre>", "<TABLE border=1><tr></tr></TABLE>x<pre class=\"language-Rust\">let a = 1;\r\n</pre>",
    "<table><tr><td>x <b>y</b>\n z</td><td>&amp;</td><td>3</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>", "<pre>plain</pre> and <pre><code class='language-ts'>t</code></pre>", "<table>" + "<tr>" + "<td>c</td>" * 8 + "</tr>" * 1 + "<tr><td>r</td></tr>" * 23 + "</table>", "none",
]
_q = lambda p: p.replace("'", "''")
_PARTS = ", ".join("'" + _q(p).replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'" for p in PARTS)


def _replaced_sql(x: str, pattern: str, by) -> str:
    parts, found = f"regexp_split_to_array({x}, '{_q(pattern)}')", f"regexp_extract_all({x}, '{_q(pattern)}')"
    return f"array_to_string(list_transform({parts}, lambda x_, i_: x_ || coalesce({by(f'{found}[i_]')}, '')), '')"


def _grid_sql(m: str) -> str:
    clean = rf"trim(regexp_replace({unescape_sql(f'regexp_replace(c_, $${TAG}$$, $$ $$, $$g$$)')}, '\s+', ' ', 'g'))"
    rows = f"list_filter(list_transform(regexp_extract_all({m}, '{ROW}', 1)[1:{MOST_ROWS}], lambda r_: list_transform(regexp_extract_all(r_, '{CELL}', 1)[1:{MOST_CELLS}], lambda c_: {clean})), lambda r_: len(r_) > 0)"
    line = lambda r: f"'| ' || array_to_string(list_resize({r}, w_, ''), ' | ') || ' |'"
    width = f"list_transform([{rows}], lambda all_: CASE WHEN len(all_) = 0 THEN ' ' ELSE list_transform([len(all_[1])], lambda w_: chr(10) || array_to_string(list_concat([{line('all_[1]')}, '| ' || array_to_string(list_resize(['---'], w_, '---'), ' | ') || ' |'], list_transform(all_[2:], lambda r_: {line('r_')})), chr(10)) || chr(10))[1] END)[1]"
    return f"CASE WHEN {m} IS NOT NULL THEN {width} END"


def _fence_sql(m: str) -> str:
    tags = f"lower(array_to_string(regexp_extract_all({m}, '(?is)<(?:pre|code)[^>]*>'), ' '))"
    hint = "CASE " + " ".join(f"WHEN contains({tags}, '{k}') THEN '{v}'" for k, v in LANGUAGES) + " ELSE '' END"
    body = f"regexp_extract({m}, '{INSIDE}', 1)"
    code = rf"regexp_replace(replace({unescape_sql(f'regexp_replace({body}, $${TAG}$$, $$$$, $$g$$)')}, chr(13), ''), '\n+\z', '')"
    return f"CASE WHEN {m} IS NOT NULL THEN chr(10) || '```' || {hint} || chr(10) || {code} || chr(10) || '```' || chr(10) END"


_TABLES_SQL = _replaced_sql("page", TABLE, _grid_sql)
_FENCES_SQL = _replaced_sql("grids", BLOCK, _fence_sql)


@query(
    f"WITH p AS (SELECT page_id, html || [{_PARTS}][page_id % {len(PARTS)} + 1] AS page FROM pages), g AS (SELECT page_id, {_TABLES_SQL} AS grids FROM p), f AS (SELECT page_id, {_FENCES_SQL} AS markdown FROM g) SELECT page_id, sha256(markdown) AS digest, right(markdown, 300) AS tail FROM f"
)
def w10_tables_and_code(spark, sf_dir):
    """Pages with tables and code blocks put in."""
    part = F.element_at(F.array(*map(F.lit, PARTS)), (F.col("page_id") % len(PARTS) + 1).cast("int"))
    rows = spread(table(spark, sf_dir, "pages")).select("page_id", with_tables_and_code(F.concat("html", part)).alias("markdown"))
    return rows.select("page_id", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"), F.right("markdown", F.lit(300)).alias("tail"))


def spaced(text: Column) -> Column:
    """Ends of lines bare, runs of blank lines cut to one, nothing blank at the ends (no line is dropped)."""
    bare = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t\x0B\f\r]+(\n|\z)", "$1")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


_SPACED_SQL = r"regexp_replace(regexp_replace(regexp_replace(replace(md, chr(13) || chr(10), chr(10)), '[ \t\x0B\f\r]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0B]+|[\s\x0B]+\z', '', 'g')"


@query(f"{_SELECTED}, mds AS (SELECT page_id, {_markdown_sql('content')} AS md FROM sel), s AS (SELECT page_id, {_SPACED_SQL} AS text FROM mds) SELECT page_id, len(string_split(text, chr(10))) AS lines, left(sha256(text), 12) AS hash FROM s")
def w12_spacing(spark, sf_dir):
    """Markdown with its spacing alone normalized (W12), and the first twelve digits of its hash."""
    rows = selected(spread(table(spark, sf_dir, "pages"))).select("page_id", spaced(markdown(F.col("content"))).alias("text"))
    return rows.select("page_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(12)).alias("hash"))
