"""Web pages to Markdown, URL rules and result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze, unescape, unescape_sql, word_count, word_count_sql
from ..registry import query
from ..sources.tables import spread, table

# What goes from a page before its content is chosen, in order.
NOISE = [r"(?is)<!--.*?-->", r"(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>", r"(?is)<(img|picture|source|svg|canvas)[^>]*?/?>"]
MAIN = [
    r"(?is)<main[^>]*>(.*?)</main>",
    r"(?is)<article[^>]*>(.*?)</article>",
    r"""(?is)<[^>]+role=["']main["'][^>]*>(.*?)</[^>]+>""",
    r"""(?is)<[^>]+(?:id|class)=["'][^"']*(?:content|docs-content|markdown-body|documentation)[^"']*["'][^>]*>(.*?)</[^>]+>""",
]
BLOCK = r"(?is)<(?:section|div|article|main)[^>]*>(.*?)</(?:section|div|article|main)>"
MARKERS = ['id="__next"', "id='__next'", 'id="root"', "id='root'", "data-reactroot", "window.__initial_state__", "window.__nuxt", "ng-version", "data-hydrate"]
BOXES = r"(?is)<(?:nav|footer|aside|form|button)[^>]*>.*?</(?:nav|footer|aside|form|button)>"
TRACKING = r"^(utm_.*|fbclid|gclid|mc_cid|mc_eid)$"
LEAST = 400


def cleaned(page: Column) -> Column:
    for p in NOISE:
        page = F.regexp_replace(page, p, " ")
    return page


def _q(p: str) -> str:
    return p.replace("'", "''")


def cleaned_sql(x: str) -> str:
    for p in NOISE:
        x = f"regexp_replace({x}, '{_q(p)}', ' ', 'g')"
    return x


def main_content(page: Column, least: int = LEAST) -> Column:
    """The first of main, article, role and id/class matches with enough words, else null."""
    found = [F.trim(F.regexp_extract(page, p, 1)) for p in MAIN]
    return F.coalesce(*[F.when(word_count(c) >= max(least, 120), c) for c in found])


def largest_block(page: Column) -> Column:
    """The block with most words; of equal ones the first; blocks without words don't count."""
    blocks = F.transform(F.regexp_extract_all(page, F.lit(BLOCK), F.lit(1)), lambda b, i: F.struct(word_count(b).alias("n"), (-i).alias("i"), b.alias("b")))
    return F.array_max(F.filter(blocks, lambda b: b["n"] > 0))["b"]


def selected(df: DataFrame, page: str = "html", least: int = LEAST) -> DataFrame:
    """Adds ``content`` and ``method``: main content, else the largest block, else the whole page."""
    df = df.withColumn("_clean", cleaned(F.col(page)))
    df = df.withColumn("_main", main_content(F.col("_clean"), least)).withColumn("_block", F.when(F.col("_main").isNull(), largest_block(F.col("_clean"))))
    method = F.when(F.col("_main").isNotNull(), "auto_semantic").when(F.col("_block").isNotNull(), "auto_largest_block").otherwise("auto_full_page")
    return df.withColumn("content", F.coalesce("_main", "_block", "_clean")).withColumn("method", method).drop("_clean", "_main", "_block")


def markdown(content: Column) -> Column:
    """Headings, links, code, list items and block tags as Markdown, in that order; all else goes.

    For content without tables and code blocks, ``full_markdown`` has those too."""
    s = F.regexp_replace(content, BOXES, " ")
    s = F.regexp_replace(s, r"(?is)<table[^>]*>.*?</table>", " ")
    for level in range(1, 7):
        s = F.regexp_replace(s, rf"(?is)<h{level}[^>]*>\s*(.*?)\s*</h{level}>", "\n" + "#" * level + " $1\n")
    s = F.regexp_replace(s, r"""(?is)<a[^>]*href=["']([^"']+)["'][^>]*>\s*(\S.*?)\s*</a>""", "[$2]($1)")
    s = F.regexp_replace(s, r"(?is)<code[^>]*>(.*?)</code>", "`$1`")
    s = F.regexp_replace(s, r"(?is)<li[^>]*>(.*?)</li>", "\n- $1\n")
    s = F.regexp_replace(s, r"(?is)</?(?:p|div|section|article|br)\b[^>]*>", "\n")
    return unescape(F.regexp_replace(s, r"(?is)<[^>]+>", " "))


def _markdown_sql(x: str) -> str:
    steps = [(BOXES, " "), (r"(?is)<table[^>]*>.*?</table>", " ")]
    steps += [(rf"(?is)<h{n}[^>]*>\s*(.*?)\s*</h{n}>", "\n" + "#" * n + r" \1" + "\n") for n in range(1, 7)]
    steps += [(r"""(?is)<a[^>]*href=["']([^"']+)["'][^>]*>\s*(\S.*?)\s*</a>""", r"[\2](\1)"), (r"(?is)<code[^>]*>(.*?)</code>", r"`\1`"), (r"(?is)<li[^>]*>(.*?)</li>", "\n- \\1\n")]
    steps += [(r"(?is)</?(?:p|div|section|article|br)\b[^>]*>", "\n"), (r"(?is)<[^>]+>", " ")]
    for p, r in steps:
        x = f"regexp_replace({x}, '{_q(p)}', '{_q(r)}', 'g')"
    return unescape_sql(x)


def is_noise(line: Column) -> Column:
    low = F.lower(line)
    return low.startswith("privacy policy") | low.startswith("cookie") | low.startswith("terms of service") | low.contains("share on ") | low.contains("follow us")


def deduped_lines(df: DataFrame, key: str, md: str) -> DataFrame:
    """key, pos, line: spaces squeezed, navigation noise and lines seen earlier in the page dropped,
    lines inside code fences kept as they are, blank runs cut to one."""
    rows = df.select(key, F.posexplode(F.split(md, "\n")).alias("pos", "raw"))
    in_order = Window.partitionBy(key).orderBy("pos")
    fence = F.ltrim("raw").startswith("```")
    rows = rows.withColumn("mark", fence).withColumn("inside", F.sum(fence.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    rows = rows.withColumn("as_is", F.col("mark") | F.col("inside")).withColumn("line", F.when(F.col("as_is"), F.col("raw")).otherwise(squeeze("raw")))
    seen = Window.partitionBy(key, "as_is", F.lower("line")).orderBy("pos")
    rows = rows.withColumn("k", F.row_number().over(seen))
    rows = rows.where(F.col("as_is") | (F.col("line") == "") | (~is_noise(F.col("line")) & (F.col("k") == 1)))
    blank = (F.col("line") == "") & ~F.col("as_is")
    rows = rows.withColumn("blank", blank).withColumn("before", F.lag("blank").over(in_order))
    return rows.where(~F.col("blank") | ~F.coalesce("before", F.lit(True))).select(key, F.col("pos").cast("long").alias("pos"), "line")


@query(
    rf"SELECT page_id, {unescape_sql('regexp_extract(html, $$(?is)<title>(.*?)</title>$$, 1)')} AS title, CAST(length({cleaned_sql('html')}) AS BIGINT) AS clean_chars FROM pages"
)
def w1_title_and_noise(spark, sf_dir):
    title = unescape(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.char_length(cleaned(F.col("html"))).cast("long").alias("clean_chars"))


_MAIN_SQL = ", ".join(f"CASE WHEN {word_count_sql(f'trim(regexp_extract(c, $${p}$$, 1))')} >= {LEAST} THEN trim(regexp_extract(c, $${p}$$, 1)) END" for p in MAIN)
_BLOCKS_SQL = f"list_filter(list_transform(regexp_extract_all(c, $${BLOCK}$$, 1), lambda b, i: {{'n': {word_count_sql('b')}, 'i': -i, 'b': b}}), lambda b: b.n > 0)"
_SELECTED = (
    f"WITH k AS (SELECT page_id, url, html, {cleaned_sql('html')} AS c FROM pages), m AS (SELECT *, coalesce({_MAIN_SQL}) AS main, list_sort({_BLOCKS_SQL}, 'DESC')[1].b AS block FROM k), "
    "sel AS (SELECT page_id, url, html, coalesce(main, block, c) AS content, CASE WHEN main IS NOT NULL THEN 'auto_semantic' WHEN block IS NOT NULL THEN 'auto_largest_block' ELSE 'auto_full_page' END AS method FROM m)"
)


@query(f"{_SELECTED} SELECT page_id, method, CAST({word_count_sql('content')} AS BIGINT) AS words FROM sel")
def w2_content_strategy(spark, sf_dir):
    return selected(spread(table(spark, sf_dir, "pages"))).select("page_id", "method", word_count("content").cast("long").alias("words"))


@query(f"{_SELECTED} SELECT page_id, sha256({_markdown_sql('content')}) AS digest FROM sel")
def w5_markdown(spark, sf_dir):
    return selected(spread(table(spark, sf_dir, "pages"))).select("page_id", F.sha2(markdown(F.col("content")).cast("binary"), 256).alias("digest"))


@query(
    f"{_SELECTED}, l AS (SELECT page_id, unnest(string_split(md, chr(10))) AS raw, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS pos FROM (SELECT page_id, {_markdown_sql('content')} AS md FROM sel)), "
    r"n AS (SELECT page_id, pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM l), "
    "first AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(line) ORDER BY pos) AS nth FROM n), "
    "f AS (SELECT *, line = '' AS blank FROM first WHERE line = '' OR (nth = 1 AND NOT (starts_with(lower(line), 'privacy policy') OR starts_with(lower(line), 'cookie') OR starts_with(lower(line), 'terms of service') OR contains(lower(line), 'share on ') OR contains(lower(line), 'follow us')))), "
    "b AS (SELECT *, lag(blank) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM f) SELECT page_id, pos, line FROM b WHERE NOT blank OR NOT coalesce(before, true)"
)
def w11_markdown_dedupe(spark, sf_dir):
    return deduped_lines(selected(spread(table(spark, sf_dir, "pages"))).select("page_id", markdown(F.col("content")).alias("md")), "page_id", "md")


@query(
    f"{_SELECTED} SELECT page_id, CASE WHEN length({_markdown_sql('content')}) >= {LEAST} THEN 'ok' WHEN "
    + " OR ".join(f"contains(lower(html), '{_q(m)}')" for m in MARKERS)
    + r" OR len(regexp_extract_all(html, '(?is)<script\b')) >= 4 THEN 'dynamic_content_unavailable' ELSE 'insufficient_content' END AS status FROM sel"
)
def w17_status(spark, sf_dir):
    low = F.lower("html")
    dynamic = F.regexp_count("html", F.lit(r"(?is)<script\b")) >= 4
    for m in MARKERS:
        dynamic = dynamic | low.contains(m)
    status = F.when(F.char_length(markdown(F.col("content"))) >= max(LEAST, 80), "ok").when(dynamic, "dynamic_content_unavailable").otherwise("insufficient_content")
    return selected(spread(table(spark, sf_dir, "pages"))).select("page_id", status.alias("status"))


def clean_url(url: Column) -> Column:
    """Without tracking parameters; other parameters keep their order."""
    base, query_ = F.split_part(url, F.lit("?"), F.lit(1)), F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.filter(F.split(query_, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(TRACKING))
    clean = F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment)
    return F.when(F.contains(url, F.lit("?")), clean).otherwise(F.trim(url))


@query(
    "WITH u AS (SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'utm_source=a&id=' || page_id || '&gclid=x&b=2' AS url FROM pages) "
    f"SELECT page_id, split_part(url, '?', 1) || '?' || array_to_string(list_filter(string_split(regexp_extract(url, '[?](.*)', 1), '&'), lambda p: NOT regexp_matches(split_part(p, '=', 1), '{TRACKING}')), '&') || '#top' AS clean, url AS bare FROM u"
)
def w14_clean_urls(spark, sf_dir):
    """Tracking parameters gone (W14); fragment gone."""
    own = F.split_part("url", F.lit("#"), F.lit(1))
    url = F.concat(own, F.when(F.contains(own, F.lit("?")), "&").otherwise("?"), F.lit("utm_source=a&id="), "page_id", F.lit("&gclid=x&b=2#top"))
    return table(spark, sf_dir, "pages").select("page_id", clean_url(url).alias("clean"), F.regexp_replace(url, "#.*$", "").alias("bare"))


def query_pairs(url: Column) -> Column:
    """array<struct<key, value>> of a URL's query, decoded as forms are: ``+`` is a blank, empty parts are none, a
    pair without ``=`` has an empty value; escapes that can't be read stay as they are (F9)."""
    decoded = lambda c: F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    at = lambda p: F.instr(p, "=")
    key = lambda p: F.when(at(p) > 0, F.substr(p, F.lit(1), at(p) - 1)).otherwise(p)
    value = lambda p: F.when(at(p) > 0, F.substr(p, at(p) + 1)).otherwise("")
    return F.transform(parts, lambda p: F.struct(decoded(key(p)).alias("key"), decoded(value(p)).alias("value")))


_QUERIES = ["?a=1&b=two+words&&c", "?x=%C3%A9%20y&x=2#f?no=1", "", "?=empty&k==v&", "#only?f=1", "?u=https%3A%2F%2Fh.example%2F%3Fq%3D1"]


@query(
    f"WITH u AS (SELECT page_id, regexp_extract(url, '^[^?#]*') || [{', '.join(repr(q) for q in _QUERIES)}][page_id % {len(_QUERIES)} + 1] AS url FROM pages), "
    "p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '') AS parts FROM u), "
    "e AS (SELECT page_id, url, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS pos FROM p) "
    "SELECT page_id, pos, url_decode(replace(regexp_extract(p, '^[^=]*'), '+', ' ')) AS key, url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' ')) AS value, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM e"
)
def f9_query_pairs(spark, sf_dir):
    """Query pairs and fragments of URLs."""
    ending = F.element_at(F.array(*map(F.lit, _QUERIES)), (F.col("page_id") % len(_QUERIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^[^?#]*", 0), ending).alias("url"))
    rows = rows.select("page_id", F.posexplode(query_pairs(F.col("url"))).alias("pos", "p"), F.nullif(F.regexp_extract("url", "#(.*)$", 1), F.lit("")).alias("fragment"))
    return rows.select("page_id", "pos", "p.key", "p.value", "fragment")
