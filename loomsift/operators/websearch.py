"""Search results from captured answers: anchors of result pages, rows of JSON of any shape, one schema."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..registry import query
from ..sources.searches import SEARCHES_SQL, captured_searches
from ..sources.tables import table
from .addresses import AUTHORITY, SCHEME, host_of, policy_sql, url_policy
from .captured import RESULT, SNIPPET, result_links

# Any anchor with an address; titles of links that lead nowhere; entities in the order in which they are
# replaced; where JSON answers hold their rows, and what rows call their fields.
ANCHOR = r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
NAV_TITLES = ["all", "images", "videos", "news", "maps", "shopping", "settings", "feedback", "privacy", "next", "previous", "more", "duckduckgo"]
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
ROW_KEYS = ["results", "data", "items", "web", "organic", "organic_results", "documents"]
URL_FIELDS = ["url", "link", "href"]
TITLE_FIELDS = ["title", "name"]
SNIPPET_FIELDS = ["snippet", "description", "content", "summary", "body", "text"]
INTERNAL = "duckduckgo.com"
WHITE = " \t\n\x0b\f\r"
HTML_PROVIDERS = ["duckduckgo_html"]
RESULT_COLUMNS = ["search_id", "provider", "rank", "url", "normalized_url", "title", "snippet", "content_hash_prefix", "extraction_method"]


def plain_text(html: Column) -> Column:
    """Tags as blanks, entities spelt out, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<[^>]+>", " ")
    for entity, own in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(own))
    return squeeze(text)


def normalized(url: Column) -> Column:
    """Without a fragment; scheme and host in lower case, a default port left out, an empty path as ``/``."""
    base = F.regexp_replace(url, "#.*$", "")
    scheme, authority = F.lower(F.regexp_extract(base, SCHEME, 1)), F.regexp_extract(base, AUTHORITY, 1)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    host = F.regexp_replace(F.lower(F.substr(authority, F.char_length(user) + 1)), F.when(scheme == "https", ":443$").otherwise(":80$"), "")
    rest = F.substr(base, F.char_length(scheme) + 4 + F.char_length(authority))
    return F.concat(scheme, F.lit("://"), user, host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def target(href: Column) -> Column:
    """Where a link of a result page leads: redirects are decoded; null for a relative address."""
    own = F.btrim(href, F.lit(WHITE))
    own = F.when(own.startswith("//"), F.concat(F.lit("https:"), own)).otherwise(own)
    path = F.regexp_extract(own, r"^[^:]*://[^/?#]*(/[^?#]*)", 1)
    # Parameters keep their first value; the name may stand anywhere in the query.
    sent_to = F.try_url_decode(F.nullif(F.regexp_extract(own, r"^[^?#]*\?(?:[^#]*?&)?uddg=([^&#]+)", 1), F.lit("")))
    decoded = F.when(F.contains(host_of(own), F.lit(INTERNAL)) & path.startswith("/l/"), sent_to)
    return F.when(own.rlike(SCHEME), F.coalesce(decoded, own))


def allowed(url: Column, plain_http: Column) -> Column:
    return (url_policy(url) == "ok") & (plain_http | (F.lower(F.regexp_extract(url, SCHEME, 1)) == "https"))


def hash_prefix(*parts: str) -> Column:
    return F.left(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), F.lit(16))


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """Rows numbered by place, the first ``most`` of each search (the cap is the feature)."""
    rank = F.row_number().over(Window.partitionBy("search_id").orderBy("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long")).withColumn("content_hash_prefix", hash_prefix("url", "title", "snippet")).select(RESULT_COLUMNS)


def page_results(pages: DataFrame, most: int) -> DataFrame:
    """Results of result pages (search_id, provider, plain_http, body): anchors of the result class, and only where none
    of those counts all anchors.

    A result has a title that is no navigation, leads to an allowed address outside the provider, and is the
    first with its normalized address."""
    anchor = lambda a: F.struct(F.regexp_extract(a, ANCHOR, 1).alias("url"), F.regexp_extract(a, ANCHOR, 2).alias("title"), F.lit("").alias("snippet"))
    sides = {0: result_links(F.col("body"), 1 << 30), 1: F.transform(F.regexp_extract_all("body", F.lit(ANCHOR), F.lit(0)), anchor)}
    keys = ["search_id", "provider", "plain_http"]
    found = None
    for side, links in sides.items():
        rows = pages.select(*keys, F.lit(side).alias("side"), F.posexplode(links).alias("pos", "r"))
        found = rows if found is None else found.unionByName(rows)
    rows = found.select(*keys, "side", "pos", target(F.col("r.url")).alias("url"), plain_text(F.col("r.title")).alias("title"), plain_text(F.col("r.snippet")).alias("snippet"))
    rows = rows.where(F.col("url").isNotNull() & allowed(F.col("url"), F.col("plain_http")) & ~F.lower("title").isin("", *NAV_TITLES))
    rows = rows.withColumn("normalized_url", normalized(F.col("url"))).where(~F.contains(host_of(F.col("normalized_url")), F.lit(INTERNAL)))
    rows = rows.withColumn("first", F.min("side").over(Window.partitionBy("search_id"))).where("side = first")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("search_id", "normalized_url").orderBy("pos"))).where("k = 1")
    method = F.when(F.col("side") == 0, F.col("provider")).otherwise(F.concat("provider", F.lit("_generic_links")))
    return _ranked(rows.withColumn("extraction_method", method), most)


def _named(value: object) -> bool:
    return isinstance(value, dict) and any(isinstance(value.get(f), str) and value[f].strip() for f in URL_FIELDS)


def rows_of(value: object) -> Iterator[object]:
    """Rows of a parsed answer: each array that has an element with an address counts as a whole; others, and the
    ``ROW_KEYS`` of objects, are looked into from the last to the first."""
    if isinstance(value, list) and any(map(_named, value)):
        yield from value
    elif isinstance(value, (list, dict)):
        inner = value if isinstance(value, list) else [value[k] for k in ROW_KEYS if k in value]
        for part in reversed(inner):
            yield from rows_of(part)


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def json_rows(answers: DataFrame, id_col: str = "search_id", body_col: str = "body") -> DataFrame:
    """``id_col``, pos, fields (map of a row's texts): rows of JSON answers.  What is no JSON, or nested too deeply to be
    read, has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, fields = [], [], []
            for key, body in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                try:
                    found = list(rows_of(json.loads(body or "", parse_constant=_refused)))
                except (ValueError, RecursionError):
                    found = []
                for pos, row in enumerate(found):
                    ids.append(key)
                    places.append(pos)
                    fields.append([(k, v) for k, v in row.items() if isinstance(v, str)] if isinstance(row, dict) else [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch[0].type), pa.array(places, pa.int64()), pa.array(fields, pa.map_(pa.string(), pa.string()))], names=[id_col, "pos", "fields"])

    kind = dict(answers.dtypes)[id_col]
    return answers.select(id_col, body_col).mapInArrow(read, f"{id_col} {kind}, pos long, fields map<string,string>")


def json_results(answers: DataFrame, most: int) -> DataFrame:
    """Results of JSON answers (search_id, provider, plain_http, body): rows with an allowed address, under whichever
    names they have; equal addresses stay."""
    pick = lambda names: F.coalesce(*[F.nullif(F.btrim(F.col("fields")[n], F.lit(WHITE)), F.lit("")) for n in names])
    rows = json_rows(answers).join(answers.select("search_id", "provider", "plain_http"), "search_id")
    rows = rows.select("search_id", "provider", "plain_http", "pos", pick(URL_FIELDS).alias("url"), pick(TITLE_FIELDS).alias("title"), F.coalesce(pick(SNIPPET_FIELDS), F.lit("")).alias("snippet"))
    rows = rows.where(F.col("url").isNotNull() & allowed(F.col("url"), F.col("plain_http")))
    rows = rows.withColumn("title", F.coalesce("title", "url")).withColumn("normalized_url", normalized(F.col("url")))
    return _ranked(rows.withColumn("extraction_method", F.lit("json_array")), most)


def search_results(searches: DataFrame, most: int = 10) -> DataFrame:
    """Results of captured answers of all providers in one schema; an answer with an error status has none."""
    good = searches.where(F.col("status").between(200, 299))
    html = F.col("provider").isin(HTML_PROVIDERS)
    return page_results(good.where(html), most).unionByName(json_results(good.where(~html), most))


def _list_sql(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_TAGLESS = "regexp_replace({x}, '(?is)<[^>]+>', ' ', 'g')"
_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(" + _TAGLESS + r", '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '\s+', ' ', 'g'))".replace('\\"', '"')
_NORMAL = (
    "regexp_replace(lower(regexp_extract({u}, '^[^:]*://[^/?#]*')), CASE WHEN starts_with(lower({u}), 'https:') THEN ':443$' ELSE ':80$' END, '') || "
    "CASE WHEN starts_with(regexp_extract({u}, '^[^:]*://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract({u}, '^[^:]*://[^/?#]*([^#]*)', 1)"
)
_GOOD = policy_sql("url") + " = 'ok' AND (plain_http OR starts_with(lower(url), 'https:'))"


def _links_sql(pattern: str, side: int) -> str:
    return f"SELECT search_id, provider, plain_http, body, {side} AS side, unnest(regexp_extract_all(body, $${pattern}$$)) AS a, generate_subscripts(regexp_extract_all(body, $${pattern}$$), 1) AS pos FROM pages_ok"


PAGES_SQL = (
    f"pages_ok AS (SELECT * FROM searches WHERE status = 200 AND provider IN ({_list_sql(HTML_PROVIDERS)})), "
    f"links AS ({_links_sql(RESULT, 0)} UNION ALL {_links_sql(ANCHOR, 1)}), "
    f"raw AS (SELECT search_id, provider, plain_http, side, pos, CASE WHEN side = 0 THEN regexp_extract(a, $${RESULT}$$, 1) ELSE regexp_extract(a, $${ANCHOR}$$, 1) END AS href, "
    f"{_PLAIN.format(x=f'CASE WHEN side = 0 THEN regexp_extract(a, $${RESULT}$$, 2) ELSE regexp_extract(a, $${ANCHOR}$$, 2) END')} AS title, "
    f"CASE WHEN side = 0 THEN {_PLAIN.format(x=f'regexp_extract(substr(body, strpos(body, a) + length(a), 1400), $${SNIPPET}$$, 1)')} ELSE '' END AS snippet FROM links), "
    "abs AS (SELECT *, CASE WHEN starts_with(href, '//') THEN 'https:' || href ELSE href END AS h FROM raw), "
    "led AS (SELECT *, CASE WHEN regexp_matches(h, '^https?://[^/]*duckduckgo[.]com/l/.*[?&]uddg=') THEN url_decode(replace(regexp_extract(h, '[?&]uddg=([^&#]+)', 1), '+', ' ')) ELSE h END AS url FROM abs WHERE regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:')), "
    f"ok AS (SELECT *, {_NORMAL.format(u='url')} AS normalized_url FROM led WHERE {_GOOD} AND lower(title) NOT IN ('', {_list_sql(['all', 'images', 'videos', 'news', 'maps', 'shopping', 'settings', 'feedback', 'privacy', 'next', 'previous', 'more', 'duckduckgo'])})), "
    "own AS (SELECT *, min(side) OVER (PARTITION BY search_id) AS first FROM ok WHERE NOT regexp_matches(normalized_url, '^https?://[^/]*duckduckgo[.]com')), "
    "uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_id, normalized_url ORDER BY pos) AS k FROM own WHERE side = first) WHERE k = 1), "
    "page_hits AS (SELECT search_id, provider, row_number() OVER (PARTITION BY search_id ORDER BY pos) AS rank, url, normalized_url, title, snippet, provider || CASE WHEN side = 0 THEN '' ELSE '_generic_links' END AS extraction_method FROM uniq)"
)


def _pick_sql(names: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(v, '$.{n}') = 'VARCHAR' THEN nullif(trim(json_extract_string(v, '$.{n}')), '') END" for n in names) + ")"


_IS_ROWS = "len(list_filter(CAST(node AS JSON[]), lambda v: " + " OR ".join(f"(json_type(v, '$.{n}') = 'VARCHAR' AND trim(json_extract_string(v, '$.{n}')) <> '')" for n in ["url", "link", "href"]) + ")) > 0"
_KEYS = "['results', 'data', 'items', 'web', 'organic', 'organic_results', 'documents']"
JSON_SQL = (
    f"json_ok AS (SELECT * FROM searches WHERE status = 200 AND provider NOT IN ({_list_sql(HTML_PROVIDERS)}) AND json_valid(body)), "
    "nodes(search_id, path, node) AS (SELECT search_id, []::BIGINT[], body::JSON FROM json_ok UNION ALL "
    # A later part comes first, so places are counted down.
    f"SELECT search_id, list_append(path, -i), child FROM (SELECT search_id, path, CASE WHEN json_type(node) = 'ARRAY' THEN CASE WHEN {_IS_ROWS} THEN []::JSON[] ELSE CAST(node AS JSON[]) END "
    f"ELSE list_transform({_KEYS}, lambda k: json_extract(node, '$.' || k)) END AS parts FROM nodes WHERE json_type(node) IN ('ARRAY', 'OBJECT')) AS n, unnest(range(1, len(parts) + 1)) AS u(i), LATERAL (SELECT parts[i] AS child) AS c WHERE child IS NOT NULL), "
    f"arrays AS (SELECT search_id, path, CAST(node AS JSON[]) AS parts FROM (SELECT * FROM nodes WHERE json_type(node) = 'ARRAY') WHERE {_IS_ROWS}), "
    "vals AS (SELECT search_id, path, unnest(parts) AS v, generate_subscripts(parts, 1) AS i FROM arrays), "
    f"named AS (SELECT search_id, path, i, {_pick_sql(['url', 'link', 'href'])} AS url, {_pick_sql(['title', 'name'])} AS title, coalesce({_pick_sql(['snippet', 'description', 'content', 'summary', 'body', 'text'])}, '') AS snippet FROM vals WHERE json_type(v) = 'OBJECT'), "
    f"json_hits AS (SELECT search_id, provider, row_number() OVER (PARTITION BY search_id ORDER BY path, i) AS rank, url, {_NORMAL.format(u='url')} AS normalized_url, coalesce(title, url) AS title, snippet, 'json_array' AS extraction_method FROM named JOIN json_ok USING (search_id) WHERE url IS NOT NULL AND {_GOOD})"
)
_HASHED = "SELECT *, left(sha256(url || chr(10) || title || chr(10) || snippet), 16) AS content_hash_prefix FROM "


@query(f"WITH {SEARCHES_SQL}, {PAGES_SQL} {_HASHED} page_hits WHERE rank <= 10")
def w27_page_results(spark, sf_dir):
    """Result pages: classed anchors, else all; push rules, navigation, redirects and hashes."""
    html = F.col("provider").isin(HTML_PROVIDERS)
    return page_results(captured_searches(spark, sf_dir).where(html & (F.col("status") == 200)), 10)


@query(f"WITH RECURSIVE {SEARCHES_SQL}, {JSON_SQL} {_HASHED} json_hits WHERE rank <= 10")
def w30_json_results(spark, sf_dir):
    """JSON answers of any shape: rows collected, fields by their aliases, policy and ranks."""
    html = F.col("provider").isin(HTML_PROVIDERS)
    return json_results(captured_searches(spark, sf_dir).where(~html & (F.col("status") == 200)), 10)


@query(f"WITH RECURSIVE {SEARCHES_SQL}, {PAGES_SQL}, {JSON_SQL} {_HASHED} (SELECT * FROM page_hits UNION ALL SELECT * FROM json_hits) WHERE rank <= 2")
def s12_search_providers(spark, sf_dir):
    """All six providers' captured answers in one schema, two results of each."""
    return search_results(captured_searches(spark, sf_dir), 2)


@query(
    r"WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*') AS site, html FROM pages), "
    + f"l AS (SELECT page_id, site, unnest(regexp_extract_all(html, $${ANCHOR}$$)) AS a, generate_subscripts(regexp_extract_all(html, $${ANCHOR}$$), 1) AS pos FROM p), "
    + f"r AS (SELECT page_id, pos, true AS plain_http, CASE WHEN starts_with(h, '/') THEN site || h ELSE h END AS url, title FROM (SELECT *, regexp_extract(a, $${ANCHOR}$$, 1) AS h, {_PLAIN.format(x=f'regexp_extract(a, $${ANCHOR}$$, 2)')} AS title FROM l)), "
    + f"ok AS (SELECT *, {_NORMAL.format(u='url')} AS normalized_url FROM r WHERE regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND {_GOOD} AND lower(title) NOT IN ('', 'all', 'images', 'videos', 'news', 'maps', 'shopping', 'settings', 'feedback', 'privacy', 'next', 'previous', 'more', 'duckduckgo')), "
    + "u AS (SELECT *, row_number() OVER (PARTITION BY page_id, normalized_url ORDER BY pos) AS k FROM ok) "
    + "SELECT page_id, url, title, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, left(sha256(url || chr(10) || title || chr(10)), 16) AS hash FROM u WHERE k = 1"
)
def w26_page_links(spark, sf_dir):
    """All links of the given pages as results, relative ones made absolute by the page's own site first."""
    site = F.regexp_extract("url", r"^[^:]*://[^/?#]*", 0)
    body = F.regexp_replace("html", F.lit(r"""(?is)(<a\b[^>]*href\s*=\s*["'])(/)"""), F.concat(F.lit("$1"), F.regexp_replace(site, r"([$\\])", r"\\$1"), F.lit("$2")))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("search_id"), F.lit("captured").alias("provider"), F.lit(True).alias("plain_http"), body.alias("body"))
    return page_results(pages, 1 << 30).select(F.col("search_id").alias("page_id"), "url", "title", "rank", F.col("content_hash_prefix").alias("hash"))
