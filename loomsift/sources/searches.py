"""Captured answers of search providers: result pages and JSON bodies of every shape, one per page of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Inputs: provider, HTTP status, whether plain HTTP results are wanted, and the body with {u} for a page's URL, {e} for
# the URL as a query parameter and {n} for its number.
BODIES = [
    ("duckduckgo_html", 200, False, '<a rel=n class="result__a" href="https://a.example/{n}#x"><b>First</b> &amp; {n}</a><a class=\'result__snippet\' href="#">about <i>{n}</i></a> <a class="big result__a" href="//duckduckgo.com/l/?uddg={e}&amp;rut=1">Page&#39;s own</a><a class="result__a" href="https://A.example/{n}">again</a> <a class="result__a" href="https://c.example">Third\n one</a><a class="result__snippet">of &lt;third&gt;</a>'),
    ("duckduckgo_html", 200, False, '<a href="https://duckduckgo.com/about">Duck</a><a href="https://b.example/{n}">Images</a> <a href="https://b.example/{n}">Kept {n}</a><a href="/local">relative</a><a class="result__a" href="http://plain.example/">plain</a><a href="https://10.0.0.1/">inside</a><a id=q href = \'https://d.example:443/x?y={n}#z\'> two <br> words </a><a href="https://e.example/"> </a><a href="https://duckduckgo.com.example/">odd host</a>'),
    ("duckduckgo_html", 503, False, '<a class="result__a" href="https://a.example/">too late</a>'),
    ("custom_json", 200, True, '{"results": [{"url": "{u}", "title": "Page {n}", "snippet": "s {n}"}, {"link": " http://plain.example/{n} ", "name": ""}]}'),
    ("custom_json", 200, False, '[[{"items": {"documents": [{"href": "https://deep.example/{n}", "body": "deep"}]}, "data": [{"url": "https://data.example/{n}"}]}], {"web": [{"url": "https://web.example/"}, {"name": "no url"}, "text", {"url": 7}, {"url": "http://plain.example/"}, {"url": "https://web.example/"}]}]'),
    ("brave", 200, False, '{"query": {"q": "x"}, "web": {"type": "search", "results": [{"title": "B {n}", "url": "https://brave.example/{n}#frag", "description": "of b"}, {"title": "own", "url": "{u}"}]}}'),
    ("kagi", 200, False, '{"meta": {"ms": 3}, "data": [{"t": 0, "url": "https://kagi.example/{n}", "title": " K ", "snippet": ""}, {"t": 1, "list": ["a", "b"]}]}'),
    ("tavily", 200, False, '{"query": "x", "answer": null, "results": [{"title": "T", "url": "https://tavily.example/{n}", "content": "of {n}", "score": 0.9}, {"url": "https://127.0.0.1/"}, {"url": ""}]}'),
    ("whoogle", 200, False, '{"organic_results": [{"href": "https://w.example/{n}", "text": "t", "content": "c"}], "organic": {"results": [{"link": "https://first.example/{n}", "summary": "before"}]}}'),
    ("whoogle", 200, False, "no json {n}"),
    ("brave", 429, False, '{"results": [{"url": "https://late.example/"}]}'),
    ("kagi", 200, False, '{"other": [{"url": "https://unseen.example/"}], "data": {"items": []}}'),
]


def captured_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_id, provider, status, plain_http, body: every body for every page."""
    cases = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(s).alias("status"), F.lit(h).alias("plain_http"), F.lit(b).alias("body")) for p, s, h, b in BODIES])
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(cases).alias("k", "c"))
    body = F.replace(F.replace(F.replace(F.col("c.body"), F.lit("{u}"), F.col("url")), F.lit("{e}"), F.url_encode("url")), F.lit("{n}"), F.col("page_id").cast("string"))
    return rows.select((F.col("page_id") * len(BODIES) + F.col("k")).cast("long").alias("search_id"), "c.provider", "c.status", "c.plain_http", body.alias("body"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_CASES = ", ".join(f"({i}, '{p}', {s}, {str(h).lower()}, {_text(b)})" for i, (p, s, h, b) in enumerate(BODIES))
SEARCHES_SQL = (
    f"searches AS MATERIALIZED (SELECT page_id * {len(BODIES)} + k AS search_id, provider, status, plain_http, replace(replace(replace(b, '{{u}}', url), '{{e}}', replace(url_encode(url), '%20', '+')), '{{n}}', CAST(page_id AS VARCHAR)) AS body "
    f"FROM pages, (VALUES {_CASES}) AS v(k, provider, status, plain_http, b))"
)
