"""Queries over captured sources, redirects, robots rules and result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redact_sql, squeeze
from ..registry import query
from ..sources.captures import NO_DOCUMENTATION, PRIORITIES, bounded_read, captured_output, first_documentation, folder_snapshot, page_caps, priority, scan_path, text_of
from ..sources.tables import SECRETS_SQL, secret_lines, table


_PATH = "/bin/src7:/bin/src2:/none:/bin/src7:/bin/src11"


@query(
    "WITH l AS (SELECT '/bin/' || source AS folder, 'd' || doc_id // 2 AS name, n_chars AS size FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0), p AS (SELECT unnest(['/bin/src7', '/bin/src2', '/bin/src11']) AS folder, unnest([0, 1, 4]) AS place), "
    "f AS (SELECT folder, name, folder || '/' || name AS path, place, min(size) AS size FROM l JOIN p USING (folder) GROUP BY ALL), k AS (SELECT * FROM f ORDER BY place, path LIMIT 60) SELECT folder, name, path, size, (SELECT count(*) FROM k) >= 60 AS capped FROM k"
)
def s1_path_scan(spark, sf_dir):
    """Executables on a path (S1); the cap is the scan's own."""
    docs = table(spark, sf_dir, "documents")
    mode = F.when(F.col("doc_id") % 3 == 0, 0o644).otherwise(0o755)
    listing = docs.select(F.concat(F.lit("/bin/"), "source").alias("folder"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2)).alias("name"), mode.alias("mode"), (F.col("doc_id") % 5 != 0).alias("is_file"), F.col("n_chars").alias("size"))
    return scan_path(listing, _PATH, 60)


@query(
    f"SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '{NO_DOCUMENTATION}' ELSE ['man ', 'help ', 'h '][doc_id % 4 + 1] || doc_id END AS documentation FROM documents"
)
def s2_documentation(spark, sf_dir):
    """Manual, then two help texts, then a stub."""
    when = lambda k, v, other: F.when(F.col("doc_id") % 4 == k, F.concat(F.lit(v), "doc_id")).otherwise(F.lit(other))
    text = first_documentation(when(0, "man ", " \n"), when(1, "help ", ""), when(2, "h ", None))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("documentation"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 7 < 6 THEN doc_id % 7 ELSE 6 END AS BIGINT) AS priority FROM documents")
def s3_priority(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, [*PRIORITIES, "other"])), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", priority(kind).alias("priority"))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id % 6 <> 0")
def s5_index_chunks(spark, sf_dir):
    """Chunks without tombstones, joined with their entries (S5); a chunk without an entry is an error."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", "source", (F.col("doc_id") % 6 == 0).alias("tombstone")).where(~F.col("tombstone"))
    entries = docs.select("doc_id", "lang", F.lit(True).alias("known"))
    found = chunks.join(entries, "doc_id", "left")
    checked = F.when(F.col("known").isNull(), F.raise_error(F.lit("chunk without an entry"))).otherwise(F.col("lang"))
    return found.select("doc_id", "source", checked.alias("lang"))


@query(
    f"WITH {SECRETS_SQL}, r AS (SELECT doc_id, list_max(list_filter(range(0, 97), lambda n: strlen(left(left(text, 96), n)) <= 96)) AS n, text FROM secret_lines), c AS (SELECT doc_id, left(text, n) AS head, strlen(text) AS size, strlen(left(text, n)) AS got FROM r) "
    f"SELECT doc_id, {redact_sql('head')} AS text, size > 96 AS truncated, least(size, 96) AS bytes_read FROM c WHERE doc_id % 9 <> 0"
)
def s11_bounded_read(spark, sf_dir):
    """The first 96 bytes of each file without its half characters, secrets hidden (S11); binary files are refused."""
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 9 == 0, F.concat(F.unhex(F.lit("00")), raw)).otherwise(raw)
    rows = secret_lines(spark, sf_dir).select("doc_id", bounded_read(content, 96).alias("r")).where("r is not null")
    return rows.select("doc_id", F.regexp_replace("r.text", "�+$", "").alias("text"), "r.truncated", "r.bytes_read")


@query(
    "SELECT page_id, CAST(least(strlen(html), 2000) AS BIGINT) AS fetched, strlen(html) > 1024 AS truncated, sha256(left(html, list_max(list_filter(range(0, 1025), lambda n: strlen(left(left(html, 1024), n)) <= 1024)))) AS digest FROM pages"
)
def s13_page_caps(spark, sf_dir):
    """Pages under a fetch cap of 2000 bytes and a parse cap of 1024 (S13); half characters go."""
    rows = table(spark, sf_dir, "pages").select("page_id", page_caps(F.col("html"), 2000, 100).alias("c"))
    return rows.select("page_id", "c.fetched", "c.truncated", F.sha2(F.regexp_replace("c.html", "�+$", "").cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, to_base64(encode(text)[1:400]) AS base64, strlen(text) > 400 AS truncated FROM documents")
def s18_captured_output(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", captured_output(F.encode("text", "UTF-8"), 400).alias("c"))
    return rows.select("doc_id", "c.*")


@query(
    "WITH n AS (SELECT DISTINCT source, CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'D' ELSE 'd' END || doc_id AS name, doc_id % 3 = 0 AS is_dir FROM documents), "
    "k AS (SELECT *, starts_with(name, '.') AS hidden, row_number() OVER (PARTITION BY source, starts_with(name, '.'), is_dir ORDER BY lower(name), name) <= CASE WHEN is_dir THEN 4 ELSE 6 END AS kept FROM n) "
    "SELECT source, coalesce(string_agg(name, ', ' ORDER BY lower(name), name) FILTER (kept AND is_dir AND NOT hidden), '') AS dirs, coalesce(string_agg(name, ', ' ORDER BY lower(name), name) FILTER (kept AND NOT is_dir AND NOT hidden), '') AS files, "
    "count(*) FILTER (hidden) AS hidden, count(*) FILTER (NOT hidden AND NOT kept) AS left_out FROM k GROUP BY source"
)
def s19_folder_snapshot(spark, sf_dir):
    """What a folder holds, hidden names left out, the first of each sort."""
    n = F.col("doc_id")
    name = F.concat(F.when(n % 5 == 0, ".").otherwise(""), F.when(n % 2 == 0, "D").otherwise("d"), n.cast("string"))
    return folder_snapshot(table(spark, sf_dir, "documents").select("source", name.alias("name"), (n % 3 == 0).alias("is_dir")), "source", 4, 6)


def robots_verdicts(df: DataFrame) -> DataFrame:
    """page_id, allowed of pages (page_id, status, body, agent, path): by status 401 and 403 deny, any other but success
    allows; else the longest pattern that matches the path decides, an allowing one among equals; else allowed.

    The groups that name the agent count or, where none does, those for ``*``.  Lines become rows: runs of agent
    lines number the groups, so a file's rules are found by a join of its lines with themselves."""
    asked = df.select("body", "agent", "path").distinct().withColumn("f", F.xxhash64("body", "agent", "path"))
    line = F.split_part(F.col("raw"), F.lit("#"), F.lit(1))
    lines = asked.select("f", F.lower("agent").alias("agent"), "path", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\n|\r")).alias("pos", "raw"))
    lines = lines.withColumn("key", F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1))))).withColumn("value", F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)))
    lines = lines.where(F.col("key").isin("user-agent", "allow", "disallow")).withColumn("names", F.col("key") == "user-agent")
    in_file = Window.partitionBy("f").orderBy("pos")
    begins = F.col("names") & ~F.coalesce(F.lag("names").over(in_file), F.lit(False))
    lines = lines.withColumn("begins", begins.cast("int")).withColumn("g", F.sum("begins").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    named = F.when(F.col("names"), F.split_part(F.lower("value"), F.lit("/"), F.lit(1)))
    lines = lines.withColumn("own", F.max(F.coalesce(named == F.col("agent"), F.lit(False))).over(Window.partitionBy("f")))
    meant = F.when(F.col("own"), F.col("agent")).otherwise(F.lit("*"))
    lines = lines.withColumn("meant", F.max(F.coalesce(named == meant, F.lit(False))).over(Window.partitionBy("f", "g")))
    pattern = F.regexp_replace("value", r"\$$", "")
    quoted = F.array_join(F.transform(F.split(pattern, r"\*"), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), ".*")
    shape = F.concat(F.lit("^"), quoted, F.when(F.col("value").endswith("$"), "$").otherwise(""))
    hits = lines.where(F.col("meant") & ~F.col("names") & (F.col("value") != "") & F.rlike("path", shape))
    allow = F.col("key") == "allow"
    best = hits.groupBy("f").agg(F.max_by(allow, F.struct(F.char_length("value"), allow)).alias("said"))
    rows = df.withColumn("f", F.xxhash64("body", "agent", "path")).join(best, "f", "left")
    by_rules = F.coalesce("said", F.lit(True))
    return rows.select("page_id", F.when(F.col("status").isin(401, 403), False).when(~F.col("status").between(200, 299), True).otherwise(by_rules).alias("allowed"))


# Inputs: status, robots file, path and whether it is allowed for the agent ``reader``.
_ROBOTS = [
    (404, "User-agent: *\nDisallow: /", "/a", True), (403, "", "/a", False), (401, "", "/a", False), (500, "User-agent: *\nDisallow: /", "/a", True),
    (200, "User-agent: *\nDisallow: /private # all of it\nAllow: /private/open", "/private/open/x", True), (200, "User-agent: *\nDisallow: /private", "/private/x", False),
    (200, "User-agent: other\nUser-agent: Reader/2.0\nDisallow: /x\n\nUser-agent: *\nDisallow: /", "/y", True), (200, "User-agent: reader\nDisallow: /*.pdf$", "/a/b.pdf", False), (200, "User-agent: reader\nDisallow: /*.pdf$", "/a/b.pdf?x", True),
    (200, "User-agent: *\nDisallow: /a\nAllow: /a", "/a", True), (200, "User-agent: *\nDisallow:", "/a", True), (200, "", "/", True),
]


_CASES = ", ".join("({}, {}, '{}', '{}')".format(i, r[0], r[1].replace("\n", "' || chr(10) || '"), r[2]) for i, r in enumerate(_ROBOTS))


@query(
    f"WITH c(k, status, body, path) AS (VALUES {_CASES}), l AS (SELECT k, path, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM c), "
    "t AS (SELECT k, path, pos, lower(trim(split_part(split_part(raw, '#', 1), ':', 1))) AS key, trim(regexp_extract(split_part(raw, '#', 1), '^[^:]*:(.*)$', 1)) AS value FROM l), "
    "n AS (SELECT *, CASE WHEN key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY k ORDER BY pos), '') <> 'user-agent' THEN 1 ELSE 0 END AS b FROM t WHERE key IN ('user-agent', 'allow', 'disallow')), "
    "g AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY pos) AS g FROM n), a AS (SELECT k, g, lower(split_part(value, '/', 1)) AS name FROM g WHERE key = 'user-agent'), "
    "w AS (SELECT k, CASE WHEN bool_or(name = 'reader') THEN 'reader' ELSE '*' END AS wanted FROM a GROUP BY k), "
    "r AS (SELECT DISTINCT g.k, value, key = 'allow' AS allow, path FROM g JOIN a ON a.k = g.k AND a.g = g.g JOIN w ON w.k = g.k AND name = wanted WHERE key <> 'user-agent' AND value <> ''), "
    "m AS (SELECT k, arg_max(allow, length(value) * 2 + CAST(allow AS INTEGER)) AS said FROM r WHERE regexp_matches(path, '^' || replace(regexp_replace(regexp_replace(value, '[$]$', ''), '([.?+()])', '[\\1]', 'g'), '*', '.*') || CASE WHEN ends_with(value, '$') THEN '$' ELSE '' END) GROUP BY k) "
    f"SELECT page_id, CASE WHEN status IN (401, 403) THEN false WHEN status NOT BETWEEN 200 AND 299 THEN true ELSE coalesce(said, true) END AS allowed FROM pages JOIN c ON page_id % {len(_ROBOTS)} = c.k LEFT JOIN m USING (k)"
)
def w24_robots(spark, sf_dir):
    """Whether robots files let a reader in."""
    cases = spark.createDataFrame([(i, s, t, "reader", p) for i, (s, t, p, _) in enumerate(_ROBOTS)], "k long, status int, body string, agent string, path string")
    rows = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % len(_ROBOTS)).alias("k"))
    return robots_verdicts(rows.join(F.broadcast(cases), "k"))


# Result anchors and snippets by their class; a snippet stands within so many characters.
RESULT = r"""(?is)<a\b[^>]*class\s*=\s*["'][^"']*\bresult__a\b[^"']*["'][^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
SNIPPET = r"""(?is)<a\b[^>]*class\s*=\s*["'][^"']*\bresult__snippet\b[^"']*["'][^>]*>(.*?)</a>"""
REACH = 1400


def result_links(body: Column, most: int) -> Column:
    """array<struct<url, title, snippet>> of a result page: each anchor with the first snippet after it
    within reach, empty where there is none."""
    anchors = F.regexp_extract_all(body, F.lit(RESULT), F.lit(0))
    bare = lambda html: squeeze(F.regexp_replace(html, r"(?is)<[^>]+>", " "))

    def take(state: Column, a: Column) -> Column:
        end = F.call_function("locate", a, body, state["at"])
        end = (end + F.char_length(a)).cast("int")
        rest = F.substring(body, end, F.lit(REACH))
        link = F.struct(F.regexp_extract(a, RESULT, 1).alias("url"), bare(F.regexp_extract(a, RESULT, 2)).alias("title"), bare(F.regexp_extract(rest, SNIPPET, 1)).alias("snippet"))
        return F.struct(end.alias("at"), F.array_append(state["links"], link).alias("links"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<url:string,title:string,snippet:string>>").alias("links"))
    return F.aggregate(F.slice(anchors, 1, most), start, take, lambda s: s["links"])


@query(
    "SELECT page_id, unnest([0, 1, 2]) AS pos, unnest(['https://a.example/' || page_id, 'https://b.example/' || page_id, 'https://c.example/' || page_id]) AS url, unnest(['First ' || page_id, 'Second', 'Third one']) AS title, unnest(['about ' || page_id, 'of the third', 'of the third']) AS snippet FROM pages"
)
def w25_result_links(spark, sf_dir):
    """Three results, the second without a snippet of its own: the next one in reach counts."""
    body = F.format_string(
        "<div><a rel=x class=\"result__a\" href=\"https://a.example/%d\"><b>First</b> %d</a><a class='result__snippet' href='#'>about <i>%d</i></a>"
        "<a class=\"big result__a\" href='https://b.example/%d'>Second</a> <a class=\"result__a\" href=\"https://c.example/%d\">Third\n one</a><a class=\"result__snippet\">of the third</a></div>",
        *[F.col("page_id")] * 5,
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(result_links(body, 10)).alias("pos", "r"))
    return rows.select("page_id", "pos", "r.*")


# Inputs: bytes that are no UTF-8, as hexadecimal digits, and what each becomes: a replacement per longest part that could
# begin a character, else per byte.
_ODD_BYTES = [("", ""), ("FF", "\ufffd"), ("C3", "\ufffd"), ("E282", "\ufffd"), ("F09F98", "\ufffd"), ("C0AF", "\ufffd\ufffd"), ("EDA080", "\ufffd\ufffd\ufffd"), ("8081", "\ufffd\ufffd"), ("C3A9", "\u00e9"), ("E28241", "\ufffdA"), ("F4908080", "\ufffd\ufffd\ufffd\ufffd")]


@query(
    f"SELECT doc_id, md5([{', '.join(repr(t) for _, t in _ODD_BYTES)}][doc_id % {len(_ODD_BYTES)} + 1] || text || [{', '.join(repr(t) for _, t in _ODD_BYTES)}][(doc_id * 3) % {len(_ODD_BYTES)} + 1]) AS digest FROM documents"
)
def f10_lossy_decode(spark, sf_dir):
    """Texts between bytes that are no UTF-8, decoded with replacements."""
    odd = lambda n: F.unhex(F.element_at(F.array(*[F.lit(h) for h, _ in _ODD_BYTES]), (n % len(_ODD_BYTES) + 1).cast("int")))
    content = F.concat(odd(F.col("doc_id")), F.encode("text", "UTF-8"), odd(F.col("doc_id") * 3))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text_of(content).cast("binary")).alias("digest"))
