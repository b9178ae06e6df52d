"""Which URLs may be fetched: schemes, local names and blocked address classes, IPv4 and IPv6."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import let
from ..registry import query
from ..sources.tables import table

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
V4 = r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$"
#: Sixteen-bit groups that are all zero, then ``ffff`` and the last two groups: an IPv4 address inside.
MAPPED_DOTTED = r"^(?:0{0,4}:)+ffff:(\d+\.\d+\.\d+\.\d+)$"
MAPPED_HEX = r"^(?:0{0,4}:)+ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
#: ``::1`` and ``::`` in any spelling.
OWN_V6 = r"^[0:]*:0{0,3}[01]?$"
FIRST_GROUP = r"^([0-9a-f]{1,4}):"
LOCAL_NAMES = ["localhost", "metadata.google.internal"]
LOCAL_ENDS = [".localhost", ".local", ".internal"]


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, brackets or a final dot."""
    authority = F.regexp_replace(F.lower(F.regexp_extract(url, AUTHORITY, 1)), r"^.*@", "")
    return let(authority, lambda a: F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(F.split_part(a, F.lit(":"), F.lit(1)), r"\.+$", "")))


def _number(hexed: Column) -> Column:
    return F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("long")


def blocked_v4(host: Column) -> Column:
    """Loopback, private, link-local (with the metadata address), multicast, or of this host."""

    def of(octets: Column) -> Column:
        one, two = octets[0], octets[1]
        return one.isin(0, 10, 127) | one.between(224, 239) | ((one == 172) & two.between(16, 31)) | ((one == 192) & (two == 168)) | ((one == 169) & (two == 254))

    return F.coalesce(let(F.when(host.rlike(V4), F.transform(F.split(host, r"\."), lambda x: x.cast("long"))), of), F.lit(False))


def blocked_v6(host: Column) -> Column:
    """Loopback, unique local (fc00::/7), link-local (fe80::/10), multicast (ff00::/8), or a blocked IPv4
    address inside."""
    pair = F.array(_number(F.regexp_extract(host, MAPPED_HEX, 1)), _number(F.regexp_extract(host, MAPPED_HEX, 2)))
    dotted = lambda p: F.concat_ws(".", *[x.cast("string") for n in (p[0], p[1]) for x in (F.floor(n / 256), n % 256)])
    inside = let(pair, lambda p: F.when(p[0].isNotNull(), dotted(p)).otherwise(F.regexp_extract(host, MAPPED_DOTTED, 1)))
    first = let(_number(F.regexp_extract(host, FIRST_GROUP, 1)), lambda n: F.coalesce(n.between(0xFC00, 0xFDFF) | n.between(0xFE80, 0xFEBF) | (n >= 0xFF00), F.lit(False)))
    return F.when(host.contains(":"), host.rlike(OWN_V6) | first | blocked_v4(inside)).otherwise(False)


def url_policy(url: Column) -> Column:
    """Why a URL may not be fetched, or ``ok``: ``scheme``, ``host`` (none), ``local`` or ``address``."""
    scheme = F.lower(F.regexp_extract(url, SCHEME, 1))

    def of(host: Column) -> Column:
        local = host.isin(LOCAL_NAMES)
        for end in LOCAL_ENDS:
            local = local | host.endswith(end)
        return F.when(host == "", "host").when(local, "local").when(blocked_v4(host) | blocked_v6(host), "address").otherwise("ok")

    return F.when(~scheme.isin("http", "https"), "scheme").otherwise(let(host_of(url), of))


def policy_sql(url: str) -> str:
    """The same verdict as one expression of DuckDB SQL."""
    authority = f"regexp_replace(lower(regexp_extract({url}, '{AUTHORITY}', 1)), '^.*@', '')"
    host = rf"list_transform([{authority}], lambda a_: CASE WHEN starts_with(a_, '[') THEN regexp_extract(a_, '^\[([^\]]*)\]', 1) ELSE regexp_replace(split_part(a_, ':', 1), '\.+$', '') END)"
    number = lambda p, i: f"TRY_CAST('0x' || nullif(regexp_extract(h_, '{p}', {i}), '') AS BIGINT)"
    high, low = number(MAPPED_HEX, 1), number(MAPPED_HEX, 2)
    inside = f"coalesce(({high} // 256) || '.' || ({high} % 256) || '.' || ({low} // 256) || '.' || ({low} % 256), regexp_extract(h_, '{MAPPED_DOTTED}', 1))"

    def v4(h: str) -> str:
        one, two = (f"TRY_CAST(nullif(regexp_extract({h}, '{V4}', {i}), '') AS BIGINT)" for i in (1, 2))
        return f"coalesce({one} IN (0, 10, 127) OR {one} BETWEEN 224 AND 239 OR ({one} = 172 AND {two} BETWEEN 16 AND 31) OR ({one} = 192 AND {two} = 168) OR ({one} = 169 AND {two} = 254), false)"

    first = number(FIRST_GROUP, 1)
    v6 = f"(contains(h_, ':') AND (regexp_matches(h_, '{OWN_V6}') OR coalesce({first} BETWEEN {0xFC00} AND {0xFDFF} OR {first} BETWEEN {0xFE80} AND {0xFEBF} OR {first} >= {0xFF00}, false) OR list_transform([{inside}], lambda i_: {v4('i_')})[1]))"
    local = " OR ".join([f"h_ = '{n}'" for n in LOCAL_NAMES] + [f"ends_with(h_, '{e}')" for e in LOCAL_ENDS])
    verdict = f"CASE WHEN lower(regexp_extract({url}, '{SCHEME}', 1)) NOT IN ('http', 'https') THEN 'scheme' WHEN h_ = '' THEN 'host' WHEN {local} THEN 'local' WHEN {v4('h_')} OR {v6} THEN 'address' ELSE 'ok' END"
    return f"list_transform({host}, lambda h_: {verdict})[1]"


# Inputs: URLs of every class, by page number.
URLS = [
    "http://127.0.0.1/", "http://10.1.2.3/x", "http://172.20.0.1/", "http://172.32.0.1/", "http://192.168.0.9:80/", "http://169.254.169.254/m", "https://224.0.0.1/", "https://8.8.8.8/", "ftp://a.b/", "http://localhost:1/", "http://x.internal/",
    "http://[::1]/", "http://[::1]:8080/x", "http://[0:0:0:0:0:0:0:1]/", "http://[::]/", "http://[fe80::1]/", "http://[febf::1]/", "http://[fec0::1]/", "http://[fd00::1]/", "http://[fc12:3::4]/", "http://[ff02::1]/", "http://[::ffff:127.0.0.1]/",
    "http://[::ffff:8.8.8.8]/", "http://[::ffff:a00:1]/", "http://[::ffff:808:808]/", "http://[2001:db8::1]/", "https://[2606:4700::1111]:443/", "http://u:p@10.0.0.1/", "http://u@[::1]/", "http://printer.local./", "HTTP://LOCALHOST/", "http:///x", "mailto:a@b", "https://ok.example/",
]
_LIST = ", ".join(f"'{u}'" for u in URLS)


@query(f"WITH u AS (SELECT page_id, url AS own, [{_LIST}][page_id % {len(URLS)} + 1] AS url FROM pages) SELECT page_id, url, {policy_sql('url')} AS reason, {policy_sql('own')} AS own FROM u")
def w21_url_policy(spark, sf_dir):
    """URLs of every blocked class (W21, W22), and the pages' own."""
    url = F.element_at(F.array(*map(F.lit, URLS)), (F.col("page_id") % len(URLS) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.col("url").alias("own"))
    return rows.select("page_id", "url", url_policy(F.col("url")).alias("reason"), url_policy(F.col("own")).alias("own"))


def redirects(hops: Column, most: int) -> Column:
    """ok, ``limit`` with more than ``most`` hops, or the first refused hop as ``number:reason``."""
    reasons = F.transform(hops, lambda u, i: F.struct((i + 1).alias("n"), url_policy(u).alias("r")))
    bad = F.try_element_at(F.filter(F.slice(reasons, 1, most), lambda v: v["r"] != "ok"), F.lit(1))
    return F.when(bad.isNotNull(), F.concat_ws(":", bad["n"].cast("string"), bad["r"])).when(F.size(hops) > most, "limit").otherwise("ok")


_MOST_HOPS = 5


@query(
    f"WITH c AS (SELECT page_id, unnest(range(1, CAST(page_id % 8 AS BIGINT) + 1)) AS n FROM pages), h AS (SELECT page_id, n, CASE WHEN n = 1 + page_id % 3 AND page_id % 2 = 0 THEN [{_LIST}][page_id % {len(URLS)} + 1] ELSE 'https://h' || n || '.example/' END AS url FROM c), "
    f"v AS (SELECT page_id, n, {policy_sql('url')} AS reason FROM h), b AS (SELECT page_id, count(*) AS hops, min(n) FILTER (reason <> 'ok' AND n <= {_MOST_HOPS}) AS bad, arg_min(reason, n) FILTER (reason <> 'ok' AND n <= {_MOST_HOPS}) AS why FROM v GROUP BY page_id) "
    f"SELECT page_id, CASE WHEN bad IS NOT NULL THEN bad || ':' || why WHEN hops > {_MOST_HOPS} THEN 'limit' ELSE 'ok' END AS verdict FROM pages LEFT JOIN b USING (page_id)"
)
def w23_redirects(spark, sf_dir):
    """Chains of ``page_id mod 8`` redirects; one hop of every other chain is a URL of some class."""
    page = F.col("page_id")
    odd = F.element_at(F.array(*map(F.lit, URLS)), (page % len(URLS) + 1).cast("int"))
    chain = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when((i == 1 + page % 3) & (page % 2 == 0), odd).otherwise(F.concat(F.lit("https://h"), i.cast("string"), F.lit(".example/"))))
    return table(spark, sf_dir, "pages").select("page_id", redirects(F.slice(chain, F.lit(1), (page % 8).cast("int")), _MOST_HOPS).alias("verdict"))
