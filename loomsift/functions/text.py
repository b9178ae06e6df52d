"""Text kernels as column expressions (JVM side), and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c) -> Column:
    """A-Z alone are folded; accented capitals stay."""
    return F.translate(c, UPPER, LOWER)


def ascii_lower_sql(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


#: A text that this expression finds has a token.
TOKEN = r"[\p{IsAlphabetic}\p{N}_-]"


def tokens(c) -> Column:
    """Runs of letters, digits, ``-`` and ``_`` in ASCII lower case."""
    return F.filter(F.split(ascii_lower(c), r"[^\p{IsAlphabetic}\p{N}_-]+"), lambda t: t != "")


def tokens_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({ascii_lower_sql(x)}, '[^\p{{L}}\p{{N}}_-]+'), lambda t: t <> '')"


def word_count(c) -> Column:
    """White-space separated words once tags are blanked."""
    return F.size(F.filter(F.split(F.regexp_replace(c, r"(?is)<[^>]+>", " "), r"\s+"), lambda w: w != ""))


def word_count_sql(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(regexp_replace({x}, '(?is)<[^>]+>', ' ', 'g'), '\s+'), lambda w: w <> ''))"


# Entities in the order in which they are replaced.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def unescape(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def unescape_sql(x: str) -> str:
    for entity, plain in ENTITIES:
        x = f"replace({x}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return x


def tokens_up(c) -> Column:
    """Token estimate that rounds up: ``(chars + 3) div 4``."""
    return F.floor((F.char_length(c) + 3) / 4).cast("long")


def tokens_down(c) -> Column:
    """Token estimate that rounds down, one at least."""
    return F.greatest(F.floor(F.char_length(c) / 4), F.lit(1)).cast("long")


def trim_to_tokens(c, most: int) -> Column:
    """Four characters a token; a cut text ends with an ellipsis that counts as one character."""
    c = F.col(c) if isinstance(c, str) else c
    if most == 0:
        return F.lit("")
    return F.when(F.char_length(c) <= 4 * most, c).otherwise(F.concat(F.substring(c, 1, 4 * most - 1), F.lit("…")))


def squeeze(c) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cut_bytes(c, most: int) -> Column:
    """At most ``most`` bytes of UTF-8, never half a character."""
    raw = F.substring(F.encode(c, "UTF-8"), 1, most)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+$", ""))


# Secret patterns in the order in which they are applied; with a group, it stays.
SECRETS = [
    r"(?im)(authorization\s*:\s*(?:bearer|token|basic)\s+)[^\s\r\n]+",
    r"(?im)(x-api-key\s*:\s*)[^\s\r\n]+",
    r"(?im)(cookie\s*:\s*)[^\r\n]+",
    r"(?im)(set-cookie\s*:\s*[^=;\r\n]+=)[^;\r\n]+",
    r"(?i)(api[_-]?key\s*[=:]\s*)[A-Za-z0-9._\-]+",
    r"(?i)(password\s*[=:]\s*)\S+",
    r"(?i)(aws_secret_access_key\s*[=:]\s*)[A-Za-z0-9/+=]{16,}",
    r"""\b([A-Z][A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|API_KEY|ACCESS_KEY|PRIVATE_KEY)\s*=\s*)([^\s"']+)""",
    r"(?i)([?&](?:access_token|token|api_key|apikey|password)=)[^&\s]+",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)gh[pousr]_[A-Za-z0-9]{20,}",
    r"(?i)github_pat_[A-Za-z0-9_]+",
    r"(?i)sk-[A-Za-z0-9_-]{16,}",
    r"-----BEGIN (?:RSA|OPENSSH|EC|PGP) PRIVATE KEY-----[\s\S]*?-----END (?:RSA|OPENSSH|EC|PGP) PRIVATE KEY-----",
]
DATABASE_URL = r"(?i)\b((?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqp)://[^/\s:@]+:)[^@/\s]+(@)"


def redact(c: Column) -> Column:
    """Secrets replaced one pattern after the other; passwords of database URLs come first."""
    c = F.regexp_replace(c, DATABASE_URL, "$1<redacted>$2")
    for p in SECRETS:
        c = F.regexp_replace(c, p, "$1<redacted>" if "(" in p.replace("(?", "") else "<redacted>")
    return c


def redact_sql(x: str) -> str:
    quote = lambda p: p.replace("'", "''")
    x = f"regexp_replace({x}, '{quote(DATABASE_URL)}', '\\1<redacted>\\2', 'g')"
    for p in SECRETS:
        keep = "\\1" if "(" in p.replace("(?", "") else ""
        x = f"regexp_replace({x}, '{quote(p)}', '{keep}<redacted>', 'g')"
    return x
