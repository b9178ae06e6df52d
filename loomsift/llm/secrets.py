"""Secret scans with a trigram inverted index.

A Boolean trigram query is derived from each rule's regular expression.  Every block of documents
gets an inverted index from trigram to documents; a rule's query intersects and unites postings, and
only the documents that remain are verified by the expression itself.  Rules without a mandatory
trigram scan every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, public_id, tidy
from .kernels import chunks


@dataclass(frozen=True)
class Rule:
    """``least``: (group, characters) that a match must have; matches that fail are dropped."""

    kind: str
    pattern: str
    least: tuple[int, int] = (0, 0)


# Kinds and patterns, in the order in which equal starts are listed.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 6)),
    Rule("access", r"AKIA[A-Z0-9]+", (0, 20)),
    Rule("hex", r"[0-9a-f]{24,}", (0, 24)),
]
#: A private key goes from its header to its END line; without one, to the end of its base64 lines (line
#: breaks may be written as \\n).  A short last line counts only if it stands alone or is padded.
_BREAK = r"(?:\s|\\[rn])+"
_KEY_BODY = (
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n\\]*)*(?:{_BREAK}[A-Za-z0-9+/=]{{16,}})+"
    rf"(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}=|\r?\n[A-Za-z0-9+/]{{1,15}}(?=\r?\n|\Z))?=?)?"
)
MORE_RULES = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----" + _KEY_BODY),
    Rule("code_host", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\x00-\x20/@:]{1,100}:[^\x00-\x20/@:]{1,100}@"),
]
RULES = BASE_RULES + MORE_RULES

ANY = ("and", ())


def _and(*parts):
    flat = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,))}
    return next(iter(flat)) if len(flat) == 1 else ("and", tuple(sorted(flat, key=str)))


def _or(*parts):
    return ANY if ANY in parts or not parts else next(iter(set(parts))) if len(set(parts)) == 1 else ("or", tuple(sorted(set(parts), key=str)))


def _trigrams(text: str):
    """All trigrams of a text, as a query on UTF-8 bytes."""
    raw = text.encode()
    return _and(*(raw[i : i + 3] for i in range(len(raw) - 2))) if len(raw) > 2 else ANY


@dataclass
class _Part:
    """What every match of a sub-expression fulfils: it is one of ``exact`` (if known), starts with
    one of ``prefix``, ends with one of ``suffix``, and contains what ``match`` says."""

    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    match: object = ANY

    def opened(self) -> _Part:
        """The same without ``exact``."""
        if self.exact is None:
            return self
        match = _and(self.match, _or(*(_trigrams(s) for s in self.exact))) if self.exact else self.match
        return _Part(None, frozenset(s[:3] for s in self.exact), frozenset(s[-3:] for s in self.exact), match)


_NOTHING = _Part(frozenset([""]), frozenset([""]), frozenset([""]))
_UNKNOWN = _Part(None, frozenset([""]), frozenset([""]))
_MOST = 64  # strings of a set; larger ones are given up


def _exact(strings) -> _Part:
    s = frozenset(strings)
    return _Part(s, s, s) if 0 < len(s) <= _MOST else _UNKNOWN


def _concat(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= _MOST:
        return _exact(a + b for a, b in product(x.exact, y.exact))
    across = [a + b for a, b in product(x.suffix, y.prefix)] if len(x.suffix) * len(y.prefix) <= _MOST else [""]
    prefix = frozenset(a + b for a, b in product(x.exact, y.prefix)) if x.exact is not None and len(x.exact) * len(y.prefix) <= _MOST else x.opened().prefix
    suffix = frozenset(a + b for a, b in product(x.suffix, y.exact)) if y.exact is not None and len(x.suffix) * len(y.exact) <= _MOST else y.opened().suffix
    x, y = x.opened(), y.opened()
    short = lambda s, cut: frozenset(cut(t) for t in s)
    return _Part(None, short(prefix, lambda t: t[:3]), short(suffix, lambda t: t[-3:]), _and(x.match, y.match, _or(*(_trigrams(s) for s in across))))


def _either(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= _MOST:
        return _exact(x.exact | y.exact)
    x, y = x.opened(), y.opened()
    join = lambda a, b: a | b if len(a | b) <= _MOST else frozenset([""])
    return _Part(None, join(x.prefix, y.prefix), join(x.suffix, y.suffix), _or(x.match, y.match))


def _read(tree) -> _Part:
    """Of a parsed expression; texts are taken in lower case (ASCII)."""
    out = _NOTHING
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            part = _exact([_fold(chr(arg))])
        elif name == "IN":
            codes: set | None = set()
            for kind, value in arg:
                if str(kind) == "LITERAL" and codes is not None:
                    codes.add(value)
                elif str(kind) == "RANGE" and codes is not None and value[1] - value[0] < _MOST:
                    codes |= set(range(value[0], value[1] + 1))
                else:
                    codes = None
            part = _exact({_fold(chr(c)) for c in codes}) if codes and len(codes) <= 16 else _UNKNOWN
        elif name == "SUBPATTERN":
            part = _read(arg[3])
        elif name == "BRANCH":
            parts = [_read(b) for b in arg[1]]
            part = parts[0]
            for p in parts[1:]:
                part = _either(part, p)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, own = arg[0], arg[1], _read(arg[2])
            part = _NOTHING
            for _ in range(min(low, 3)):
                part = _concat(part, own)
            if high != low or low > 3:
                part = _either(_NOTHING, own) if (low, high) == (0, 1) else _concat(part, _UNKNOWN)
        elif name in ("AT", "ASSERT_NOT"):
            part = _NOTHING
        else:
            part = _UNKNOWN
        out = _concat(out, part)
    return out


def _fold(text: str) -> str:
    return text.lower() if text.isascii() else text


def trigram_query(pattern: str):
    """The Boolean query that every match of ``pattern`` fulfils in lower-cased UTF-8: a trigram
    (bytes), or ``("and" | "or", parts)``.  ``ANY`` if no trigram is mandatory."""
    return _read(re._parser.parse(pattern, re.A)).opened().match


def _leaves(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else {x for q in query[1] for x in _leaves(q)}


class Scanner:
    """Rules with their queries and the trigrams that the index needs."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.A) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.slots = {t: i + 1 for i, t in enumerate(sorted({x for q in self.queries for x in _leaves(q)}))}
        self.slot_of = None

    def index(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Postings of a block: [trigram's slot, document] is true where it occurs."""
        if self.slot_of is None:
            self.slot_of = np.zeros(1 << 24, np.uint8 if len(self.slots) < 256 else np.uint16)
            for t, i in self.slots.items():
                self.slot_of[t[0] << 16 | t[1] << 8 | t[2]] = i
        postings = np.zeros((len(self.slots) + 1, len(offsets) - 1), bool)
        if len(data) > 2:
            x = (data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)).astype(np.uint32)
            slot = self.slot_of[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
            at = np.flatnonzero(slot)
            doc = np.searchsorted(offsets, at, side="right") - 1
            inside = at + 2 < offsets[doc + 1]
            postings[slot[at[inside]], doc[inside]] = True
        return postings

    def evaluate(self, query, postings: np.ndarray) -> np.ndarray:
        if isinstance(query, bytes):
            return postings[self.slots[query]]
        out = np.full(postings.shape[1], query[0] == "and")
        for q in query[1]:
            out = out & self.evaluate(q, postings) if query[0] == "and" else out | self.evaluate(q, postings)
        return out

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[list[tuple[str, int, int]]]]]:
        """(first row, spans of each row) by block; offsets count code points."""
        for row, data, offsets in chunks(column):
            postings = self.index(data, offsets)
            raw = data.tobytes()
            texts: dict[int, str] = {}
            found: list[list] = [[] for _ in range(len(offsets) - 1)]
            for order, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries)):
                for i in np.flatnonzero(self.evaluate(query, postings)).tolist():
                    if i not in texts:
                        texts[i] = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                    for m in pattern.finditer(texts[i]):
                        if m.end(rule.least[0]) - m.start(rule.least[0]) >= rule.least[1]:
                            found[i].append((m.start(), order, m.end()))
            yield row, [[(self.rules[o].kind, a, b) for a, o, b in sorted(x)] for x in found]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> (code points, end exclusive), ordered by start
    and then by rule.

    A null or empty text has no spans; a null id stays null, repeated rows stay; an empty table
    gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in x] for _, block in scanner.scan(batch[1]) for x in block]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(spans, kind)], names=["_id", "spans"])

    out = ids_and_text(docs, id_col, text_col).mapInArrow(tidy(scan), "_id long, spans array<struct<kind:string,start:long,end:long>>")
    return out.select(public_id(), "spans")


def redact(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret's span replaced by ``<kind>``; overlapping spans become one.

    All columns stay as they are, but for the text; a null text stays null.
    """
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch[at]
            changed = {}
            for row, block in scanner.scan(texts):
                for i, spans in enumerate(block):
                    if spans:
                        changed[row + i] = _replace(texts[row + i].as_py(), spans)
            if changed:
                all_texts = texts.to_pylist()
                for i, t in changed.items():
                    all_texts[i] = t
                texts = pa.array(all_texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(tidy(clean), docs.schema)


def _replace(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join(out) + text[at:]


def counts_of(spans, kind: str):
    """Column: how many spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans, kinds: list[str] | None = None):
    """Column: ``kind:start:end``, comma-joined, of all spans or of some kinds."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
