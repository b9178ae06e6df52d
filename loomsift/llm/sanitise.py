"""Information-theoretic sanitisation of personal data, in DataFrame functions alone.

Personal data that patterns find are protected entities.  What stands around them is counted over the
whole corpus: a term that is rarely met without an entity gives the entity away even where the entity
itself is taken out.  How much it gives away is its pointwise mutual information with the entity, as a
share of the entity's own information content:

    disclosure(term, entity) = log(n(term, entity) * N / (n(term) * n(entity))) / log(N / n(entity))

where N, n(term), n(entity) and n(term, entity) count distinct texts, so that copies are no evidence.  It is 1
for a term that is met in the entity's texts alone, and 0 for one that is independent of it.  Terms
above ``GENERALISE`` are replaced by what kind of word they are, those above ``REMOVE`` go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, materialize, public_id

KINDS = ["email", "ip", "card", "phone"]
# A match can only begin where a run of its first class begins, or where the match before it ended; loops are
# possessive, so that no text makes the search quadratic or recursive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}{3,}"
#: Terms on either side of an entity that count as its context, and code points in which they are sought.
WINDOW, REACH = 8, 120
#: Distinct texts in which a term must be met with an entity before the two are held to belong together.
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95
#: Terms up to which the candidates are sent to all tasks; more are joined by shuffle.
MOST_SENT = 100_000
#: Matches whose places are added up in one go.
STRIDE = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _running(steps: Column) -> Column:
    """Running sums of an array<int>, in strides: an array that grows by one element is copied each time."""

    def inside(x: Column, base: Column) -> Column:
        grown = F.aggregate(x, F.array(base), lambda sums, v: F.array_append(sums, F.element_at(sums, -1) + v))
        return F.slice(grown, 2, F.size(x))

    def placed(strides: Column) -> Column:
        totals = F.transform(strides, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
        before = F.aggregate(totals, F.array(F.lit(0)), lambda sums, v: F.array_append(sums, F.element_at(sums, -1) + v))
        return _let(before, lambda bases: F.flatten(F.zip_with(strides, F.slice(bases, 1, F.size(strides)), inside)))

    last = F.floor((F.size(steps) - 1) / F.lit(STRIDE)).cast("int")
    return _let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(steps, k * STRIDE + 1, F.lit(STRIDE))), placed)


_PLACE = "array<struct<start:int,end:int,said:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: start, end (code points), said, and up to ``REACH`` code points of the text
    on either side, but for what other matches hold."""

    def between(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), F.slice(F.concat(F.array(F.lit("")), found), 1, F.size(found)), lambda a, b: F.char_length(a) + F.char_length(b))

        def place(x: Column, i: Column, starts: Column) -> Column:
            start = F.get(starts, i)
            side = [F.right(F.get(gaps, i), F.lit(REACH)), F.left(F.get(gaps, i + 1), F.lit(REACH))]
            return F.struct(start.alias("start"), (start + F.char_length(x)).alias("end"), x.alias("said"), side[0].alias("before"), side[1].alias("after"))

        return _let(_let(steps, _running), lambda starts: F.transform(found, lambda x, i: place(x, i, starts)))

    none = F.array().cast(_PLACE)
    each = lambda found: F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), lambda gaps: between(found, gaps))).otherwise(none)
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), each)


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, said: Column) -> Column:
    if kind == "ip":
        return said.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")
    if kind == "card":
        return _let(_digits(said), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(said)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, said: Column) -> Column:
    """What a match names, however it is written."""
    name = {"email": F.lower(said), "ip": F.regexp_replace(said, r"(?<![0-9])0+(?=[0-9])", "")}.get(kind, _digits(said))
    return F.concat(F.lit(f"{kind}:"), name)


def base_spans(text: Column) -> Column:
    """Spans of personal data by kind as in ``KINDS``, then start: kind, entity, start, end, before, after."""
    out = []
    for kind in KINDS:
        none = F.array().cast(_PLACE)
        found = F.when(F.contains(text, F.lit(HINTS[kind])), matches(text, PATTERNS[kind])).otherwise(none)
        kept = F.filter(found, lambda m: valid(kind, m["said"]))  # noqa: B023
        out.append(F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), _entity(kind, m["said"]).alias("entity"), m["start"].alias("start"), m["end"].alias("end"), m["before"].alias("before"), m["after"].alias("after"))))  # noqa: B023
    return F.concat(*out)


def _context(span: Column) -> Column:
    """The terms around a span: entity, term (lower case), start, end.  A word that the reach cuts is none."""

    def of(side: str, base: Column, cut, nearest) -> Column:
        words = F.filter(matches(span[side], TERM), cut)
        near = _let(words, nearest)
        return F.transform(near, lambda w: F.struct(span["entity"].alias("entity"), F.lower(w["said"]).alias("term"), (base + w["start"]).alias("start"), (base + w["end"]).alias("end")))

    full = lambda side: F.char_length(span[side]) == REACH
    before = of("before", span["start"] - F.char_length(span["before"]), lambda w: ~((w["start"] == 0) & full("before")), lambda x: F.slice(x, F.greatest(F.size(x) - WINDOW + 1, F.lit(1)), F.lit(WINDOW)))
    after = of("after", span["end"], lambda w: ~((w["end"] == REACH) & full("after")), lambda x: F.slice(x, 1, WINDOW))
    return F.concat(before, after)


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    """Distinct texts (``_h``, ``_c``) per key."""
    return rows.select(*by, "_h", "_c").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def disclosures(found: DataFrame, texts: DataFrame) -> DataFrame:
    """entity, term, disclosure: what the terms of all contexts give away.

    ``found`` has, per document, hashes of its text, its entities and their contexts; ``texts`` the hashes and the
    text of every document.  Terms seen with an entity in fewer than ``SUPPORT`` texts give nothing away.

    A term is in at least as many texts as have it in a context.  So contexts alone tell of most terms that they
    are too common to give anything away, and only the others are counted in all texts."""
    total = float(max(found.select("_h", "_c").distinct().count(), 1))

    def share(n_term: str) -> Column:
        gain = F.log(F.col("n_both") * F.lit(total) / (F.col(n_term).cast("double") * F.col("n_entity")))
        return gain / F.nullif(F.log(F.lit(total) / F.col("n_entity")), F.lit(0.0))

    entities = _counted(found.select("_h", "_c", F.explode("entities").alias("entity")), "entity").where(F.col("n") >= SUPPORT).withColumnRenamed("n", "n_entity")
    contexts = found.select("_h", "_c", F.explode("contexts").alias("x")).select("_h", "_c", "x.entity", "x.term")
    pairs = _counted(contexts, "entity", "term").where(F.col("n") >= SUPPORT).withColumnRenamed("n", "n_both")
    pairs = pairs.join(entities, "entity").join(_counted(contexts, "term").withColumnRenamed("n", "n_seen"), "term")
    pairs = materialize(pairs.where(share("n_seen") >= GENERALISE - 1e-9), "pairs")
    terms = materialize(pairs.select("term").distinct(), "terms")
    words = texts.select("_h", "_c", F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))).alias("term"))
    held = _counted(words.join(F.broadcast(terms) if terms.count() <= MOST_SENT else terms, "term", "left_semi"), "term").withColumnRenamed("n", "n_term")
    return pairs.join(held, "term").select("entity", "term", share("n_term").alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> (code points, end exclusive) by kind, then start.

    Base kinds are ``KINDS``; the kinds ``generalised`` and ``removed`` are terms that give an entity away which stands
    in the same document, where they stand in its context (``WINDOW`` terms on either side, up to the next match
    of the entity's kind).  A document without personal data has none, so its terms stay.  A null or empty
    text has no spans; a null id stays null; repeated rows stay, and count as one text; an empty table gives
    no rows."""
    base, extra = _found(docs, id_col, text_col)
    return _joined(base, extra).select(public_id(id_col), "spans")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, and two hashes that name a text, 96 bits together."""
    return ids_and_text(docs, id_col, text_col).select("*", F.xxhash64("_text").alias("_h"), F.crc32(F.col("_text").cast("binary")).alias("_c"))


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row (_id, _key, base spans), and the terms to be sanitised: _key, kind, start, end."""
    texts = _hashed(docs, id_col, text_col)
    rows = texts.select("_id", "_h", "_c", base_spans(F.col("_text")).alias("_s"))
    contexts = F.flatten(F.transform("_s", _context))
    spans = F.transform("_s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    base = rows.select("_id", F.monotonically_increasing_id().alias("_key"), "_h", "_c", spans.alias("base"), F.transform("_s", lambda s: s["entity"]).alias("entities"), contexts.alias("contexts"))
    base = materialize(base, "personal")
    found = disclosures(base, texts)
    told = base.select("_key", F.explode("contexts").alias("x")).select("_key", "x.*").join(found, ["entity", "term"])
    # A term that gives several entities away is treated as its most telling one asks for.
    told = told.groupBy("_key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    kind = F.when(F.col("disclosure") >= REMOVE, F.lit("removed")).otherwise(F.lit("generalised"))
    return base, told.select("_key", kind.alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _joined(base: DataFrame, extra: DataFrame) -> DataFrame:
    terms = extra.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("terms"))
    rows = base.join(terms.withColumnRenamed("_key", "_of"), F.col("_key") == F.col("_of"), "left")
    apart = lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    own = F.coalesce(F.filter("terms", apart), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    return rows.select("_id", "_h", "_c", F.concat("base", own).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: personal data as their kind in brackets, generalised terms as ``[name]`` where they begin with a
    capital and ``[word]`` elsewhere, removed terms as nothing.  Spans that overlap become one, named by the first."""
    base, extra = _found(docs, id_col, text_col)
    # Rows that repeat an id may differ in text, so spans go by both; equal rows have equal spans.
    found = _joined(base, extra).dropDuplicates(["_id", "_h", "_c"]).select(F.col("_id").alias("_of"), F.col("_h").alias("_oh"), F.col("_c").alias("_oc"), "spans")
    rows = _hashed(docs, id_col, text_col).join(found, (F.col("_id") == F.col("_of")) & (F.col("_h") == F.col("_oh")) & (F.col("_c") == F.col("_oc")), "left")
    text = F.col("_text")

    def shown(s: Column) -> Column:
        said = F.substring(text, (s["start"] + 1).cast("int"), F.lit(1))
        return F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", F.when(said.rlike(r"\p{Lu}"), "[name]").otherwise("[word]")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        said = F.when(s["start"] >= done["at"], F.concat(done["out"], gap, shown(s))).otherwise(done["out"])
        return F.struct(said.alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    clean = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda d: F.concat(d["out"], F.substr(text, (d["at"] + 1).cast("int"), F.char_length(text))))
    return rows.select(public_id(id_col), F.coalesce(clean, text).alias(text_col))


def joined(spans: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:end``, comma-joined, of all spans or of some kinds, in their order."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: DuckDB SQL for the rows of the registered query; patterns and thresholds are written out, not taken from above.
SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT r, ko, kind, regexp_extract_all(text, p) AS ms, regexp_split_to_array(text, p) AS gs FROM d, (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, 'card', '[0-9]([ -]?[0-9])+'), (3, 'phone', '\+[0-9][ ().0-9-]+[0-9]')) AS pats(ko, kind, p)),
e AS (SELECT r, ko, kind, unnest(ms) AS said, unnest(gs) AS gap, unnest(range(1, len(gs) + 1)) AS i FROM f WHERE len(ms) > 0),
s AS (SELECT *, lead(gap) OVER w AS nxt, sum(len(gap)) OVER w + coalesce(sum(len(said)) OVER (PARTITION BY r, ko ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e WINDOW w AS (PARTITION BY r, ko ORDER BY i)),
v AS (SELECT r, ko, kind, said, CAST(place AS BIGINT) AS a, CAST(place AS BIGINT) + len(said) AS b, right(gap, 120) AS bef, left(nxt, 120) AS aft, regexp_replace(said, '[^0-9]', '', 'g') AS dg, list_transform(string_split(said, '.'), lambda o: CASE WHEN ltrim(o, '0') = '' THEN '0' ELSE ltrim(o, '0') END) AS octets FROM s WHERE said IS NOT NULL),
x AS MATERIALIZED (SELECT row_number() OVER () AS sid, *, kind || ':' || CASE kind WHEN 'email' THEN lower(said) WHEN 'ip' THEN array_to_string(octets, '.') ELSE dg END AS entity FROM v WHERE CASE kind
  WHEN 'ip' THEN len(list_filter(octets, lambda o: len(o) > 3 OR coalesce(TRY_CAST(o AS BIGINT), 256) > 255)) = 0 WHEN 'phone' THEN len(dg) BETWEEN 9 AND 15
  WHEN 'card' THEN len(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(len(dg)), lambda j: (1 + j % 2) * CAST(substr(dg, len(dg) - j, 1) AS INTEGER) - CASE WHEN j % 2 = 1 AND substr(dg, len(dg) - j, 1) > '4' THEN 9 ELSE 0 END)) % 10 = 0 ELSE true END),
z AS (SELECT sid, r, entity, 0 AS side, bef AS t, a - len(bef) AS base FROM x UNION ALL SELECT sid, r, entity, 1, aft, b FROM x),
w1 AS (SELECT sid, r, entity, side, base, len(t) AS tl, unnest(regexp_extract_all(t, '\p{L}{3,}')) AS said, unnest(regexp_split_to_array(t, '\p{L}{3,}')) AS gap, unnest(range(1, len(regexp_split_to_array(t, '\p{L}{3,}')) + 1)) AS i FROM z),
w2 AS (SELECT *, CAST(sum(len(gap)) OVER (PARTITION BY sid, side ORDER BY i) + coalesce(sum(len(said)) OVER (PARTITION BY sid, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p FROM w1),
w3 AS (SELECT *, row_number() OVER (PARTITION BY sid, side ORDER BY CASE WHEN side = 0 THEN -i ELSE i END) AS k FROM w2 WHERE said IS NOT NULL AND NOT (tl = 120 AND CASE WHEN side = 0 THEN p = 0 ELSE p + len(said) = 120 END)),
c AS MATERIALIZED (SELECT r, entity, lower(said) AS term, base + p AS a, base + p + len(said) AS b FROM w3 WHERE k <= 8),
n AS (SELECT count(DISTINCT text) AS total FROM d),
ne AS (SELECT entity, count(DISTINCT text) AS n_entity FROM x JOIN d USING (r) GROUP BY entity),
nb AS MATERIALIZED (SELECT entity, term, count(DISTINCT text) AS n_both FROM c JOIN d USING (r) GROUP BY ALL HAVING count(DISTINCT text) >= 3),
nt AS (SELECT term, count(*) AS n_term FROM (SELECT DISTINCT text, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS term FROM d) WHERE term IN (SELECT term FROM nb) GROUP BY term),
g AS (SELECT entity, term, ln(n_both * total::DOUBLE / (n_term * n_entity)) / nullif(ln(total::DOUBLE / n_entity), 0) AS share FROM nb JOIN ne USING (entity) JOIN nt USING (term), n),
h AS (SELECT r, c.a, c.b, max(share) AS share FROM c JOIN g USING (entity, term) WHERE share >= 0.85 GROUP BY ALL),
o AS (SELECT r, CASE WHEN share >= 0.95 THEN 'removed' ELSE 'generalised' END AS kind, a, b FROM h WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.r = h.r AND x.a < h.b AND h.a < x.b)),
u AS (SELECT r, ko, kind, a, b FROM x UNION ALL SELECT r, 4, kind, a, b FROM o)
SELECT doc_id, count(*) FILTER (ko = 0) AS n_email, count(*) FILTER (ko = 1) AS n_ip, count(*) FILTER (ko = 2) AS n_card, count(*) FILTER (ko = 3) AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ko, a) FILTER (ko < 4), '')) AS base_sha256, coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ko, kind, a, b), '') AS spans
FROM d LEFT JOIN u USING (r) GROUP BY r, doc_id
"""
