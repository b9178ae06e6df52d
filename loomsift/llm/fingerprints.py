"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A k-mer here is ``K`` consecutive words and an s-mer ``S`` of them.  A k-mer is an anchor if the
smallest hash among its s-mers is the first's or the last's: whether it is chosen depends on its own
words only, never on what stands around it.  The fingerprint has every anchor, with the word position
where it first stands, and two are compared by anchors that lie at matching positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, materialize, public_id

K, S = 6, 2
#: Ids per window of the next-document join: with distinct ids, at most so many rows meet in one.
BUCKET = 1024
#: Buckets per stretch, of which one window orders the first ones: a row for every four million ids.
STRETCH = 4096
#: Rows up to which the bucket borders are sent to all tasks; beyond, they are joined by shuffle.
MOST_SENT = 100_000
_POS = 24  # bits of a position; a hash has 38 above them


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _mark(value: Column, at: Column) -> Column:
    """An anchor as a number: 38 bits of its hash, then its position."""
    return F.shiftleft(F.shiftrightunsigned(value, 64 - 38), _POS).bitwiseOR(F.least(at, F.lit((1 << _POS) - 1)).cast("long"))


def _hash(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, _POS)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND((1 << _POS) - 1)


def anchors(text: Column) -> Column:
    """array<bigint> of a text: hash and first position of each anchor (``_mark``), by hash.

    A text without anchors (fewer than ``K`` words, or none chosen) has its whole text as one, the
    empty text too.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def chosen(s: Column) -> Column:
        """s: hashes of all s-mers; one more than there are k-mers times their s-mers."""
        pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(a, b))

        def pick(fours: Column) -> Column:
            # fours[i] is the least of s[i..i+3]
            at_edge = lambda x, i: (x <= fours[i + 1]) | (s[i + 4] <= fours[i])
            mark = lambda x, i: _mark(F.xxhash64(x, s[i + 2], s[i + 4]), i)
            every = F.transform(F.slice(s, 1, F.size(s) - 4), lambda x, i: F.when(at_edge(x, i), mark(x, i)))
            return F.filter(every, lambda x: x.isNotNull())

        return _let(F.zip_with(pairs, F.slice(pairs, 3, F.greatest(F.size(pairs), F.lit(1))), lambda a, b: F.least(a, b)), pick)

    def smers(h: Column) -> Column:
        every = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(h) >= K, _let(every, chosen)).otherwise(F.array().cast("array<bigint>"))

    def firsts(found: Column) -> Column:
        once = F.filter(found, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(found, i - 1))))
        return F.when(F.size(found) > 0, once).otherwise(F.array(_mark(F.xxhash64(text), F.lit(0))))

    return _let(F.sort_array(_let(hashes, smers)), firsts)


def as_text(found: Column) -> Column:
    """``hash@position`` of each anchor, in the order of hashes."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.lower(F.hex(_hash(x))), F.lit("@"), _place(x).cast("string"))), ",")


def shifts(a: Column, b: Column) -> Column:
    """By how many words each common anchor lies later in ``b`` than in ``a``, sorted."""
    both = F.sort_array(F.concat(F.transform(a, lambda x: x * 2), F.transform(b, lambda x: x * 2 + 1)))

    def of(every: Column) -> Column:
        # A hash stands once in each, so common ones are neighbours; the last bit tells whose it is.
        def step(x: Column, i: Column) -> Column:
            before = F.get(every, i - 1)
            apart = _place(F.shiftright(x, 1)) - _place(F.shiftright(before, 1))
            return F.when(_hash(F.shiftright(x, 1)) == _hash(F.shiftright(before, 1)), F.when(x.bitwiseAND(1) == 1, apart).otherwise(-apart))

        return F.sort_array(F.filter(F.transform(every, step), lambda x: x.isNotNull()))

    return _let(both, of)


def likeness(by: Column, a: Column, b: Column) -> Column:
    """Share of the anchors of both that match in position: those in ``by``, the shifts of ``a`` and ``b``,
    that lie in place or are moved by as much as another one."""
    fellow = F.filter(by, lambda x, i: (x == 0) | (x == F.get(by, i - 1)) | (x == F.get(by, i + 1)))
    return _let(F.size(fellow), lambda n: n / (F.size(a) + F.size(b) - n)).cast("double")


def shift(by: Column) -> Column:
    """The most common of sorted shifts (ties: the smallest); null if there are none."""
    begins = F.filter(F.transform(by, lambda x, i: F.when((i == 0) | (x != F.get(by, i - 1)), F.struct(i.alias("i"), x.alias("x")))), lambda r: r.isNotNull())
    counted = lambda all_: F.transform(all_, lambda r, k: F.struct((r["i"] - F.coalesce(F.get(all_, k + 1)["i"], F.size(by))).alias("n"), r["x"].alias("x")))
    return _let(begins, lambda all_: F.array_min(counted(all_))["x"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, anchors, fingerprint of every row; null text as empty, null id stays null."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select("_id", anchors(F.col("_text")).alias("anchors")).select(public_id(), "anchors", as_text(F.col("anchors")).alias("fingerprint"))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document.

    The edit puts the first ``floor(n_chars / 3)`` code points of the next document (by descending
    id; after the last the first) in place of as many last ones.  Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shift_edited.  A null
    text counts as empty; a null id comes last and stays null; rows that repeat an id follow one
    another by the hash of their texts; a single row is its own next; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # Rows without an id come last, in buckets of their own by the hash of their texts.
    tie = F.xxhash64("_text")
    spread = F.lit(-(1 << 62)) + F.shiftright(tie, 44)
    rows = rows.withColumn("_bucket", F.when(F.col("_id") == NULL_ID, spread).otherwise(F.floor(F.col("_id") / F.lit(BUCKET)))).withColumn("_tie", tie)
    # The document after a bucket's last one is the first of the next bucket that has any: the next one of its stretch
    # of buckets or, after the stretch's last, the first of the next stretch.
    tops = rows.groupBy("_bucket").agg(F.max(F.struct("_id", "_tie")).alias("top")).withColumn("_stretch", F.floor(F.col("_bucket") / F.lit(STRETCH)))
    stretches = tops.groupBy("_stretch").agg(F.max_by("top", "_bucket").alias("head"))
    order = Window.orderBy(F.desc("_stretch"))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stretches = stretches.select(F.col("_stretch").alias("_s"), F.coalesce(F.lead("head").over(order), F.first("head").over(every)).alias("after"))
    inside = Window.partitionBy("_stretch").orderBy(F.desc("_bucket"))
    tops = tops.withColumn("n", F.lead("top").over(inside))
    borders = tops.join(stretches, F.col("_stretch") == F.col("_s")).select(F.col("_bucket").alias("_of"), F.coalesce("n", "after").alias("n"))
    borders = materialize(borders.select("_of", F.col("n._id").alias("_nid"), F.col("n._tie").alias("_ntie")), "borders")
    if borders.count() <= MOST_SENT:
        borders = F.broadcast(borders)
    found = rows.join(borders, (rows["_id"] == borders["_nid"]) & (rows["_tie"] == borders["_ntie"])).select(F.col("_of").alias("_bucket"), "_id", "_tie", "_text", F.lit(True).alias("_border"))
    both = rows.select("_bucket", "_id", "_tie", "_text", F.lit(False).alias("_border")).unionByName(found)
    down = Window.partitionBy("_bucket").orderBy("_border", F.desc("_id"), F.desc("_tie"))
    both = both.withColumn("_next", F.lead("_text").over(down)).where(~F.col("_border"))
    n = F.char_length("_text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut))
    # Texts travel, anchors don't: they take more room and are made again of the next text.
    out = both.select("_id", n.cast("long").alias("n_chars"), "_text", "_next", edited.alias("_edited"))
    out = out.select("_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), anchors(F.col("_text")).alias("_own"), anchors(F.col("_next")).alias("_after"), anchors(F.col("_edited")).alias("_new"))
    out = out.select("*", shifts(F.col("_own"), F.col("_new")).alias("_by"), shifts(F.col("_own"), F.col("_after")).alias("_to"))
    return out.select(
        public_id(),
        "n_chars",
        "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_by"), F.col("_own"), F.col("_new")).alias("near_edited"),
        likeness(F.col("_to"), F.col("_own"), F.col("_after")).alias("near_next"),
        shift(F.col("_by")).alias("shift_edited"),
    )
