"""Substring dedup by relative Lempel-Ziv parsing over sharded reference blocks.

The text that documents can be factored against is sharded by content.  Every window of ``WINDOW``
words has an anchor, the least hash among its ``ANCHOR``-word runs, which depends on the window's
words alone; so equal windows have equal anchors and meet in the same reference block (the hash
partition of the anchor).  Only stretches of text whose anchor occurs more than once travel.  A block
indexes the words of its stretches in the order of documents and parses each stretch greedily: a factor
is the longest run of words, ``WINDOW`` at least, that also starts at an earlier place of the block, and is
compared with that reference word by word.  Where a factor ends, the next window is looked up anew, so
windows across a factor's or a stretch's border are checked too.

A row's place is its id and the hash of its text (``_text_key``), so texts under one id, or under none, keep
their own words; their order is that of the hashes.  ``_place`` is a hash of both by which rows are dealt.

Each task parses its own rows as a block first, so a passage that a third of all documents share arrives
at its block once per task, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, partitions, public_id, tidy
from .kernels import Words, mix64, ngrams, pair64, ranges, runs, same_spans, words

WINDOW, ANCHOR = 20, 6
#: Windows that share an anchor's place, at most: longer stretches are cut for parsing.
PART = WINDOW - ANCHOR + 1
#: Columns that say which rows are one document.
PLACE = ["_id", "_text_key"]
#: Anchors that a task gathers before it combines and hands on what it has.
FLUSH = 6_000_000
#: Bytes of text that are indexed at once.
FLUSH_BYTES = 20 << 20


def _windows(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk with the words' hashes: the windows' first words, their anchors' hashes and first words."""
    grams, at = ngrams(h, w.first, ANCHOR)
    count = np.maximum(np.diff(w.first) - WINDOW + 1, 0)
    begin = ranges(w.first[:-1], count)
    if not len(begin):
        return begin, grams[:0], begin
    best, value, width = np.arange(len(grams)), grams, 1
    span = WINDOW - ANCHOR + 1
    while width < span:
        step = min(width, span - width)
        right, other = value[step:], best[step:]
        left = value[: len(right)]
        take = right < left  # of equal hashes the first is the anchor
        value, best = np.where(take, right, left), np.where(take, other, best[: len(right)])
        width += step
    own = best[np.searchsorted(at, begin)]
    return begin, grams[own], at[own]


def _concat(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, _place, pos, known.  known 0: the only one of this task; 1: the first of several; 2: a later
    one, repeated for sure, which needs no partner and is dealt by its own place."""
    names = ["key", "_place", "pos", "known"]
    parts, n = [], 0

    def combine():
        key, places, pos = _concat(parts)
        order = np.argsort(key, kind="stable")
        key, places, pos = (x[order] for x in (key, places, pos))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        several = np.diff(np.append(np.flatnonzero(first), len(key))) > 1
        known = np.full(len(key), 2, np.int8)
        known[first] = several
        spread = mix64(places.view(np.uint64) + pos.astype(np.uint64))
        return _batch(names, _signed(np.where(known == 2, spread, key)), places, pos.astype(np.int32), known)

    for batch in batches:
        places = batch["_place"].to_numpy()
        for w in words(batch["_text"]):
            begin, anchor, at = _windows(w, w.hashes())
            if len(begin):
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                doc = np.searchsorted(w.first, at[new], side="right") - 1
                parts.append((anchor[new], places[w.row0 + doc], at[new] - w.first[doc]))
                n += len(doc)
        if n > FLUSH:
            yield combine()
            parts, n = [], 0
    if n:
        yield combine()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_place, pos of the anchors of one partition that occur more than once."""
    parts = [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
    if parts:
        names = ["_place", "pos"]
        key, places, pos, known = _concat(parts)
        sure = known == 2
        yield _batch(names, places[sure], pos[sure])
        key, places, pos, known = (x[~sure] for x in (key, places, pos, known))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = (count > 1) | (np.bincount(inverse, known, len(count)) > 0)
        again = again[inverse]
        yield _batch(names, places[again], pos[again])


STRETCH = "key long, _id long, _text_key long, start int, size int, body string, ref_id long, ref_start int"
FACTOR = "_id long, _text_key long, start int, size int, ref_id long, ref_start int"


@dataclass
class Block:
    """A reference block: words in ``data`` (which has eight bytes to spare), and stretches of windows with
    one anchor (``key``), of which ``first`` is the first word, ``count`` the number of windows.

    Windows are numbered in the order of documents and places, each place once; ``at`` is a window's first
    word, ``run`` its stretch, ``pos`` its place."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    key: np.ndarray
    ids: np.ndarray
    texts: np.ndarray
    begin: np.ndarray
    by_text: np.ndarray | None = None

    def __post_init__(self) -> None:
        order = np.lexsort((self.count, self.begin, self.texts, self.ids))
        # Text that repeats itself has long stretches; they are parsed in parts.
        parts = -(-self.count[order] // PART)
        order, part = np.repeat(order, parts), ranges(np.zeros_like(parts), parts)
        for name in ("first", "count", "key", "ids", "texts", "begin"):
            setattr(self, name, getattr(self, name)[order])
        self.first, self.begin, self.count = self.first + part * PART, self.begin + part * PART, np.minimum(self.count - part * PART, PART)
        self.run = np.repeat(np.arange(len(order)), self.count)
        self.at, self.pos = ranges(self.first, self.count), ranges(self.begin, self.count)
        meets = (self.ids[1:] == self.ids[:-1]) & (self.texts[1:] == self.texts[:-1]) & (self.begin[1:] < self.begin[:-1] + self.count[:-1])
        if meets.any():  # a row that repeats an id and its text has the same places as the other: neither is earlier
            ids, texts = self.ids[self.run], self.texts[self.run]
            order = np.lexsort((self.pos, texts, ids))
            ids, texts, pos = ids[order], texts[order], self.pos[order]
            keep = np.ones(len(order), bool)
            keep[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]) | (pos[1:] != pos[:-1])
            order = order[keep]
            self.run, self.at, self.pos = self.run[order], self.at[order], self.pos[order]
        # The index: windows of equal hashes, the earliest first.
        name = runs(self.hashes, WINDOW)[self.at] if len(self.at) else self.hashes[:0]
        self.order = np.argsort(name, kind="stable")
        name = name[self.order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        self.group_at = np.flatnonzero(new)
        self.group_size = np.diff(np.append(self.group_at, len(name)))
        self.group = np.empty(len(name), np.int64)
        self.group[self.order] = np.cumsum(new) - 1

    def cuts(self) -> np.ndarray:
        """Where a window does not go on from the one before it."""
        out = np.ones(len(self.at), bool)
        out[1:] = (self.run[1:] != self.run[:-1]) | (self.pos[1:] != self.pos[:-1] + 1)
        return out

    def _left(self, windows: np.ndarray) -> np.ndarray:
        """Words of the stretch after a window."""
        run = self.run[windows]
        return self.first[run] + self.count[run] - 1 - self.at[windows]

    def _members(self, windows: np.ndarray) -> np.ndarray:
        """All windows with the same words as one of ``windows``."""
        groups = np.unique(self.group[windows])
        return np.sort(self.order[ranges(self.group_at[groups], self.group_size[groups])])

    def longest(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the longest earlier match of each window (0: none), and the window where the earliest
        such match begins."""
        length, ref = np.zeros(len(self.at), np.int64), np.full(len(self.at), -1)
        late = windows[self.order[self.group_at[self.group[windows]]] != windows]
        # Matches up to the end of a stretch can't be longer.
        rows = self._members(late)
        rest = self._left(rows)
        name, own, k = self.group[rows].astype(np.uint64), np.arange(len(rows)), 0
        while len(own := own[rest[own] > k]):
            name[own] = pair64(name[own], self.hashes[self.at[rows[own]] + WINDOW + k])
            k += 1
        lead, _ = _leaders(rows, mix64(name + rest.astype(np.uint64)))
        hit = lead != rows
        length[rows[hit]], ref[rows[hit]] = WINDOW + rest[hit], lead[hit]
        whole = length > 0
        # Others grow a word at a time, among all windows that begin alike.
        rows, n = self._members(late[~whole[late]]), WINDOW
        name = self.group[rows].astype(np.uint64)
        while len(rows):
            lead, several = _leaders(rows, name)
            hit = (lead != rows) & ~whole[rows]
            length[rows[hit]], ref[rows[hit]] = n, lead[hit]
            keep = several & (self._left(rows) > n - WINDOW)
            rows = rows[keep]
            name = pair64(name[keep], self.hashes[self.at[rows] + n])
            n += 1
        return length[windows], ref[windows]

    def exact(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``longest``, by the words themselves and for ``WINDOW`` words: where hashes of different words met."""
        if self.by_text is None:
            raw, seen = self.data.tobytes(), {}
            words_ = [raw[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist())]
            self.by_text = np.array([seen.setdefault(tuple(words_[a : a + WINDOW]), i) for i, a in enumerate(self.at.tolist())], np.int64)
        ref = self.by_text[windows]
        return np.where(ref != windows, WINDOW, 0), ref

    def parse(self, match) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy factors: first windows, references, words.  A cursor per stretch takes the longest match; the
        next window that lies not wholly inside a factor is looked up anew, so the windows across a
        factor's end are checked too."""
        cursor = np.flatnonzero(self.cuts())
        end = np.append(cursor[1:], len(self.at))
        at, refs, sizes = [], [], []
        while len(cursor):
            size, ref = match(cursor)
            hit = size > 0
            at, refs, sizes = [*at, cursor[hit]], [*refs, ref[hit]], [*sizes, size[hit]]
            cursor = cursor + np.where(hit, size - WINDOW + 1, 1)
            cursor, end = cursor[cursor < end], end[cursor < end]
        if not at:
            return tuple(np.zeros((3, 0), np.int64))
        order = np.argsort(at := np.concatenate(at))
        return at[order], np.concatenate(refs)[order], np.concatenate(sizes)[order]

    def same(self, at: np.ndarray, ref: np.ndarray, size: np.ndarray) -> bool:
        """Whether all factors and their references are the same words: as bytes, or else word by word."""
        one, two = self.at[at], self.at[ref]
        a, b = self.start[one], self.start[two]
        n, m = self.start[one + size - 1] + self.size[one + size - 1] - a, self.start[two + size - 1] + self.size[two + size - 1] - b
        left = np.flatnonzero(n != m)
        alike = np.flatnonzero(n == m)
        left = np.concatenate((left, alike[~same_spans(self.data, a[alike], self.data, b[alike], n[alike], 4096)]))
        one, two = ranges(one[left], size[left]), ranges(two[left], size[left])
        return bool((self.size[one] == self.size[two]).all() and same_spans(self.data, self.start[one], self.data, self.start[two], self.size[one]).all())

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First windows, references and numbers of windows of the block's factors."""
        found = self.parse(self.longest)
        if not self.same(*found):
            found = self.parse(self.exact)
        return found[0], found[1], found[2] - WINDOW + 1

    def rows(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns of ``FACTOR``, where factors that go on together are one, and which windows no factor covers."""
        at, ref, size = self.factors()
        change = np.zeros(len(self.at) + 1, np.int64)
        change[at] += 1
        np.add.at(change, at + size, -1)
        free = np.cumsum(change)[:-1] == 0
        ids, texts, pos = self.ids[self.run[at]], self.texts[self.run[at]], self.pos[at]
        ref_id, ref_text, ref_pos = self.ids[self.run[ref]], self.texts[self.run[ref]], self.pos[ref]
        cut = np.ones(len(at), bool)
        cut[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]) | (pos[1:] != pos[:-1] + size[:-1])
        cut[1:] |= (ref_id[1:] != ref_id[:-1]) | (ref_text[1:] != ref_text[:-1]) | (ref_pos[1:] != ref_pos[:-1] + size[:-1])
        start = np.flatnonzero(cut)
        total = np.add.reduceat(size, start) if len(start) else size
        return [ids[start], texts[start], pos[start].astype(np.int32), total.astype(np.int32), ref_id[start], ref_pos[start].astype(np.int32)], free


def _leaders(rows: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the first with the same name, and whether there are several."""
    order = np.argsort(name, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = name[order[1:]] != name[order[:-1]]
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lead, several = np.empty_like(rows), np.empty(len(rows), bool)
    lead[order] = rows[order[begin]][group]
    several[order] = (np.diff(np.append(begin, len(order))) > 1)[group]
    return lead, several


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with repeated anchors, as stretches with one anchor and consecutive starts.

    A task factors its own rows first.  What no factor covers travels to its block; the factors go along
    (without a ``body``)."""
    names = [x.split()[0] for x in STRETCH.split(", ")]
    parts: list[tuple] = []
    texts_: list[tuple] = []
    size = count = 0

    def combine():
        data = np.concatenate([*(x[0] for x in texts_), np.zeros(8, np.uint8)])
        start, length, h = _concat([x[1:] for x in texts_])
        block = Block(data, start, length, h, *_concat(parts))
        (ids, texts, pos, n, ref_id, ref_pos), free = block.rows()
        yield _batch(names, _signed(mix64((ids ^ texts).astype(np.uint64) + np.uint64(1))), ids, texts, pos, n, pa.nulls(len(ids), pa.string()), ref_id, ref_pos)
        key, own, text = block.key[block.run], block.ids[block.run], block.texts[block.run]
        cut = np.ones(len(free), bool)
        cut[1:] = (block.at[1:] != block.at[:-1] + 1) | (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (text[1:] != text[:-1]) | (free[1:] != free[:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(cut)) - 1
        first, last = first[free[first]], last[free[first]]
        for a in range(0, len(first), 50_000):
            s, e = first[a : a + 50_000], last[a : a + 50_000]
            begin, to, run = start[block.at[s]], block.at[e] + WINDOW - 1, block.run[s]
            wide = start[to] + length[to] - begin
            offsets = np.concatenate(([0], np.cumsum(wide)))
            body = pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[ranges(begin, wide)])])
            none = pa.nulls(len(s), pa.int64())
            yield _batch(names, _signed(block.key[run]), block.ids[run], block.texts[run], block.pos[s].astype(np.int32), (e - s + 1).astype(np.int32), body, none, none.cast(pa.int32()))

    for batch in batches:
        keys, text_keys, marks = batch[0].to_numpy(), batch["_text_key"].to_numpy(), batch["marks"]
        offsets, values = marks.offsets.to_numpy(), marks.flatten().to_numpy()
        offsets = offsets - offsets[0]
        for w in words(batch[1]):
            h = w.hashes()
            begin, anchor, at = _windows(w, h)
            if not len(begin):
                continue
            marked = np.zeros(w.first[-1] + 1, bool)
            rows = slice(w.row0, w.row0 + len(w.first))
            own = values[offsets[rows][0] : offsets[rows][-1]]
            # A mark may be of another row whose place has the same hash: it must lie in this text.
            own, end = np.repeat(w.first[:-1], np.diff(offsets[rows])) + own, np.repeat(w.first[1:], np.diff(offsets[rows]))
            marked[own[own < end]] = True
            keep = marked[at]
            begin, anchor = begin[keep], anchor[keep]
            doc = np.searchsorted(w.first, begin, side="right") - 1
            cut = np.ones(len(begin), bool)
            cut[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1) | (doc[1:] != doc[:-1])
            cut = np.flatnonzero(cut)
            own, doc = begin[cut], doc[cut]
            parts.append((own + count, np.diff(np.append(cut, len(begin))), anchor[cut], keys[w.row0 + doc], text_keys[w.row0 + doc], own - w.first[doc]))
            texts_.append((w.data, w.start + size, w.end - w.start, h))
            size, count = size + len(w.data), count + len(w.start)
            if size > FLUSH_BYTES:
                yield from combine()
                parts, texts_, size, count = [], [], 0, 0
    if texts_:
        yield from combine()


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of one reference block, in windows; those that a task had found pass through."""
    names = [x.split()[0] for x in FACTOR.split(", ")]
    held = []
    for b in batches:
        done = pa.compute.is_null(b["body"])
        old, new = b.filter(done), b.filter(pa.compute.invert(done))
        if old.num_rows:
            yield _batch(names, *(old[c] for c in names))
        if new.num_rows:
            held.append(new)
    if not held:
        return
    every = pa.Table.from_batches(held)
    # Stretches of one anchor stay together; the rest of the block need not be in memory with them.
    parts = -(-every["body"].nbytes // FLUSH_BYTES)
    of = mix64(every["key"].to_numpy().view(np.uint64)) % np.uint64(parts)
    for k in range(parts):
        own = every.take(pa.array(np.flatnonzero(of == k))) if parts > 1 else every
        if not own.num_rows:
            continue
        (w,) = words(own["body"].combine_chunks(), limit=1 << 62)
        block = Block(
            np.append(w.data, np.zeros(8, np.uint8)), w.start, w.end - w.start, w.hashes(), w.first[:-1], own["size"].to_numpy().astype(np.int64),
            own["key"].to_numpy().view(np.uint64), own["_id"].to_numpy(), own["_text_key"].to_numpy(), own["start"].to_numpy().astype(np.int64),
        )
        yield _batch(names, *block.rows()[0])


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (_id, _text, _text_key, _place and more) dealt by place once, and the factors of all documents."""
    n = partitions(rows.sparkSession)
    dealt = rows.repartition(n, "_place")
    anchors = rows.select("_place", "_text").mapInArrow(tidy(_anchor_rows), "key long, _place long, pos int, known byte").repartition(n, "key")
    marks = anchors.mapInArrow(tidy(_repeated), "_place long, pos int").groupBy("_place").agg(F.array_distinct(F.collect_list("pos")).alias("marks"))
    stretches = dealt.join(marks, "_place").select("_id", "_text", "_text_key", "marks").mapInArrow(tidy(_stretches), STRETCH)
    return dealt, stretches.repartition(n, "key").mapInArrow(tidy(_factor), FACTOR)


def _spans(factors: DataFrame) -> DataFrame:
    """_place, spans: of all rows whose places have one hash."""
    return factors.groupBy(F.xxhash64("_id", "_text_key").alias("_place")).agg(F.collect_list(F.struct("start", "size", "_id", "_text_key")).alias("spans"))


def _rows(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_text_key"), *kept)
    return rows.withColumn("_place", F.xxhash64("_id", "_text_key"))


def _whole(factors: DataFrame) -> DataFrame:
    """Factors of one text that go on in the same earlier text, each where the one before ends or within it, as one: what was
    parsed in stretches becomes the longest factors of whole texts."""
    line = ["_id", "_text_key", "ref_id", "_shift"]
    rows = factors.withColumn("_shift", F.col("ref_start") - F.col("start")).withColumn("_end", F.col("start") + F.col("size"))
    in_order = Window.partitionBy(*line).orderBy("start", "size")
    reach = F.max("_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")
    rows = rows.withColumn("_begins", begins).withColumn("_n", F.sum("_begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    glued = rows.groupBy(*line, "_n").agg(F.min("start").alias("start"), F.max("_end").alias("_end"))
    return glued.select("_id", "_text_key", "start", (F.col("_end") - F.col("start")).alias("size"), "ref_id", (F.col("start") + F.col("_shift")).alias("ref_start"))


def duplicate_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_words, ref_id, ref_start: factors of ``WINDOW`` words or more that occur
    earlier (smaller id, or same document and earlier start), in words; one row for as long as a text goes on as the
    same earlier text does."""
    _, factors = _dealt(_rows(docs, id_col, text_col, False))
    return _whole(factors).select(public_id(), "start", (F.col("size") + WINDOW - 1).alias("n_words"), F.when(F.col("ref_id") != NULL_ID, F.col("ref_id")).alias("ref_id"), "ref_start")


def _covered(w: Words, batch: pa.RecordBatch) -> np.ndarray:
    """Which words of a chunk lie in a window of its documents' factors."""
    change = np.zeros(w.first[-1] + 1, np.int64)
    rows = batch.slice(w.row0, len(w.first) - 1)
    own = rows["spans"]
    if own.null_count < len(own):
        valid = pa.compute.fill_null(pa.compute.list_value_length(own), 0).to_numpy(zero_copy_only=False)
        flat = own.flatten()
        mine = np.ones(len(flat), bool)
        for name in PLACE:
            mine &= np.repeat(rows[name].to_numpy(), valid) == flat.field(name).to_numpy()
        start = (np.repeat(w.first[:-1], valid) + flat.field("start").to_numpy())[mine]
        np.add.at(change, start, 1)
        np.add.at(change, start + flat.field("size").to_numpy()[mine] + WINDOW - 1, -1)
    return np.cumsum(change)[:-1] > 0


def kept_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words outside repeated windows, joined by a space.

    A window of ``WINDOW`` words is repeated if its words also start earlier: in a document of
    smaller id, or earlier in the same.  Windows are judged on the input.  A null text has no words;
    a null id counts as smaller than all others and stays null; different texts under one id (or null) are
    different documents, ordered by a hash; rows that repeat an id and its text are judged alike, as one
    place; an empty table gives no rows.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch[1]):
                n = len(w.first) - 1
                gone = _covered(w, batch)
                size = np.where(gone, 0, w.end - w.start + 1)
                source = np.append(w.data, np.uint8(32))
                out = source[ranges(w.start, size)]
                to = np.cumsum(size)
                out[to[~gone] - 1] = 32
                total = np.concatenate(([0], to))[w.first]
                removed = np.concatenate(([0], np.cumsum(gone)))[w.first]
                raw = out.tobytes()
                kept = [raw[a : max(a, b - 1)] for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
                yield _batch(["_id", "n_words", "n_removed", "kept"], batch[0].slice(w.row0, n), np.diff(w.first).astype(np.int64), np.diff(removed).astype(np.int64), pa.array(kept, pa.binary()).cast(pa.string()))

    rows, factors = _dealt(_rows(docs, id_col, text_col, False))
    out = rows.join(_spans(factors), "_place", "left").select("_id", "_text", "_text_key", "spans").mapInArrow(tidy(finish), "_id long, n_words long, n_removed long, kept string")
    return out.select(public_id(), "n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows cut from the texts; each cut word takes the white space after
    it along, all else stays as it was.  A text without repeats, or null, is unchanged."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[1].to_pylist()
            for w in words(batch[1]):
                gone = _covered(w, batch)
                raw = w.data.tobytes()
                doc_end = np.searchsorted(w.first, np.flatnonzero(gone), side="right") - 1
                for i in np.unique(doc_end).tolist():
                    a, b = w.first[i], w.first[i + 1]
                    starts = np.append(w.start[a:b], w.end[b - 1])
                    keep = ~gone[a:b]
                    texts[w.row0 + i] = b"".join(raw[x:y] for x, y, k in zip(starts[:-1].tolist(), starts[1:].tolist(), keep.tolist()) if k).decode("utf-8", "replace").rstrip(" \t\n\v\f\r")
            yield _batch(["_row", "_cut"], batch["_row"], pa.array(texts, pa.string()))

    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).schema["_row"].dataType
    rows, factors = _dealt(_rows(docs, id_col, text_col, True))
    out = rows.join(_spans(factors), "_place", "left").select("_id", "_text", "_text_key", "_row", "spans").mapInArrow(tidy(cut), f"_row {kind.simpleString()}, _cut string")
    return out.select(*[F.when(F.col("_row")[c].isNotNull(), F.col("_cut")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
