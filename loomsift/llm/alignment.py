"""Alignment of two tokenizers: byte-level BPE (A) and sentence pieces (B) of the same texts.

Both tokenizers cut before a space that follows a character other than white space, so a text is the
sequence of its segments between such places and a segment's tokens don't depend on what stands
around it.  Within an Arrow partition each distinct segment is encoded once by both; DuckDB joins the
two tables of token intervals (range join for tokens that overlap, window sums for numbers of groups, as-of
join from tokens to groups).  A partition hands on blocks of documents as numbers of segments, and how often each
pair of ids is linked there.  Spark adds the counts up, and gives each block the totals of its pairs.

A segment whose bytes a tokenizer changes is not trusted: its whole document is encoded as one.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE, Encoder, WordTable, _classes, pieces, vocabulary
from .common import ids_and_text, materialize, public_id, small_batches, tidy
from .kernels import ranges, span_hashes

#: Code points of a block of documents; a longer document is a block of its own.
BLOCK_CHARS = 1 << 20
#: Distinct segments, and their bytes, that a worker keeps: they bound its memory, not the results.
MOST_SEGMENTS, MOST_BYTES = 300_000, 1 << 24
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]

# Segments follow one another, so offsets of a whole block tell them apart: a range join finds the tokens that share a byte,
# those that end together cut the block into groups, which a window numbers, and a token's group is that of the first cut
# at or after its end.
_OVERLAPS = "CREATE TEMP TABLE shared AS SELECT a.seg, b.k AS bk, a.id AS a, b.id AS b, a.e, a.e = b.e AS linked FROM tb b JOIN ta a ON a.s < b.e AND a.e > b.s"
_CUTS = "CREATE TEMP TABLE cuts AS SELECT e, CAST(sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM shared WHERE linked"
_GROUPS = "SELECT t.k, c.g FROM {} t ASOF JOIN cuts c ON t.e <= c.e ORDER BY t.k"
_LINKS = "SELECT seg, a, b FROM shared WHERE linked ORDER BY bk"
_COUNTS = "SELECT seg, count(*) AS n FROM shared GROUP BY seg"


#: Memory of a partition's joins; what needs more goes to disk until the join is done.
DUCK_MEMORY = "192MB"


@contextlib.contextmanager
def _duck():
    """A database of one block's tables, whose memory goes with it: workers also serve tasks of other kinds."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="loomsift-") as folder, duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": folder}) as con:
        yield con


class Aligned:
    """What is known of numbered segments: numbers of tokens, groups, links; their groups as text; their links."""

    def __init__(self) -> None:
        self.numbers = np.zeros((len(NUMBERS), 0), np.int64)
        self.exact = np.zeros(0, bool)
        self.said, self.said_size = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.links, self.n_links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, other: Aligned) -> None:
        self.numbers = np.concatenate((self.numbers, other.numbers), axis=1)
        for name in ("exact", "said", "said_size", "links", "n_links"):
            setattr(self, name, np.concatenate((getattr(self, name), getattr(other, name))))


def _table(ids: np.ndarray, size: np.ndarray, seg: np.ndarray) -> pa.Table:
    end = np.cumsum(size)
    return pa.table({"k": np.arange(len(ids)), "id": ids, "seg": seg, "s": end - size, "e": end})


def align(count: int, a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Aligned:
    """Segments 0 to ``count`` from their tokens' (id, bytes, segment): segments follow one another, and both
    tokenizers' tokens cover the same bytes of each."""
    out = Aligned()
    out.exact = np.ones(count, bool)
    out.numbers = np.zeros((len(NUMBERS), count), np.int64)
    out.said_size, out.n_links = np.zeros(count, np.int64), np.zeros(count, np.int64)
    if not len(a[0]):
        return out
    with _duck() as con:
        con.register("ta", _table(*a))
        con.register("tb", _table(*b))
        con.execute(_OVERLAPS)
        con.execute(_CUTS)
        links, overlaps, of_a, of_b = (con.sql(sql).to_arrow_table() for sql in (_LINKS, _COUNTS, _GROUPS.format("ta"), _GROUPS.format("tb")))
    of = lambda t, c: t.column(c).to_numpy().astype(np.int64)
    seg = of(links, "seg")
    out.links, out.n_links = of(links, "a") << 32 | of(links, "b"), np.bincount(seg, minlength=count)
    # A group's ids of A stand before those of B; each id is followed by what parts it from the next.
    side = np.concatenate((2 * of(of_a, "g"), 2 * of(of_b, "g") + 1))
    by = np.argsort(side, kind="stable")
    ids, home, side = np.concatenate((a[0], b[0]))[by], np.concatenate((a[2], b[2]))[by], side[by]
    mark = np.where(np.append(side[1:] == side[:-1], False), 0, 1 + side % 2)
    said = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), pa.array([",", "|", ";"]).take(pa.array(mark)), "")
    size = pc.binary_length(said).to_numpy()
    out.said = np.frombuffer(said.buffers()[2], np.uint8)[: int(size.sum())]
    out.said_size = np.bincount(home, size, count).astype(np.int64)
    for row, (at, n) in enumerate(((a[2], None), (b[2], None), (home[mark == 2], None), (seg, None), (of(overlaps, "seg"), of(overlaps, "n")))):
        out.numbers[row] = np.bincount(at, n, minlength=count)
    return out


class Segments:
    """The places of the segments of some non-empty texts, each behind a space; ``first`` delimits texts."""

    def __init__(self, texts: list[str]) -> None:
        whole = "".join([" " + t for t in texts])
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        begin = np.zeros(len(points), bool)
        begin[1:] = (points[1:] == 0x20) & (_classes()[points[:-1]] != SPACE)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        begin[starts] = True
        at = np.flatnonzero(begin)
        self.first = np.searchsorted(at, np.append(starts, len(points)))
        raw = whole.encode()
        if len(raw) > len(points):
            wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = (np.cumsum(wide) - wide)[at]
        self.data = np.frombuffer(raw + bytes(8), np.uint8)
        self.byte_start, self.byte_end = at, np.append(at[1:], len(raw))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.byte_start, self.byte_end)


class Aligner:
    """Both tokenizers, and the segments that a worker has met."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        self.a = Encoder(byte_path)
        self.a.tokenizer.encode_special_tokens = True
        self.a.special = []  # their strings are plain text here
        self.a.MOST_WORDS, self.a.MOST_BYTES = MOST_SEGMENTS, MOST_BYTES
        self.a_pieces, self.a_at = pieces(byte_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        spelt = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.b_pieces, self.b_at = np.frombuffer(b"".join(spelt), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in spelt])))
        self.space = self.b.piece_to_id("▁")
        self._clear()

    def _clear(self) -> None:
        self.table, self.known = WordTable(), Aligned()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and numbers of tokens of texts that begin with a space, by A and by B."""
        flat, size = [], np.zeros(len(texts), np.int64)
        for row, ids, offsets in self.a.batches(texts):
            flat.append(ids)
            size[row : row + len(offsets) - 1] = np.diff(offsets)
        # A lone space ends a text, where B writes it as a piece; alone it would be no text for B.
        own = [ids if t != " " else [self.space] for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1))]
        n = np.fromiter((len(x) for x in own), np.int64, len(own))
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), size, np.fromiter((i for x in own for i in x), np.int32, int(n.sum())), n

    def _same(self, ids: np.ndarray, n: np.ndarray, table: np.ndarray, at: np.ndarray, want: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text spell its bytes."""
        text = np.repeat(np.arange(len(n)), n)
        wide = (at[1:] - at[:-1])[ids]
        ok = np.bincount(text, wide, len(n)).astype(np.int64) == size
        good = ok[text]
        spelt = table[ranges(at[ids[good]], wide[good])]
        differs = spelt != want[ranges((np.cumsum(size) - size)[ok], size[ok])]
        ok[np.repeat(np.flatnonzero(ok), size[ok])[differs]] = False
        return ok

    def aligned(self, texts: list[str]) -> Aligned:
        """Each text, which begins with a space, aligned as one; inexact ones have no tokens."""
        ids_a, n_a, ids_b, n_b = self._ids(texts)
        raw = [t.encode() for t in texts]
        want, size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        exact = self._same(ids_a, n_a, self.a_pieces, self.a_at, want, size) & self._same(ids_b, n_b, self.b_pieces, self.b_at, want, size)
        sides = []
        for ids, n, at in ((ids_a, n_a, self.a_at), (ids_b, n_b, self.b_at)):
            seg = np.repeat(np.arange(len(texts)), n)
            kept = exact[seg]
            sides.append((ids[kept], (at[1:] - at[:-1])[ids[kept]], seg[kept]))
        out = align(len(texts), *sides)
        out.exact = exact
        return out

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Aligned]:
        """(segments of all texts, offsets per text, what is known of the segments) of non-empty texts."""
        if self.table.n > MOST_SEGMENTS or self.table.used > MOST_BYTES:
            self._clear()
        found, before = Segments(texts), self.table.n
        number, first = self.table.numbers(found).astype(np.int64), found.first
        if self.table.n > before:
            self.known.extend(self.aligned(self.table.words(before)))
        known = self.known
        wrong = np.flatnonzero(~np.logical_and.reduceat(known.exact[number], first[:-1]))
        if len(wrong):
            known, base = Aligned(), len(self.known.exact)
            known.extend(self.known)
            known.extend(self.aligned([" " + texts[i] for i in wrong.tolist()]))
            parts = np.split(number, first[1:-1])
            for k, i in enumerate(wrong.tolist()):
                parts[i] = np.array([base + k])
            number, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return number, first, known


@functools.cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _packed(values: np.ndarray) -> bytes:
    kind = "<u2" if not len(values) or values.max() < 1 << 16 else "<u4"
    return kind.encode() + zstandard.compress(values.astype(kind).tobytes(), 3)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[3:]), raw[:3].decode()).astype(np.int64)


_BLOCK = "block string, ids array<long>, " + ", ".join(f"{n} array<long>" for n in NUMBERS) + ", sha array<string>, said array<string>, segs binary, firsts binary, seg_links binary, seg_firsts binary, a array<int>, b array<int>, n array<long>"


def _encoded(ids: list[int], texts: list[str], tool: Aligner, keep: bool) -> pa.RecordBatch:
    """One row: documents as numbers of segments, and the block's pairs with their counts."""
    full = [i for i, t in enumerate(texts) if t]
    numbers, sha, said = np.zeros((len(NUMBERS), len(ids)), np.int64), [""] * len(ids), [""] * len(ids)
    first, own, links, seg_first = np.zeros(len(ids) + 1, np.int64), *[np.zeros(0, np.int64)] * 2, np.zeros(1, np.int64)
    pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if full:
        number, starts, known = tool.block([texts[i] for i in full])
        numbers[:, full] = np.add.reduceat(known.numbers[:, number], starts[:-1], axis=1)
        size = known.said_size
        raw = known.said[ranges((np.cumsum(size) - size)[number], size[number])]
        cut = np.concatenate(([0], np.cumsum(size[number])))[starts]
        for k, i in enumerate(full):
            if cut[k + 1] > cut[k]:
                text = raw[cut[k] : cut[k + 1] - 1].tobytes()
                sha[i], said[i] = hashlib.sha256(text).hexdigest(), text.decode() if keep else ""
        # Segments of the block by how often they occur, and their links as numbers of the block's pairs.
        used, own, times = np.unique(number, return_inverse=True, return_counts=True)
        by = np.argsort(-times, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        used, times, own = used[by], times[by], place[own]
        size = known.n_links[used]
        pairs, links = np.unique(known.links[ranges((np.cumsum(known.n_links) - known.n_links)[used], size)], return_inverse=True)
        n = np.bincount(links, np.repeat(times, size), len(pairs)).astype(np.int64)
        seg_first = np.concatenate(([0], np.cumsum(size)))
        sizes = np.zeros(len(ids), np.int64)
        sizes[full] = np.diff(starts)
        first = np.concatenate(([0], np.cumsum(sizes)))
    row = [uuid.uuid4().hex, ids, *numbers, sha, said, _packed(own), _packed(np.diff(first)), _packed(links), _packed(np.diff(seg_first)), (pairs >> 32).astype(np.int32), pairs.astype(np.int32), n]
    kinds = [pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * len(NUMBERS), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def encoded_blocks(docs: DataFrame, byte_path: str, piece_path: str, keep: bool = False) -> DataFrame:
    """Blocks of documents (``_id``, ``_text``), each with its pairs of linked ids and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_path, piece_path)
        for batch in batches:
            ids, texts, at = batch[0].to_pylist(), batch[1].to_pylist(), 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and (to == at or size + len(texts[to]) <= BLOCK_CHARS):
                    size += len(texts[to]) + 1
                    to += 1
                yield _encoded(ids[at:to], texts[at:to], tool, keep)
                at = to

    return docs.mapInArrow(tidy(run), _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, links (of the corpus), top (whether no other A id is linked more often with this B id)."""
    pairs = blocks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    counted = pairs.groupBy("a", "b").agg(F.sum("n").alias("links"))
    return counted.withColumn("top", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of blocks whose pairs have their totals."""
    sums = lambda values, size: np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(size)))])
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row]  # noqa: B023, E731
            total = get("links").values
            links, sizes, own, docs = (_unpacked(get(c).as_py()) for c in ("seg_links", "seg_firsts", "segs", "firsts"))
            by_doc = []
            for values in (total, get("top").values):
                each = np.zeros(0, np.int64) if values is None else values.cast(pa.int64()).to_numpy()
                by_doc.append(sums(sums(each[links], sizes)[own], docs))
            columns = [get("ids").values, *[get(n).values for n in NUMBERS], get("sha").values, get("said").values, pa.array(by_doc[0]), pa.array(by_doc[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", *NUMBERS, "groups_sha256", "groups", "count_sum", "n_best"])


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str | None = None, piece_path: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_overlaps (token pairs that share a byte), n_best,
    count_sum, groups_sha256; with ``keep_groups`` also ``groups``, the ids of every group.

    A null or empty text, and one whose tokens spell other bytes, has no tokens: zeros, and '' as groups and their hash.
    A null id stays null, repeated rows stay and count each; an empty table gives no rows."""
    spark = docs.sparkSession
    byte_path, piece_path = byte_path or vocabulary(), piece_path or vocabulary("piece_bpe_32k.model")
    with small_batches(spark, 1024):
        blocks = materialize(encoded_blocks(ids_and_text(docs, id_col, text_col), byte_path, piece_path, keep_groups), "aligned")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("pos", "p")).select("block", "pos", "p.a", "p.b")
    totals = pairs.join(pair_counts(blocks), ["a", "b"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "links", "top"))).alias("x"))
    totals = totals.select("block", F.col("x.links").alias("links"), F.col("x.top").alias("top"))
    schema = "_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", groups_sha256 string, groups string, count_sum long, n_best long"
    with small_batches(spark, 8):
        done = materialize(blocks.drop("a", "b", "n").join(totals, "block", "left").mapInArrow(tidy(_finish), schema), "documents")
    return done.select(public_id(), *NUMBERS, "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else []))
