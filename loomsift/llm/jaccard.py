"""N-gram Jaccard join by a token-group matrix, down to connected components.

Documents are sets of word shingles.  Two sets that link share a token among the first ones of each,
under one order of all tokens in which frequent ones come last, so each document is posted under few
tokens.  Documents of one token and of compatible sizes form a block.  Each block first tests its
documents against leaders; those that link form groups.  For every group the matrix row, its token
union, is kept as hashed token columns: a document's tokens outside the union bound its overlap with
every member, and only groups that the bound leaves are opened.  Each candidate is verified on whole
texts, so the links are exact.  Within a group nothing is compared again to connect it.

Links are counted once components are known: sets that link are in one component, whose different sets
are dealt to cells, pairs of buckets, and compared there all with all.

Equal sets are one document here, from their tasks on and again in each block.  A token of very many documents is dealt over
several blocks, each of which meets the documents outside the token's main group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, discard, ids_and_text, materialize, partitions, public_id, small_batches, tidy
from .kernels import mix64, ranges, same_spans, shingle_sets, shingles

SHINGLE, PERCENT = 5, 80
#: Frequent tokens that all tasks know, at most; the order of the others is that of their hashes.
HOT_TOKENS = 1 << 20
#: Documents of a token from which it counts as frequent, and per block of a frequent token.
HOT_LEAST, BLOCK_DOCS = 8, 2048
#: Tokens of different sets that a task counts at once.
FLUSH_TOKENS = 4_000_000
#: Bits of the set of wanted ids that is sent to all tasks (8 MB); more ids let more rows through.
ID_BITS = 1 << 26
#: Least block keys of a document that go along with it, so that few blocks give out the same pair.
LEAST_KEYS = 16
#: Different sets of a component per bucket; a cell compares two buckets.
CELL_DOCS = 1024
#: Documents of a cell from which a token is counted by a matrix product; rarer ones are paired. Tokens per product.
CELL_HOT, CELL_TOKENS = 32, 4096
#: Pairs of texts per Arrow batch.
PAIR_ROWS = 512


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted tokens) of each document."""
    for row, tokens, offsets in shingle_sets(batch[1], SHINGLE):
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            yield row + i, tokens[a:b]


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    return int(mix64(tokens).sum(dtype=np.uint64)), int(mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))


def _bits(tokens: np.ndarray) -> bytes:
    """Token columns: bit ``token mod width``, for the power of two at or above twice the size."""
    width = max(64, 1 << int(2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    flags = np.zeros(width, np.uint8)
    flags[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


SUMMARY = "_id long, size long, a long, b long, bits binary, mark long, token long, n long"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and the tokens that several different sets of this task have, with counts.

    ``FLUSH_TOKENS`` are counted at once, so a token that is frequent enough to make a large block is
    seen several times."""
    seen: set = set()
    held: list[np.ndarray] = []
    n_held = 0
    names = "_id size a b bits mark token n"

    def often():
        token, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= 2
        nothing = pa.nulls(int(some.sum()), pa.int64())
        return _batch(names, nothing, nothing, nothing, nothing, pa.nulls(len(nothing), pa.binary()), nothing, token[some].view(np.int64), n[some].astype(np.int64))

    for batch in batches:
        keys = batch[0].to_pylist()
        rows = []
        for i, tokens in _sets(batch):
            a, b = _identity(tokens)
            rows.append((keys[i], len(tokens), a, b, _bits(tokens)))
            if (a, b) not in seen:
                seen.add((a, b))
                held.append(tokens.copy())
                n_held += len(tokens)
                if n_held > FLUSH_TOKENS:
                    yield often()
                    held, n_held = [], 0
        ids, size, a, b, bits = zip(*rows) if rows else [()] * 5
        nothing = pa.nulls(len(rows), pa.int64())
        yield _batch(names, pa.array(ids, pa.int64()), pa.array(size, pa.int64()), np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64), pa.array(bits, pa.binary()), batch["_mark"], nothing, nothing)
    if held:
        yield often()


class _Order:
    """The order of tokens: by hash, but frequent ones last, the most frequent at the end."""

    def __init__(self, tokens: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.n = tokens[order], n[order]
        rank = np.empty(len(tokens), np.uint64)
        rank[np.argsort(self.n, kind="stable")] = np.arange(len(tokens), dtype=np.uint64)
        self.rank = rank

    def prefix(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens under which a set is posted, and in how many blocks each is dealt."""
        size = len(tokens)
        most = size - -(-PERCENT * size // 100) + 1
        deal = np.ones(size, np.int64)
        if not len(self.tokens):
            return tokens[:most], deal[:most]
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        hot = self.tokens[at] == tokens
        if hot.any():
            key = np.where(hot, np.uint64(1 << 63) + self.rank[at], tokens >> np.uint64(1))
            order = np.argsort(key, kind="stable")
            deal = np.where(hot, -(-self.n[at] // BLOCK_DOCS), 1)[order]
            tokens = tokens[order]
        return tokens[:most], deal[:most]


def _postings(order):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """token, deal, _id, size, who: one document of each set of this task, under its first tokens.

        Equal sets of different tasks are dealt alike, and ``_blocks`` keeps one of them."""
        seen: set = set()
        for batch in batches:
            keys, parts = batch[0].to_pylist(), []
            for i, tokens in _sets(batch):
                if len(tokens) and keys[i] != NULL_ID and (who := _identity(tokens)) not in seen:
                    seen.add(who)
                    first, deals = order.value.prefix(tokens)
                    own = np.uint64(who[0])
                    parts.append((first, np.where(deals > 1, (own % deals.astype(np.uint64)).astype(np.int64), -1), np.full(len(first), keys[i]), np.full(len(first), len(tokens)), np.full(len(first), own)))
            if parts:
                token, deal, ids, size, who = (np.concatenate(x) for x in zip(*parts))
                yield _batch("token deal _id size who", token.view(np.int64), deal.astype(np.int32), ids, size.astype(np.int32), who.view(np.int64))

    return post


BLOCK = "block long, token long, deal int, docs array<long>, sizes array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one partition of postings: two documents or more whose sizes form a chain.

    Equal blocks of several tokens become one.  A dealt token's documents stay one row whatever
    their sizes and number, with ``token`` and ``deal``."""
    parts = [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
    if not parts:
        return
    token, deal, ids, size, who = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, who, size, deal, token))
    one = np.ones(len(order), bool)  # of equal sets the smallest id
    one[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (token, deal, size, who)])
    order = order[one]
    order = order[np.lexsort((ids[order], size[order], deal[order], token[order]))]
    token, deal, ids, size = (x[order] for x in (token, deal, ids, size))
    cut = np.ones(len(ids), bool)
    far = (100 * size[:-1].astype(np.int64) < PERCENT * size[1:].astype(np.int64)) & (deal[1:] < 0)
    cut[1:] = (token[1:] != token[:-1]) | (deal[1:] != deal[:-1]) | far
    start = np.flatnonzero(cut)
    count = np.diff(np.append(start, len(ids)))
    name = np.add.reduceat(mix64(ids.astype(np.uint64)), start)
    dealt = deal[start] >= 0
    name = np.where(dealt, mix64(token[start].view(np.uint64) + deal[start].astype(np.uint64)), name)
    keep = (count > 1) | dealt
    _, one = np.unique(name[keep], return_index=True)
    chosen = np.flatnonzero(keep)[np.sort(one)]
    for a in range(0, len(chosen), 20_000):
        own = chosen[a : a + 20_000]
        n = count[own]
        at = np.concatenate([np.arange(s, s + k) for s, k in zip(start[own].tolist(), n.tolist())])
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        yield _batch(
            "block token deal docs sizes", name[own].view(np.int64), pa.array(token[own], mask=~dealt[own]), deal[own].astype(np.int32),
            pa.ListArray.from_arrays(offsets, pa.array(ids[at])), pa.ListArray.from_arrays(offsets, pa.array(size[at].astype(np.int32))),
        )


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _least_overlap(x, y):
    """Common tokens that sets of sizes x and y need at least to link (numbers or arrays)."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def _bound(bits: np.ndarray, size: np.ndarray, union: np.ndarray) -> np.ndarray:
    """Most common tokens of sets with a token union: each column outside it is a token outside."""
    return size - np.bitwise_count(bits & ~union).sum(axis=1, dtype=np.int64)


class Columns:
    """The hashed token columns of a block's documents, by width."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes]) -> None:
        self.sizes, self.widths = sizes.astype(np.int64), np.array([len(b) for b in bits])
        self.at = {int(w): np.flatnonzero(self.widths == w) for w in np.unique(self.widths)}
        self.matrix = {(w, w): np.frombuffer(b"".join(bits[i] for i in own), np.uint8).reshape(len(own), w) for w, own in self.at.items()}

    def folded(self, of: int, to: int) -> np.ndarray:
        if (of, to) not in self.matrix:
            self.matrix[of, to] = _fold(self.matrix[of, of], to)
        return self.matrix[of, to]

    def may_link(self, i: int) -> np.ndarray:
        """Which documents may link with the i-th: every column that one has and the other has not is
        a token outside both.  Sizes that may link differ by one width at most."""
        out = np.zeros(len(self.sizes), bool)
        w, size = int(self.widths[i]), self.sizes[i]
        row = np.flatnonzero(self.at[w] == i)[0]
        for other in (w // 2, w, 2 * w):
            if other in self.at:
                own, to = self.at[other], min(w, other)
                mine, theirs = self.folded(w, to)[row], self.folded(other, to)
                most = np.minimum(size - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), self.sizes[own] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
                fits = 100 * np.minimum(self.sizes[own], size) >= PERCENT * np.maximum(self.sizes[own], size)
                out[own] = fits & (most >= _least_overlap(self.sizes[own], size))
        out[i] = False
        return out


def stars(docs: np.ndarray, sizes: np.ndarray, bits: list[bytes], probes: int = 32) -> list[tuple[int, int]]:
    """Pairs of leaders with the documents that may link with them, each document in one star.

    Leaders are taken by how many of some evenly chosen documents may link with them, so that the
    text that copies were made from comes before the copies."""
    columns = Columns(sizes, bits)
    degree = np.zeros(len(docs), np.int64)
    for i in np.unique(np.linspace(0, len(docs) - 1, probes).astype(np.int64)) if len(docs) > 2 else []:
        degree += columns.may_link(int(i))
    done, out = np.zeros(len(docs), bool), []
    for i in np.lexsort((docs, -degree)).tolist():
        if not done[i]:
            done[i] = True
            members = columns.may_link(i) & ~done
            done |= members
            out += [(int(min(docs[i], d)), int(max(docs[i], d))) for d in docs[members] if d != docs[i]]
    return out


def open_groups(docs: np.ndarray, sizes: np.ndarray, groups: np.ndarray, bits: list[bytes], key: int = 0, keys: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """Pairs of documents of different groups of a block that may link.

    Strays, the documents outside the block's largest group, are held against each other group's
    token union, and against the members of those groups only that the bound leaves.  ``keys`` has
    the least block keys of each document: a pair is given out by the block of its least common key
    (by every block if the lists share none)."""
    columns = Columns(sizes, bits)
    names, count = np.unique(groups, return_counts=True)
    stray = groups != names[np.argmax(count)]
    held = [frozenset(k) for k in keys] if keys is not None else None
    out: list[tuple[int, int]] = []
    for width, own in columns.at.items():
        a = own[stray[own]]
        if not len(a):
            continue
        opened = np.zeros((len(a), len(docs)), bool)
        for other in (width // 2, width, 2 * width):
            if other not in columns.at:
                continue
            to, members = min(width, other), columns.at[other]
            mine, theirs = columns.folded(width, to)[stray[own]], columns.folded(other, to)
            for g in np.unique(groups[members]):
                of = groups[members] == g
                union = np.bitwise_or.reduce(theirs[of], axis=0)
                need = _least_overlap(sizes[a], np.maximum(sizes[members[of]].min(), -(-PERCENT * sizes[a] // 100)))
                opened[np.ix_((groups[a] != g) & (_bound(mine, sizes[a], union) >= need), members[of])] = True
        for row, i in enumerate(a.tolist()):
            fits = columns.may_link(i) & opened[row] & (~stray | (docs < docs[i])) if opened[row].any() else opened[row]
            for j in np.flatnonzero(fits).tolist():
                common = held[i] & held[j] if held is not None else ()
                if not common or min(common) == key:
                    out.append((int(min(docs[i], docs[j])), int(max(docs[i], docs[j]))))
    return out


def _wanted(ids: DataFrame):
    """A broadcast bit set of hashed ids: at most ``ID_BITS`` bits, whatever the number of ids."""
    at = F.pmod(F.xxhash64("_id"), F.lit(ID_BITS)) + 1
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(ID_BITS // 8 + 4096, np.uint8)
    for r in rows:
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits)


def _texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be wanted; one row per id."""
    bits = _wanted(ids)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["at"].to_numpy()
            hit = (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select(["_id", "_text"])

    hashed = rows.select("_id", "_text", F.pmod(F.xxhash64("_id"), F.lit(ID_BITS)).alias("at"))
    return hashed.mapInArrow(tidy(keep), "_id long, _text string")


def _one_text(texts: DataFrame) -> DataFrame:
    """A text per id: of several the one with the least hash."""
    return texts.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))


def _places(column: pa.Array) -> Iterator[tuple]:
    """(tokens, their first words, words of a shingle, bytes, starts and sizes of words) of each document."""
    for w, grams, at, offsets in shingles(column, SHINGLE):
        data, size, count = np.append(w.data, np.zeros(8, np.uint8)), w.end - w.start, np.diff(w.first).tolist()
        for n, a, b in zip(count, offsets[:-1].tolist(), offsets[1:].tolist()):
            yield grams[a:b], at[a:b], min(n, SHINGLE), data, w.start, size


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y of the pairs that link, by their whole texts: common shingles are compared word by word."""
    for batch in batches:
        hit = []
        for (one, p, n, data, start, size), (two, q, m, other, begin, width) in zip(_places(batch["tx"]), _places(batch["ty"]), strict=True):
            _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
            least = _least_overlap(len(one), len(two))
            if n == m and len(i) >= max(least, 1):
                a, b = (p[i][:, None] + np.arange(n)).ravel(), (q[j][:, None] + np.arange(n)).ravel()
                same = (size[a] == width[b]) & same_spans(data, start[a], other, begin[b], np.minimum(size[a], width[b]))
                hit.append(int(same.reshape(-1, n).all(1).sum()) >= max(least, 1))
            else:
                hit.append(False)
        yield batch.select(["x", "y"]).filter(pa.array(hit, pa.bool_()))


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    ids = pairs.select(F.explode(F.array("x", "y")).alias("_id"))
    texts = materialize(_one_text(_texts_of(rows, ids)), "texts")
    joined = pairs.join(texts.select(F.col("_id").alias("x"), F.col("_text").alias("tx")), "x")
    joined = joined.join(texts.select(F.col("_id").alias("y"), F.col("_text").alias("ty")), "y")
    with small_batches(rows.sparkSession, PAIR_ROWS):
        return materialize(joined.select("x", "y", "tx", "ty").mapInArrow(tidy(_links), "x long, y long"), "verified")


def components(links: DataFrame) -> DataFrame:
    """_id, label: of every document in ``links`` (x, y) the smallest id that it is connected with.

    Large-star and small-star rounds; the number of rounds grows with the logarithm of a component's
    size, and each round's links are written to the shared folder."""
    edges = materialize(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        last, edges = edges, materialize(small.distinct(), "links")
        # The same set of links: sums of whole hashes, without overflow.
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
        discard(last)
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("_id")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("_id"), F.col("v").alias("label")).distinct())


def extended(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that made ``groups`` and of ``links`` (x, y): only labels are connected anew."""
    of = lambda c: groups.select(F.col("_id").alias(c), F.col("label").alias(f"l{c}"))
    joined = links.join(of("x"), "x", "left").join(of("y"), "y", "left")
    top = components(joined.select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y")))
    renamed = top.select(F.col("_id").alias("label"), F.col("label").alias("now"))
    old = groups.join(renamed, "label", "left").select("_id", F.coalesce("now", "label").alias("label"))
    return old.unionByName(top.join(groups, "_id", "left_anti"))


def _common(sets: list[np.ndarray], right: np.ndarray) -> np.ndarray:
    """Common tokens of each set that is not ``right`` (rows) and each that is (columns)."""
    size = np.array([len(x) for x in sets])
    token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), size)
    place = np.empty(len(sets), np.int64)  # row or column
    place[right], place[~right] = np.arange(right.sum()), np.arange((~right).sum())
    rows, columns = int((~right).sum()), int(right.sum())
    out = np.zeros((rows, columns), np.float32)
    hot = np.flatnonzero(count >= CELL_HOT)
    slot = np.full(len(token), -1, np.int64)
    slot[hot] = np.arange(len(hot))
    at, side = slot[inverse], right[doc]
    for a in range(0, len(hot), CELL_TOKENS):
        own = (at >= a) & (at < a + CELL_TOKENS)
        x, y = np.zeros((rows, CELL_TOKENS), np.float32), np.zeros((columns, CELL_TOKENS), np.float32)
        x[place[doc[own & ~side]], at[own & ~side] - a] = 1
        y[place[doc[own & side]], at[own & side] - a] = 1
        out += x @ y.T
    few = (count > 1) & (count < CELL_HOT)
    own = np.flatnonzero(few[inverse] & ~side)
    other = np.flatnonzero(few[inverse] & side)
    other = other[np.argsort(inverse[other], kind="stable")]
    n = np.bincount(inverse[other], minlength=len(token))
    begin = np.cumsum(n) - n
    flat = out.reshape(-1)
    for a in range(0, len(own), 200_000):
        some = own[a : a + 200_000]
        each = n[inverse[some]]
        partner = other[ranges(begin[inverse[some]], each)]
        cell = np.repeat(place[doc[some]], each) * columns + place[doc[partner]]
        cell, k = np.unique(cell, return_counts=True)
        flat[cell] += k
    return out


def _cell_links(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray) -> np.ndarray:
    """How many documents of a cell each set links with.  ``copies``: documents of each set; ``side``:
    0 and 1 for the buckets of a cell of two, 2 for all of a cell of one bucket with itself."""
    n = np.zeros(len(sets), np.int64)
    if len(sets) < 2 or len(np.unique(side)) < 2 and side[0] != 2:
        return n
    one = side[0] == 2
    right = np.arange(2 * len(sets)) >= len(sets) if one else side == 1
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets)) if one else np.flatnonzero(~right)
    over = left if one else np.flatnonzero(right)
    common = _common(sets + sets if one else sets, right).astype(np.int64)
    link = (common > 0) & (100 * common >= PERCENT * (size[left][:, None] + size[over][None, :] - common))
    if one:
        np.fill_diagonal(link, False)
    n[left] += link @ copies[over]
    if not one:
        n[over] += copies[left] @ link
    return n


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, n: linked documents of each set in each cell; a cell's rows follow each other."""
    held: list[tuple] = []
    now = None

    def close():
        ids, copies, side, sets = zip(*held)
        n = _cell_links(list(sets), np.array(copies, np.int64), np.array(side))
        return _batch("_id n", pa.array(ids, pa.int64()), n)

    for batch in batches:
        cells = list(zip(*(batch[c].to_pylist() for c in ("label", "lo", "hi"))))
        ids, copies, side = (batch[c].to_pylist() for c in ("_id", "copies", "side"))
        for i, tokens in _sets(batch.select(["_id", "_text"])):
            if cells[i] != now and held:
                yield close()
                held = []
            now = cells[i]
            held.append((ids[i], copies[i], side[i], tokens.copy()))
    if held:
        yield close()


def _link_counts(rows: DataFrame, groups: DataFrame, classes: DataFrame, copies: DataFrame) -> DataFrame:
    """rep, links: for each set, named by its smallest id, the documents of other sets that link with it."""
    n = partitions(rows.sparkSession)
    reps = groups.join(copies.select("_id"), "_id", "left_anti").join(classes.select(F.col("rep").alias("_id"), F.col("n").alias("copies")), "_id", "left")
    reps = reps.select("_id", "label", F.coalesce("copies", F.lit(1)).alias("copies"))
    sizes = reps.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("copies").alias("all"))
    reps = materialize(reps.join(sizes.where("sets > 1"), "label"), "members")
    # Two sets that are a whole component link.
    pairs = reps.where("sets = 2").select("_id", (F.col("all") - F.col("copies")).alias("n"))
    many = reps.where("sets > 2").withColumn("buckets", F.ceil(F.col("sets") / CELL_DOCS).cast("int"))
    texts = _one_text(_texts_of(rows, many.select("_id")))
    own, other = F.pmod(F.xxhash64("_id"), F.col("buckets")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))
    cells = many.select("_id", "label", "copies", own.alias("own"), other.alias("other")).select(
        "_id", "label", "copies", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
    )
    # Named by ids first: texts meet their cells once and go to them at once.
    placed = cells.join(texts, "_id").repartition(n, "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    with small_batches(rows.sparkSession, PAIR_ROWS):
        counted = materialize(placed.select("_id", "_text", "label", "lo", "hi", "copies", "side").mapInArrow(tidy(_cells), "_id long, n long").union(pairs), "counts")
    return counted.groupBy(F.col("_id").alias("rep")).agg(F.sum("n").alias("links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row.

    A document's set is its distinct shingles of ``SHINGLE`` lower-cased words (A-Z; fewer words:
    all as one).  Documents link at a Jaccard index of ``PERCENT``/100 or more; component_id is the
    smallest id reachable.  n_links counts the documents that it links with; without ``count_links`` it
    is null and the counting is saved.  A null
    or empty text has an empty set, which links with nothing; a null id links with nothing and has a
    null component; rows that repeat an id are one document in links, of different texts the one with the least
    hash; an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = ids_and_text(docs, id_col, text_col)
    table = materialize(rows.withColumn("_mark", F.xxhash64("_text")).mapInArrow(tidy(_summary), SUMMARY), "sets")
    sets = table.where("_id is not null")
    bits = sets.where((F.col("size") > 0) & (F.col("_id") != NULL_ID)).groupBy("_id").agg(F.min_by(F.struct("size", "a", "b", "bits"), "mark").alias("s")).select("_id", "s.*")
    bits = materialize(bits, "bits")
    often = table.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST)
    got = often.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toArrow()
    order = spark.sparkContext.broadcast(_Order(got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()))

    # Written, so that a join with it is one that is split where a class is large.
    classes = materialize(bits.groupBy("a", "b").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    copies = materialize(bits.select("_id", "a", "b").join(classes, ["a", "b"]).where("_id <> rep").select("_id", "rep"), "copies")

    posted = rows.mapInArrow(tidy(_postings(order)), "token long, deal int, _id long, size int, who long").repartition(n, "token", "deal")
    blocks = posted.mapInArrow(tidy(_blocks), BLOCK).groupBy("block").agg(*[F.first(c).alias(c) for c in ("token", "deal", "docs", "sizes")])
    blocks = materialize(blocks, "blocks")
    plain = blocks.where("token is null").select("block", "docs", "sizes")
    dealt = blocks.where("token is not null").select("token", "deal", "docs", "sizes")

    # First wave: stars in each block, and among the middle documents of a dealt token's blocks.
    bits = bits.select("_id", "size", "bits")
    middle = F.get("docs", F.floor(F.size("docs") / 2).cast("int"))
    of = plain.select("block", F.explode("docs").alias("_id"))
    of = of.union(dealt.select(F.xxhash64("token", "deal").alias("block"), F.explode("docs").alias("_id"))).union(dealt.select(F.xxhash64("token").alias("block"), middle.alias("_id")))
    grouped = of.join(bits, "_id").groupBy("block").agg(F.collect_list(F.struct("_id", "size", "bits")).alias("docs"))
    first = materialize(grouped.mapInArrow(tidy(_stars), "x long, y long").distinct(), "pairs")
    links = _verified(first, rows)
    same = copies.select(F.col("rep").alias("x"), F.col("_id").alias("y"))
    groups = materialize(components(links.union(same)), "components")

    # Second wave: what is left between different groups of a block.
    label = F.coalesce("label", "_id").alias("label")
    of = plain.where(F.size("docs") > 2).select("block", F.col("block").alias("key"), F.explode("docs").alias("_id"))
    each = dealt.select("token", "deal", F.explode("docs").alias("_id")).join(groups, "_id", "left").select("token", "deal", "_id", label)
    mains = each.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    strays = each.join(mains, "token").where("label <> main").select("token", F.col("deal").alias("from"), F.col("_id").alias("stray"))
    cells = each.join(strays.select("token", "from").distinct(), "token")
    cell = [F.xxhash64("token", "deal", "from").alias("block"), F.xxhash64("token").alias("key")]
    extra = strays.join(each.select("token", "deal").distinct(), "token").select(*cell, F.col("stray").alias("_id"))
    of = of.join(groups, "_id", "left").select("block", "key", "_id", label)
    of = of.union(cells.select(*cell, "_id", "label")).union(extra.join(groups, "_id", "left").select("block", "key", "_id", label))
    open_ = of.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("block")
    left = materialize(of.join(open_, "block").dropDuplicates(["block", "_id"]), "open")
    keys = left.groupBy("_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LEAST_KEYS).alias("keys"))
    left = left.join(keys.join(bits, "_id"), "_id")
    left = left.groupBy("block").agg(F.first("key").alias("key"), F.collect_list(F.struct("_id", "size", "label", "bits", "keys")).alias("docs"))
    second = left.mapInArrow(tidy(_open), "x long, y long").distinct().join(first, ["x", "y"], "left_anti")
    second = materialize(second, "pairs")
    more = _verified(second, rows)
    final = materialize(extended(groups, more), "components")
    component = F.when(F.col("_id") != NULL_ID, F.coalesce("label", "_id"))
    out = sets.select("_id", "size", "a", "b").join(final, "_id", "left")
    links_of = F.lit(None).cast("long")
    if count_links:
        counts = _link_counts(rows, final, classes, copies)
        out = out.join(classes, ["a", "b"], "left").withColumn("rep", F.coalesce("rep", "_id")).join(counts, "rep", "left")
        usual = (F.col("size") > 0) & (F.col("_id") != NULL_ID)
        links_of = F.when(usual, F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return out.select(public_id(), F.col("size").alias("n_shingles"), component.alias("component_id"), links_of.alias("n_links"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _pairs_of(batches, lambda own, _: stars(own.field("_id").to_numpy(), own.field("size").to_numpy(), own.field("bits").to_pylist()))


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _pairs_of(batches, lambda own, key: open_groups(own.field("_id").to_numpy(), own.field("size").to_numpy(), own.field("label").to_numpy(), own.field("bits").to_pylist(), key, own.field("keys").to_pylist()))


def _pairs_of(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """x, y that ``find`` gives for blocks; pairs that a task has given out already are left out."""
    given: set[tuple[int, int]] = set()
    for batch in batches:
        out: set[tuple[int, int]] = set()
        keys = batch["key"].to_pylist() if "key" in batch.schema.names else [0] * batch.num_rows
        for docs, key in zip(batch["docs"], keys, strict=True):
            out.update(find(docs.values, key))
        new = sorted(out - given)
        if len(given) < 1_000_000:
            given |= out
        yield _batch("x y", pa.array([x for x, _ in new], pa.int64()), pa.array([y for _, y in new], pa.int64()))
