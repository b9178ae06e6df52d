"""Vector code compression: product codes whose nearest entries are found in kd-trees.

A vector becomes integers, ``floor(SCALE * x)``, and is cut into equal parts, each of which is coded as the
number of the nearest entry of its part's codebook.  Every round builds one kd-tree per codebook and
sends them to all tasks; a task searches its vectors by branch and bound and hands on, per entry, how
many parts chose it and their sums.  Those are added up in Spark as integers, so that the entries don't
depend on how rows are dealt.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a leaf, and vectors that are searched at a time.
LEAF, BLOCK = 32, 1 << 13
#: Components that 64 bits can't square and sum: a vector that has one gets no code.
MOST = 1 << 24
#: Labels up to which their sums are sent to all tasks; more are joined by shuffle.
MOST_SENT = 100_000


class Tree:
    """A kd-tree over a codebook's entries: inner nodes are cut at the median of the widest component, and every
    node knows the box around its entries.

    Distances are whole numbers: they are taken as products of matrices of doubles where those hold them exactly,
    as 64-bit integers elsewhere."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.most = int(np.abs(entries).max()) if entries.size else 0
        self.low, self.high, self.children, self.own = [], [], [], []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> int:
        node, points = len(self.own), self.entries[own]
        self.low.append(points.min(axis=0))
        self.high.append(points.max(axis=0))
        self.children.append(None)
        self.own.append(np.sort(own))  # a leaf's first nearest entry is the one with the lowest index
        spread = self.high[node] - self.low[node]
        if len(own) > LEAF and spread.any():
            by = np.argsort(points[:, spread.argmax()], kind="stable")
            half = len(own) // 2
            self.children[node] = self._grow(own[by[:half]]), self._grow(own[by[half:]])
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry nearest to each row; of equally near ones the lowest index."""
        at, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x) if len(self.entries) else 0, BLOCK):
            at[a : a + BLOCK], best[a : a + BLOCK] = self._search(x[a : a + BLOCK])
        return at, best

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The largest number on the way is below (|x| + |entry|)^2, summed over the components.
        exact = (max(self.most, int(np.abs(x).max(initial=0))) * 2) ** 2 * max(x.shape[1], 1) < 1 << 53
        kind = np.float64 if exact else np.int64
        x, entries = x.astype(kind), self.entries.astype(kind)
        low, high = [v.astype(kind) for v in self.low], [v.astype(kind) for v in self.high]
        own_norm, norm = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", entries, entries)
        at, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf if exact else np.iinfo(np.int64).max, kind)

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            """The least squared distance that any entry under a node can have."""
            out = np.maximum(np.maximum(low[node] - x[rows], x[rows] - high[node]), 0)
            return np.einsum("ij,ij->i", out, out)

        def leaf(rows: np.ndarray, own: np.ndarray) -> None:
            if exact:
                far = own_norm[rows][:, None] - 2 * (x[rows] @ entries[own].T) + norm[own]
            else:
                apart = x[rows][:, None, :] - entries[own][None]
                far = np.einsum("ijk,ijk->ij", apart, apart)
            one = far.argmin(axis=1)
            far, one = far[np.arange(len(rows)), one], own[one]
            better = (far < best[rows]) | ((far == best[rows]) & (one < at[rows]))
            at[rows[better]], best[rows[better]] = one[better], far[better]

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if self.children[node] is None:
                leaf(rows, self.own[node])
                return
            left, right = self.children[node]
            to_left, to_right = bound(left, rows), bound(right, rows)
            near = to_left <= to_right
            visit(left, rows[near])
            visit(right, rows[~near])
            # A bound equal to the best distance is visited too: an entry of lower index may be as near.
            visit(right, rows[near & (to_right <= best[rows])])
            visit(left, rows[~near & (to_left <= best[rows])])

        visit(0, np.arange(len(x)))
        return at, best.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != inf)), F.lit(False))


def _width(kept: DataFrame, parts: int) -> int:
    """The components of most vectors that can be cut into equal parts (ties: the larger number)."""
    sizes = kept.groupBy(F.size("_v").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    first = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return first.n if first else 0


def train(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after so many rounds over ``kept`` (_id, _v), which begin as the parts
    of the rows with the smallest ids."""
    spark, size = kept.sparkSession, width // parts
    first = kept.select("_id", "_v").orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).collect()
    books = np.array([r._v for r in first], np.int64).reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        sent = spark.sparkContext.broadcast([Tree(b) for b in books])

        def totals(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            count, sums = np.zeros(books.shape[:2], np.int64), np.zeros_like(books)
            for batch in batches:
                x = _matrix(batch[0], width)
                for p, tree in enumerate(sent.value):
                    own = x[:, p * size : (p + 1) * size]
                    at = tree.nearest(own)[0]
                    by = np.argsort(at, kind="stable")
                    chosen, start = np.unique(at[by], return_index=True)
                    if len(chosen):
                        sums[p, chosen] += np.add.reduceat(own[by], start)
                        count[p, chosen] += np.diff(np.append(start, len(by)))
            part, entry = np.nonzero(count)
            added = pa.ListArray.from_arrays(np.arange(0, (len(part) + 1) * size, size, dtype=np.int32)[: len(part) + 1], sums[part, entry].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), added], names=["part", "entry", "n", "sums"])

        each = kept.select("_v").mapInArrow(tidy(totals), "part int, entry int, n long, sums array<long>")
        merged = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
        for r in merged.collect():  # a row per entry that was chosen
            books[r.part, r.entry] = [s // r.n for s in r.sums]
        sent.unpersist()
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``kept`` (_id, _label, _v) as _id, _label, code, error."""
    parts, _, size = books.shape
    sent = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    digits = np.array([f"{i:02x}" for i in range(max(256, books.shape[1]))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch[2], parts * size)
            found = [tree.nearest(x[:, p * size : (p + 1) * size]) for p, tree in enumerate(sent.value)]
            names = ["".join(row) for row in zip(*[digits[at].tolist() for at, _ in found])]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(names, pa.string()), pa.array(sum(far for _, far in found), pa.int64())], names=["_id", "_label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("_id", "_label", "_v").mapInArrow(tidy(coded), f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, one after the other, in the vectors' own unit."""
    sent = codes.sparkSession.sparkContext.broadcast(books)
    at = codes.columns.index(code_col)
    schema = codes.select("*", F.lit(None).cast("array<double>").alias("vector")).schema

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if c is None else np.concatenate([sent.value[p, int(c[2 * p : 2 * p + 2], 16)] for p in range(len(sent.value))]) / SCALE for c in batch[at].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(tidy(spelt), schema)


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error of every kept row; codebooks).

    Rows whose vector is null or holds null or non-finite components go.  Repeated rows stay and count each;
    a null id comes last among the first codebooks' rows and stays null.  Vectors of another length than most,
    or with a component of ``MOST`` / ``SCALE`` or more, can't be compared with the codebooks: they keep their
    row, with null code and error, and train nothing.  Errors are summed per label, null being a label; an
    empty table gives no rows and empty codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits per part")
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_x")).where(finite(F.col("_x")))
    kept = materialize(rows.select("_id", "_label", whole(F.col("_x")).alias("_v")), "vectors")
    width = _width(kept, parts)
    fits = (F.size("_v") == width) & F.forall("_v", lambda x: (x > -MOST) & (x < MOST)) if width else F.lit(False)
    good = kept.where(fits)
    books = train(good, width, parts, entries, rounds) if width else np.zeros((parts, 0, 0), np.int64)
    done = encode(good, books).unionByName(kept.where(~fits).select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    done = materialize(done, "codes")
    sums = materialize(done.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")), "labels")
    few = F.broadcast(sums) if sums.count() <= MOST_SENT else sums
    out = done.join(few, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()


def _sql(parts: int, entries: int, rounds: int) -> str:
    """DuckDB SQL for the same rows, where ids are distinct and lengths equal: every round a table of its own."""
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}]::DOUBLE[] AS x FROM k, (SELECT unnest(range({parts})) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p) WHERE entry < {entries})",
    ]
    for i in range(rounds + 1):
        # Distance and index in one number, so that its least is the nearest entry of lowest index.
        away = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, part, min(CAST({away} AS BIGINT) * 256 + entry) AS best FROM p JOIN c{i} USING (part) GROUP BY vec_id, part)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT part, best % 256 AS entry, pos, sum(y) AS s, count(*) AS n FROM (SELECT part, best, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{i} JOIN p USING (vec_id, part)) GROUP BY ALL)")
            steps.append(f"n{i} AS (SELECT part, entry, list(floor(s / n) ORDER BY pos) AS c FROM s{i} GROUP BY part, entry)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (part, entry))")
    steps += [
        f"r AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS y, generate_subscripts(c, 1) AS pos FROM c{rounds}))",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h"


SQL = _sql(PARTS, ENTRIES, ROUNDS)
