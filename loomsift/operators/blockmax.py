"""Block-max postings: an inverted index by blocks of documents, and top-k search that skips blocks.

A row of the index is a block: its documents' ids, its distinct tokens with the number of documents
that hold each, and the places of those in the block.  A token weighs the same in every document that holds
it, so the sum of the weights of a query's tokens that a block has at all is the most that one of its
documents can score.  A task meets the blocks in the order of these bounds, keeps the best rows of each query so
far, and opens a block's postings only for queries whose k-th best row the bound reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.formats import arrow_rows, stored
from ..sources.tables import sent

#: Documents per block, blocks whose bounds are held at a time, documents whose texts a worker gets at a time, and scores
#: that are added up at a time.
BLOCK, AHEAD, TEXTS, CELLS = 128, 64, 512, 1 << 20
#: Query terms (token and query) up to which a batch of queries is sent to all tasks.
MOST_TERMS = 1 << 20


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + size - 1 of each range, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def block_index(docs: DataFrame, text: str | Column = "text", id_col: str = "doc_id") -> DataFrame:
    """docs array<id>, tokens, counts, held (16-bit places in the block): blocks of the documents that have tokens."""
    # No token holds a blank.  Texts without tokens are left out below: a filter here would be pushed under the exchange
    # that deals the texts, and split all of them there a second time.
    rows = docs.select(F.col(id_col).alias("id"), F.concat_ws(" ", F.array_distinct(tokens(text))).alias("t"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, out = batch.filter(pc.not_equal(batch[1], "")), []
            for at in range(0, batch.num_rows, BLOCK):
                ids, lists = batch[0].slice(at, BLOCK), pc.split_pattern(batch[1].slice(at, BLOCK), " ")
                code = lists.flatten().dictionary_encode()
                place = np.repeat(np.arange(len(lists), dtype=np.uint16), pc.list_value_length(lists).to_numpy())
                number = code.indices.to_numpy()
                by = np.argsort(number, kind="stable")
                out.append((ids, code.dictionary, np.bincount(number, minlength=len(code.dictionary)), place[by].astype("<u2").tobytes()))
            lists_of = lambda parts, kind: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32), pa.concat_arrays([pa.array(p).cast(kind) for p in parts]))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([lists_of(cols[0], batch.schema.field(0).type), lists_of(cols[1], pa.string()), lists_of(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["docs", "tokens", "counts", "held"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(build, f"docs array<{kind}>, tokens array<string>, counts array<int>, held binary")


def term_weights(index: DataFrame, terms: DataFrame) -> DataFrame:
    """item_id, token, terms, w of the query terms (item_id, token, qtf, terms) that the index has.  Only the
    frequencies of the queries' tokens leave a task."""
    n_docs = index.agg(F.sum(F.size("docs")).alias("n"))
    each = index.select(F.explode(F.arrays_zip("tokens", "counts")).alias("e")).select(F.col("e.tokens").alias("token"), F.col("e.counts").alias("c"))
    df = each.join(sent(terms.select("token").distinct(), terms), "token", "left_semi").groupBy("token").agg(F.sum("c").alias("df"))
    idf = F.greatest(F.lit(0.0), F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    return terms.join(df, "token").crossJoin(F.broadcast(n_docs)).select("item_id", "token", "terms", (idf * (1 + F.log1p("qtf"))).alias("w"))


def batch_weights(index: DataFrame, terms: pa.Table) -> pa.Table:
    """``term_weights`` of a batch of terms that is sent to all tasks: a task counts the documents of its blocks and of each
    token, in one pass over names and counts alone."""
    names = pc.unique(terms.column("token").combine_chunks())
    sent_ = index.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(sent_.value), np.int64), 0
        for batch in batches:
            n += int(batch[0].to_numpy().sum())
            code = pc.fill_null(pc.index_in(batch[1].flatten(), value_set=sent_.value), -1).to_numpy()
            own = code >= 0
            df += np.bincount(code[own], batch[2].flatten().to_numpy()[own], len(df)).astype(np.int64)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(df[held], n))], names=["i", "c"])

    each = index.select(F.size("docs").alias("n"), "tokens", "counts").mapInArrow(count, "i int, c long")
    with arrow_rows(index.sparkSession, AHEAD):
        found = {r.i: r.c for r in each.groupBy("i").agg(F.sum("c").alias("c")).collect()}  # a row per term at most
    df = np.array([found.get(i, 0) for i in range(len(names))], np.float64)
    own = df[pc.index_in(terms.column("token").combine_chunks(), value_set=names).to_numpy()]
    w = np.maximum(0.0, np.log((found.get(-1, 0) - own + 0.5) / (own + 0.5) + 1)) * (1 + np.log1p(terms.column("qtf").to_numpy()))
    return terms.select(["item_id", "token", "terms"]).append_column("w", pa.array(w)).filter(pa.array(own > 0))


def scored(index: DataFrame, weights: DataFrame) -> DataFrame:
    """item_id, doc_id, score of every document that shares a token with a query, for more queries than can be sent."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, names, counts, held in zip(*[batch.column(c) for c in ("docs", "tokens", "counts", "held")]):
                place = np.frombuffer(held.as_py(), "<u2").astype(np.int64)
                token = np.repeat(np.arange(len(names)), counts.values.to_numpy())
                yield pa.RecordBatch.from_arrays([docs.values.take(pa.array(place)), names.values.take(pa.array(token))], names=["doc_id", "token"])

    rows = index.mapInArrow(postings, "doc_id long, token string").join(weights, "token")
    out = rows.groupBy("item_id", "doc_id").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("m"), F.first("terms").alias("t"))
    return out.select("item_id", "doc_id", (F.col("s") + 0.2 * F.col("m") / F.col("t")).alias("score"))


class Batch:
    """A batch of queries as one table from tokens to (query, weight)."""

    def __init__(self, rows: pa.Table) -> None:
        code = rows.column("token").combine_chunks().dictionary_encode()
        items = rows.column("item_id").combine_chunks().dictionary_encode()
        by = np.argsort(code.indices.to_numpy(), kind="stable")
        #: Covering all terms adds 0.2, so each term adds its share.
        weight = rows.column("w").to_numpy() + 0.2 / rows.column("terms").to_numpy()
        self.tokens, self.items = code.dictionary, items.dictionary.to_numpy()
        self.query, self.weight = items.indices.to_numpy()[by].astype(np.int64), weight[by]
        self.size = np.bincount(code.indices.to_numpy(), minlength=len(self.tokens))
        self.start = np.cumsum(self.size) - self.size


class Best:
    """The first k rows of each query so far, by score (rounded) and then id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least, self.last = k, np.full(queries, -np.inf), np.full(queries, np.iinfo(np.int64).max)
        self.rows = np.zeros(0, [("query", "i8"), ("by", "f8"), ("id", "i8"), ("score", "f8")])
        self.opened = self.skipped = 0

    def takes(self, query: np.ndarray, by: np.ndarray, id_: np.ndarray) -> np.ndarray:
        """Whether a row comes before the k-th best row of its query so far."""
        least = self.least[query]
        return (by > least) | (by == least) & (id_ < self.last[query])

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate((self.rows, rows))
        rows = rows[np.lexsort((rows["id"], -rows["by"], rows["query"]))]
        first = np.flatnonzero(np.concatenate(([True], rows["query"][1:] != rows["query"][:-1]))) if len(rows) else np.zeros(0, np.int64)
        rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        self.rows = rows[rank < self.k]
        last = rows[rank == self.k - 1]
        self.least[last["query"]], self.last[last["query"]] = last["by"], last["id"]


def _search(blocks: pa.RecordBatch, batch: Batch, best: Best) -> None:
    lists, counts = blocks.column("tokens"), blocks.column("counts")
    n_tokens = pc.list_value_length(lists).to_numpy().astype(np.int64)
    code = pc.fill_null(pc.index_in(lists.flatten(), value_set=batch.tokens), -1).to_numpy().astype(np.int64)
    count = counts.flatten().to_numpy()
    first = np.concatenate(([0], np.cumsum(n_tokens)))
    found, most, bounds = [], np.zeros(blocks.num_rows), []
    for i in range(blocks.num_rows):
        own, n = code[first[i] : first[i + 1]], count[first[i] : first[i + 1]].astype(np.int64)
        has = np.flatnonzero(own >= 0)
        own, n, start = own[has], n[has], (np.cumsum(n) - n)[has]
        found.append((own, n, start))
        entry = _ranges(batch.start[own], batch.size[own])
        bound = np.bincount(batch.query[entry], batch.weight[entry], len(batch.items))
        met = np.flatnonzero(bound > 0)
        bounds.append((met, bound[met]))
        most[i] = bound.max(initial=0)
    # Sums may differ in their last digits by the order of what is added.
    for i in np.argsort(-most, kind="stable").tolist():
        met, bound = bounds[i]
        queries = met[bound + 1e-5 >= best.least[met]]
        best.opened, best.skipped = best.opened + len(queries), best.skipped + len(met) - len(queries)
        if not len(queries):
            continue
        own, n, start = found[i]
        held = np.frombuffer(blocks.column("held")[i].as_py(), "<u2")
        ids = blocks.column("docs")[i].values.to_numpy()
        row = np.full(len(batch.items), -1)
        row[queries] = np.arange(len(queries))
        entry = _ranges(batch.start[own], batch.size[own])
        row = row[batch.query[entry]]
        keep = row >= 0
        entry, row, at, size = entry[keep], row[keep], np.repeat(start, batch.size[own])[keep], np.repeat(n, batch.size[own])[keep]
        # As many queries at a time as have so many places to add up.
        places = np.cumsum(np.bincount(row, size, len(queries)) + len(ids)) // CELLS
        for some in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(places)) + 1):
            low, high = some[0], some[-1] + 1
            part = slice(None) if len(some) == len(queries) else (row >= low) & (row < high)
            cell = np.repeat((row[part] - low) * len(ids), size[part]) + held[_ranges(at[part], size[part])]
            score = np.bincount(cell, np.repeat(batch.weight[entry[part]], size[part]), len(some) * len(ids)).reshape(len(some), len(ids))
            by = np.floor(score * 1e6 + 0.5) / 1e6
            q, d = np.nonzero((score > 0) & (by >= best.least[queries[some]][:, None]))
            own_ = best.takes(queries[some][q], by[q, d], ids[d])
            q, d = q[own_], d[own_]
            new = np.zeros(len(q), best.rows.dtype)
            new["query"], new["by"], new["id"], new["score"] = queries[some][q], by[q, d], ids[d], score[q, d]
            best.add(new)


def block_topk(index: DataFrame, weights: pa.Table, k: int) -> DataFrame:
    """item_id, doc_id, score, by: each task's best ``k`` rows of every query, stored, as a worker gets few blocks at a time."""
    schema = "item_id long, doc_id long, score double, by double"
    if not weights.num_rows:
        return index.sparkSession.createDataFrame([], schema)
    sent_ = index.sparkSession.sparkContext.broadcast(Batch(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = sent_.value
        best = Best(len(batch.items), k)
        for blocks in batches:
            for at in range(0, blocks.num_rows, AHEAD):
                _search(blocks.slice(at, AHEAD), batch, best)
        rows = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (batch.items[rows["query"]], rows["id"], rows["score"], rows["by"])], names=["item_id", "doc_id", "score", "by"])

    return stored(index.mapInArrow(run, schema), "found", AHEAD)
