"""BPE encoding and decoding through a table of distinct words.

Words are split in Spark tasks and counted; each distinct word is encoded once, into a table that
is written to the shared folder.  The table's most frequent words (a fixed number of bounded length, so
the size is bounded) go to all tasks, which compare words byte by byte; the occurrences of all others
are joined with the table by word.  Both come back to their document by position: its ids are its words'
ids.  Documents travel as compressed blocks of a range of ids, the ids that a block needs are joined on
the block.  Decoding knows ids alone and joins them with the vocabulary's pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Spans, WordTable, encoder, pieces, split, vocabulary
from .common import NULL_ID, ids_and_text, materialize_by, public_id, tidy
from .kernels import ranges

HEAD_WORDS = 1 << 19
HEAD_BYTES = 64
#: Longer words among those that go to all tasks: at most so many, of so many bytes, that occur so often.
LONG_WORDS, LONG_BYTES, LONG_LEAST = 1 << 13, 1 << 12, 16
#: Document ids per block.
BLOCK = 256
#: Distinct words, and bytes of them, that a task holds before it hands its counts on.
FLUSH, FLUSH_BYTES = 400_000, 1 << 25


def _plain(texts: list[str], special: list[str]) -> tuple[list[str], list[list[str]]]:
    """Texts with every special token's string cut out, and the strings that were cut.

    A text with k special tokens becomes k + 1 texts; the second list has, per original text, the
    specials between them."""
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    out, between = [], []
    for t in texts:
        found = cut.findall(t) if cut and any(s in t for s in special) else []
        out += cut.split(t) if found else [t]
        between.append(found)
    return out, between


def word_counts(docs: DataFrame, vocab: str) -> DataFrame:
    """word, n: every distinct word of ``_text`` and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = encoder(vocab).special
        table, n = WordTable(), np.zeros(0, np.int64)

        def out():
            own = pa.array(table.words(), pa.string())
            order = pa.compute.sort_indices(own)  # neighbours that look alike compress well on their way
            return pa.RecordBatch.from_arrays([own.take(order), pa.array(n[: len(own)]).take(order)], names=["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for chunk in split(_plain(batch[1].slice(at, 1024).to_pylist(), special)[0]):
                    found = table.numbers(chunk)
                    if len(n) < table.n:
                        n = np.concatenate((n, np.zeros(max(table.n, 1 << 16), np.int64)))
                    n += np.bincount(found, minlength=len(n))
                    if table.n > FLUSH or table.used > FLUSH_BYTES:
                        yield out()
                        table, n = WordTable(), np.zeros(0, np.int64)
        yield out()

    return docs.select("_id", "_text").mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_table(words: DataFrame, vocab: str) -> DataFrame:
    """word, n, ids (little-endian, 16 bits where the vocabulary allows): each distinct word is encoded here, once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab)
        width = _width(coder)
        for batch in batches:
            if batch.num_rows:
                ids, size = coder.encode_words(batch["word"].to_pylist())
                ends = (width.itemsize * np.concatenate(([0], np.cumsum(size)))).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(width).tobytes())])
                yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], blob], names=["word", "n", "ids"])

    return words.mapInArrow(tidy(encode), "word string, n long, ids binary")


def _spelt(ids: list[np.ndarray], data: np.ndarray, at: np.ndarray) -> list[str]:
    """Texts of arrays of ids: each id's piece, found by the id, one after the other; bytes that are no UTF-8 are replaced."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    size = (at[1:] - at[:-1])[flat]
    raw = data[ranges(at[flat], size)]
    cuts = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *map(len, ids)])].tolist()
    return [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def decode_documents(coded: DataFrame, ids_col: str = "ids", vocab: str | None = None) -> DataFrame:
    """``coded`` with ``decoded``: the text that ids (binary, little-endian 32-bit) spell, from the ids alone.

    Ids are joined with the vocabulary's pieces, a table of fixed size that is sent to all tasks; special tokens
    are spelt out.  Null ids give null, no ids the empty text; an id that the vocabulary lacks is an error."""
    sent = coded.sparkSession.sparkContext.broadcast(pieces(vocab or vocabulary()))
    at = coded.columns.index(ids_col)
    schema = coded.select("*", F.lit(None).cast("string").alias("decoded")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                blobs = part[at].to_pylist()
                texts = _spelt([np.frombuffer(b or b"", "<u4").astype(np.int64) for b in blobs], *sent.value)
                decoded = pa.array([None if b is None else t for b, t in zip(blobs, texts)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(tidy(decode), schema)


def _width(coder) -> np.dtype:
    """How an id is stored in the table."""
    return np.dtype("<u2" if coder.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


class _Head:
    """The words that every task has, and their ids.  Bytes, sizes and ids travel; the table of words is built
    where it is used."""

    def __init__(self, words: list[str], blobs: list[bytes], width: np.dtype) -> None:
        raw = [w.encode() for w in words]
        self.state = np.array([len(w) for w in raw], np.uint16), b"".join(raw), np.array([len(b) // width.itemsize for b in blobs], np.uint16), np.frombuffer(b"".join(blobs), width)

    def __getstate__(self):
        return self.state

    def __setstate__(self, state) -> None:
        word_size, raw, size, packed = state
        self.table = WordTable()
        number = self.table.numbers(Spans(np.frombuffer(raw + bytes(8), np.uint8), word_size.astype(np.int64))) if len(word_size) else np.zeros(0, np.int64)
        self.size, self.offset = np.zeros(len(size), np.int32), np.zeros(len(size), np.int64)
        self.size[number], self.offset[number] = size, np.cumsum(size.astype(np.int64)) - size
        self.pool = packed.astype(np.int32)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded (string) of every whole text.

    A null text counts as empty and has no ids; a null id stays null; repeated rows give repeated
    results; an empty table gives no rows.
    """
    vocab = vocab or vocabulary()
    spark = docs.sparkSession
    rows = ids_and_text(docs, id_col, text_col)
    table = materialize_by(encode_table(word_counts(rows, vocab), vocab), "words", "word")
    top = table.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD_WORDS)
    got = top.select("word", "n", "ids").toArrow()
    least = min(got["n"].to_pylist()) if got.num_rows >= HEAD_WORDS else 0
    long_ = table.where((F.octet_length("word") > HEAD_BYTES) & (F.octet_length("word") <= LONG_BYTES) & (F.col("n") >= LONG_LEAST)).orderBy(F.desc("n"), "word").limit(LONG_WORDS)
    got = pa.concat_tables([got, long_.select("word", "n", "ids").toArrow()])
    head = spark.sparkContext.broadcast(_Head(got["word"].to_pylist(), got["ids"].to_pylist(), _width(encoder(vocab))))
    rest = table.where((F.col("n") <= least) | (F.octet_length("word") > HEAD_BYTES)).select("word", F.col("ids").alias("code"))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = encoder(vocab).special
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts, marks, blocks_ = part["_text"].to_pylist(), part["_print"].to_numpy(), part["block"].to_numpy()
                plain, between = _plain(texts, special)
                owner = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in between])
                words, doc, pos = [], [], []
                seen = np.zeros(len(texts), np.int64)
                for chunk in split(plain):
                    found = head.value.table.numbers(chunk, add=False)
                    own = owner[chunk.row0 + np.repeat(np.arange(len(chunk.first) - 1), np.diff(chunk.first))]
                    per = np.bincount(own, minlength=len(texts))
                    within = np.arange(len(own)) - (np.cumsum(per) - per)[own] + seen[own]
                    seen += per
                    miss = np.flatnonzero(found < 0)
                    words += [chunk.text[a:b] for a, b in zip(chunk.start[miss].tolist(), chunk.end[miss].tolist())]
                    doc.append(own[miss])
                    pos.append(within[miss])
                if words:
                    doc = np.concatenate(doc)
                    place = np.empty(len(doc), _PLACE)
                    place["text"], place["pos"] = marks[doc], np.concatenate(pos)
                    ends = pa.py_buffer((np.arange(len(doc) + 1) * _PLACE.itemsize).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(blocks_[doc]), pa.Array.from_buffers(pa.binary(), len(doc), [None, ends, pa.py_buffer(place.tobytes())])], names=["word", "block", "place"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            block = batch["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            out = []
            for own in np.split(order, cuts) if len(order) else []:
                part = batch.take(pa.array(own)).drop_columns(["block"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                out.append((int(block[own[0]]), coder.compress(sink.getvalue())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["block", "rows"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab)
        special_ids = {t.content: i for i, t in coder.tokenizer.get_added_tokens_decoder().items()}
        for batch in batches:
            for b in range(batch.num_rows):
                raw = zstandard.ZstdDecompressor().decompress(batch["rows"][b].as_py())
                docs_ = pa.ipc.open_stream(raw).read_all()
                keys, texts, prints = docs_[0].to_pylist(), docs_[1].to_pylist(), docs_[2].to_pylist()
                patches: dict = {}
                if batch["patches"][b].is_valid:
                    for patch in batch["patches"][b].as_py():
                        mark, pos = struct.unpack_from(_PLACE_CODE, patch)
                        patches.setdefault(mark, {})[pos] = patch[_PLACE.itemsize :]
                for lo in range(0, len(texts), 64):
                    yield _finish(keys[lo : lo + 64], texts[lo : lo + 64], prints[lo : lo + 64], patches, head.value, special_ids, coder.special, _width(coder))

    # Rows without an id are dealt by their texts.
    block = F.when(F.col("_id") == NULL_ID, F.col("_print")).otherwise(F.floor(F.col("_id") / BLOCK)).alias("block")
    marked = rows.withColumn("_print", F.xxhash64("_text")).select("_id", "_text", "_print", block)
    patches = (
        marked.mapInArrow(tidy(tails), "word string, block long, place binary")
        .join(rest.select("word", "code"), "word")
        .groupBy("block")
        .agg(F.collect_list(F.concat("place", "code")).alias("patches"))
    )
    whole = marked.mapInArrow(tidy(blocks), "block long, rows binary").join(patches, "block", "left").select("rows", "patches")
    out = whole.mapInArrow(tidy(finish), "_id long, n_tokens long, ids binary")
    return decode_documents(out, vocab=vocab).select(public_id(), "n_tokens", "ids", "decoded")


#: Where a joined word stands: the hash of its document's text (documents of a block with equal texts have
#: equal words) and its number there.
_PLACE = np.dtype([("text", "<i8"), ("pos", "<i4")])
_PLACE_CODE = "<qi"


def _finish(keys, texts, prints, patches, head: _Head, special_ids, special, width) -> pa.RecordBatch:
    """Ids of some documents, from the head and the joined ids of other words."""
    plain, between = _plain(texts, special)
    segment_words = np.zeros(len(plain), np.int64)
    numbers = []
    for chunk in split(plain):
        numbers.append(head.table.numbers(chunk, add=False))
        segment_words[chunk.row0 : chunk.row0 + len(chunk.first) - 1] = np.diff(chunk.first)
    number = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    at, segment = 0, 0
    parts: list[np.ndarray] = []
    for mark, cut in zip(prints, between, strict=True):
        segments = segment_words[segment : segment + len(cut) + 1]
        n = int(segments.sum())
        own = number[at : at + n]
        size = np.where(own >= 0, head.size[own] if len(head.size) else 0, 0).astype(np.int64)
        miss = np.flatnonzero(own < 0)
        joined = [patches[mark][int(i)] for i in miss]
        extra = [np.frombuffer(own_ids, width).astype(np.int32) for own_ids in joined]
        size[miss] = [len(x) for x in extra]
        ids = np.empty(int(size.sum()), np.int32)
        to = np.cumsum(size) - size
        known = np.flatnonzero(own >= 0)
        ids[ranges(to[known], size[known])] = head.pool[ranges(head.offset[own[known]], size[known])]
        if extra:
            ids[ranges(to[miss], size[miss])] = np.concatenate(extra)
        ends = np.cumsum(segments)[:-1]
        if cut:
            ids = np.insert(ids, np.append(to, len(ids))[ends], [special_ids[s] for s in cut])
        parts.append(ids)
        at, segment = at + n, segment + len(cut) + 1
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary())], names=["_id", "n_tokens", "ids"])
