"""Vector bin packing of token sequences by the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens) and a sequence has a limit for each: its
prompt's tokens bear no loss, its answer's do.  The next example for an open sequence is the one whose
vector has the largest dot product with the room that is left, among those that fit.  Where none fits,
the one of which most can be placed is cut: documents may be cut freely.  Each task packs its own rows,
so nothing is shuffled; a sequence that stays short is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, pieces, vocabulary
from .common import NULL_ID, public_id, tidy

PIECES = "_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence.  ``tokens`` is also the padded length."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


#: For instruction data: an eighth of a sequence at least is prompts (or padding, which there is none of).
INSTRUCTIONS = Limits(loss=1792)


class _Packer:
    """Packs pieces of one task.  ``pool`` waiting examples at most, or ``MOST_WAITING`` ids of them, are
    looked through."""

    MOST_WAITING = 1 << 22

    def __init__(self, limits: Limits, first_sequence: int, pool: int = 1024) -> None:
        self.limits, self.sequence, self.size = limits, first_sequence, pool
        self.items: list = [None] * (pool + 1)
        self.tokens = np.zeros(pool + 1)
        self.loss = np.zeros(pool + 1)
        self.free = list(range(pool, -1, -1))
        self.rows: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.room, self.segments, self.loss_room, self.held = self.limits.tokens, self.limits.segments, self.limits.loss, []

    @staticmethod
    def _loss(start: int, stop: int, prompt: int) -> int:
        return max(0, stop - max(start, prompt))

    def add(self, doc: int, ids: np.ndarray, prompt: int) -> None:
        """ids: of the whole document; the first ``prompt`` of them bear no loss."""
        total, start = len(ids), 0
        if self.limits.loss >= self.limits.tokens:  # whole sequences at once
            while total - start >= self.limits.tokens:
                stop = start + self.limits.tokens
                self._row(doc, start, ids[start:stop], total, self._loss(start, stop, prompt), self.sequence, 0)
                self.sequence += 1
                start = stop
        if start < total:
            self._wait(doc, start, ids[start:].copy(), total, prompt)
        while len(self.free) <= 1 or self.tokens.sum() > self.MOST_WAITING:
            self._place()

    def _wait(self, doc, start, ids, total, prompt) -> None:
        at = self.free.pop()
        self.items[at] = (doc, start, ids, total, prompt)
        self.tokens[at] = len(ids)
        self.loss[at] = self._loss(start, start + len(ids), prompt)

    def choose(self) -> int:
        """The waiting example whose vector has the largest dot product with the room left, among those that
        fit and, by the part that can be placed, those that no sequence holds whole; if there are none the
        example of which most can be placed."""
        t, s, x = self.limits.tokens, self.limits.segments, self.limits.loss
        waits = self.tokens > 0
        prompt = self.tokens - self.loss  # comes first and needs no room for loss
        part = np.minimum(np.minimum(self.tokens, self.room), prompt + self.loss_room)
        score = part * (self.room / t**2) + np.maximum(part - prompt, 0) * (self.loss_room / x**2) + self.segments / s**2
        able = waits & (part > 0) & ((part == self.tokens) | (self.tokens > t) | (self.loss > x))
        if self.segments == 1 or not able.any():  # the last segment should fill what is left
            able = waits & (part == part[waits].max())
        return int(np.argmax(np.where(able, score, -1.0)))

    def _place(self) -> None:
        """Put one example, or a part of it, into the open sequence."""
        at = self.choose()
        doc, start, ids, total, prompt = self.items[at]
        most = min(self.room, len(ids), max(0, prompt - start) + self.loss_room)
        if most > 0:
            bears = self._loss(start, start + most, prompt)
            self.held.append((doc, start, ids[:most], total, bears))
            self.room, self.segments, self.loss_room = self.room - most, self.segments - 1, self.loss_room - bears
            self.items[at], self.tokens[at], self.loss[at] = None, 0, 0
            self.free.append(at)
            if most < len(ids):
                self._wait(doc, start + most, ids[most:], total, prompt)
        if most <= 0 or not self.room or not self.segments:
            self._close()

    def _row(self, doc, start, ids, total, bears, sequence, offset) -> None:
        self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, bears, sequence, offset))

    def _close(self) -> None:
        """Give out the open sequence; a short one is cut where the binary digits of its length are."""
        held, left = self.held[::-1], self.limits.tokens - self.room
        while left:
            take = left if not self.room else 1 << (left.bit_length() - 1)
            left, offset = left - take, 0
            while offset < take:
                doc, start, ids, total, bears = held.pop()
                n = min(take - offset, len(ids))
                after = min(bears, len(ids) - n)  # loss-bearing ids stand last
                self._row(doc, start, ids[:n], total, bears - after, self.sequence, offset)
                if n < len(ids):
                    held.append((doc, start + n, ids[n:], total, after))
                offset += n
            self.sequence += 1
        self._open()

    def finish(self) -> None:
        while any(x is not None for x in self.items):
            self._place()
        self._close()

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
        names = [f.split()[0] for f in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)


def prompt_chars(text: Column) -> Column:
    """Where a text without a marked prompt is taken to have its answer: after the first end of a sentence or
    line that follows its first quarter (without one, after the quarter)."""
    text = F.coalesce(text, F.lit(""))
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    end = F.regexp_instr(F.substring(text, quarter + 1, F.char_length(text)), F.lit(r"[.!?\n]"))
    return quarter + end


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), end_id: int | None = 1, prompt: Column | None = None, vocab: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    loss_tokens, sequence_id, offset.

    ``prompt``: how many leading characters are a prompt (null or not given: none); tokens that lie wholly
    in it bear no loss.  A null text counts as empty, a null id stays null, repeated rows are packed each.
    Every id of every row lies in exactly one piece; an empty table gives no rows.
    """
    vocab = vocab or vocabulary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab)
        width = np.diff(pieces(vocab)[1])
        packer = _Packer(limits, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, texts, prompts = part[0].to_pylist(), part[1].to_pylist(), part[2].to_pylist()
                for row, ids, offsets in coder.batches(texts):
                    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                        own = ids[a:b] if end_id is None else np.append(ids[a:b], end_id)
                        if len(own):
                            chars, text = prompts[row + i], texts[row + i]
                            head = int(np.searchsorted(np.cumsum(width[ids[a:b]]), chars if text.isascii() else len(text[:chars].encode()), side="right")) if chars else 0
                            packer.add(keys[row + i], own, head)
                    if len(packer.rows) > 2000:
                        yield packer.take()
        packer.finish()
        yield packer.take()

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.greatest(F.coalesce(prompt, F.lit(0)) if prompt is not None else F.lit(0), F.lit(0)).cast("long").alias("_prompt"),
    )
    out = rows.mapInArrow(tidy(pack), PIECES)
    return out.select(public_id(), *[c for c in out.columns if c != "_id"])


def pack_instructions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = INSTRUCTIONS) -> DataFrame:
    """``pack_documents`` of texts as prompts (``prompt_chars``) and answers, under limits that bind on all three."""
    return pack_documents(docs, id_col, text_col, limits, prompt=prompt_chars(F.col(text_col)))
