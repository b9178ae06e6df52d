"""Byte-level BPE over whole Arrow batches.

``split`` finds the words of the byte-level pattern with array operations on code points; ``WordTable``
numbers distinct words, where a hash finds a word and its bytes decide; ``Encoder`` keeps the ids of the
numbered words, so that a word is encoded once and looked up after.  The vocabulary file is a parameter
and is read by path on each executor.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np

from .kernels import ranges, same_spans, span_hashes

SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SENTINEL = 0x110000
CHUNK_CHARS = 1 << 19


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _classes() -> np.ndarray:
    kind = np.full(_SENTINEL + 1, OTHER, dtype=np.uint8)
    for code in range(_SENTINEL):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            kind[code] = LETTER
        elif major == "N":
            kind[code] = NUMBER
    kind[WHITE_SPACE] = SPACE
    kind[_SENTINEL] = BREAK
    return kind


class Chunk:
    """Words of some documents: ``text[start:end]`` by code point, ``first`` delimits documents."""

    def __init__(self, row0: int, texts: list[str]) -> None:
        self.row0 = row0
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text = "\n".join(texts) + "\n"
        points = np.frombuffer(self.text.encode("utf-32-le"), "<u4").copy()
        self.breaks = np.cumsum(sizes + 1) - 1
        points[self.breaks] = _SENTINEL
        self.start, self.end = _spans(points)
        self.first = np.searchsorted(self.start, np.concatenate(([0], self.breaks + 1)))
        raw = self.text.encode()
        #: UTF-8 bytes, with eight to spare, and the words' places there.
        self.data = np.frombuffer(raw + bytes(8), np.uint8)
        if len(raw) == len(points):
            self.byte_start, self.byte_end = self.start, self.end
        else:
            points[self.breaks] = 0x0A
            wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate(([0], np.cumsum(wide)))
            self.byte_start, self.byte_end = at[self.start], at[self.end]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.byte_start, self.byte_end)


def _spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` matches."""
    kind = _classes()[points]
    n = len(kind)
    begin = np.ones(n + 1, dtype=bool)
    begin[1:n] = kind[1:] != kind[:-1]
    # A run of white space before other text gives up its last character: a plain space joins the
    # next word, any other one stands alone.
    tail = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
    begin[tail] = True
    begin[tail[points[tail] == 0x20] + 1] = False
    # Contractions: a lone apostrophe that starts a word takes the letters after it.
    quote = np.flatnonzero((points[: n - 1] == 0x27) & begin[: n - 1] & begin[1:n] & (kind[1:n] == LETTER))
    if len(quote):
        a = points[quote + 1]
        b = points[np.minimum(quote + 2, n - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        begin[quote[one | two] + 1] = False
        for hit, size in ((one, 2), (two & ~one, 3)):
            after = quote[hit] + size
            begin[after[kind[after] == LETTER]] = True
    start = np.flatnonzero(begin[:n] & (kind != BREAK))
    stop = np.flatnonzero(begin | np.append(kind == BREAK, True))
    return start, stop[np.searchsorted(stop, start, side="right")]


def split(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[Chunk]:
    row = 0
    while row < len(texts):
        to, size = row, 0
        while to < len(texts) and (to == row or size + len(texts[to]) <= limit):
            size += len(texts[to]) + 1
            to += 1
        yield Chunk(row, texts[row:to])
        row = to


def _visible() -> dict[str, int]:
    """Byte-level BPE writes each byte as a visible character: this is the way back."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class HashTable:
    """Open addressing from 64-bit keys to consecutive numbers, looked up an array at a time."""

    def __init__(self, bits: int = 16) -> None:
        self.n = 0
        self._resize(bits)
        self.all = np.zeros(0, dtype=np.uint64)

    def _resize(self, bits: int) -> None:
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        out = self.values[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.values[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new, distinct keys from ``n`` on."""
        self.all = np.concatenate((self.all, keys))
        if 2 * len(self.all) > len(self.keys):
            self._resize(int(2 * len(self.all)).bit_length())
            keys, number = self.all, np.arange(len(self.all), dtype=np.int32)
        else:
            number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n = len(self.all)
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.values[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], number[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            todo = todo[left[todo]]
            at[todo] = np.where(self.values[at[todo]] >= 0, (at[todo] + 1) & self.mask, at[todo])


class Spans:
    """Words that follow each other in ``data``, which has eight bytes to spare."""

    def __init__(self, data: np.ndarray, size: np.ndarray) -> None:
        self.data, self.byte_end = data, np.cumsum(size)
        self.byte_start = self.byte_end - size

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.byte_start, self.byte_end)


class WordTable:
    """Consecutive numbers of distinct words.  Words whose hash belongs to another word are kept by text."""

    def __init__(self) -> None:
        self.table, self.other = HashTable(), {}
        self.pool, self.used = np.zeros(1 << 16, np.uint8), 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def n(self) -> int:
        return self.table.n

    def words(self, first: int = 0) -> list[str]:
        """The words from number ``first`` on."""
        raw, base = self.pool[self.at[first] if first < self.n else self.used : self.used].tobytes(), 0
        out = []
        for size in self.size[first:].tolist():
            out.append(raw[base : base + size].decode())
            base += size
        return out

    def _store(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        total = int(size.sum())
        if self.used + total + 8 > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(self.used, total) + total + 8, np.uint8)))
        self.pool[self.used : self.used + total] = data[ranges(start, size)]
        self.at = np.concatenate((self.at, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.used += total
        self.table.add(keys)

    def numbers(self, chunk: Chunk | Spans, add: bool = True) -> np.ndarray:
        """The number of each word; without ``add``, -1 for words that have none."""
        h, start = chunk.hashes(), chunk.byte_start
        size = chunk.byte_end - start
        found = self.table.find(h)
        missing = np.flatnonzero(found < 0)
        if add and len(missing):
            keys, one = np.unique(h[missing], return_index=True)
            one = missing[one]
            self._store(keys, chunk.data, start[one], size[one])
            found[missing] = self.table.find(h[missing])
        if not self.n:
            return found
        known = np.maximum(found, 0)
        differs = (found >= 0) & (self.size[known] != size)
        same = np.flatnonzero((found >= 0) & ~differs)
        differs[same] = ~same_spans(self.pool, self.at[found[same]], chunk.data, start[same], size[same])
        for i in np.flatnonzero(differs).tolist():
            word = chunk.data[start[i] : start[i] + size[i]].tobytes()
            if word not in self.other:
                if not add:
                    found[i] = -1
                    continue
                key = next(k for k in range(len(self.other), 1 << 62) if self.table.find(np.array([k], np.uint64))[0] < 0)
                self.other[word] = self.n
                self._store(np.array([key], np.uint64), chunk.data, start[i : i + 1], size[i : i + 1])
            found[i] = self.other[word]
        return found


class Encoder:
    """Ids of whole documents, as the tokenizers library gives them for the same file."""

    #: Words, and bytes of words, kept before the table starts anew: they bound the memory, not the results.
    MOST_WORDS, MOST_BYTES = 1_500_000, 1 << 26

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast(path)
        self.line_feed = self.fast and self.fast.encode_ordinary("\n")[0]
        self._clear()

    def _clear(self) -> None:
        self.table, self.pool, self.used = WordTable(), np.zeros(1 << 16, np.int32), 0
        self.offset, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _fast(self, path: str):
        """The same merges in a faster library, with line feeds as the only piece borders; None
        where ids don't follow the order of merges, as that library needs."""
        import tiktoken

        model = json.loads(Path(path).read_text())["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [vocab["".join(m)] for m in merges]
        if order != sorted(order) or any(v >= order[0] for k, v in vocab.items() if len(k) == 1):
            return None
        to_byte = _visible()
        ranks = {bytes(map(to_byte.__getitem__, k)): v for k, v in vocab.items() if k not in self.special}
        return tiktoken.Encoding("own", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of single words, and how many each word has."""
        slow = [i for i, w in enumerate(words) if "\n" in w or not w] if self.fast else range(len(words))
        own = self.ids_of([words[i] for i in slow])
        size = np.zeros(len(words), np.int32)
        size[list(slow)] = [len(x) for x in own]
        if not self.fast:
            return np.fromiter((x for ids in own for x in ids), np.int32, int(size.sum())), size
        for i in slow:
            words[i] = "-"
        flat = self.fast.encode_to_numpy("\n".join(words)).astype(np.int32)
        cut = np.flatnonzero(flat == self.line_feed)
        parts = np.diff(np.concatenate(([-1], cut, [len(flat)]))) - 1
        flat = np.delete(flat, cut)
        if slow:
            pieces_ = np.split(flat, np.cumsum(parts)[:-1])
            for i, ids in zip(slow, own, strict=True):
                pieces_[i] = np.array(ids, np.int32)
            flat = np.concatenate(pieces_)
            parts[list(slow)] = size[list(slow)]
        return flat, parts.astype(np.int32)

    def numbers(self, chunk: Chunk) -> np.ndarray:
        """The table's number of each word of the chunk; new words are encoded, each once."""
        before = self.table.n
        found = self.table.numbers(chunk)
        if self.table.n > before:
            flat, size = self.encode_words(self.table.words(before))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.pool[self.used : self.used + len(flat)] = flat
            self.offset = np.concatenate((self.offset, self.used + np.cumsum(size) - size))
            self.length = np.concatenate((self.length, size))
            self.used += len(flat)
        return found

    def batches(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of all rows, offsets per row) by chunk of rows."""
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = texts if not special else ["" if i in set(special) else t for i, t in enumerate(texts)]
        for chunk in split(plain):
            if self.table.n > self.MOST_WORDS or self.table.used > self.MOST_BYTES:
                self._clear()
            number = self.numbers(chunk)
            size = self.length[number]
            ids = self.pool[ranges(self.offset[number], size)]
            total = np.concatenate(([0], np.cumsum(size)))
            offsets = total[chunk.first]
            rows = [i for i in special if chunk.row0 <= i < chunk.row0 + len(offsets) - 1]
            if rows:  # these texts hold a special token's string, which the library cuts out first
                parts = np.split(ids, offsets[1:-1])
                for i, own in zip(rows, self.ids_of([texts[i] for i in rows]), strict=True):
                    parts[i - chunk.row0] = np.array(own, np.int32)
                ids = np.concatenate(parts)
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            yield chunk.row0, ids, offsets


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


@functools.cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Id-to-piece table: all pieces' bytes and their offsets by id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    to_byte = _visible()
    added = tokenizer.get_added_tokens_decoder()
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        out.append(added[i].content.encode() if i in added else bytes(to_byte[c] for c in tokenizer.id_to_token(i)))
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in out])))
    return np.frombuffer(b"".join(out), np.uint8), offsets
