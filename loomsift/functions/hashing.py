"""64-bit FNV-1a in built-in expressions: a state of two 32-bit limbs, so nothing overflows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: offset basis, and the prime 2**40 + 0x1B3.
BASIS, LOW_PRIME = 0xCBF29CE484222325, 0x1B3
_LIMB = 1 << 32


def fnv1a_limbs(c: Column) -> Column:
    """struct<hi, lo> of a string's UTF-8 bytes."""
    hexed = F.hex(F.encode(c, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), lambda i: F.conv(F.substring(hexed, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.length(hexed) > 0, codes).otherwise(F.array().cast("array<bigint>"))

    def step(state: Column, byte: Column) -> Column:
        lo = state["lo"].bitwiseXOR(byte)
        low = lo * LOW_PRIME
        high = state["hi"] * LOW_PRIME + F.floor(low / _LIMB) + lo * 256
        return F.struct((high % _LIMB).cast("long").alias("hi"), (low % _LIMB).cast("long").alias("lo"))

    start = F.struct(F.lit(BASIS >> 32).cast("long").alias("hi"), F.lit(BASIS & (_LIMB - 1)).cast("long").alias("lo"))
    return F.aggregate(codes, start, step)


def bucket_and_sign(c: Column, dim: int) -> Column:
    """struct<idx, sign> of a token: hash modulo ``dim``, and 1 or -1 by bit 51."""
    def body(h: Column) -> Column:
        idx = ((h["hi"] % dim) * (_LIMB % dim) + h["lo"] % dim) % dim
        odd = F.shiftright(h["hi"], 19).bitwiseAND(1)
        return F.struct(idx.cast("int").alias("idx"), (1 - 2 * odd).cast("int").alias("sign"))

    return F.transform(F.array(fnv1a_limbs(c)), body)[0]


def bucket_and_sign_sql(x: str, dim: int) -> tuple[str, str]:
    h = (
        f"list_reduce(list_prepend({BASIS}::HUGEINT, list_transform(range(0, strlen({x})), lambda i: "
        f"('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2))::INT::HUGEINT)), lambda s, b: (xor(s, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    )
    return f"CAST({h} % {dim} AS INTEGER)", f"CAST(1 - 2 * (({h} // 2251799813685248::HUGEINT) % 2) AS INTEGER)"


def hashed_cells(names: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``bucket_and_sign`` of all strings of an Arrow array: byte by byte, all strings at a time."""
    raw = names.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    size, state = np.diff(ends), np.full(len(raw), BASIS, np.uint64)
    prime = np.uint64((1 << 40) + LOW_PRIME)
    own, k = np.flatnonzero(size > 0), 0
    while len(own):
        state[own] = (state[own] ^ data[ends[own] + k]) * prime
        k += 1
        own = own[size[own] > k]
    return (state % np.uint64(dim)).astype(np.int64), 1 - 2 * ((state >> np.uint64(51)) & np.uint64(1)).astype(np.int64)
