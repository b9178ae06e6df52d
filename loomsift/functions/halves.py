"""16-bit floating point numbers by arithmetic on doubles: there is no such type, so vectors are kept as
their bit patterns, two bytes a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least exponent of normal numbers, bits of a fraction, largest finite number.
LEAST, FRACTION, MOST = -14, 10, 65504.0


def half_bits(x: Column) -> Column:
    """The bit pattern (0 to 65535) of the nearest half, ties to even; beyond the largest it is infinity."""

    def body(size: Column) -> Column:
        e = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-30)))), F.lit(LEAST))
        # The fraction counts on from the exponent, so one that rounds up to the next power carries over.
        return F.least((F.rint(size * F.pow(F.lit(2.0), FRACTION - e)) + (e - LEAST) * 1024).cast("int"), F.lit(0x7C00))

    return F.transform(F.array(F.abs(x.cast("double"))), body)[0] + F.when(x < 0, 0x8000).otherwise(0)


def from_bits(bits: Column) -> Column:
    """The number of a bit pattern as a double."""
    size, e = bits % 0x8000, F.floor(bits % 0x8000 / 1024)
    plain = F.when(e == 0, size * F.lit(2.0**-24)).otherwise((1024 + size % 1024) * F.pow(F.lit(2.0), e - 25))
    return F.when(bits >= 0x8000, -plain).otherwise(plain)


def half_bits_sql(x: str) -> str:
    e = f"greatest(floor(log2(greatest(abs({x}), 1e-30))), {LEAST})"
    return f"CAST(least(round_even(abs({x}) * pow(2.0, {FRACTION} - {e}), 0) + ({e} - {LEAST}) * 1024, {0x7C00}) AS INTEGER) + CASE WHEN {x} < 0 THEN {0x8000} ELSE 0 END"


def from_bits_sql(b: str) -> str:
    size = f"({b} % {0x8000})"
    plain = f"CASE WHEN {size} // 1024 = 0 THEN {size} * pow(2.0, -24) ELSE (1024 + {size} % 1024) * pow(2.0, {size} // 1024 - 25) END"
    return f"(CASE WHEN {b} >= {0x8000} THEN -1 ELSE 1 END * ({plain}))"
