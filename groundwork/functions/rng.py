"""Counter-based uniform numbers as column expressions: any draw at any place, with no state and no UDF."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Increment and odd parts of the 32-bit generator.
STEP = 0x6D2B79F5
_M = 1 << 32


def _times(a: Column, b: Column) -> Column:
    """a * b modulo 2**32 without leaving 64 bits: b in two halves."""
    high = F.pmod(a * F.shiftright(b, 16), F.lit(1 << 16)) * (1 << 16)
    return F.pmod(high + a * b.bitwiseAND(0xFFFF), F.lit(_M))


def uniform(seed: Column, k: Column) -> Column:
    """The k-th number in [0, 1) of a seed."""
    t = F.pmod(seed.cast("long") + F.pmod((k.cast("long") + 2) * STEP, F.lit(_M)), F.lit(_M))
    t = _times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(1))
    t = t.bitwiseXOR(F.pmod(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61)), F.lit(_M)))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(float(_M))


def uniform_sql(seed: str, k: str) -> str:
    """The same number as a DuckDB expression over 128-bit integers."""
    m = "4294967296::HUGEINT"
    t0 = f"((({seed})::HUGEINT + (({k})::HUGEINT + 2) * {STEP}) % {m})"
    t1 = f"((xor({t0}, {t0} >> 15) * ({t0} | 1::HUGEINT)) % {m})"
    t2 = f"xor({t1}, ({t1} + (xor({t1}, {t1} >> 7) * ({t1} | 61::HUGEINT)) % {m}) % {m})"
    return f"(xor({t2}, {t2} >> 14)::DOUBLE / 4294967296.0)"


def uniform_values(seed: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The same numbers of arrays that broadcast."""
    low, word = np.uint64(_M - 1), np.uint64
    t = (np.asarray(seed).astype(np.int64).astype(word) + (np.asarray(k).astype(word) + word(2)) * word(STEP)) & low
    t = ((t ^ (t >> word(15))) * (t | word(1))) & low
    t = t ^ ((t + (((t ^ (t >> word(7))) * (t | word(61))) & low)) & low)
    return (t ^ (t >> word(14))) / float(_M)
