"""Vectorised helpers over Arrow string columns, shared by the operators of this subpackage.

Texts are handled as UTF-8 bytes in blocks of a bounded number of bytes (one text at least), so the
working memory of a task does not follow the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 1 << 18
#: The code points of white space.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD = _U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> _U(32))
    h *= _WORD
    h ^= h >> _U(29)
    h *= _WORD
    h ^= h >> _U(32)
    return h


#: Prime modulus of the prefix sums, and the two bases (fixed, drawn at random) of its polynomials.
_PRIME = (1 << 31) - 1
_M = _U(_PRIME)
_SHIFT = _U(31)
_BASES = (1_263_508_417, 726_199_043)

with np.errstate(over="ignore"):
    _CODES = [mix(np.arange(1, 257, dtype=_U) * _U(_BASE) + _U(k)) >> _U(33) for k in (0, 1 << 40)]

_powers: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, but for a multiple that's left of small size."""
    return (x & _M) + (x >> _SHIFT)


def _power(base: int, n: int) -> np.ndarray:
    """Powers of base modulo the prime."""
    if len(_powers.get(base, ())) < n:
        table, step = np.ones(1, dtype=_U), base
        while len(table) < max(n, BLOCK_BYTES + 1):
            table = np.concatenate([table, _fold(_fold(table * _U(step)))])
            step = step * step % _PRIME
        _powers[base] = table
    return _powers[base][:n]


class Hashes:
    """Hashes of any byte spans of one block: two polynomials modulo a prime from prefix sums, and the length."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self._sums = []
        for codes, base in zip(_CODES, _BASES, strict=True):
            sums = np.zeros(self.n + 1, dtype=_U)
            np.cumsum(_fold(codes[data] * _power(base, self.n + 1)[: self.n]), out=sums[1:])
            self._sums.append(sums)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (end - start).astype(_U) * _WORD
        for k, (sums, base) in enumerate(zip(self._sums, _BASES, strict=True)):
            x = _fold(_fold(_fold(_fold(sums[end] - sums[start])) * _power(pow(base, -1, _PRIME), self.n + 1)[start]))
            x[x >= _M] -= _M
            out += x << (_SHIFT * _U(k))
        return mix(out)


#: Spans of more bytes are hashed as polynomials, so that no loop follows the longest of them.
_LANES = 16


def _words_at(data: np.ndarray, step: int = 1) -> np.ndarray:
    """Eight bytes as a number from every step-th byte, zeros behind the last."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) // step + 1, "<u8", wide.data, strides=(step,))


def _bytes_of(data: np.ndarray) -> tuple[np.ndarray, int]:
    return np.ascontiguousarray(data).view(np.uint8), data.itemsize


def _stir(out: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ((out ^ (out >> _U(32))) + word) * _WORD


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k bytes or code points from every start."""
    raw, step = _bytes_of(data)
    n, size = len(data) - k + 1, k * step
    if n <= 0:
        return np.empty(0, dtype=_U)
    if size < 8:
        return span_hashes(data, np.arange(n), np.arange(n) + k)
    out = np.zeros(n, dtype=_U)
    for at in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out = _stir(out, np.ndarray(n, "<u8", raw.data, at, (step,)))
    return mix(out + _U(size * _BASE % (1 << 64)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes or code points, mixed from 8-byte words; of long ones from two polynomials modulo a prime."""
    raw, step = _bytes_of(data)
    first, size = np.asarray(start) * step, (np.asarray(end) - start) * step
    words = _words_at(raw)
    out = size.astype(_U) * _U(_BASE)
    some, k = np.flatnonzero((size > 0) & (size <= 8 * _LANES)), 0
    while len(some):
        left = np.minimum(size[some] - 8 * k, 8).astype(_U)
        out[some] = _stir(out[some], words[first[some] + 8 * k] & (~_U(0) >> (_U(64) - left * _U(8))))
        k += 1
        some = some[size[some] > 8 * k]
    out = mix(out)
    long = np.flatnonzero(size > 8 * _LANES)
    if len(long):
        ends = np.cumsum(size[long])
        out[long] = Hashes(gather(raw, first[long], size[long])).spans(ends - size[long], ends)
    return out


def piece_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of byte spans, and which of them are hashes: spans of up to 7 bytes are their own key, so only others can collide."""
    size = end - start
    short = np.minimum(size, 7).astype(_U)
    keys = (_words_at(data)[start] & ((_U(1) << (short * _U(8))) - _U(1))) | (short << _U(56))
    hashed = size > 7
    keys[hashed] = span_hashes(data, start[hashed], end[hashed]) | _U(1 << 63)
    return keys, hashed


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` bytes from a and from b differ."""
    words = _words_at(data)
    out = np.zeros(len(a), dtype=bool)
    some, k = np.flatnonzero((a != b) & (size > 0)), 0
    while len(some):
        left = np.minimum(size[some] - 8 * k, 8).astype(_U)
        x = words[a[some] + 8 * k] ^ words[b[some] + 8 * k]
        out[some] |= (x & (~_U(0) >> (_U(64) - left * _U(8)))) != 0
        k += 1
        some = some[(size[some] > 8 * k) & ~out[some]]
        if k == _LANES:
            for i in some.tolist():
                out[i] = data[a[i] : a[i] + size[i]].tobytes() != data[b[i] : b[i] + size[i]].tobytes()
            break
    return out


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true within each row: starts, ends, and the first run of each row (one more at the end)."""
    n = len(inside)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each `size` consecutive word hashes."""
    m = len(words) - size + 1
    if m <= 0:
        return np.empty(0, dtype=_U)
    out = words[:m].copy()
    for j in range(1, size):
        out *= _U(_BASE)
        out += words[j : m + j]
    return mix(out)


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Indices of the words from which `size` words of the same row follow. bounds: the first word of each row."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(bounds[0], bounds[-1])
    return at[at + size <= ends]


@cache
def _libc():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Gives memory that a task has freed back, as Python workers live on."""
    pa.default_memory_pool().release_unused()
    if release := _libc():
        release(0)


def lut(kept: Iterator[int] | range | list[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(kept)] = True
    return table


#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space (0x20 and 0x09 to 0x0D).
NOT_SPACE = lut([b for b in range(256) if b != 0x20 and not 9 <= b <= 13])
#: Bytes of words of digits, a-z and anything outside ASCII, once lower-cased.
ALNUM = lut([b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80])


@cache
def code_classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for every code point."""
    kinds = {"L": 1, "N": 2}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], 3) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    table[SPACES] = 0
    return table


@cache
def lower_codes() -> np.ndarray:
    """The lower case of every code point that has one of a single code point."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a block, and the offsets of its rows in them."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    return codes, offsets if len(codes) == len(data) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of a block, and starts, ends and row bounds of its maximal runs of letters."""
    codes, at = code_points(data, offsets)
    codes = lower_codes()[codes]
    return codes, *runs(code_classes()[codes] == 1, at)


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of values, one after another."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


def strings(values: list) -> pa.Array:
    return pa.array(values, type=pa.string())


def udf(ddl: str):
    """An Arrow UDF that is made when it's first applied, as a DDL type needs a session."""

    def wrap(fn):
        def apply(*columns):
            from pyspark.sql import functions as F

            return F.arrow_udf(fn, ddl)(*columns)

        apply.__doc__ = fn.__doc__
        return apply

    return wrap


@udf("binary")
def packed(texts: pa.Array) -> pa.Array:
    """Texts compressed for the way through a shuffle."""
    pack = zstandard.ZstdCompressor(level=6)
    return pa.array([pack.compress(x.as_buffer()) if x.is_valid else None for x in texts], pa.binary())


def unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x.as_buffer()) if x.is_valid else b"" for x in column], pa.large_binary())
