"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, letters a-z (after lower-casing A-Z) and anything outside ASCII. A window is ten
consecutive words of an item (a shorter, not empty item is one window). Texts are scanned where they lie, so
nothing is shuffled; hits on a hash are verified word by word.

The windows are broadcast in blocks of a fixed number, so what an executor holds is bounded whatever the
benchmark's size: the usual benchmark is one block; a larger one takes a checkpointed pass for each block.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no window; an
item without id counts under the empty id; repeated items count once; an empty benchmark hits nothing; rows
(repeated ids too) come out one for one, with their other columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW = 10
#: Windows in one broadcast: about 100 bytes each with their words.
BLOCK_WINDOWS = 500_000
_BITS = 22
_SCAN = "struct<n_words: long, ranges: array<long>, items: array<string>>"


def words_of(text: str | None) -> list[bytes]:
    data = K.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    return np.where(K.ALNUM[data], data, 32).astype(np.uint8).tobytes().split()


class NgramSet:
    """Windows of items: for each size the sorted hashes, a bit table before them, and the words to verify."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        self.sizes = {size: self._index(size, windows) for size, windows in found.items()}

    @staticmethod
    def _index(size: int, windows: dict[tuple[bytes, ...], set[str]]) -> tuple:
        flat = [w for words in windows for w in words]
        ends = np.cumsum([len(w) for w in flat])
        starts = np.concatenate([[0], ends[:-1]])
        hashed = K.rolling(K.span_hashes(np.frombuffer(b"".join(flat), dtype=np.uint8), starts, ends), size)[::size]
        by_hash: dict[int, list] = {}
        for h, (words, owners) in zip(hashed.tolist(), windows.items(), strict=True):
            by_hash.setdefault(h, []).append((words, sorted(owners)))
        bits = np.zeros(1 << _BITS, dtype=bool)
        bits[hashed >> np.uint64(64 - _BITS)] = True
        return np.unique(hashed), bits, by_hash

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words lie in an occurrence, and the items found in each row that has any."""
        hit, items = np.zeros(len(starts), dtype=bool), {}
        words = K.span_hashes(data, starts, ends)
        for size, (keys, bits, by_hash) in self.sizes.items():
            at = K.window_starts(bounds, size)
            hashed = K.rolling(words, size)[at]
            some = np.flatnonzero(bits[hashed >> np.uint64(64 - _BITS)])
            some = some[np.isin(hashed[some], keys)]
            rows = np.searchsorted(bounds, at[some], side="right") - 1
            for i, h, row in zip(at[some].tolist(), hashed[some].tolist(), rows.tolist(), strict=True):
                said = tuple(data[starts[j] : ends[j]].tobytes() for j in range(i, i + size))
                for window, owners in by_hash[h]:
                    if window == said:
                        hit[i : i + size] = True
                        items.setdefault(row, set()).update(owners)
        return hit, items


def _scanner(shared):
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ngrams = shared.value
        for column in batches:
            out = []
            for _, _, raw, offsets in K.blocks(column):
                data = K.LOWER[raw]
                starts, ends, bounds = K.runs(K.ALNUM[data], offsets)
                hit, items = ngrams.scan(data, starts, ends, bounds)
                first, last, runs = K.runs(hit, bounds)
                for row in range(len(offsets) - 1):
                    a, b = runs[row], runs[row + 1]
                    ranges = [] if a == b else np.column_stack([first[a:b] - bounds[row], last[a:b] - bounds[row], starts[first[a:b]] - offsets[row], ends[last[a:b] - 1] - offsets[row]]).ravel().tolist()
                    out.append({"n_words": int(bounds[row + 1] - bounds[row]), "ranges": ranges, "items": sorted(items.get(row, ()))})
            yield pa.array(out, type=pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    return F.arrow_udf(scan, _SCAN)


def _union(ranges: list[int], k: int) -> list[tuple[int, int]]:
    """Merged (start, end) of the k-th pair in each group of four."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(ranges[2 * k :: 4], ranges[2 * k + 1 :: 4], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@K.udf("struct<n_hit: long, items_sha256: string>")
def _digest(ranges: pa.Array, items: pa.Array) -> pa.Array:
    hits = [sum(b - a for a, b in _union(r, 0)) for r in ranges.to_pylist()]
    none = hashlib.sha256(b"").hexdigest()
    ids = [hashlib.sha256(",".join(sorted(set(x))).encode()).hexdigest() if x else none for x in items.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(hits, pa.int64()), pa.array(ids, pa.string())], ["n_hit", "items_sha256"])


@K.udf("string")
def _without(text: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for x, r in zip(text.to_pylist(), ranges.to_pylist(), strict=True):
        if r:
            data, at, kept = x.encode(), 0, []
            for a, b in _union(r, 1):
                kept.append(data[at:a])
                at = b
            x = b"".join([*kept, data[at:]]).decode()
        out.append(x)
    return pa.array(out, pa.string())


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, name: str = "leak") -> DataFrame:
    """df with a struct column `name` (in the place of one of that name): n_words, n_hit, n_items, items, items_sha256, ranges, contaminated.

    ranges holds, four numbers each, the first word, the word after the last, the first byte and the byte after
    the last of every maximal hit. remove_spans() cuts them out; filtering on contaminated removes whole texts.
    """
    spark = df.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    most = items.agg(F.sum(F.length("t"))).first()[0] or 0  # no item has more windows than characters
    n = max(1, math.ceil(most / 4 / block_windows))
    out = df
    found = F.lit(None).cast(_SCAN)
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        shared = spark.sparkContext.broadcast(NgramSet([tuple(r) for r in block.collect()], window))
        scanned = _scanner(shared)(F.col(text))
        if n == 1:
            out = out.withColumn(name, scanned)
        else:
            out = out.withColumn(f"_{name}_next", scanned)
            found = F.col(f"_{name}_next") if k == 0 else F.struct(F.col(f"_{name}_next.n_words").alias("n_words"), F.concat(f"{name}.ranges", f"_{name}_next.ranges").alias("ranges"), F.array_union(f"{name}.items", f"_{name}_next.items").alias("items"))
            out = out.withColumn(name, found).drop(f"_{name}_next").checkpoint()
    out = out.withColumn(f"_{name}_digest", _digest(F.col(f"{name}.ranges"), F.col(f"{name}.items")))
    at = lambda c: F.col(f"{name}.{c}").alias(c)
    made = F.struct(at("n_words"), F.col(f"_{name}_digest.n_hit").alias("n_hit"), F.size(f"{name}.items").cast("long").alias("n_items"), at("items"), F.col(f"_{name}_digest.items_sha256").alias("items_sha256"), at("ranges"), (F.size(f"{name}.ranges") > 0).alias("contaminated"))
    return out.withColumn(name, made).drop(f"_{name}_digest")


def remove_spans(df: DataFrame, text: str = "text", name: str = "leak") -> DataFrame:
    """Cuts the hit spans out of the texts of decontaminate()'s result."""
    return df.withColumn(text, _without(F.col(text), F.col(f"{name}.ranges")))
