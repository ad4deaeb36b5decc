"""Exact removal of repeated word windows by difference-cover anchors.

COVER is a difference cover modulo PERIOD: of any two places, some shift under PERIOD takes both to places that are in COVER modulo PERIOD. So
two equal windows of LENGTH words, wherever they begin, share an anchor of LENGTH - PERIOD + 1 words that begins at a cover place in both, at
the same distance from the windows' beginnings. Only anchors at cover places are hashed; what has none in common can't be equal.

1. A block of texts sends each distinct anchor with its reach, the words within PERIOD - 1 of it on either side, as two hashes.
2. Spark groups by anchor. Where two places share the reach too, all windows around the anchor are repeated, and nothing more is asked.
   Where an anchor has several reaches, the match ends nearby: those with a reach of their own, and one block for each shared reach, are asked
   for windows.
3. The asked blocks extend these anchors to each window around them and send the windows' hashes; Spark counts them and answers with the repeated ones.
4. The block removes the words of both kinds.

No pairs are made: copies meet as equal keys, and a block sends a key once, however often it has it. A key of all blocks makes one row a block.
Texts go, compressed, through one shuffle, which all steps read. Keys have two 64-bit hashes.

Defined results: a null text has no words and keeps the empty text; ids play no part, so null and repeated ids are texts like others; texts under LENGTH words stay
whole; a window that overlaps its own repetition counts as repeated. A text is held whole by one task, and so is a block, of HELD bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

LENGTH = 35
#: A perfect difference set, in which each difference modulo 21 occurs once.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = LENGTH - PERIOD + 1
#: Bytes of texts in a block at most (but for a longer text), and at least where there are fewer than partitions.
HELD, LEAST = 8_000_000, 1_000_000
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xA0761D6478BD642F)


def _pair(x: np.ndarray, y: np.ndarray, factor: np.uint64 = _A) -> np.ndarray:
    return K.mix(x * factor + (y ^ (y >> _U(31))) * _B + _C)


class _Block:
    """The words of a block's texts: bytes, first byte and size of each word, first word of each text, hashes, and the anchors."""

    def __init__(self, column: pa.Array):
        data, start, size, hashes, count, base = [], [], [], [], [0], 0
        for _, _, raw, at in K.blocks(K.unpacked(column)):
            a, b, of = K.runs(K.NOT_SPACE[raw], at)
            hashes.append(K.span_hashes(raw, a, b))
            start.append(a + base)
            size.append(b - a)
            count.extend((of[1:] + count[-1]).tolist())
            data.append(raw)
            base += len(raw)
        none = np.empty(0, np.int64)
        self.data, self.start, self.size = np.concatenate([*data, np.zeros(1, np.uint8)]), np.concatenate([*start, none]), np.concatenate([*size, none])
        self.bounds = np.array(count, dtype=np.int64)
        self._anchors(np.concatenate([*hashes, np.empty(0, _U)]))

    def _anchors(self, words: np.ndarray) -> None:
        """p: places of anchors; low, high: their reach; a, w: hashes of both; half: hashes of each 32 words."""
        by = {1: words}
        for k in (1, 2, 4, 8, 16):
            by[2 * k] = _pair(by[k][:-k], by[k][k:]) if len(by[k]) > k else np.empty(0, _U)
        self.half, eight = by[32], by[8]
        n = np.repeat(np.diff(self.bounds), np.diff(self.bounds))
        at = np.arange(len(words)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        covered = np.zeros(PERIOD, dtype=bool)
        covered[list(COVER)] = True
        p = np.flatnonzero(covered[at % PERIOD] & (at + ANCHOR <= n) & (n >= LENGTH))
        self.low = p - np.minimum(at[p], PERIOD - 1)
        self.high = p + np.minimum(n[p] - at[p], LENGTH)
        self.a = _pair(eight[p], eight[p + ANCHOR - 8])
        self.w = _pair(self.half[self.low], self.half[self.high - 32]) + K.mix((p - self.low).astype(_U) * _U(64) + (self.high - p).astype(_U))
        self.key = _pair(self.a, self.w)

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Where the windows around the chosen anchors begin."""
        edge = np.zeros(len(self.start) + 1, np.int32)
        np.add.at(edge, self.low[chosen], 1)
        np.add.at(edge, self.high[chosen] - LENGTH + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    def names(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = self.half[begin], self.half[begin + LENGTH - 32]
        return _pair(first, last), _pair(last, first, _C)

    def state(self, replies: pa.Table) -> np.ndarray:
        """What was answered for each anchor: 1 all its windows are repeated, 2 its windows are asked for."""
        keep = replies["state"].to_numpy() < 4
        key = _pair(replies["x"].to_numpy()[keep].view(_U), replies["y"].to_numpy()[keep].view(_U))
        order = np.argsort(key)
        return _found(self.key, key[order], replies["state"].to_numpy()[keep][order])


def _found(want: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of sorted keys, 0 of others."""
    if not len(keys):
        return np.zeros(len(want), np.int32)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0).astype(np.int32)


_SENT = "x long, y long, block int, n int"
_CUT = "d long, n_words long, n_removed long, kept string, kept_sha256 string"


def _distinct(x: np.ndarray, y: np.ndarray, block: int) -> pa.Table:
    """Each pair of keys once, n: 2 if it occurs more often."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    n = np.minimum(np.diff(np.r_[first, len(x)]), 2).astype(np.int32)
    return pa.table({"x": x[first].view(np.int64), "y": y[first].view(np.int64), "block": np.full(len(first), block, np.int32), "n": n})


def _send(texts: pa.Table) -> pa.Table:
    block = _Block(texts["t"])
    out = _distinct(block.a, block.w, texts["block"][0].as_py())
    del block
    K.trim()
    return out


def _extend(texts: pa.Table, replies: pa.Table) -> pa.Table:
    if not len(texts) or not (replies["state"].to_numpy() >= 2).any():
        none = np.empty(0, _U)
        return _distinct(none, none, 0)
    block = _Block(texts["t"])
    begin = block.windows((block.state(replies) & 2) > 0)
    out = _distinct(*block.names(begin), texts["block"][0].as_py())
    del block
    K.trim()
    return out


def words_kept(data: np.ndarray, start: np.ndarray, size: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each row, joined by one space. data has a byte behind the last word."""
    count = np.concatenate([[0], np.cumsum(keep)])[bounds]
    start, size = start[keep], size[keep] + 1
    ends = np.cumsum(size)
    out = K.gather(data, start, size)
    out[ends - 1] = 0x20
    at, raw = np.concatenate([[0], ends])[count].tolist(), out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def _rows(d: pa.ChunkedArray, block: _Block, gone: np.ndarray) -> pa.Table:
    kept = words_kept(block.data, block.start, block.size, block.bounds, ~gone)
    n = np.diff(block.bounds)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[block.bounds])
    sha = [hashlib.sha256(x).hexdigest() for x in kept]
    return pa.table({"d": d, "n_words": n, "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(sha, pa.string())})


def _cut(texts: pa.Table, replies: pa.Table) -> pa.Table:
    if not len(texts):
        return pa.table({"d": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": K.strings([]), "kept_sha256": K.strings([])})
    block = _Block(texts["t"])
    state = block.state(replies)
    begin = block.windows((state & 2) > 0)
    said = replies["state"].to_numpy() == 4
    key = np.sort(_pair(replies["x"].to_numpy()[said].view(_U), replies["y"].to_numpy()[said].view(_U)))
    begin = begin[_found(_pair(*block.names(begin)), key, np.ones(len(key), np.int32)) > 0]
    whole = (state & 1) > 0
    edge = np.zeros(len(block.start) + 1, np.int32)
    for low, high in ((block.low[whole], block.high[whole]), (begin, begin + LENGTH)):
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
    out = _rows(texts["d"], block, np.cumsum(edge[:-1]) > 0)
    del block
    K.trim()
    return out


def _short(texts: pa.Table) -> pa.Table:
    block = _Block(texts["t"])
    return _rows(texts["d"], block, np.zeros(len(block.start), dtype=bool))


def _each(fn):
    def over(batches):
        for batch in batches:
            yield from fn(pa.Table.from_batches([batch])).to_batches()

    return over


def _answers(anchors: DataFrame) -> DataFrame:
    """block, x, y, state for the anchors that occur more than once."""
    group = Window.partitionBy("x")
    alike = Window.partitionBy("x", "y")
    seen = anchors.repartition("x").select(
        "*", F.sum("n").over(alike).alias("same"), F.min("block").over(alike).alias("least"),
        F.sum("n").over(group).alias("all"), (F.min("y").over(group) < F.max("y").over(group)).alias("mixed"),
    ).filter("all > 1")
    return seen.selectExpr("block", "x", "y", "if(same > 1, 1, 0) + if(mixed and (same = 1 or block = least), 2, 0) AS state")


def remove_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256 for each row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("t"))
    able = F.coalesce(F.octet_length("t") >= 2 * LENGTH - 1, F.lit(False))
    size = rows.filter(able).agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(size // HELD, min(parts, size // LEAST)) + 1
    block = F.pmod(F.xxhash64("d", "t"), F.lit(blocks)).cast("int").alias("block")
    texts = rows.filter(able).select(block, "d", K.packed(F.col("t")).alias("t"))
    answers = _answers(texts.groupBy("block").applyInArrow(_send, _SENT))
    windows = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_extend, _SENT)
    again = windows.select("*", F.sum("n").over(Window.partitionBy("x", "y")).alias("all")).filter("all > 1").selectExpr("block", "x", "y", "4 AS state")
    cut = texts.groupBy("block").cogroup(answers.unionByName(again).groupBy("block")).applyInArrow(_cut, _CUT)
    short = rows.filter(~able).select("d", K.packed(F.col("t")).alias("t")).mapInArrow(_each(_short), _CUT)
    return cut.unionByName(short).withColumnRenamed("d", id_col)
