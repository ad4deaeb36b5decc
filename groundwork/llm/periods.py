"""Runs of repeated words by grammar compression.

A run is a stretch of words with smallest period q, of at least max(LEAST, TIMES * q) words, that no neighbouring word extends. Each text is read as word ids.

1. A run holds each PIECE words of it twice: only stretches in which each PIECE words occur again in the same stretch are looked at; nothing
   else can hold a run.
2. Re-Pair: the most frequent pair of neighbours becomes a nonterminal until none occurs twice; what is left is paired as a balanced tree.
3. A run crosses the boundary of the least nonterminal that holds it. For each nonterminal, once, the runs that cross its boundary are computed from
   how far the words before and after agree with those a period away, for all periods that a common piece of PIECE words allows.
4. They are translated to all places where the derivation has the nonterminal; intervals of one period that overlap by a period are merged, and of
   several periods of one interval the least one stays.

Defined results: null and empty texts have no run. A text is held whole by one task; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .anchors import words_kept

LEAST, TIMES = 24, 3
#: In a run of m words and period q, every PIECE words occur again a period before or after, as m >= 2 * q + PIECE - 1; and of the m - q >= 16 places that
#: equal those a period on, PIECE at least lie on one side of any boundary.
PIECE = LEAST // TIMES
_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return K.mix(x * _A + (y ^ (y >> _U(31))) * _B)


def _doubled(words: np.ndarray, steps: int) -> np.ndarray:
    """Hashes of each 2 ** steps words."""
    for k in range(steps):
        words = _pair(words[: -(1 << k)], words[1 << k :]) if len(words) > 1 << k else words[:0]
    return words


def stretches(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of a row in which each PIECE words occur twice."""
    out, at = [], np.stack([bounds[:-1], bounds[1:]], axis=1)
    at = at[at[:, 1] - at[:, 0] >= LEAST]
    gram = _doubled(words, PIECE.bit_length() - 1)
    while len(at):
        size = at[:, 1] - at[:, 0] - PIECE + 1
        place, of = K.gather(np.arange(len(gram)), at[:, 0], size), np.repeat(np.arange(len(at)), size)
        key = K.mix(gram[place] + of.astype(_U) * _A)
        order = np.argsort(key)
        alike = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = alike
        again[order[:-1]] |= alike
        begin, end, _ = K.runs(again, np.concatenate([[0], np.cumsum(size)]))
        found = np.stack([place[begin], place[end - 1] + PIECE], axis=1) if len(begin) else np.empty((0, 2), np.int64)
        whole = np.isin(found[:, 0], at[:, 0]) & np.isin(found[:, 1], at[:, 1]) if len(found) else np.empty(0, bool)
        out.extend(map(tuple, found[whole].tolist()))
        at = found[~whole]
        at = at[at[:, 1] - at[:, 0] >= LEAST] if len(at) else at
    return sorted(out)


def re_pair(ids: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules, of which rule k makes the symbol n + k, and the symbols left, n being one more than the largest id.

    The most frequent pair goes first; ties go by the pair. Occurrences that overlap count from the left.
    """
    n, size = max(ids, default=-1) + 1, len(ids)
    sym, after, before = list(ids), list(range(1, size + 1)), list(range(-1, size - 1))
    where: dict[tuple[int, int], set[int]] = {}
    for i in range(size - 1):
        where.setdefault((sym[i], sym[i + 1]), set()).add(i)
    heap = [(-len(x), pair) for pair, x in where.items() if len(x) > 1]
    heapq.heapify(heap)
    rules = []
    while heap:
        count, pair = heapq.heappop(heap)
        places = where.get(pair, ())
        if len(places) < 2 or -count != len(places):
            if len(places) > 1:
                heapq.heappush(heap, (-len(places), pair))
            continue
        a, b = pair
        chosen, last = [], -1
        for i in sorted(places):
            if i != last:
                chosen.append(i)
                last = after[i]
            else:
                last = -1
        del where[pair]
        if len(chosen) < 2:
            continue
        new, touched = n + len(rules), set()
        rules.append(pair)
        for i in chosen:
            j = after[i]
            left, right = before[i], after[j]
            if left >= 0:
                if old := where.get((sym[left], a)):
                    old.discard(left)
                where.setdefault(key := (sym[left], new), set()).add(left)
                touched.add(key)
            if right < size:
                if old := where.get((b, sym[right])):
                    old.discard(j)
                where.setdefault(key := (new, sym[right]), set()).add(i)
                touched.add(key)
                before[right] = i
            sym[i], after[i] = new, right
        for key in touched:
            if len(x := where.get(key, ())) > 1:
                heapq.heappush(heap, (-len(x), key))
    left, i = [], 0
    while i < size:
        left.append(sym[i])
        i = after[i]
    return rules, left


def _balanced(rules: list[tuple[int, int]], left: list[int], n: int) -> None:
    """Rules above those of Re-Pair, to one symbol."""
    while len(left) > 1:
        up = []
        for i in range(0, len(left) - 1, 2):
            rules.append((left[i], left[i + 1]))
            up.append(n + len(rules) - 1)
        left = up + left[len(up) * 2 :]


class _Agree:
    """How far two places of a stretch agree, forwards and backwards, by hashes of powers of two of words."""

    def __init__(self, words: np.ndarray):
        self.words, self.tables, size = words, [(1, words)], 1
        top = min(len(words), 4096)
        for _ in range(12):
            if 2 * size > top:
                break
            last = self.tables[-1][1]
            self.tables.append((2 * size, _pair(last[:-size], last[size:])))
            size *= 2

    def forwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words from i on that equal those from j on, up to `most`."""
        out = np.zeros(len(i), np.int64)
        for k, (size, table) in enumerate(reversed(self.tables)):
            some = np.arange(len(i))
            while len(some):
                some = some[out[some] + size <= most[some]]
                some = some[table[i[some] + out[some]] == table[j[some] + out[some]]]
                out[some] += size
                if k:
                    break
        return out

    def backwards(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words before i that equal those before j, up to `most`."""
        out = np.zeros(len(i), np.int64)
        for k, (size, table) in enumerate(reversed(self.tables)):
            some = np.arange(len(i))
            while len(some):
                some = some[out[some] + size <= most[some]]
                some = some[table[i[some] - out[some] - size] == table[j[some] - out[some] - size]]
                out[some] += size
                if k:
                    break
        return out

    def crossing(self, low: int, cut: int, high: int, piece: np.ndarray) -> np.ndarray:
        """start, end, period of the runs of words[low:high] that cross the boundary before `cut`; piece: hashes of each PIECE words."""
        found = []
        # with a period before the boundary: compared are the words at it and those a period to the left
        q = self._periods(cut, min((high - low) // TIMES, cut - low), -1, piece, low, high)
        if len(q):
            at = np.full(len(q), cut)
            f, b = self.forwards(at - q, at, np.full(len(q), high - cut)), self.backwards(at - q, at, cut - q - low)
            found.append(np.stack([cut - q - b, cut + f, q], axis=1))
        q = self._periods(cut, min((high - low) // TIMES, high - cut), 1, piece, low, high)
        if len(q):
            at = np.full(len(q), cut)
            f, b = self.forwards(at, at + q, high - cut - q), self.backwards(at, at + q, np.full(len(q), cut - low))
            found.append(np.stack([cut - b, cut + q + f, q], axis=1))
        if not found:
            return np.empty((0, 3), np.int64)
        runs = np.concatenate(found)
        size = runs[:, 1] - runs[:, 0]
        return _least_period(runs[(size >= LEAST) & (size >= TIMES * runs[:, 2]) & (runs[:, 0] < cut) & (runs[:, 1] > cut)])

    def _periods(self, cut: int, most: int, side: int, piece: np.ndarray, low: int, high: int) -> np.ndarray:
        """Periods up to `most` at which the PIECE words at the boundary, or those before it, occur on a side of it."""
        if most < 1:
            return np.empty(0, np.int64)
        allowed = np.zeros(most, dtype=bool)
        for at in (cut, cut - PIECE):
            if low <= at and at + PIECE <= high:
                # place at + side * q, for q = 1..most, where PIECE words still lie inside
                if side < 0:
                    n = min(most, at - low)
                    if n > 0:
                        allowed[:n] |= piece[at - n : at][::-1] == piece[at]
                else:
                    n = min(most, high - PIECE - at)
                    if n > 0:
                        allowed[:n] |= piece[at + 1 : at + 1 + n] == piece[at]
        return np.flatnonzero(allowed) + 1


def _least_period(runs: np.ndarray) -> np.ndarray:
    """Of several periods of one interval the least."""
    if len(runs) < 2:
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    return runs[first]


def _merged(runs: np.ndarray) -> np.ndarray:
    """Intervals of one period that overlap by it become one."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    out: list[list[int]] = []
    for s, e, q in runs.tolist():
        if out and out[-1][2] == q and out[-1][1] - s >= q:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, q])
    return _least_period(np.array(out, np.int64).reshape(-1, 3))


def stretch_runs(words: np.ndarray) -> np.ndarray:
    """start, end, period of all runs of a stretch, in order."""
    ids = np.unique(words, return_inverse=True)[1].tolist()
    n = max(ids) + 1
    rules, left = re_pair(ids)
    _balanced(rules, left, n)
    size, first = [1] * (n + len(rules)), [0] * (n + len(rules))
    for k, (a, b) in enumerate(rules):
        size[n + k] = size[a] + size[b]
    # places of the derivation, from the last rule down; symbols of fewer than LEAST words hold no run
    places: list[list[int]] = [[] for _ in rules]
    if rules:
        places[-1].append(0)
    agree, piece, found = _Agree(words), _doubled(words, PIECE.bit_length() - 1), []
    for k in range(len(rules) - 1, -1, -1):
        if size[n + k] < LEAST:
            continue
        (a, b), at = rules[k], places[k]
        low = at[0]
        crossing = agree.crossing(low, low + size[a], low + size[n + k], piece)
        if len(crossing):
            shift = np.array(at) - low
            each = np.repeat(crossing, len(shift), axis=0)
            each[:, :2] += np.tile(shift, len(crossing))[:, None]
            found.append(each)
        if a >= n and size[a] >= LEAST:
            places[a - n].extend(at)
        if b >= n and size[b] >= LEAST:
            places[b - n].extend(x + size[a] for x in at)
        places[k] = []
    return _merged(np.concatenate(found)) if found else np.empty((0, 3), np.int64)


def _exact(words: np.ndarray, runs: np.ndarray) -> bool:
    return all((words[s : e - q] == words[s + q : e]).all() for s, e, q in runs.tolist())


def _row_runs(words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """start, length, period for each row, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    for low, high in stretches(words, bounds):
        part = words[low:high]
        runs = stretch_runs(part)
        assert _exact(part, runs)
        row = int(np.searchsorted(bounds, low, side="right")) - 1
        out[row].extend((s + low - int(bounds[row]), e - s, q) for s, e, q in runs.tolist())
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


_FOUND = "struct<n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string, collapsed_sha256 string>"


@K.udf(_FOUND)
def _found(texts: pa.Array) -> pa.Array:
    n_words, runs, collapsed = [], [], []
    for _, _, data, at in K.blocks(texts):
        start, end, of = K.runs(K.NOT_SPACE[data], at)
        words = K.span_hashes(data, start, end)
        rows = _row_runs(words, of)
        edge = np.zeros(len(start) + 1, np.int32)
        for row, first in zip(rows, of.tolist(), strict=False):
            for s, size, q in row:
                edge[first + s + q] += 1
                edge[first + s + size] -= 1
        keep = np.cumsum(edge[:-1]) == 0
        collapsed.extend(words_kept(np.append(data, np.uint8(0)), start, end - start, of, keep))
        n_words.extend(np.diff(of).tolist())
        runs.extend([{"start": s, "length": m, "period": q} for s, m, q in row] for row in rows)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    sha = [hashlib.sha256(x).hexdigest() for x in collapsed]
    K.trim()
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(kind)), pa.array(collapsed, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())], ["n_words", "runs", "collapsed", "collapsed_sha256"])


def find(docs: DataFrame, text: str = "text", name: str = "periodic") -> DataFrame:
    """docs with a struct `name`: n_words, runs (start, length, period by start, then period), collapsed (of each run its first period is kept; words
    joined by one space) and collapsed_sha256."""
    return docs.withColumn(name, _found(F.col(text)))


def digests(docs: DataFrame, name: str = "periodic") -> DataFrame:
    """docs with n_runs, start, length, period, exponent_milli of the run of the greatest length / period, and runs_sha256, instead of `name`.

    Ratios are compared exactly: the first of the runs by length / period as fractions, then least start, then least period.
    """
    runs = F.col(f"{name}.runs")
    better = "x.length * y.period > y.length * x.period or (x.length * y.period = y.length * x.period and (x.start < y.start or (x.start = y.start and x.period < y.period)))"
    best = F.expr(f"aggregate({name}.runs, try_element_at({name}.runs, 1), (y, x) -> if({better}, x, y))")
    best = F.when(F.size(runs) > 0, best)
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    out = docs.withColumn("_best", best)
    return out.select(
        *docs.columns, F.size(runs).cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.col(f"{name}.collapsed_sha256").alias("collapsed_sha256"),
    ).drop(name)
