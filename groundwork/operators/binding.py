"""What binds entities that arrive near each other: nulls of placed arrivals, direction, and communities by label propagation.

Arrivals are rows (seq, id, pos), an id at most once at a place. A sequence is read by one task with its pairs, in blocks of whole sequences; nulls are made only for pairs that
met. A draw is a ranking of the places at hand by counter-based random numbers: it is made in the task's memory, once for all pairs that share it, and a lost task draws the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundwork.functions.rng import uniform_values
from groundwork.functions.store import dropped, written
from groundwork.operators import blocks

#: Step between the seeds of two draws.
STRIDE = 7919
_PAIR = ["seq", "a", "b"]
#: Fixed value: cells of the tables that are made at once, unless one row is longer.
CELLS = 1 << 20


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array, int]:
    """The values of some columns as numbers in the order of the values, -1 for null, and the values by number."""
    every = pa.concat_arrays([pa.concat_arrays(c.chunks) for c in columns]).dictionary_encode()
    order = pc.sort_indices(every.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    codes = rank[every.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1]), every.dictionary.take(pa.array(order)), max(len(order), 1)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as counted, one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def met_pairs(arrivals: DataFrame, window: int) -> DataFrame:
    """seq, a, b (a < b), overlap: pairs of arrivals of both within the window; na, nb: arrivals of each; lo, hi: the first and last of both.

    Arrivals stand in order of their places, so each meets those that follow it, one step further at a time, until none is within the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in blocks.whole_groups(batches, "seq"):
            (ids,), names, k = _codes(table["id"])
            seq, pos = np.repeat(np.arange(len(at) - 1), np.diff(at)), table["pos"].to_numpy()
            met, counts, step = np.empty(0, np.int64), np.empty(0, np.int64), 1
            while step < len(seq) and (near := (seq[step:] == seq[:-step]) & (pos[step:] - pos[:-step] <= window)).any():
                x, y = ids[:-step][near], ids[step:][near]
                key = ((seq[step:][near] * k + np.minimum(x, y)) * k + np.maximum(x, y))[x != y]
                met, back = np.unique(np.concatenate([met, key]), return_inverse=True)
                counts, step = np.bincount(back, np.concatenate([counts, np.ones(len(key), np.int64)]), len(met)).astype(np.int64), step + 1
            if not len(met):
                continue
            own = seq * k + ids
            order = np.argsort(own, kind="stable")
            left, right = (lambda of: (np.searchsorted(own[order], of), np.searchsorted(own[order], of, "right")))(np.stack([met // k, met // (k * k) * k + met % k]))
            lo, hi = pos[order[left]].min(axis=0), pos[order[right - 1]].max(axis=0)
            seqs = pa.concat_arrays(table["seq"].chunks).take(pa.array(at[met // (k * k)]))
            yield from blocks.batches_of({"seq": seqs, "a": names.take(pa.array(met // k % k)), "b": names.take(pa.array(met % k)), "overlap": counts, "na": (right - left)[0], "nb": (right - left)[1], "lo": lo, "hi": hi})

    kind = {f.name: f.dataType.simpleString() for f in arrivals.schema}
    given = arrivals.filter("seq is not null and id is not null and pos is not null").select("seq", "id", F.col("pos").cast("long").alias("pos"))
    return blocks.ordered(given, "seq", "pos").mapInArrow(run, f"seq {kind['seq']}, a {kind['id']}, b {kind['id']}, overlap long, na long, nb long, lo long, hi long")


class Bound:
    """Pairs of a block of sequences, by number: seq, a, b, the length n of the sequence (-1 without one), and the places of a and of b."""

    def __init__(self, table: pa.Table, at: np.ndarray):
        (ids, a, b), _, k = _codes(table["_id"], table["a"], table["b"])
        seq = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.rows = np.flatnonzero(a >= 0)
        self.seq, self.a, self.b = seq[self.rows], a[self.rows], b[self.rows]
        self.table, self.k = table, k
        arrived = np.flatnonzero(ids >= 0)
        pos, own = table["_at"].to_numpy()[arrived].astype(np.int64), seq[arrived] * k + ids[arrived]
        order = np.lexsort((pos, own))
        self.own, self.pos = own[order], pos[order]
        n, sized = np.full(len(at) - 1, -1, np.int64), np.flatnonzero(table["_n"].is_valid().to_numpy())
        n[seq[sized]] = table["_n"].to_numpy()[sized]
        self.n = n[self.seq]

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()[self.rows].astype(np.int64)

    def flags(self, seq: np.ndarray, ids: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
        """Where each id arrives in its sequence: a row of `span` places from `first` on for each."""
        own = seq * self.k + ids
        left, right = np.searchsorted(self.own, own), np.searchsorted(self.own, own, "right")
        row, place = np.repeat(np.arange(len(own)), right - left), self.pos[_ranges(left, right - left)] - np.repeat(first, right - left)
        inside, out = (place >= 0) & (place < span), np.zeros((len(own), span), np.int8)
        out[row[inside], place[inside]] = 1
        return out


def _bound(arrivals: DataFrame, pairs: DataFrame, length: DataFrame | None, make: Callable[[Bound], tuple[np.ndarray, dict[str, np.ndarray]]], fields: str) -> DataFrame:
    """pairs with fields: what `make` gives for a block, the numbers of the pairs that stay and their columns."""
    rows = pairs.withColumns({"_id": F.lit(None).cast(arrivals.schema["id"].dataType), "_at": F.lit(None).cast("long"), "_n": F.lit(None).cast("long")})
    rows = rows.unionByName(arrivals.filter("id is not null").select("seq", F.col("id").alias("_id"), F.col("pos").cast("long").alias("_at")), allowMissingColumns=True)
    if length is not None:
        rows = rows.unionByName(length.select("seq", F.col("n").cast("long").alias("_n")), allowMissingColumns=True)
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in blocks.whole_groups(batches, "seq"):
            bound = Bound(table, at)
            if len(bound.rows):
                kept, columns = make(bound)
                pairs_kept = table.select(names).take(pa.array(bound.rows[kept]))
                yield from blocks.batches_of({c: pairs_kept[c] for c in names} | columns)

    return blocks.ordered(rows, "seq").mapInArrow(run, StructType([*pairs.schema.fields, *StructType.fromDDL(fields).fields]))


def _groups(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of the rows that have the same keys."""
    if len(keys[0]):
        order = np.lexsort(keys[::-1])
        new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        yield from np.split(order, np.flatnonzero(new) + 1)


def _parts(rows: np.ndarray, span: int) -> Iterator[np.ndarray]:
    size = max(1, CELLS // max(span, 1))
    for k in range(0, len(rows), size):
        yield rows[k : k + size]


def _ranked(seeds: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """The places from `first` on in the order of their uniform numbers, the place deciding ties: a row for each seed, counted from `first`."""
    word = (uniform_values(seeds[:, None], first[:, None] + np.arange(span)) * 4294967296.0).astype(np.uint64)
    return (np.sort((word << np.uint64(32)) | np.arange(span, dtype=np.uint64), axis=1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def displacement_null(arrivals: DataFrame, pairs: DataFrame, window: int, draws: int, seed: int) -> DataFrame:
    """pairs with p_met: b's arrivals are placed at random on the places from lo to hi that a doesn't take; the share of draws in which they overlap a's as much.

    The numbers of a draw go by place and na, so all pairs of an a are drawn from one ranking."""

    def shares(x: Bound) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        na, nb, lo, hi, overlap = (x.column(c) for c in ("na", "nb", "lo", "hi", "overlap"))
        firsts = list(_groups(x.seq, x.a, na))
        lead = np.array([g[0] for g in firsts], np.int64)
        first, span = np.array([lo[g].min() for g in firsts], np.int64), np.array([hi[g].max() - lo[g].min() + 1 for g in firsts], np.int64)
        hits = np.zeros(len(x.rows), np.int64)
        for same in _groups(span):
            width = int(span[same[0]])
            for part in _parts(same, width * max(len(firsts[g]) for g in same)):
                taken = x.flags(x.seq[lead[part]], x.a[lead[part]], first[part] - window, width + 2 * window)
                sums = np.concatenate([np.zeros((len(part), 1), np.int64), np.cumsum(taken, axis=1, dtype=np.int64)], axis=1)
                near = sums[:, 2 * window + 1 :] - sums[:, : -2 * window - 1]
                near[taken[:, window : window + width] > 0] = -1
                q = np.concatenate([firsts[g] for g in part])
                row = np.repeat(np.arange(len(part)), [len(firsts[g]) for g in part])
                low, high = (lo[q] - first[part][row])[:, None], (hi[q] - first[part][row])[:, None]
                for draw in range(draws):
                    order = _ranked(seed + na[lead[part]] + draw * STRIDE, first[part], width)
                    place, by = order[row], np.take_along_axis(near, order, axis=1)[row]
                    free = (place >= low) & (place <= high) & (by >= 0)
                    chosen = free & (np.cumsum(free, axis=1) <= nb[q][:, None])
                    hits[q] += ((by * chosen).sum(axis=1) >= overlap[q]) & chosen.any(axis=1)
        return np.arange(len(x.rows)), {"p_met": hits / draws}

    return _bound(arrivals, pairs, None, shares, "p_met double")


def reseed_null(arrivals: DataFrame, pairs: DataFrame, length: DataFrame, draws: int, seed: int) -> DataFrame:
    """pairs with near1 (arrivals of both at most one place apart) and p_reseed: both are placed anew, on different places of the whole sequence (seq, n).

    The numbers of a draw go by place alone, so sequences of a length share their rankings, and pairs with as many arrivals their samples."""
    observed = met_pairs(arrivals, 1).select(*_PAIR, F.col("overlap").alias("near1"))
    pairs = pairs.join(observed, _PAIR, "left").withColumn("near1", F.coalesce("near1", F.lit(0).cast("long")))

    def shares(x: Bound) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        na, nb, near1 = (x.column(c) for c in ("na", "nb", "near1"))
        hits = np.zeros(len(x.rows), np.int64)
        for long in _groups(x.n):
            n = int(x.n[long[0]])
            if n < 1:
                continue
            for draw in range(draws):
                rank = np.empty(n, np.int64)
                rank[_ranked(np.array([seed + draw * STRIDE]), np.array([0]), n)[0]] = np.arange(n)
                # neighbours of which one is among a's places and the other among b's: the lower rank and the higher one
                low, high = np.minimum(rank[1:], rank[:-1]), np.maximum(rank[1:], rank[:-1])
                of, back = np.unique(np.stack([na[long], nb[long]]), axis=1, return_inverse=True)
                met = np.concatenate([((low < a[:, None]) & (high >= a[:, None]) & (high < (a + b)[:, None])).sum(axis=1) for a, b in ((of[0][p], of[1][p]) for p in _parts(np.arange(of.shape[1]), n))])
                hits[long] += met[back.ravel()] >= near1[long]
        return np.arange(len(x.rows)), {"p_reseed": hits / draws}

    return _bound(arrivals, pairs, length, shares, "p_reseed double")


def _entropy(count, x: str, y: str) -> Column:
    """Bits that x tells of y's next arrival beyond y itself, from counts of (x, y, y next); only y's arriving counts."""
    out = F.lit(0.0)
    for b in (0, 1):
        arrived, all_ = [count(x, a, y, b, 1) for a in (0, 1)], [count(x, a, y, b, None) for a in (0, 1)]
        for a in (0, 1):
            ratio = (arrived[a] / all_[a]) / ((arrived[0] + arrived[1]) / (all_[0] + all_[1]))
            out = out + F.when(arrived[a] > 0, arrived[a] / F.col("steps") * F.log2(ratio)).otherwise(0.0)
    return out


def asymmetry(steps: DataFrame, by: list[str]) -> DataFrame:
    """by, fwd, rev, s (their difference) of rows (by, place, x, y, flags of 0 and 1, one row a place)."""
    w = Window.partitionBy(*by).orderBy("place")
    moves = steps.select(*by, "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).filter("x1 is not null")
    sums, names = [F.count("*").alias("steps")], []
    for x in (0, 1):
        for y in (0, 1):
            here = (F.col("x") == x) & (F.col("y") == y)
            for nxt, flag in (("x1", "x"), ("y1", "y"), (None, "")):
                names.append(f"c_{x}{y}{flag}")
                sums.append(F.sum((here & (F.col(nxt) == 1) if nxt else here).cast("long")).alias(names[-1]))
    counts = moves.groupBy(*by).agg(*sums)

    def count(x: str, a: int, y: str, b: int, nxt: int | None) -> Column:
        at = f"{a}{b}" if x == "x" else f"{b}{a}"
        return F.col(f"c_{at}{y if nxt else ''}")

    out = counts.withColumn("fwd", F.round(_entropy(count, "x", "y"), 12)).withColumn("rev", F.round(_entropy(count, "y", "x"), 12))
    return out.select(*by, "fwd", "rev", F.round(F.col("fwd") - F.col("rev"), 12).alias("s"))


def reversal_null(arrivals: DataFrame, pairs: DataFrame, length: DataFrame, draws: int, seed: int) -> DataFrame:
    """pairs with fwd, rev (bits that a tells of b, and b of a), strength and p_direction: b's arrivals are placed anywhere in the sequence (seq, n); the
    share of draws as one-sided, either way, as what was observed. direction: a to b, b to a, or null from 0.05 on."""

    def shares(p: Bound) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        nb, kept = p.column("nb"), np.flatnonzero(p.n >= 2)
        seen, hits = {c: np.zeros(len(p.rows)) for c in ("fwd", "rev", "strength")}, np.zeros(len(p.rows), np.int64)
        for long in _groups(p.n[kept]):
            n, ranks = int(p.n[kept[long[0]]]), {}
            for same in _groups(nb[kept[long]]):
                for part in _parts(kept[long[same]], n):
                    x, y = (p.flags(p.seq[part], i[part], np.zeros(len(part), np.int64), n) for i in (p.a, p.b))
                    seen["fwd"][part], seen["rev"][part], s = (z[:, 0] for z in _transfers(x, y, own=True))
                    seen["strength"][part] = np.abs(s)
                    size = max(1, CELLS // n)
                    for k in range(0, draws, size):
                        if (k, n) not in ranks:
                            seeds = seed + 7 + np.arange(k, min(draws, k + size)) * STRIDE
                            ranks = {(k, n): np.argsort(_ranked(seeds, np.zeros(len(seeds), np.int64), n), axis=1)} | (ranks if size >= draws else {})
                        drawn = (ranks[k, n] < nb[part[0]]).astype(np.int8)
                        hits[part] += (np.abs(_transfers(x, drawn)[2]) >= seen["strength"][part][:, None]).sum(axis=1)
        return kept, {"fwd": seen["fwd"][kept], "rev": seen["rev"][kept], "strength": seen["strength"][kept], "p_direction": hits[kept] / draws}

    out = _bound(arrivals, pairs, length, shares, "fwd double, rev double, strength double, p_direction double")
    direction = F.when(F.col("p_direction") < 0.05, F.when(F.col("fwd") > F.col("rev"), "a to b").otherwise("b to a"))
    return out.withColumn("direction", direction)


def _transfers(x: np.ndarray, y: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fwd, rev and their difference, as asymmetry() has them, of flags: each row of x with each row of y, or with its own."""
    x0, x1, y0, y1 = (z.astype(float) for z in (x[:, :-1], x[:, 1:], y[:, :-1], y[:, 1:]))
    meet = (lambda a, b: (a * b).sum(axis=1)[:, None]) if own else (lambda a, b: a @ b.T)
    of_x, of_y = (lambda a: a.sum(axis=1)[:, None]), (lambda b: b.sum(axis=1)[:, None] if own else b.sum(axis=1)[None, :])
    steps = x0.shape[1]
    # how often each (x, y) comes, and with x, or y, in the next place
    both, here, there = meet(x0, y0), of_x(x0), of_y(y0)
    count = {(1, 1): both, (1, 0): here - both, (0, 1): there - both, (0, 0): steps - here - there + both}
    next_x, next_y = {}, {}
    for v, flag in ((1, x0 * x1), (0, (1 - x0) * x1)):
        next_x[v, 1] = meet(flag, y0)
        next_x[v, 0] = of_x(flag) - next_x[v, 1]
    for v, flag in ((1, y0 * y1), (0, (1 - y0) * y1)):
        next_y[1, v] = meet(x0, flag)
        next_y[0, v] = of_y(flag) - next_y[1, v]

    def bits(all_: Callable[[int, int], np.ndarray], arrived: Callable[[int, int], np.ndarray]) -> np.ndarray:
        out = 0.0
        for b in (0, 1):
            whole = (arrived(0, b) + arrived(1, b)) / np.maximum(all_(0, b) + all_(1, b), 1)
            for a in (0, 1):
                hit = arrived(a, b)
                ratio = np.where(hit > 0, hit / np.maximum(all_(a, b), 1), 1) / np.where(hit > 0, whole, 1)
                out = out + hit / steps * np.log2(ratio)
        return np.round(out, 12)

    fwd = bits(lambda a, b: count[a, b], lambda a, b: next_y[a, b])
    rev = bits(lambda a, b: count[b, a], lambda a, b: next_x[b, a])
    return fwd, rev, np.round(fwd - rev, 12)


# --- communities


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    return edges.select(F.explode(ends).alias("e"), "weight").groupBy("e.node", "e.other").agg(F.sum("weight").alias("weight"))


def propagated(labels: DataFrame, beside: DataFrame, turn: int | None = None) -> DataFrame:
    """node, label: each node (or, of a turn, each whose hash is odd or even as the turn) takes the label with most weight among its neighbours, of equal ones the least."""
    moves = beside if turn is None else beside.filter((F.crc32(F.col("node").cast("string").cast("binary")) + turn) % 2 == 0)
    said = moves.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
    best = said.groupBy("node").agg(F.max("w").alias("w")).join(said, ["node", "w"]).groupBy("node").agg(F.min("label").alias("new"))
    return labels.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label"))


def communities(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """node, label: communities of an undirected graph (a, b, weight) by label propagation, until two turns change nothing or for `limit` turns.

    In a turn only the nodes of one half change, by a hash of their names, so that two neighbours don't trade labels for ever. A node without
    edges keeps its name. Each turn's labels are a table; the one before it is removed.
    """
    beside = written(_both_ways(edges), "beside")
    labels, quiet = written(nodes.select("node", F.col("node").alias("label")).distinct(), "labels"), 0
    for turn in range(limit):
        new = written(propagated(labels, beside, turn), "labels")
        changed = not new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").isEmpty()
        dropped(labels)
        labels, quiet = new, 0 if changed else quiet + 1
        if quiet == 2:
            break
    dropped(beside)
    return labels
