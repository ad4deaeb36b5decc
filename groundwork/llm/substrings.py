"""Exact removal of repeated byte strings by prefix-free parsing and suffix arrays of its dictionary.

Parsing: hashes of GRAM bytes are triggers where they're least among those of some LENGTH-byte string. A
phrase holds the LENGTH-byte strings that share a trigger, so neighbouring phrases overlap by LENGTH - 1 bytes, every
string of LENGTH bytes lies in exactly one phrase, as a phrase suffix's beginning, and equal strings have equal
triggers at equal places. The dictionary is the set of distinct phrases; the parse tells where they occur.

Texts are dealt into blocks; the parse of a block stays with it, and only the dictionary travels.

1. A block sends each of its distinct phrases' hash once, with the least id that has it, to the trigger's bucket.
2. The bucket merges the dictionary, answers with each phrase's least id, and asks for the bytes of phrases whose trigger
   other texts have in other phrases.
3. The suffixes of these are sorted by their first LENGTH bytes (suffix array, neighbours with that common prefix in one
   run); each run's least id covers it in the others, and the ranges go back to the blocks.
4. The block's parse applies both answers: a phrase that a smaller id has is covered whole, any other in its ranges.

As no comparison goes beyond LENGTH bytes and a phrase holds all strings of its trigger whole, the dictionary's suffixes alone decide; the
order of the parse's suffixes, which tells longer ones apart, has no part in the result. A passage that all texts have is sent
once a block, not once an occurrence. Texts go, compressed, through one shuffle, which all four steps read. Defined results: a
null text is empty; rows without id lose nothing and cover nothing; rows of the same id never cover each other; texts under LENGTH
bytes stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LENGTH = 50
GRAM = 20
#: Bytes of texts in a block at most (but for a longer text), and at least where there are fewer than partitions; bytes of texts whose dictionary makes a bucket at least.
HELD, LEAST, BUCKET = 10_000_000, 1_000_000, 4_000_000


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a block: first byte, number of LENGTH-byte strings, and hash of the trigger, mixed again as the least hashes crowd."""
    low = K.grams(data, gram)
    n, width = len(data) - length + 1, length - gram + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    least, where, size = low, np.arange(len(low), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = least[:-step], least[step:]
        first = left <= right
        least, where, size = np.where(first, left, right), np.where(first, where[:-step], where[step:]), size + step
    whole = np.zeros(n + 1, dtype=np.int8)  # strings that lie in one text
    some = np.diff(offsets) >= length
    np.add.at(whole, offsets[:-1][some], 1)
    np.add.at(whole, offsets[1:][some] - length + 1, -1)
    inside = np.cumsum(whole[:-1], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (where[1:n] != where[: n - 1]) | ~inside[:-1]
    first_of_row = offsets[:-1][some]
    new[first_of_row] = True
    start = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    return start, np.flatnonzero(stop) + 1 - start, K.mix(low[where[start]])


def _parsed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """The bytes of a block's texts, their offsets, and of each phrase: first byte, strings, trigger, hash, row."""
    texts, parts, offsets, base = K.unpacked(column), [], [np.zeros(1, np.int64)], 0
    whole = []
    for lo, hi, data, at in K.blocks(texts):
        start, strings, trigger = parse(data, at)
        row = np.searchsorted(at, start, side="right") - 1 + lo
        parts.append((start + base, strings, trigger, K.span_hashes(data, start, start + strings + LENGTH - 1), row))
        whole.append(data)
        offsets.append(at[1:] + base)
        base += len(data)
    kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64)
    found = tuple(np.concatenate([*(p[i] for p in parts), np.empty(0, t)]) for i, t in enumerate(kinds))
    return np.concatenate([*whole, np.empty(0, np.uint8)]), np.concatenate(offsets), found


def _distinct(trigger: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dictionary of a block, by trigger and hash: one occurrence of each phrase, which phrase each occurrence is, and where the order's runs begin."""
    order = np.lexsort((phrase, trigger))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (trigger[order[1:]] != trigger[order[:-1]]) | (phrase[order[1:]] != phrase[order[:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, order


def _bucket_cuts(trigger: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted triggers begin."""
    edges = np.array([min((1 << 64) * i // buckets, (1 << 64) - 1) for i in range(buckets + 1)], dtype=np.uint64)
    cuts = np.searchsorted(trigger, edges)
    cuts[-1] = len(trigger)
    return cuts


def _keys(trigger: np.ndarray, buckets: int) -> np.ndarray:
    """24 bits below the bucket's, which tell a trigger's hash from most others of its bucket; those that stay alike cost only work."""
    return ((trigger >> np.uint64(40 - buckets.bit_length())) & np.uint64((1 << 32) - 1)).astype(np.uint32)


def _small(x: np.ndarray, kind) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _large(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


_SENT = "bucket int, block int, n int, trigger binary, phrase binary, least binary"
#: kind 0: the least id of each phrase (a: steps from the block's own) and whether its bytes are asked for (b); kind 1: numbers of phrases (a), and
#: phrases and ranges (b).
_REPLY = "block int, bucket int, kind int, a binary, b binary"
_ASKED = "bucket int, block int, at binary, strings binary, least binary, bytes binary"
_CUT = "d long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _least(d: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out, which, d)
    return out


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields, cols, strict=True)})


def _sender(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        """A block's dictionary by bucket."""
        _, _, (_, _, trigger, phrase, row) = _parsed(table["t"])
        one, which, _ = _distinct(trigger, phrase)
        least = _least(table["d"].to_numpy()[row], which, len(one))
        trigger, phrase = trigger[one], phrase[one]
        cuts, block = _bucket_cuts(trigger, buckets), table["block"][0].as_py()
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            x = slice(cuts[b], cuts[b + 1])
            rows.append((b, block, x.stop - x.start, _small(np.diff(_keys(trigger[x], buckets), prepend=np.uint32(0)), np.uint32), phrase[x].tobytes(), _small(least[x], np.int64)))
        return _table(rows, _SENT)

    return send


def _merged(table: pa.Table) -> pa.Table:
    """For each block's phrases in a bucket, the least id of all, and whether another text has another phrase at the trigger."""
    n = table["n"].to_numpy()
    trigger = np.concatenate([np.cumsum(_large(x, np.uint32), dtype=np.uint32) for x in table["trigger"].to_pylist()])
    phrase = np.concatenate([np.frombuffer(x, np.uint64) for x in table["phrase"].to_pylist()])
    own = np.concatenate([_large(x, np.int64) for x in table["least"].to_pylist()])
    one, which, _ = _distinct(trigger, phrase)
    least = _least(own, which, len(one))
    first = np.flatnonzero(np.r_[True, np.diff(trigger[one]) != 0])  # of each trigger
    mixed = np.repeat(np.minimum.reduceat(least, first) < np.maximum.reduceat(least, first), np.diff(np.r_[first, len(one)]))
    step = own - least[which]
    ask = mixed[which] & (step == 0)
    cuts = np.cumsum([0, *n])
    rows = [(block, bucket, 0, _small(step[a:b], np.int64), _small(ask[a:b], np.uint8)) for block, bucket, a, b in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), cuts[:-1], cuts[1:], strict=True)]
    return _table(rows, _REPLY)


def _answers(replies: pa.Table, kind: int) -> list[tuple[int, bytes, bytes]]:
    """bucket, a, b in order of the buckets."""
    rows = zip(*(replies[c].to_pylist() for c in ("kind", "bucket", "a", "b")), strict=True)
    return sorted(r[1:] for r in rows if r[0] == kind)


def _byte_sender(buckets: int):
    def send(texts: pa.Table, replies: pa.Table) -> pa.Table:
        """The bytes of the phrases that buckets ask for."""
        said = _answers(replies, 0)
        if not said:
            return _table([], _ASKED)
        ask = np.concatenate([_large(b, np.uint8) for _, _, b in said])
        if not ask.any():
            return _table([], _ASKED)
        data, _, (start, strings, trigger, phrase, row) = _parsed(texts["t"])
        one, which, _ = _distinct(trigger, phrase)
        least = _least(texts["d"].to_numpy()[row], which, len(one))
        block, cuts, rows = texts["block"][0].as_py(), _bucket_cuts(trigger[one], buckets), []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = np.flatnonzero(ask[cuts[b] : cuts[b + 1]]) + cuts[b]
            if len(at):
                x = one[at]
                text = zstandard.ZstdCompressor(level=3).compress(K.gather(data, start[x], strings[x] + LENGTH - 1).tobytes())
                rows.append((b, block, _small(at - cuts[b], np.int32), _small(strings[x], np.uint16), _small(least[at], np.int64), text))
        return _table(rows, _ASKED)

    return send


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a big-endian number, so that numbers compare as the bytes do."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out |= wide[j : j + len(data)] << np.uint64(56 - 8 * j)
    return out


def sorted_runs(data: np.ndarray, suffixes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by the first `length` bytes: an order of the suffixes, and where its runs of equal ones begin."""
    word = _words(data)
    keys = [word[suffixes + min(8 * i, length - 8)] for i in range(-(-length // 8))]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(suffixes), dtype=bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _runs(table: pa.Table) -> pa.Table:
    """Ranges of strings of the asked phrases that phrases of smaller ids have too."""
    kinds = {"at": np.int32, "strings": np.uint16, "least": np.int64, "bytes": np.uint8}
    parts = {c: [_large(x, kind) for x in table[c].to_pylist()] for c, kind in kinds.items()}
    sizes = [len(x) for x in parts["at"]]
    at, size, least, data = (np.concatenate(parts[c]) for c in ("at", "strings", "least", "bytes"))
    size = size.astype(np.int64)
    place = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    bounds = np.r_[0, np.cumsum(size)]
    of = np.repeat(np.arange(len(size)), size)
    order, first = sorted_runs(data, place[of] + np.arange(len(of)) - bounds[of])
    low = np.repeat(np.minimum.reduceat(least[of[order]], first), np.diff(np.r_[first, len(order)]))
    hit = np.zeros(len(of), dtype=bool)
    hit[order] = low < least[of[order]]
    a, b, _ = K.runs(hit, bounds)
    phrase = np.searchsorted(bounds, a, side="right") - 1
    a, b = a - bounds[phrase], b - bounds[phrase] + LENGTH - 1
    cuts = np.searchsorted(phrase, np.cumsum([0, *sizes]))
    rows = [(block, bucket, 1, at[phrase[x:y]].astype(np.int64).tobytes(), np.column_stack([a[x:y], b[x:y]]).astype(np.int64).tobytes()) for block, bucket, x, y in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), cuts[:-1], cuts[1:], strict=True) if y > x]
    return _table(rows, _REPLY)


def _cutter(buckets: int):
    def cut(texts: pa.Table, replies: pa.Table) -> pa.Table:
        """The rows of a block without what texts of smaller ids have."""
        if not len(texts):
            return _table([], _CUT)
        data, offsets, (start, strings, trigger, phrase, row) = _parsed(texts["t"])
        one, which, _ = _distinct(trigger, phrase)
        d = texts["d"].to_numpy()
        step = np.concatenate([*(_large(a, np.int64) for _, a, _ in _answers(replies, 0)), np.empty(0, np.int64)])
        whole = d[row] > (_least(d[row], which, len(one)) - step)[which]
        begin, end = [start[whole]], [(start + strings + LENGTH - 1)[whole]]
        cuts = _bucket_cuts(trigger[one], buckets)
        parts = [(np.frombuffer(a, np.int64) + cuts[k], np.frombuffer(b, np.int64).reshape(-1, 2)) for k, a, b in _answers(replies, 1)]
        if parts:
            of, ranges = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            firsts = np.flatnonzero(~whole)
            firsts = firsts[np.argsort(which[firsts], kind="stable")]
            lo, hi = np.searchsorted(which[firsts], of), np.searchsorted(which[firsts], of, side="right")
            occ = firsts[K.gather(np.arange(len(firsts)), lo, hi - lo)]
            begin.append(start[occ] + np.repeat(ranges[:, 0], hi - lo))
            end.append(start[occ] + np.repeat(ranges[:, 1], hi - lo))
        begin, end = np.concatenate(begin), np.concatenate(end)
        gone = np.zeros(len(data) + 1, np.int32)
        np.add.at(gone, begin, 1)
        np.add.at(gone, end, -1)
        a, b, of_row = K.runs(np.cumsum(gone[:-1]) > 0, offsets)
        out = _rows_cut(data, offsets, d, a, b, of_row)
        K.trim()
        return out

    return cut


def _rows_cut(data: np.ndarray, offsets: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray, of_row: np.ndarray) -> pa.Table:
    """a, b: the removed runs of all rows; of_row: the first of each row."""
    rows, raw = [], data.tobytes()
    for i in range(len(d)):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        x, y = a[of_row[i] : of_row[i + 1]].tolist(), b[of_row[i] : of_row[i + 1]].tolist()
        left = b"".join(raw[p:q] for p, q in zip([lo, *y], [*x, hi], strict=True))
        rows.append((int(d[i]), hi - lo, hi - lo - len(left), len(x), left, hashlib.sha256(left).hexdigest()))
    return _table(rows, _CUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256 for each row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("t"))
    able = F.coalesce(F.expr(f"d is not null and octet_length(t) >= {LENGTH}"), F.lit(False))
    size = rows.filter(able).agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, buckets = max(size // HELD, min(parts, size // LEAST)) + 1, min(4 * parts, size // BUCKET + 1)  # a row for each pair of them that has phrases
    block = F.pmod(F.xxhash64("d", "t"), F.lit(blocks)).cast("int").alias("block")
    texts = rows.filter(able).select(block, "d", K.packed(F.col("t")).alias("t"))
    replies = texts.groupBy("block").applyInArrow(_sender(buckets), _SENT).groupBy("bucket").applyInArrow(_merged, _REPLY)
    asked = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_byte_sender(buckets), _ASKED)
    ranges = asked.groupBy("bucket").applyInArrow(_runs, _REPLY)
    cut = texts.groupBy("block").cogroup(replies.unionByName(ranges).groupBy("block")).applyInArrow(_cutter(buckets), _CUT)
    bytes_of = F.coalesce(F.encode("t", "utf-8"), F.lit(b""))
    short = rows.filter(~able).select("d", F.octet_length(bytes_of).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), bytes_of.alias("kept"), F.sha2(bytes_of, 256).alias("kept_sha256"))
    return cut.unionByName(short).withColumnRenamed("d", id_col)
