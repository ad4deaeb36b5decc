"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into pieces (contractions, letters, digits, other signs, white space); each piece starts as single
bytes. A segment tree holds rank * leaves + position for every adjacent pair, so its root names the leftmost pair
of lowest rank. Merging it changes three leaves, each repaired up to the root in logarithmic time, until the
root holds no pair. Short pieces go through the tree in batches, one merge a step in each; long ones alone.
Pieces are encoded once and kept, up to CACHE pieces a Python worker; a kept piece stands only for the same bytes.

Defined results: null and empty texts have no ids and decode to the empty text; the strings of added tokens in a
text become those tokens; other columns and repeated rows pass through.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

CACHE = 250_000
#: Bytes of a piece up to which pieces share a batch of trees.
BATCHED = 64
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge ranks, ids and bytes, as arrays that are broadcast; their size is that of the vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of = spec["model"]["vocab"], byte_alphabet()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        self.order = np.argsort(pairs).astype(np.int32)
        self.pairs = pairs[self.order]
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.first = np.zeros(256, dtype=np.int32)
        for c, b in of.items():
            self.first[b] = vocab[c]
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        tokens = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for t, i in vocab.items():
            tokens[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        for t, i in self.added.items():
            tokens[i] = t
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.order[at], _NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        return K.gather(self.bytes, self.ends[ids] - self.sizes[ids], self.sizes[ids])


def merge_batch(v: Vocabulary, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodes a batch of pieces. pieces: bytes, a column each. Returns ids (a column each) and which of them remain."""
    most, n = pieces.shape
    leaves = 1 << max(0, (most - 2)).bit_length()
    ids = np.vstack([v.first[pieces], np.zeros((1, n), np.int32)])
    there = np.vstack([np.arange(most)[:, None] < sizes, np.zeros((1, n), bool)])
    after = np.repeat(np.arange(1, most + 2, dtype=np.int32)[:, None], n, axis=1)
    before = np.repeat(np.arange(-1, most, dtype=np.int32)[:, None], n, axis=1)
    tree = np.full((2 * leaves, n), _NONE, dtype=np.int32)
    for i in range(most - 1):
        rank = v.ranks(ids[i], ids[i + 1])
        tree[leaves + i] = np.where(there[i + 1] & (rank != _NONE), rank * leaves + i, _NONE)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    col = np.flatnonzero(tree[1] != _NONE)
    while len(col):
        root = tree[1, col]
        i, made = root % leaves, v.made[root // leaves]
        j = after[i, col]
        k = after[j, col]
        ids[i, col], there[j, col], after[i, col] = made, False, k
        before[np.minimum(k, most), col] = i
        right = np.full(len(col), _NONE, dtype=np.int32)
        some = np.flatnonzero(there[np.minimum(k, most), col])
        rank = v.ranks(made[some], ids[k[some], col[some]])
        right[some] = np.where(rank != _NONE, rank * leaves + i[some], _NONE)
        updates = [(i, col, right), (j[j < leaves], col[j < leaves], _NONE)]
        h = before[i, col]
        some = np.flatnonzero(h >= 0)
        rank = v.ranks(ids[h[some], col[some]], made[some])
        updates.append((h[some], col[some], np.where(rank != _NONE, rank * leaves + h[some], _NONE)))
        for leaf, c, value in updates:
            node = leaf + leaves
            tree[node, c] = value
            node = node >> 1
            for _ in range(leaves.bit_length() - 1):
                tree[node, c] = np.minimum(tree[2 * node, c], tree[2 * node + 1, c])
                node = node >> 1
        col = col[tree[1, col] != _NONE]
    return ids[:most], there[:most]


def merge_long(v: Vocabulary, piece: bytes) -> list[int]:
    """Encodes one long piece with a tree of its own."""
    n = len(piece)
    ids = v.first[np.frombuffer(piece, dtype=np.uint8)]
    leaves = 1 << max(0, n - 2).bit_length()
    none = 1 << 62
    ranks = v.ranks(ids[:-1], ids[1:]).astype(np.int64)
    tree = np.full(2 * leaves, none, dtype=np.int64)
    tree[leaves : leaves + n - 1] = np.where(ranks != _NONE, ranks * leaves + np.arange(n - 1), none)
    size = leaves
    while size > 1:
        tree[size // 2 : size] = np.minimum(tree[size : 2 * size : 2], tree[size + 1 : 2 * size : 2])
        size //= 2
    tree, ids = tree.tolist(), ids.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known = _pair_ranks(v)
    made = v.made

    def put(leaf: int, value: int) -> None:
        node = leaf + leaves
        tree[node] = value
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

    while (root := tree[1]) != none:
        rank, i = divmod(root, leaves)
        j = after[i]
        k = after[j]
        ids[i], ids[j], after[i] = int(made[rank]), -1, k
        if j < leaves:
            put(j, none)
        right = none
        if k < n:
            before[k] = i
            if (r := known.get((ids[i] << 32) | ids[k])) is not None:
                right = r * leaves + i
        put(i, right)
        if (h := before[i]) >= 0:
            r = known.get((ids[h] << 32) | ids[i])
            put(h, none if r is None else r * leaves + h)
    return [x for x in ids if x >= 0]


_known: dict[int, dict[int, int]] = {}


def _pair_ranks(v: Vocabulary) -> dict[int, int]:
    if id(v) not in _known:
        _known.clear()
        _known[id(v)] = dict(zip(v.pairs.tolist(), v.order.tolist(), strict=True))
    return _known[id(v)]


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of the rows between the offsets."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    kind = K.code_classes()[code]
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of each character
    n = len(code)
    edge = np.zeros(n + 1, dtype=bool)
    edge[np.searchsorted(at, offsets)] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    space = kind[runs] == 0
    start = np.zeros(n + 1, dtype=bool)
    start[runs[space]] = True
    followed = space & ~edge[ends]
    start[ends[followed] - 1] = True
    word = runs[~space]
    joined = np.zeros(len(word), dtype=bool)
    inner = ~edge[word]
    joined[inner] = code[word[inner] - 1] == 0x20
    start[word[~joined]] = True
    # contractions: an apostrophe alone, not joined to a space, before letters that begin with one of the endings
    alone = word[(code[word] == 0x27) & ~joined]
    alone = alone[~edge[alone + 1]]
    alone = alone[kind[alone + 1] == 1]
    if len(alone):
        a = code[alone + 1]
        b = np.where(edge[np.minimum(alone + 2, n)], 0, code[np.minimum(alone + 2, n - 1)])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[alone[one | two] + 1] = False
        start[alone[one] + 2] = True
        start[alone[two] + 3] = True
    first = at[np.flatnonzero(start[:n])]
    return first, np.append(first[1:], len(data))


class Encoder:
    """Ids of texts; keeps the ids of pieces it has met."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.said: dict[int, bytes] = {}
        self.start, self.size, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _keep(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.place), len(ids)
        while n + len(keys) > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while self.used + m > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + m] = ids
        self.size[n : n + len(keys)] = sizes
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.used += m
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _keys(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """np.unique of the pieces' keys. Pieces of one hash are compared with each other and with the kept piece; where
        they differ, the next free key is theirs."""
        keys, hashed = K.piece_keys(data, first, end)
        size = end - first
        while True:
            found, where, which = np.unique(keys, return_index=True, return_inverse=True)
            other = np.zeros(len(keys), dtype=bool)
            some = np.flatnonzero(hashed)
            one = where[which[some]]
            other[some] = (size[some] != size[one]) | K.differ(data, first[some], first[one], np.minimum(size[some], size[one]))
            for k, i in zip(found.tolist(), where.tolist(), strict=True):
                if hashed[i] and (kept := self.said.get(k)) is not None and kept != data[first[i] : end[i]].tobytes():
                    other |= (keys == np.uint64(k)) & hashed
            if not other.any():
                return found, where, which
            keys[other] += np.uint64(1)

    def _learn(self, keys: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        edges = [0, 1, 2, 3, 5, 9, 17, 33, BATCHED]
        for lo, hi in zip(edges, edges[1:], strict=False):
            some = np.flatnonzero((size > lo) & (size <= hi))
            if len(some):
                rows = first[some] + np.arange(hi)[:, None]
                pieces = np.where(np.arange(hi)[:, None] < size[some], data[np.minimum(rows, len(data) - 1)], 0)
                ids, there = merge_batch(self.v, pieces, size[some])
                self._keep(keys[some].tolist(), ids.T[there.T], there.sum(axis=0))
        for i in np.flatnonzero(size > BATCHED).tolist():
            ids = merge_long(self.v, data[first[i] : first[i] + size[i]].tobytes())
            self._keep([int(keys[i])], np.array(ids, np.int32), np.array([len(ids)]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin in them."""
        cuts, special = offsets, {}
        raw = data.tobytes() if self.v.added else b""
        for text, token in self.v.added.items():
            at = raw.find(text)
            while at >= 0:
                if int(np.searchsorted(offsets, at, side="right")) == int(np.searchsorted(offsets, at + len(text), side="left")):
                    special[at] = (at + len(text), token)
                    at = raw.find(text, at + len(text))
                else:
                    at = raw.find(text, at + 1)
        if special:
            cuts = np.unique(np.concatenate([offsets, list(special), [e for e, _ in special.values()]]))
        first, end = pieces_of(data, cuts)
        if special:
            kept = np.ones(len(first), dtype=bool)
            for a, (b, _) in special.items():
                lo, hi = np.searchsorted(first, [a, b])
                kept[lo + 1 : hi] = False
                end[lo] = b
            first, end = first[kept], end[kept]
        keys, where, which = self._keys(data, first, end)
        if len(self.place) + len(keys) > CACHE:
            self.clear()
        new = np.array([k not in self.place for k in keys.tolist()], dtype=bool)
        if new.any():
            at = where[new]
            self._learn(keys[new], data, first[at], end[at] - first[at])
            self.said.update((k, data[a:b].tobytes()) for k, a, b in zip(keys[new].tolist(), first[at].tolist(), end[at].tolist(), strict=True) if b - a > 7)
        place = np.array([self.place[k] for k in keys.tolist()], dtype=np.int64)[which]
        sizes, starts = self.size[place], self.start[place]
        ids = K.gather(self.ids, starts, sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if special:
            starts_of = np.searchsorted(first, list(special))
            for i, (_, token) in zip(starts_of.tolist(), special.values(), strict=True):
                ids[ends[i]] = token
                ids[ends[i] + 1 : ends[i + 1]] = -1
            kept = ids >= 0
            ends = np.concatenate([[0], np.cumsum(kept)])[ends]
            ids = ids[kept]
        return ids, ends[np.searchsorted(first, offsets)]


_encoders: dict[int, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    if id(v) not in _encoders:
        _encoders.clear()
        _encoders[id(v)] = Encoder(v)
    return _encoders[id(v)]


def _rows(column: pa.Array, v: Vocabulary) -> Iterator[np.ndarray]:
    encoder = _encoder(v)
    for _, _, data, offsets in K.blocks(column):
        ids, at = encoder.encode(data, offsets)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield ids[a:b]


def encode(df: DataFrame, vocabulary: str, text: str = "text", name: str = "ids") -> DataFrame:
    """df with an array<int> column of token ids. vocabulary: path of a tokenizer's JSON file on the driver."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield _lists(list(_rows(column, shared.value)))
        K.trim()

    return df.withColumn(name, F.arrow_udf(run, "array<int>")(F.col(text)))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text of an array<int> column of token ids; bytes that are no UTF-8 become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            sizes = column.value_lengths().fill_null(0).to_numpy()
            ends, flat = np.cumsum(sizes), column.flatten().to_numpy().astype(np.int64)
            yield K.strings([shared.value.decode(flat[b - n : b]).tobytes().decode("utf-8", "replace") for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
        K.trim()

    return df.withColumn(name, F.arrow_udf(run, "string")(F.col(ids)))


def encode_exactly(df: DataFrame, vocabulary: str, text: str = "text", name: str = "bpe") -> DataFrame:
    """df with a struct: ids, and whether they decode to the text (a null's to the empty one)."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared.value)
        for column in batches:
            rows, same = [], []
            for _, _, data, offsets in K.blocks(column):
                ids, at = encoder.encode(data, offsets)
                for a, b, lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    rows.append(ids[a:b])
                    same.append(bool(np.array_equal(shared.value.decode(ids[a:b]), data[lo:hi])))
            yield pa.StructArray.from_arrays([_lists(rows), pa.array(same, pa.bool_())], ["ids", "exact"])
        K.trim()

    return df.withColumn(name, F.arrow_udf(run, "struct<ids: array<int>, exact: boolean>")(F.col(text)))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", name: str = "bpe") -> DataFrame:
    """df with a struct: n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256 (of what the ids decode to)."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n, hashed, back = [], [], []
            for ids in _rows(column, shared.value):
                n.append(len(ids))
                hashed.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text = shared.value.decode(ids).tobytes().decode("utf-8", "replace")
                back.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), K.strings(hashed), K.strings(back)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.withColumn(name, F.arrow_udf(run, "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")(F.col(text)))
