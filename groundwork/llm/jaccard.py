"""Exact set-similarity self-join on word shingles with set-relation skipping, and its connected components.

1. A text's set is hashed; texts with equal sets form a class, and all further work is on classes.
2. A sketch of COUNTERS counters tells roughly how many texts have a shingle; its levels, then hashes, give a global
   order from rare to frequent (any one order is exact). Two classes that link share c = common(n) shingles among the first
   n - ceil(0.75 n) + c of each (n: the smaller size), so Python tasks post only those, packed by bucket of the shingle, and
   classes whose first shingles hardly occur elsewhere are out.
3. Of the rest, every shingle is counted exactly, in blocks of sets that send their distinct shingles. A class of which under 0.75
   occurs elsewhere is out. The others' index lists take the first n - ceil(0.75 n) + 1 shingles from rare to frequent, with position and size.
4. In each list every class is compared with one pivot only, that with the commonest shingles, and only where size and position let the
   shingle be the first common one (the list's other blocks are skipped). Overlaps are exact.
5. Answers are derived from the pivot's: classes linked to it are one component and need no comparison among themselves, and the
   overlaps with the pivot bound that of any two others. Lists left with several components take another pivot; when pivots
   link no more, the pairs of different components in neighbouring size blocks that no bound rules out are compared.

So no component is lost, and a group of copies costs a comparison for each member and list pivot. Defined results: texts without
words have empty sets and link with nothing; fewer than five words are one shingle; rows without id get their set's size
and no component and link nothing; repeated ids and rows are separate texts of the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from groundwork.functions.store import dropped as discarded
from groundwork.operators.components import components
from .store import dropped, written

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Counters of the sketch of text frequencies, and of a row of it.
COUNTERS = 1 << 22
CHUNK = 1 << 16
_COUNTER = np.uint64(64 - 22)
#: For so many shingles of a set its prefix is longer by one, and has one more in common with that of a linked set.
STEP = 25
#: Width of a block of sizes, a little over the logarithm of the largest ratio of linked sets.
WIDTH = 0.2877
#: Bytes of sets that a Python task of blocks holds.
HELD = 16_000_000
#: Keys that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Postings that a task holds before it hands them on.
PART = 1_000_000
_TOKEN_BITS = np.uint64(32)


def sets_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each row of a block."""
    data = K.LOWER[data]
    starts, ends, bounds = K.runs(K.NOT_SPACE[data], offsets)
    each = K.span_hashes(data, starts, ends)
    rolled = K.rolling(each, words)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            yield K.mix(K.rolling(each[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def common(n):
    """Shingles that the prefixes of two linked sets have in common, the smaller set's size being n."""
    return 1 + n // STEP


def _key(s: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int(K.mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15 & 0xFFFFFFFF)) >> 1


@K.udf("struct<n: long, cls: long>")
def _classes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        n, cls = [], []
        for _, _, data, offsets in K.blocks(column):
            for s in sets_of(data, offsets):
                n.append(len(s))
                cls.append(_key(s))
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(cls, pa.int64())], ["n", "cls"])


@K.udf("binary")
def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        yield pa.array([s.tobytes() for _, _, data, offsets in K.blocks(K.unpacked(column)) for s in sets_of(data, offsets)], pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have a shingle of each counter, as rows of CHUNK counters."""
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in K.blocks(batch.column(0)):
            found = [s >> _COUNTER for s in sets_of(data, offsets)]
            at, n = np.unique(np.concatenate(found), return_counts=True)
            counts[at] += n
    yield _chunks({i: counts[i * CHUNK : (i + 1) * CHUNK] for i in range(COUNTERS // CHUNK)})


def _chunks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack.compress(x.astype(np.int64).tobytes()) for x in sums.values()], pa.binary())], ["chunk", "counts"])


def _sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    unpack, sums = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(unpack.decompress(counts), np.int64)
            sums[chunk] = sums[chunk] + x if chunk in sums else x
    return sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _chunks(_sums(batches))


def _as_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _sums(batches)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_small(2 * np.log2(x + 1), np.uint8) for x in sums.values()], pa.binary())], ["chunk", "levels"])


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """For each counter the level (half powers of two) of the number of texts; COUNTERS bytes whatever the corpus."""
    kind = "chunk int, counts binary"
    parts = docs.select("t").mapInArrow(_sketch, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.repartition("chunk", "salt").select("chunk", "counts").mapInArrow(_added, kind)
    whole = parts.repartition("chunk").mapInArrow(_as_levels, "chunk int, levels binary")
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for row in whole.collect():  # in one job: COUNTERS bytes at most, as levels are made in the tasks
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = _large(row["levels"], np.uint8)
    return out


def _poster(shared, buckets: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        seen: dict[int, int] = {}
        tokens, size, names = [], 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            t = np.concatenate([*tokens, np.empty(0, np.uint64)])
            o = np.repeat(np.arange(len(names), dtype=np.uint32), [len(x) for x in tokens])
            bucket = t % np.uint64(buckets)
            order = np.lexsort((t, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            cls = np.array(names, dtype=np.int64)
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[b] : cuts[b + 1]]
                who, which = np.unique(o[some], return_inverse=True)
                steps = np.diff((t[some] >> _TOKEN_BITS).astype(np.uint32), prepend=np.uint32(0))
                rows.append((b, _small(steps, np.uint32), _small(which, np.uint16 if len(who) < 65536 else np.uint32), cls[who].tobytes()))
            for x in (tokens, names):
                x.clear()
            seen.clear()
            size = 0
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "token", "owner", "cls"])

        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0)):
                for s in sets_of(data, offsets):
                    key = _key(s)
                    if not len(s) or key in seen:
                        continue
                    seen[key] = 1
                    prefix = min(len(s), len(s) - (PERCENT * len(s) + 99) // 100 + common(len(s)))
                    order = (levels[s >> _COUNTER].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    first = s[np.argsort(order, kind="stable")[:prefix]]
                    tokens.append(first)
                    names.append(key)
                    size += len(first)
                if size > PART:
                    yield from flush()
        yield from flush()
        K.trim()

    return post


_POSTS = "bucket int, token binary, owner binary, cls binary"


def _sharer(parts: int):
    def shared(table: pa.Table) -> pa.Table:
        """For each class of a bucket, how many of its posted shingles another class has posted too: packed by part of the classes."""
        held = []
        for token, owner, cls in zip(*(table[c].to_pylist() for c in ("token", "owner", "cls")), strict=True):
            cls = np.frombuffer(cls, np.int64)
            held.append((np.cumsum(_large(token, np.uint32), dtype=np.uint32), cls[_large(owner, np.uint16 if len(cls) < 65536 else np.uint32)]))
        token, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls = token[new], cls[new]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[first, len(token)])
        some = np.repeat(size > 1, size)
        names, k = np.unique(cls[some], return_counts=True)
        part = names % parts
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [order[cuts[p] : cuts[p + 1]] for p in range(parts)]
        full = [p for p in range(parts) if len(rows[p])]
        return pa.table({"part": pa.array(full, pa.int32()), "cls": pa.array([names[rows[p]].tobytes() for p in full], pa.binary()), "k": pa.array([_small(k[rows[p]], np.uint32) for p in full], pa.binary())})

    return shared


def _summed(table: pa.Table) -> pa.Table:
    """cls, k over all buckets."""
    cls = np.concatenate([np.frombuffer(x, np.int64) for x in table["cls"].to_pylist()])
    k = np.concatenate([_large(x, np.uint32) for x in table["k"].to_pylist()])
    names, which = np.unique(cls, return_inverse=True)
    return pa.table({"cls": names, "k": np.bincount(which, weights=k).astype(np.int64)})


def _small(x: np.ndarray, kind) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _large(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _edges(buckets: int) -> np.ndarray:
    """The least hash of each bucket, and one more."""
    return np.array([min((1 << 64) * i // buckets, (1 << 64) - 1) for i in range(buckets + 1)], dtype=np.uint64)


def _joined(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a block's sets, and how many each has."""
    return np.frombuffer(b"".join(sets), np.uint64), np.array([len(s) // 8 for s in sets], dtype=np.int64)


def _counter(buckets: int):
    edges = _edges(buckets)

    def send(table: pa.Table) -> pa.Table:
        """A block's distinct shingles, by bucket, with their numbers of classes."""
        found, n = np.unique(_joined(table["s"].to_pylist())[0], return_counts=True)
        cuts = np.searchsorted(found, edges)
        cuts[-1] = len(found)
        some = np.flatnonzero(np.diff(cuts))
        words = [(found[cuts[b] : cuts[b + 1]] >> np.uint64(16)).astype(np.uint32).tobytes() for b in some]
        times = [_small(n[cuts[b] : cuts[b + 1]], np.uint32) for b in some]
        return pa.table({"bucket": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), table["block"][0].as_py(), np.int32)), "token": pa.array(words, pa.binary()), "times": pa.array(times, pa.binary())})

    return send


def _levels(table: pa.Table) -> pa.Table:
    """The level (quarter powers of two, 0 for one class) of each shingle that the blocks have sent to a bucket."""
    tokens = [np.frombuffer(x, np.uint32) for x in table["token"].to_pylist()]
    times = np.concatenate([_large(x, np.uint32) for x in table["times"].to_pylist()])
    _, which = np.unique(np.concatenate(tokens), return_inverse=True)
    level = np.minimum(4 * np.log2(np.bincount(which, weights=times)), 255).astype(np.uint8)[which]
    cuts = np.cumsum([0, *map(len, tokens)])
    return pa.table({"block": table["block"], "bucket": table["bucket"], "level": pa.array([_small(level[a:b], np.uint8) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


_LISTS = "token long, cls long, n long, place int, typ int"


def _prefixes(sets: pa.Table, replies: pa.Table) -> pa.Table:
    """List entries of a block's classes: the first shingles, from rare to frequent, that some other class has.

    typ is the mean level of a class: copies of one text have the more of each other's shingles the closer they are to it.
    """
    shingles, sizes = _joined(sets["s"].to_pylist())
    _, which = np.unique(shingles, return_inverse=True)
    said = sorted(zip(replies["bucket"].to_pylist(), replies["level"].to_pylist(), strict=True))
    level = np.concatenate([*(_large(x, np.uint8) for _, x in said), np.empty(0, np.uint8)])[which]
    ends = np.cumsum(sizes)
    token, at, place, typ = [], [], [], []
    for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        n, x, s = b - a, level[a:b], shingles[a:b]
        if np.count_nonzero(x) < -(-PERCENT * n // 100):
            continue
        first = np.argsort((x.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[: n - (PERCENT * n + 99) // 100 + 1]
        kept = np.flatnonzero(x[first])
        token.append(s[first[kept]].view(np.int64))
        place.append(kept)
        at.append(np.full(len(kept), i))
        typ.append(np.full(len(kept), int(1000 * x.mean())))
    token, at, place, typ = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (token, at, place, typ))
    cls = np.array(sets["cls"].to_pylist(), dtype=np.int64)
    return pa.table({"token": token, "cls": cls[at], "n": sizes[at], "place": place.astype(np.int32), "typ": typ.astype(np.int32)})


def _compared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Exact overlaps of a block's pairs."""
    of = {c: np.frombuffer(s, np.uint64) for c, s in zip(sets["cls"].to_pylist(), sets["s"].to_pylist(), strict=True)}
    both = []
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
        x, y = of[a], of[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both.append(int(np.count_nonzero(y[at] == x)))
    o = np.array(both, dtype=np.int64)
    n, m = (np.array([len(of[c]) for c in pairs[k].to_pylist()], dtype=np.int64) for k in ("a", "b"))
    return pa.table({"a": pairs["a"], "b": pairs["b"], "o": o, "linked": 100 * o >= PERCENT * (n + m - o)})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, o (overlap), linked of written pairs (a, b, n, m), which are removed; a: the pivot, b: its partners.

    A pivot's pairs go to one block, or to several if they're many, so a set goes once to each block that has a pair of it.
    The blocks' number follows the pairs' bytes.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, (pairs.agg(F.sum(8 * (F.col("n") + F.col("m")))).first()[0] or 0) // HELD + 1)
    shares = pairs.groupBy("a").agg(F.ceil(F.sum(8 * F.col("m")) / (HELD // 4)).alias("shares"))
    placed = written(pairs.join(shares, "a").withColumn("block", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), "shares")), F.lit(blocks))).select("block", "a", "b"), "placed", "uncompressed")
    block = (F.col("block") + 0).alias("of_block")
    wanted = written(placed.select(block, F.col("a").alias("cls")).unionByName(placed.select(block, F.col("b").alias("cls"))).distinct(), "wanted", "uncompressed")
    needed = sets.select("cls", "s").join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "cls")
    found = written(placed.groupBy("block").cogroup(needed.groupBy("of_block")).applyInArrow(_compared, "a long, b long, o long, linked boolean"), "compared", "uncompressed")
    dropped(pairs, placed, wanted)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("d"), F.col(text).alias("t"))
    named = written(rows.select("d", _classes(F.col("t")).alias("c"), F.xxhash64("t").alias("h")).select("d", "h", "c.n", "c.cls"), "classes")
    real = named.filter("n > 0 and d is not null")
    classes = real.groupBy("cls", "n").agg(F.min("d").alias("rep"), F.min(F.struct("d", "h")).alias("of"))
    found = _components(rows.filter("d is not null"), classes)
    of_class = classes.select("cls", "n", "rep").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "component").select("cls", "n", "component_id")
    out = named.join(of_class, ["cls", "n"], "left")
    return out.select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("d").isNotNull(), F.coalesce("component_id", "d")).alias("component_id"))


def _able(spark: SparkSession, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, n of the classes that have enough first shingles in common with others to link with one of them."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(frequency_levels(rows))
    posts = rows.select("t").mapInArrow(_poster(shared, buckets), _POSTS)
    found = posts.groupBy("bucket").applyInArrow(_sharer(buckets), "part int, cls binary, k binary").groupBy("part").applyInArrow(_summed, "cls long, k long")
    enough = 1 + F.floor(F.col("n") * PERCENT / 100 / STEP)
    return written(found.join(classes.select("cls", "n"), "cls").filter(F.col("k") >= enough).select("cls", "n"), "able")


def _components(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """node, component of the classes that link."""
    spark = rows.sparkSession
    able = _able(spark, rows, classes)
    sets = _sets_of(rows, classes, able)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, 8 * (able.agg(F.sum("n")).first()[0] or 0) // HELD + 1)
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int"))
    sent = dealt.groupBy("block").applyInArrow(_counter(4 * parts), "bucket int, block int, token binary, times binary")
    replies = sent.groupBy("bucket").applyInArrow(_levels, "block int, bucket int, level binary")
    lists = written(dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_prefixes, _LISTS), "lists")
    found = _rounds(lists, sets)
    dropped(able, sets, lists)
    return found


def _possible(n: str, m: str, i: str, j: str) -> Column:
    """Whether a common shingle at places i and j can be the first one of linked sets of n and m.

    Linked sets have o = ceil(0.75 / 1.75 (n + m)) common shingles at least, so the first of them leaves o of either set from
    its place on.
    """
    need = f"ceil({PERCENT} * ({n} + {m}) / {100 + PERCENT})"
    return F.expr(f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m}) and {i} <= {n} - {need} and {j} <= {m} - {need}")


def _derived(n: str, m: str, o: str, q: str) -> Column:
    """Whether sets of n and m, with overlaps of o and q with one pivot, can link: they have no more in common than the lesser
    overlap and the lesser rest."""
    most = f"(least({o}, {q}) + least({n} - {o}, {m} - {q}))"
    return F.coalesce(F.expr(f"100 * {most} >= {PERCENT} * ({n} + {m} - {most})"), F.lit(True))


def _starred(lists: DataFrame) -> DataFrame:
    """Lists of several components, a row for each class but the pivot: that of the highest typ, then of the largest name."""
    best = lists.groupBy("token").agg(F.max(F.struct("typ", "cls", "n", "place", "component", "o")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high"))
    best = best.filter("low <> high").select("token", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("cls", "n", "place", "component", "o")))
    return lists.join(best, "token").filter("cls <> p_cls")


def _rounds(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """node, component. lists: token, cls, n, place, typ."""
    kept = ["token", "cls", "n", "place", "typ"]
    lists = lists.withColumn("component", F.col("cls")).withColumn("o", F.lit(None).cast("long"))
    done = links = None
    compared = []
    while True:
        star = written(_starred(lists), "stars")
        able = star.filter("component <> p_component").filter(_possible("p_n", "n", "p_place", "place")).filter(_derived("p_n", "n", "p_o", "o"))
        pairs = able.select(F.col("p_cls").alias("a"), F.col("cls").alias("b"), F.col("p_n").alias("n"), F.col("n").alias("m")).distinct()
        seen = _verified(written(pairs if done is None else _unknown(pairs, done), "candidates", "uncompressed"), sets)
        compared.append(seen)
        new = seen.filter("linked").select("a", "b")
        more = links is None or not new.isEmpty()
        done = seen if done is None else done.unionByName(seen)
        links = _joined_components(links, new) if more else links
        # what a pivot leaves: lists with a class outside of its component, without the pivot
        apart = _with_components(star.select("p_cls", "cls").distinct(), links, "cls", "component").transform(lambda x: _with_components(x, links, "p_cls", "p_component"))
        apart = apart.filter("component <> p_component").select("p_cls", "cls")
        tokens = star.join(apart, ["p_cls", "cls"], "left_semi").select("token").distinct()
        left = _with_components(star.join(tokens, "token", "left_semi").select(*kept, "p_cls"), links, "cls", "component")
        left = left.join(seen.select(F.col("a").alias("p_cls"), F.col("b").alias("cls"), "o"), ["p_cls", "cls"], "left")
        mixed = left.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
        before, lists = lists, written(left.join(mixed, "token", "left_semi").select(*kept, "component", "o"), "open")
        dropped(star, before)
        if not more or lists.isEmpty():
            break
    last = _verified(written(_unknown(_across(lists), done), "candidates", "uncompressed"), sets)
    new = last.filter("linked").select("a", "b")
    found = links if new.isEmpty() else _joined_components(links, new)
    dropped(lists, last, *compared)
    return found


def _joined_components(links: DataFrame | None, new: DataFrame) -> DataFrame:
    """The components of links and new; the table of links is removed."""
    if links is None:
        return components(new)
    found = components(links.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))
    discarded(links)
    return found


def _across(lists: DataFrame) -> DataFrame:
    """Pairs of classes of one list in different components that size, position and the pivot's overlaps leave possible. Lists are cut into
    blocks by size, so only blocks of the same and the next sizes meet."""
    band = F.floor(F.log("n") / WIDTH)
    x, y = (lists.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("cls", "n", "place", "component", "o")), at.alias("band")) for side, at in (("x", F.explode(F.array(band, band + 1))), ("y", band)))
    both = x.join(y, ["token", "band"]).filter("x_component <> y_component and (x_n < y_n or x_n = y_n and x_cls < y_cls)")
    both = both.filter(_possible("x_n", "y_n", "x_place", "y_place")).filter(_derived("x_n", "y_n", "x_o", "y_o"))
    return both.select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b"), F.col("x_n").alias("n"), F.col("y_n").alias("m")).distinct()


def _unknown(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that haven't been compared in either direction."""
    known = done.select("a", "b").unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(known, ["a", "b"], "left_anti")


def _with_components(rows: DataFrame, links: DataFrame, cls: str, name: str) -> DataFrame:
    """The component of a class, itself where it has no link."""
    return rows.join(links.select(F.col("node").alias(cls), F.col("component").alias(name)), cls, "left").withColumn(name, F.coalesce(name, cls))


def _sets_of(rows: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, s: the sets of the wanted classes, each from one text."""
    of = classes.join(wanted.select("cls"), "cls", "left_semi").select("cls", F.col("of.d").alias("d"), F.col("of.h").alias("h"))
    packed = rows.select("d", F.xxhash64("t").alias("h"), K.packed(F.col("t")).alias("t"))
    text = packed.join(of, ["d", "h"]).groupBy("cls", "d", "h").agg(F.first("t").alias("t"))
    return written(text.select("cls", _sets(F.col("t")).alias("s")), "sets")
