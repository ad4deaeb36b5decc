"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and cut into runs of letters; each run is read as a padded character sequence. Python tasks
count the five-grams of their rows per language; Spark adds them up, derives the lower orders' continuation counts,
discounts and interpolated probabilities with grouping and joins. Every counted gram stays in the model, which stays in
tables and grows with the text: to score texts, the probabilities of the five-grams that occur in them are joined together
from order to order, and broadcast - sorted hashes with a column of log probabilities for each language - in blocks of at
most BLOCK_CELLS numbers on average, by gram hash. What an executor holds is so bounded whatever the model's size: a usual
model is one block; a larger one takes a pass over the texts for each block, and the passes' sums are added by text.

A text gets the language of the lowest cross-entropy per character. It is marked as rejected if that entropy exceeds
what CUT of the calibration rows of the language have. Defined results: a null text, or one without letters, is `und`
with score 0, rejected; without any labelled row every text is `und`; ties take the first language by name; other columns and
repeated rows pass through.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import written

ORDER = 5
CUT = 0.999
#: Distinct five-grams a task holds before it hands on what it has counted.
FLUSH = 400_000
CACHE = 500_000
#: Numbers of four bytes in one broadcast; a gram takes one for each language and two for its hash.
BLOCK_CELLS = 1 << 24
_BEGIN, _END = 2, 3
_SHARPNESS = 12.0


def padded(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between ORDER-1 begin marks and an end mark, one after another, and where each starts."""
    size = ends - starts
    whole = size + ORDER
    at = np.cumsum(whole) - whole
    out = np.full(int(whole.sum()), _BEGIN, dtype=np.uint32)
    to = np.arange(int(size.sum())) + np.repeat(at + ORDER - 1 - (np.cumsum(size) - size), size)
    out[to] = K.gather(codes, starts, size)
    out[at + whole - 1] = _END
    return out, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    names: dict[int, str] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, names[k], n) for lang, found in counts.items() for k, n in found.items()]
        counts.clear()
        names.clear()
        lang, gram, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([K.strings(list(lang)), K.strings(list(gram)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            rows = batch.column(0).filter(pa.array([x == lang for x in langs]))
            for _, _, data, offsets in K.blocks(rows):
                codes, starts, ends, _ = K.letter_words(data, offsets)
                if not len(starts):
                    continue
                keys, first, times = np.unique(K.span_hashes(codes, starts, ends), return_index=True, return_counts=True)
                text, at = padded(codes, starts[first], ends[first])
                size = ends[first] - starts[first] + 1
                begin = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
                grams = K.grams(text, ORDER)[begin]
                each = np.repeat(times, size)
                keys, where, which = np.unique(grams, return_index=True, return_inverse=True)
                total = np.bincount(which, weights=each).astype(np.int64)
                own = counts[lang]
                for k, n, p in zip(keys.tolist(), total.tolist(), begin[where].tolist(), strict=True):
                    own[k] += n
                    if k not in names:
                        names[k] = text[p : p + ORDER].tobytes().decode("utf-32-le")
                if len(names) > FLUSH:
                    yield flush()
    yield flush()
    K.trim()


def gram_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram (five characters), n over every row with a language."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("l is not null and t is not null")
    return rows.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The five-grams of texts, without most of the repetitions."""
    words: set[int] = set()
    grams: set[int] = set()
    for batch in batches:
        out: list[str] = []
        for _, _, data, offsets in K.blocks(batch.column(0)):
            codes, starts, ends, _ = K.letter_words(data, offsets)
            if not len(starts):
                continue
            keys, first = np.unique(K.span_hashes(codes, starts, ends), return_index=True)
            first = first[[k not in words for k in keys.tolist()]]
            if not len(first):
                continue
            words = set() if len(words) > CACHE else words
            words.update(keys.tolist())
            text, at = padded(codes, starts[first], ends[first])
            size = ends[first] - starts[first] + 1
            begin = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
            keys, where = np.unique(K.grams(text, ORDER)[begin], return_index=True)
            where = where[[k not in grams for k in keys.tolist()]]
            grams = set() if len(grams) > FLUSH else grams
            grams.update(keys.tolist())
            said = text[begin[where][:, None] + np.arange(ORDER)].tobytes().decode("utf-32-le")
            out += [said[i : i + ORDER] for i in range(0, len(said), ORDER)]
        yield pa.RecordBatch.from_arrays([K.strings(out)], ["gram"])
    words, grams = set(), set()
    K.trim()


def grams_of(df: DataFrame, text: str) -> DataFrame:
    """gram: the distinct five-grams of all texts."""
    return df.select(F.col(text).alias("t")).filter("t is not null").mapInArrow(_needed, "gram string").distinct()


def gathered(df: DataFrame, name: str) -> DataFrame:
    """df as a written table of a file a core at most, by tasks that take one partition after another: each file that an executor writes to a local folder
    takes processes of its own."""
    return written(df.coalesce(df.sparkSession.sparkContext.defaultParallelism), name)


def statistics(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of interpolated Kneser-Ney: k, lang, gram, own (discounted share of its context) and
    k, lang, h, bow (what the context leaves to the order below).

    The highest order has the counts; below, a gram counts once for each character that is seen before it.
    """
    counts = gathered(counts.withColumn("k", F.lit(ORDER)), "grams")
    every = level = counts
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")).withColumn("k", F.lit(k))
        every = every.unionByName(level)
    every = gathered(every, "orders")
    ones = F.sum(F.when(F.col("n") == 1, 1).otherwise(0))
    twos = F.sum(F.when(F.col("n") == 2, 1).otherwise(0))
    discount = every.groupBy("lang", "k").agg(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.coalesce(F.try_divide(ones, ones + 2 * twos), F.lit(0.5)))).alias("d"))
    every = every.join(F.broadcast(discount), ["lang", "k"]).withColumn("h", F.expr("substring(gram, 1, k - 1)"))  # a row for each language and order
    context = every.groupBy("lang", "k", "h").agg(F.sum("n").alias("c"), F.count("*").alias("types"), F.first("d").alias("d"))
    grams = every.join(context.select("lang", "k", "h", "c"), ["lang", "k", "h"])
    return grams.select("k", "lang", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("c")).alias("own")), context.select("k", "lang", "h", (F.col("d") * F.col("types") / F.col("c")).alias("bow"))


def _hash(grams: list[str], k: int) -> np.ndarray:
    """Hashes of texts of k characters, in pieces."""
    some = K.BLOCK_BYTES // k
    pieces = (np.frombuffer("".join(grams[i : i + some]).encode("utf-32-le"), dtype=np.uint32) for i in range(0, len(grams), some))
    return np.concatenate([np.empty(0, np.uint64), *(K.grams(x, k)[::k] for x in pieces)])


def _find(keys: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
    at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
    return at, keys[at] == hashed


class Model:
    """A whole model in one place, to look at small ones: for each order the sorted hashes of all languages' grams with a
    column of log probabilities a language."""

    def __init__(self, grams: pa.Table, contexts: pa.Table):
        self.langs = pa.compute.unique(grams["lang"]).sort().to_pylist() if len(grams) else []
        self.keys, self.logs, self.contexts, self.weights = {}, {}, {}, {}
        letters = len(set(grams.filter(pa.compute.equal(grams["k"], 1))["gram"].to_pylist()))
        for k in range(1, ORDER + 1):
            keys, _, bow = self._columns(contexts, k, "h", "bow", k - 1, 1.0)
            self.contexts[k], self.weights[k] = keys, np.log(bow).astype(np.float32)
            keys, text, own = self._columns(grams, k, "gram", "own", k, 0.0)
            if k == 1:
                self.floor = (np.log(bow[0]) if len(bow) else np.zeros(len(self.langs))).astype(np.float32) - np.float32(np.log(letters + 1))
                lower = np.broadcast_to(self.floor, own.shape)
            else:
                lower = self._look(k - 1, text[:, 1:]) + self._weight(k, text[:, :-1])
            self.keys[k], self.logs[k] = keys, np.log(own + np.exp(lower.astype(np.float64))).astype(np.float32)

    def _columns(self, table: pa.Table, k: int, name: str, value: str, size: int, fill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of an order's texts, the texts' characters, and the value in each language."""
        table = table.filter(pa.compute.equal(table["k"], k))
        text = np.frombuffer("".join(table[name].to_pylist()).encode("utf-32-le"), dtype=np.uint32).reshape(len(table), size)
        hashed = K.grams(text.ravel(), size)[::size] if size and len(table) else np.zeros(len(table), np.uint64)
        keys, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        out = np.full((len(keys), len(self.langs)), fill)
        if len(table):
            out[which, pa.compute.index_in(table["lang"].combine_chunks(), pa.array(self.langs, pa.string())).to_numpy()] = table[value].to_numpy()
        return keys, text[first], out

    def _weight(self, k: int, text: np.ndarray) -> np.ndarray:
        at, found = _find(self.contexts[k], K.grams(np.ascontiguousarray(text).ravel(), k - 1)[:: k - 1])
        return np.where(found[:, None], self.weights[k][at] if len(self.weights[k]) else 0, 0).astype(np.float32)

    def _look(self, k: int, text: np.ndarray) -> np.ndarray:
        """Log probabilities of rows of k characters."""
        if not len(text):
            return np.empty((0, len(self.langs)), np.float32)
        at, found = _find(self.keys[k], K.grams(np.ascontiguousarray(text).ravel(), k)[::k])
        out = np.empty((len(text), len(self.langs)), dtype=np.float32)
        out[found] = self.logs[k][at[found]]
        gone = ~found
        if gone.any():
            rest = text[gone]
            out[gone] = self.floor if k == 1 else self._look(k - 1, rest[:, 1:]) + self._weight(k, rest[:, :-1])
        return out


class Trained:
    """A model of all counted grams in tables: own (k, gram, own) and left (k, h, bow) have a number for each of langs."""

    def __init__(self, grams: DataFrame, contexts: DataFrame):
        self.grams, self.contexts = grams, contexts
        self.langs = sorted(r.lang for r in self.grams.filter("k = 1").select("lang").distinct().collect())
        if self.langs:
            self.own = gathered(self._wide(self.grams, "gram", "own", 0.0), "own")
            self.left = gathered(self._wide(self.contexts, "h", "bow", 1.0), "left")

    @cached_property
    def value(self) -> Model:
        return Model(self.grams.toArrow(), self.contexts.toArrow())

    def _wide(self, table: DataFrame, key: str, value: str, fill: float) -> DataFrame:
        by_lang = F.map_from_entries(F.collect_list(F.struct("lang", value)))  # one entry for each language at most
        each = F.transform(F.array(*map(F.lit, self.langs)), lambda x: F.coalesce(F.try_element_at("by_lang", x), F.lit(fill)))
        return table.groupBy("k", key).agg(by_lang.alias("by_lang")).select("k", key, each.alias(value))

    def probabilities(self, needed: DataFrame) -> DataFrame:
        """gram, p: the probability in each language of the last character of each five-gram after the others."""
        every = needed.select("gram", F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("k")).select("k", F.expr(f"substring(gram, {ORDER + 1} - k, k)").alias("gram"))
        every = gathered(every.distinct(), "needed")
        letters = self.own.filter("k = 1").count()
        lower = self.left.filter("k = 1").select(F.transform("bow", lambda x: x / (letters + 1)).alias("below"))
        out = every.filter("k = 1").select("gram").crossJoin(F.broadcast(lower))  # one row
        for k in range(1, ORDER + 1):
            if k > 1:
                bow = self.left.filter(f"k = {k}").select("h", "bow")
                out = every.filter(f"k = {k}").select("gram", F.expr("substring(gram, 1, k - 1)").alias("h"), F.expr("substring(gram, 2, k - 1)").alias("rest")).join(out, "rest").join(bow, "h", "left")
                out = out.select("gram", F.when(F.col("bow").isNull(), F.col("p")).otherwise(F.zip_with("bow", "p", lambda x, y: x * y)).alias("below"))
            out = out.join(self.own.filter(f"k = {k}").select("gram", "own"), "gram", "left")
            p = F.when(F.col("own").isNull(), F.col("below")).otherwise(F.zip_with("own", "below", lambda x, y: x + y)).alias("p")
            out = out.select("gram" if k == ORDER else F.col("gram").alias("rest"), p)
        return out


class Block:
    """Sorted hashes of five-grams with a column of log probabilities for each language."""

    def __init__(self, table: pa.Table, langs: int):
        hashed = _hash(table["gram"].to_pylist(), ORDER)
        self.langs = langs
        self.keys, first = np.unique(hashed, return_index=True)
        p = table["p"].combine_chunks().flatten().to_numpy() if len(table) else np.empty(0)
        self.logs = np.log(p).astype(np.float32).reshape(-1, langs)[first]

    def words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What the block's grams add to the log probability of each word in each language."""
        text, at = padded(codes, starts, ends)
        size = ends - starts + 1
        first = np.cumsum(size) - size
        begin = np.arange(int(size.sum())) + np.repeat(at - first, size)
        grams, which = np.unique(K.grams(text, ORDER)[begin], return_inverse=True)
        at, found = _find(self.keys, grams)
        logs = np.zeros((len(grams), self.langs), np.float32)
        logs[found] = self.logs[at[found]]
        return np.add.reduceat(logs[which], first, axis=0)


class Scorer:
    """Log probabilities of texts; keeps the words it has met."""

    def __init__(self, block: Block):
        self.block, self.place = block, {}
        self.logs = np.empty((1 << 16, block.langs), np.float32)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters, and the block's part of the log probability in each language, of each row."""
        codes, starts, ends, bounds = K.letter_words(data, offsets)
        rows = len(offsets) - 1
        if not len(starts):
            return np.zeros(rows, np.int64), np.zeros((rows, self.block.langs))
        keys, where, which = np.unique(K.span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        if len(self.place) + len(keys) > CACHE:
            self.place.clear()
        new = np.flatnonzero(np.array([k not in self.place for k in keys.tolist()], dtype=bool))
        if len(new):
            n = len(self.place)
            while n + len(new) > len(self.logs):
                self.logs = np.vstack([self.logs, np.empty_like(self.logs)])
            self.logs[n : n + len(new)] = self.block.words(codes, starts[where[new]], ends[where[new]])
            self.place.update(zip(keys[new].tolist(), range(n, n + len(new)), strict=True))
        logs = self.logs[np.array([self.place[k] for k in keys.tolist()], dtype=np.int64)].astype(np.float64)[which]
        sums = np.vstack([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
        chars = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        return chars[bounds[1:]] - chars[bounds[:-1]], sums[bounds[1:]] - sums[bounds[:-1]]


_scorers: dict[int, Scorer] = {}


def _scorer(block: Block) -> Scorer:
    if id(block) not in _scorers:
        _scorers.clear()
        _scorers[id(block)] = Scorer(block)
    return _scorers[id(block)]


def _summer(shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(shared.value)
        kind = pa.struct([("chars", pa.int64()), ("logs", pa.list_(pa.float64()))])
        for column in batches:
            found = [scorer.score(data, offsets) for _, _, data, offsets in K.blocks(column)]
            chars = np.concatenate([np.empty(0, np.int64), *(c for c, _ in found)])
            logs = np.concatenate([np.empty(0), *(x.ravel() for _, x in found)])
            ends = np.arange(len(chars) + 1, dtype=np.int32) * scorer.block.langs
            yield pa.StructArray.from_arrays([pa.array(chars), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(logs))], fields=list(kind))

    return F.arrow_udf(run, "struct<chars: long, logs: array<double>>")


def _sums(df: DataFrame, model: Trained, text: str, cells: int) -> DataFrame:
    """df with _sums: characters, and the log probability in each language, of each text."""
    table = gathered(model.probabilities(grams_of(df, text)), "probabilities")
    n, width = max(1, math.ceil(table.count() * (len(model.langs) + 2) / cells)), len(model.langs)
    parts = None
    for k in range(n):
        block = table if n == 1 else table.filter(F.pmod(F.xxhash64("gram"), F.lit(n)) == k)
        shared = df.sparkSession.sparkContext.broadcast(Block(block.toArrow(), width))
        if n == 1:
            return df.withColumn("_sums", _summer(shared)(F.col(text)))
        part = df.select(F.xxhash64(text).alias("_h"), _summer(shared)(F.col(text)).alias("s")).groupBy("_h").agg(F.first("s").alias("s"))  # equal texts have equal sums
        part = written(part.select("_h", "s.chars", "s.logs"), "sums")
        shared.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    every = parts.groupBy("_h").agg(F.struct(F.max("chars").alias("chars"), F.array(*(F.sum(F.col("logs")[i]) for i in range(width))).alias("logs")).alias("_sums"))
    return df.withColumn("_h", F.xxhash64(text)).join(every, "_h", "left").drop("_h")


def identify(df: DataFrame, model: Trained, text: str = "text", name: str = "language", cells: int = BLOCK_CELLS) -> DataFrame:
    """df with a struct: lang, score, nats (a character, in that language). model: what train() returns."""
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("nats"))
    if not model.langs:
        return df.withColumn(name, none)
    chars, logs = F.col("_sums.chars"), F.col("_sums.logs")
    size, most = F.greatest(chars, F.lit(1)), F.array_max(logs)
    lang = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position(logs, most).cast("int"))
    others = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(_SHARPNESS * (x - most) / size))
    found = F.struct(lang.alias("lang"), (1 / others).alias("score"), (-most / size).alias("nats"))
    return _sums(df, model, text, cells).withColumn(name, F.when(chars > 0, found).otherwise(none)).drop("_sums")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Trained:
    """A model of all labelled rows."""
    return Trained(*statistics(gram_counts(labelled, text, lang)))


def entropy_limits(identified: DataFrame, name: str = "language", cut: float = CUT) -> DataFrame:
    """lang, limit: the entropy that the share `cut` of the calibration rows, which identify() has seen, of a language stay under."""
    seen = identified.select(f"{name}.lang", f"{name}.nats").filter("lang <> 'und'")
    return seen.groupBy("lang").agg(F.percentile_approx("nats", cut, 1000).alias("limit"))


def reject(identified: DataFrame, limits: DataFrame, name: str = "language") -> DataFrame:
    """Adds the boolean `rejected` to what identify() has added; limits has a row for each language."""
    limit = F.broadcast(limits.select(F.col("lang").alias("_limit_of"), F.col("limit").alias("_limit")))
    out = identified.join(limit, F.col(f"{name}.lang") == F.col("_limit_of"), "left")
    return out.withColumn("rejected", F.col("_limit").isNull() | (F.col(f"{name}.nats") > F.col("_limit"))).drop("_limit_of", "_limit")


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
