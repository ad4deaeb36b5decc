"""Toxicity by a counterfactual-regularised classifier.

Features are the words of a text (runs of letters, lower-cased) and their first four to six letters, which takes in
inflected forms; each counts once a text. Spark counts features by label, and those with the clearest difference
enter a logistic regression. Each labelled text with identity terms gets a counterfactual, in which every such term is
swapped for another of its group; the squared change of the score's logit is penalised, so that weight does not settle on mentions of
a group. Newton steps add up gradients and curvatures of the rows' partitions.

Learning takes at most max_labelled labelled rows, those of the least id hash, which bounds the broadcast of their ids and labels;
scoring covers every row. Defined results: a null or empty text has no feature and the score of the intercept;
without labelled rows, or with one label only, every score is that label's share (0.5 without any); a null label is no label, of
several labels of an id the highest counts; other columns and repeated rows pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import dropped, written

MAX_LABELLED = 20_000
FEATURES = 384
#: Texts that a feature must be in, of one label at least.
SUPPORT = 4
RIDGE = 0.05
#: Weight of the counterfactual penalty, for each text with identity terms.
COUNTERFACTUAL = 2.0
STEPS = 12
THRESHOLD = 0.7
_PREFIXES = (4, 5, 6)
#: Identity terms; the terms of a line may stand for one another.
IDENTITY_TERMS = [
    "women men girls boys woman man girl boy",
    "muslim christian jewish hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists",
    "black white asian latino arab african european",
    "gay straight lesbian bisexual transgender queer",
    "immigrants refugees foreigners citizens natives",
    "old young elderly teenage disabled deaf blind",
    "frauen männer mädchen jungen muslime christen juden ausländer",
    "femmes hommes filles garçons musulmans chrétiens juifs étrangers",
    "mujeres hombres niñas niños musulmanes cristianos judíos extranjeros",
]


def _features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of words, and the word each comes from."""
    size = ends - starts
    out, of = [K.span_hashes(codes, starts, ends)], [np.arange(len(starts))]
    for k in _PREFIXES:
        long = np.flatnonzero(size >= k)
        out.append(K.mix(K.span_hashes(codes, starts[long], starts[long] + k) + np.uint64(k)))
        of.append(long)
    return np.concatenate(out), np.concatenate(of)


def _word_features(words: list[str]) -> list[np.ndarray]:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(w) for w in words])
    f, of = _features(codes, ends - [len(w) for w in words], ends)
    return [f[of == i] for i in range(len(words))]


class Swaps:
    """For the hash of an identity term, the features that go and those that come with its stand-in."""

    def __init__(self):
        self.by_word: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for line in IDENTITY_TERMS:
            words = line.split()
            own = _word_features(words)
            for i, f in enumerate(own):
                self.by_word[int(f[0])] = (f, own[(i + 1) % len(words)])
        self.keys = np.sort(np.array(list(self.by_word), dtype=np.uint64))


def row_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row the distinct features, and the distinct hashes of whole words."""
    codes, starts, ends, bounds = K.letter_words(data, offsets)
    f, of = _features(codes, starts, ends)
    row = np.searchsorted(bounds, of, side="right") - 1
    order = np.argsort(row, kind="stable")
    f, cut = f[order], np.searchsorted(row[order], np.arange(len(offsets)))
    words = K.span_hashes(codes, starts, ends)
    for i in range(len(offsets) - 1):
        yield np.unique(f[cut[i] : cut[i + 1]]), words[bounds[i] : bounds[i + 1]]


def _among(keys: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Which of f are among the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, f), len(keys) - 1)] == f if len(keys) else np.zeros(len(f), dtype=bool)


def _counts(wanted, positive: bool):
    """Texts of each label that have a feature: of texts of label 1 all features, or of all texts the wanted features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        held, labels = [], []

        def flush() -> pa.RecordBatch:
            f = np.concatenate([*held, np.empty(0, np.uint64)])
            y = np.repeat(np.array(labels, dtype=np.int64), [len(x) for x in held])
            keys, which, n = np.unique(f, return_inverse=True, return_counts=True)
            pos = np.bincount(which, weights=y, minlength=len(keys)).astype(np.int64)
            held.clear()
            labels.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(pos)], ["f", "n", "pos"])

        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, _, data, offsets in K.blocks(batch.column(0)):
                for i, (f, _) in enumerate(row_features(data, offsets)):
                    held.append(f if keep is None else f[_among(keep, f)])
                    labels.append(int(y[lo + i]))
                if sum(map(len, held)) > 1_000_000:
                    yield flush()
        yield flush()
        K.trim()

    return run


class Classifier:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, intercept: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.intercept = keys[order], weights[order], intercept

    def place(self, f: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
        return np.unique(at[self.keys[at] == f])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, starts, ends, bounds = K.letter_words(data, offsets)
        f, of = _features(codes, starts, ends)
        n = len(self.keys)
        z = np.full(len(offsets) - 1, self.intercept)
        if n and len(f):
            at = np.minimum(np.searchsorted(self.keys, f), n - 1)
            hit = self.keys[at] == f
            pairs = np.unique((np.searchsorted(bounds, of[hit], side="right") - 1) * n + at[hit])
            np.add.at(z, pairs // n, self.weights[pairs % n])
        return 1 / (1 + np.exp(-z))


def _rows(shared):
    """Labelled texts as indices of their features, and of the features that its counterfactual loses and gains."""
    kind = pa.schema([("y", pa.int32()), ("at", pa.list_(pa.int32())), ("lost", pa.list_(pa.int32())), ("won", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, swaps = shared.value, Swaps()
        for batch in batches:
            y = batch.column(1).to_pylist()
            for lo, hi, data, offsets in K.blocks(batch.column(0)):
                out = []
                for i, (f, words) in enumerate(row_features(data, offsets)):
                    at = model.place(f)
                    lost = won = np.empty(0, np.int64)
                    terms = np.unique(words[np.isin(words, swaps.keys)])
                    if len(terms):
                        gone, come = (np.concatenate(x) for x in zip(*(swaps.by_word[t] for t in terms.tolist()), strict=True))
                        rest = np.concatenate([f[~np.isin(f, gone)], come])
                        after = model.place(rest)
                        lost, won = np.setdiff1d(at, after), np.setdiff1d(after, at)
                    out.append({"y": y[lo + i], "at": at.tolist(), "lost": lost.tolist(), "won": won.tolist()})
                yield pa.RecordBatch.from_pylist(out, kind)

    return run


def _step(w: np.ndarray, penalty: float):
    """A partition's share of the gradient and curvature at w (the intercept last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(w)
        g, h = np.zeros(n), np.zeros((n, n))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512).to_pylist()
                x = np.zeros((len(rows), n))
                d = np.zeros((len(rows), n))
                for i, r in enumerate(rows):
                    x[i, r["at"]] = 1
                    d[i, r["won"]] = 1
                    d[i, r["lost"]] -= 1
                x[:, -1] = 1
                y = np.array([r["y"] for r in rows], dtype=float)
                p = 1 / (1 + np.exp(-x @ w))
                g += x.T @ (p - y)
                h += (x * (p * (1 - p))[:, None]).T @ x
                d = d[np.any(d != 0, axis=1)]
                g += 2 * penalty * d.T @ (d @ w)
                h += 2 * penalty * d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([h.tobytes()])], ["g", "h"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g = h = 0
    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
            g, h = g + np.frombuffer(a), h + np.frombuffer(b)
    if not np.isscalar(g):
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([h.tobytes()])], ["g", "h"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, features: int = FEATURES, penalty: float = COUNTERFACTUAL):
    """A broadcast Classifier of the texts that labels names."""
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("d"), F.col(label).cast("int").alias("y")).filter("d is not null and y is not null").groupBy("d").agg(F.max("y").alias("y"))
    sample = own.orderBy(F.xxhash64("d"), "d").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("d"), F.col(text).alias("t")).join(F.broadcast(sample), "d")
    rows = written(rows.groupBy("d", "y").agg(F.min("t").alias("t")).select("t", "y"), "labelled")  # of rows of one id the least text
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    if not 0 < pos < n:
        p = (pos + 0.5) / (n + 1)
        return spark.sparkContext.broadcast(Classifier(np.empty(0, np.uint64), np.empty(0), float(np.log(p / (1 - p)))))
    kind = "f long, n long, pos long"
    few = rows.filter("y = 1") if 2 * pos <= n else rows.filter("y = 0")
    seen = few.mapInArrow(_counts(None, True), kind).groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT)
    wanted = np.sort(seen.select("f").toArrow()["f"].to_numpy().view(np.uint64))  # at most a SUPPORT-th of the sample's features
    counted = rows.mapInArrow(_counts(spark.sparkContext.broadcast(wanted), False), kind).groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # likelihood ratio of the two shares against one: clear for frequent and for one-sided features alike
    a, size, base = F.col("pos").cast("double"), F.col("n").cast("double"), pos / n
    part = lambda x, of, p: F.when(x > 0, x * F.ln(x / (of * p))).otherwise(0.0)
    b, c, d = size - a, F.lit(float(pos)) - a, F.lit(float(n - pos)) - size + a
    rest = F.lit(float(n)) - size
    clear = part(a, size, base) + part(b, size, 1 - base) + part(c, rest, base) + part(d, rest, 1 - base)
    best = counted.select("f", clear.alias("z")).orderBy(F.desc("z"), "f").limit(features).toArrow()
    keys = np.sort(best["f"].to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(Classifier(keys, np.zeros(len(keys)), 0.0))
    sparse = written(rows.mapInArrow(_rows(shared), "y int, at array<int>, lost array<int>, won array<int>"), "features")
    w = np.zeros(len(keys) + 1)
    w[-1] = np.log(pos / (n - pos))
    for _ in range(STEPS):
        parts = sparse.mapInArrow(_step(w, penalty), "g binary, h binary")
        g, h = 0, 0
        for x in parts.repartition(4).mapInArrow(_added, "g binary, h binary").collect():
            g, h = g + np.frombuffer(x["g"]), h + np.frombuffer(x["h"]).reshape(len(w), len(w))
        ridge = np.full(len(w), RIDGE)
        ridge[-1] = 1e-6
        move = np.linalg.solve(h + np.diag(ridge), g + ridge * w)
        w = w - move * min(1.0, 4.0 / max(1e-12, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-4:
            break
    dropped(rows, sparse)
    return spark.sparkContext.broadcast(Classifier(keys, w[:-1], float(w[-1])))


def score(df: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """df with the probability of label 1."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(np.concatenate([*(model.value.scores(data, offsets) for _, _, data, offsets in K.blocks(column)), np.empty(0)]), pa.float64())
        K.trim()

    return df.withColumn(name, F.arrow_udf(run, "double")(F.col(text)))
