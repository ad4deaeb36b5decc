"""Statistics of ordered series. A series table has sid, i (0, 1, ... within a series) and v."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(df: DataFrame, sid: str, order: list[str], value: str) -> DataFrame:
    """sid, i, v in the given order; rows without value are left out."""
    w = Window.partitionBy(sid).orderBy(*order)
    kept = df.filter(F.col(value).isNotNull())
    return kept.select(F.col(sid).alias("sid"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col(value).cast("double").alias("v"))


def _by(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("i")


def sliding_means(s: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """The mean of every full window, by its first place."""
    keys = keys or ["sid"]
    frame = _by(keys).rowsBetween(0, window - 1)
    return s.withColumn("mean", F.avg("v").over(frame)).withColumn("size", F.count("v").over(frame)).filter(F.col("size") == window).select(*keys, "i", "mean")


def burstiness(s: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """The greatest mean of a window of each series; series shorter than a window have none."""
    keys = keys or ["sid"]
    return sliding_means(s, window, keys).groupBy(*keys).agg(F.max("mean").alias("stat"))


def window_mean(s: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """The mean of the first window."""
    keys = keys or ["sid"]
    return s.filter(F.col("i") < window).groupBy(*keys).agg(F.avg("v").alias("stat"), F.count("*").alias("n")).filter(F.col("n") == window).select(*keys, "stat")


def max_deviation(s: DataFrame, window: int = 0, keys: list[str] | None = None) -> DataFrame:
    """The greatest distance from the interpolated median; no window has a part in it."""
    keys = keys or ["sid"]
    middle = s.groupBy(*keys).agg(F.percentile("v", F.lit(0.5)).alias("m"))
    return s.join(middle, keys).groupBy(*keys).agg(F.max(F.abs(F.col("v") - F.col("m"))).alias("stat"))


def ordinal_patterns(s: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """keys, key, n: how often the values of a window stand in each order; ties keep the order of the places."""
    keys = keys or ["sid"]
    w = _by(keys)
    pairs = F.array(*(F.struct(F.lead("v", j).over(w).alias("v"), F.lit(j).alias("j")) for j in range(window)))
    full = s.withColumn("last", F.lead("i", window - 1).over(w)).withColumn("p", pairs).filter("last is not null")
    key = F.concat_ws("", F.transform(F.array_sort("p"), lambda x: x["j"].cast("string")))
    return full.groupBy(*keys, key.alias("key")).agg(F.count("*").alias("n"))


def _licensed_patterns(patterns: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """Shares of the patterns of series that have at least as many windows as there are orders."""
    total = Window.partitionBy(*keys)
    return patterns.withColumn("total", F.sum("n").over(total)).filter(F.col("total") >= math.factorial(window)).withColumn("p", F.col("n") / F.col("total"))


def permutation_entropy(s: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """Entropy of the ordinal patterns as a share of its greatest value."""
    keys = keys or ["sid"]
    p = _licensed_patterns(ordinal_patterns(s, window, keys), window, keys)
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p")) / math.log(math.factorial(window))).alias("stat"))


def reversed_key(key: Column, window: int) -> Column:
    """The pattern of the same window read backwards."""
    return F.translate(key, "".join(map(str, range(window))), "".join(map(str, reversed(range(window)))))


def irreversibility(s: DataFrame, window: int, keys: list[str] | None = None) -> DataFrame:
    """Jensen-Shannon divergence in bits between the patterns and those of the series read backwards."""
    keys = keys or ["sid"]
    p = _licensed_patterns(ordinal_patterns(s, window, keys), window, keys).select(*keys, "key", "p")
    q = p.select(*keys, reversed_key(F.col("key"), window).alias("key"), F.col("p").alias("q"))
    both = p.join(q, [*keys, "key"], "full_outer").na.fill(0.0, ["p", "q"]).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0)
    return both.groupBy(*keys).agg((0.5 * F.sum(term("p")) + 0.5 * F.sum(term("q"))).alias("stat"))


def coarsen(s: DataFrame, width: int) -> DataFrame:
    """The series of sliding means, shorter by width - 1."""
    return sliding_means(s, width).withColumnRenamed("mean", "v")


def hop_windows(s: DataFrame, width: int, hop: int) -> DataFrame:
    """sid, start, n, mean of the windows [start, start + width) for every hop-th start; each value is counted in all of its windows."""
    first = F.greatest(F.ceil((F.col("i") - width + 1) / hop), F.lit(0))
    starts = F.transform(F.sequence(first, F.floor(F.col("i") / hop)), lambda k: k * hop)
    return s.select("sid", "v", F.explode(starts).alias("start")).groupBy("sid", "start").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).filter(F.col("n") == width)


def islands(s: DataFrame, above: float) -> DataFrame:
    """sid, start, end, length of maximal runs of values over a level."""
    high = s.filter(F.col("v") > above)
    run = F.col("i") - F.row_number().over(_by(["sid"]))
    return high.withColumn("run", run).groupBy("sid", "run").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count("*").alias("length")).drop("run")
