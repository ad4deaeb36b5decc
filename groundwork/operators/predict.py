"""Baselines that see only earlier places of a series, and proper scores of what they say."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coefficients of the normal distribution function's rational approximation.
_P = 0.3275911
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


#: Values up to which a spread is summed one after another.
SHORT = 16


def spread_of(values: Column) -> Column:
    """Standard deviation of an array, summed one value after another by the distances to the mean before and after each; null under two values."""

    def add(z: Column, x: Column) -> Column:
        n = z["n"] + 1
        mean = z["mean"] + (x - z["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (z["m2"] + (x - mean) * (x - z["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.when(F.size(values) > 1, F.aggregate(values, start, add, lambda z: F.sqrt(z["m2"] / (z["n"] - 1))))


def baselines(s: DataFrame, window: int, period: int) -> DataFrame:
    """sid, i, v, name, mean, sd: last_value, global_mean, moving_mean and seasonal_persistence for each place.

    A spread that isn't defined yet is null; a prediction without history is left out. Spreads of up to SHORT values are summed as the SQL's engine does: where values differ by
    their last bits, a spread is as large as its rounding, and whether it is zero decides on the loss.
    """
    by = Window.partitionBy("sid").orderBy("i")
    before, recent = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(-window, -1)
    few = by.rowsBetween(-SHORT, -1)

    def spread(name: str) -> Column:
        return F.when(F.count(name).over(before) <= SHORT, spread_of(F.collect_list(name).over(few))).otherwise(F.stddev_samp(name).over(before))

    s = s.withColumn("step", F.col("v") - F.lag("v").over(by)).withColumn("season", F.col("v") - F.lag("v", period).over(by))
    said = [
        ("last_value", F.lag("v").over(by), spread("step")),
        ("global_mean", F.avg("v").over(before), spread("v")),
        ("moving_mean", F.when(F.count("v").over(recent) == window, F.avg("v").over(recent)), spread_of(F.collect_list("v").over(recent)) if window <= SHORT else F.stddev_samp("v").over(recent)),
        ("seasonal_persistence", F.lag("v", period).over(by), spread("season")),
    ]
    rows = s.select("sid", "i", "v", F.array(*(F.struct(F.lit(n).alias("name"), m.alias("mean"), sd.alias("sd")) for n, m, sd in said)).alias("b"))
    return rows.select("sid", "i", "v", F.inline("b")).filter("mean is not null")


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + _P * x)
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def crps(mean: Column, sd: Column, v: Column) -> Column:
    """Continuous ranked probability score of a normal prediction; the absolute error of a point."""
    z = (v - mean) / sd
    pdf = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(sd > 0, sd * (z * (2 * normal_cdf(z) - 1) + 2 * pdf - 1 / math.sqrt(math.pi))).otherwise(F.abs(v - mean))


def log_loss(mean: Column, sd: Column, v: Column) -> Column:
    z = (v - mean) / sd
    return F.when(sd > 0, F.ln(sd) + 0.5 * math.log(2 * math.pi) + z * z / 2)


def pinball(quantile: Column, tau: float, v: Column) -> Column:
    return F.when(v >= quantile, tau * (v - quantile)).otherwise((1 - tau) * (quantile - v))


def ledger(predicted: DataFrame, warmup: int) -> DataFrame:
    """name, n, loss, gain over the best other: a walk-forward competition, scored past the warm-up on places that all predict."""
    late = predicted.filter(F.col("i") >= warmup)
    names = late.withColumn("k", F.count("*").over(Window.partitionBy("sid", "i"))).filter("k = 4")
    sums = names.groupBy("name").agg(F.count("*").alias("n"), F.sum(crps(F.col("mean"), F.col("sd"), F.col("v"))).alias("loss"))
    other = sums.alias("a").join(sums.alias("b"), F.col("a.name") != F.col("b.name")).groupBy("a.name").agg(F.min("b.loss").alias("best"))  # a row for each baseline
    return sums.join(other, "name").select("name", "n", "loss", (F.col("best") - F.col("loss")).alias("gain"))
