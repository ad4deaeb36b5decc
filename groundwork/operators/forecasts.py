"""Forecasts from what the regime tracker knows: the present regime's mean and spread, and the ground's width.

A row is forecast from the rows before it alone: the regime is the one that stood after the last value, of which sums are read as differences of two prefix
sums, found by an equi-join on the place where the regime begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regime_forecasts(tracked: DataFrame) -> DataFrame:
    """sid, i, v, name, mean, sd for rows (sid, i, v, start, volume) of a tracker, i counting from 0, from the second on.

    regime_mean: mean and sample deviation of the present regime; below two values of it the last value, with the deviation of all steps so far.
    regime_aperture: the same mean, its deviation times the ground's width over the mean of all widths so far, where both are known. sd is null where it
    can't be formed (of a single value or step).
    """
    order = Window.partitionBy("sid").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = tracked.select(
        "sid", "i", "v", F.lag("start").over(order).alias("from"), F.lag("volume").over(order).alias("width"), F.avg("volume").over(before).alias("usual"), F.lag("v").over(order).alias("last"),
        F.sum("v").over(before).alias("s"), F.sum(F.col("v") * F.col("v")).over(before).alias("q"), (F.col("v") - F.lag("v").over(order)).alias("step"),
    )
    at = at.withColumn("all_steps", F.stddev_samp("step").over(before))
    # prefix sums before the regime's first place
    first = at.select("sid", F.col("i").alias("from"), F.coalesce("s", F.lit(0.0)).alias("s0"), F.coalesce("q", F.lit(0.0)).alias("q0"))
    own = at.filter("i > 0").join(first, ["sid", "from"])
    n = F.col("i") - F.col("from")
    mean = (F.col("s") - F.col("s0")) / n
    spread = F.sqrt(F.greatest((F.col("q") - F.col("q0")) - n * mean * mean, F.lit(0.0)) / F.when(n > 1, n - 1))
    out = own.select("sid", "i", "v", F.when(n >= 2, mean).otherwise(F.col("last")).alias("mean"), F.when(n >= 2, spread).otherwise(F.col("all_steps")).alias("sd"), (F.col("width") / F.when(F.col("usual") > 0, F.col("usual"))).alias("ratio"))
    scaled = F.when(F.col("ratio") > 0, F.col("sd") * F.col("ratio")).otherwise(F.col("sd"))
    both = F.explode(F.array(F.struct(F.lit("regime_mean").alias("name"), "sd"), F.struct(F.lit("regime_aperture").alias("name"), scaled.alias("sd"))))
    return out.select("sid", "i", "v", "mean", both.alias("f")).select("sid", "i", "v", "f.name", "mean", "f.sd")
