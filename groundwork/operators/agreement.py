"""Agreement and goodness of fit from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_by_two(rows: DataFrame) -> DataFrame:
    """One row for boolean a, b: n, agreement (share of equal rows), chi_square, phi; null where a margin is empty."""
    n = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b)).cast("double")
    c = rows.agg(n(True, True).alias("p"), n(True, False).alias("q"), n(False, True).alias("r"), n(False, False).alias("s"))
    total = F.expr("p + q + r + s")
    phi = F.try_divide(F.expr("p * s - q * r"), F.sqrt(F.expr("(p + q) * (r + s) * (p + r) * (q + s)")))
    return c.select(total.cast("long").alias("n"), F.try_divide(F.expr("p + s"), total).alias("agreement"), (total * phi * phi).alias("chi_square"), phi.alias("phi"))


def leading_digits(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, chi_square of the leading digits against their logarithmic shares; values under 1 are left out."""
    digit = F.substring(F.floor(value).cast("string"), 1, 1).cast("int")
    counts = rows.filter(F.col(value) >= 1).groupBy(by, digit.alias("digit")).agg(F.count("*").alias("k"))
    share = F.log10(1 + 1 / F.col("digit"))
    # sum((k - e)^2 / e) over all nine digits is sum(k^2 / e) - n, where absent digits add nothing
    return counts.groupBy(by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k") / share).alias("q")).select(by, "n", (F.col("q") / F.col("n") - F.col("n")).alias("chi_square"))


def correlations(rows: DataFrame, by: str, x: str, y: str, given: str) -> DataFrame:
    """by, pearson of x and y, and partial with the part of both that goes with a third column taken out."""
    r = rows.groupBy(by).agg(F.corr(x, y).alias("xy"), F.corr(x, given).alias("xz"), F.corr(y, given).alias("yz"))
    return r.select(by, F.col("xy").alias("pearson"), F.try_divide(F.expr("xy - xz * yz"), F.sqrt(F.expr("(1 - xz * xz) * (1 - yz * yz)"))).alias("partial"))



def cohen(rows: DataFrame) -> DataFrame:
    """One row for categories a, b of the same things: n, splits (rows that differ), agreement, kappa (beyond what the margins give; null where they
    leave no room)."""
    cells = rows.groupBy("a", "b").agg(F.count("*").alias("k"))
    whole = cells.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("k"))), F.lit(0)).alias("same"))
    a, b = cells.groupBy(F.col("a").alias("c")).agg(F.sum("k").alias("x")), cells.groupBy(F.col("b").alias("c")).agg(F.sum("k").alias("y"))
    chance = a.join(b, a.c.eqNullSafe(b.c)).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    agreed, pe = F.col("same") / F.col("n"), F.col("xy") / F.col("n") / F.col("n")
    return whole.crossJoin(chance).select("n", (F.col("n") - F.col("same")).alias("splits"), agreed.alias("agreement"), F.try_divide(agreed - pe, 1 - pe).alias("kappa"))  # a row each


def fleiss(ratings: DataFrame, raters: int) -> DataFrame:
    """One row: items, kappa. ratings: item, category, a row for each rater; items with another number of ratings are left out."""
    cells = ratings.groupBy("item", "category").agg(F.count("*").alias("k"))
    items = cells.groupBy("item").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("pairs")).filter(F.col("n") == raters)
    mean = items.agg(F.count("*").alias("items"), (F.avg("pairs") / (raters * (raters - 1))).alias("p"))
    shares = cells.join(items.select("item"), "item", "left_semi").groupBy("category").agg(F.sum("k").alias("k"))
    chance = shares.agg((F.sum(F.col("k") * F.col("k")) / F.sum("k") / F.sum("k")).alias("e"))
    kappa = F.when(F.col("e") == 1, 1.0).otherwise((F.col("p") - F.col("e")) / (1 - F.col("e")))
    return mean.crossJoin(chance).select("items", kappa.alias("kappa"))  # a row each
