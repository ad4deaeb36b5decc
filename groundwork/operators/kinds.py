"""Records by the fields they have: prevalence, profile similarity, containment and agreement of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prevalence(attributes: DataFrame) -> DataFrame:
    """field, records, share of all records."""
    n = attributes.agg(F.count_distinct("id").alias("all"))  # one row
    return attributes.groupBy("field").agg(F.count_distinct("id").alias("records")).crossJoin(F.broadcast(n)).select("field", "records", (F.col("records") / F.col("all")).alias("share"))


def profile_pairs(attributes: DataFrame) -> DataFrame:
    """a, b, jaccard, height: of records with a common field; b's fields all in a and fewer: above, the other way: below, else peer."""
    own = attributes.select("id", "field").distinct()
    size = own.groupBy("id").agg(F.count("*").alias("size"))
    common = own.withColumnRenamed("id", "a").join(own.withColumnRenamed("id", "b"), "field").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    sized = common.join(size.withColumnsRenamed({"id": "a", "size": "n"}), "a").join(size.withColumnsRenamed({"id": "b", "size": "m"}), "b")
    height = F.when((F.col("both") == F.col("m")) & (F.col("n") > F.col("m")), "above").when((F.col("both") == F.col("n")) & (F.col("m") > F.col("n")), "below").otherwise("peer")
    return sized.select("a", "b", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("jaccard"), height.alias("height"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """One row, ari: agreement of the partitions a and b beyond chance; null where chance leaves no room."""
    cells = labels.groupBy("a", "b").agg(F.count("*").alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    side = lambda k, name: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias(name))
    sums = cells.agg(F.sum(two("n")).alias("both"), F.sum("n").alias("total")).crossJoin(side("a", "x")).crossJoin(side("b", "y"))  # a row each
    expected = F.col("x") * F.col("y") / two("total")
    return sums.select(F.try_divide(F.col("both") - expected, (F.col("x") + F.col("y")) / 2 - expected).alias("ari"))


def weighted_jaccard(weights: DataFrame) -> DataFrame:
    """a, b, similarity: the lesser over the greater weights of records (id, field, w) with a common field."""
    total = weights.groupBy("id").agg(F.sum("w").alias("t"))
    a, b = weights.selectExpr("id a", "field", "w x"), weights.selectExpr("id b", "field", "w y")
    both = a.join(b, "field").filter("a < b").groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("low"))
    sized = both.join(total.selectExpr("id a", "t ta"), "a").join(total.selectExpr("id b", "t tb"), "b")
    return sized.select("a", "b", (F.col("low") / (F.col("ta") + F.col("tb") - F.col("low"))).alias("similarity"))
