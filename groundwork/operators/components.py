"""Connected components of a table of links, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.store import dropped, written


def ready(spark: SparkSession) -> None:
    """checkpoint() needs a folder that driver and executors share: the session's own, or spark.checkpoint.dir; only a local session may have neither."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", "")
        if not found and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or "/tmp/groundwork-checkpoints")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of a link.

    Each round joins every node to the smallest neighbour (large star) and then every node with the smaller
    ones among its neighbours (small star); paths shorten geometrically. Each round's result is written, and
    the rounds end when every node has one smaller neighbour at most, which has none: those are the components.
    """
    pairs = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "pairs", "uncompressed")
    none = F.lit(None).cast(pairs.schema["v"].dataType)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        before, pairs = pairs, written(small.select("p.*").filter("u <> v").distinct(), "pairs", "uncompressed")
        dropped(before)
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), none.alias("to")))).alias("p")).select("p.*")
        nodes = written(ends.groupBy("node").agg(F.min("to").alias("to"), F.count("to").alias("smaller"), (F.count("*") > F.count("to")).alias("above")), "nodes", "uncompressed")
        if nodes.filter("smaller > 1 or smaller = 1 and above").isEmpty():
            dropped(pairs)
            return nodes.select("node", F.coalesce("to", "node").alias("component"))
        dropped(nodes)
