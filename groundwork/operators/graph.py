"""Edges from triples: decay, weights, chains, co-occurrence, bands, information flow and surprise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_key(subject: Column, verb: Column, object_: Column) -> Column:
    return F.concat_ws("|", F.lower(subject), verb, F.lower(object_))


def decayed_edges(triples: DataFrame, gamma: float) -> DataFrame:
    """subject, verb, object, weight: every arrival decays by gamma a tick (the closed form of decay without pruning)."""
    now = triples.agg(F.max("tick").alias("now"))  # one row
    each = triples.crossJoin(F.broadcast(now)).withColumn("w", F.pow(F.lit(gamma), F.col("now") - F.col("tick")))
    return each.groupBy("subject", "verb", "object").agg(F.sum("w").alias("weight"))


def node_weights(edges: DataFrame) -> DataFrame:
    """node, weight: of all edges at it, a loop once."""
    ends = F.when(F.col("subject") == F.col("object"), F.array("subject")).otherwise(F.array("subject", "object"))
    return edges.select(F.explode(ends).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("weight"))


def strongest_edges(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n heaviest edges; keys decide ties."""
    return edges.orderBy(F.desc("weight"), "subject", "verb", "object").limit(n)


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """subject, object, ways: chains of an edge of each table."""
    b = second.select(F.col("subject").alias("object"), F.col("object").alias("far"))
    return first.select("subject", "object").join(b, "object").groupBy("subject", F.col("far").alias("object")).agg(F.count("*").alias("ways"))


def compose_edges(edges: DataFrame) -> DataFrame:
    """subject, verb, object, via, weight (the lesser of both): chains of two edges of one verb whose ends differ and aren't bound by that verb yet. A chain for each way."""
    one = edges.groupBy("subject", "verb", "object").agg(F.max("weight").alias("weight"))
    first = one.select("subject", "verb", F.col("object").alias("via"), F.col("weight").alias("w1"))
    second = one.select(F.col("subject").alias("via"), "verb", "object", F.col("weight").alias("w2"))
    chains = first.join(second, ["verb", "via"]).filter((F.col("via") != F.col("object")) & (F.col("subject") != F.col("object")) & (F.col("subject") != F.col("via")))
    return chains.join(one.select("subject", "verb", "object"), ["subject", "verb", "object"], "left_anti").select("subject", "verb", "object", "via", F.least("w1", "w2").alias("weight"))


def cooccurrence(members: DataFrame) -> DataFrame:
    """a, b, n: frames that hold both. Repeats in a frame count once; the join is on the frame, so a frame costs its own pairs."""
    m = members.select("frame", "id").distinct()
    other = m.select("frame", F.col("id").alias("b"))
    return m.withColumnRenamed("id", "a").join(other, "frame").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def coarrivals(arrivals: DataFrame, window: int) -> DataFrame:
    """a, b, n: pairs of arrivals of different ids within the window of places, in each sequence.

    The band join is an equi-join on blocks of the window's width: every arrival meets its own block and its neighbours.
    """
    block = F.floor(F.col("pos") / window)
    left = arrivals.select("seq", F.col("id").alias("a"), F.col("pos").alias("i"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = arrivals.select("seq", F.col("id").alias("b"), F.col("pos").alias("j"), block.alias("block"))
    near = left.join(right, ["seq", "block"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("i") - F.col("j")) <= window))
    return near.groupBy("a", "b").agg(F.count("*").alias("n"))


def transfer_entropy(steps: DataFrame) -> DataFrame:
    """x, y, bits: what a step of x tells of the next y beyond y's own step, from seq, pos, id; one id a step.

    Only the states' counts are moved: steps are grouped to (id now, id next) first.
    """
    w = Window.partitionBy("seq").orderBy("pos")
    moves = steps.withColumn("next", F.lead("id").over(w)).filter("next is not null").groupBy("id", "next").agg(F.count("*").alias("n"))
    ids = moves.select(F.col("id").alias("x")).distinct()
    pairs = ids.crossJoin(ids.withColumnRenamed("x", "y")).filter("x <> y")  # pairs of kinds of steps, not of rows
    states = moves.crossJoin(pairs).groupBy("x", "y", (F.col("next") == F.col("y")).alias("y1"), (F.col("id") == F.col("y")).alias("y0"), (F.col("id") == F.col("x")).alias("x0")).agg(F.sum("n").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("x", "y", *by))
    ratio = (F.col("n") / total("y0", "x0")) / (total("y1", "y0") / total("y0"))
    terms = states.withColumn("term", F.col("n") / total() * F.log2(ratio))
    return terms.filter("y1").groupBy("x", "y").agg(F.sum("term").alias("bits"))


def bayesian_surprise(arrivals: DataFrame, alpha: float = 1.0) -> DataFrame:
    """tick, bits: divergence of the smoothed shares after a tick from those before it. arrivals: tick, form, n."""
    forms = arrivals.select("form").distinct()
    ticks = arrivals.select("tick").distinct()
    every = ticks.crossJoin(F.broadcast(forms)).join(arrivals, ["tick", "form"], "left").na.fill(0, ["n"])
    upto = Window.partitionBy("form").orderBy("tick")
    c = every.withColumn("after", F.sum("n").over(upto)).withColumn("before", F.col("after") - F.col("n"))
    at = Window.partitionBy("tick")
    share = lambda k: (F.col(k) + alpha) / (F.sum(k).over(at) + alpha * F.count("*").over(at))
    return c.withColumn("p", share("before")).withColumn("q", share("after")).groupBy("tick").agg(F.sum(F.col("q") * F.log2(F.col("q") / F.col("p"))).alias("bits"))
