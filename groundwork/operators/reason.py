"""Scoped propositions (id, subject, predicate, object, polarity, start, end): conflicts and open questions.

Every check is an equi-join on subject and predicate with overlapping scopes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(p: DataFrame) -> DataFrame:
    b = p.select("subject", "predicate", *(F.col(c).alias(f"{c}_b") for c in ("id", "object", "polarity", "start", "end")))
    met = p.join(b, ["subject", "predicate"]).filter("id < id_b")
    return met.withColumn("overlap", (F.col("start") <= F.col("end_b")) & (F.col("start_b") <= F.col("end")))


def conflicts(p: DataFrame) -> DataFrame:
    """a, b, act: the same proposition with both polarities; a conflict where scopes meet, else a split."""
    found = _pairs(p).filter((F.col("object") == F.col("object_b")) & (F.col("polarity") != F.col("polarity_b")))
    return found.select(F.col("id").alias("a"), F.col("id_b").alias("b"), F.when(F.col("overlap"), "conflict").otherwise("split").alias("act"))


def underdetermined(p: DataFrame) -> DataFrame:
    """subject, predicate, objects: relations that hold with several objects in meeting scopes."""
    found = _pairs(p).filter((F.col("object") != F.col("object_b")) & (F.col("polarity") > 0) & (F.col("polarity_b") > 0) & F.col("overlap"))
    return found.select("subject", "predicate", F.explode(F.array("object", "object_b")).alias("o")).groupBy("subject", "predicate").agg(F.count_distinct("o").alias("objects"))


def at_risk(p: DataFrame, depends: DataFrame) -> DataFrame:
    """id: propositions that depend (id, on) on one in a conflict."""
    hurt = conflicts(p).filter("act = 'conflict'").select(F.explode(F.array("a", "b")).alias("on")).distinct()
    return depends.join(hurt, "on", "left_semi").select("id").distinct()
