"""Registered queries of kind induction, with the SQL that checks its parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.store import written
from groundwork.operators import induction as I

SHARE, POPULATIONS, SEED = 0.02, 3, 42
SPEC = {"min_share": 0.05, "min_size": 500, "draws": 39, "quantile": 0.95, "reseeds": 4, "seed": SEED}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment, nation and region."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    where = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = read("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.array(F.concat(F.lit("segment "), "c_mktsegment"), F.concat(F.lit("nation "), "n_name"), F.concat(F.lit("region "), "r_name"))
    return named.select(F.col("c_custkey").cast("long").alias("id"), said.alias("fields"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents by the languages that they occur in, their last letter and their length."""
    said = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)))
    of = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", said.alias("id")).groupBy("id").agg(F.collect_set("lang").alias("langs"))
    form = F.array(F.concat(F.lit("ends "), F.substring("id", -1, 1)), F.when(F.char_length("id") < 6, "short").otherwise("long"))
    return of.select("id", F.concat(F.transform("langs", lambda x: F.concat(F.lit("in "), x)), form).alias("fields"))


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = written(I.admitted_profiles(customers(spark, sf_dir), SHARE), "profiles")
    swapped = I.field_swaps(profiles, POPULATIONS, SEED).withColumn("r", F.col("r").cast("long"))
    rows = swapped.select("r", F.lit("record").alias("side"), F.col("id").cast("string").alias("name"), F.size("profile").cast("long").alias("n"))
    fields = swapped.select("r", F.explode("profile").alias("name")).groupBy("r", "name").agg(F.count("*").alias("n"))
    return rows.unionByName(fields.select("r", F.lit("field").alias("side"), "name", "n"))


def _likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = I.admitted_profiles(customers(spark, sf_dir), SHARE).withColumn("r", F.lit(-1))
    return I.class_pairs(I.classes_of(profiles)).select("a", "b", F.round("j", 9).alias("j"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.induce_kinds(words(spark, sf_dir), **SPEC)[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"kinds_induced": _kinds, "field_swap_margins": _margins, "class_likeness": _likeness}

_FIELDS = """
each AS (
  SELECT c_custkey AS id, unnest(['segment ' || c_mktsegment, 'nation ' || n_name, 'region ' || r_name]) AS field
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), kept AS (SELECT field FROM each GROUP BY field HAVING count(*) >= 0.02 * (SELECT count(DISTINCT id) FROM each)
), own AS (SELECT id, field FROM each SEMI JOIN kept USING (field))
"""

ORACLE_SQL: dict[str, str] = {
    "field_swap_margins": f"""
WITH {_FIELDS}, populations AS (SELECT unnest(range(3)) AS r)
SELECT r, 'record' AS side, CAST(id AS VARCHAR) AS name, count(*) AS n FROM own, populations GROUP BY r, id
UNION ALL SELECT r, 'field', field, count(*) FROM own, populations GROUP BY r, field
""",
    "class_likeness": f"""
WITH {_FIELDS}, profiles AS (SELECT id, list(field ORDER BY field) AS p FROM own GROUP BY id
), classes AS (SELECT p, min(id) AS name FROM profiles GROUP BY p
), pairs AS (SELECT x.name AS a, y.name AS b, len(list_intersect(x.p, y.p)) AS c, len(x.p) + len(y.p) AS n FROM classes x JOIN classes y ON x.name < y.name)
SELECT a, b, round(c / (n - c), 9) AS j FROM pairs WHERE c > 0
""",
}
