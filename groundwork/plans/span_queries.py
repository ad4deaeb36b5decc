"""Registered queries of sentences, abbreviations and nested intervals, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import spans as S


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in force: from an order's day on, longer the dearer it was; and one that holds all their time."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("id"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("lo"), (F.floor(F.col("o_totalprice") / 1000) + 1).alias("days"))
    own = orders.select("who", "id", "lo", (F.col("lo") + F.col("days")).alias("hi"))
    return own.unionByName(orders.groupBy("who").agg(F.lit(-1).cast("long").alias("id"), F.min("lo").alias("lo"), F.lit(1_000_000_000_000).cast("long").alias("hi")))


def _innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _spans(spark, sf_dir)
    points = every.filter("id >= 0").select("who", F.explode(F.array("lo", F.col("lo") + 30, F.col("lo") + 200)).alias("at"))
    return S.innermost(points, every, ["who"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "abbreviations": lambda spark, sf_dir: S.abbreviations(_docs(spark, sf_dir)),
    "sentences": lambda spark, sf_dir: S.sentences(_docs(spark, sf_dir)).select("doc", "order", "start", F.char_length("sentence").alias("n"), F.sha2("sentence", 256).alias("sha256")),
    "innermost_span": _innermost,
}

ORACLE_SQL: dict[str, str] = {
    "abbreviations": r"""
WITH m AS (SELECT doc_id AS doc, unnest(regexp_extract_all(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\p{L}[\p{L}\p{M}]*\.?')) AS m FROM documents
), c AS (SELECT doc, rtrim(m, '.') AS token, count(*) AS n, count(*) FILTER (ends_with(m, '.')) AS dotted FROM m GROUP BY ALL
), b AS (SELECT doc, list_sort(list(length(rtrim(m, '.')))) AS l FROM m GROUP BY doc)
SELECT doc, token FROM c JOIN b USING (doc) WHERE dotted = n AND n >= 2 AND length(token) <= l[CAST(floor(len(l) * 0.1) AS BIGINT) + 1]
""",
    "innermost_span": """
WITH o AS (SELECT o_custkey AS who, o_orderkey AS id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS lo, CAST(floor(o_totalprice / 1000) AS BIGINT) + 1 AS days FROM orders
), spans AS (SELECT who, id, lo, lo + days AS hi FROM o UNION ALL SELECT who, -1, min(lo), 1000000000000 FROM o GROUP BY who
), points AS (SELECT DISTINCT who, unnest([lo, lo + 30, lo + 200]) AS at_ FROM o)
SELECT p.who, at_ AS "at", id FROM points p LEFT JOIN spans s ON s.who = p.who AND at_ >= lo AND at_ < hi
QUALIFY row_number() OVER (PARTITION BY p.who, at_ ORDER BY hi - lo, lo DESC, id) = 1
""",
}
