"""Registered queries of grounds that are kept or conceded, with the SQL that checks their nulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions.rng import uniform_sql
from groundwork.operators import atmosphere as A
from groundwork.operators import forecasts, predict
from groundwork.plans.series_queries import _SERIES, WINDOW, events

RESEEDS, SEED, LEVEL = 20, 5, 60.0
SPEC = A.Spec(window=2, draws=16, tolerance=2, seed=SEED)
SLACK = A.Spec(window=2, draws=16, tolerance=2, statistic="window_mean", regularity=True, reseeds=RESEEDS, seed=SEED)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "atmosphere": lambda spark, sf_dir: _rounded(A.track(events(spark, sf_dir), SPEC), "volume"),
    "atmosphere_slack": lambda spark, sf_dir: _rounded(A.track(events(spark, sf_dir), SLACK), "volume"),
    "atmosphere_regions": lambda spark, sf_dir: _rounded(A.read(events(spark, sf_dir), SPEC), "volume_open", "volume_close"),
    "slack_null": lambda spark, sf_dir: A.slack_null(events(spark, sf_dir), LEVEL, RESEEDS, SEED),
    "stationarity": lambda spark, sf_dir: A.stationarity(events(spark, sf_dir), RESEEDS, SEED),
}

_REORDERED = f"""
n AS (SELECT sid, count(*) AS n FROM s GROUP BY sid
), d AS (
  SELECT sid, draw, row_number() OVER (PARTITION BY sid, draw ORDER BY u, i) - 1 AS i, v
  FROM (SELECT sid, i, v, draw, {uniform_sql(f"draw * {A.STRIDE} + {SEED}", "i")} AS u FROM s, range({RESEEDS}) AS t(draw))
)"""
_AT = int(RESEEDS * 0.95) + 1


def _runs(table: str, by: str) -> str:
    return f"""SELECT {by}, coalesce(max(len), 0) AS s FROM (SELECT DISTINCT {by} FROM {table}) LEFT JOIN (
  SELECT {by}, count(*) AS len FROM (SELECT {by}, i - row_number() OVER (PARTITION BY {by} ORDER BY i) AS g FROM {table} WHERE v < {LEVEL}) GROUP BY {by}, g) USING ({by}) GROUP BY {by}"""


def _ends(table: str, by: str) -> str:
    return f"SELECT {by}, round(abs(avg(v) FILTER (i >= n - q) - avg(v) FILTER (i < q)), 9) AS s FROM {table} JOIN m USING (sid) GROUP BY {by}"


_LIMIT = f"limits AS (SELECT sid, s AS threshold FROM samples QUALIFY row_number() OVER (PARTITION BY sid ORDER BY s) = {_AT})"

ORACLE_SQL: dict[str, str] = {
    "slack_null": f"""
WITH {_SERIES}, {_REORDERED}, samples AS ({_runs("d", "sid, draw")}), {_LIMIT}, seen AS ({_runs("s", "sid")})
SELECT sid, s AS run, threshold, s > threshold AS found FROM seen JOIN limits USING (sid)
""",
    "stationarity": f"""
WITH {_SERIES}, {_REORDERED}, m AS (SELECT sid, n, greatest(2, n // 4) AS q FROM n WHERE n >= 8), samples AS ({_ends("d", "sid, draw")}), {_LIMIT}, seen AS ({_ends("s", "sid")})
SELECT sid, n, s AS observed, threshold, CASE WHEN s > threshold THEN 'trending_material' END AS gap FROM seen JOIN limits USING (sid) JOIN m USING (sid)
""",
}


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's loss and what it gains over the moving mean, on the rows that all of them forecast."""
    s = events(spark, sf_dir)
    said = forecasts.regime_forecasts(A.track(s, SPEC)).unionByName(predict.baselines(s, WINDOW, 4).filter("name = 'moving_mean'"))
    loss = said.withColumn("loss", predict.crps(F.col("mean"), F.col("sd"), F.col("v"))).filter("loss is not null")
    shared = loss.withColumn("k", F.count("*").over(Window.partitionBy("sid", "i"))).filter("k = 3")
    sums = shared.groupBy("name").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"))
    base = sums.filter("name = 'moving_mean'").select(F.col("loss").alias("base"))  # one row
    return sums.crossJoin(F.broadcast(base)).select("name", "n", F.round("loss", 4).alias("loss"), F.round(F.col("base") - F.col("loss"), 4).alias("gain"))


QUERIES["regime_forecasts"] = _forecasts
