"""Registered queries of binding nulls and communities, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions.rng import uniform_sql
from groundwork.functions.store import written
from groundwork.operators import binding as B

WINDOW, DRAWS, SEED, TURNS = 2, 19, 11, 20


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order, by kind."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("seq"), F.col("event_type").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("pos"))


def _placed(spark: SparkSession, sf_dir: str, null) -> DataFrame:
    seen = arrivals(spark, sf_dir)
    return null(seen, written(B.met_pairs(seen, WINDOW), "met"), seen.groupBy("seq").agg(F.count("*").alias("n"))).drop("na", "nb", "lo", "hi")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts, bound by the number of deliveries."""
    edges = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey")).alias("b")).agg(F.count("*").alias("weight"))
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), edges


def _one_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return B.propagated(nodes.withColumn("label", F.col("node")), B._both_ways(edges))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "displacement_null": lambda spark, sf_dir: _placed(spark, sf_dir, lambda a, p, n: B.displacement_null(a, p, WINDOW, DRAWS, SEED)),
    "reseed_null": lambda spark, sf_dir: _placed(spark, sf_dir, lambda a, p, n: B.reseed_null(a, p, n, DRAWS, SEED)),
    "reversal_null": lambda spark, sf_dir: _placed(spark, sf_dir, lambda a, p, n: B.reversal_null(a, p, n, DRAWS, SEED)),
    "community_turn": _one_turn,
    "communities": lambda spark, sf_dir: B.communities(*_graph(spark, sf_dir), TURNS),
}

_SEEN = f"""
seen AS (SELECT user_id AS seq, event_type AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events
), size AS (SELECT seq, id, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM seen GROUP BY seq, id
), length AS (SELECT seq, count(*) AS n FROM seen GROUP BY seq
), met AS (
  SELECT x.seq, x.id AS a, y.id AS b, count(*) AS overlap, count(*) FILTER (abs(x.pos - y.pos) <= 1) AS near1
  FROM seen x JOIN seen y ON x.seq = y.seq AND x.id < y.id AND abs(x.pos - y.pos) <= {WINDOW} GROUP BY ALL
), pairs AS (
  SELECT met.*, s.n AS na, t.n AS nb, least(s.lo, t.lo) AS lo, greatest(s.hi, t.hi) AS hi FROM met JOIN size s ON s.seq = met.seq AND s.id = a JOIN size t ON t.seq = met.seq AND t.id = b
), draws AS (SELECT unnest(range({DRAWS})) AS draw
)"""


def _terms(x: str, y: str) -> str:
    """Bits that x tells of y's next arrival."""
    n = lambda a, b, more="": f"count(*) FILTER ({x} = {a} AND {y} = {b}{more})"
    out = []
    for b in (0, 1):
        one = [n(a, b, f" AND {y}1 = 1") for a in (0, 1)]
        all_ = [n(a, b) for a in (0, 1)]
        out += [f"CASE WHEN {one[a]} > 0 THEN {one[a]} / count(*) * log2(({one[a]} / {all_[a]}) / (({one[0]} + {one[1]}) / ({all_[0]} + {all_[1]}))) ELSE 0 END" for a in (0, 1)]
    return f"round({' + '.join(out)}, 12)"


_EVERY = """
every AS (
  SELECT p.seq, p.a, p.b, p.nb, unnest(range(n)) AS place FROM pairs p JOIN length USING (seq)
), flagged AS (
  SELECT e.*, CASE WHEN s.id = e.a THEN 1 ELSE 0 END AS x, CASE WHEN s.id = e.b THEN 1 ELSE 0 END AS y FROM every e JOIN seen s ON s.seq = e.seq AND s.pos = e.place
)"""

ORACLE_SQL: dict[str, str] = {
    "displacement_null": f"""
WITH {_SEEN}, pool AS (
  SELECT seq, a, b, na, nb, unnest(range(lo, hi + 1)) AS place FROM pairs
), free AS (SELECT * FROM pool ANTI JOIN seen ON seen.seq = pool.seq AND seen.id = pool.a AND seen.pos = pool.place
), ranked AS (
  SELECT free.*, draw, row_number() OVER (PARTITION BY seq, a, b, draw ORDER BY {uniform_sql(f"{SEED} + na + draw * {B.STRIDE}", "place")}, place) AS rank FROM free, draws
), samples AS (
  SELECT r.seq, r.a, r.b, draw, count(s.pos) AS s FROM ranked r LEFT JOIN seen s ON s.seq = r.seq AND s.id = r.a AND abs(s.pos - r.place) <= {WINDOW} WHERE rank <= nb GROUP BY ALL
), k AS (SELECT seq, a, b, count(*) FILTER (s >= overlap) AS k FROM samples JOIN pairs USING (seq, a, b) GROUP BY ALL)
SELECT seq, a, b, overlap, coalesce(k, 0) / {DRAWS} AS p_met FROM pairs LEFT JOIN k USING (seq, a, b)
""",
    "reseed_null": f"""
WITH {_SEEN}, pool AS (
  SELECT p.seq, a, b, na, nb, unnest(range(n)) AS place FROM pairs p JOIN length USING (seq)
), ranked AS (
  SELECT pool.*, draw, row_number() OVER (PARTITION BY seq, a, b, draw ORDER BY {uniform_sql(f"{SEED} + draw * {B.STRIDE}", "place")}, place) AS rank FROM pool, draws
), samples AS (
  SELECT y.seq, y.a, y.b, y.draw, count(x.place) AS s FROM ranked y LEFT JOIN ranked x ON x.seq = y.seq AND x.a = y.a AND x.b = y.b AND x.draw = y.draw AND x.rank <= x.na
    AND abs(x.place - y.place) <= 1 WHERE y.rank > y.na AND y.rank <= y.na + y.nb GROUP BY ALL
), k AS (SELECT seq, a, b, count(*) FILTER (s >= near1) AS k FROM samples JOIN pairs USING (seq, a, b) GROUP BY ALL)
SELECT seq, a, b, overlap, near1, coalesce(k, 0) / {DRAWS} AS p_reseed FROM pairs LEFT JOIN k USING (seq, a, b)
""",
    "reversal_null": f"""
WITH {_SEEN}, {_EVERY}, moves AS (
  SELECT seq, a, b, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM flagged WINDOW w AS (PARTITION BY seq, a, b ORDER BY place)
), observed AS (SELECT seq, a, b, {_terms("x", "y")} AS fwd, {_terms("y", "x")} AS rev FROM moves WHERE x1 IS NOT NULL GROUP BY seq, a, b
), ranked AS (
  SELECT flagged.* EXCLUDE (y), draw, CASE WHEN row_number() OVER (PARTITION BY seq, a, b, draw ORDER BY {uniform_sql(f"{SEED + 7} + draw * {B.STRIDE}", "place")}, place) <= nb THEN 1 ELSE 0 END AS y FROM flagged, draws
), drawn AS (
  SELECT seq, a, b, draw, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ranked WINDOW w AS (PARTITION BY seq, a, b, draw ORDER BY place)
), samples AS (SELECT seq, a, b, draw, abs(round({_terms("x", "y")} - {_terms("y", "x")}, 12)) AS s FROM drawn WHERE x1 IS NOT NULL GROUP BY seq, a, b, draw
), k AS (SELECT seq, a, b, count(*) FILTER (s >= abs(round(fwd - rev, 12))) / {DRAWS} AS p FROM samples JOIN observed USING (seq, a, b) GROUP BY ALL)
SELECT seq, a, b, overlap, fwd, rev, abs(round(fwd - rev, 12)) AS strength, coalesce(p, 0) AS p_direction,
  CASE WHEN coalesce(p, 0) < 0.05 THEN CASE WHEN fwd > rev THEN 'a to b' ELSE 'b to a' END END AS direction
FROM pairs JOIN observed USING (seq, a, b) LEFT JOIN k USING (seq, a, b)
""",
    "community_turn": """
WITH edges AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, count(*) AS weight FROM lineitem GROUP BY ALL
), beside AS (SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges
), ranked AS (SELECT node, other AS label, row_number() OVER (PARTITION BY node ORDER BY sum(weight) DESC, other) AS r FROM beside GROUP BY node, other)
SELECT node, label FROM ranked WHERE r = 1
""",
}
