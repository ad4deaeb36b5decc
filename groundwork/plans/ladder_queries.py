"""Registered queries of grounds against grounds, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.rng import uniform_sql
from groundwork.operators import ladder as L
from groundwork.plans.series_queries import _SERIES, WINDOW, events

SHARE, DRAWS, RESEEDS, WIDTHS, PLACED = 0.6, 16, 3, [1, 2, 4, 8], 6


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cascade(events(spark, sf_dir), WIDTHS, 3, DRAWS, RESEEDS)


def _holons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle fifth of each series."""
    s = events(spark, sf_dir)
    n = s.groupBy("sid").agg(F.count("*").alias("n"))
    return L.holon_levels(s, n.select("sid", F.floor(F.col("n") * 2 / 5).alias("start"), F.floor(F.col("n") * 3 / 5).alias("end")), WINDOW, DRAWS, PLACED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pattern": lambda spark, sf_dir: L.pattern(events(spark, sf_dir), SHARE, WINDOW, DRAWS, RESEEDS),
    "rungs": lambda spark, sf_dir: L.rungs(events(spark, sf_dir), WIDTHS).withColumn("v", F.round("v", 9)),
    "cascade": _cascade,
    "holon_levels": _holons,
    "ladders": lambda spark, sf_dir: L.ladders(_cascade(spark, sf_dir)),
}

_LIST = ", ".join(map(str, L.GRID))
ORACLE_SQL: dict[str, str] = {
    "pattern": f"""
WITH {_SERIES}, z AS (SELECT sid, count(*) AS n, CAST(floor(count(*) * {SHARE}) AS BIGINT) AS cut FROM s GROUP BY sid
), turns AS (SELECT unnest(range({RESEEDS + 1})) AS turn
), made AS (
  SELECT sid, turn, i, v FROM s JOIN z USING (sid), turns WHERE i < cut
  UNION ALL SELECT sid, -1, i, v FROM s
  UNION ALL SELECT k.sid, turn, place, s.v FROM (
    SELECT sid, turn, place, CAST(floor({uniform_sql(f"{L.CONTINUE} + turn * {DRAWS}", "(place - cut)")} * cut) AS BIGINT) AS pick
    FROM (SELECT sid, cut, unnest(range(cut, n)) AS place FROM z), turns WHERE turn > 0) k JOIN s ON s.sid = k.sid AND s.i = k.pick
), shuffled AS (
  SELECT sid, turn, draw, row_number() OVER (PARTITION BY sid, turn, draw ORDER BY {uniform_sql(f"greatest(turn, 0) * {DRAWS} + draw", "i")}, i) AS i, v FROM made, range({DRAWS}) AS t(draw)
), means AS (
  SELECT sid, turn, draw, avg(v) OVER w AS m, count(*) OVER w AS k FROM shuffled WINDOW w AS (PARTITION BY sid, turn, draw ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), g AS (SELECT sid, turn, draw, max(m) AS stat FROM means WHERE k = {WINDOW} GROUP BY ALL
), shape AS (SELECT sid, turn, quantile_cont(stat, [{_LIST}]) AS q, count(*) AS k, min(stat) = max(stat) AS flat FROM g GROUP BY ALL
), apart AS (
  SELECT a.sid, a.turn, list_avg(list_transform(list_zip(a.q, b.q), lambda x: abs(x[1] - x[2]))) AS d, (a.q[4] - a.q[2]) - (b.q[4] - b.q[2]) AS wide, a.flat OR b.flat AS flat
  FROM shape a JOIN shape b ON a.sid = b.sid AND b.turn = 0
), sums AS (
  SELECT sid, round(avg(d) FILTER (turn > 0) + 3 * stddev_samp(d) FILTER (turn > 0), 9) AS reseed_null, round(max(d) FILTER (turn = -1), 9) AS displacement,
    round(max(wide) FILTER (turn = -1), 9) AS volume_delta, round(max(abs(wide)) FILTER (turn > 0), 9) AS volume_null, bool_or(flat) FILTER (turn <= 0) AS flat FROM apart GROUP BY sid
), formed AS (SELECT sid, count(*) FILTER (k = {DRAWS}) AS formed FROM shape GROUP BY sid
), said AS (
  SELECT z.sid, displacement, reseed_null, volume_delta, volume_null,
    CASE WHEN coalesce(formed, 0) < {RESEEDS + 2} THEN 'unknown_spec' WHEN flat OR reseed_null = 0 THEN 'degenerate_ground' END AS gap FROM z LEFT JOIN sums USING (sid) LEFT JOIN formed USING (sid)
)
SELECT sid, gap, CASE WHEN gap IS NULL THEN displacement END AS displacement, CASE WHEN gap IS NULL THEN reseed_null END AS reseed_null, CASE WHEN gap IS NULL THEN volume_delta END AS volume_delta,
  CASE WHEN gap IS NULL THEN volume_null END AS volume_null, CASE WHEN gap IS NULL THEN displacement > reseed_null END AS moved,
  CASE WHEN gap IS NULL AND volume_null > 0 AND abs(volume_delta) > volume_null THEN volume_delta > 0 END AS opened FROM said
""",
    "rungs": f"""
WITH {_SERIES}, widths AS (SELECT unnest({WIDTHS}) AS width), z AS (SELECT sid, count(*) - {max(WIDTHS)} + 1 AS extent FROM s GROUP BY sid)
SELECT a.sid, width, a.i, round(avg(b.v), 9) AS v FROM s a JOIN z USING (sid), widths JOIN s b ON b.sid = a.sid AND b.i BETWEEN a.i AND a.i + width - 1 WHERE a.i < extent GROUP BY a.sid, width, a.i
""",
    "holon_levels": f"""
WITH {_SERIES}, z AS (SELECT sid, count(*) AS n, 2 * count(*) // 5 AS start, 3 * count(*) // 5 AS stop FROM s GROUP BY sid
), r AS (SELECT *, greatest(0, start - (stop - start) + 1) AS left_, greatest(0, start - (stop - start) + 1) + greatest(0, n - (stop - start) - stop + 1) AS total FROM z
), e AS (
  SELECT sid, test, turn, CASE WHEN k < left_ THEN k ELSE stop + k - left_ END AS lo, stop - start AS len FROM (
    SELECT *, least(total - 1, CAST(floor({uniform_sql("base - 1 + turn", "0")} * total) AS BIGINT)) AS k
    FROM r, range(1, {PLACED + 1}) AS t(turn), (SELECT unnest(['existence', 'constraint']) AS test, unnest([{L.PLACES["existence"]}, {L.PLACES["constraint"]}]) AS base) WHERE total > 0)
), own AS (SELECT sid, 0 AS turn, start AS lo, stop AS hi FROM r
), cuts AS (SELECT * FROM own UNION ALL SELECT sid, turn, lo, lo + len FROM e WHERE test = 'existence' UNION ALL SELECT sid, -1, 0, 0 FROM r
), m AS (SELECT sid, turn, CASE WHEN i < lo THEN i ELSE i - hi + lo END AS i, v FROM s JOIN cuts USING (sid) WHERE i < lo OR i >= hi
), d AS (
  SELECT sid, turn, draw, row_number() OVER (PARTITION BY sid, turn, draw ORDER BY {uniform_sql(f"(turn + 1) * {DRAWS} + draw", "i")}, i) AS i, v FROM m, range({DRAWS}) AS t(draw)
), w AS (SELECT sid, turn, draw, avg(v) OVER o AS x, count(*) OVER o AS k FROM d WINDOW o AS (PARTITION BY sid, turn, draw ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), g AS (SELECT sid, turn, draw, max(x) AS stat FROM w WHERE k = {WINDOW} GROUP BY ALL
), v AS (SELECT sid, turn, quantile_cont(stat, 0.75) - quantile_cont(stat, 0.25) AS volume FROM g GROUP BY ALL HAVING min(stat) < max(stat)
), x AS (SELECT a.sid, a.turn, round(abs(b.volume - a.volume), 9) AS d FROM v a JOIN v b ON b.sid = a.sid AND b.turn = -1 WHERE a.turn >= 0
), p AS (
  SELECT sid, turn, round(abs(avg(v) FILTER (i >= lo AND i < hi) - avg(v) FILTER (i < lo OR i >= hi)), 9) AS d
  FROM s JOIN (SELECT * FROM own UNION ALL SELECT sid, turn, lo, lo + len FROM e WHERE test = 'constraint') USING (sid) GROUP BY sid, turn, lo, hi
  HAVING count(*) FILTER (i < lo OR i >= hi) >= 2 AND (turn > 0 OR count(*) FILTER (i >= lo AND i < hi) >= 2)
), a AS (SELECT sid, max(d) FILTER (turn = 0) AS existence, list_sort(list(d) FILTER (turn > 0)) AS l FROM x GROUP BY sid
), b AS (SELECT sid, max(d) FILTER (turn = 0) AS shift, list_sort(list(d) FILTER (turn > 0)) AS l FROM p GROUP BY sid
), t AS (
  SELECT r.sid, start, stop, existence, shift, CASE WHEN len(a.l) >= 2 THEN a.l[CAST(floor(len(a.l) * 0.95) AS BIGINT) + 1] END AS el, CASE WHEN len(b.l) >= 2 THEN b.l[CAST(floor(len(b.l) * 0.95) AS BIGINT) + 1] END AS sl
  FROM r LEFT JOIN a USING (sid) LEFT JOIN b USING (sid)
), u AS (SELECT *, existence > el AS e, shift > sl AS c FROM t)
SELECT sid, start, stop AS "end", CASE WHEN e IS NOT NULL THEN existence END AS existence, CASE WHEN e IS NOT NULL THEN el END AS existence_limit, e AS "exists",
  CASE WHEN c IS NOT NULL THEN shift END AS shift, CASE WHEN c IS NOT NULL THEN sl END AS shift_limit, c AS constrains,
  CASE WHEN e AND c THEN 'above' WHEN NOT e AND NOT c THEN 'peer' ELSE 'unstable' END AS relation FROM u
""",
}
