"""Registered queries over the events table's series, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.rng import uniform_sql
from groundwork.operators import nulls, predict, regimes
from groundwork.operators import series as S

WINDOW, DRAWS = 8, 16
#: Draws by which the order of a series is judged.
ORDERED = 12


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.series(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], "value")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def _stat(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(make(events(spark, sf_dir)), "stat")


def place(spark: SparkSession, sf_dir: str, perturbation: str = "resample") -> DataFrame:
    s = events(spark, sf_dir)
    return nulls.difference(S.burstiness(s, WINDOW), nulls.ground(s, DRAWS, WINDOW, perturbation))


def _apertures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nulls.apertures(nulls.ground(events(spark, sf_dir), DRAWS, WINDOW, "resample")), "volume", "tail_span")


def _disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nulls.disagreement(place(spark, sf_dir).unionByName(place(spark, sf_dir, "shuffle"))), "spread")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.baselines(events(spark, sf_dir), WINDOW, 4)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, sd, v = F.col("mean"), F.col("sd"), F.col("v")
    losses = {"crps": predict.crps(m, sd, v), "log_loss": predict.log_loss(m, sd, v), "squared": (v - m) * (v - m), "absolute": F.abs(v - m), "pinball": predict.pinball(m, 0.9, v)}
    return _predicted(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(k) for k, c in losses.items()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "verdict": lambda spark, sf_dir: nulls.verdict(place(spark, sf_dir)),
    "burstiness": _stat(lambda s: S.burstiness(s, WINDOW)),
    "window_mean": _stat(lambda s: S.window_mean(s, WINDOW)),
    "max_deviation": _stat(S.max_deviation),
    "permutation_entropy": _stat(lambda s: S.permutation_entropy(s, 3)),
    "irreversibility": _stat(lambda s: S.irreversibility(s, 3)),
    "coarsen": lambda spark, sf_dir: _rounded(S.coarsen(events(spark, sf_dir), 4), "v"),
    "wave_islands": lambda spark, sf_dir: S.islands(events(spark, sf_dir), 60.0),
    "resample_ground": lambda spark, sf_dir: _rounded(nulls.ground(events(spark, sf_dir), DRAWS, WINDOW, "resample"), "stat"),
    "rank_shuffle_ground": lambda spark, sf_dir: _rounded(nulls.ground(events(spark, sf_dir), DRAWS, WINDOW, "shuffle"), "stat"),
    "extreme_ground": lambda spark, sf_dir: _rounded(nulls.extreme_ground(events(spark, sf_dir), 8, WINDOW, 3), "stat"),
    "place_observation": lambda spark, sf_dir: _rounded(place(spark, sf_dir), "observed", "rank"),
    "apertures": _apertures,
    "disagreement": _disagreement,
    "temporality": lambda spark, sf_dir: nulls.temporality(events(spark, sf_dir), ORDERED, 3),
    "hop_windows": lambda spark, sf_dir: _rounded(S.hop_windows(events(spark, sf_dir), WINDOW, 4), "mean"),
    "regimes": lambda spark, sf_dir: _rounded(regimes.segments(regimes.regimes(events(spark, sf_dir))), "mean"),
    "baselines": lambda spark, sf_dir: _rounded(_predicted(spark, sf_dir), "v", "mean", "sd"),
    "scores": _scored,
    "ledger_gain": lambda spark, sf_dir: predict.ledger(_predicted(spark, sf_dir), 12).withColumns({"loss": F.round("loss", 4), "gain": F.round("gain", 4)}),
}

_SERIES = "s AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events WHERE value IS NOT NULL)"


def _burst(table: str, keys: str) -> str:
    return f"SELECT {keys}, max(m) AS stat FROM (SELECT {keys}, avg(v) OVER w AS m, count(*) OVER w AS k FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) WHERE k = {WINDOW} GROUP BY {keys}"


_PATTERNS = """p AS (SELECT sid, key, count(*) AS n FROM (
  SELECT sid, lead(i, 2) OVER w AS last, array_to_string(list_transform(list_sort([{'v': v, 'j': 0}, {'v': lead(v, 1) OVER w, 'j': 1}, {'v': lead(v, 2) OVER w, 'j': 2}]), lambda x: x.j), '') AS key
  FROM s WINDOW w AS (PARTITION BY sid ORDER BY i)) WHERE last IS NOT NULL GROUP BY sid, key),
q AS (SELECT sid, key, n / sum(n) OVER (PARTITION BY sid) AS p, sum(n) OVER (PARTITION BY sid) AS total FROM p),
r AS (SELECT sid, key, p FROM q WHERE total >= 6)"""


def _ground(perturbation: str, draws: int = DRAWS, name: str = "g") -> str:
    drawn = f"d{name} AS (SELECT sid, i, v, draw, {uniform_sql('draw', 'i')} AS u, count(*) OVER (PARTITION BY sid, draw) AS n FROM s, generate_series(0, {draws - 1}) AS t(draw))"
    if perturbation == "resample":
        made = f"m{name} AS (SELECT d{name}.sid, draw, d{name}.i, s.v FROM d{name} JOIN s ON s.sid = d{name}.sid AND s.i = floor(u * n))"
    else:
        made = f"m{name} AS (SELECT sid, draw, row_number() OVER (PARTITION BY sid, draw ORDER BY u, i) - 1 AS i, v FROM d{name})"
    return f"{drawn}, {made}, {name} AS ({_burst(f'm{name}', 'sid, draw')})"


def _place(name: str = "g") -> str:
    return f"""SELECT sid, observed, CASE WHEN low < high AND observed BETWEEN low AND high THEN share END AS rank,
  CASE WHEN low = high THEN 'degenerate_ground' WHEN observed NOT BETWEEN low AND high THEN 'exceeds_witness' END AS gap, low < high AND observed > high AS re_zero
FROM (SELECT b.sid, any_value(b.stat) AS observed, min(g.stat) AS low, max(g.stat) AS high, avg(CASE WHEN g.stat >= b.stat THEN 1.0 ELSE 0.0 END) AS share
  FROM {name} g JOIN b ON b.sid = g.sid GROUP BY b.sid)"""


_B = f"b AS ({_burst('s', 'sid')})"
_PREDICTED = f"""w AS (SELECT *, v - lag(v) OVER o AS step, v - lag(v, 4) OVER o AS season FROM s WINDOW o AS (PARTITION BY sid ORDER BY i)),
p AS (SELECT sid, i, v, unnest([
  {{'name': 'last_value', 'mean': lag(v) OVER o, 'sd': stddev_samp(step) OVER b}},
  {{'name': 'global_mean', 'mean': avg(v) OVER b, 'sd': stddev_samp(v) OVER b}},
  {{'name': 'moving_mean', 'mean': CASE WHEN count(v) OVER r = {WINDOW} THEN avg(v) OVER r END, 'sd': stddev_samp(v) OVER r}},
  {{'name': 'seasonal_persistence', 'mean': lag(v, 4) OVER o, 'sd': stddev_samp(season) OVER b}}], recursive := true)
  FROM w WINDOW o AS (PARTITION BY sid ORDER BY i), b AS (PARTITION BY sid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY sid ORDER BY i ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)),
t AS (SELECT * FROM p WHERE mean IS NOT NULL)"""
_ERF = "(1 - (((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k) * exp(-x * x))"
_CRPS = f"""c AS (SELECT *, CASE WHEN sd > 0 THEN sd * (z * (2 * (CASE WHEN z >= 0 THEN (1 + {_ERF}) / 2 ELSE (1 - {_ERF}) / 2 END) - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) ELSE abs(v - mean) END AS crps
  FROM (SELECT *, 1 / (1 + 0.3275911 * x) AS k FROM (SELECT *, abs(z) / sqrt(2) AS x FROM (SELECT *, CASE WHEN sd > 0 THEN (v - mean) / sd END AS z FROM t))))"""


def _orders(name: str, table: str, by: str) -> str:
    """Shares of the orders of three values in each series of a table, of those with as many windows as there are orders."""
    return f"""{name}k AS (SELECT {by}, key, count(*) AS n FROM (
  SELECT {by}, lead(i, 2) OVER w AS last, array_to_string(list_transform(list_sort([{{'v': v, 'j': 0}}, {{'v': lead(v, 1) OVER w, 'j': 1}}, {{'v': lead(v, 2) OVER w, 'j': 2}}]), lambda x: x.j), '') AS key
  FROM {table} WINDOW w AS (PARTITION BY {by} ORDER BY i)) WHERE last IS NOT NULL GROUP BY {by}, key),
{name}p AS (SELECT {by}, key, n / sum(n) OVER (PARTITION BY {by}) AS p FROM {name}k QUALIFY sum(n) OVER (PARTITION BY {by}) >= 6)"""


def _entropies(name: str, by: str) -> str:
    return f"SELECT {by}, round(-sum(p * ln(p)) / ln(6), 9) AS stat FROM {name}p GROUP BY {by}"


def _arrows(name: str, by: str) -> str:
    both = f"SELECT {by}, sum(p) AS p, sum(q) AS q FROM (SELECT {by}, key, p, 0 AS q FROM {name}p UNION ALL SELECT {by}, translate(key, '012', '210'), 0, p FROM {name}p) GROUP BY {by}, key"
    return f"SELECT {by}, round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 9) AS stat FROM ({both}) GROUP BY {by}"


def _shuffled(name: str, first: int) -> str:
    return f"{name} AS (SELECT sid, draw, row_number() OVER (PARTITION BY sid, draw ORDER BY {uniform_sql(f'(draw + {first})', 'i')}, i) - 1 AS i, v FROM s, range({ORDERED}) AS t(draw))"


def _placed(observed: str, samples: str) -> str:
    return f"SELECT o.sid, any_value(o.stat) AS o, min(g.stat) AS low, max(g.stat) AS high FROM ({observed}) o JOIN ({samples}) g ON g.sid = o.sid GROUP BY o.sid"


ORACLE_SQL: dict[str, str] = {
    "verdict": f"WITH {_SERIES}, {_B}, {_ground('resample')} SELECT sid, CASE WHEN gap = 'degenerate_ground' THEN 'void' WHEN gap IS NOT NULL OR rank < 0.1 OR rank > 0.9 THEN 'contested' ELSE 'supported' END AS verdict FROM ({_place()})",
    "burstiness": f"WITH {_SERIES} SELECT sid, round(stat, 9) AS stat FROM ({_burst('s', 'sid')})",
    "window_mean": f"WITH {_SERIES} SELECT sid, round(avg(v), 9) AS stat FROM s WHERE i < {WINDOW} GROUP BY sid HAVING count(*) = {WINDOW}",
    "max_deviation": f"WITH {_SERIES} SELECT sid, round(max(abs(v - m)), 9) AS stat FROM s JOIN (SELECT sid, quantile_cont(v, 0.5) AS m FROM s GROUP BY sid) USING (sid) GROUP BY sid",
    "permutation_entropy": f"WITH {_SERIES}, {_PATTERNS} SELECT sid, round(-sum(p * ln(p)) / ln(6), 9) AS stat FROM r GROUP BY sid",
    "irreversibility": f"""WITH {_SERIES}, {_PATTERNS}, j AS (SELECT coalesce(a.sid, b.sid) AS sid, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM r a FULL JOIN (SELECT sid, translate(key, '012', '210') AS key, p FROM r) b ON a.sid = b.sid AND a.key = b.key)
SELECT sid, round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 9) AS stat FROM j GROUP BY sid""",
    "coarsen": f"WITH {_SERIES} SELECT sid, i, round(m, 9) AS v FROM (SELECT sid, i, avg(v) OVER w AS m, count(*) OVER w AS k FROM s WINDOW w AS (PARTITION BY sid ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE k = 4",
    "hop_windows": f"WITH {_SERIES} SELECT sid, k * 4 AS start, count(*) AS n, round(avg(v), 9) AS mean FROM s, generate_series(0, (SELECT max(i) FROM s) // 4) AS t(k) WHERE i >= k * 4 AND i < k * 4 + {WINDOW} GROUP BY sid, k HAVING count(*) = {WINDOW}",
    "wave_islands": f"WITH {_SERIES} SELECT sid, min(i) AS start, max(i) AS \"end\", count(*) AS length FROM (SELECT sid, i, i - row_number() OVER (PARTITION BY sid ORDER BY i) AS run FROM s WHERE v > 60.0) GROUP BY sid, run",
    "resample_ground": f"WITH {_SERIES}, {_ground('resample')} SELECT sid, draw, round(stat, 9) AS stat FROM g",
    "rank_shuffle_ground": f"WITH {_SERIES}, {_ground('shuffle')} SELECT sid, draw, round(stat, 9) AS stat FROM g",
    "extreme_ground": f"WITH {_SERIES}, {_ground('shuffle', 24)} SELECT sid, draw // 3 AS draw, round(max(stat), 9) AS stat FROM g GROUP BY sid, draw // 3",
    "place_observation": f"WITH {_SERIES}, {_B}, {_ground('resample')} SELECT sid, round(observed, 9) AS observed, round(rank, 9) AS rank, gap, re_zero FROM ({_place()})",
    "apertures": f"WITH {_SERIES}, {_ground('resample')} SELECT sid, round(quantile_cont(stat, 0.75) - quantile_cont(stat, 0.25), 9) AS volume, round(quantile_cont(stat, 0.95) - quantile_cont(stat, 0.05), 9) AS tail_span FROM g GROUP BY sid",
    "disagreement": f"""WITH {_SERIES}, {_B}, {_ground('resample')}, {_ground('shuffle', name='h')}
SELECT sid, count(*) AS n, count(gap) AS censored, count(gap) > 0 AND count(rank) > 0 AS split, round(max(rank) - min(rank), 9) AS spread FROM ({_place()} UNION ALL {_place('h')}) GROUP BY sid""",
    "temporality": f"""WITH {_SERIES}, {_shuffled('d', 0)}, {_shuffled('e', ORDERED)}, {_orders('s', 's', 'sid')}, {_orders('d', 'd', 'sid, draw')}, {_orders('e', 'e', 'sid, draw')},
a AS ({_placed(_entropies('s', 'sid'), _entropies('d', 'sid, draw'))}), b AS ({_placed(_arrows('s', 'sid'), _arrows('e', 'sid, draw'))})
SELECT a.sid, CASE WHEN a.low = a.high THEN 'void' WHEN a.o > a.high THEN 'unstable' WHEN a.o >= a.low THEN 'exchangeable' WHEN b.low < b.high AND b.o > b.high THEN 'arrowed' ELSE 'reversible' END AS temporality
FROM a JOIN b USING (sid)""",
    "baselines": f"WITH {_SERIES}, {_PREDICTED} SELECT sid, i, round(v, 9) AS v, name, round(mean, 9) AS mean, round(sd, 9) AS sd FROM t",
    "scores": f"""WITH {_SERIES}, {_PREDICTED}, {_CRPS} SELECT name, count(*) AS n, round(avg(crps), 6) AS crps, round(avg(CASE WHEN sd > 0 THEN ln(sd) + 0.5 * ln(2 * pi()) + z * z / 2 END), 6) AS log_loss,
  round(avg((v - mean) * (v - mean)), 6) AS squared, round(avg(abs(v - mean)), 6) AS absolute, round(avg(CASE WHEN v >= mean THEN 0.9 * (v - mean) ELSE 0.1 * (mean - v) END), 6) AS pinball FROM c GROUP BY name""",
    "ledger_gain": f"""WITH {_SERIES}, {_PREDICTED}, {_CRPS}, l AS (SELECT name, count(*) AS n, sum(crps) AS loss FROM (SELECT *, count(*) OVER (PARTITION BY sid, i) AS every FROM c WHERE i >= 12) WHERE every = 4 GROUP BY name)
SELECT name, n, round(loss, 4) AS loss, round((SELECT min(o.loss) FROM l o WHERE o.name <> l.name) - loss, 4) AS gain FROM l""",
}
