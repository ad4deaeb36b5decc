"""Registered queries over graphs, records, logs and propositions, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import agreement, components, kinds, log, reason
from groundwork.operators import graph as G

GAMMA, MARK, READS = 0.95, "purchase", ["click", "view"]
#: Place of the cursor in the log, of which it then reads so large a share at every size.
SHARE = (4, 5)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that deliver parts, by the month of shipping."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject"), F.col("l_returnflag").alias("verb"), F.concat(F.lit("b"), (F.col("l_partkey") % 40).cast("string")).alias("object"), month.cast("long").alias("tick"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.decayed_edges(triples(spark, sf_dir), GAMMA)


def _weight(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.round("weight", 6))


def _compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("subject"), F.col("c_nationkey").cast("long").alias("object"))
    second = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("subject"), F.col("n_regionkey").cast("long").alias("object"))
    return G.compose(first, second)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in nations, nations in regions, and customers of one segment in regions already."""
    read = lambda name: _read(spark, sf_dir, name)
    edge = lambda df, a, b, w: df.select(a.alias("subject"), F.lit("in").alias("verb"), b.alias("object"), w.alias("weight"))
    c, n, r = (lambda k: F.concat(F.lit("c"), k)), (lambda k: F.concat(F.lit("n"), k)), (lambda k: F.concat(F.lit("r"), k))
    whole = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter("c_mktsegment = 'BUILDING'")
    own = edge(read("customer"), c("c_custkey"), n("c_nationkey"), F.round("c_acctbal", 2))
    return own.unionByName(edge(read("nation"), n("n_nationkey"), r("n_regionkey"), F.lit(1000.0))).unionByName(edge(whole, c("c_custkey"), r("n_regionkey"), F.lit(1.0)))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("event_type").alias("id"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("tick"), F.col("event_type").alias("type"), F.col("user_id").alias("task"), "value")


def _at_share(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The log, and a cursor that moves with its size."""
    entries = _log(spark, sf_dir)
    return entries, log.cursor_at(entries, *SHARE)


def _lens_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, cursor = _at_share(spark, sf_dir)
    return log.lens(entries, READS, cursor)


def _discarded_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, cursor = _at_share(spark, sf_dir)
    return log.discarded_types(entries, READS, cursor)


def _surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = _read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("tick"), F.col("event_type").alias("form")).agg(F.count("*").alias("n"))
    return G.bayesian_surprise(arrivals).withColumn("bits", F.round("bits", 9))


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.concat_ws(":", "p_type", (F.col("p_size") % 5).cast("string")).alias("field"))


def _propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), F.when(F.col("o_totalprice") > 150000, 1).otherwise(-1).alias("polarity"), day.alias("start"), (day + 90).alias("end"))


def _at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _propositions(spark, sf_dir)
    return reason.at_risk(p, p.select("id", (F.col("id") - 1).alias("on")))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that one customer gave in one month, as chains."""
    from pyspark.sql import Window

    components.ready(spark)
    w = Window.partitionBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM")).orderBy("o_orderkey")
    links = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(w).alias("b")).filter("b is not null")
    return components.components(links)


def _brand_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id"), F.col("p_type").alias("field")).agg(F.count("*").alias("w"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "decayed_edges": lambda spark, sf_dir: _weight(_edges(spark, sf_dir)),
    "node_weights": lambda spark, sf_dir: _weight(G.node_weights(_edges(spark, sf_dir))),
    "strongest_edges": lambda spark, sf_dir: _weight(G.strongest_edges(_edges(spark, sf_dir))),
    "compose_transitive": _compose,
    "compose_edges": lambda spark, sf_dir: G.compose_edges(_places(spark, sf_dir)),
    "cooccurrence": lambda spark, sf_dir: G.cooccurrence(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_suppkey").alias("id"))),
    "coarrival_band": lambda spark, sf_dir: G.coarrivals(_steps(spark, sf_dir), 3),
    "transfer_entropy": lambda spark, sf_dir: G.transfer_entropy(_steps(spark, sf_dir)).withColumn("bits", F.round("bits", 9)),
    "bayesian_surprise": _surprise,
    "prevalence": lambda spark, sf_dir: kinds.prevalence(_attributes(spark, sf_dir)).withColumn("share", F.round("share", 9)),
    "profile_pairs": lambda spark, sf_dir: kinds.profile_pairs(_attributes(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9)),
    "adjusted_rand": lambda spark, sf_dir: kinds.adjusted_rand(_read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"))).withColumn("ari", F.round("ari", 9)),
    "weighted_jaccard": lambda spark, sf_dir: kinds.weighted_jaccard(_brand_weights(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9)),
    "components": _components,
    "two_by_two": lambda spark, sf_dir: agreement.two_by_two(_read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))).withColumns({c: F.round(c, 6) for c in ("agreement", "chi_square", "phi")}),
    "leading_digits": lambda spark, sf_dir: agreement.leading_digits(_read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").withColumn("chi_square", F.round("chi_square", 4)),
    "correlations": lambda spark, sf_dir: agreement.correlations(_read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", "l_discount").withColumns({c: F.round(c, 6) for c in ("pearson", "partial")}),
    "as_of": lambda spark, sf_dir: log.as_of_each(_log(spark, sf_dir), MARK),
    "lens_view": lambda spark, sf_dir: log.as_of_each(_log(spark, sf_dir), MARK).filter(F.col("type").isin(READS)),
    "discarded_types": lambda spark, sf_dir: log.as_of_each(_log(spark, sf_dir), MARK).filter(~F.col("type").isin(READS)).groupBy("type").agg(F.count("*").alias("n")),
    "as_of_share": lambda spark, sf_dir: log.as_of(*_at_share(spark, sf_dir)),
    "lens_view_share": _lens_share,
    "discarded_types_share": _discarded_share,
    "task_projection": lambda spark, sf_dir: log.project_tasks(_log(spark, sf_dir)),
    "working_set": lambda spark, sf_dir: log.working_set(log.project_tasks(_log(spark, sf_dir))),
    "latest_before": lambda spark, sf_dir: log.latest_before(_log(spark, sf_dir), "purchase"),
    "eot_conflicts": lambda spark, sf_dir: reason.conflicts(_propositions(spark, sf_dir)),
    "eot_underdetermined": lambda spark, sf_dir: reason.underdetermined(_propositions(spark, sf_dir)),
    "eot_dependency_risk": _at_risk,
}

_TRIPLES = "t AS (SELECT 's' || l_suppkey AS subject, l_returnflag AS verb, 'b' || (l_partkey % 40) AS object, year(l_shipdate) * 12 + month(l_shipdate) AS tick FROM lineitem)"
_EDGES = f"{_TRIPLES}, e AS (SELECT subject, verb, object, sum(pow(0.95, (SELECT max(tick) FROM t) - tick)) AS weight FROM t GROUP BY ALL)"
_STEPS = "s AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS id FROM events)"
_LOG = "g AS (SELECT event_id AS tick, event_type AS type, user_id AS task, value FROM events)"
_SHARED = f"{_LOG}, u AS (SELECT min(tick) + (max(tick) - min(tick)) * {SHARE[0]} // {SHARE[1]} AS cursor FROM g), v AS (SELECT g.* FROM g, u WHERE tick < cursor)"
_ATTR = "a AS (SELECT DISTINCT p_brand AS id, p_type || ':' || (p_size % 5) AS field FROM part)"
_PROP = "p AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus AS object, CASE WHEN o_totalprice > 150000 THEN 1 ELSE -1 END AS polarity, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders), m AS (SELECT x.*, y.id AS id_b, y.object AS object_b, y.polarity AS polarity_b, x.s <= y.s + 90 AND y.s <= x.s + 90 AS meet FROM p x JOIN p y USING (subject, predicate) WHERE x.id < y.id)"
_TASKS = "k AS (SELECT task, arg_max(type, tick) AS last_type, arg_max(value, tick) FILTER (value IS NOT NULL) AS last_value, min(tick) AS first_tick, count(DISTINCT type) AS evidence, count(*) AS entries FROM g GROUP BY task)"

_EACH = "SELECT g.* FROM g JOIN (SELECT task, max(tick) AS last FROM g WHERE type = 'purchase' GROUP BY task) USING (task) WHERE tick < last"

ORACLE_SQL: dict[str, str] = {
    "compose_edges": """
SELECT 'c' || c_custkey AS subject, 'in' AS verb, 'r' || n_regionkey AS object, 'n' || n_nationkey AS via, least(round(c_acctbal, 2), 1000.0) AS weight
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'
""",
    "decayed_edges": f"WITH {_EDGES} SELECT subject, verb, object, round(weight, 6) AS weight FROM e",
    "node_weights": f"WITH {_EDGES} SELECT node, round(sum(weight), 6) AS weight FROM (SELECT subject AS node, weight FROM e UNION ALL SELECT object, weight FROM e WHERE subject <> object) GROUP BY node",
    "strongest_edges": f"WITH {_EDGES} SELECT subject, verb, object, round(weight, 6) AS weight FROM e ORDER BY e.weight DESC, subject, verb, object LIMIT 10",
    "compose_transitive": "SELECT c_mktsegment AS subject, n_regionkey AS object, count(*) AS ways FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "cooccurrence": "WITH m AS (SELECT DISTINCT l_orderkey AS frame, l_suppkey AS id FROM lineitem) SELECT x.id AS a, y.id AS b, count(*) AS n FROM m x JOIN m y USING (frame) WHERE x.id < y.id GROUP BY ALL",
    "coarrival_band": f"WITH {_STEPS} SELECT x.id AS a, y.id AS b, count(*) AS n FROM s x JOIN s y ON x.seq = y.seq AND x.id < y.id AND abs(x.pos - y.pos) <= 3 GROUP BY ALL",
    "transfer_entropy": f"""WITH {_STEPS}, v AS (SELECT id, lead(id) OVER (PARTITION BY seq ORDER BY pos) AS nxt FROM s), ids AS (SELECT DISTINCT id FROM v WHERE nxt IS NOT NULL),
c AS (SELECT a.id AS x, b.id AS y, v.nxt = b.id AS y1, v.id = b.id AS y0, v.id = a.id AS x0, count(*) AS n FROM v, ids a, ids b WHERE v.nxt IS NOT NULL AND a.id <> b.id GROUP BY ALL),
d AS (SELECT x, y, y1, n / sum(n) OVER (PARTITION BY x, y) * log2((n / sum(n) OVER (PARTITION BY x, y, y0, x0)) / (sum(n) OVER (PARTITION BY x, y, y1, y0) / sum(n) OVER (PARTITION BY x, y, y0))) AS term FROM c)
SELECT x, y, round(sum(term), 9) AS bits FROM d WHERE y1 GROUP BY x, y""",
    "bayesian_surprise": """WITH a AS (SELECT strftime(ts, '%Y-%m-%d') AS tick, event_type AS form, count(*) AS n FROM events GROUP BY ALL),
e AS (SELECT tick, form, coalesce(n, 0) AS n FROM (SELECT DISTINCT tick FROM a) CROSS JOIN (SELECT DISTINCT form FROM a) LEFT JOIN a USING (tick, form)),
c AS (SELECT *, sum(n) OVER (PARTITION BY form ORDER BY tick) AS post FROM e),
d AS (SELECT tick, (post - n + 1) / (sum(post - n) OVER w + count(*) OVER w) AS p, (post + 1) / (sum(post) OVER w + count(*) OVER w) AS q FROM c WINDOW w AS (PARTITION BY tick))
SELECT tick, round(sum(q * log2(q / p)), 9) AS bits FROM d GROUP BY tick""",
    "prevalence": f"WITH {_ATTR} SELECT field, count(*) AS records, round(count(*) / (SELECT count(DISTINCT id) FROM a), 9) AS share FROM a GROUP BY field",
    "profile_pairs": f"""WITH {_ATTR}, z AS (SELECT id, count(*) AS n FROM a GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM a x JOIN a y USING (field) WHERE x.id < y.id GROUP BY ALL)
SELECT c.a, c.b, round(k / (x.n + y.n - k), 9) AS jaccard, CASE WHEN k = y.n AND x.n > y.n THEN 'above' WHEN k = x.n AND y.n > x.n THEN 'below' ELSE 'peer' END AS height FROM c JOIN z x ON x.id = c.a JOIN z y ON y.id = c.b""",
    "adjusted_rand": """WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS k, (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS y)
SELECT round((k - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 9) AS ari FROM s""",
    "weighted_jaccard": """WITH w AS (SELECT p_brand AS id, p_type AS field, count(*) AS w FROM part GROUP BY ALL), t AS (SELECT id, sum(w) AS t FROM w GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, sum(least(x.w, y.w)) AS low FROM w x JOIN w y USING (field) WHERE x.id < y.id GROUP BY ALL)
SELECT a, b, round(low / (x.t + y.t - low), 9) AS similarity FROM c JOIN t x ON x.id = a JOIN t y ON y.id = b""",
    "components": "SELECT o_orderkey AS node, component FROM (SELECT o_orderkey, min(o_orderkey) OVER w AS component, count(*) OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m'))) WHERE k > 1",
    "two_by_two": """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS p, count(*) FILTER (quality = 1 AND toxic <> 1)::DOUBLE AS q, count(*) FILTER (quality <> 1 AND toxic = 1)::DOUBLE AS r, count(*) FILTER (quality <> 1 AND toxic <> 1)::DOUBLE AS s FROM labels),
d AS (SELECT *, p + q + r + s AS n, (p * s - q * r) / sqrt((p + q) * (r + s) * (p + r) * (q + s)) AS phi FROM c)
SELECT n::BIGINT AS n, round((p + s) / n, 6) AS agreement, round(n * phi * phi, 6) AS chi_square, round(phi, 6) AS phi FROM d""",
    "leading_digits": """WITH d AS (SELECT o_orderpriority, CAST(substring(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS digit, count(*) AS k FROM orders WHERE o_totalprice >= 1 GROUP BY ALL)
SELECT o_orderpriority, sum(k) AS n, round(sum(k * k / log10(1 + 1 / digit)) / sum(k) - sum(k), 4) AS chi_square FROM d GROUP BY o_orderpriority""",
    "correlations": """WITH r AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(xy, 6) AS pearson, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM r""",
    "as_of": f"WITH {_LOG} {_EACH}",
    "lens_view": f"WITH {_LOG} {_EACH} AND type IN ('click', 'view')",
    "discarded_types": f"WITH {_LOG} SELECT type, count(*) AS n FROM ({_EACH} AND type NOT IN ('click', 'view')) GROUP BY type",
    "as_of_share": f"WITH {_SHARED} SELECT * FROM v",
    "lens_view_share": f"WITH {_SHARED} SELECT * FROM v WHERE type IN ('click', 'view')",
    "discarded_types_share": f"WITH {_SHARED} SELECT type, count(*) AS n FROM v WHERE type NOT IN ('click', 'view') GROUP BY type",
    "task_projection": f"WITH {_LOG}, {_TASKS} SELECT * FROM k",
    "working_set": f"WITH {_LOG}, {_TASKS} SELECT * FROM k ORDER BY entries DESC, first_tick LIMIT 7",
    "latest_before": f"WITH {_LOG} SELECT task, tick, max(CASE WHEN type = 'purchase' THEN tick END) OVER (PARTITION BY task ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM g",
    "eot_conflicts": f"WITH {_PROP} SELECT id AS a, id_b AS b, CASE WHEN meet THEN 'conflict' ELSE 'split' END AS act FROM m WHERE object = object_b AND polarity <> polarity_b",
    "eot_underdetermined": f"WITH {_PROP} SELECT subject, predicate, count(DISTINCT o) AS objects FROM (SELECT subject, predicate, unnest([object, object_b]) AS o FROM m WHERE object <> object_b AND polarity > 0 AND polarity_b > 0 AND meet) GROUP BY ALL",
    "eot_dependency_risk": f"WITH {_PROP}, h AS (SELECT DISTINCT unnest([id, id_b]) AS i FROM m WHERE object = object_b AND polarity <> polarity_b AND meet) SELECT id FROM p WHERE id - 1 IN (SELECT i FROM h)",
}
