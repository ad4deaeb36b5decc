"""Registered queries of losses, agreement, segmentation errors and typed placements, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions.rng import uniform_sql
from groundwork.operators import agreement, nulls, scoring, segmentation
from groundwork.operators import series as S
from groundwork.operators import text as T
from groundwork.plans.series_queries import _B, _SERIES, DRAWS, WINDOW, _ground, _place, events
from groundwork.plans.text_queries import _T

#: Previous values that make an ensemble, forms of a predicted sequence, and the quantiles that are judged.
ENSEMBLE, HORIZON, TAUS = 8, 4, (0.1, 0.5, 0.9)
#: Tokens of a frame.
FRAME = 40


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("event_type").alias("form"), F.col("value").alias("v"))


def _rounded(df: DataFrame, *names: str, to: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


def _categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's type as predicted by the user's earlier ones, every type counted once more."""
    steps = _steps(spark, sf_dir)
    forms = steps.select(F.col("form").alias("label")).distinct()  # kinds of events
    before = Window.partitionBy("sid", "label").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    every = steps.crossJoin(F.broadcast(forms)).withColumn("c", F.coalesce(F.sum(F.when(F.col("form") == F.col("label"), 1).otherwise(0)).over(before), F.lit(0)))
    probs = every.groupBy("sid", "i", "form").agg(F.collect_list(F.struct("label", (F.col("c") + 1).alias("w"))).alias("w"), F.sum(F.col("c") + 1).alias("all"))
    p = F.map_from_entries(F.transform("w", lambda x: F.struct(x["label"], x["w"] / F.col("all"))))
    scored = probs.withColumn("p", p).select("sid", scoring.brier(F.col("p"), F.col("form")).alias("b"), scoring.categorical_log_loss(F.col("p"), F.col("form")).alias("l"))
    return _rounded(scored.groupBy("sid").agg(F.count("*").alias("n"), F.avg("b").alias("brier"), F.avg("l").alias("log_loss")), "brier", "log_loss")


def _ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value against the ensemble of the values before it."""
    w = Window.partitionBy("sid").orderBy("i").rowsBetween(-ENSEMBLE, -1)
    x = events(spark, sf_dir).withColumn("x", F.collect_list("v").over(w)).filter(F.size("x") == ENSEMBLE)
    losses = scoring.sample_crps(F.col("x"), F.col("v")), scoring.quantile_loss([(t, scoring.quantile(F.col("x"), t)) for t in TAUS], F.col("v"))
    return _rounded(x.select("sid", losses[0].alias("c"), losses[1].alias("p")).groupBy("sid").agg(F.count("*").alias("n"), F.avg("c").alias("crps"), F.avg("p").alias("pinball")), "crps", "pinball")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next forms as a repetition of the last ones."""
    w = Window.partitionBy("sid").orderBy("i")
    x = _steps(spark, sf_dir).select("sid", F.collect_list("form").over(w.rowsBetween(-HORIZON, -1)).alias("said"), F.collect_list("form").over(w.rowsBetween(0, HORIZON - 1)).alias("came"))
    x = x.filter((F.size("said") == HORIZON) & (F.size("came") == HORIZON))
    return x.groupBy("sid").agg(F.count("*").alias("n"), F.sum(scoring.prefix_agreement(F.col("said"), F.col("came"))).cast("long").alias("prefix_loss"), F.sum(scoring.exact_match(F.col("said"), F.col("came"))).cast("long").alias("misses"))


def _cohen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.cohen(_read(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))), "agreement", "kappa")


def _fleiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of an order as raters of its return flag."""
    lines = _read(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("category"))
    return _rounded(agreement.fleiss(lines, 3), "kappa")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir)
    out = nulls.typed_difference(s, S.burstiness(s, WINDOW), nulls.ground(s, DRAWS, WINDOW, "resample"), DRAWS)
    return _rounded(out, "observed", "low", "high", "rank")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the event's type against values that cross the middle."""
    w = Window.partitionBy("sid").orderBy("i")
    flags = _steps(spark, sf_dir).filter("v is not null").withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    changes = lambda c: F.coalesce(c != F.lag(c).over(w), F.lit(False))
    return flags.select("sid", "i", changes(F.col("form")).alias("r"), changes(F.col("v") > 50).alias("h"))


def _tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return _rounded(segmentation.tiled_texts(texts, F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), F.lit(1)), FRAME, 2), "similarity")


def _dealt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of texts that were dealt by doc: what goes by doc and form from then on stays where it is."""
    return T.tokens(_read(spark, sf_dir, "documents").repartition("doc_id"))


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = segmentation.content_frames(_dealt_tokens(spark, sf_dir), FRAME, T.FUNCTION_SHARE)
    return _rounded(segmentation.boundaries(frames), "weight")


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses by host."""
    rows = _read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("by"), F.col("url").alias("row"))
    return _rounded(T.row_form_distances(rows), "distance")


def _containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the later turns of a conversation have of its first one's trigrams."""
    turns = _read(spark, sf_dir, "conversations")
    grams = T.ngrams(turns.select(F.struct("conv_id", "turn").alias("id"), "text"), 3, "id").select(F.col("doc.conv_id").alias("conv_id"), F.col("doc.turn").alias("doc"), "gram", "n")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    grams = grams.join(first, "conv_id")
    return _rounded(T.containment(grams.filter("doc > first"), grams.filter("doc = first"), ["conv_id"]), "containment")


def _max_deviation_ground(perturbation: str, to: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(nulls.ground(events(spark, sf_dir), DRAWS, WINDOW, perturbation, statistic="max_deviation"), "stat", to=to)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "segmentation_errors": lambda spark, sf_dir: _rounded(segmentation.boundary_errors(_flags(spark, sf_dir)), "pk", "window_diff"),
    "boundary_hits": lambda spark, sf_dir: segmentation.boundary_hits(_flags(spark, sf_dir), 1, 2),
    "tiling_similarity": _tiling,
    "text_boundaries": _boundaries,
    "script_profile": lambda spark, sf_dir: _rounded(T.script_profile(_read(spark, sf_dir, "documents")), "share"),
    "row_form_distances": _shapes,
    "query_containment": _containment,
    "content_words": lambda spark, sf_dir: T.content_words(_dealt_tokens(spark, sf_dir), T.function_words(T.tokens(_read(spark, sf_dir, "documents")))),
    "sequence_baselines": lambda spark, sf_dir: _rounded(T.sequence_baselines(_dealt_tokens(spark, sf_dir)), "unigram", "uniform", "repeats"),
    "level": lambda spark, sf_dir: _rounded(nulls.level(events(spark, sf_dir), WINDOW, DRAWS, 2), "displacement", "threshold"),
    "categorical_scores": _categorical,
    "ensemble_scores": _ensemble,
    "sequence_scores": _sequences,
    "cohen_kappa": _cohen,
    "fleiss_kappa": _fleiss,
    "typed_placement": _typed,
    "full_verdict": lambda spark, sf_dir: nulls.full_verdict(events(spark, sf_dir), WINDOW, DRAWS, 2),
    "resample_deviation_ground": _max_deviation_ground("resample", 9),
    "phase_deviation_ground": _max_deviation_ground("phase", 5),
}

_FORMS = "f AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS form, value AS v FROM events)"
_DRAWN = f"d AS (SELECT sid, i, v, draw, {uniform_sql('draw', 'i')} AS u, count(*) OVER (PARTITION BY sid, draw) AS n FROM s, generate_series(0, {DRAWS - 1}) AS t(draw))"
_DEVIATION = "SELECT sid, draw, round(max(abs(v - m)), {to}) AS stat FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY sid, draw) AS m FROM {rows}) GROUP BY sid, draw"
_SAID = "CASE WHEN gap = 'degenerate_ground' THEN 'void' WHEN gap IS NOT NULL OR rank < 0.1 OR rank > 0.9 THEN 'contested' ELSE 'supported' END"


def _turn(k: int) -> str:
    """The ground of the k-th reseeding: draws from k * DRAWS on."""
    return _ground("resample", DRAWS, f"g{k}").replace(uniform_sql("draw", "i"), uniform_sql(f"(draw + {k * DRAWS})", "i"))


_FLAGS = f"""{_FORMS}, e AS (SELECT sid, row_number() OVER o - 1 AS i, coalesce(form <> lag(form) OVER o, false) AS r, coalesce((v > 50) <> lag(v > 50) OVER o, false) AS h FROM f WHERE v IS NOT NULL WINDOW o AS (PARTITION BY sid ORDER BY i))"""

ORACLE_SQL: dict[str, str] = {
    "boundary_hits": f"""WITH {_FLAGS} SELECT sid, count_if(r) AS boundaries, count_if(h) AS found,
  count_if(r AND EXISTS (SELECT 1 FROM e x WHERE x.sid = e.sid AND x.h AND x.i BETWEEN e.i - 1 AND e.i + 2)) AS hits,
  count_if(h AND EXISTS (SELECT 1 FROM e x WHERE x.sid = e.sid AND x.r AND x.i BETWEEN e.i - 2 AND e.i + 1)) AS "right" FROM e GROUP BY sid""",
    "tiling_similarity": f"""WITH {_T}, c AS (SELECT doc, pos // {FRAME} AS frame, form, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT doc, unnest(generate_series(1, max(frame))) AS gap FROM c GROUP BY doc),
v AS (SELECT doc, gap, form, sum(CASE WHEN frame < gap THEN n END) AS x, sum(CASE WHEN frame >= gap THEN n END) AS y FROM g JOIN c USING (doc) WHERE frame BETWEEN gap - 2 AND gap + 1 GROUP BY doc, gap, form)
SELECT doc, gap, round(coalesce(coalesce(sum(x * y), 0) / sqrt(sum(x * x) * sum(y * y)), 0), 9) AS similarity FROM v GROUP BY doc, gap""",
    "script_profile": r"""WITH l AS (SELECT doc_id AS doc, source, length(regexp_replace(text, '\P{L}', '', 'g')) AS letters, [length(regexp_replace(text, '\P{Latin}', '', 'g')), length(regexp_replace(text, '\P{Han}', '', 'g')), length(regexp_replace(text, '\P{Cyrillic}', '', 'g')), length(regexp_replace(text, '\P{Greek}', '', 'g'))] AS k FROM documents),
m AS (SELECT doc, source, letters, list_append(k, greatest(letters - list_sum(k), 0)) AS k FROM l),
p AS (SELECT doc, source, CASE WHEN list_max(k) > 0 THEN ['Latin', 'Han', 'Cyrillic', 'Greek', 'Other'][list_position(k, list_max(k))] END AS script, CASE WHEN list_max(k) > 0 THEN list_max(k) / letters END AS share FROM m),
b AS (SELECT source, script AS most FROM (SELECT source, script, count(*) AS n FROM p WHERE script IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, script DESC) = 1)
SELECT doc, script, round(share, 9) AS share, script <> most AS switched FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source""",
    "row_form_distances": r"""WITH r AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS "by", regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[^\s\p{L}\p{Nd}]+', chr(1), 'g'), '\s+', chr(2), 'g'), '\p{Nd}+', chr(3), 'g'), '\p{Lu}+', chr(4), 'g'), '\p{Ll}+', chr(5), 'g'), '\p{L}+', chr(6), 'g') AS u FROM pages),
q AS (SELECT "by", translate(u, chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6), 'p_dUlw') AS shape FROM r), k AS (SELECT "by", shape, count(*) AS n FROM q GROUP BY "by", shape), s AS (SELECT *, sum(n) OVER (PARTITION BY "by") AS size FROM k)
SELECT a."by", a.shape, a.n, round(sum(b.n * levenshtein(a.shape, b.shape) / greatest(length(a.shape), length(b.shape), 1)) / (a.size - 1), 9) AS distance FROM s a JOIN s b ON a."by" = b."by" WHERE a.size > 2 GROUP BY a."by", a.shape, a.n, a.size""",
    "query_containment": """WITH g AS (SELECT conv_id, turn, gram, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(generate_series(1, length(text) - 2), lambda i: substring(lower(text), i, 3))) AS gram FROM conversations WHERE length(text) >= 3) GROUP BY ALL),
f AS (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY conv_id), q AS (SELECT g.conv_id, gram, n FROM g JOIN f ON g.conv_id = f.conv_id AND turn = first), z AS (SELECT conv_id, sqrt(sum(n * n)) AS norm FROM q GROUP BY conv_id)
SELECT g.conv_id, g.turn AS doc, round(sum(q.n * least(g.n, q.n)) / (any_value(norm) * sqrt(sum(least(g.n, q.n) ** 2))), 9) AS containment FROM g JOIN f ON g.conv_id = f.conv_id AND turn > first JOIN q ON q.conv_id = g.conv_id AND q.gram = g.gram JOIN z ON z.conv_id = g.conv_id GROUP BY g.conv_id, g.turn""",
    "content_words": f"""WITH {_T}, w AS (SELECT doc, form, count(*) AS k, sum(count(*)) OVER (PARTITION BY doc) AS n FROM t GROUP BY doc, form), f AS (SELECT form FROM t GROUP BY form HAVING count(*) / (SELECT count(*) FROM t) >= 0.006)
SELECT doc, CAST(any_value(n) AS BIGINT) AS n, CAST(sum(CASE WHEN k / n < 0.006 THEN k ELSE 0 END) AS BIGINT) AS content, CAST(sum(CASE WHEN form NOT IN (SELECT form FROM f) THEN k ELSE 0 END) AS BIGINT) AS content_of_all FROM w GROUP BY doc""",
    "sequence_baselines": f"""WITH {_T}, c AS (SELECT *, row_number() OVER (PARTITION BY doc, form ORDER BY pos) - 1 AS c, lag(form) OVER (PARTITION BY doc ORDER BY pos) AS b FROM t), m AS (SELECT *, coalesce(count_if(c = 0) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met FROM c)
SELECT doc, count(*) AS n, round(avg(-ln((c + 1) / (pos + met + 1))), 9) AS unigram, round(avg(ln(met + 1)), 9) AS uniform, round(avg(CASE WHEN b = form THEN 1.0 WHEN b IS NOT NULL THEN 0.0 END), 9) AS repeats FROM m GROUP BY doc""",
    "level": f"""WITH {_SERIES}, {_B}, {_turn(0)}, {_turn(1)}, {_turn(2)}, {_ground('shuffle', name='h')},
a AS ({_place('g0')}), r1 AS ({_place('g1')}), r2 AS ({_place('g2')}), c AS ({_place('h')}),
j AS (SELECT a.sid, a.rank, c.rank - a.rank AS moved, greatest(2.0 / {DRAWS}, abs(r1.rank - a.rank), abs(r2.rank - a.rank)) AS threshold, coalesce(a.gap, CASE WHEN c.rank IS NULL OR r1.rank IS NULL OR r2.rank IS NULL THEN 'unstable' END) AS gap FROM a LEFT JOIN r1 USING (sid) LEFT JOIN r2 USING (sid) LEFT JOIN c USING (sid))
SELECT sid, CASE WHEN gap IS NULL THEN CASE WHEN abs(moved) <= threshold THEN 'peer' WHEN moved > 0 THEN 'above' ELSE 'below' END END AS relationship, CASE WHEN gap IS NULL THEN round(moved, 9) END AS displacement, CASE WHEN gap IS NULL THEN round(threshold, 9) END AS threshold, gap FROM j""",
    "segmentation_errors": f"""WITH {_FORMS}, e AS (SELECT sid, row_number() OVER o - 1 AS i, coalesce(form <> lag(form) OVER o, false) AS r, coalesce((v > 50) <> lag(v > 50) OVER o, false) AS h FROM f WHERE v IS NOT NULL WINDOW o AS (PARTITION BY sid ORDER BY i)),
z AS (SELECT sid, count(*) AS n, CAST(greatest(1, floor(count(*) / (count_if(r) + 1) / 2 + 0.5)) AS BIGINT) AS k FROM e GROUP BY sid),
p AS (SELECT a.sid, a.i, any_value(n) AS n, any_value(k) AS k, count_if(b.r) AS x, count_if(b.h) AS y FROM e a JOIN z USING (sid) JOIN e b ON b.sid = a.sid AND b.i > a.i AND b.i <= a.i + k WHERE a.i < n - k GROUP BY a.sid, a.i)
SELECT sid, n, k, round(avg(CASE WHEN (x = 0) <> (y = 0) THEN 1.0 ELSE 0.0 END), 9) AS pk, round(avg(CASE WHEN x <> y THEN 1.0 ELSE 0.0 END), 9) AS window_diff FROM p GROUP BY sid, n, k""",
    "categorical_scores": f"""WITH {_FORMS}, e AS (SELECT sid, i, form, label, (SELECT count(*) FROM f x WHERE x.sid = f.sid AND x.i < f.i AND x.form = label) + 1 AS w FROM f, (SELECT DISTINCT event_type AS label FROM events)),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY sid, i) AS p FROM e),
b AS (SELECT sid, i, sum((p - CASE WHEN label = form THEN 1 ELSE 0 END) ** 2) AS b, -ln(max(CASE WHEN label = form THEN p END)) AS l FROM p GROUP BY sid, i)
SELECT sid, count(*) AS n, round(avg(b), 9) AS brier, round(avg(l), 9) AS log_loss FROM b GROUP BY sid""",
    "ensemble_scores": f"""WITH {_SERIES}, x AS (SELECT a.sid, a.i, a.v, avg(abs(b.v - a.v)) AS near, quantile_cont(b.v, [0.1, 0.5, 0.9]) AS q, list(b.v) AS x FROM s a JOIN s b ON b.sid = a.sid AND b.i BETWEEN a.i - {ENSEMBLE} AND a.i - 1 GROUP BY a.sid, a.i, a.v HAVING count(*) = {ENSEMBLE}),
l AS (SELECT sid, near - list_sum(list_transform(x, lambda p: list_sum(list_transform(x, lambda q: abs(p - q))))) / (2 * {ENSEMBLE} * {ENSEMBLE}) AS c,
  (CASE WHEN v >= q[1] THEN 0.1 * (v - q[1]) ELSE -0.9 * (v - q[1]) END + CASE WHEN v >= q[2] THEN 0.5 * (v - q[2]) ELSE -0.5 * (v - q[2]) END + CASE WHEN v >= q[3] THEN 0.9 * (v - q[3]) ELSE -0.1 * (v - q[3]) END) / 3 AS p FROM x)
SELECT sid, count(*) AS n, round(avg(c), 9) AS crps, round(avg(p), 9) AS pinball FROM l GROUP BY sid""",
    "sequence_scores": f"""WITH {_FORMS}, p AS (SELECT a.sid, a.i, min(CASE WHEN a2.form <> b2.form THEN b2.i - a.i END) AS first, count(*) AS k FROM f a JOIN f b2 ON b2.sid = a.sid AND b2.i BETWEEN a.i AND a.i + {HORIZON - 1} JOIN f a2 ON a2.sid = a.sid AND a2.i = b2.i - {HORIZON} GROUP BY a.sid, a.i HAVING count(*) = {HORIZON})
SELECT sid, count(*) AS n, CAST(sum({HORIZON} - coalesce(first, {HORIZON})) AS BIGINT) AS prefix_loss, count(first) AS misses FROM p WHERE i >= {HORIZON} GROUP BY sid""",
    "cohen_kappa": """WITH w AS (SELECT count(*) AS n, count_if(quality = toxic) AS same FROM labels), m AS (SELECT sum(x * y) AS xy FROM (SELECT quality AS c, count(*) AS x FROM labels GROUP BY quality) JOIN (SELECT toxic AS c, count(*) AS y FROM labels GROUP BY toxic) USING (c))
SELECT n, n - same AS splits, round(same / n, 9) AS agreement, round((same / n - xy / n / n) / (1 - xy / n / n), 9) AS kappa FROM w, m""",
    "fleiss_kappa": """WITH l AS (SELECT l_orderkey AS item, l_returnflag AS category, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_linenumber <= 3), c AS (SELECT item, category, count(*) AS k FROM l WHERE n = 3 GROUP BY item, category),
p AS (SELECT count(*) AS items, avg(s / 6) AS p FROM (SELECT sum(k * (k - 1)) AS s FROM c GROUP BY item)), e AS (SELECT sum((k / t) ** 2) AS e FROM (SELECT sum(k) AS k, sum(sum(k)) OVER () AS t FROM c GROUP BY category))
SELECT items, round((p - e) / (1 - e), 9) AS kappa FROM p, e""",
    "typed_placement": f"""WITH {_SERIES}, {_B}, {_ground('resample')}, z AS (SELECT sid, count(*) AS extent FROM s GROUP BY sid),
j AS (SELECT z.sid, any_value(extent) AS extent, any_value(b.stat) AS observed, min(g.stat) AS low, max(g.stat) AS high, count(g.stat) AS n, avg(CASE WHEN g.stat >= b.stat THEN 1.0 ELSE 0.0 END) AS share FROM z LEFT JOIN b USING (sid) LEFT JOIN g ON g.sid = z.sid GROUP BY z.sid),
k AS (SELECT *, CASE WHEN n <> {DRAWS} OR observed IS NULL THEN 'unknown_spec' WHEN low = high THEN 'degenerate_ground' WHEN observed NOT BETWEEN low AND high THEN 'exceeds_witness' END AS gap FROM j)
SELECT sid, extent, round(observed, 9) AS observed, round(low, 9) AS low, round(high, 9) AS high, CASE WHEN gap IS NULL THEN round(share, 9) END AS rank, gap,
  CASE WHEN gap = 'exceeds_witness' THEN CASE WHEN observed > high THEN 'above' ELSE 'below' END END AS direction, CASE WHEN gap = 'exceeds_witness' THEN 1.0 / {DRAWS} END AS censored_at FROM k""",
    "full_verdict": f"""WITH {_SERIES}, {_B}, {_turn(0)}, {_turn(1)}, {_turn(2)}, {_ground('shuffle', name='h')},
a AS (SELECT sid, {_SAID} AS said FROM ({_place('g0')})), r1 AS (SELECT sid, {_SAID} AS said FROM ({_place('g1')})), r2 AS (SELECT sid, {_SAID} AS said FROM ({_place('g2')})), p AS (SELECT sid, {_SAID} AS said FROM ({_place('h')}))
SELECT a.sid, CASE WHEN a.said = 'void' THEN 'void' WHEN a.said <> p.said THEN 'thrash' WHEN a.said = 'supported' AND r1.said = 'supported' AND r2.said = 'supported' THEN 'settled' ELSE a.said END AS verdict FROM a JOIN r1 USING (sid) JOIN r2 USING (sid) JOIN p USING (sid)""",
    "resample_deviation_ground": f"WITH {_SERIES}, {_DRAWN}, m AS (SELECT d.sid, draw, d.i, s.v FROM d JOIN s ON s.sid = d.sid AND s.i = floor(u * n)) {_DEVIATION.format(to=9, rows='m')}",
    "phase_deviation_ground": f"""WITH {_SERIES}, z AS (SELECT sid, count(*) AS n FROM s GROUP BY sid), q AS (SELECT sid, n, k, sqrt(sum(v * cos(2 * pi() * k * i / n)) ** 2 + sum(v * sin(2 * pi() * k * i / n)) ** 2) AS size, sum(v * cos(2 * pi() * k * i / n)) AS re
  FROM s JOIN z USING (sid), generate_series(0, (SELECT max(n) FROM z) // 2) AS t(k) WHERE k <= n // 2 GROUP BY sid, n, k),
r AS (SELECT q.sid, n, k, draw, CASE WHEN k = 0 OR 2 * k = n THEN re ELSE 2 * size END AS a, CASE WHEN k = 0 OR 2 * k = n THEN 0 ELSE 2 * pi() * {uniform_sql('draw', '(k - 1)')} END AS ph FROM q, generate_series(0, {DRAWS - 1}) AS t(draw)),
m AS (SELECT s.sid, draw, s.i, CASE WHEN any_value(n) < 4 THEN any_value(v) ELSE sum(a * cos(2 * pi() * k * s.i / n + ph)) / any_value(n) END AS v FROM s JOIN r ON r.sid = s.sid GROUP BY s.sid, draw, s.i)
{_DEVIATION.format(to=5, rows='m')}""",
}
