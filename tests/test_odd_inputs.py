"""Inputs on which queries once failed or differed from their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from groundwork.operators import segmentation
from groundwork.operators import text as T
from groundwork.plans import measure_queries, series_queries


def test_script_of_signs_that_are_no_letters(spark):
    rows = [(0, "a", "abc"), (1, "a", "123"), (2, "a", ""), (3, "a", None), (4, None, "Ⅷ"), (5, "a", "Ⅷ a"), (6, "b", "〇〇")]
    got = {r.doc: (r.script, r.share, r.switched) for r in T.script_profile(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    none = (None, None, None)
    assert got == {0: ("Latin", 1.0, False), 1: none, 2: none, 3: none, 4: ("Latin", float("inf"), False), 5: ("Latin", 2.0, False), 6: ("Han", float("inf"), False)}


def test_scores_of_values_whose_steps_differ_by_rounding(spark, tmp_path):
    db = duckdb.connect()
    rows = ", ".join(f"({u * 100 + k}, {u}, {round(a + d * k, 2) + (7.5 if k > 5 else 0)})" for u, (a, d) in enumerate([(1.1, 1.1), (0.3, 0.1), (5.07, 0.71), (2.2, 0), (9.9, 3.3), (0.1, 0.7)]) for k in range(9))
    db.execute(f"COPY (SELECT id AS event_id, TIMESTAMP '2024-01-01' + to_seconds(id) AS ts, CAST(u AS BIGINT) AS user_id, CAST(v AS DOUBLE) AS value FROM (VALUES {rows}) t(id, u, v)) TO '{tmp_path}/events.parquet'").fetchall()
    got = {x[0]: tuple(x)[1:] for x in series_queries.QUERIES["scores"](spark, str(tmp_path)).select("name", "n", "crps", "log_loss", "squared", "absolute", "pinball").collect()}
    want = duckdb.connect()
    want.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'").fetchall()
    said = {x[0]: x[1:] for x in want.execute(series_queries.ORACLE_SQL["scores"]).fetchall()}
    assert got.keys() == said.keys() and all(got[k] == pytest.approx(said[k], rel=1e-12) for k in said)


def test_tiling_has_no_rows_for_tokens_and_counts_rows_of_a_doc_together(spark, sf_dir):
    plan = measure_queries.QUERIES["tiling_similarity"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    rows = [(1, "a b c a b d e a b f".split()), (1, "x a y b".split()), (2, []), (3, None), (4, ["a"] * 3), (None, "a b c d".split()), (5, "a b".split())]
    texts = spark.createDataFrame(rows, "doc long, forms array<string>")
    frames = texts.select("doc", F.posexplode("forms").alias("pos", "form")).groupBy("doc", F.floor(F.col("pos") / 2).alias("frame"), "form").agg(F.count("*").alias("n"))
    want = {(x.doc, x.gap): x.similarity for x in segmentation.tiling(frames.filter("doc is not null"), 2).collect()}
    got = {(x.doc, x.gap): x.similarity for x in segmentation.tiled_texts(texts, F.col("forms"), 2, 2).filter("doc is not null").collect()}
    assert got == pytest.approx(want) and len(want) > 4
