"""Losses, grounds and their refusals against plain versions in Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.operators import nulls, scoring
from groundwork.operators import series as S
from groundwork.operators import text as T


def test_categorical_losses(spark):
    rows = [({"a": 0.7, "b": 0.3}, "a"), ({"a": 0.7, "b": 0.3}, "b"), ({"a": 1.0, "b": 0.0}, "b"), ({"a": 1.0}, "z")]
    out = spark.createDataFrame(rows, "p map<string, double>, y string").select(scoring.brier(F.col("p"), F.col("y")).alias("b"), scoring.categorical_log_loss(F.col("p"), F.col("y")).alias("l")).collect()
    for (p, y), r in zip(rows, out, strict=True):
        assert math.isclose(r.b, sum((q - (k == y)) ** 2 for k, q in p.items()) + (y not in p))
        assert r.l is None if y not in p else math.isclose(r.l, -math.log(p[y] or 5e-324))


def test_sample_and_quantile_losses(spark):
    r = np.random.default_rng(1)
    rows = [([float(x) for x in r.normal(size=n)], float(r.normal())) for n in (1, 2, 7, 40)] + [([1.0, 1.0, 1.0], 1.0)]
    levels = [(t, scoring.quantile(F.col("x"), t)) for t in (0.1, 0.5, 0.9)]
    out = spark.createDataFrame(rows, "x array<double>, y double").select(scoring.sample_crps(F.col("x"), F.col("y")).alias("c"), scoring.quantile_loss(levels, F.col("y")).alias("q")).collect()
    for (x, y), got in zip(rows, out, strict=True):
        x = np.array(x)
        assert math.isclose(got.c, np.abs(x - y).mean() - np.abs(x[:, None] - x).mean() / 2, abs_tol=1e-12)
        want = [max(t * (y - v), (t - 1) * (y - v)) for t, v in zip((0.1, 0.5, 0.9), np.quantile(x, [0.1, 0.5, 0.9]), strict=True)]
        assert math.isclose(got.q, sum(want) / 3, abs_tol=1e-12)


def test_sequence_losses(spark):
    rows = [(["a", "b", "c"], ["a", "b", "d"]), (["a"], ["a"]), (["a", "b"], ["a"]), (["a"], ["b", "a"]), ([], [])]
    out = spark.createDataFrame(rows, "e array<string>, o array<string>").select(scoring.prefix_agreement(F.col("e"), F.col("o")).alias("p"), scoring.exact_match(F.col("e"), F.col("o")).alias("m")).collect()
    for (e, o), r in zip(rows, out, strict=True):
        k = 0
        while k < min(len(e), len(o)) and e[k] == o[k]:
            k += 1
        assert (r.p, r.m) == (len(e) - k, int(e != o))


def test_phases_keep_the_strengths(spark):
    r = np.random.default_rng(3)
    made = {n: r.normal(size=n) for n in (3, 4, 9, 16)}
    s = spark.createDataFrame([(n, i, float(v)) for n, x in made.items() for i, v in enumerate(x)], "sid long, i long, v double")
    rows = nulls.phased(s, 3, 5).collect()
    for n, x in made.items():
        for draw in range(3):
            y = np.array([q.v for q in sorted((q for q in rows if (q.sid, q.draw) == (n, draw)), key=lambda q: q.i)])
            assert np.allclose(np.abs(np.fft.rfft(y)), np.abs(np.fft.rfft(x))) and (n > 3) == (not np.allclose(x, y))


def test_refusals(spark):
    s = spark.createDataFrame([(1, i, float(i % 3)) for i in range(12)] + [(2, 0, 1.0)] + [(3, i, 5.0) for i in range(12)], "sid long, i long, v double")
    for kind, ask in (("undeclared", {"draws": 1, "window": 3}), ("undeclared", {"draws": 4, "window": 1}), ("unknown_spec", {"draws": 4, "window": 3, "statistic": "none"}), ("unknown_spec", {"draws": 4, "window": 3, "perturbation": "none"})):
        with pytest.raises(nulls.Refused) as e:
            nulls.ground(s, **ask)
        assert e.value.kind == kind
    gaps = {r.sid: r.gap for r in nulls.typed_difference(s, S.burstiness(s, 3), nulls.ground(s, 8, 3), 8).collect()}
    assert gaps[2] == "unknown_spec" and gaps[3] == "degenerate_ground"
    assert nulls.licensed("irreversibility", "phase") and not nulls.licensed("burstiness", "phase")


def test_repeats_and_content_words_are_of_the_text(spark):
    docs = spark.createDataFrame([(1, "a a"), (2, "b"), (3, " ".join(["the"] * 2 + [f"w{i}" for i in range(398)])), (4, "x y x x")], "doc_id long, text string")
    t = T.tokens(docs)
    got = {r.doc: r for r in T.sequence_baselines(t).collect()}
    assert got[1].repeats == 1.0 and got[2].repeats is None and abs(got[4].repeats - 1 / 3) < 1e-12
    assert {r.doc: r.repeats for r in T.sequence_baselines(t, 2).collect()}[4] == 0.5
    content = {r.doc: (r.n, r.content) for r in T.content_words(t).collect()}
    assert content == {1: (2, 0), 2: (1, 0), 3: (400, 400), 4: (4, 0)}
    many = T.content_words(T.tokens(spark.createDataFrame([(1, " ".join(["the"] * 4 + [f"w{i}" for i in range(396)]))], "doc_id long, text string"))).first()
    assert (many.n, many.content) == (400, 396)


def test_content_words_count_function_words_of_all_texts(spark):
    t = T.tokens(spark.createDataFrame([(1, " ".join(["the"] * 40 + [f"w{i}" for i in range(360)])), (2, "the cat the"), (3, "the"), (4, None), (5, "--")], "doc_id long, text string"))
    got = {r.doc: (r.n, r.content, r.content_of_all) for r in T.content_words(t).collect()}
    assert got == {1: (400, 360, 360), 2: (3, 0, 1), 3: (1, 0, 0)}
    given = T.content_words(t, spark.createDataFrame([("cat",)], "form string"))
    assert {r.doc: r.content_of_all for r in given.collect()} == {1: 400, 2: 2, 3: 1}


def test_content_words_of_the_query_cover_all_texts(spark, sf_dir):
    from groundwork.plans import QUERIES

    sums = QUERIES["content_words"](spark, sf_dir).agg(F.sum("n"), F.sum("content_of_all")).first()
    t = T.tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    total, function = t.count(), T.function_words(t).agg(F.sum("n")).first()[0]
    assert sums[0] == total and sums[1] == total - function
