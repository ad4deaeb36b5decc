"""Nulls of placed arrivals and communities against plain versions."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from groundwork.operators import binding as B
from groundwork.operators import graph as G


def _plain_communities(nodes, edges, limit):
    beside = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            beside.setdefault(x, {})
            beside[x][y] = beside[x].get(y, 0) + w
    labels, quiet = {n: n for n in nodes}, 0
    for turn in range(limit):
        new = dict(labels)
        for n, near in beside.items():
            if n in labels and (zlib.crc32(str(n).encode()) + turn) % 2 == 0:
                count = {}
                for other, w in near.items():
                    count[labels[other]] = count.get(labels[other], 0) + w
                new[n] = min(count, key=lambda x: (-count[x], x))
        quiet = quiet + 1 if new == labels else 0
        labels = new
        if quiet == 2:
            break
    return labels


@pytest.mark.parametrize("seed", range(3))
def test_communities_of_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [(f"n{r.randrange(38):02}", f"n{r.randrange(38):02}", r.randint(1, 3)) for _ in range(60)]  # loops, repeats, two nodes alone
    df = spark.createDataFrame(edges, "a string, b string, weight long")
    for limit in (1, 30):
        got = B.communities(spark.createDataFrame([(n,) for n in nodes], "node string"), df, limit).collect()
        assert {x.node: x.label for x in got} == _plain_communities(nodes, edges, limit)


def test_two_cliques_are_two_communities(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1) for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 1)]
    df = spark.createDataFrame(edges, "a string, b string, weight long")
    got = {x.node: x.label for x in B.communities(df.select(F.explode(F.array("a", "b")).alias("node")), df, 30).collect()}
    assert len(set(got.values())) == 2 and {n[0] + got[n][0] for n in got} == {"aa", "bb"}
    assert B.communities(df.filter("false").select(F.col("a").alias("node")), df.filter("false"), 5).count() == 0


def _arrivals(spark, rows):
    return spark.createDataFrame(rows, "seq long, id string, pos long")


def test_bound_and_unbound_pairs(spark):
    r = random.Random(5)
    a = sorted(r.sample(range(0, 400, 2), 30))
    rows = [(1, "a", p) for p in a] + [(1, "b", p + 1) for p in a] + [(1, "c", p) for p in sorted(r.sample(range(400), 30))]
    arrivals = _arrivals(spark, rows)
    pairs = B.met_pairs(arrivals, 1)
    met = {(x.a, x.b): x for x in pairs.collect()}
    where = {i: [p for _, j, p in rows if i == j] for i in "abc"}
    for (x, y), row in met.items():
        assert row.overlap == sum(abs(p - q) <= 1 for p in where[x] for q in where[y]) and (row.na, row.nb) == (30, 30)
    length = spark.createDataFrame([(1, 420)], "seq long, n long")
    p = {(x.a, x.b): x.p_met for x in B.displacement_null(arrivals, pairs, 1, 60, 3).collect()}
    assert p["a", "b"] == 0.0 and p["a", "c"] > 0.05
    assert {(x.a, x.b): x.p_reseed for x in B.reseed_null(arrivals, pairs, length, 60, 3).collect()}["a", "b"] == 0.0
    way = {(x.a, x.b): x for x in B.reversal_null(arrivals, pairs, length, 60, 3).collect()}
    assert way["a", "b"].direction == "a to b" and way["a", "b"].p_direction == 0.0


def _transfer(x, y):
    n, out = len(x) - 1, 0.0
    for a in (0, 1):
        for b in (0, 1):
            here = [t for t in range(n) if (x[t], y[t]) == (a, b)]
            hit, all_b = sum(y[t + 1] for t in here), [t for t in range(n) if y[t] == b]
            if hit:
                out += hit / n * math.log2(hit / len(here) / (sum(y[t + 1] for t in all_b) / len(all_b)))
    return out


def test_asymmetry_is_of_both_transfers(spark):
    r = random.Random(9)
    series = [[(r.random() < 0.3, r.random() < 0.4) for _ in range(50)] for _ in range(8)]
    rows = [(k, t, int(x), int(y)) for k, s in enumerate(series) for t, (x, y) in enumerate(s)]
    got = B.asymmetry(spark.createDataFrame(rows, "k int, place int, x int, y int"), ["k"]).collect()
    for row in got:
        x, y = [int(v[0]) for v in series[row.k]], [int(v[1]) for v in series[row.k]]
        assert row.fwd == pytest.approx(_transfer(x, y), abs=1e-9) and row.rev == pytest.approx(_transfer(y, x), abs=1e-9)
        assert row.s == pytest.approx(row.fwd - row.rev, abs=1e-9)


def test_chains_bind_what_is_not_bound_yet(spark):
    rows = [("a", "x", "b", 3.0), ("b", "x", "c", 2.0), ("b", "y", "d", 1.0), ("b", "x", "a", 1.0), ("c", "x", "c", 9.0), ("a", "x", "e", 1.0), ("e", "x", "c", 5.0), ("e", "x", "b", 4.0), ("a", "x", "b", 1.0)]
    got = {tuple(x) for x in G.compose_edges(spark.createDataFrame(rows, "subject string, verb string, object string, weight double")).collect()}
    assert got == {("a", "x", "c", "b", 2.0), ("a", "x", "c", "e", 1.0), ("e", "x", "a", "b", 1.0), ("b", "x", "e", "a", 1.0)}


def _no_rows_of_draws(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Generate" not in plan and "row_number" not in plan


def test_reversal_has_no_rows_for_draws(spark):
    arrivals = _arrivals(spark, [(1, "a", 0), (1, "b", 1), (1, "a", 2), (2, "a", 0), (2, "b", 0)])
    length = spark.createDataFrame([(1, 4), (2, 1)], "seq long, n long")
    out = B.reversal_null(arrivals, B.met_pairs(arrivals, 1), length, 9, 3)
    assert _no_rows_of_draws(out) and [(x.seq, x.a, x.b, x.overlap) for x in out.collect()] == [(1, "a", "b", 2)]  # a single place has no next one


def test_reseed_has_no_rows_for_draws(spark):
    arrivals = _arrivals(spark, [(1, "a", 0), (1, "b", 2), (2, "a", 0), (2, "b", 1)])
    length = spark.createDataFrame([(1, 2), (2, 2)], "seq long, n long")
    out = B.reseed_null(arrivals, B.met_pairs(arrivals, 2), length, 9, 3)
    assert _no_rows_of_draws(out) and {(x.seq, x.near1, x.p_reseed) for x in out.collect()} == {(1, 0, 1.0), (2, 1, 1.0)}


def test_displacement_has_no_rows_for_draws(spark):
    arrivals = _arrivals(spark, [(1, "a", 0), (1, "b", 1), (1, "a", 1), (2, "a", 0), (2, "b", 3)])
    out = B.displacement_null(arrivals, B.met_pairs(arrivals, 3), 3, 9, 3)
    assert _no_rows_of_draws(out) and {(x.seq, x.p_met) for x in out.collect()} == {(1, 0.0), (2, 1.0)}  # without a free place nothing is drawn
