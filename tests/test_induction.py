"""Kinds: planted ones, margins of traded fields, exact ranks, and clusters against best-pair-first merging."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from groundwork.functions.store import written
from groundwork.operators import induction as I
from groundwork.operators import kinds as K

DDL = "id string, fields array<string>"


def _jaccard(p, q):
    return len(p & q) / len(p | q)


def _mean(sets):
    pairs = list(itertools.combinations(sets, 2))
    return sum(_jaccard(p, q) for p, q in pairs) / len(pairs)


def _best_first(profiles, threshold):
    """Average linkage, the best pair first."""
    clusters = [[x] for x in profiles]
    while len(clusters) > 1:
        mean = lambda a, b: sum(_jaccard(profiles[x], profiles[y]) for x in a for y in b) / (len(a) * len(b))
        best = max(itertools.combinations(clusters, 2), key=lambda p: mean(*p))
        if mean(*best) < threshold:
            break
        clusters = [c for c in clusters if c not in best] + [best[0] + best[1]]
    return {frozenset(c) for c in clusters}


def _planted(overlap, seed=7):
    r = random.Random(seed)
    return [(f"k{k}m{m}", sorted({f"core{k}_{x}" for x in range(4) if x < 3 or r.random() < overlap} | set(r.sample([f"own{k}_{x}" for x in range(4)], 2)))) for k in range(4) for m in range(8)]


def test_planted_kinds_come_back(spark):
    rows = _planted(1.0)
    kinds, members = I.induce_kinds(spark.createDataFrame(rows, DDL).withColumn("kind", F.lit("clash")), 0.03, 3, 99, 0.95, 6, 42)
    kinds = {k.kind: k for k in kinds.collect()}
    assert sorted(kinds) == ["k0m0", "k1m0", "k2m0", "k3m0"]
    labels = members.select(F.col("kind").alias("a"), F.substring("id", 1, 2).alias("b"))
    assert labels.count() == 32 and K.adjusted_rand(labels).first().ari == 1.0
    sets = {i: set(f) for i, f in rows}
    for name, k in kinds.items():
        own = [v for i, v in sets.items() if i[:2] == name[:2]]
        assert k.size == 8 and k.height == "above" and k.core_share == 1.0 and abs(k.cohesion - _mean(own)) < 1e-9
        assert k.existence_p <= 0.05 and k.search_p <= 0.05 / 4 and k.ground == "key"


def test_noise_has_no_kinds_and_small_populations_none(spark):
    r = random.Random(3)
    noise = [(f"n{i}", r.sample([f"f{x}" for x in range(12)], 4)) for i in range(40)]
    assert I.induce_kinds(spark.createDataFrame(noise, DDL), 0.05, 3, 60, 0.95, 6, 42)[0].count() == 0
    few = [("a", ["x"]), ("b", ["x"]), ("c", None), ("d", [])]
    assert I.induce_kinds(spark.createDataFrame(few, DDL), 0.2, 2, 20, 0.95, 2, 1)[0].count() == 0
    assert I.induce_kinds(spark.createDataFrame([], DDL), 0.2, 2, 20, 0.95, 2, 1)[0].count() == 0


def test_one_field_each_rests_on_existence_alone(spark):
    rows = [(f"a{i}", ["anchor"]) for i in range(8)] + [(f"s{i}", ["subject", None]) for i in range(6)] + [("friend", [])]
    kinds, members = I.induce_kinds(spark.createDataFrame(rows, DDL), 0.25, 3, 150, 0.95, 4, 42)
    assert {(k.core, k.size, k.ground, k.search_p) for k in kinds.collect()} == {("anchor", 8, "eva-only", None), ("subject", 6, "eva-only", None)}
    assert members.filter("id = 'friend'").count() == 0


@pytest.mark.parametrize("group", [I.GROUP, 10])
def test_margins_stay_and_rows_mix(spark, monkeypatch, group):
    monkeypatch.setattr(I, "GROUP", group)
    r = random.Random(1)
    rows = [(f"r{i}", r.sample([f"f{x}" for x in range(15)], r.randint(0, 6))) for i in range(60)]
    profiles = spark.createDataFrame(rows, "id string, profile array<string>").withColumn("profile", F.sort_array("profile"))
    out = I.field_swaps(profiles, 20, 5).collect()
    degree, fields = {i: len(f) for i, f in rows}, sorted(x for _, f in rows for x in f)
    for turn in range(20):
        mine = [x for x in out if x.r == turn]
        assert {x.id: len(x.profile) for x in mine} == {i: n for i, n in degree.items() if n}
        assert all(len(set(x.profile)) == len(x.profile) for x in mine)
        assert sorted(f for x in mine for f in x.profile) == fields
        same = sum(set(x.profile) == set(dict(rows)[x.id]) for x in mine)
        assert same < len(mine) * 0.3  # mixed: few records keep their profile
    again = I.field_swaps(profiles.repartition(7), 20, 5).collect()
    assert sorted((x.r, x.id, tuple(x.profile)) for x in again) == sorted((x.r, x.id, tuple(x.profile)) for x in out)


def test_ranks_are_exact_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(I, "RANKED", 20)
    rows = spark.range(500).select("id", F.lit(0).alias("r"), (F.floor(I.chance(F.lit(3), F.col("id")) * 200) / 200).alias("u"))
    got = I.ranked(rows, ["r"], 500).collect()
    assert [x.id for x in sorted(got, key=lambda x: x["rank"])] == [x.id for x in sorted(got, key=lambda x: (x.u, x.id))]
    assert sorted(x["rank"] for x in got) == list(range(1, 501))


@pytest.mark.parametrize("here", [I.HERE, 0])
def test_clusters_against_best_pair_first(spark, monkeypatch, here):
    monkeypatch.setattr(I, "HERE", here)
    monkeypatch.setattr(I, "BLOCK", 3)
    r = random.Random(11)
    sets = {f"x{i:02}": frozenset(r.sample(range(300), r.randint(90, 190))) for i in range(12)}
    rows = [(0, i, sorted(f"f{x:03}" for x in s)) for i, s in sets.items()] + [(0, "x00copy", sorted(f"f{x:03}" for x in sets["x00"]))]
    every = spark.createDataFrame(rows, "r int, id string, profile array<string>")
    classes = written(I.classes_of(every), "classes")
    pairs = written(I.class_pairs(classes), "pairs")
    want = {(a, b): _jaccard(sets[a], sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    assert {(x.a, x.b): x.j for x in pairs.collect()} == pytest.approx(want)
    assert len(set(want.values())) == len(want)  # no ties
    out = I.agglomerate(classes, pairs, spark.createDataFrame([(0, 0.3)], "r int, threshold double"))
    got = {}
    for x in out.collect():
        got.setdefault(x.cluster, set()).add(x.name)
    assert len(got) < 12
    found = {frozenset(v) | ({"x00copy"} if "x00" in v else set()) for v in got.values()}
    assert found == _best_first({**sets, "x00copy": sets["x00"]}, 0.3)
    cohesion = {x.cluster: x for x in I.cluster_cohesion(classes, out, pairs).collect()}
    for name, v in got.items():
        own = [sets[i] for i in v] + ([sets["x00"]] if "x00" in v else [])
        assert cohesion[name].size == len(own) and (len(own) < 2 or abs(cohesion[name].cohesion - _mean(own)) < 1e-9)


def test_thresholds_are_quantiles_of_random_halves(spark):
    rows = [(-1, i, sorted(f)) for i, f in _planted(0.5)]
    every = spark.createDataFrame(rows, "r int, id string, profile array<string>")
    classes = I.classes_of(every)
    named = every.join(classes.select("r", "profile", "name"), ["r", "profile"]).select("r", "id", "name")
    u = {(x.id, x.draw): x.u for x in I._draws(named, 40, 9).collect()}
    sets = {i: set(f) for _, i, f in rows}
    means = sorted(_mean([sets[i] for i in sorted(sets, key=lambda i: (u[i, d], i))[:16]]) for d in range(40))
    at = 0.9 * 39
    want = means[int(at)] + (means[int(at) + 1] - means[int(at)]) * (at - int(at))
    assert abs(I.cohesion_thresholds(named, I.class_pairs(classes), 32, 40, 0.9, 9).first().threshold - want) < 1e-9


def test_placement_counts_samples_at_or_above(spark):
    r = random.Random(4)
    samples = [round(r.random(), 2) for _ in range(300)] + [1.0] * 5
    seen = [0.0, 0.5, 0.505, 0.99, 1.0]
    got = I.shared_placement(spark.createDataFrame([(x,) for x in seen], "x double"), spark.createDataFrame([(x,) for x in samples], "s double"))
    assert {x.x: x.p for x in got.collect()} == pytest.approx({x: sum(s >= x for s in samples) / 306 for x in seen})
    flat = spark.createDataFrame([(0.5,)] * 3, "s double")
    assert I.shared_placement(got.select("x"), flat).filter("p is not null").count() == 0
    assert I.shared_placement(got.select("x"), flat.filter("false")).filter("p is not null").count() == 0
