"""Series operators against plain versions in Python."""

import math

import numpy as np
import pytest

from groundwork.functions.rng import uniform
from groundwork.operators import nulls
from groundwork.operators import series as S


def _uniform(seed, k):
    m = (1 << 32) - 1
    t = (seed + (k + 2) * 0x6D2B79F5) & m
    t = ((t ^ (t >> 15)) * (t | 1)) & m
    t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & m)) & m
    return (t ^ (t >> 14)) / 2**32


def test_uniform(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s, k) for s in (0, 7, 2**31) for k in range(40)], "s long, k long").withColumn("u", uniform(F.col("s"), F.col("k"))).collect()
    assert all(r.u == _uniform(r.s, r.k) for r in rows)


@pytest.fixture(scope="module")
def material():
    r = np.random.default_rng(5)
    n = 80
    return {1: r.normal(size=n), 2: np.sin(np.arange(n) / 5) + r.normal(size=n) * 1e-3, 3: (np.arange(n) % 9) ** 2 + r.normal(size=n) * 1e-3, 4: np.array([1.0, 2.0])}


@pytest.fixture(scope="module")
def frame(spark, material):
    return spark.createDataFrame([(k, i, float(v)) for k, x in material.items() for i, v in enumerate(x)], "sid long, i long, v double")


def _patterns(x, w):
    out = {}
    for a in range(len(x) - w + 1):
        key = "".join(str(j) for _, j in sorted((x[a + j], j) for j in range(w)))
        out[key] = out.get(key, 0) + 1
    return out


def test_statistics(frame, material):
    burst = {r.sid: r.stat for r in S.burstiness(frame, 4).collect()}
    entropy = {r.sid: r.stat for r in S.permutation_entropy(frame, 3).collect()}
    for k in (1, 2, 3):
        x = material[k]
        assert math.isclose(burst[k], max(np.mean(x[a : a + 4]) for a in range(len(x) - 3)))
        p = np.array(list(_patterns(x, 3).values())) / (len(x) - 2)
        assert math.isclose(entropy[k], -(p * np.log(p)).sum() / math.log(6), rel_tol=1e-9)
    assert 4 not in burst and 4 not in entropy


def test_grounds_keep_the_material_and_the_draws(frame, material):
    drawn = nulls.shuffled(frame, 3, 11).filter("sid = 1").collect()
    for draw in range(3):
        mine = sorted((r.i, r.v) for r in drawn if r.draw == draw)
        order = sorted(range(80), key=lambda i: (_uniform(11 + draw, i), i))
        assert [v for _, v in mine] == [float(material[1][i]) for i in order]
    with pytest.raises(ValueError):
        nulls.ground(frame, 1, 4)


def test_temporality(frame):
    got = {r.sid: r.temporality for r in nulls.temporality(frame, 24, 3).collect()}
    assert got[1] in ("exchangeable", "unstable") and got[2] == "reversible" and got[3] == "arrowed" and 4 not in got
