"""Draws in blocks against draws as rows, and plans without a row for a draw's values."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork.operators import atmosphere, blocks, ladder, nulls


@pytest.fixture(scope="module")
def many(spark):
    r = np.random.default_rng(7)
    rows = [(k, i, float(v)) for k, n in enumerate([1, 2, 3, 4, 7, 8, 9, 9, 30, 31, 64]) for i, v in enumerate(r.integers(0, 5, n) if k % 2 else r.normal(size=n))]
    return spark.createDataFrame(rows, "sid int, i long, v double").cache()


def _rows_of_draws(df):
    return any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Generate", "explode", "FlatMapGroupsInPandas"))


def _same(s, statistic, perturbation, window):
    got = {(x.sid, x.draw): x.stat for x in nulls.ground(s, 5, window, perturbation, 3, statistic).collect()}
    want = {(x.sid, x.draw): x.stat for x in nulls.STATISTICS[statistic](nulls.PERTURBATIONS[perturbation](s, 5, 3), window, ["sid", "draw"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize(("statistic", "perturbation", "window"), [("burstiness", "shuffle", 4), ("max_deviation", "phase", 3), ("max_deviation", "resample", 3), ("window_mean", "resample", 3), ("permutation_entropy", "shuffle", 3), ("irreversibility", "phase", 3)])
def test_grounds_of_blocks_are_those_of_rows(many, statistic, perturbation, window):
    _same(many, statistic, perturbation, window)
    assert not _rows_of_draws(nulls.ground(many, 5, window, perturbation, 3, statistic))


def test_whole_groups_are_not_cut(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    sid = [0] * 3 + [1] * 30 + [None] * 2 + [4] * 9 + [5]
    batches = pa.table({"sid": pa.array(sid), "k": range(len(sid))}).to_batches(max_chunksize=4)
    seen = []
    for table, at in blocks.whole_groups(iter(batches), "sid"):
        assert at[0] == 0 and at[-1] == table.num_rows
        seen += [table["sid"].to_pylist()[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert seen == [[0] * 3, [1] * 30, [None] * 2, [4] * 9, [5]]


def test_verdicts_and_levels_read_a_series_once(many):
    for df in (nulls.full_verdict(many, 4, 8, 2), nulls.level(many, 4, 8, 2)):
        assert not _rows_of_draws(df) and "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_stationarity_has_no_rows_of_draws(many):
    assert not _rows_of_draws(atmosphere.stationarity(many, 20, 5))
    assert {x.sid for x in atmosphere.stationarity(many, 20, 5).collect()} == {5, 6, 7, 8, 9, 10}


def test_scales_in_blocks_are_those_of_rows(many, monkeypatch):
    steps = lambda: sorted(map(tuple, ladder.cascade(many, [1, 2, 4], 3, 8, 2).collect()))
    assert not _rows_of_draws(ladder.cascade(many, [1, 2, 4], 3, 8, 2))
    got = steps()
    monkeypatch.setattr(blocks, "can", lambda *_: False)
    assert got == steps() and {x[6] for x in got} >= {"empty_material", None}


def test_ladders_have_no_rows_of_draws(many):
    out = ladder.ladders(ladder.cascade(many, [1, 2], 3, 8, 2))
    assert not _rows_of_draws(out) and out.count() == 11 and out.filter(F.col("laddered") + F.col("broken") > 1).isEmpty()


def test_innermost_has_no_rows_for_levels_and_keeps_points_without_an_interval(spark):
    from groundwork.operators import spans

    r = np.random.default_rng(2)
    held = [(g, k, int(lo), int(lo + n)) for g in (0, 1, None) for k, (lo, n) in enumerate(zip(r.integers(-20, 60, 30), r.integers(-2, 40, 30), strict=True))] + [(1, 99, -(10**12), 10**12)]
    asked = [(g, int(at)) for g in (0, 1, 2, None) for at in r.integers(-30, 90, 60)] + [(0, None), (0, None), (1, -(10**12)), (1, 10**12)]
    points, intervals = spark.createDataFrame(asked, "g int, at long"), spark.createDataFrame(held, "g int, id int, lo long, hi long")
    out = spans.innermost(points, intervals, ["g"])
    assert not _rows_of_draws(out) and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = [tuple(x) for x in out.collect()]
    best = lambda g, at: min(((hi - lo, -lo, k) for h, k, lo, hi in held if g is not None and at is not None and h == g and lo <= at < hi), default=(0, 0, None))[2]
    assert len(got) == len(set(asked)) and set(got) == {(g, at, best(g, at)) for g, at in asked}
