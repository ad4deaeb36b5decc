"""Grounds kept and conceded: planted regimes, a plain reader, stream against batch, and the null of runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.functions.rng import uniform, uniform_values
from groundwork.operators import atmosphere as A
from groundwork.operators import forecasts as F_
from groundwork.streaming.atmosphere import track as stream_track


def _planted(seed, levels=(0, 20, 45), n=60):
    r = random.Random(seed)
    return [level + r.random() * 4 for level in levels for _ in range(n)]


def _plain(values, spec):
    """The same reading by lists and loops, from the whole past at each place."""
    start, ground, clearings, out = 0, None, 0, []
    for t in range(1, len(values) + 1):
        w = spec.window
        if t >= w:
            own = values[start : t - w]
            if len(own) >= 10 * w:
                samples = []
                for d in range(spec.draws):
                    u = [float(uniform_values(np.array(d + spec.seed + start), np.array(k))) for k in range(len(own))]
                    row = [own[k] for k in sorted(range(len(own)), key=lambda k: (u[k], k))]
                    means = [sum(row[k : k + w]) / w for k in range(len(row) - w + 1)]
                    samples.append(round(max(means) if spec.statistic == "burstiness" else means[0], 9))
                if min(samples) < max(samples):
                    ground = (min(samples), max(samples))
        if t < w or ground is None:
            out.append((start, "no_ground"))
            continue
        mean = round(sum(values[t - w : t]) / w, 9)
        if mean > ground[1] or (spec.statistic == "window_mean" and mean < ground[0]):
            clearings += 1
            if clearings >= spec.tolerance:
                start, ground, clearings = t - w, None, 0
                out.append((start, "other"))
            else:
                out.append((start, "strained"))
        else:
            clearings = 0
            out.append((start, "placed"))
    return out


@pytest.mark.parametrize("statistic", A.STATISTICS)
def test_tracker_against_a_plain_reader(spark, statistic):
    spec = A.Spec(window=3, draws=9, tolerance=2, statistic=statistic, seed=4)
    series = {k: _planted(k, (0, 20, 3), 45) for k in range(3)} | {3: [1.0] * 50, 4: [1.0], 5: [float(i % 7) for i in range(80)]}
    rows = [(sid, i, v) for sid, s in series.items() for i, v in enumerate(s)]
    got = {}
    for x in A.track(spark.createDataFrame(rows, "sid long, i long, v double").repartition(3), spec).orderBy("sid", "i").collect():
        got.setdefault(x.sid, []).append((x.start, x.placement))
    assert got == {sid: _plain(s, spec) for sid, s in series.items()}
    assert {p for x in got.values() for _, p in x} >= {"placed", "strained", "other", "no_ground"}


def test_planted_regimes_are_found_in_place(spark):
    spec = A.Spec(window=3, draws=32, tolerance=3)
    rows = [(1, i, v) for i, v in enumerate(_planted(2))]
    df = spark.createDataFrame(rows, "sid long, i long, v double")
    starts = [x.start for x in A.track(df, spec).filter("placement = 'other'").orderBy("i").collect()]
    assert len(starts) == 2 and all(abs(s - at) <= 3 for s, at in zip(starts, (60, 120), strict=True))
    regions = A.read(df, spec).orderBy("start").collect()
    assert [(r.start, r.end) for r in regions][0][0] == 0 and regions[-1].end == 180 and len(regions) == 3
    assert all(abs(r.start - at) <= 3 for r, at in zip(regions, (0, 60, 120), strict=True))
    assert all(r.opened is not None and r.tended > 0 for r in regions)
    noise = [(1, i, random.Random(i).random()) for i in range(150)]
    assert A.track(spark.createDataFrame(noise, "sid long, i long, v double"), spec).filter("placement = 'other'").count() == 0
    assert A.track(df.filter("false"), spec).count() == 0 and A.read(df.filter("false"), spec).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    spec = A.Spec(window=2, draws=9, tolerance=2, statistic="window_mean", regularity=True, reseeds=20, seed=1)
    rows = [(sid, i, v) for sid in (1, 2) for i, v in enumerate(_planted(sid, (20, 26, 10), 40))]
    for cut in ((0, 50), (50, 51), (51, 120)):
        spark.createDataFrame([x for x in rows if cut[0] <= x[1] < cut[1]], "sid long, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("sid long, i long, v double").parquet(str(tmp_path / "in"))
        q = stream_track(stream, spec).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.select("sid", "i", "start", "placement", F.round("volume", 9), "slack").collect()), key=str)
    batch = A.track(spark.createDataFrame(rows, "sid long, i long, v double"), spec)
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)
    assert batch.filter("slack is not null").count() > 0  # the fall below the ground is found, and nothing is conceded for it


def test_run_null_in_state_and_in_spark(spark):
    r = random.Random(6)
    flags = {sid: [r.random() < 0.4 for _ in range(30)] + [True] * (6 * (sid % 2)) for sid in range(6)}
    rows = [(sid, i, 0.0 if f else 1.0) for sid, s in flags.items() for i, f in enumerate(s)]
    got = {x.sid: x for x in A.slack_null(spark.createDataFrame(rows, "sid long, i long, v double"), 0.5, 40, 3).collect()}
    for sid, s in flags.items():
        assert got[sid].threshold == A.slack_limit(np.array(s), 40, 3)
        assert got[sid].run == max(len(x) for x in "".join("x" if f else " " for f in s).split(" "))


def test_trends_and_bursts(spark):
    r = random.Random(8)
    series = {1: [i + r.random() for i in range(80)], 2: [r.random() for _ in range(80)], 3: [r.random() + (5 if 30 < i < 45 else 0) for i in range(80)], 4: [1.0] * 5}
    rows = [(sid, i, v) for sid, s in series.items() for i, v in enumerate(s)]
    got = {x.sid: x.gap for x in A.stationarity(spark.createDataFrame(rows, "sid long, i long, v double"), 40, 1).collect()}
    assert got == {1: "trending_material", 2: None, 3: None}


def test_both_generators_agree(spark):
    got = spark.range(50).select(uniform(F.col("id") * 7919 + 3, F.col("id") % 11).alias("u")).collect()
    k = np.arange(50)
    assert [x.u for x in got] == uniform_values(k * 7919 + 3, k % 11).tolist()


def test_declared_and_nothing_else():
    for bad in ({"window": 1}, {"draws": 1}, {"tolerance": 0}, {"statistic": "mean"}, {"regularity": True}):
        with pytest.raises(ValueError):
            A.Spec(**{"window": 2, "draws": 2, "tolerance": 1} | bad)


def test_forecasts_see_the_past_alone(spark):
    spec = A.Spec(window=2, draws=9, tolerance=2)
    series = {1: _planted(1, (0, 20), 40), 2: [5.0] * 6, 3: [1.0]}
    tracked = A.track(spark.createDataFrame([(sid, i, v) for sid, s in series.items() for i, v in enumerate(s)], "sid long, i long, v double"), spec)
    state = {(x.sid, x.i): x for x in tracked.collect()}
    got = {(x.sid, x.i, x.name): x for x in F_.regime_forecasts(tracked).collect()}
    assert len(got) == 2 * sum(len(s) - 1 for s in series.values())
    for (sid, i, name), x in got.items():
        s, own = series[sid][:i], series[sid][state[sid, i - 1].start : i]
        mean, values = (np.mean(own), own) if len(own) >= 2 else (s[-1], np.diff(s))
        sd = np.std(values, ddof=1) if len(values) > 1 else None
        widths = [state[sid, k].volume for k in range(i) if state[sid, k].volume is not None]
        if name == "regime_aperture" and sd is not None and state[sid, i - 1].volume and np.mean(widths) > 0:
            sd *= state[sid, i - 1].volume / np.mean(widths)
        assert x.mean == pytest.approx(mean, abs=1e-9) and (x.sd is None) == (sd is None) and (sd is None or x.sd == pytest.approx(sd, abs=1e-6))
    assert got[1, 60, "regime_mean"].mean > 15  # the fall of the old regime left no trace
