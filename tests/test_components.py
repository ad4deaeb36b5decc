"""Components against a plain version, and how much work they take at many partitions."""

import random
import uuid

import pytest
from groundwork.llm import jaccard
from groundwork.operators.components import components
from pyspark.sql import functions as F


def _plainly(links):
    least = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in least:
        before = dict(least)
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    return least


@pytest.fixture()
def partitions(spark):
    """As many shuffle partitions as on a large table, not coalesced."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield int(held["spark.sql.shuffle.partitions"])
    for k, v in before.items():
        spark.conf.set(k, v)


def _worked(spark, run):
    """What run returns, and its numbers of jobs and of tasks."""
    spark.sparkContext.setJobGroup(name := uuid.uuid4().hex, "")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(name)]
    return out, len(jobs), sum(info.numCompletedTasks for j in jobs for s in j.stageIds if (info := tracker.getStageInfo(s)))


def test_components_equal_a_plain_version(spark):
    draw = random.Random(5)
    path = [(i, i + 1) for i in range(40)]
    draw.shuffle(path)
    some = [(draw.randrange(100, 160), draw.randrange(100, 160)) for _ in range(40)]
    links = [*path, *some, *some[:9], *((500, 501 + i) for i in range(9)), *((620 + i, 600) for i in range(9)), (700, 700)]
    got = components(spark.createDataFrame([(*x,) for x in links] + [(None, 3), (800, None)], "a long, b long")).collect()
    assert dict(got) == _plainly(links) and len(got) == len(_plainly(links))
    named = components(spark.createDataFrame([(str(a), str(b)) for a, b in some], "a string, b string")).collect()
    assert dict(named) == _plainly([(str(a), str(b)) for a, b in some])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_one_round(spark, partitions):
    links = spark.range(60).select((F.col("id") + 100).alias("a"), (F.col("id") % 7).alias("b"))
    got, _, tasks = _worked(spark, lambda: components(links).collect())
    assert len(got) == 67 and all(r.component == (r.node - 100) % 7 for r in got if r.node >= 100)
    assert tasks <= 10 * partitions  # with all rows computed twice and a round more to see that nothing changes, it took 406


def test_frequency_levels_take_no_job_a_partition(spark, partitions):
    docs = spark.createDataFrame([(f"one two three four five {i % 3}",) for i in range(30)], "t string")
    levels, jobs, _ = _worked(spark, lambda: jaccard.frequency_levels(docs))
    assert len(levels) == jaccard.COUNTERS and sorted(levels[levels > 0].tolist()) == [6, 6, 6, 9] and jobs < partitions
