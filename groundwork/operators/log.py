"""Append-only logs (tick, type, task, value): as-of reads, lenses, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(log: DataFrame, cursor: int) -> DataFrame:
    """What the log held before the cursor."""
    return log.filter(F.col("tick") < cursor)


def as_of_each(log: DataFrame, mark: str) -> DataFrame:
    """What the log held of each task before the task's last entry of the type `mark`; tasks without one have nothing."""
    last = log.filter(F.col("type") == mark).groupBy("task").agg(F.max("tick").alias("cursor"))
    return log.join(last, "task").filter("tick < cursor").select(log.columns)


def cursor_at(log: DataFrame, parts: int, of: int) -> int:
    """The tick at parts / of of the span of the log's ticks; 0 of an empty log."""
    first, last = log.agg(F.min("tick"), F.max("tick")).first()
    return 0 if first is None else first + (last - first) * parts // of


def lens(log: DataFrame, reads: list[str], cursor: int) -> DataFrame:
    """The types that a lens reads, as of a cursor."""
    return as_of(log, cursor).filter(F.col("type").isin(reads))


def discarded_types(log: DataFrame, reads: list[str], cursor: int) -> DataFrame:
    """type, n: what a lens leaves out."""
    return as_of(log, cursor).filter(~F.col("type").isin(reads)).groupBy("type").agg(F.count("*").alias("n"))


def project_tasks(log: DataFrame) -> DataFrame:
    """task, last_type, last_value (the last that isn't null), first_tick, evidence (distinct types)."""
    return log.groupBy("task").agg(
        F.max_by("type", "tick").alias("last_type"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("tick"))).alias("last_value"),
        F.min("tick").alias("first_tick"), F.count_distinct("type").alias("evidence"), F.count("*").alias("entries"),
    )


def working_set(tasks: DataFrame, k: int = 7) -> DataFrame:
    """The k tasks with the most entries; the first in the log decides ties."""
    return tasks.orderBy(F.desc("entries"), "first_tick").limit(k)


def latest_before(log: DataFrame, kind: str) -> DataFrame:
    """task, tick, prior: the tick of the last entry of a type before each entry of the same task."""
    before = Window.partitionBy("task").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    return log.select("task", "tick", F.last(F.when(F.col("type") == kind, F.col("tick")), ignorenulls=True).over(before).alias("prior"))
