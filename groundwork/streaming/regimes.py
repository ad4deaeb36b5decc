"""The regime tracker over a stream: state of a series is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundwork.operators.regimes import BATCH, Tracker


def track(stream: DataFrame, reach: float = 2.5, warmup: int = 8, forget_ms: int | None = None) -> DataFrame:
    """sid, i, v, regime, fresh for a stream of sid, i, v.

    Rows of a micro-batch are taken by i. A row whose i isn't over all of earlier micro-batches is too late and gets no row, so what is read is a batch's reading
    of the rows that came in time. The state of a series that brings nothing for forget_ms is dropped, if given; the series then begins anew.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *held, last = state.get if state.exists else (None,)
        t = Tracker(*held)
        rows = pd.concat(list(batches)).sort_values("i", kind="stable")
        rows = rows if last is None else rows[rows["i"] > last]
        said = [t.step(v, reach, warmup) for v in rows["v"]]
        state.update((t.regime, t.n, t.mean, t.squares, last if rows.empty else int(rows["i"].iloc[-1])))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield rows.assign(regime=[r for r, _ in said], fresh=[f for _, f in said])[["sid", "i", "v", "regime", "fresh"]]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("sid").applyInPandasWithState(run, BATCH, "regime long, n long, mean double, squares double, last long", "append", timeout)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, slide: str, late: str) -> DataFrame:
    """Counts and sums of v by sliding event-time windows; rows later than the watermark are dropped."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), by).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
