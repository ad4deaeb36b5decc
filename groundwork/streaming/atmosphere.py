"""The regime tracker with a ground, over a stream: a series' state is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundwork.operators.atmosphere import TRACKED, Atmosphere, Spec, _said

_STATE = "start long, held array<double>, ground array<double>, clearings int, below array<boolean>, since int, last long"


def track(stream: DataFrame, spec: Spec) -> DataFrame:
    """sid, i, v, start, placement, volume, slack for a stream of sid, i, v.

    Rows of a micro-batch are taken by i; a row whose i isn't over all of earlier micro-batches is too late and gets no row. The ground of
    the present regime is built anew from the values in the state, with the same draws as in batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, last = Atmosphere(), None
        if state.exists:
            start, held, ground, clearings, below, since, last = state.get
            t = Atmosphere(start, list(held), tuple(ground) if len(ground) else None, clearings, list(below), since)
        rows = pd.concat(list(batches)).sort_values("i", kind="stable")
        rows = rows if last is None else rows[rows["i"] > last]
        said = [t.push(float(v), spec) for v in rows["v"]]
        state.update((t.start, t.held, list(t.ground or ()), t.clearings, t.below, t.since, last if rows.empty else int(rows["i"].iloc[-1])))
        yield _said(rows, said)

    return stream.groupBy("sid").applyInPandasWithState(run, TRACKED, _STATE, "append", GroupStateTimeout.NoTimeout)
