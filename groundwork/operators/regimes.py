"""Causal regimes of a series: a place that the present ground can't hold starts a new ground.

The same step runs over whole series in batch (one group a series, in order) and over a stream with the state kept
between batches. A regime's ground is the running mean and spread of its values; a value farther from the mean than
`reach` spreads, after `warmup` values, ends the regime.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = "sid long, i long, v double, regime long, fresh boolean"


@dataclass
class Tracker:
    """Welford sums of the present regime."""

    regime: int = 0
    n: int = 0
    mean: float = 0.0
    squares: float = 0.0

    def step(self, v: float, reach: float, warmup: int) -> tuple[int, bool]:
        spread = (self.squares / (self.n - 1)) ** 0.5 if self.n > 1 else 0.0
        fresh = self.n >= warmup and spread > 0 and abs(v - self.mean) > reach * spread
        if fresh:
            self.regime, self.n, self.mean, self.squares = self.regime + 1, 0, 0.0, 0.0
        self.n += 1
        d = v - self.mean
        self.mean += d / self.n
        self.squares += d * (v - self.mean)
        return self.regime, fresh


def regimes(s: DataFrame, reach: float = 2.5, warmup: int = 8) -> DataFrame:
    """sid, i, v, regime, fresh. A series goes through one task in order, in batches of its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, t = None, Tracker()
        for rows in batches:
            said = []
            for own, v in zip(rows["sid"], rows["v"], strict=True):
                if own != sid:
                    sid, t = own, Tracker()
                said.append(t.step(v, reach, warmup))
            yield rows.assign(regime=[r for r, _ in said], fresh=[f for _, f in said])

    ordered = s.select(F.col("sid").cast("long").alias("sid"), "i", "v").repartition("sid").sortWithinPartitions("sid", "i")
    return ordered.mapInPandas(run, BATCH)


def segments(tracked: DataFrame) -> DataFrame:
    """sid, regime, start, end, mean of each regime."""
    return tracked.groupBy("sid", "regime").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.avg("v").alias("mean"))
