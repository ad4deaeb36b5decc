"""Regimes of a series by the ground that it stands on: a ground is kept while it holds what arrives, and conceded when it fails repeatedly.

The ground of a regime is the null of the library: `draws` shuffles of the regime's own values, of which the greatest mean of a window (burstiness), or the mean of
the first (window_mean), is a sample. Each value is read in order, so a series is one task's; its state is the values of the present regime and a few numbers. The
same step runs in batch and over a stream (groundwork.streaming.atmosphere).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.rng import uniform, uniform_values
from groundwork.operators import blocks

#: Windows of material below which a ground is too narrow to be one; step between the seeds of two shuffles of a null.
FLOOR, STRIDE = 10, 7919
STATISTICS = ("burstiness", "window_mean")


@dataclass
class Spec:
    """What is declared of a reading: none of these has a default in the library, but the seed."""

    window: int
    draws: int
    tolerance: int
    statistic: str = "burstiness"
    regularity: bool = False
    reseeds: int = 0
    seed: int = 0

    def __post_init__(self) -> None:
        if self.window < 2 or self.draws < 2 or self.tolerance < 1 or (self.regularity and self.reseeds < 2):
            raise ValueError("undeclared: a window and draws of two at least, a tolerance of one, and reseeds of two to find regularity")
        if self.statistic not in STATISTICS:
            raise ValueError(f"unknown_spec: {self.statistic}")


def shuffles(values: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """The values in the order of their uniform numbers, a row a draw, the place deciding ties."""
    u = uniform_values(np.arange(draws)[:, None] + seed, np.arange(len(values))[None, :])
    return values[np.argsort(u, axis=1, kind="stable")]


def _window_sums(rows: np.ndarray, window: int) -> np.ndarray:
    sums = np.cumsum(rows, axis=1)
    return np.concatenate([sums[:, window - 1 : window], sums[:, window:] - sums[:, :-window]], axis=1)


def ground_of(values: np.ndarray, spec: Spec, start: int) -> tuple[float, float, float] | None:
    """low, high and volume (between the quartiles) of a ground over the values of a regime from `start`; None below FLOOR windows or without width."""
    if len(values) < FLOOR * spec.window:
        return None
    rows = shuffles(values, spec.draws, spec.seed + start)
    samples = _window_sums(rows, spec.window).max(axis=1) if spec.statistic == "burstiness" else rows[:, : spec.window].sum(axis=1)
    samples = np.sort(np.round(samples / spec.window, 9))
    if samples[0] == samples[-1]:
        return None
    a, b = np.quantile(samples, (0.25, 0.75))
    return float(samples[0]), float(samples[-1]), float(b - a)


def _longest(flags: np.ndarray) -> np.ndarray:
    """The longest run of true of each row."""
    run, best = np.zeros(len(flags), int), np.zeros(len(flags), int)
    for column in flags.T:
        run = np.where(column, run + 1, 0)
        best = np.maximum(best, run)
    return best


def slack_limit(flags: np.ndarray, reseeds: int, seed: int) -> int:
    """The length that 95 % of the shuffles' longest runs don't exceed."""
    u = uniform_values(np.arange(reseeds)[:, None] * STRIDE + seed, np.arange(len(flags))[None, :])
    runs = np.sort(_longest(np.asarray(flags, bool)[np.argsort(u, axis=1, kind="stable")]))
    return int(runs[int(reseeds * 0.95)])


@dataclass
class Atmosphere:
    """State of one series; held: the values since `start`, the first place of the present regime."""

    start: int = 0
    held: list[float] = field(default_factory=list)
    ground: tuple[float, float, float] | None = None
    clearings: int = 0
    below: list[bool] = field(default_factory=list)
    since: int = 0

    def push(self, v: float, spec: Spec) -> tuple[int, str, float | None, int | None]:
        """start, placement, volume of the ground, and the length of a run of slack where one is found.

        placement: no_ground, placed, strained (the value's window lies beyond the ground), or other: strained `tolerance` times in a row, so the ground
        is given up and the regime begins with that window. What counts is the mean of the last window against the ground of all before it.
        """
        self.held.append(v)
        w = spec.window
        if len(self.held) < w or (built := ground_of(np.array(self.held[:-w]), spec, self.start)) is None and self.ground is None:
            return self.start, "no_ground", None, None
        self.ground = low, high, volume = built or self.ground
        mean = round(sum(self.held[-w:]) / w, 9)
        # a window's mean lies below the greatest of many as a rule; of a single one both sides count, unless slack is looked for
        strained = mean > high or (mean < low and spec.statistic == "window_mean" and not spec.regularity)
        slack = self._slack(mean < low, spec) if spec.regularity else None
        if not strained:
            self.clearings = 0
            return self.start, "placed", volume, slack
        self.clearings += 1
        if self.clearings < spec.tolerance:
            return self.start, "strained", volume, slack
        self.start += len(self.held) - w
        self.held, self.ground, self.clearings, self.below, self.since = self.held[-w:], None, 0, [], 0
        return self.start, "other", None, slack

    def _slack(self, below: bool, spec: Spec) -> int | None:
        """Windows that share no value are looked at; a run of those below the ground counts if it is longer than shuffles of them give."""
        self.since += 1
        if self.since < spec.window:
            return None
        self.since = 0
        self.below.append(below)
        run = 0
        while run < len(self.below) and self.below[-1 - run]:
            run += 1
        if run < spec.tolerance or run <= slack_limit(np.array(self.below), spec.reseeds, spec.seed + self.start):
            return None
        self.below = []
        return run


TRACKED = "sid long, i long, v double, start long, placement string, volume double, slack int"


def _said(rows: pd.DataFrame, said: list[tuple]) -> pd.DataFrame:
    start, placement, volume, slack = (list(c) for c in zip(*said, strict=True)) if said else ([], [], [], [])
    return rows.assign(start=start, placement=placement, volume=pd.Series(volume, rows.index, "Float64"), slack=pd.Series(slack, rows.index, "Int32"))[["sid", "i", "v", "start", "placement", "volume", "slack"]]


def track(s: DataFrame, spec: Spec) -> DataFrame:
    """sid, i, v, start, placement, volume, slack: what each value finds, by what came before it alone. Places count the rows of a series in the order of i; values
    that are null or not finite must be left out before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, t = None, Atmosphere()
        for rows in batches:
            said = []
            for own, v in zip(rows["sid"], rows["v"], strict=True):
                if own != sid:
                    sid, t = own, Atmosphere()
                said.append(t.push(float(v), spec))
            yield _said(rows, said)

    return s.select(F.col("sid").cast("long").alias("sid"), "i", F.col("v").cast("double").alias("v")).repartition("sid").sortWithinPartitions("sid", "i").mapInPandas(run, TRACKED)


def read_series(values: np.ndarray, spec: Spec, hop: int = 1) -> list[tuple]:
    """start, end, tended, volume at its opening, at its close, opened (whether the ground widened, null where a volume is missing) of each regime of a whole series.

    Unlike a tracker it looks ahead: the window at i is held against the ground of [start, i)."""
    w, out = spec.window, []
    start, ground, opening, clearings, tended = 0, None, None, 0, 0

    def close(end: int, last: float | None) -> tuple:
        return start, end, tended, opening, last, None if opening is None or last is None else last > opening

    for i in range(w, len(values) - w + 1, hop):
        if ground is None:
            if (ground := ground_of(values[start:i], spec, start)) is None:
                continue
            opening = ground[2]
        if round(float(np.sum(values[i : i + w])) / w, 9) > ground[1]:
            clearings += 1
            if clearings >= spec.tolerance:
                out.append(close(i, ground[2]))
                start, ground, opening, clearings, tended = i, None, None, 0, 0
        else:
            clearings, tended = 0, tended + 1
            ground = ground_of(values[start:i], spec, start) or ground
    last = ground or ground_of(values[start:], spec, start)
    out.append(close(len(values), last and last[2]))
    return out


REGIONS = "sid long, start long, end long, tended long, volume_open double, volume_close double, opened boolean"


def read(s: DataFrame, spec: Spec, hop: int = 1) -> DataFrame:
    """The regimes of each series, as read_series has them."""

    def regions(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        found = [(int(rows["sid"].iloc[0]), *x) for x in read_series(rows["v"].to_numpy(), spec, hop)]
        return pd.DataFrame(found, columns=[x.split()[0] for x in REGIONS.split(", ")]).astype({"volume_open": "float64", "volume_close": "float64", "opened": "boolean"})

    return s.select(F.col("sid").cast("long").alias("sid"), "i", F.col("v").cast("double").alias("v")).groupBy("sid").applyInPandas(regions, REGIONS)


def _reordered(s: DataFrame, reseeds: int, seed: int) -> DataFrame:
    """sid, draw, i, v: the values in the order of their uniform numbers, STRIDE between two draws' seeds."""
    each = s.select("sid", "i", "v", F.explode(F.sequence(F.lit(0), F.lit(reseeds - 1))).alias("draw")).withColumn("u", uniform(F.col("draw") * STRIDE + seed, F.col("i")))
    return each.select("sid", "draw", (F.row_number().over(Window.partitionBy("sid", "draw").orderBy("u", "i")) - 1).cast("long").alias("i"), "v")


def _limit(samples: DataFrame, reseeds: int) -> DataFrame:
    """sid, threshold: the sample at 95 % of the way up."""
    at = F.row_number().over(Window.partitionBy("sid").orderBy("s"))
    return samples.withColumn("at", at).filter(F.col("at") == int(reseeds * 0.95) + 1).select("sid", F.col("s").alias("threshold"))


def slack_null(s: DataFrame, above: float, reseeds: int, seed: int = 0) -> DataFrame:
    """sid, run, threshold, found: the longest run of values under `above`, held against those of shuffles."""

    def longest(rows: DataFrame, by: list[str]) -> DataFrame:
        low = rows.filter(F.col("v") < above)
        runs = low.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy(*by).orderBy("i"))).groupBy(*by, "g").agg(F.count("*").alias("n"))
        every = rows.select(*by).distinct()
        return every.join(runs.groupBy(*by).agg(F.max("n").alias("s")), by, "left").select(*by, F.coalesce("s", F.lit(0)).alias("s"))

    limit = _limit(longest(_reordered(s, reseeds, seed), ["sid", "draw"]), reseeds)
    return longest(s, ["sid"]).withColumnRenamed("s", "run").join(limit, "sid").withColumn("found", F.col("run") > F.col("threshold"))


def stationarity(s: DataFrame, reseeds: int, seed: int = 0) -> DataFrame:
    """sid, n, observed, threshold, gap of series with 8 values at least: how far the means of the first and last quarter lie apart, and what shuffles give; gap is trending_material beyond it."""
    at = int(reseeds * 0.95)

    def apart(b: blocks.Block, v: np.ndarray) -> np.ndarray:
        q = np.maximum(2, b.sizes // 4)
        side = lambda own: np.add.reduceat(np.where(own, v, 0.0), b.starts) / q
        place = np.arange(len(v)) - b.first
        return np.abs(side(place >= np.repeat(b.sizes - q, b.sizes)) - side(place < np.repeat(q, b.sizes)))

    def limits(b: blocks.Block) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        of = np.flatnonzero(b.sizes >= 8)
        samples = np.stack([apart(b, blocks.shuffled(b, seed + k * STRIDE))[of] for k in range(reseeds)])
        return of, {"n": b.sizes[of], "s": apart(b, b.v)[of], "limit": np.sort(samples, axis=0)[at]}

    out = blocks.each_block(s, limits, "n long, s double, limit double").select("sid", "n", F.round("s", 9).alias("observed"), F.round("limit", 9).alias("threshold"))
    return out.withColumn("gap", F.when(F.col("observed") > F.col("threshold"), "trending_material"))
