"""Null distributions by perturbing the material itself, and placing observations in them.

A ground has sid, draw, stat. The draws of a ground are made in the memory of the task that reads the series (`blocks`); `shuffled`, `resampled` and `phased` give the
same draws as rows, by joins and windows partitioned by series and draw.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.rng import uniform
from groundwork.operators import blocks
from groundwork.operators.series import burstiness, irreversibility, max_deviation, permutation_entropy, window_mean

#: Shares of samples at or over an observation that make a verdict contested.
LOW, HIGH = 0.1, 0.9


def _draws(s: DataFrame, draws: int, seed: int | Column) -> DataFrame:
    if draws < 2:
        raise Refused("undeclared", "two draws at least")
    each = s.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    return each.withColumn("u", uniform(F.col("draw") + seed, F.col("i")))


def resampled(s: DataFrame, draws: int, seed: int | Column = 0) -> DataFrame:
    """sid, draw, i, v: each series drawn from itself with replacement."""
    n = s.groupBy("sid").agg(F.count("*").alias("n"))
    picks = _draws(s.select("sid", "i"), draws, seed).join(n, "sid").select("sid", "draw", F.col("i").alias("to"), F.floor(F.col("u") * F.col("n")).alias("i"))
    return picks.join(s, ["sid", "i"]).select("sid", "draw", F.col("to").alias("i"), "v")


def shuffled(s: DataFrame, draws: int, seed: int | Column = 0) -> DataFrame:
    """sid, draw, i, v: each series in the order of its uniform numbers, the place deciding ties."""
    w = Window.partitionBy("sid", "draw").orderBy("u", "i")
    drawn = _draws(s, draws, seed)
    return drawn.select("sid", "draw", (F.row_number().over(w) - 1).cast("long").alias("i"), "v")


def phased(s: DataFrame, draws: int, seed: int | Column = 0) -> DataFrame:
    """sid, draw, i, v: each series with the strength of every frequency kept and its phase drawn; series under four values stay as they are."""

    def turn(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("i")
        n, v = len(rows), rows["v"].to_numpy()
        if n >= 4:
            spectrum, free = np.fft.rfft(v), (n + 1) // 2  # the mean, and the highest frequency of an even number, have no phase
            spectrum[1:free] = np.abs(spectrum[1:free]) * np.exp(2j * np.pi * rows["u"].to_numpy()[: free - 1])
            v = np.fft.irfft(spectrum, n)
        return rows.assign(v=v)[["sid", "draw", "i", "v"]]

    drawn = _draws(s, draws, seed).select("sid", "draw", "i", "v", "u")
    kinds = {f.name: f.dataType.simpleString() for f in drawn.schema}
    return drawn.groupBy("sid", "draw").applyInPandas(turn, f"sid {kinds['sid']}, draw long, i long, v double")  # one draw of one series in memory


STATISTICS = {"burstiness": burstiness, "permutation_entropy": permutation_entropy, "irreversibility": irreversibility, "window_mean": window_mean, "max_deviation": max_deviation}
PERTURBATIONS = {"shuffle": shuffled, "resample": resampled, "phase": phased}
# The pairs of statistic and perturbation for which the statistic was shown to feel what the perturbation destroys.
LICENSED = {
    ("burstiness", "shuffle"), ("window_mean", "shuffle"), ("permutation_entropy", "shuffle"), ("irreversibility", "shuffle"), ("irreversibility", "phase"),
    ("max_deviation", "resample"), ("max_deviation", "phase"),
}


class Refused(ValueError):
    """A ground that can't be asked for: kind is undeclared, unknown_spec or unlicensed."""

    def __init__(self, kind: str, what: str):
        super().__init__(f"{kind}: {what}")
        self.kind = kind


def licensed(statistic: str, perturbation: str) -> bool:
    return (statistic, perturbation) in LICENSED


def ground(s: DataFrame, draws: int, window: int, perturbation: str = "shuffle", seed: int | Column = 0, statistic: str = "burstiness") -> DataFrame:
    """A statistic of every draw; the seed may be a column of sid."""
    if window < 2:
        raise Refused("undeclared", "a window of two places at least")
    if perturbation not in PERTURBATIONS or statistic not in STATISTICS:
        raise Refused("unknown_spec", f"{statistic}/{perturbation}")
    if draws < 2:
        raise Refused("undeclared", "two draws at least")
    if not blocks.can(statistic, window):
        return STATISTICS[statistic](PERTURBATIONS[perturbation](s, draws, seed), window, ["sid", "draw"])

    def samples(b: blocks.Block) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        of = np.flatnonzero(blocks.formed(statistic, b.sizes, window))
        return blocks.by_draw(of, blocks.drawn(b, statistic, window, perturbation, range(draws))[:, of] if len(of) else np.empty((draws, 0)))

    return blocks.each_block(_seeded(s, seed), samples, "draw long, stat double")


def _seeded(s: DataFrame, seed: int | Column) -> DataFrame:
    return s.withColumn("seed", (F.lit(seed) if isinstance(seed, int) else seed).cast("long"))


def placements(s: DataFrame, window: int, statistic: str, grounds: list[tuple[str, str, range]], seed: int = 0) -> DataFrame:
    """sid, of, observed, rank, gap, re_zero as `difference` has them, of grounds (name, perturbation, numbers of the draws) that are made and placed where a series is read."""
    for _, perturbation, numbers in grounds:
        if window < 2 or len(numbers) < 2:
            raise Refused("undeclared", "a window of two places and two draws at least")
        if perturbation not in PERTURBATIONS or statistic not in STATISTICS:
            raise Refused("unknown_spec", f"{statistic}/{perturbation}")
    if not blocks.can(statistic, window):
        each = [STATISTICS[statistic](PERTURBATIONS[p](s, len(numbers), seed + numbers[0]), window, ["sid", "draw"]).select("sid", F.lit(name).alias("of"), "stat") for name, p, numbers in grounds]
        return difference(STATISTICS[statistic](s, window), reduce(DataFrame.unionByName, each), ("of",))
    names = np.array([name for name, _, _ in grounds], object)

    def placed(b: blocks.Block) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        of = np.flatnonzero(blocks.formed(statistic, b.sizes, window))
        if not len(of):
            return of, {}
        observed = blocks.STATISTICS[statistic](b, b.v, window)[of]
        found = [blocks.place(observed, blocks.drawn(b, statistic, window, p, numbers)[:, of]) for _, p, numbers in grounds]
        columns = {k: np.stack([x[j] for x in found]).T.ravel() for j, k in enumerate(("low", "high", "share"))}
        return np.repeat(of, len(grounds)), {"of": np.tile(names, len(of)), "observed": np.repeat(observed, len(grounds))} | columns

    return _said_of(blocks.each_block(_seeded(s, seed), placed, "of string, observed double, low double, high double, share double"), ("of",))


def extreme_ground(s: DataFrame, draws: int, window: int, n: int, direction: str = "above", seed: int = 0) -> DataFrame:
    """Each sample is the greatest (or least) of n statistics."""
    pick = F.max if direction == "above" else F.min
    return ground(s, draws * n, window, "shuffle", seed).groupBy("sid", F.floor(F.col("draw") / n).alias("draw")).agg(pick("stat").alias("stat"))


def apertures(g: DataFrame) -> DataFrame:
    """sid, volume (between the quartiles), tail_span (between the twentieths)."""
    q = F.percentile("stat", F.array(*map(F.lit, (0.05, 0.25, 0.75, 0.95))))
    return g.groupBy("sid").agg(q.alias("q")).select("sid", (F.col("q")[2] - F.col("q")[1]).alias("volume"), (F.col("q")[3] - F.col("q")[0]).alias("tail_span"))


def difference(observed: DataFrame, g: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """sid, by (which ground it is, of several), observed, rank (share of samples at or over it), gap.

    Beyond the samples there is no rank but the gap exceeds_witness, with re_zero above; a ground without width is refused.
    """
    both = g.join(observed.select("sid", F.col("stat").alias("observed")), "sid")
    out = both.groupBy("sid", *by).agg(F.first("observed").alias("observed"), F.min("stat").alias("low"), F.max("stat").alias("high"), F.avg(F.when(F.col("stat") >= F.col("observed"), 1.0).otherwise(0.0)).alias("share"))
    return _said_of(out, by)


def _said_of(out: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rank, gap and re_zero of observed, low, high and share."""
    outside = (F.col("observed") > F.col("high")) | (F.col("observed") < F.col("low"))
    gap = F.when(F.col("low") == F.col("high"), "degenerate_ground").when(outside, "exceeds_witness")
    return out.select("sid", *by, "observed", F.when(gap.isNull(), F.col("share")).alias("rank"), gap.alias("gap"), (gap.eqNullSafe("exceeds_witness") & (F.col("observed") > F.col("high"))).alias("re_zero"))


def typed_difference(s: DataFrame, observed: DataFrame, g: DataFrame, draws: int) -> DataFrame:
    """For every series: sid, extent, observed, low, high, rank, gap, direction, censored_at.

    gap: unknown_spec where the statistic can't be formed of the series or of a draw, degenerate_ground for one without width, exceeds_witness (with its direction)
    beyond the samples, else null.
    """
    extent = s.groupBy("sid").agg(F.count("*").alias("extent"))
    seen = observed.select("sid", F.col("stat").alias("observed"))
    shares = g.join(seen, "sid", "left").groupBy("sid").agg(F.min("stat").alias("low"), F.max("stat").alias("high"), F.count("stat").alias("n"), F.avg(F.when(F.col("stat") >= F.col("observed"), 1.0).otherwise(0.0)).alias("share"))
    both = extent.join(seen, "sid", "left").join(shares, "sid", "left")
    formed = F.coalesce((F.col("n") == draws) & F.col("observed").isNotNull(), F.lit(False))
    direction = F.when(F.col("observed") > F.col("high"), "above").when(F.col("observed") < F.col("low"), "below")
    gap = F.when(~formed, "unknown_spec").when(F.col("low") == F.col("high"), "degenerate_ground").when(direction.isNotNull(), "exceeds_witness")
    beyond = gap.eqNullSafe("exceeds_witness")
    return both.select("sid", "extent", "observed", "low", "high", F.when(gap.isNull(), F.col("share")).alias("rank"), gap.alias("gap"), F.when(beyond, direction).alias("direction"), F.when(beyond, F.lit(1.0 / draws)).alias("censored_at"))


def full_verdict(s: DataFrame, window: int, draws: int, reseeds: int, statistic: str = "burstiness", perturbation: str = "resample", plural: tuple[str, ...] = ("shuffle",), seed: int = 0) -> DataFrame:
    """sid, verdict over several grounds: void without a ground, thrash where the plural grounds say otherwise, settled where reseeded grounds all
    support too, else contested or supported.

    All reseeds are one ground of more draws, cut by the number of the draw; all grounds are placed where a series is read.
    """
    grounds = [*_turns(draws, reseeds, perturbation), *((name, name, range(draws)) for name in plural)]
    placed = placements(s, window, statistic, grounds, seed).select("sid", F.struct("of", _said().alias("verdict")).alias("e"))
    out = placed.groupBy("sid").agg(F.map_from_entries(F.collect_list("e")).alias("by"))  # an entry a ground
    first, split, stable = F.col("by")["0"], F.lit(False), F.lit(True)
    for name in plural:
        split = split | ~F.col("by")[name].eqNullSafe(first)
    for k in range(1, reseeds + 1):
        stable = stable & F.col("by")[str(k)].eqNullSafe("supported")
    kind = F.when(first == "void", "void").when(split, "thrash").when((first == "supported") & stable & F.lit(reseeds > 0), "settled").otherwise(first)
    return out.select("sid", kind.alias("verdict"))


def _turns(draws: int, reseeds: int, perturbation: str) -> list[tuple[str, str, range]]:
    """A ground (0) and its reseedings (1 to reseeds), as one ground of more draws that is cut by the number of the draw."""
    return [(str(k), perturbation, range(k * draws, (k + 1) * draws)) for k in range(reseeds + 1)]


def _said() -> Column:
    return F.when(F.col("gap") == "degenerate_ground", "void").when(F.col("gap").isNotNull() | (F.col("rank") < LOW) | (F.col("rank") > HIGH), "contested").otherwise("supported")


def verdict(placed: DataFrame) -> DataFrame:
    """sid, verdict: void without a ground, contested in the tails or beyond, supported else."""
    return placed.select("sid", _said().alias("verdict"))


def disagreement(placed: DataFrame) -> DataFrame:
    """sid, n, censored, split, spread over several placements of a series."""
    return placed.groupBy("sid").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("gap").isNotNull()).alias("censored"),
        ((F.count_if(F.col("gap").isNotNull()) > 0) & (F.count("rank") > 0)).alias("split"),
        (F.max("rank") - F.min("rank")).alias("spread"),
    )


def temporality(s: DataFrame, draws: int, window: int, seed: int = 0) -> DataFrame:
    """sid, temporality: exchangeable if the order of the values is like that of shuffles, else arrowed or reversible by whether
    the series differs from its reversal more than shuffles do; unstable if it is less ordered than all shuffles. Statistics are compared to nine places, as many
    orders of values give the same one."""
    even = lambda g: g.withColumn("stat", F.round("stat", 9))
    placed = lambda name, start: difference(even(STATISTICS[name](s, window)), even(ground(s, draws, window, "shuffle", start, name)))
    order = placed("permutation_entropy", seed).select("sid", F.col("gap").alias("gap"), F.col("re_zero").alias("above"))
    arrow = placed("irreversibility", seed + draws).select("sid", F.col("re_zero").alias("arrow"))
    kind = F.when(F.col("gap") == "degenerate_ground", "void").when(F.col("above"), "unstable").when(F.col("gap").isNull(), "exchangeable").when(F.col("arrow"), "arrowed").otherwise("reversible")
    return order.join(arrow, "sid").select("sid", kind.alias("temporality"))


def level(s: DataFrame, window: int, draws: int, reseeds: int, statistic: str = "burstiness", own: str = "resample", target: str = "shuffle", seed: int = 0) -> DataFrame:
    """sid, relationship, displacement, threshold, gap: whether a series stands above, below or beside its own ground as another ground sees it.

    The displacement is the difference of the two ranks; under the resolution of the draws, or the widest change of rank under reseeded grounds of its own, it's a peer. What
    its own ground can't place keeps that gap; if the other ground or a reseeded one can't place it, it's unstable.
    """
    grounds = [*_turns(draws, reseeds, own), ("target", target, range(draws))]
    placed = placements(s, window, statistic, grounds, seed).select("sid", F.struct("of", F.struct("rank", "gap").alias("at")).alias("e"))
    by = placed.groupBy("sid").agg(F.map_from_entries(F.collect_list("e")).alias("by"))  # an entry a ground
    out = by.filter(F.col("by")["0"].isNotNull()).select("sid", "by", F.col("by")["0"]["rank"].alias("rank"), F.col("by")["0"]["gap"].alias("gap"), F.col("by")["target"]["rank"].alias("cross"))
    ranks = [F.col("by")[str(k)]["rank"] for k in range(1, reseeds + 1)]
    lost = F.col("cross").isNull()
    for r in ranks:
        lost = lost | r.isNull()
    gap = F.coalesce("gap", F.when(lost, "unstable"))
    threshold = F.greatest(F.lit(2.0 / draws), *(F.abs(r - F.col("rank")) for r in ranks)) if ranks else F.lit(2.0 / draws)
    moved = F.col("cross") - F.col("rank")
    kind = F.when(F.abs(moved) <= threshold, "peer").when(moved > 0, "above").otherwise("below")
    said = lambda c: F.when(gap.isNull(), c)
    return out.select("sid", said(kind).alias("relationship"), said(moved).alias("displacement"), said(threshold).alias("threshold"), gap.alias("gap"))
