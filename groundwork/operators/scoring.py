"""Losses of predictive outputs as column expressions: categorical, quantiles, samples and sequences. Lower is better."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The loss of what had no probability: of the least positive number.
WORST = -math.log(5e-324)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def brier(probs: Column, observed: Column) -> Column:
    """Squared distance of a map of probabilities from what came; a label that isn't in the map costs one."""
    each = F.transform(F.map_entries(probs), lambda e: F.pow(e["value"] - F.when(e["key"] == observed, 1.0).otherwise(0.0), F.lit(2)))
    return _sum(each) + F.when(F.try_element_at(probs, observed).isNull(), 1.0).otherwise(0.0)


def categorical_log_loss(probs: Column, observed: Column) -> Column:
    """Null for a label that isn't in the map."""
    p = F.try_element_at(probs, observed)
    return F.when(p > 0, -F.ln(p)).when(p == 0, F.lit(WORST))


def sample_crps(samples: Column, observed: Column) -> Column:
    """Mean distance of the samples from what came less half their mean distance from each other, which sorted samples give in one pass."""
    n = F.size(samples)
    spread = _sum(F.transform(F.array_sort(samples), lambda x, i: (2 * i - n + 1) * x)) / (n * n)
    return _sum(F.transform(samples, lambda x: F.abs(x - observed))) / n - spread


def quantile(samples: Column, tau: float) -> Column:
    """Interpolated quantile of an array."""
    x, at = F.array_sort(samples), F.lit(tau) * (F.size(samples) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(x, low), F.get(x, F.least(low + 1, F.size(x) - 1))
    return a + (at - low) * (b - a)


def quantile_loss(levels: list[tuple[float, Column]], observed: Column) -> Column:
    """Mean pinball loss over the levels (tau, value)."""
    total = F.lit(0.0)
    for tau, value in levels:
        off = observed - value
        total = total + F.when(off >= 0, tau * off).otherwise((tau - 1) * off)
    return total / len(levels)


def prefix_agreement(emitted: Column, observed: Column) -> Column:
    """How many of the emitted forms come after the first that differs from what came, that one included."""
    same = F.zip_with(emitted, observed, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.size(emitted) - F.when(at > 0, at - 1).otherwise(F.size(emitted))


def exact_match(emitted: Column, observed: Column) -> Column:
    return F.when(emitted == observed, 0).otherwise(1)
