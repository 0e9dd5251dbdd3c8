"""Tail probabilities as plain column expressions (they stay in the JVM)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _upper_tail_near(z: Column, terms: int = 90) -> Column:
    """1/2 - pdf(z) * (z + z^3/3 + z^5/15 + ...); all terms positive, z < 4."""
    start = F.struct(z.alias("term"), z.alias("total"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * z * z / (k * 2 + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), start, add, lambda state: state["total"]
    )
    return F.lit(0.5) - F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series


def _upper_tail_far(z: Column, depth: int = 60) -> Column:
    """pdf(z) / (z + 1/(z + 2/(z + 3/...))), evaluated from the innermost fraction."""
    fraction = F.aggregate(
        F.sequence(F.lit(depth), F.lit(1), F.lit(-1)),
        F.lit(0.0),
        lambda inner, k: k / (z + inner),
    )
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (z + fraction)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal for z >= 0."""
    return F.when(z < 3.5, _upper_tail_near(z)).otherwise(_upper_tail_far(z))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value, at most 1."""
    return F.least(F.lit(1.0), normal_upper_tail(F.abs(z)) * 2)

