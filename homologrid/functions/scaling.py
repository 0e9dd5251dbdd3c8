"""Numeric column expressions: rescaling, rounding, confidence bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rescaled(value: Column, low: Column, high: Column, new_low: float, new_high: float) -> Column:
    """Linear map of [low, high] onto [new_low, new_high]; null when low = high."""
    share = F.try_divide(value - low, high - low)
    return share * F.lit(float(new_high - new_low)) + F.lit(float(new_low))


def percent_to_fraction(value: Column) -> Column:
    return value * F.lit(0.01)


def rounded(value: Column, decimals: int = 4) -> Column:
    """Round half to even, as Python's ``round`` does."""
    return F.bround(value, decimals)


def truncated_int(value: Column) -> Column:
    """Toward-zero integer of a number that may be stored as text such as ``375.0``."""
    return value.cast("double").cast("int")


def confidence_band(value: Column) -> Column:
    """Residue confidence bands, right-closed; exactly 0 counts as very high.

    Values outside 0..100 have no band and give null.
    """
    return (
        F.when((value < 0) | (value > 100), F.lit(None).cast("string"))
        .when(value == 0, "very_high")
        .when(value <= 50, "very_low")
        .when(value <= 70, "low")
        .when(value <= 90, "confident")
        .otherwise("very_high")
    )


def structure_confidence(origin: Column, mean: Column, high: Column) -> Column:
    """Mean confidence on a 0-100 scale.

    Experimental structures score 100.  Values that all lie in 0-1 are scaled up;
    everything else, including values straddling 1, is averaged as it is.
    """
    return (
        F.when(origin == "PDB", F.lit(100.0)).when(high <= 1, mean * 100.0).otherwise(mean)
    )


def linear_concordance(structural: Column, identity: Column) -> Column:
    return structural - identity


def entry_count(values: Column, separator: str = ";") -> Column:
    """Number of non-empty entries in a delimited cell, 0 for null."""
    parts = F.filter(F.split(values, separator), lambda part: part != "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("int")
