"""Densities of a measure per cluster: the numbers behind violins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.staging import StageArea

POINTS = 100
# Rule of thumb: this times the deviation times n^(-1/5).
BANDWIDTH_FACTOR = 1.06


def cluster_densities(
    rows: DataFrame, cluster: str, value: str, points: int = POINTS, factor: float = BANDWIDTH_FACTOR
) -> DataFrame:
    """``cluster, n, bandwidth, point, at, density``: Gaussian kernel densities on one grid for all clusters.

    The grid spans the whole range of the measure.  The input is read once, into counts of
    values; every count meets every grid point inside its task and only sums by cluster and
    point are shuffled.  Null and NaN values take no part; a cluster with fewer than two values or without
    spread has no bandwidth, so no rows.
    """
    area = StageArea(rows.sparkSession, "densities")
    counts = area.write(
        rows.select(F.col(cluster).alias("cluster"), F.col(value).cast("double").alias("x"))
        .where(F.col("cluster").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
        .groupBy("cluster", "x")
        .agg(F.count("*").alias("times")),
        "counts",
    )
    means = counts.groupBy("cluster").agg(
        F.sum("times").alias("n"),
        (F.sum(F.col("times") * F.col("x")) / F.sum("times")).alias("mean"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    ends = means.agg(F.min("low"), F.max("high")).first()
    low, high = (0.0, 0.0) if ends[0] is None else ends
    step = (high - low) / max(1, points - 1)
    away = F.col("x") - F.col("mean")
    spreads = (
        counts.join(means.select("cluster", "n", "mean"), "cluster")
        .groupBy("cluster", "n")
        .agg(F.sqrt(F.sum(F.col("times") * away * away) / (F.col("n") - 1)).alias("deviation"))
        .where("n > 1 and deviation > 0")
        .select("cluster", "n", (factor * F.col("deviation") * F.pow("n", F.lit(-0.2))).alias("bandwidth"))
    )
    at = F.lit(low) + F.col("point") * F.lit(step)
    far = (at - F.col("x")) / F.col("bandwidth")
    sums = (
        counts.join(spreads, "cluster")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .groupBy("cluster", "n", "bandwidth", "point")
        .agg(F.sum(F.col("times") * F.exp(-0.5 * far * far)).alias("total"))
    )
    return sums.select(
        "cluster", "n", "bandwidth", "point", at.alias("at"),
        (F.col("total") / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"),
    )
