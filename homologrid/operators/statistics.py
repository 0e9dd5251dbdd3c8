"""Cluster statistics: rank-sum and distribution tests, FDR, medians, markers.

Every test works on value counts and global running totals, so its cost is one
aggregation plus one range-partitioned pass whatever the cluster sizes; a
cluster holding a third of all rows is spread over the value ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homologrid.functions.kolmogorov import two_sample_tail
from homologrid.functions.probability import two_sided_p
from homologrid.operators.ordering import (
    BUCKET,
    exact_quantiles,
    range_bounds,
    running_totals,
    value_counts,
    with_range,
    with_scalars,
)
from homologrid.staging import StageArea

# Significance threshold of the markers, placeholder of an empty cluster,
# and the sample size up to which untied rank sums are tested exactly.
ADJUSTED_P_THRESHOLD = 0.001
EMPTY_CLUSTER_VALUE = 0.0
EXACT_SAMPLE_SIZE = 8


def cluster_values(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Non-null values per cluster; a cluster without any gets a single 0."""
    pairs = df.where(F.col(cluster).isNotNull()).select(
        F.col(cluster).alias("cluster"), F.col(value).cast("double").alias("value")
    )
    given = pairs.where(F.col("value").isNotNull() & ~F.isnan("value"))
    empty = (
        pairs.groupBy("cluster")
        .agg(F.count(F.when(~F.isnan("value"), F.col("value"))).alias("n"))
        .where(F.col("n") == 0)
        .select("cluster", F.lit(EMPTY_CLUSTER_VALUE).alias("value"))
    )
    return given.unionAll(empty)


def clusters_of(df: DataFrame, cluster: str, keys: Sequence[str], key: str = "protid") -> DataFrame:
    """The cluster or clusters holding the key proteins."""
    return (
        df.where(F.col(key).isin(list(keys)) & F.col(cluster).isNotNull())
        .select(F.col(cluster).alias("cluster"))
        .distinct()
    )


def _tie_term(n: Column) -> Column:
    n = n.cast("double")
    return n * n * n - n


def _sided_counts(
    values: DataFrame, targets: Sequence | None
) -> tuple[DataFrame, DataFrame, DataFrame, list[float]]:
    """Counts per (cluster, value); per value of the comparison sample; the same with ranks; the ranges.

    The counts are written once; the input is not read again.
    """
    area = StageArea(values.sparkSession, "counts")
    counts = area.write(value_counts(values, "value", ["cluster"]), "counts")
    compared = F.col("n")
    if targets is not None:
        # Values the comparison sample lacks take part with a count of 0.
        compared = F.when(F.col("cluster").isin(list(targets)), F.col("n")).otherwise(0)
    pooled = counts.groupBy("value").agg(F.sum(compared).alias("base"))
    bounds = range_bounds(counts, "value")
    return counts, pooled, running_totals(pooled, "value", ["base"], bounds=bounds), bounds


def rank_sum_test(
    values: DataFrame, targets: Sequence | None = None, exact: bool = True
) -> DataFrame:
    """Two-sided Mann-Whitney U of every cluster.

    ``values`` has ``cluster, value``.  With ``targets`` each cluster is compared
    with the pooled target clusters, itself included when it is one of them;
    without, with all other clusters.  Returns ``cluster, n1, n2, u, z, p``; z
    carries the tie and continuity corrections.  Small untied samples get the
    exact p-value when ``exact``.
    """
    counts, pooled, ranked, _ = _sided_counts(values, targets)
    joined = counts.join(ranked, "value")
    own = F.col("n").cast("double")
    base = F.col("base").cast("double")
    below = F.col("base_before").cast("double")
    per_cluster = joined.groupBy("cluster").agg(
        F.sum("n").alias("n1"),
        F.sum(own * (below + base / 2)).alias("won"),
        # Change of the tie sum of the comparison sample through this cluster's values.
        F.sum(_tie_term(F.col("n") + F.col("base")) - _tie_term(F.col("base"))).alias("tie_gain"),
    )
    overall = pooled.agg(
        F.sum("base").alias("size"), F.sum(_tie_term(F.col("base"))).alias("tie_base")
    )
    both = with_scalars(per_cluster, overall)
    if targets is None:
        # The comparison sample is everything else: own values beat each other n1^2 / 2 times.
        n2 = F.col("size") - F.col("n1")
        u = F.col("won") - F.col("n1").cast("double") * F.col("n1") / 2
        ties = F.col("tie_base")
    else:
        n2, u, ties = F.col("size"), F.col("won"), F.col("tie_base") + F.col("tie_gain")
    sized = both.select("cluster", "n1", n2.alias("n2"), u.alias("u"), ties.alias("ties"))

    n1d, n2d = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1d + n2d
    spread = F.sqrt(
        n1d * n2d / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1)))
    )
    top = F.greatest(F.col("u"), n1d * n2d - F.col("u"))
    z = F.try_divide(top - n1d * n2d / 2 - 0.5, spread)
    # The larger U, less the continuity correction, can fall just below the mean, and the
    # spread is 0 when all values are equal: p is 1 in both cases.
    no_evidence = (F.col("n2") > 0) & (F.col("z").isNull() | (F.col("z") <= 0))
    tested = sized.withColumn("z", z).withColumn(
        "p", F.when(no_evidence, 1.0).otherwise(two_sided_p(F.col("z")))
    )
    if exact:
        small = (F.least("n1", "n2") <= EXACT_SAMPLE_SIZE) & (F.col("ties") == 0)
        tested = tested.withColumn(
            "p", F.when(small, _exact_rank_sum_p("n1", "n2", "u")).otherwise(F.col("p"))
        )
    return tested.select("cluster", "n1", "n2", "u", "z", "p")


def exact_rank_sum_tail(n1: int, n2: int, u: float) -> float:
    """Two-sided exact p: share of arrangements at least as extreme, by counting.

    The numbers of arrangements by statistic are the coefficients of the Gaussian binomial,
    a product of ``small`` factors (1 - q^(large + k)) / (1 - q^k): two sweeps each, linear in the
    larger sample.  Only the shorter tail is counted.
    """
    small, large = sorted((int(n1), int(n2)))
    if small == 0:
        return float("nan")
    # Statistics of at most the smaller of both directions are as extreme, by symmetry.
    upto = math.floor(min(u, small * large - u))
    ways = np.zeros(upto + 1)
    ways[0] = 1.0
    for k in range(1, small + 1):
        if large + k <= upto:
            # In one piece on the right, so every entry is taken from before the factor.
            ways[large + k :] -= ways[: upto + 1 - large - k].copy()
        for residue in range(min(k, upto + 1)):
            ways[residue::k] = np.cumsum(ways[residue::k])
    return min(1.0, 2.0 * float(ways.sum()) / math.comb(small + large, small))


def _exact_rank_sum_p(n1: str, n2: str, u: str) -> Column:
    """Exact p for small samples, null elsewhere; one value per cluster, in Arrow batches."""

    @F.pandas_udf("double")
    def tail(first: pd.Series, second: pd.Series, stat: pd.Series) -> pd.Series:
        return pd.Series(
            [
                exact_rank_sum_tail(a, b, s)
                if min(a, b) <= EXACT_SAMPLE_SIZE
                else None
                for a, b, s in zip(first, second, stat)
            ],
            dtype="float64",
        )

    return F.coalesce(tail(F.col(n1), F.col(n2), F.col(u)), F.col("p"))


def distribution_gap_test(values: DataFrame, targets: Sequence | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D of every cluster, with its p-value.

    p is exact for samples of up to 10,000 values, else that of the effective size.

    The gap between two step functions is largest at a value of either sample.
    At a value only the comparison sample has, the gap is largest just before the
    cluster's next value (or at the very end, where it is 0), so it is enough to
    look at and just below each of the cluster's own values.
    """
    counts, pooled, ranked, bounds = _sided_counts(values, targets)
    own = running_totals(counts, "value", ["n"], ["cluster"], bounds)
    sizes = counts.groupBy("cluster").agg(F.sum("n").alias("n1"))
    size = pooled.agg(F.sum("base").alias("size"))
    joined = with_scalars(own.join(ranked, "value").join(sizes, "cluster"), size)
    n1 = F.col("n1").cast("double")
    if targets is None:
        n2 = (F.col("size") - F.col("n1")).cast("double")
        before = F.col("base_before") - F.col("n_before")
        upto = before + F.col("base") - F.col("n")
    else:
        n2 = F.col("size").cast("double")
        before = F.col("base_before")
        upto = before + F.col("base")
    gaps = F.greatest(
        F.abs(F.col("n_before") / n1 - before / n2),
        F.abs((F.col("n_before") + F.col("n")) / n1 - upto / n2),
    )
    result = joined.groupBy("cluster").agg(
        F.max("n1").alias("n1"), F.max(n2).cast("bigint").alias("n2"), F.max(gaps).alias("d")
    )

    # One row per cluster, in Arrow batches.
    @F.pandas_udf("double")
    def tail(first: pd.Series, second: pd.Series, gap: pd.Series) -> pd.Series:
        return pd.Series([two_sample_tail(*row) for row in zip(first, second, gap)], dtype="float64")

    return result.withColumn("p", tail("n1", "n2", "d"))


TESTS = {"MWU": rank_sum_test, "KS2S": distribution_gap_test}


def distribution_test(
    values: DataFrame, targets: Sequence | None = None, method: str = "MWU"
) -> DataFrame:
    """Test every cluster against the targets (or the rest) with a named method."""
    if method not in TESTS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(TESTS)}")
    if targets is not None:
        known = {
            row["cluster"]
            for row in values.where(F.col("cluster").isin(list(targets)))
            .select("cluster")
            .distinct()
            .collect()
        }
        unknown = [name for name in targets if name not in known]
        if unknown:
            raise ValueError(f"unknown clusters: {unknown}")
    return TESTS[method](values, targets)


def adjust_p(tests: DataFrame, p: str = "p", family: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg step-up adjustment inside each family; adds ``padj``.

    Equal p-values share the largest of their ranks, which is what the step-up
    minimum selects among them.  The backward minimum runs inside value ranges
    and is carried over from the ranges above.
    """
    family = list(family)
    # One small row per test, read several times below: write it once.
    tests = StageArea(tests.sparkSession, "tests").write(tests)
    counts = value_counts(tests, p, family)
    bounds = range_bounds(tests, p)
    ranked = running_totals(counts, p, ["n"], family, bounds)
    sizes = counts.groupBy(*family).agg(F.sum("n").alias("_m"))
    ranked = ranked.join(sizes, family) if family else with_scalars(ranked, sizes)
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("n_before") + F.col("n")))
    cut = with_range(raw, p, bounds)
    inside = (
        Window.partitionBy(*family, BUCKET)
        .orderBy(F.col(p).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    above = (
        Window.partitionBy(*family)
        .orderBy(F.col(BUCKET).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lowest = (
        cut.groupBy(*family, BUCKET)
        .agg(F.min("_raw").alias("_low"))
        .select(*family, BUCKET, F.min("_low").over(above).alias("_carried"))
    )
    adjusted = (
        cut.withColumn("_inside", F.min("_raw").over(inside))
        .join(lowest, [*family, BUCKET])
        .select(
            *family,
            p,
            F.least(F.lit(1.0), F.col("_inside"), F.col("_carried")).alias("padj"),
        )
    )
    return tests.join(adjusted, [*family, p], "left").select(*tests.columns, "padj")


def medians(values: DataFrame, groups: Sequence[str] = ("cluster",)) -> DataFrame:
    """Exact medians per group."""
    return exact_quantiles(values, "value", {"median": 0.5}, list(groups))


def marked_clusters(
    values: DataFrame,
    targets: Sequence | None = None,
    threshold: float = ADJUSTED_P_THRESHOLD,
    method: str = "MWU",
) -> DataFrame:
    """Test, adjust and mark every cluster of one column.

    ``.`` not significant; without targets ``*`` significant; with targets ``v``,
    ``^`` or ``o`` for a median below, above or equal to the targets' median.
    """
    tested = adjust_p(distribution_test(values, targets, method))
    result = tested.join(medians(values), "cluster")
    if targets is None:
        result = result.withColumn("target_median", F.lit(None).cast("double"))
        marker = F.lit("*")
    else:
        pooled = values.where(F.col("cluster").isin(list(targets)))
        target = exact_quantiles(pooled, "value", {"target_median": 0.5})
        result = with_scalars(result, target)
        marker = (
            F.when(F.col("median") < F.col("target_median"), "v")
            .when(F.col("median") > F.col("target_median"), "^")
            .otherwise("o")
        )
    return result.withColumn(
        "marker", F.when(F.col("padj") > threshold, ".").otherwise(marker)
    )


def column_markers(
    features: DataFrame,
    cluster: str,
    columns: Sequence[str],
    keys: Sequence[str] | None = None,
    key: str = "protid",
) -> DataFrame:
    """Marker tables of several feature columns, stacked; unknown columns are left out.

    The number of target clusters is at most the number of key proteins.
    """
    targets = None
    if keys is not None:
        targets = [row["cluster"] for row in clusters_of(features, cluster, keys, key).collect()]
    tables = [
        marked_clusters(cluster_values(features, cluster, name), targets).select(
            F.lit(name).alias("feature"), "*"
        )
        for name in columns
        if name in features.columns
    ]
    return reduce(DataFrame.unionByName, tables)
