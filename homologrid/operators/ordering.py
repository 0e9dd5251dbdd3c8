"""Global order at scale: range buckets, running totals, exact quantiles.

A window without partitions (or with one hot partition) would pull everything
into one task.  Here rows are first reduced to one per distinct value, cut into
ranges whose bounds come from an approximate-quantile pass, summed inside each
range, and shifted by the totals of the ranges before it.  Bounds only balance
the work; results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homologrid.session import shuffle_width
from homologrid.staging import StageArea

BUCKET = "_range"


def with_scalars(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the cells of a one-row table as columns, through scalar subqueries."""
    return df.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])


def range_bounds(df: DataFrame, value: str, pieces: int | None = None) -> list[float]:
    """At most ``pieces`` - 1 increasing cut points of a numeric column.

    By default there are as many ranges as shuffle partitions; adaptive execution merges
    those that turn out small.  Only a column with at most one value has no cut.
    """
    if pieces is None:
        pieces = shuffle_width(df.sparkSession)
    shares = [i / pieces for i in range(1, pieces)]
    row = df.select(
        F.percentile_approx(F.col(value).cast("double"), shares, 20 * pieces).alias("cuts")
    ).first()
    return sorted(set(row["cuts"] or []))


def with_range(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Add the number of the range a value falls in; equal values share a range."""
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    keyed = df.withColumn("_sort", F.col(value).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_sort", outputCol="_cut", handleInvalid="keep")
    return (
        cut.transform(keyed).withColumn(BUCKET, F.col("_cut").cast("int")).drop("_sort", "_cut")
    )


def running_totals(
    df: DataFrame,
    value: str,
    measures: Sequence[str],
    groups: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``<measure>_before``: the sum over all smaller values, per group.

    ``df`` holds one row per (group, value).
    """
    if bounds is None:
        bounds = range_bounds(df, value)
    groups = list(groups)
    cut = with_range(df, value, bounds)
    inside = (
        Window.partitionBy(*groups, BUCKET)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (group, range): the second window sees at most `pieces` rows a group.
    totals = cut.groupBy(*groups, BUCKET).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    offsets = totals.select(
        *groups,
        BUCKET,
        *[
            F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}")
            for m in measures
        ],
    )
    local = cut.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_l_{m}") for m in measures]
    )
    joined = local.join(offsets, [*groups, BUCKET])
    return joined.select(
        *df.columns, *[(F.col(f"_l_{m}") + F.col(f"_o_{m}")).alias(f"{m}_before") for m in measures]
    )


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, value), nulls left out; combined before the shuffle."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    shares: dict[str, float],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Exact linearly interpolated quantiles, one output column per entry of ``shares``.

    Unlike a per-group percentile buffer, no group is ever held in one task.  The input is read
    once, into counts of values that are written.
    """
    groups = list(groups)
    counts = StageArea(df.sparkSession, "quantiles").write(value_counts(df, value, groups), "counts")
    bounds = range_bounds(counts, value)
    ranked = running_totals(counts, value, ["n"], groups, bounds)
    sizes = counts.groupBy(*groups).agg(F.sum("n").alias("_size"))
    ranked = ranked.join(sizes, groups) if groups else with_scalars(ranked, sizes)

    def at(position):
        covers = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
        return F.max(F.when(covers, F.col(value).cast("double")))

    picks = []
    for name, share in shares.items():
        spot = F.lit(share) * (F.col("_size") - 1)
        picks += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_w_{name}"),
        ]
    found = ranked.groupBy(*groups).agg(*picks)
    return found.select(
        *groups,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")
            ).alias(name)
            for name in shares
        ],
    )


def dense_codes(df: DataFrame, key: str, code: str = "code") -> DataFrame:
    """Distinct keys with their 0-based position in ascending order, any key type.

    The sorted keys are written once with the partition and place each row landed
    in, so that both stay fixed; the position is the place plus the sizes of the
    partitions before it (one number per partition).
    """
    spark = df.sparkSession
    placed = (
        df.select(key)
        .where(F.col(key).isNotNull())
        .distinct()
        .orderBy(key)
        .select(
            key,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"),
        )
    )
    written = StageArea(spark, "codes").write(placed)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        written.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return written.join(F.broadcast(offsets), "_part").select(
        key, (F.col("_place") + F.col("_offset")).alias(code)
    )
