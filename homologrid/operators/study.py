"""Meta-analysis over runs: bins, weights, sampling, contingency, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homologrid.functions.scaling import truncated_int
from homologrid.operators.ordering import exact_quantiles, with_scalars


def quantile_bins(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Add ``<column>_bin``: 1..bins by exact interpolated quantile edges.

    Bins are right-closed and the first includes the minimum.  The few edges are
    computed without holding a column in one task, then compared row by row.
    """
    out = df
    for name in columns:
        edges = {f"q{i}": i / bins for i in range(1, bins)}
        row = exact_quantiles(df, name, edges).first()
        number = F.lit(1)
        if row is not None:
            for edge in edges:
                number = number + F.when(F.col(name) > F.lit(row[edge]), 1).otherwise(0)
        out = out.withColumn(f"{name}_bin", F.when(F.col(name).isNotNull(), number))
    return out


def bin_weights(df: DataFrame, bins: Sequence[str]) -> DataFrame:
    """Add ``combined_weight``: the share of all rows in the row's bin combination.

    The number of combinations is fixed by the bins (100 for two tens), so the
    weights are small whatever the table.
    """
    shares = df.groupBy(*bins).agg(F.count(F.lit(1)).alias("_n"))
    total = shares.agg(F.sum("_n").alias("_all"))
    weighted = with_scalars(shares, total).select(
        *bins, (F.col("_n") / F.col("_all")).alias("combined_weight")
    )
    return df.join(weighted, list(bins))


def uniform_of(key: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that depends only on the key and the seed."""
    digest = F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sample(
    df: DataFrame, n: int, weight: str, key: str = "protid", seed: int = 20230821
) -> DataFrame:
    """``n`` rows without replacement, chance growing with the weight.

    Exponential keys: the n smallest of -ln(u)/w.  Reproducible whatever the
    partitioning, and one top-k instead of a sort.
    """
    draw = -F.log(uniform_of(F.col(key), seed)) / F.col(weight)
    return (
        df.where(F.col(weight) > 0)
        .withColumn("_draw", draw)
        .orderBy("_draw", key)
        .limit(n)
        .drop("_draw")
    )


def mark_sampled(df: DataFrame, sample: DataFrame, key: str = "protid") -> DataFrame:
    """Add ``sampled`` = yes/no."""
    chosen = sample.select(key).distinct().withColumn("_chosen", F.lit(True))
    return df.join(chosen, key, "left").select(
        *df.columns, F.when(F.col("_chosen"), "yes").otherwise("no").alias("sampled")
    )


def contingency(
    df: DataFrame, run: str, category: str, ranked: Sequence[str]
) -> DataFrame:
    """Counts, shares and cumulative shares of ranked categories per run.

    Categories outside the ranking are left out of the shares; a ranked category
    that occurs in any run appears in all of them, with 0.
    """
    counts = (
        df.where(F.col(category).isin(list(ranked)))
        .groupBy(F.col(run).alias("run"))
        .pivot(category, list(ranked))
        .agg(F.count(F.lit(1)))
    )
    cells = [F.coalesce(F.col(f"`{name}`"), F.lit(0)).cast("bigint") for name in ranked]
    total = sum(cells[1:], cells[0])
    entries = []
    cumulative = F.lit(0).cast("bigint")
    for place, (name, cell) in enumerate(zip(ranked, cells)):
        cumulative = cumulative + cell
        entries.append(
            F.struct(
                F.lit(place).alias("place"),
                F.lit(name).alias("category"),
                cell.alias("n"),
                (cell / total).alias("share"),
                (cumulative / total).alias("cumulative_share"),
            )
        )
    # One row per run holds all its categories: shares need no further shuffle.
    long = counts.select("run", F.inline(F.array(*entries)))
    present = (
        df.where(F.col(category).isin(list(ranked)))
        .select(F.col(category).alias("category"))
        .distinct()
    )
    return long.join(present, "category", "left_semi").select(
        "run", "place", "category", "n", "share", "cumulative_share"
    )


def equal_width_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in equally wide bins between the minimum and the maximum; the last is closed."""
    limits = df.agg(
        F.min(F.col(value).cast("double")).alias("_low"),
        F.max(F.col(value).cast("double")).alias("_high"),
    )
    numbered = with_scalars(df.where(F.col(value).isNotNull()).select(value), limits)
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_low"), width)), F.lit(0))
    return (
        numbered.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_low").alias("_low"),
            F.min(width).alias("_width"),
        )
        .select(
            "bin",
            (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"),
            "n",
        )
    )


def fixed_edge_histogram(
    df: DataFrame, value: str, start: float, stop: float, step: float
) -> DataFrame:
    """Counts in bins of a fixed width; values outside are left out, the last bin is closed."""
    last = round((stop - start) / step) - 1
    place = F.least(F.floor((F.col(value) - start) / step), F.lit(last)).cast("int")
    return (
        df.where((F.col(value) >= start) & (F.col(value) <= stop))
        .groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(float(start)) + F.col("bin") * float(step)).alias("bin_start"), "n")
    )


def top_rows(df: DataFrame, column: str, n: int = 10, tie: str = "protid") -> DataFrame:
    """The ``n`` rows with the largest values."""
    return df.orderBy(F.desc_nulls_last(column), tie).limit(n)


def study_table(study: DataFrame, assessed: DataFrame, key: str = "protid") -> DataFrame:
    """Every assessed protein with its study columns, where it has any."""
    return study.join(assessed, key, "right")


def run_summary(
    df: DataFrame,
    run: str,
    cluster: str,
    source: str,
    organism: str,
    numbers: Sequence[str] = (),
    integers: Sequence[str] = (),
) -> DataFrame:
    """Hit counts, species and mean/median of columns per run.

    Only clustered rows count.  A missing organism counts as one species.
    Columns in ``integers`` are truncated before averaging.
    """
    kept = df.where(F.col(cluster).isNotNull())
    for name in integers:
        kept = kept.withColumn(name, truncated_int(F.col(name)))
    columns = [*numbers, *integers]
    basic = kept.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(source).contains("foldseek"), 1)).alias("n_structure"),
        F.count(F.when(F.col(source).contains("blast"), 1)).alias("n_sequence"),
        (
            F.count_distinct(organism) + F.coalesce(F.max(F.col(organism).isNull().cast("int")), F.lit(0))
        ).alias("n_species"),
        *[F.avg(name).alias(f"{name}_mean") for name in columns],
    )
    for name in columns:
        median = exact_quantiles(kept, name, {f"{name}_median": 0.5}, [run])
        basic = basic.join(median, run, "left")
    return basic


def compactness_table(runs: DataFrame, method_column: str = "method") -> DataFrame:
    """Means and counts of both clusterings side by side, one row per run."""
    return (
        runs.groupBy("run")
        .pivot(method_column, ["Leiden", "Structural"])
        .agg(F.first("mean_similarity").alias("mean"), F.first("n_clusters").alias("count"))
    )

