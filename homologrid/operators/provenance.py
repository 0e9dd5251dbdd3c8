"""Where each protein came from: per-key, per-method hit flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Method names and the label of a double hit.
SEQUENCE_METHOD = "blast"
STRUCTURE_METHOD = "foldseek"
BOTH_METHODS = "blast+foldseek"


def hit_sources(
    proteins: DataFrame,
    hits: DataFrame,
    keys: Sequence[str],
    methods: Sequence[str] = (SEQUENCE_METHOD, STRUCTURE_METHOD),
    no_hit_label: str | None = None,
) -> DataFrame:
    """Flags of every (key, method), their summaries and the source label.

    ``hits`` is long: ``protid, key, method``.  The hit lists of all keys are
    reduced to one row per protein in a single aggregation whatever the number
    of lists; columns are exact (key, method) pairs, so a key that is a prefix
    of another never picks up its hits.  A protein without any hit is labelled
    with the first method unless ``no_hit_label`` is given.
    """
    pairs = [(key, method) for key in keys for method in methods]
    flags = (
        hits.groupBy("protid")
        .agg(
            *[
                F.max(((F.col("key") == key) & (F.col("method") == method)).cast("int")).alias(
                    f"{key}_{method}"
                )
                for key, method in pairs
            ]
        )
    )
    base = proteins.select("protid").distinct().join(flags, "protid", "left")
    base = base.select(
        "protid",
        *[F.coalesce(F.col(f"`{k}_{m}`"), F.lit(0)).alias(f"{k}_{m}") for k, m in pairs],
    )

    def any_of(columns: Sequence[str]):
        cells = [F.col(f"`{c}`") for c in columns]
        return F.greatest(*cells) if len(cells) > 1 else cells[0]

    by_method = base.select(
        "*", *[any_of([f"{k}_{m}" for k in keys]).alias(m) for m in methods]
    )
    sequence, structure = F.col(SEQUENCE_METHOD), F.col(STRUCTURE_METHOD)
    both = (sequence == 1) & (structure == 1)
    label = (
        F.when(both, BOTH_METHODS)
        .when(sequence == 1, SEQUENCE_METHOD)
        .when(structure == 1, STRUCTURE_METHOD)
        .otherwise(no_hit_label or SEQUENCE_METHOD)
    )
    return by_method.select(
        "*",
        F.when(both, 2).otherwise(0).alias("both_methods"),
        label.alias("source_method"),
        *[any_of([f"{k}_{m}" for m in methods]).alias(f"{k}_hit") for k in keys],
    )


def contract_columns(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rename to the column names of the file contract (they hold dots and plus signs)."""
    names = {"both_methods": BOTH_METHODS, "source_method": "source.method"}
    names |= {f"{key}_hit": f"{key}.hit" for key in keys}
    names |= {
        f"{key}_{method}": f"{key}.{method}_"
        for key in keys
        for method in (SEQUENCE_METHOD, STRUCTURE_METHOD)
    }
    return sources.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in sources.columns])
