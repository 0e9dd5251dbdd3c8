"""Hit lists: extraction, first-seen order, best hits, filters, set algebra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homologrid.functions.identifiers import is_model, model_accession, model_name
from homologrid.functions.scaling import percent_to_fraction, truncated_int

# Default cut-offs.
HIT_EVALUE = 0.01


def model_hits(hits: DataFrame) -> DataFrame:
    """Hits on predicted models, with the accession as ``protid``."""
    named = hits.withColumn("modelid", model_name(F.col("target")))
    return (
        named.where(is_model(F.col("modelid")))
        .withColumn("protid", model_accession(F.col("modelid")))
        .where(F.col("protid").isNotNull())
        .drop("modelid")
    )


def first_seen(df: DataFrame, key: str, position: Column | Sequence[Column]) -> DataFrame:
    """Distinct non-null keys with the position of their first row (``pos``)."""
    spot = F.struct(*position) if isinstance(position, (list, tuple)) else position
    placed = df.where(F.col(key).isNotNull()).select(key, spot.alias("pos"))
    return placed.groupBy(key).agg(F.min("pos").alias("pos"))


def capped(df: DataFrame, limit: int | None, order: Sequence[Column | str]) -> DataFrame:
    """The first ``limit`` rows in a stated order (a top-k, never a full sort)."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def extract_structure_hits(
    hits: DataFrame,
    position: Column | Sequence[Column],
    max_evalue: float = HIT_EVALUE,
    limit: int | None = None,
) -> DataFrame:
    """Distinct model accessions below the e-value bound, in first-seen order."""
    kept = model_hits(hits.where(F.col("evalue") < max_evalue))
    return capped(first_seen(kept, "protid", position), limit, ["pos", "protid"])


def extract_sequence_hits(
    hits: DataFrame, position: Column | Sequence[Column], accession: str = "sacc"
) -> DataFrame:
    """Distinct accessions of a sequence search, in first-seen order."""
    return first_seen(hits, accession, position)


class NoHitsError(RuntimeError):
    """A search returned nothing and empty results were not allowed."""


def require_hits(hits: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Stop a run whose search came back empty, unless that is accepted."""
    if not allow_empty and hits.isEmpty():
        raise NoHitsError("no hits were returned")
    return hits


def best_hits(hits: DataFrame) -> DataFrame:
    """One row per accession: lowest e-value, then highest prob, then highest fident.

    A minimum over a struct is combined before the shuffle, so one accession
    holding most rows costs no more than any other.
    """
    ranked = F.struct(
        F.col("evalue").alias("evalue"),
        (-F.col("prob")).alias("neg_prob"),
        (-F.col("fident")).alias("neg_fident"),
    )
    best = model_hits(hits).groupBy("protid").agg(F.min(ranked).alias("best"))
    return best.select(
        "protid",
        (-F.col("best.neg_prob")).alias("prob"),
        F.col("best.evalue").alias("evalue"),
        (-F.col("best.neg_fident")).alias("fident"),
    )


def identity_features(hits: DataFrame, key: str) -> DataFrame:
    """Sequence identity to one key protein, as features named after the key."""
    return best_hits(hits).select(
        "protid",
        F.col("prob").alias(f"prob_v_{key}"),
        F.col("evalue").alias(f"evalue_v_{key}"),
        percent_to_fraction(F.col("fident")).alias(f"fident_v_{key}"),
    )


def union_ids(lists: Sequence[DataFrame], column: str = "protid") -> DataFrame:
    """Distinct ids of any number of lists, in one shuffle."""
    return reduce(DataFrame.unionAll, [ids.select(column) for ids in lists]).distinct()


def filter_candidates(
    features: DataFrame,
    min_length: int = 0,
    max_length: int = 0,
    excluded: DataFrame | None = None,
    drop_inactive: bool = True,
    drop_fragments: bool = True,
) -> DataFrame:
    """Active, non-fragment proteins with a length strictly between the bounds.

    A bound of 0 is no bound.  Missing cells are not fragments and not deleted.
    """
    if min_length > max_length and max_length != 0:
        raise ValueError("the minimum length must not exceed the maximum length")
    kept = features
    if drop_inactive:
        kept = kept.where(
            ~F.col("`Protein names`").eqNullSafe("deleted") & F.col("Annotation").isNotNull()
        )
    if drop_fragments:
        kept = kept.where(~F.col("Fragment").eqNullSafe("fragment"))
    length = truncated_int(F.col("Length"))
    if min_length > 0:
        kept = kept.where(length > min_length)
    if max_length > 0:
        kept = kept.where(length < max_length)
    if excluded is not None:
        kept = kept.join(excluded.select("protid"), "protid", "left_anti")
    return kept


def pending_ids(requested: DataFrame, fetched: DataFrame, column: str = "protid") -> DataFrame:
    """Requested ids that have not been fetched yet."""
    return requested.select(column).distinct().join(
        fetched.select(column), column, "left_anti"
    )


def map_ids(ids: DataFrame, mapping: DataFrame, column: str = "protid") -> DataFrame:
    """Translate ids through a 1:n mapping; the result is distinct."""
    distinct_ids = ids.select(F.col(column).alias("from")).distinct()
    pairs = mapping.where(F.col("to").isNotNull()).select("from", "to").distinct()
    return pairs.join(distinct_ids, "from", "left_semi").select(F.col("to").alias(column)).distinct()


def missing_keys(keys: DataFrame, known: DataFrame, column: str = "protid") -> DataFrame:
    """Key ids that are not among the known ids; must be empty for a valid run."""
    return keys.select(column).distinct().join(known.select(column), column, "left_anti")
