"""Taxonomic lineages: splitting and ranked categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Broad taxa from most to least specific; the order decides the category.
EUKARYOTE_FOCUS = [
    "Mammalia",
    "Vertebrata",
    "Arthropoda",
    "Ecdysozoa",
    "Lophotrochozoa",
    "Metazoa",
    "Fungi",
    "Viridiplantae",
    "Sar",
    "Excavata",
    "Amoebazoa",
    "Eukaryota",
    "Bacteria",
    "Archaea",
    "Viruses",
]
BACTERIA_FOCUS = [
    "Pseudomonadota",
    "Nitrospirae",
    "Acidobacteria",
    "Bacillota",
    "Spirochaetes",
    "Cyanobacteria",
    "Actinomycetota",
    "Deinococcota",
    "Bacteria",
    "Archaea",
    "Viruses",
    "Metazoa",
    "Fungi",
    "Viridiplantae",
    "Eukaryota",
]
TAXON_FOCUS = {"euk": EUKARYOTE_FOCUS, "bac": BACTERIA_FOCUS}


def lineage_names(lineage: Column) -> Column:
    """``"Eukaryota (superkingdom), Metazoa (kingdom)"`` -> ``["Eukaryota", "Metazoa"]``."""
    return F.transform(
        F.split(lineage, ", "), lambda entry: F.split_part(entry, F.lit(" ("), F.lit(1))
    )


def matching_taxa(lineage: Column, ranked: Sequence[str]) -> Column:
    """The ranked taxa that occur in the lineage, in ranked order."""
    order = F.array(*[F.lit(name) for name in ranked])
    return F.filter(order, lambda name: F.array_contains(lineage, name))


def taxon_category(lineage: Column, ranked: Sequence[str], fallback: str = "Other") -> Column:
    """First ranked taxon that occurs in the lineage."""
    return F.coalesce(F.get(matching_taxa(lineage, ranked), F.lit(0)), F.lit(fallback))


def taxon_labels(
    lineage: Column, ranked: Sequence[str], separator: str = ",", fallback: str = "Other"
) -> Column:
    """All ranked taxa of the lineage, joined."""
    found = F.array_join(matching_taxa(lineage, ranked), separator)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(fallback)).otherwise(found)
