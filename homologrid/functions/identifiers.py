"""Column expressions over identifiers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker and pattern of predicted-model identifiers.
MODEL_MARKER = "-F1-model"
MODEL_PATTERN = "AF-(.*)-F1-model"


def model_name(target: Column) -> Column:
    """The text of a hit target before its first blank."""
    return F.split_part(target, F.lit(" "), F.lit(1))


def is_model(name: Column) -> Column:
    return name.contains(MODEL_MARKER)


def model_accession(name: Column) -> Column:
    """Accession inside a model name, null where the pattern is absent."""
    found = F.regexp_extract(name, MODEL_PATTERN, 1)
    return F.when(found != "", found)


def without_suffix(name: Column, suffix: str = ".pdb") -> Column:
    """Drop one trailing file suffix (a suffix, not a set of characters)."""
    return F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")


def without_all(name: Column, text: str = ".pdb") -> Column:
    return F.replace(name, F.lit(text), F.lit(""))


def file_stem(path: Column, suffix: str = ".pdb") -> Column:
    """File name without folders, up to the first ``suffix``."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit(suffix), F.lit(1))


def padded_label(prefix: str, number: Column, width: Column) -> Column:
    """``prefix`` + number, zero-padded to ``width`` and never cut."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(width, F.length(digits)), "0"))


def truncated(label: Column, width: int = 30) -> Column:
    """Labels longer than ``width`` are cut and marked with dots."""
    return F.when(
        F.length(label) > width, F.concat(F.substring(label, 1, width), F.lit("..."))
    ).otherwise(label)
