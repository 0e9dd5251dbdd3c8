"""Protein sequences, one FASTA record per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: longest sequence the folding service accepts.
MAX_FOLDABLE_LENGTH = 400


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``protid, record_id, description, sequence``; a file with other than one record fails."""
    records = F.filter(F.split("value", r"(?m)^>"), lambda part: F.trim(part) != "")
    header = F.trim(F.regexp_extract("record", r"^([^\r\n]*)", 1))
    return (
        spark.read.text(paths, wholetext=True)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("protid"),
            records.alias("records"),
        )
        .select(
            "protid",
            F.when(F.size("records") == 1, F.get("records", F.lit(0)))
            .otherwise(
                F.raise_error(
                    F.concat(F.lit("expected exactly one record in "), F.col("protid"))
                ).cast("string")
            )
            .alias("record"),
        )
        .select(
            "protid",
            F.split_part(header, F.lit(" "), F.lit(1)).alias("record_id"),
            header.alias("description"),
            F.regexp_replace(F.regexp_replace("record", r"^[^\r\n]*", ""), r"\s+", "").alias(
                "sequence"
            ),
        )
    )


def foldable(sequences: DataFrame, longest: int = MAX_FOLDABLE_LENGTH) -> DataFrame:
    """Sequences short enough to be folded."""
    return sequences.where(F.length("sequence") <= longest)
