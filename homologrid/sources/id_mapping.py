"""Identifier-mapping payloads (JSON) as ``from, to`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLAT = T.ArrayType(
    T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType())])
)
PAYLOAD = T.StructType([T.StructField("results", _FLAT)])


def _target_id(value: Column) -> Column:
    """The target is either the id itself or an object with a primary accession."""
    return F.coalesce(F.get_json_object(value, "$.primaryAccession"), value)


def mapping_rows(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Explode payload documents; a nested ``to`` arrives as JSON text and is opened."""
    return (
        payloads.select(F.from_json(column, PAYLOAD).alias("payload"))
        .select(F.inline("payload.results"))
        .select("from", F.trim(_target_id(F.col("to"))).alias("to"))
    )


def read_id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Payload files (one JSON document each)."""
    return mapping_rows(spark.read.text(path, wholetext=True))
