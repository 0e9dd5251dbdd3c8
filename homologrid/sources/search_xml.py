"""Sequence-search XML to the 17-column hit table, with Spark's XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homologrid.schemas import SEQUENCE_HITS

# Accession inside a hit id, and the kept length of a description.
ACCESSION_PATTERN = r"(?:ref\|)?([A-Z0-9_]+)(?:\.\d+)?\|?"
DESCRIPTION_WIDTH = 80
DOCUMENT_PATTERN = r"(?s)<BlastOutput[ >].*</BlastOutput>"


def _text_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


_HSP = T.StructType(
    _text_fields(
        "Hsp_bit-score",
        "Hsp_evalue",
        "Hsp_query-from",
        "Hsp_query-to",
        "Hsp_hit-from",
        "Hsp_hit-to",
        "Hsp_identity",
        "Hsp_gaps",
        "Hsp_align-len",
    )
)
_HIT = T.StructType(
    _text_fields("Hit_id", "Hit_def", "Hit_accession")
    + [T.StructField("Hit_hsps", T.StructType([T.StructField("Hsp", T.ArrayType(_HSP))]))]
)
_ITERATION = T.StructType(
    _text_fields("Iteration_query-def")
    + [T.StructField("Iteration_hits", T.StructType([T.StructField("Hit", T.ArrayType(_HIT))]))]
)
SEARCH_DOCUMENT = T.StructType(
    _text_fields("BlastOutput_query-def")
    + [
        T.StructField(
            "BlastOutput_iterations",
            T.StructType([T.StructField("Iteration", T.ArrayType(_ITERATION))]),
        )
    ]
)


def _ddl(kind: T.DataType) -> str:
    """Schema text with quoted names (they hold hyphens)."""
    if isinstance(kind, T.StructType):
        inner = ", ".join(f"`{f.name}`: {_ddl(f.dataType)}" for f in kind.fields)
        return f"STRUCT<{inner}>"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_ddl(kind.elementType)}>"
    return kind.simpleString()


def read_search_xml(spark: SparkSession, path: str) -> DataFrame:
    """All alignments of the result documents, one document per file.

    Status text around a document is cut off; a file without one (the service was
    still working) gives no rows.
    """
    document = F.regexp_extract("value", DOCUMENT_PATTERN, 0)
    parsed = (
        spark.read.text(path, wholetext=True)
        .select(document.alias("document"))
        .where(F.col("document") != "")
        .select(F.from_xml("document", _ddl(SEARCH_DOCUMENT)).alias("parsed"))
    )
    return alignments(parsed.select("parsed.*"))


def _number(field: str) -> Column:
    return F.coalesce(F.col(f"hsp.`{field}`").cast("double"), F.lit(0.0))


def alignments(documents: DataFrame) -> DataFrame:
    """One row per alignment (document -> iteration -> hit -> alignment)."""
    query = F.coalesce(
        F.col("`BlastOutput_query-def`"),
        F.get(F.col("BlastOutput_iterations.Iteration"), F.lit(0))["Iteration_query-def"],
    )
    rows = (
        documents.select(
            F.split_part(F.trim(query), F.lit(" "), F.lit(1)).alias("qseqid"),
            F.explode("BlastOutput_iterations.Iteration").alias("iteration"),
        )
        .select("qseqid", F.explode("iteration.Iteration_hits.Hit").alias("hit"))
        .select("qseqid", "hit", F.explode("hit.Hit_hsps.Hsp").alias("hsp"))
        .where(F.col("hsp.`Hsp_evalue`").isNotNull() | F.col("hsp.`Hsp_bit-score`").isNotNull())
    )
    hit_id = F.trim(F.coalesce("hit.Hit_id", F.lit("")))
    given = F.trim(F.coalesce("hit.Hit_accession", F.lit("")))
    accession = F.when(given != "", given).otherwise(
        F.regexp_extract(hit_id, ACCESSION_PATTERN, 1)
    )
    length = _number("Hsp_align-len")
    divisor = F.when(length == 0, 1.0).otherwise(length)
    unmatched = divisor.cast("int") - _number("Hsp_identity").cast("int") - _number(
        "Hsp_gaps"
    ).cast("int")
    values = {
        "sseqid": hit_id,
        "pident": F.round(_number("Hsp_identity") * 100.0 / divisor, 3),
        "length": F.col("hsp.`Hsp_align-len`"),
        "mismatch": F.greatest(F.lit(0), unmatched),
        "gapopen": F.coalesce(F.col("hsp.Hsp_gaps"), F.lit("0")),
        "qstart": F.col("hsp.`Hsp_query-from`"),
        "qend": F.col("hsp.`Hsp_query-to`"),
        "sstart": F.col("hsp.`Hsp_hit-from`"),
        "send": F.col("hsp.`Hsp_hit-to`"),
        "evalue": F.col("hsp.Hsp_evalue"),
        "bitscore": F.col("hsp.`Hsp_bit-score`"),
        "sacc": F.when(accession != "", accession),
        "saccver": F.when(accession != "", accession),
        "scomnames": F.translate(
            F.substring(F.trim("hit.Hit_def"), 1, DESCRIPTION_WIDTH), "\t", " "
        ),
    }
    cells = []
    for field in SEQUENCE_HITS.fields:
        value = F.col("qseqid") if field.name == "qseqid" else values.get(field.name, F.lit(None))
        cells.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*cells)
