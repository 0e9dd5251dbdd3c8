"""Readers for delimited text: hit tables, feature tables, lists, scores, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homologrid.schemas import CLUSTER_MEMBERS, MISSING_CELLS, SEQUENCE_HITS, STRUCTURE_HITS


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text cells that stand for a missing value become null."""
    cells = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            column = F.when(~column.isin(MISSING_CELLS), column)
        cells.append(column.alias(field.name))
    return df.select(*cells)


def _typed_text(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, with_position: bool
) -> DataFrame:
    """Headerless TSV: read as text columns, null the missing cells, then cast.

    Casting after the null step keeps ``N/A`` in a number column from failing and
    lets a count written as ``375.0`` become an integer.
    """
    raw = text_cells(spark.read, schema).csv(list(paths) if not isinstance(paths, str) else paths)
    return typed_cells(raw, schema, with_position)


def text_cells(reader, schema: T.StructType):
    """A batch or stream reader set to headerless TSV with text columns only."""
    names = schema.fieldNames()
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.schema(text).option("sep", "\t").option("quote", "")


def typed_cells(raw: DataFrame, schema: T.StructType, with_position: bool = False) -> DataFrame:
    """Text columns with missing cells nulled and the types of ``schema``."""
    cells: list[Column] = []
    for field in schema.fields:
        cell = F.when(~F.col(field.name).isin(MISSING_CELLS), F.col(field.name))
        if isinstance(field.dataType, T.IntegerType):
            cell = cell.cast("double").cast("int")
        elif not isinstance(field.dataType, T.StringType):
            cell = cell.cast(field.dataType)
        cells.append(cell.alias(field.name))
    if with_position:
        # File, then split within the file, then row within the split: the order of the
        # lines, whatever tasks the splits were given to.
        cells.append(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("pos")
        )
    return raw.select(*cells)


def read_structure_hits(
    spark: SparkSession, paths: str | Sequence[str], with_position: bool = False
) -> DataFrame:
    """Structure-search hits, any number of files, empty files included.

    ``with_position`` adds ``pos``, the place of a line among all files by name.
    """
    return _typed_text(spark, paths, STRUCTURE_HITS, with_position)


def read_sequence_hits(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    with_position: bool = False,
) -> DataFrame:
    """Sequence-search hits; ``columns`` gives the order when it is not the usual one."""
    schema = SEQUENCE_HITS
    if columns is not None:
        known = {field.name: field for field in SEQUENCE_HITS.fields}
        schema = T.StructType(
            [known.get(name, T.StructField(name, T.StringType())) for name in columns]
        )
    return _typed_text(spark, paths, schema, with_position)


def columns_of_format(format_string: str) -> list[str]:
    """Column names in a tabular output format string such as ``6 qseqid sacc``."""
    return [word for word in format_string.split() if word != "6"]


def read_cluster_members(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _typed_text(spark, paths, CLUSTER_MEMBERS, with_position=False)


def read_features(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | None = None,
    numbers: Sequence[str] = (),
) -> DataFrame:
    """Feature table with a header.

    Types come from ``schema``, or all columns are text and the ones named in
    ``numbers`` are cast to double; the data is never scanned twice to guess.
    """
    paths = list(paths) if not isinstance(paths, str) else paths
    if schema is not None:
        return missing_to_null(
            spark.read.csv(paths, sep="\t", header=True, schema=schema, enforceSchema=False)
        )
    df = missing_to_null(spark.read.csv(paths, sep="\t", header=True))
    wanted = set(numbers)
    return df.select(
        *[
            (F.col(f"`{c}`").cast("double") if c in wanted else F.col(f"`{c}`")).alias(c)
            for c in df.columns
        ]
    )


def read_ids(spark: SparkSession, paths: str | Sequence[str], keep_file: bool = False) -> DataFrame:
    """Accession list, one id per line; blank lines are kept out."""
    paths = list(paths) if not isinstance(paths, str) else paths
    df = spark.read.text(paths)
    cells = [F.col("value").alias("protid")]
    if keep_file:
        cells.append(F.col("_metadata.file_name").alias("source_file"))
    return df.select(*cells).where(F.col("protid") != "")


def read_pair_scores(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Whitespace-separated ``query target score ...``; anything after the score is ignored.

    The score stays available as written (``score_text``), because two rows of a
    pair conflict when their texts differ.
    """
    paths = list(paths) if not isinstance(paths, str) else paths
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (
        spark.read.text(paths)
        .where(F.trim(F.col("value")) != "")
        .select(
            F.replace(parts[0], F.lit(".pdb"), F.lit("")).alias("query"),
            F.replace(parts[1], F.lit(".pdb"), F.lit("")).alias("target"),
            parts[2].alias("score_text"),
            parts[2].cast("double").alias("score"),
        )
    )


def melt_matrix(df: DataFrame, key: str = "protid") -> DataFrame:
    """Wide matrix (one column per target) to long ``query, target, score``."""
    targets = [c for c in df.columns if c != key]
    cells = [F.col(f"`{c}`").cast("double").alias(c) for c in targets]
    return (
        df.select(F.col(key).alias("query"), *cells)
        .unpivot("query", [f"`{c}`" for c in targets], "target", "score")
    )


def read_matrix(spark: SparkSession, path: str, key: str = "protid") -> DataFrame:
    """All-against-all matrix file, read straight into long form."""
    return melt_matrix(spark.read.csv(path, sep="\t", header=True), key)
