"""Text writers for the file contracts; Parquet is used everywhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str) -> None:
    """TSV with header.  Lists are written as JSON; an empty table keeps its header."""
    cells = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        cells.append(column.alias(field.name))
    flat = df.select(*cells)
    if flat.isEmpty():
        flat = flat.coalesce(1)
    flat.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_ids(df: DataFrame, path: str, column: str = "protid") -> None:
    df.select(F.col(f"`{column}`").cast("string")).write.mode("overwrite").text(path)
