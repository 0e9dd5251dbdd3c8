"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


# Rows of whole texts in one Arrow batch, where the session has not chosen.
BATCH_ROWS = 512
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: Spark's default of 10,000 rows suits short cells."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def whole_text(column: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(quoted(column)), F.lit(""))


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names for internal use that no given column has, in any case."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: what the session deals shuffles by."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def extended(schema: StructType, more: str) -> StructType:
    """A schema with all fields nullable and further ones behind them."""
    out = StructType()
    for field in schema.fields:
        out = out.add(field.name, field.dataType, True)
    for field in StructType.fromDDL(more).fields:
        out = out.add(field)
    return out


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def kept_by_worker(key: tuple, build):
    """What ``build()`` makes, made once per Python process and key; another key's object goes.

    Functions of this package travel to the tasks by value, so their modules'
    own variables do not outlive a task; this store does.
    """
    store = sys.modules.setdefault("_homologrid_kept", types.ModuleType("_homologrid_kept")).__dict__
    held = store.setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = build()
    return held[key]
