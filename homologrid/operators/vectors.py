"""Helpers for numeric vectors held in array columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A matrix shipped to every task (keys, pivots, components) may take this many bytes.
MAX_SHIPPED_BYTES = 64 << 20


def vector_width(df: DataFrame, vector: str) -> int:
    """Length of the vectors, from one row; 0 for an empty table."""
    row = df.select(F.size(vector).alias("d")).first()
    return 0 if row is None else int(row["d"])


def elements(vector: str, width: int) -> list[Column]:
    """The entries of a vector as separate double columns; a shorter vector is an error."""
    return [F.expr(f"CAST(`{vector}`[{i}] AS DOUBLE)") for i in range(width)]


def dot(vector: str, weights: Sequence[float]) -> Column:
    """Dot product with a fixed vector, as one generated expression."""
    terms = [
        f"CAST(`{vector}`[{i}] AS DOUBLE) * {float(weight)!r}D" for i, weight in enumerate(weights)
    ]
    return F.expr(" + ".join(terms) if terms else "0D")


def matrix_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """An Arrow list column as a dense matrix; rows of unequal length are an error."""
    cells = batch.column(batch.schema.get_field_index(column))
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(cells) == 0:
        return flat.reshape(0, 0)
    if cells.null_count or len(flat) % len(cells):
        raise ValueError(f"{column}: vectors must be non-null and of one length")
    width = len(flat) // len(cells)
    lengths = np.diff(cells.offsets.to_numpy())
    if not (lengths == width).all():
        raise ValueError(f"{column}: vectors must be of one length")
    return flat.reshape(len(cells), width)


def list_column(matrix: np.ndarray) -> pa.Array:
    """A dense matrix as an Arrow list column."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(0, rows * width + 1, max(width, 1), dtype=np.int32)[: rows + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def check_shipped(rows: int, width: int, what: str) -> None:
    size = rows * width * 8
    if size > MAX_SHIPPED_BYTES:
        raise ValueError(f"{what}: {rows} x {width} takes {size} bytes, too much to ship to tasks")


def moments(df: DataFrame, vector: str, width: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sum and second-moment matrix of all vectors.

    Every task reduces its rows to one d x d matrix; Spark adds those up entry by
    entry, so the driver receives d x d numbers however many rows there are.
    """
    width = width or vector_width(df, vector)
    if width == 0:
        return 0, np.zeros(0), np.zeros((0, 0))
    check_shipped(width, width, "second moments")
    # Cells of the upper-left (width + 1)^2 block: moments, then sums, then the count.
    side = width + 1
    schema = "cell int, amount double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((side, side))
        for batch in batches:
            block = matrix_of(batch, vector)
            if len(block):
                extended = np.hstack([block, np.ones((len(block), 1))])
                gram += extended.T @ extended
        if gram[-1, -1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(side * side, dtype=np.int32)), pa.array(gram.reshape(-1))],
                names=["cell", "amount"],
            )

    summed = (
        df.select(F.col(vector).cast("array<double>").alias(vector))
        .mapInArrow(partial, schema)
        .groupBy("cell")
        .agg(F.sum("amount").alias("amount"))
        .toPandas()
    )
    gram = np.zeros(side * side)
    gram[summed["cell"].to_numpy()] = summed["amount"].to_numpy()
    gram = gram.reshape(side, side)
    return int(gram[-1, -1]), gram[-1, :-1].copy(), gram[:-1, :-1].copy()
