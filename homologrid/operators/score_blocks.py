"""A sparse score table in blocks, and its products with thin matrices.

As joins a product sends every score with a whole row of the thin matrix through a shuffle.  Here queries and targets are
dealt to blocks by a hash of their ids, and the scores of a block of queries with a block of targets are one file of the
shared folder: places in both blocks and scores, shuffled once.  A thin matrix is a file for every block.  The task of a
block reads the files that it meets one after the other and adds up its own rows, so a product shuffles nothing;
it reads the thin matrix once for every block of the other side, some ``BLOCK_SCORES`` scores.

Missing target ids take no part; a missing query id has its row, which counts as 0 in everything but the last product.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.operators.vectors import list_column
from homologrid.staging import StageArea, drop_path

# Scores and rows of a block, about; fewer rows than the last number are not worth a block.
BLOCK_SCORES = 1 << 21
BLOCK_ROWS = 1 << 16
FEW_ROWS = 1 << 12
# Scores of one task that makes the blocks.
TASK_SCORES = 1 << 20
# Numbers of a thin matrix that are worked on at once.
SLICE = 1 << 20

SIDES = ("query", "target")
CELLS = "cell int, amount double"


class Store:
    """Files of a folder that all tasks share."""

    def __init__(self, folder: str):
        self.folder = folder

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        files, base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        return files, f"{base}/{name}"

    def write(self, name: str, data) -> None:
        files, path = self._at(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        # Whole files only come under their name; a task that runs again writes the same.
        part = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(data)
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_file(path)
        files.move(part, path)

    def write_rows(self, name: str, rows: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, rows.schema) as out:
            out.write_table(rows)
        self.write(name, sink.getvalue())

    def rows(self, name: str) -> pa.Table:
        files, path = self._at(name)
        with files.open_input_file(path) as source:
            return pa.ipc.open_file(source.read_buffer()).read_all()

    def write_matrix(self, name: str, matrix: np.ndarray) -> None:
        self.write(name, np.ascontiguousarray(matrix, np.float64).tobytes())

    def matrix(self, name: str, width: int, first: int = 0, rows: int | None = None) -> np.ndarray:
        """A written matrix, or so many of its rows."""
        files, path = self._at(name)
        with files.open_input_file(path) as source:
            source.seek(first * width * 8)
            return np.frombuffer(source.read_buffer(None if rows is None else rows * width * 8), np.float64).reshape(-1, width)


def add_product(out: np.ndarray, row: np.ndarray, column: np.ndarray, score: np.ndarray, thin: np.ndarray) -> None:
    """Add the scores times the rows ``column`` of a thin matrix to the rows ``row``, which are in order."""
    step = max(1, SLICE // max(thin.shape[1], 1))
    for a in range(0, len(row), step):
        own = row[a : a + step]
        firsts = np.flatnonzero(np.diff(own, prepend=-1))
        part = thin[column[a : a + step]]
        part *= score[a : a + step, None]
        out[own[firsts]] += np.add.reduceat(part, firsts, axis=0)


def _cells(matrix: np.ndarray) -> pa.RecordBatch:
    flat = np.ascontiguousarray(matrix).reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "amount"])


def _stacked(store: Store, thin: list[tuple[str, int]], block: int) -> Iterator[list[np.ndarray]]:
    """Rows of the sums and of some thin matrices of a block of targets, slice by slice."""
    sums = store.rows(f"target/{block}")["sum"].to_numpy()
    step = max(1, SLICE // (sum(width for _, width in thin) + 1))
    for a in range(0, len(sums), step):
        own = sums[a : a + step, None]
        yield [own, *[store.matrix(f"{name}/{block}", width, a, len(own)) for name, width in thin]]


class ScoreBlocks:
    """The blocks of a written table ``query, target, score``; ``targets`` has ``protid, sum, start`` of every known target.

    ``gram`` are the second moments of the ``start`` vectors, which become the thin matrix ``draft``.
    """

    def __init__(self, scores: DataFrame, targets: DataFrame, width: int, area: StageArea):
        self.area, self.spark = area, area.spark
        self.store = store = Store(f"{area.root}/blocks")
        self.kind = scores.schema["query"].dataType.simpleString()
        known = scores.where("target IS NOT NULL")
        queries = known.select(F.col("query").alias("protid")).distinct()
        number = known.count()
        self.blocks = tuple(self._blocks(number, side.count()) for side in (queries, targets))

        def keep(side: str, names: list[str]) -> Callable[[pa.Table], pa.Table]:
            def run(rows: pa.Table) -> pa.Table:
                rows = rows.sort_by("protid").combine_chunks()
                block = rows["block"][0].as_py()
                store.write_rows(f"{side}/{block}", rows.select(names))
                if side == "query":
                    return pa.table({"cell": pa.array([0], pa.int32()), "amount": pa.array([float(len(rows))])})
                start = rows["start"].combine_chunks().flatten().to_numpy().reshape(-1, width)
                store.write_matrix(f"draft/{block}", start)
                return pa.Table.from_batches([_cells(start.T @ start)])

            return run

        def dealt(rows: DataFrame, side: int, column: str = "protid") -> F.Column:
            return F.pmod(F.xxhash64(column), F.lit(self.blocks[side])).cast("int")

        # The sides first: the scores are told by their places.
        queries.withColumn("block", dealt(queries, 0)).groupBy("block").applyInArrow(keep("query", ["protid"]), CELLS).collect()
        made = targets.withColumn("block", dealt(targets, 1)).groupBy("block").applyInArrow(keep("target", ["protid", "sum"]), CELLS)
        self.gram = self._summed(made, "start", (width, width))
        across = self.blocks[1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [batch for batch in batches if batch.num_rows]
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            pair = rows["pair"].to_numpy()
            order = np.argsort(pair, kind="stable")
            found, firsts = np.unique(pair[order], return_index=True)
            for one, own in zip(found.tolist(), np.split(order, firsts[1:])):
                part = rows.take(pa.array(own))
                at = []
                for side, block in zip(SIDES, divmod(one, across)):
                    ids = store.rows(f"{side}/{block}")["protid"].combine_chunks()
                    at.append(pc.index_in(part[side].combine_chunks(), value_set=ids).to_numpy())
                by_query = np.lexsort((at[1], at[0]))
                row, column = (x[by_query] for x in at)
                score = pc.fill_null(part["score"], 0.0).to_numpy()[by_query]
                back = np.argsort(column, kind="stable").astype(np.int32)
                store.write_rows(f"scores/{one}", pa.table({"query": row, "target": column, "score": score, "back": back}))
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["pair"])

        pairs = known.select(
            *SIDES, "score", (dealt(known, 0, "query").cast("long") * across + dealt(known, 1, "target")).alias("pair")
        )
        # A stated number of partitions is not merged by size.
        tasks = max(1, math.ceil(number / TASK_SCORES), min(self.spark.sparkContext.defaultParallelism, number // FEW_ROWS))
        filled = pairs.repartition(tasks, "pair").mapInArrow(place, "pair long").collect()
        # Which blocks have scores: one entry for every two blocks.
        self.filled = np.zeros(self.blocks, bool)
        self.filled.reshape(-1)[[r["pair"] for r in filled]] = True

    def _blocks(self, scores: int, rows: int) -> int:
        busy = min(self.spark.sparkContext.defaultParallelism, rows // FEW_ROWS + 1)
        return max(1, busy, math.ceil(scores / BLOCK_SCORES), math.ceil(rows / BLOCK_ROWS))

    def _each(self, side: int, work: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``work`` gives for every block of a side, each in a task of its own."""
        count = self.blocks[side]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    yield from work(block)

        return self.spark.range(0, count, 1, count).mapInArrow(run, schema)

    def _summed(self, cells: DataFrame, label: str, shape: tuple[int, int]) -> np.ndarray:
        written = self.area.write(cells.groupBy("cell").agg(F.sum("amount").alias("amount")), label)
        summed = written.toPandas()
        self.area.forget(written)
        out = np.zeros(shape)
        out.reshape(-1)[summed["cell"].to_numpy()] = summed["amount"].to_numpy()
        return out

    def _product(self, side: int, thin: str, width: int) -> Callable[[int], np.ndarray]:
        """The rows of a block of one side: its scores times the thin matrix of the other side."""
        store, filled, across = self.store, self.filled if side == 0 else self.filled.T, self.blocks[1]

        def run(block: int) -> np.ndarray:
            ids = store.rows(f"{SIDES[side]}/{block}")
            out = np.zeros((len(ids), width))
            for other in np.flatnonzero(filled[block]).tolist():
                query, target = (block, other) if side == 0 else (other, block)
                part = store.rows(f"scores/{query * across + target}")
                row, column, score, back = (part[c].to_numpy() for c in ("query", "target", "score", "back"))
                if side == 1:
                    row, column, score = column[back], row[back], score[back]
                add_product(out, row, column, score, store.matrix(f"{thin}/{other}", width))
            return out

        return run

    def image(self, basis: list[tuple[str, int]], label: str) -> np.ndarray:
        """Writes the scores, both ways, times the last block of a basis as ``image``.

        Gives the moments of basis, sums and image (rows) with sums and image (columns).
        """
        thin, width = basis[-1]
        there, store = self._product(0, thin, width), self.store

        def forth(block: int) -> Iterator[pa.RecordBatch]:
            out = there(block)
            out[pc.is_null(store.rows(f"query/{block}")["protid"]).to_numpy()] = 0.0
            store.write_matrix(f"half/{block}", out)
            yield pa.RecordBatch.from_arrays([pa.array([block])], names=["block"])

        self._each(0, forth, "block long").collect()
        here, size = self._product(1, "half", width), sum(w for _, w in basis)

        def back(block: int) -> Iterator[pa.RecordBatch]:
            store.write_matrix(f"image/{block}", here(block))
            gram = np.zeros((size + 1 + width, 1 + width))
            for own, *parts in _stacked(store, [*basis, ("image", width)], block):
                right = np.hstack([own, parts[-1]])
                gram += np.hstack([*parts[:-1], right]).T @ right
            yield _cells(gram)

        return self._summed(self._each(1, back, CELLS), label, (size + 1 + width, 1 + width))

    def combine(self, thin: list[tuple[str, int]], factors: np.ndarray, name: str, gram: str | None = None) -> np.ndarray | None:
        """Writes ``name``, thin matrices and the sums (the last row of the factors) times factors.

        With ``gram``, the label of a stage, it gives the moments of the thin matrices and the result (rows) with the result.
        """
        store, width = self.store, factors.shape[1]
        size = sum(w for _, w in thin)

        def run(block: int) -> Iterator[pa.RecordBatch]:
            rows, moments = [np.zeros((0, width))], np.zeros((size + width, width))
            for own, *parts in _stacked(store, thin, block):
                left = np.hstack(parts)
                made = left @ factors[:-1] + own * factors[-1]
                rows.append(made)
                if gram:
                    moments += np.hstack([left, made]).T @ made
            store.write_matrix(f"{name}/{block}", np.concatenate(rows))
            yield _cells(moments)

        done = self._each(1, run, CELLS)
        if gram:
            return self._summed(done, gram, (size + width, width))
        done.where("cell < 0").collect()
        return None

    def largest(self, name: str, width: int) -> np.ndarray:
        """The entry of largest magnitude of every column of a thin matrix of the targets."""
        store = self.store

        def run(block: int) -> Iterator[pa.RecordBatch]:
            matrix = store.matrix(f"{name}/{block}", width)
            yield _cells(matrix[np.abs(matrix).argmax(axis=0), np.arange(width)])

        lead = np.zeros(width)
        for row in self._each(1, run, CELLS).collect():
            if abs(row["amount"]) > abs(lead[row["cell"]]):
                lead[row["cell"]] = row["amount"]
        return lead

    def rows(self, name: str, width: int) -> DataFrame:
        """``protid, coords``: the scores of every query, a missing id too, times a thin matrix of the targets."""
        product, store = self._product(0, name, width), self.store

        def run(block: int) -> Iterator[pa.RecordBatch]:
            ids = store.rows(f"query/{block}")["protid"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, list_column(product(block))], names=["protid", "coords"])

        return self._each(0, run, f"protid {self.kind}, coords array<double>")

    def forget(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, f"{self.store.folder}/{name}")
