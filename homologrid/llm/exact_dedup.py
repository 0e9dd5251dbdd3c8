"""Exact dedup by Grace hashing with open-addressing tables over complete contents.

Records are dealt by a 64-bit hash of their content and looked up in an
open-addressing table that compares whole contents, so a hash collision never
joins two texts.  A table holds distinct contents only, up to ``table_bytes``;
rows of contents that no longer fit are partitioned by the next hash bits into
spill files, and each file is handled the same way, recursively.

* Each input partition first collapses its own copies, so a group of copies, however
  large, sends at most one row per partition through the shuffle.
* Those representatives are shuffled by hash, collapsed once more and give every
  partition-local class its group's survivor and size.
* Members learn the outcome by a join on their local class, which is never larger
  than one input partition.

Spill files lie below ``spark.checkpoint.dir``, are written by one task attempt under a
name of its own and go when it has read them; a lost executor only repeats its tasks.

Defined results: null text counts as empty; the row with the largest id stays, a null
id being the smallest; of repeated rows with the same id exactly one stays; an empty
table gives an empty table; further columns of any name and type are kept.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.llm.common import (
    bounded_batches,
    documents,
    extended,
    free_names,
    quoted,
    text_bytes,
    whole_text,
    width,
)
from homologrid.staging import StageArea

TABLE_BYTES = 32 << 20
FAN_OUT_BITS = 4
# What an entry takes besides its content and row.
ENTRY_BYTES = 200
# Replaced rows beyond as many as there are entries, after which they are dropped.
COMPACT_ROWS = 4096


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = self.row_bytes = 0

    def place(self, key: int, content: bytes, may_add: bool) -> int:
        """The entry of a content; -1 when it is absent and may not be added."""
        mask = len(self.slots) - 1
        at = (key ^ (key >> 29)) & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        if not may_add:
            return -1
        self.slots[at] = entry = len(self.hashes)
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content) + self.row_bytes + ENTRY_BYTES
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.hashes):
            at = (key ^ (key >> 29)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


class SpillFiles:
    """The spill files of one level of one task attempt, in shared storage."""

    def __init__(self, root: str, schema: pa.Schema):
        self.schema = schema
        self.files, base = fs.FileSystem.from_uri(root)
        self.folder = f"{base}/{uuid.uuid4().hex}"
        self.files.create_dir(self.folder, recursive=True)
        self.writers: dict[int, tuple] = {}

    def add(self, bucket: int, rows: pa.RecordBatch) -> None:
        if bucket not in self.writers:
            sink = self.files.open_output_stream(f"{self.folder}/{bucket}")
            options = pa.ipc.IpcWriteOptions(compression="lz4")
            self.writers[bucket] = sink, pa.ipc.new_stream(sink, self.schema, options=options)
        self.writers[bucket][1].write_batch(rows)

    def buckets(self) -> Iterator[Iterator[pa.RecordBatch]]:
        for sink, writer in self.writers.values():
            writer.close()
            sink.close()
        for bucket in sorted(self.writers):
            with self.files.open_input_stream(f"{self.folder}/{bucket}") as source:
                yield iter(pa.ipc.open_stream(source))
            self.files.delete_file(f"{self.folder}/{bucket}")

    def drop(self) -> None:
        with contextlib.suppress(FileNotFoundError):
            self.files.delete_dir(self.folder)


def grace(
    batches: Iterator[pa.RecordBatch],
    key: str,
    content: str,
    table_bytes: int,
    spill_root: str,
    level: int = 0,
) -> Iterator[tuple]:
    """Events ``("rows", batch, entries)`` for placed rows and ``("end", table)`` after each table."""
    table, spill = ContentTable(), None
    try:
        for batch in batches:
            keys = batch.column(key).to_pylist()
            contents = text_bytes(batch.column(content))
            # A new entry may keep its whole row beside its content.
            table.row_bytes = batch.nbytes // max(1, len(keys))
            entries = [
                table.place(k, c, table.bytes < table_bytes) for k, c in zip(keys, contents)
            ]
            here = [i for i, e in enumerate(entries) if e >= 0]
            if len(here) == len(entries):
                yield "rows", batch, entries
                continue
            if here:
                yield "rows", batch.take(pa.array(here)), [entries[i] for i in here]
            spill = spill or SpillFiles(spill_root, batch.schema)
            dealt: dict[int, list[int]] = {}
            shift = (64 - FAN_OUT_BITS * (level + 1)) % 64
            for i, e in enumerate(entries):
                if e < 0:
                    dealt.setdefault((keys[i] >> shift) % (1 << FAN_OUT_BITS), []).append(i)
            for bucket, rows in dealt.items():
                spill.add(bucket, batch.take(pa.array(rows)))
        yield "end", table
        del table
        if spill:
            for bucket in spill.buckets():
                yield from grace(bucket, key, content, table_bytes, spill_root, level + 1)
    finally:
        if spill:
            spill.drop()


def _larger(a, b) -> bool:
    """Whether id ``a`` is larger than ``b``; null is the smallest."""
    return a is not None and (b is None or a > b)


def _collapse(names: dict[str, str], columns: list[str], table_bytes: int, spill_root: str):
    """Collapse the copies within one partition: a full row per class, thin rows for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        # Entry -> [best id, copies, stored chunk, row in it]; one list per table.
        state: list[list] = []
        chunks: list[pa.RecordBatch] = []
        stored_rows = 0
        for kind, *event in grace(
            batches, names["key"], names["text"], table_bytes, spill_root
        ):
            if kind == "rows":
                batch, entries = event
                ids = batch.column(names["id"]).to_pylist()
                better: dict[int, int] = {}
                thin_ids, thin_classes = [], []
                for row, (entry, own) in enumerate(zip(entries, ids)):
                    if entry == len(state):
                        state.append([own, 1, -1, -1])
                        better[entry] = row
                        continue
                    best = state[entry]
                    best[1] += 1
                    thin = own
                    if _larger(own, best[0]):
                        thin, best[0] = best[0], own
                        better[entry] = row
                    thin_ids.append(thin)
                    thin_classes.append(base + entry)
                if better:
                    stored = batch.take(pa.array(list(better.values())))
                    for position, entry in enumerate(better):
                        state[entry][2:] = [len(chunks), position]
                    chunks.append(stored)
                    stored_rows += stored.num_rows
                    if stored_rows > 2 * len(state) + COMPACT_ROWS:
                        chunks = [_compacted(chunks, state)]
                        stored_rows = len(state)
                if thin_ids:
                    yield _thin_rows(batch.schema, names, columns, thin_ids, thin_classes)
            else:
                wanted: dict[int, list[int]] = {}
                for entry, (_, _, chunk, _) in enumerate(state):
                    wanted.setdefault(chunk, []).append(entry)
                for chunk, own in wanted.items():
                    rows = chunks[chunk].take(pa.array([state[e][3] for e in own]))
                    chunks[chunk] = None
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(rows.column(c) for c in columns),
                            rows.column(names["key"]),
                            rows.column(names["text"]),
                            pa.array([base + e for e in own], pa.int64()),
                            pa.array([state[e][1] for e in own], pa.int64()),
                        ],
                        names=[*columns, *(names[n] for n in ("key", "text", "class", "copies"))],
                    )
                base += len(state)
                state, chunks, stored_rows = [], [], 0

    return run


def _compacted(chunks: list[pa.RecordBatch], state: list[list]) -> pa.RecordBatch:
    """The current row of every entry in one chunk; rows that larger ids replaced go."""
    firsts = list(accumulate((c.num_rows for c in chunks), initial=0))
    every = pa.Table.from_batches(chunks)
    rows = every.take(pa.array([firsts[e[2]] + e[3] for e in state], pa.int64())).combine_chunks()
    for position, entry in enumerate(state):
        entry[2:] = [0, position]
    return rows.to_batches()[0]


def _thin_rows(schema, names, columns, ids, classes) -> pa.RecordBatch:
    """Rows that only say which id belongs to which class."""
    n = len(ids)
    arrays = [
        pa.array(ids, schema.field(c).type) if c == names["id"] else pa.nulls(n, schema.field(c).type)
        for c in columns
    ]
    arrays += [pa.nulls(n, pa.int64()), pa.nulls(n, schema.field(names["text"]).type)]
    arrays += [pa.array(classes, pa.int64()), pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays(
        arrays, names=[*columns, *(names[k] for k in ("key", "text", "class", "copies"))]
    )


def _settle(names: dict[str, str], table_bytes: int, spill_root: str):
    """Over representatives of all partitions: survivor, size and digest for each local class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Entry -> [best id, its class, copies, classes].
        state: list[list] = []
        for kind, *event in grace(
            batches, names["key"], names["text"], table_bytes, spill_root
        ):
            if kind == "rows":
                batch, entries = event
                id_type = batch.schema.field(names["id"]).type
                columns = [batch.column(names[c]).to_pylist() for c in ("id", "class", "copies")]
                for entry, own, local, copies in zip(entries, *columns):
                    if entry == len(state):
                        state.append([own, local, copies, [local]])
                        continue
                    best = state[entry]
                    best[2] += copies
                    best[3].append(local)
                    if _larger(own, best[0]) or (own == best[0] and local < best[1]):
                        best[:2] = own, local
            elif state:
                digests = [hashlib.sha256(c).hexdigest() for c in event[0].contents]
                flat = [(e, local) for e, s in enumerate(state) for local in s[3]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([local for _, local in flat], pa.int64()),
                        pa.array([state[e][0] for e, _ in flat], id_type),
                        pa.array([state[e][2] for e, _ in flat], pa.int64()),
                        pa.array([state[e][1] == local for e, local in flat], pa.bool_()),
                        pa.array([digests[e] for e, _ in flat], pa.string()),
                    ],
                    names=["class", "keep_id", "group_size", "wins", "text_sha256"],
                )
                state = []

    return run


class ExactDedup:
    """The groups of equal texts of a table.

    ``members()`` has every row's group, ``kept()`` the surviving rows with all columns.
    """

    def __init__(
        self, docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES
    ):
        spark = docs.sparkSession
        bounded_batches(spark)
        area = StageArea(spark, "exact-dedup")
        self.columns, self.id = docs.columns, key
        inner = dict(
            zip(
                ("key", "text", "class", "copies"),
                free_names(docs.columns, "content_key", "content", "content_class", "copies"),
            )
        )
        self.names = inner | {"id": key}
        spill_root = f"{area.root}/spill"
        keyed = docs.select(
            *[F.col(quoted(c)) for c in docs.columns],
            F.xxhash64(whole_text(text)).alias(inner["key"]),
            F.col(quoted(text)).alias(inner["text"]),
        )
        types = f"{inner['key']} long, {inner['text']} string, {inner['class']} long, {inner['copies']} long"
        # The content is a column of its own only on the way through the task.
        columns = [c for c in docs.columns if c != text]
        schema = extended(docs.select(*map(quoted, columns)).schema, types)
        self.local = area.write(
            keyed.drop(text).mapInArrow(
                _collapse(self.names, columns, table_bytes, spill_root), schema
            ),
            "local",
        )
        self.text = text
        outcome = "class long, keep_id {}, group_size long, wins boolean, text_sha256 string".format(
            dict(docs.dtypes)[key]
        )
        self.outcome = area.write(
            self.local.where(F.col(inner["copies"]).isNotNull())
            .select(*[F.col(quoted(self.names[n])) for n in ("id", "key", "text", "class", "copies")])
            .repartition(width(spark), inner["key"])
            .mapInArrow(_settle(self.names, table_bytes, spill_root), outcome),
            "outcome",
        )

    def members(self) -> DataFrame:
        """One row per row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
        local = self.local.select(
            F.col(quoted(self.id)),
            F.col(self.names["class"]).alias("class"),
            F.col(self.names["copies"]).isNotNull().alias("first"),
        )
        return local.join(self.outcome, "class").select(
            F.col(quoted(self.id)),
            "keep_id",
            "group_size",
            (F.col("first") & F.col("wins")).alias("kept"),
            "text_sha256",
        )

    def kept(self) -> DataFrame:
        """The surviving rows, with the columns of the table."""
        winners = self.outcome.where("wins").select(F.col("class").alias(self.names["class"]))
        rows = self.local.where(F.col(self.names["copies"]).isNotNull())
        return rows.join(winners, self.names["class"], "left_semi").select(
            *[
                F.col(self.names["text"] if c == self.text else quoted(c)).alias(c)
                for c in self.columns
            ]
        )


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return ExactDedup(docs).members()


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": OP9_SQL}
