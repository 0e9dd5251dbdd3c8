"""Token files with directly addressable codes.

A file holds the ids of whole documents.  An id is split into chunks of ``CHUNK_BITS``, lowest first:
level 0 has the first chunk of every token, level 1 the second of those that go on, and
so forth.  A bitmap per level says which tokens go on; a rank directory has the number of
set bits before every 512 bits.  Token ``i`` is read by one chunk and one rank per
level: a few seeks, no block is decoded.

Layout, little-endian: magic, number of tokens, documents and levels; per level the number of
chunks and the places of chunks, bitmap and directory; then these parts, and the document
directory (ids, whether they are set, start of each document in the file).

Files are written by Spark tasks over documents in ascending order of their id.  A task
writes under a name of its own and renames, so a repeated or doubled task leaves the same file.
The manifest, an ordinary table, is written by Spark.  Where the tokens of a file
begin in the whole corpus follows from the manifest by two-level prefix sums.

Defined results: null text counts as empty; every document ends with the end id; null ids
come first; repeated ids follow each other by a hash of their text; an empty table gives no
files and an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homologrid.llm.chunks import chunk_encoder, parts
from homologrid.llm.common import bounded_batches, documents, quoted, text_bytes, width
from homologrid.staging import StageArea

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
CHUNK_BITS = 8
RANK_BITS = 512
# Tokens after which a file is closed; a longer document is a file of its own.
FILE_TOKENS = 1 << 22
MAGIC = b"DACTOKEN"
HEAD, HEAD_SIZE = "<8sQQQ", 32
LEVEL, LEVEL_SIZE = "<QQQQ", 32


def pack(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """The bytes of a file."""
    left = ids.astype(np.uint32)
    levels = []
    while True:
        rest = left >> np.uint32(CHUNK_BITS)
        goes_on = rest != 0
        bits = np.packbits(goes_on, bitorder="little").tobytes()
        bits += bytes(-len(bits) % (RANK_BITS // 8))
        counts = np.bitwise_count(np.frombuffer(bits, np.uint64)).reshape(-1, RANK_BITS // 64).sum(1, dtype=np.uint64)
        ranks = (np.cumsum(counts, dtype=np.uint64) - counts).astype("<u4").tobytes()
        levels.append((len(left), (left & np.uint32(255)).astype(np.uint8).tobytes(), bits, ranks))
        if not goes_on.any():
            break
        left = rest[goes_on]
    at = HEAD_SIZE + len(levels) * LEVEL_SIZE
    table, body = [], []
    for count, *sections in levels:
        places = []
        for section in sections:
            places.append(at)
            body.append(section)
            at += len(section)
        table.append(struct.pack(LEVEL, count, *places))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    directory = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes()
    directory += starts.astype("<u8").tobytes()
    return b"".join([struct.pack(HEAD, MAGIC, len(ids), len(doc_ids), len(levels)), *table, *body, directory])


class TokenFile:
    """Reads a file by seeks."""

    def __init__(self, source):
        self.source = source
        magic, self.tokens, self.documents, n = struct.unpack(HEAD, self._read(0, HEAD_SIZE))
        if magic != MAGIC:
            raise ValueError("not a token file")
        raw = self._read(HEAD_SIZE, n * LEVEL_SIZE)
        self.levels = [struct.unpack_from(LEVEL, raw, i * LEVEL_SIZE) for i in range(n)]
        count, _, _, ranks = self.levels[-1]
        self.directory_at = ranks + 4 * -(-count // RANK_BITS)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i`` of a level's bitmap."""
        count, _, bits, ranks = self.levels[level]
        block = min(i, count - 1) // RANK_BITS
        before = int.from_bytes(self._read(ranks + 4 * block, 4), "little")
        part = self._read(bits + block * RANK_BITS // 8, RANK_BITS // 8)
        mask = (1 << (i - block * RANK_BITS)) - 1
        return before + (int.from_bytes(part, "little") & mask).bit_count()

    def token(self, i: int) -> int:
        """The id of token ``i``."""
        value = 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value |= self._read(chunks + i, 1)[0] << CHUNK_BITS * level
            if not self._read(bits + i // 8, 1)[0] >> i % 8 & 1:
                return value
            i = self.rank(level, i)
        return value

    def range(self, first: int, n: int) -> np.ndarray:
        """The ids of ``n`` tokens from ``first`` on; reads only their parts of each level."""
        out = np.zeros(n, np.uint32)
        where = np.arange(n)
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            if not len(where):
                break
            own = np.frombuffer(self._read(chunks + first, len(where)), np.uint8)
            out[where] |= own.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            raw = self._read(bits + first // 8, (first + len(where)) // 8 - first // 8 + 1)
            flags = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
            go = flags[first % 8 : first % 8 + len(where)].astype(bool)
            if level + 1 < len(self.levels) and go.any():
                first = self.rank(level, first)
            where = where[go]
        return out

    def directory(self) -> tuple[list, np.ndarray]:
        """The documents' ids and their starts in the file."""
        n = self.documents
        raw = self._read(self.directory_at, 17 * n)
        ids = np.frombuffer(raw[: 8 * n], "<i8").tolist()
        known = raw[8 * n : 9 * n]
        return [i if k else None for i, k in zip(ids, known)], np.frombuffer(raw[9 * n :], "<u8").astype(np.int64)


MANIFEST = "part long, file long, name string, tokens long, documents long"


def write_tokens(
    docs: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the token files below ``folder``; the manifest rows, lazily: running them writes."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    bounded_batches(spark)
    tie = F.xxhash64(quoted(text))
    rows = (
        docs.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(text)).alias("text"), tie.alias("tie"))
        .repartitionByRange(width(spark), "id", "tie")
        .sortWithinPartitions("id", "tie")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        own = chunk_encoder(path)
        held: list[np.ndarray] = []
        ids: list = []
        sizes: list[int] = []
        number = total = 0

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            counts = np.array(sizes, np.int64)
            name = f"{base}/part-{part:06d}-{number:06d}.tokens"
            draft = f"{base}/_{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as sink:
                sink.write(pack(tokens, ids, np.cumsum(counts) - counts))
            files.move(draft, name)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "file": number, "name": name.rsplit("/", 1)[1], "tokens": len(tokens), "documents": len(ids)}]
            )

        for batch in batches:
            at = 0
            every = batch.column("id").to_pylist()
            for texts in parts(text_bytes(batch.column("text"))):
                found, per_text = own.ids(texts)
                place = 0
                for n in per_text.tolist():
                    flat = np.append(found[place : place + n], np.uint32(end_id))
                    place += n
                    if held and total + len(flat) > file_tokens:
                        yield close()
                        held, ids, sizes, number, total = [], [], [], number + 1, 0
                    held.append(flat)
                    ids.append(every[at])
                    sizes.append(len(flat))
                    total += len(flat)
                    at += 1
        if held:
            yield close()

    return rows.mapInArrow(run, MANIFEST)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the tokens of all files before; windows over parts, then files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        manifest.groupBy("part")
        .agg(F.sum("tokens").alias("all"))
        .select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    )
    own = manifest.withColumn("own", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return own.join(bases, "part").select(
        "part", "file", "name", "tokens", "documents", (F.col("base") + F.col("own")).alias("start")
    )


def _opened(folder: str, name: str) -> TokenFile:
    files, base = fs.FileSystem.from_uri(folder)
    return TokenFile(files.open_input_file(f"{base}/{name}"))


def read_documents(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, ``start``, ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                file = _opened(folder, name)
                ids, starts = file.directory()
                raw = memoryview(file.range(0, file.tokens).astype("<u4").tobytes())
                ends = np.append(starts[1:], file.tokens)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(base + starts), pa.array(ends - starts), pa.array(sums, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    spread = with_starts(manifest).select("name", "start").repartition(width(manifest.sparkSession), "name")
    return spread.mapInArrow(
        run, "id long, start long, n_tokens long, ids_crc32 long"
    ).withColumnRenamed("id", key)


def tokens_at(manifest: DataFrame, folder: str, positions: DataFrame) -> DataFrame:
    """``position, token`` of the wanted corpus positions (column ``position``), by random access.

    Files are found by an equi-join on ranges of ``FILE_TOKENS`` positions; positions beyond
    the corpus have no row.
    """
    files = with_starts(manifest).where("tokens > 0")
    first, last = F.floor(F.col("start") / FILE_TOKENS), F.floor((F.col("start") + F.col("tokens") - 1) / FILE_TOKENS)
    spread = files.withColumn("cell", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("tokens"))
    wanted = (
        positions.select(F.col("position").cast("long"))
        .withColumn("cell", F.floor(F.col("position") / FILE_TOKENS).cast("long"))
        .join(spread, "cell")
        .where(inside)
        .select("name", "position", (F.col("position") - F.col("start")).alias("place"))
        .repartition(width(manifest.sparkSession), "name", F.floor(F.col("place") / 65536))
        .sortWithinPartitions("name", "place")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            found = []
            for own, place in zip(batch.column("name").to_pylist(), batch.column("place").to_pylist()):
                if own != name:
                    name, file = own, _opened(folder, own)
                found.append(file.token(place))
            yield pa.RecordBatch.from_arrays(
                [batch.column("position"), pa.array(found, pa.int64())], names=["position", "token"]
            )

    return wanted.mapInArrow(run, "position long, token long")


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    area = StageArea(spark, "token-files")
    place = f"{area.root}/tokens"
    manifest = area.write(write_tokens(documents(spark, folder), place), "manifest")
    return read_documents(manifest, place)


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
