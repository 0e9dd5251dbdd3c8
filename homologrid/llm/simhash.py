"""SimHash near-dedup by tiled exact comparison.

1. Fingerprints: the majority of the bits of the XXH64 hashes of all word shingles,
   counted with eight packed byte counters per machine word.
2. Equal fingerprints collapse to one (with map-side combining) before anything is compared.
3. Tiles: the 64 bits are cut into fields; fingerprints with the same population
   counts in all fields form a tile.  The Hamming distance is at least the sum of the
   differences of these counts, so tile pairs with a larger sum are skipped.  More
   fields only make tiles smaller; the links are the same for any number.
4. The remaining tile pairs are compared in full by exclusive-or and bit counts, in blocks
   of bounded size.  A block pair emits a spanning forest of its links, not all of them:
   the classes are the same and a dense group stays linear.
5. Connected components give every fingerprint its class.

Defined results: null or wordless text has fingerprint zero, which links like any other;
texts of fewer words than a shingle hash as one whole; repeated rows keep their own
row; null ids are ignored by the smallest id of a class, unless there is no other; an empty table
gives an empty table; further columns of any name and type are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.llm.common import bounded_batches, documents, extended, free_names, quoted, text_bytes
from homologrid.llm.components import components
from homologrid.staging import StageArea

SHINGLE_WORDS = 3
HASH_SEED = 42
RADIUS = 2
# Rows of one side of a comparison; bounds the memory of a task.
TILE_ROWS = 2048
PROBE_ROWS = 16_384
# Fingerprints up to which so many fields are used; beyond, the next number.
FIELDS = ((1 << 15, 2), (1 << 21, 4), (1 << 28, 8), (1 << 63, 16))

_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Bits set in more than half of the shingle hashes; signed, as Spark's long."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), last.tolist())),
        np.uint64,
        n,
    )
    counts = np.zeros((8, 8), np.int64)
    for start in range(0, n, 255):
        part = hashes[start : start + 255]
        for bit in range(8):
            # One byte per lane counts bit ``bit`` of each byte of the hashes.
            lanes = ((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64)
            counts[:, bit] += np.frombuffer(lanes.astype("<u8").tobytes(), np.uint8)
    bits = np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little")
    return int(np.frombuffer(bits.tobytes(), "<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and a signed 64-bit fingerprint."""
    columns = docs.columns
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t) for t in text_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(marks, pa.int64())], names=[*columns, into]
            )

    return docs.mapInArrow(run, extended(docs.schema, f"`{into}` long"))


def _near_offsets(fields: int, radius: int) -> list[list[int]]:
    """All differences of field counts whose absolute values sum to at most ``radius``."""
    found = set()
    for size in range(radius + 1):
        for places in combinations_with_replacement(range(fields), size):
            for signs in product((1, -1), repeat=size):
                offset = [0] * fields
                for place, sign in zip(places, signs):
                    offset[place] += sign
                found.add(tuple(offset))
    # One of each opposite pair is enough: the other tile sees it from its side.
    return sorted(list(o) for o in found if o >= tuple([0] * fields))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links between positions below ``n``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def block_links(residents: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between two blocks of fingerprints."""
    every = np.concatenate((residents, probes))
    a = b = np.empty(0, np.int64)
    step = max(1, (1 << 18) // max(1, len(residents)))
    for start in range(0, len(probes), step):
        part = probes[start : start + step]
        distance = np.bitwise_count(residents[None, :] ^ part[:, None])
        at_probe, at_resident = np.nonzero(distance <= radius)
        a = np.concatenate((a, at_resident))
        b = np.concatenate((b, at_probe + start + len(residents)))
        if len(a) > 1 << 20:
            a, b = _forest(a, b, len(every))
    if not len(a):
        return every[:0], every[:0]
    a, b = _forest(a, b, len(every))
    return every[a], every[b]


def _compare(radius: int):
    def run(group: pa.Table) -> pa.Table:
        marks = group["fingerprint"].to_numpy().view(np.uint64)
        resident = group["resident"].to_numpy(zero_copy_only=False)
        a, b = block_links(marks[resident], marks[~resident], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, fields: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that span every class of fingerprints within ``radius``.

    ``distinct`` holds each ``fingerprint`` once.
    """
    if fields is None:
        n = distinct.count()
        fields = next(f for most, f in FIELDS if n <= most)
    bits = 64 // fields
    mask = (1 << bits) - 1
    counts = [
        F.bit_count(F.shiftrightunsigned("fingerprint", bits * i).bitwiseAND(F.lit(mask)))
        for i in range(fields)
    ]
    marked = distinct.select("fingerprint", F.array(*counts).alias("tile"))
    offsets = F.array(
        *[F.array(*[F.lit(v) for v in o]) for o in _near_offsets(fields, radius)]
    )
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(fields - 1)), lambda i: F.col("tile")[i] + F.col("offset")[i]
    )
    rows = marked.groupBy("tile").agg(F.count("*").alias("rows"))
    # What reaches each tile decides how its two sides are cut into blocks.
    reached = (
        rows.select("tile", "rows", F.explode(offsets).alias("offset"))
        .groupBy(sums.alias("home"))
        .agg(F.sum("rows").alias("reaching"))
    )
    homes = reached.join(rows.withColumnRenamed("tile", "home"), "home").select(
        "home",
        F.ceil(F.col("rows") / TILE_ROWS).alias("blocks"),
        F.ceil(F.col("reaching") / PROBE_ROWS).alias("parts"),
    )
    mixed = F.xxhash64("fingerprint")
    residents = (
        marked.join(homes, F.col("tile") == F.col("home"))
        .select(
            "home",
            F.pmod(mixed, "blocks").alias("block"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
            "fingerprint",
            F.lit(True).alias("resident"),
        )
    )
    probes = (
        marked.select("fingerprint", "tile", F.explode(offsets).alias("offset"))
        .select("fingerprint", sums.alias("home"))
        .join(homes, "home")
        .select(
            "home",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
            F.pmod(mixed, "parts").alias("part"),
            "fingerprint",
            F.lit(False).alias("resident"),
        )
    )
    return (
        residents.union(probes)
        .groupBy("home", "block", "part")
        .applyInArrow(_compare(radius), "a long, b long")
        .where("a <> b")
    )


def classes(marked: DataFrame, area: StageArea, key: str, mark: str, radius: int = RADIUS) -> DataFrame:
    """``marked`` (a written table) with ``component_id``, the smallest id of its class.

    ``class_root`` names the class by its smallest fingerprint.
    """
    named = marked.select(F.col(quoted(mark)).alias("fingerprint"), F.col(quoted(key)).alias("id"))
    smallest = area.write(named.groupBy("fingerprint").agg(F.min("id").alias("least_id")), "distinct")
    roots = components(links(smallest.select("fingerprint"), radius), area)
    rooted = smallest.join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least_id")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.join(least, "root").select(
        F.col("fingerprint").alias("class_mark"), F.col("root").alias("class_root"), "component_id"
    )
    return marked.join(found, F.col(quoted(mark)) == F.col("class_mark")).drop("class_mark")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the fingerprint as 16 hex digits and ``component_id`` of every row."""
    area = StageArea(docs.sparkSession, "simhash")
    marked = area.write(
        with_fingerprints(docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text")))
        .select("doc_id", "fingerprint"),
        "fingerprints",
    )
    return classes(marked, area, "doc_id", "fingerprint").select(
        F.col("doc_id").alias(key),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, one per class."""
    area = StageArea(docs.sparkSession, "simhash")
    mark, number, least = free_names(docs.columns, "fingerprint", "row_number", "least_number")
    marked = area.write(
        with_fingerprints(docs, text, mark).withColumn(number, F.monotonically_increasing_id()),
        "marked",
    )
    thin = marked.select(
        F.col(quoted(key)).alias("id"), F.col(mark).alias("mark"), F.col(number).alias("number")
    )
    found = classes(thin, area, "id", "mark").where(F.col("id").eqNullSafe(F.col("component_id")))
    # Of repeated ids within a class the first row stays.
    first = found.groupBy("class_root").agg(F.min("number").alias(number))
    return marked.join(first.select(number), number, "left_semi").select(
        *[F.col(quoted(c)) for c in docs.columns]
    )


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLES: dict[str, str] = {}
