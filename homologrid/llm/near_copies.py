"""SimHash near-dedup at a stated similarity of shingle sets (0.8 of five-word shingles by default).

At a similarity of 0.8 two 64-bit fingerprints differ in about ten bits, and within such a radius the counts of
set bits exclude almost nothing.  So tiles are made of texts that agree in one of ``BANDS`` bands of
``BAND_ROWS`` minimum hashes; inside a tile fingerprints are compared by exclusive-or and bit counts, sub-tiles
whose population counts differ beyond the radius are skipped, and pairs within the radius are decided by
the exact similarity of their shingle sets.

* Two texts of similarity s share a band with probability 1 - (1 - s^4)^8: 0.985 at 0.8, 0.9998 at 0.9.  The pairs that
  bands or the radius leave out are found afterwards: sets of that similarity share one of the first shingles in any
  common order (a prefix of a fifth of the set at 0.8), so texts of different classes that share one are
  candidates; what their sizes, their profiles (shingles per bucket) and the number of shingles that their prefixes
  share cannot exclude is decided exactly.
* Shingles in more than ``TILE_ROWS`` prefixes come last in that order, and the prefixes are drawn again.  A shingle that
  still is in more meets itself in parts of ``TILE_ROWS``.
* Tiles with equal members are one tile.
* A tile of up to ``TILE_ROWS`` texts is compared in full.  In a larger one everything is first compared with the
  smallest member, in parts; what is not linked to it then meets every member, block by block.
* A tile emits a spanning forest of its links; pairs that are connected already are not decided again.

Defined results: texts with fewer words than a shingle are one shingle; wordless texts, nulls included, are alike;
repeated rows keep one row; of a class the row with the smallest id stays, null ids only where there is no other;
texts of any length are compared in whole; an empty table gives an empty table; further columns of any name are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.llm.common import bounded_batches, extended, free_names, quoted, text_bytes
from homologrid.llm.components import components
from homologrid.llm.simhash import HASH_SEED, fingerprint
from homologrid.operators.vectors import check_shipped
from homologrid.staging import StageArea

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 8, 4
# Ten bits are expected at 0.8, with a deviation of three.
RADIUS = 20
TILE_ROWS = 512
SUB_ROWS = 64
# Rows that one task compares, over all of its tiles.
TASK_ROWS = 2048
# Shingles of a prefix go by so many bits: chance agreements only add candidates.
KEY_BITS = 40
BUCKETS = 256
# Pairs whose profiles are compared at once.
SLICE_PAIRS = 1 << 14

_rng = np.random.default_rng(20)
_FLIPS = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(
        np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    )


def bands(shingles: np.ndarray) -> list[int]:
    """One number per band of minimum hashes; wordless texts agree in all."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    # Runs bound the memory that a long text takes.
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096, None]
        np.minimum(least, ((part ^ _FLIPS) * _FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(rows)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the union of two sorted sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return common / (len(a) + len(b) - common)


def prefix(shingles: np.ndarray, least: float, last: np.ndarray | None = None) -> np.ndarray:
    """The first shingles, by their lowest bits, of which two sets of that similarity share one; ``last`` come last."""
    keys = np.unique(shingles & np.uint64((1 << KEY_BITS) - 1)).view(np.int64)
    if last is not None:
        late = np.isin(keys, last)
        keys = np.concatenate([keys[~late], keys[late]])
    # Shingles that agree in those bits count as one: the prefix only gets longer by the rest.
    return keys[: len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1]


def beyond(shingles: np.ndarray, firsts: np.ndarray, late: np.ndarray | None = None) -> tuple[int, int, int]:
    """The place in the common order where a prefix ends, how many keys follow it, and how many shingles share a key with another."""
    keys = len(np.unique(shingles & np.uint64((1 << KEY_BITS) - 1)))
    if not len(firsts):
        return -1, 0, 0
    end = int(firsts[-1])
    if late is not None and np.isin(end, late):
        end += 1 << KEY_BITS
    return end, keys - len(firsts), len(shingles) - keys


def profile(shingles: np.ndarray) -> bytes:
    """Shingles per bucket, at most 255."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _marked(docs: DataFrame, text: str, names: list[str], words: int, least: float) -> DataFrame:
    """``docs`` with fingerprint, bands, number of shingles, prefix, what lies beyond it, and profile."""
    columns = docs.columns
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(text))
            sets = [shingle_set(t, words) for t in texts]
            firsts = [prefix(s, least) for s in sets]
            more = [
                pa.array([fingerprint(t, words) for t in texts], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(firsts, pa.list_(pa.int64())),
                pa.array([beyond(s, f) for s, f in zip(sets, firsts)], pa.list_(pa.int64())),
                pa.array([profile(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *names])

    kinds = ("long", "array<long>", "long", "array<long>", "array<long>", "binary")
    return docs.mapInArrow(run, extended(docs.schema, ", ".join(f"{quoted(n)} {k}" for n, k in zip(names, kinds))))


def _with_sets(rows: DataFrame, words: int) -> DataFrame:
    """``number, mark, text`` as ``number, mark, shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).tobytes() for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), batch.column("mark"), pa.array(sets, pa.binary())],
                names=["number", "mark", "shingles"],
            )

    return rows.mapInArrow(run, "number long, mark long, shingles binary")


class _Rows:
    """The rows of one tile and the classes found so far."""

    def __init__(self, marks: np.ndarray, sets: list[bytes], radius: int, least: float):
        order = np.argsort(np.bitwise_count(marks), kind="stable")
        self.order, self.marks = order, marks[order]
        self.counts = np.bitwise_count(self.marks).astype(np.int64)
        self.sets = [np.frombuffer(sets[i], np.uint64) for i in order]
        self.radius, self.least = radius, least
        self.label = np.arange(len(marks))
        self.links: list[tuple[int, int]] = []

    def row(self, i: int, others: np.ndarray) -> None:
        """Link position ``i`` with those of ``others`` that are near and not connected yet."""
        others = others[self.label[others] != self.label[i]]
        near = others[np.bitwise_count(self.marks[others] ^ self.marks[i]) <= self.radius]
        for j in near.tolist():
            if self.label[j] != self.label[i] and similarity(self.sets[i], self.sets[j]) >= self.least:
                self.label[self.label == self.label[j]] = self.label[i]
                self.links.append((int(self.order[i]), int(self.order[j])))

    def compare(self, hosts: np.ndarray, guests: np.ndarray) -> None:
        """All hosts with all guests (positions by population count), skipping sub-tiles too far apart."""
        for a in range(0, len(hosts), SUB_ROWS):
            own = hosts[a : a + SUB_ROWS]
            low, high = self.counts[own[0]] - self.radius, self.counts[own[-1]] + self.radius
            for b in range(0, len(guests), SUB_ROWS):
                other = guests[b : b + SUB_ROWS]
                if self.counts[other[-1]] < low or self.counts[other[0]] > high:
                    continue
                for i in own.tolist():
                    self.row(i, other)


def _compare(radius: int, least: float):
    """Links of the tiles of one task: hosts (``host``) with all rows of their tile."""

    def run(table: pa.Table) -> pa.Table:
        numbers = table["number"].to_numpy()
        marks = table["mark"].to_numpy().view(np.uint64)
        host = table["host"].to_numpy(zero_copy_only=False)
        sets = table["shingles"].to_pylist()
        tiles: dict[tuple, list[int]] = {}
        for i, name in enumerate(zip(table["tile"].to_pylist(), table["block"].to_pylist(), table["part"].to_pylist())):
            tiles.setdefault(name, []).append(i)
        a, b = [], []
        for own in tiles.values():
            rows = _Rows(marks[own], [sets[i] for i in own], radius, least)
            hosts = np.flatnonzero(host[own][rows.order])
            rows.compare(hosts, np.arange(len(own)))
            for i, j in rows.links:
                a.append(numbers[own[i]])
                b.append(numbers[own[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links_of(rows: DataFrame, sets: DataFrame, area: StageArea, radius: int, least: float, label: str) -> DataFrame:
    """Written links of ``rows`` (number, tile, block, part, host)."""
    count = rows.count()
    tasks = max(1, count // TASK_ROWS)
    with_sets = rows.join(sets, "number").withColumn(
        "task", F.pmod(F.xxhash64("tile", "block", "part"), F.lit(tasks))
    )
    return area.write(with_sets.groupBy("task").applyInArrow(_compare(radius, least), "a long, b long"), label)


def links(thin: DataFrame, sets_of, area: StageArea, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` between numbers of rows; ``thin`` is a written table (number, mark, bands).

    ``sets_of(numbers)`` gives ``number, mark, shingles`` of the rows with these numbers.
    """
    keyed = thin.select("number", F.posexplode("bands").alias("band", "key")).select(
        "number", F.xxhash64("band", "key").alias("tile")
    )
    members = F.sum(F.xxhash64("number").cast("decimal(38,0)"))
    tiles = (
        keyed.groupBy("tile")
        .agg(F.count("*").alias("rows"), F.min("number").alias("first"), members.alias("members"))
        .where("rows > 1")
    )
    # Of tiles with the same members one is enough.
    once = area.write(tiles.groupBy("rows", "first", "members").agg(F.min("tile").alias("tile")), "tiles")
    zero = F.lit(0).cast("long")
    placed = area.write(
        keyed.join(once.select("tile", "rows", "first"), "tile").select("tile", "rows", "first", "number"), "placed"
    )
    sets = area.write(sets_of(placed.select("number").distinct()), "sets")
    small = placed.where(F.col("rows") <= TILE_ROWS).select(
        "number", "tile", zero.alias("block"), zero.alias("part"), F.lit(True).alias("host")
    )
    large = placed.where(F.col("rows") > TILE_ROWS)
    parts = F.ceil(F.col("rows") / TILE_ROWS)
    own_part = F.pmod(F.xxhash64("number"), parts)
    stars = large.where("number <> first").select(
        "number", "tile", (-zero - 1).alias("block"), own_part.alias("part"), F.lit(False).alias("host")
    )
    every_part = F.explode(F.sequence(zero, parts - 1))
    heads = once.where(F.col("rows") > TILE_ROWS).select(
        F.col("first").alias("number"), "tile", (-zero - 1).alias("block"), every_part.alias("part"), F.lit(True).alias("host")
    )
    found = _links_of(small.unionByName(stars).unionByName(heads), sets, area, radius, least, "links")

    def tidied(out: DataFrame) -> DataFrame:
        for stage in (once, placed, sets):
            area.forget(stage)
        return out

    # What a large tile's smallest member does not reach.
    reached = found.select(F.col("a").alias("first"), F.col("b").alias("number")).union(found.select("b", "a"))
    loose = area.write(
        large.where("number <> first").join(reached.distinct(), ["first", "number"], "left_anti"), "loose"
    )
    if loose.isEmpty():
        return tidied(found)
    sizes = loose.groupBy("tile").agg(F.ceil(F.count("*") / TILE_ROWS).alias("blocks"))
    hosts = loose.join(sizes, "tile").select(
        "number", "tile", F.pmod(F.xxhash64("number"), "blocks").alias("block"), every_part.alias("part"), F.lit(True).alias("host")
    )
    guests = large.join(sizes, "tile").select(
        "number", "tile", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), own_part.alias("part"), F.lit(False).alias("host")
    )
    more = _links_of(hosts.unionByName(guests), sets, area, radius, least, "more-links")
    area.forget(loose)
    return tidied(found.unionByName(more))


def _keyed(thin: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, number, root`` of every shingle of the prefixes; what has no link is its own root."""
    rooted = thin.join(roots.withColumnRenamed("node", "number"), "number", "left")
    return rooted.select(F.explode("prefix").alias("key"), "number", F.coalesce("root", "number").alias("root"))


def _mixed(keyed: DataFrame) -> DataFrame:
    """``key, rows`` of the shingles in prefixes of different classes."""
    sums = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"))
    return sums.where("low < high").select("key", "rows")


def _similar(least: float):
    """Pairs ``a, b`` whose sets ``left`` and ``right`` are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("left", "right"))
            keep = pa.array([similarity(a, b) >= least for a, b in zip(*sides)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _possible(least: float):
    """Pairs ``a, b`` of the tiles of one task, of different classes, whose sizes and profiles allow the similarity.

    Rows of a part of its own (``asks``) meet all rows of another part, or one another.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("key", "part", "other")])
        number, root, size = (table[c].to_numpy() for c in ("number", "root", "size"))
        asks, same = (table[c].to_numpy(zero_copy_only=False) for c in ("asks", "same"))
        profiles = np.frombuffer(b"".join(table["profile"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
        names = np.stack([table[c].to_numpy() for c in ("key", "part", "other")], axis=1)
        starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
        a, b = [], []
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(names)]):
            own = np.arange(first, end)
            left, right = (own, own) if same[first] else (own[asks[own]], own[~asks[own]])
            n, m = size[left][:, None], size[right][None, :]
            fits = (np.minimum(n, m) >= np.maximum(n, m) * least - 1e-6) & (root[left][:, None] != root[right][None, :])
            if same[first]:
                fits = np.triu(fits, 1)
            x, y = np.nonzero(fits)
            for at in range(0, len(x), SLICE_PAIRS):
                i, j = left[x[at : at + SLICE_PAIRS]], right[y[at : at + SLICE_PAIRS]]
                lesser = np.minimum(profiles[i], profiles[j])
                # A full bucket may hold more.
                keep = lesser.sum(axis=1, dtype=np.int64) >= least / (1 + least) * (size[i] + size[j]) - 1e-6
                keep |= (lesser == 255).any(axis=1)
                a.append(np.minimum(number[i], number[j])[keep])
                b.append(np.maximum(number[i], number[j])[keep])
        empty = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    return run


def _enough(met: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` whose sets can have enough in common: ``shared`` keys of the prefixes, and what lies beyond the one that ends first.

    Up to that end both prefixes are complete.
    """
    end, rest, extra = (F.element_at("beyond", i + 1).alias(n) for i, n in enumerate(("end", "rest", "extra")))
    facts = rows.select("number", "size", end, rest, extra)
    both = met
    for side in ("a", "b"):
        both = both.join(facts.select(F.col("number").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in facts.columns[1:]]), side)
    left = F.when(F.col("end_a") <= F.col("end_b"), F.col("rest_a")).otherwise(F.col("rest_b"))
    most = F.col("shared") + left + F.least("extra_a", "extra_b")
    return both.where(most >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-6).select("a", "b")


def links_between(thin: DataFrame, roots: DataFrame, sets_of, area: StageArea, least: float = SIMILARITY) -> DataFrame:
    """Every edge ``(a, b)`` of that similarity between rows of different classes.

    ``thin`` is a written table (number, size, prefix, beyond, profile), ``roots`` has ``node, root`` of the rows with links.
    """
    firsts = thin.select("number", "prefix", "beyond")
    keyed = _keyed(firsts, roots)
    mixed = area.write(_mixed(keyed), "mixed")
    often = np.array([r["key"] for r in mixed.where(F.col("rows") > TILE_ROWS).select("key").collect()], np.int64)
    if len(often):
        check_shipped(len(often), 1, "frequent shingles")
        shared = area.spark.sparkContext.broadcast(np.sort(often))

        def redrawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
                firsts = [prefix(s, least, shared.value) for s in sets]
                after = [beyond(s, f, shared.value) for s, f in zip(sets, firsts)]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (firsts, after)]
                yield pa.RecordBatch.from_arrays([batch.column("number"), *lists], names=["number", "prefix", "beyond"])

        hit = thin.where(F.arrays_overlap("prefix", F.lit(often.tolist()))) if len(often) <= 64 else thin.join(
            thin.select("number", F.explode("prefix").alias("key"))
            .join(F.broadcast(mixed.where(F.col("rows") > TILE_ROWS)), "key", "left_semi").select("number").distinct(),
            "number", "left_semi",
        )
        again = area.write(
            sets_of(hit.select("number")).mapInArrow(redrawn, "number long, prefix array<long>, beyond array<long>"), "redrawn"
        )
        firsts = thin.select("number", "prefix", "beyond").join(again.select("number"), "number", "left_anti").unionByName(again)
        keyed = _keyed(firsts, roots)
        area.forget(mixed)
        mixed = area.write(_mixed(keyed), "mixed-again")
    zero = F.lit(0).cast("long")
    cut = area.write(
        keyed.join(mixed, "key").join(thin.select("number", "size", "profile"), "number")
        .withColumn("parts", F.ceil(F.col("rows") / TILE_ROWS))
        .withColumn("part", F.pmod(F.xxhash64("number"), "parts")),
        "candidates",
    )
    area.forget(mixed)
    # Of two parts of a shingle the lesser one asks; a part also meets itself.
    asking = cut.withColumn("other", F.explode(F.sequence("part", F.col("parts") - 1))).withColumn("asks", F.lit(True))
    asked = (
        cut.withColumn("other", F.col("part"))
        .withColumn("part", F.explode(F.sequence(zero, "part")))
        .where("part < other")
        .withColumn("asks", F.lit(False))
    )
    tasks = max(1, cut.agg(F.sum("parts")).first()[0] or 0) // TASK_ROWS + 1
    tiles = asking.unionByName(asked).select(
        "key", "part", "other", "number", "root", "size", "profile", "asks", (F.col("part") == F.col("other")).alias("same"),
        F.pmod(F.xxhash64("key", "part", "other"), F.lit(tasks)).alias("task"),
    )
    # Two rows meet once in every shingle that their prefixes share.
    met = tiles.groupBy("task").applyInArrow(_possible(least), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = area.write(_enough(met, firsts.join(thin.select("number", "size"), "number"), least), "pairs")
    area.forget(cut)
    numbers = pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct()
    sets = area.write(sets_of(numbers).select("number", "shingles"), "pair-sets")
    both = pairs.join(sets.select(F.col("number").alias("a"), F.col("shingles").alias("left")), "a").join(
        sets.select(F.col("number").alias("b"), F.col("shingles").alias("right")), "b"
    )
    found = area.write(both.select("a", "b", "left", "right").mapInArrow(_similar(least), "a long, b long"), "links-between")
    area.forget(sets)
    return found


def one_of_each_class(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, least: float = SIMILARITY
) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their class of near copies, one per class."""
    area = StageArea(docs.sparkSession, "near-copies")
    names = ["mark", "bands", "size", "prefix", "beyond", "profile"]
    *marks, number = free_names(docs.columns, "fingerprint", *names[1:], "row_number")
    marked = area.write(
        _marked(docs, text, marks, words, least).withColumn(number, F.monotonically_increasing_id()), "marked"
    )
    thin = marked.select(F.col(number).alias("number"), *[F.col(m).alias(n) for m, n in zip(marks, names)])

    def sets_of(numbers: DataFrame) -> DataFrame:
        texts = marked.select(F.col(number).alias("number"), F.col(marks[0]).alias("mark"), F.col(quoted(text)).alias("text"))
        return _with_sets(texts.join(numbers, "number", "left_semi"), words)

    found = links(thin.select("number", "mark", "bands"), sets_of, area, least)
    more = links_between(thin, components(found, area), sets_of, area, least)
    roots = components(found.unionByName(more), area)
    ids = marked.select(F.col(number).alias("node"), F.col(quoted(key)).alias("id"))
    ranked = roots.join(ids, "node").select("node", "root", F.struct(F.col("id").isNull(), "id", "node").alias("rank"))
    first = ranked.groupBy("root").agg(F.min("rank").alias("best"))
    dropped = ranked.join(first, "root").where(F.col("rank")["node"] != F.col("best")["node"]).select(F.col("node").alias(number))
    return marked.join(dropped, number, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
