"""Mixing sources to target weights: blocks, drawn slots and index permutations.

All of it is DataFrame functions.

1. *Targets.* Sources in code-point order (null last) get cyclic weights and share the
   budget, all words of the table, by weight; a target stops at ``max_passes`` times its source and
   the excess is shared again among the others.  This has a closed form: ordered by
   size over weight, the stopped sources are a prefix.
2. *Blocks.* The words of a source, in a fixed order of its documents, are packed into blocks
   of ``block`` words; only the last block of a source is shorter.  Offsets are prefix sums
   over hashed chunks of documents, so a hot source is not ordered in one task.
3. *Draw.* A source with target ``t`` owns as many slots as blocks make ``t`` words; its last
   slot is cut to the words that are left.  One pseudorandom permutation deals the slots of
   all sources to output shards of ``shard_slots`` slots: the counts of a shard are a multinomial
   draw, conditioned on every source meeting its target in total.
4. *Slots to blocks.* Slot ``k`` of a source with ``n`` whole blocks reads, in pass ``k / n``, the block
   that the pass's own permutation gives for ``k % n``.  The permutations are small
   Feistel networks over mixed radices with cycle walking: nothing is sorted or stored.
5. Slots and document pieces meet by an equi-join on (source, block).

Reruns agree: everything follows from the rows and ``seed``.

Defined results: null text has size 0; documents without words are listed with 0 taken words and
are in no mix; null sources are one source, last in order; repeated rows and null ids are rows of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homologrid.llm.common import WORD, documents, free_names, quoted, whole_text, width
from homologrid.staging import StageArea

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 1024
SHARD_SLOTS = 1024
CHUNK_DOCUMENTS = 50_000
SEED = 17
# Steps of a cycle walk; a step fails with a chance below 1 / sqrt(n).
WALK = 24


def _permuted(index: Column, n: Column, *key: Column) -> Column:
    """A bijection of the whole numbers below ``n``, chosen by ``key``."""
    left = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    right = F.ceil(n.cast("double") / left).cast("long")

    def rounds(value: Column) -> Column:
        a, b = F.pmod(value, left), F.floor(value / left).cast("long")
        for number in range(2):
            a = F.pmod(a + F.pmod(F.xxhash64(*key, F.lit(2 * number), b), left), left)
            b = F.pmod(b + F.pmod(F.xxhash64(*key, F.lit(2 * number + 1), a), right), right)
        return b * left + a

    # Both halves cover slightly more than n: walk on until the value is inside.
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        rounds(index),
        lambda value, _: F.when(value < n, value).otherwise(rounds(value)),
    )
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(walked)


def targets(sizes: DataFrame, weights=WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    Windows run over this table of one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    share = (passes * F.col("source_size")) / F.col("weight")
    fill = Window.orderBy("share", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        F.sum("source_size").over(every)
        - passes * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(after)
    # The level at the first source that does not stop; sources before it stop.
    stops = F.col("share") <= F.col("level")
    rated = (
        sizes.withColumn("weight", weight)
        .withColumn("share", share)
        .withColumn("level", level)
        .withColumn("own_level", F.when(~stops, F.col("level")))
    )
    final = F.first("own_level", ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return rated.withColumn("final", final).select(
        "source",
        "source_size",
        F.least(
            (passes * F.col("source_size")).cast("double"),
            F.coalesce(F.col("final") * F.col("weight"), (passes * F.col("source_size")).cast("double")),
        ).alias("target"),
    )


class Mix:
    """A mix of ``docs``: sizes, targets, slots and what is taken of each document."""

    def __init__(
        self,
        docs: DataFrame,
        key: str = "doc_id",
        text: str = "text",
        source: str = "source",
        weights=WEIGHTS,
        passes: int = MAX_PASSES,
        block: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS,
        seed: int = SEED,
        area: StageArea | None = None,
    ):
        self.block, self.passes, self.seed, self.shard_slots = block, passes, seed, shard_slots
        self.area = area or StageArea(docs.sparkSession, "mix")
        rows = docs.select(
            F.col(quoted(key)).alias("id"),
            F.col(quoted(source)).alias("source"),
            F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(quoted(key), quoted(text)).alias("mixed"),
        )
        self.rows = self.area.write(rows, "sizes")
        chunks = 1 + self.rows.count() // CHUNK_DOCUMENTS
        self.placed = self.area.write(self._placed(chunks), "placed")
        self.sources = self.area.write(self._sources(weights), "sources")
        self.slots = self.area.write(self._slots(), "slots")

    def _placed(self, chunks: int) -> DataFrame:
        """Rows with ``start``, their first word's place in the word stream of their source."""
        chunked = self.rows.withColumn("chunk", F.pmod("mixed", F.lit(chunks)))
        totals = chunked.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("source").orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1
        )
        bases = totals.select(
            F.col("source").alias("base_source"),
            F.col("chunk").alias("base_chunk"),
            F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("base"),
        )
        inside = Window.partitionBy("source", "chunk").orderBy("id", "mixed")
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        local = chunked.withColumn(
            "local", F.coalesce(F.sum("size").over(earlier), F.lit(0))
        ).withColumn("place", F.row_number().over(inside))
        same = F.col("source").eqNullSafe(F.col("base_source")) & (
            F.col("chunk") == F.col("base_chunk")
        )
        return local.join(bases, same).select(
            "id", "source", "size", "mixed", "chunk", "place", (F.col("base") + F.col("local")).alias("start")
        )

    def _sources(self, weights) -> DataFrame:
        """One row per source: target in words, whole passes, slots and where its slots begin."""
        sizes = self.placed.groupBy("source").agg(F.sum("size").alias("source_size"))
        shared = targets(sizes, weights, self.passes)
        size, block = F.col("source_size"), F.lit(self.block)
        words = F.round("target").cast("long")
        blocks = F.ceil(size / block).cast("long")
        whole = F.floor(F.try_divide(F.col("words"), size)).cast("long")
        left = F.col("words") - F.col("whole") * size
        slots = F.col("whole") * F.col("blocks") + F.ceil(F.col("left") / block).cast("long")
        first = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(
            Window.unboundedPreceding, -1
        )
        return (
            shared.withColumn("words", words)
            .withColumn("blocks", blocks)
            .withColumn("full_blocks", F.floor(size / block).cast("long"))
            .withColumn("whole", F.coalesce(whole, F.lit(0).cast("long")))
            .withColumn("left", left)
            .withColumn("slots", slots)
            .withColumn("first_slot", F.coalesce(F.sum("slots").over(first), F.lit(0)))
        )

    def _slots(self) -> DataFrame:
        """One row per slot: shard, place in it, source, pass, block and words taken from its start."""
        total = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
        runs = self.sources.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("slots") / 4096))).alias("run"))
        each = (
            runs.repartition(width(self.placed.sparkSession), F.col("source"), F.col("run"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("step"))
            .withColumn("slot", F.col("run") * 4096 + F.col("step"))
            .where("slot < slots")
        )
        passed = F.floor(F.col("slot") / F.col("blocks")).cast("long")
        number = F.col("slot") - F.col("passed") * F.col("blocks")
        # The short last block keeps its place at the end of a pass; the others are permuted.
        block = F.when(F.col("number") >= F.col("full_blocks"), F.col("full_blocks")).otherwise(
            _permuted(F.col("number"), F.col("full_blocks"), F.lit(self.seed), F.col("source"), F.col("passed"))
        )
        own = F.least(F.lit(self.block), F.col("source_size") - F.col("index") * self.block)
        words = F.when(F.col("passed") < F.col("whole"), own).otherwise(
            F.least(own, F.col("left") - F.col("number") * self.block)
        )
        dealt = _permuted(
            F.col("first_slot") + F.col("slot"), F.lit(total).cast("long"), F.lit(self.seed), F.lit("shards")
        )
        return (
            each.withColumn("passed", passed)
            .withColumn("number", number)
            .withColumn("index", block)
            .withColumn("words", words)
            .withColumn("dealt", dealt)
            .select(
                F.floor(F.col("dealt") / self.shard_slots).alias("shard"),
                F.pmod("dealt", F.lit(self.shard_slots)).alias("position"),
                "source",
                F.col("passed").alias("pass"),
                F.col("index").alias("block"),
                "words",
            )
        )

    def pieces(self) -> DataFrame:
        """Documents cut at the bounds of blocks: ``begin`` to ``end`` are words of the source."""
        first = F.floor(F.col("start") / self.block).cast("long")
        last = F.floor((F.col("start") + F.col("size") - 1) / self.block).cast("long")
        cut = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        return cut.withColumn(
            "begin", F.greatest("start", F.col("block") * self.block)
        ).withColumn(
            "end", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        )

    def taken_pieces(self) -> DataFrame:
        """One row per slot and piece of a document in it, with the words that the slot takes."""
        slots = self.slots.select(
            F.col("source").alias("slot_source"), F.col("block").alias("slot_block"), "shard", "position", "pass", "words"
        )
        same = F.col("source").eqNullSafe(F.col("slot_source")) & (
            F.col("block") == F.col("slot_block")
        )
        upto = F.least(F.col("end"), F.col("block") * self.block + F.col("words"))
        return (
            self.pieces()
            .join(slots, same)
            .withColumn("upto", upto)
            .where("upto > begin")
            .select(
                "id", "source", "size", "chunk", "place", "start", "shard", "position", "pass", "begin", "upto"
            )
        )

    def shards(self) -> DataFrame:
        """The draw: per output shard and source its slots and words.

        All slots are dealt to shards by one permutation, so the counts of a shard are a multinomial draw
        conditioned on the totals of the sources.
        """
        return self.slots.groupBy("shard", "source").agg(F.count("*").alias("slots"), F.sum("words").alias("words"))

    def shard_pieces(self) -> DataFrame:
        """The content of the output shards: pieces of documents by ``shard``, ``position`` and ``begin``."""
        return self.taken_pieces().select(
            "shard", "position", "begin", "source", "pass", "id",
            (F.col("begin") - F.col("start")).alias("first_word"),
            (F.col("upto") - F.col("begin")).alias("words"),
        )

    def taken(self) -> DataFrame:
        """Of every row ``id, source, size, source_size, target, taken``, and the output shards that hold it."""
        words = self.taken_pieces().groupBy(
            F.col("source").alias("s"), F.col("chunk").alias("c"), F.col("place").alias("p")
        ).agg(
            F.sum(F.col("upto") - F.col("begin")).alias("taken"),
            F.count("*").alias("pieces"),
            F.min("shard").alias("first_shard"),
            F.max("shard").alias("last_shard"),
        )
        same = (
            F.col("source").eqNullSafe(F.col("s"))
            & (F.col("chunk") == F.col("c"))
            & (F.col("place") == F.col("p"))
        )
        sources = self.sources.select(F.col("source").alias("of"), "source_size", "target")
        return (
            self.placed.join(words, same, "left")
            .join(sources, F.col("source").eqNullSafe(F.col("of")))
            .select(
                "id", "source", "size", "source_size", "target",
                F.coalesce("taken", F.lit(0)).alias("taken"),
                F.coalesce("pieces", F.lit(0)).alias("pieces"),
                "first_shard", "last_shard",
            )
        )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row per document and pass over it.

    A pass that takes a document whole repeats its row; one that takes parts of it keeps
    the words of these parts, space-joined in their order, and counts ``n_chars`` anew.
    """
    text = settings.get("text", "text")
    mix = Mix(docs, **settings)
    key, source = settings.get("key", "doc_id"), settings.get("source", "source")
    mark, number, begins, ends, whole, tag = free_names(
        docs.columns, "mixed_mark", "mixed_number", "mixed_begins", "mixed_ends", "mixed_whole", "mixed_tag"
    )
    # Equal rows share a mark: they are numbered alike on both sides, one row each.
    slices = (
        mix.taken_pieces()
        .groupBy("source", "chunk", "place", "pass", "id", "size", "start")
        .agg(
            F.sum(F.col("upto") - F.col("begin")).alias("words"),
            F.array_sort(F.collect_list(F.struct(F.col("begin") - F.col("start"), F.col("upto") - F.col("begin")))).alias("parts"),
        )
    )
    marks = mix.placed.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), F.col("place").alias("p"), F.col("mixed").alias(mark), F.col("id").alias("i")
    )
    alike = Window.partitionBy(mark).orderBy(
        F.col("i").asc_nulls_first(), F.col("s").asc_nulls_last(), "c", "p"
    )
    marks = marks.withColumn(number, F.row_number().over(alike))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")) & (F.col("place") == F.col("p"))
    chosen = slices.join(marks, same).select(
        F.col("id").alias(tag), F.col(mark).alias(begins), F.col(number).alias(ends), F.struct("words", "size", "parts").alias(whole)
    )
    own = Window.partitionBy(mark).orderBy(
        F.col(quoted(key)).asc_nulls_first(), F.col(quoted(source)).asc_nulls_last()
    )
    given = docs.withColumn(mark, F.xxhash64(quoted(key), quoted(text))).withColumn(
        number, F.row_number().over(own)
    )
    # The number is a condition beside the key, so that the window's shuffle of whole texts
    # serves the join too.
    joined = given.join(
        chosen, (F.col(mark) == F.col(begins)) & (F.col(number) - F.col(ends) == 0)
    )
    words = F.regexp_extract_all(F.col(quoted(text)), F.lit(WORD), F.lit(0))
    kept = F.flatten(
        F.transform(
            F.col(whole)["parts"],
            lambda part: F.slice(words, part["col1"].cast("int") + 1, part["col2"].cast("int")),
        )
    )
    complete = F.col(whole)["words"] == F.col(whole)["size"]
    # In two steps, so that the words are cut out once.
    cut = joined.withColumn(
        tag, F.when(complete, F.col(quoted(text))).otherwise(F.array_join(kept, " "))
    )
    out = {text: F.col(tag)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(complete, F.col("n_chars")).otherwise(
            F.length(tag).cast(dict(docs.dtypes)["n_chars"])
        )
    return cut.select(*[out.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


def op3_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return Mix(documents(spark, folder)).taken().select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "pieces", "first_shard", "last_shard"
    )


QUERIES = {"op3_mixing_sources": op3_mixing_sources}
ORACLES: dict[str, str] = {}
