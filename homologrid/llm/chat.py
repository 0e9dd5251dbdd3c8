"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions.

Logs often hold a conversation several times, each snapshot longer than the one before.
Every turn gets the hash of all turns up to it; a conversation whose whole hash is the hash of a
longer one's prefix is a snapshot and goes, by an anti-join; of equal conversations the one
with the smallest id stays.  What remains is rendered turn by turn.

The hash of a prefix is the exclusive-or of hashes of (place, role, text), in two
independent 64-bit halves.  It is associative: turns are placed and hashed in segments of
``SEGMENT_TURNS`` turn numbers, and segments are shifted by what lies before them, so a hot
conversation is not ordered in one task.

Defined results: turns are ordered by turn, role and text, nulls first; a null role renders
as ``unknown`` and a null text as empty, but both differ from the given words when compared; rows
of a null conversation id are one conversation; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homologrid.llm.common import quoted, table
from homologrid.staging import StageArea

SEGMENT_TURNS = 1024
SEEDS = (11, 23)
# The template of a rendered turn.
OPENING, AFTER_ROLE, CLOSING = "<|", "|>\n", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(OPENING), F.coalesce(role, F.lit("unknown")), F.lit(AFTER_ROLE), F.coalesce(text, F.lit("")), F.lit(CLOSING)
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _before(totals: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Per segment, the aggregates over the earlier segments of its conversation."""
    earlier = Window.partitionBy("conv").orderBy(F.asc_nulls_first("segment")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return totals.select(
        F.col("conv").alias("c"),
        F.col("segment").alias("s"),
        *[F.coalesce(F.expr(how).over(earlier), F.lit(0)).alias(name) for name, how in sums.items()],
    )


def prefixes(turns: DataFrame, names=("conv_id", "turn", "role", "text")) -> DataFrame:
    """Every turn with its place (from 1) and the two halves of its prefix hash."""
    conv, turn, role, text = (F.col(quoted(n)) for n in names)
    rows = turns.select(
        conv.alias("conv"),
        turn.alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.floor(turn / SEGMENT_TURNS).cast("long").alias("segment"),
    )
    inside = Window.partitionBy("conv", "segment").orderBy(
        *[F.asc_nulls_first(c) for c in ("turn", "role", "text")]
    )
    match = _same("conv", "c") & _same("segment", "s")
    counted = rows.groupBy("conv", "segment").agg(F.count("*").alias("turns"))
    shifts = _before(counted, {"base": "sum(turns)"})
    placed = (
        rows.withColumn("local", F.row_number().over(inside))
        .join(shifts, match)
        .select("conv", "segment", "turn", "role", "text", (F.col("base") + F.col("local")).alias("place"))
    )
    # Null and empty differ: whether a cell is set is part of what is hashed.
    content = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    for number, seed in enumerate(SEEDS):
        placed = placed.withColumn(f"own{number}", F.xxhash64(F.lit(seed), *content))
    sums = placed.groupBy("conv", "segment").agg(
        *[F.expr(f"bit_xor(own{n})").alias(f"all{n}") for n in range(2)]
    )
    hashes = _before(sums, {f"before{n}": f"bit_xor(all{n})" for n in range(2)})
    upto = Window.partitionBy("conv", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = [
        F.expr(f"bit_xor(own{n})").over(upto).bitwiseXOR(F.col(f"before{n}")).alias(f"hash{n}") for n in range(2)
    ]
    return placed.join(hashes, match).select("conv", "turn", "role", "text", "place", *running)


def collapse(turns: DataFrame, names=("conv_id", "turn", "role", "text")) -> DataFrame:
    """Turns of maximal conversations only: ``conv, place, role, text, turns, copies``.

    ``copies`` counts the conversations equal to the kept one, itself included.
    """
    area = StageArea(turns.sparkSession, "chat")
    hashed = area.write(prefixes(turns, names), "prefixes")
    lengths = hashed.groupBy(F.col("conv").alias("c")).agg(F.max("place").alias("turns"))
    whole = area.write(
        hashed.join(lengths, _same("conv", "c") & (F.col("place") == F.col("turns"))).select(
            "conv", "turns", "hash0", "hash1"
        ),
        "conversations",
    )
    mark = ["turns", "hash0", "hash1"]
    groups = whole.groupBy(*mark).agg(F.count("*").alias("copies"), F.min("conv").alias("kept"))
    # A prefix is proper where its conversation goes on; equal prefixes meet once.
    proper = (
        hashed.join(lengths, _same("conv", "c"))
        .where(F.col("place") < F.col("turns"))
        .select(F.col("place").alias("turns"), "hash0", "hash1")
        .distinct()
    )
    maximal = groups.join(proper, mark, "left_anti").select("kept", "turns", "copies")
    return hashed.join(maximal, _same("conv", "kept")).select(
        "conv", "place", "role", "text", "turns", "copies"
    )


def formatted(turns: DataFrame, names=("conv_id", "turn", "role", "text")) -> DataFrame:
    """Rendered turns of the maximal conversations, in places from 1."""
    return collapse(turns, names).select(
        "conv", "place", "turns", "copies", rendered(F.col("role"), F.col("text")).alias("rendered")
    )


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return formatted(table(spark, folder, "conversations")).withColumnRenamed("conv", "conv_id")


OP5_SQL = """
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS turns, list({'r': role, 't': text} ORDER BY place) AS said
  FROM placed GROUP BY conv_id
), snapshots AS (
  SELECT DISTINCT a.said FROM whole a JOIN whole b
    ON a.said[1] = b.said[1] AND a.turns < b.turns AND a.said = b.said[1:a.turns]
), kept AS (
  SELECT said, min(conv_id) AS conv_id, count(*) AS copies, any_value(turns) AS turns
  FROM whole WHERE said NOT IN (SELECT said FROM snapshots) GROUP BY said
)
SELECT conv_id, CAST(place AS BIGINT) AS place, CAST(turns AS BIGINT) AS turns, CAST(copies AS BIGINT) AS copies,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered
FROM kept JOIN placed USING (conv_id)
"""

QUERIES = {"op5_chat_format": op5_chat_format}
ORACLES = {"op5_chat_format": OP5_SQL}
