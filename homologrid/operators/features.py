"""Feature tables: N-way assembly on the protein id, cell overrides, joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.functions.scaling import linear_concordance

# Default concordance cut-offs.
CONCORDANCE_EVALUE = 0.001
CONCORDANCE_MIN_SCORE = 0.0

CONCORDANCE_METHODS = {"linear": linear_concordance}


class ColumnClash(ValueError):
    """Two feature tables bring the same column."""


def _cell(name: str):
    return F.col(f"`{name}`")


def check_columns(frames: Sequence[DataFrame], key: str = "protid") -> None:
    seen: dict[str, int] = {}
    for number, frame in enumerate(frames):
        for name in frame.columns:
            if name == key:
                continue
            if name in seen:
                raise ColumnClash(f"column {name!r} is in tables {seen[name]} and {number}")
            seen[name] = number


def _has_repeated_keys(frames: Sequence[DataFrame], key: str) -> bool:
    """Whether any table holds a key twice; ids only, combined before the shuffle."""
    tagged = [frame.select(key, F.lit(i).alias("_frame")) for i, frame in enumerate(frames)]
    repeated = (
        reduce(DataFrame.unionAll, tagged)
        .groupBy(key, "_frame")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    return not repeated.isEmpty()


def assemble_features(
    frames: Sequence[DataFrame], key: str = "protid", unique: bool | None = None
) -> DataFrame:
    """Full outer merge of any number of feature tables on ``key``.

    With unique keys the tables are stacked and folded in one aggregation, so
    each row is shuffled once however many tables there are.  With repeated keys
    the merge multiplies rows, and a chain of full outer joins is used instead.
    Pass ``unique`` to skip the check that picks the plan.
    """
    check_columns(frames, key)
    frames = [frame.where(_cell(key).isNotNull()) for frame in frames]
    if len(frames) == 1:
        return frames[0].distinct()
    if unique is None:
        unique = not _has_repeated_keys(frames, key)
    if not unique:
        merged = reduce(lambda left, right: left.join(right, key, "full"), frames)
        return merged.distinct()
    stacked = reduce(
        lambda top, bottom: top.unionByName(bottom, allowMissingColumns=True), frames
    )
    values = [name for name in stacked.columns if name != key]
    return stacked.groupBy(key).agg(
        *[F.first(_cell(name), ignorenulls=True).alias(name) for name in values]
    )


def override_cells(
    features: DataFrame, override: DataFrame, key: str = "protid", order: Sequence[str] = ()
) -> DataFrame:
    """Replace cells by key.

    Every column the override shares with the table is replaced, missing cells
    included; columns unknown to the table are ignored; the first override row
    of a key counts (in ``order``, or by content when none is given); unknown
    keys are appended as new rows.
    """
    shared = [name for name in override.columns if name != key and name in features.columns]
    sort_by = list(order) or shared
    first = (
        override.where(_cell(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min_by(
                F.struct(F.lit(True).alias("_given"), *[_cell(c).alias(c) for c in shared]),
                F.struct(F.lit(0), *[_cell(c).alias(f"s{i}") for i, c in enumerate(sort_by)]),
            ).alias("_new")
        )
    )
    joined = features.join(first, key, "left")
    cells, added_cells = [], []
    for field in features.schema.fields:
        new = F.col(f"_new.`{field.name}`") if field.name in shared else F.lit(None)
        new = _cell(key) if field.name == key else new.cast(field.dataType)
        added_cells.append(new.alias(field.name))
        if field.name in shared:
            cell = F.when(F.col("_new").isNotNull(), new).otherwise(_cell(field.name))
            cells.append(cell.alias(field.name))
        else:
            cells.append(_cell(field.name))
    # Only the key column is read again to find the unknown keys; the table itself is not
    # shuffled when the override is small.
    known = features.select(key).join(first.select(key), key, "left_semi").distinct()
    added = first.join(known, key, "left_anti")
    return joined.select(*cells).unionAll(added.select(*added_cells))


def concordance(
    scores: DataFrame,
    identities: DataFrame,
    key: str,
    method: str = "linear",
    max_evalue: float = CONCORDANCE_EVALUE,
    min_score: float = CONCORDANCE_MIN_SCORE,
) -> DataFrame:
    """Structural score minus sequence identity for the hits that pass both cut-offs."""
    if method not in CONCORDANCE_METHODS:
        raise ValueError(f"unknown method {method!r}; known: {sorted(CONCORDANCE_METHODS)}")
    value = CONCORDANCE_METHODS[method](_cell(f"TMscore_v_{key}"), _cell(f"fident_v_{key}"))
    return (
        identities.where(_cell(f"evalue_v_{key}") < max_evalue)
        .join(scores.where(_cell(f"TMscore_v_{key}") > min_score), "protid")
        .select("protid", value.alias(f"concordance_v_{key}"))
    )


def attach_coordinates(coordinates: DataFrame, features: DataFrame) -> DataFrame:
    """Coordinates with the features of the same protein."""
    return coordinates.join(features, "protid")


def append_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; columns a table lacks are null."""
    return reduce(lambda top, bottom: top.unionByName(bottom, allowMissingColumns=True), frames)


def columns_like(df: DataFrame, text: str) -> list[str]:
    return [name for name in df.columns if text in name]
