"""Plot-ready tables: fills, rounding, hover text, categories, colours, ranges."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homologrid.functions.scaling import rounded
from homologrid.functions.taxa import TAXON_FOCUS, taxon_category
from homologrid.functions.words import wrapped
from homologrid.operators.ordering import dense_codes

# Fills of missing cells, score ranges, axis margin, legend limit and the
# marker text of missing categories.
MISSING_LABEL = "None"
MISSING_SCORE = -0.01
MISSING_CONCORDANCE = -1.01
MISSING_CONFIDENCE = -1.0
AXIS_MARGIN = 0.07
LEGEND_LIMIT = 50
HOVER_WIDTH = 40
HOVER_RULE = "––––––––––––"

HOVER, CATEGORY, NUMBER, TAXON = "hovertext", "categorical", "continuous", "taxonomic"


@dataclass(frozen=True)
class ColumnRule:
    """How one feature column is filled, transformed, labelled and coloured."""

    column: str
    kind: str
    label: str
    fill: object = None
    transform: Callable[[Column], Column] | None = None
    low: float | None = None
    high: float | None = None
    taxa: Sequence[str] = field(default_factory=tuple)
    in_hover: bool = True
    palette: dict[str, str] | None = None


def plotting_rules(
    focus: str = "euk", keys: Sequence[str] = (), wrap_text: bool = True, decimals: int = 4
) -> list[ColumnRule]:
    """The rules of the standard columns, then four per key protein, in display order."""
    if focus not in TAXON_FOCUS:
        raise ValueError(f"unknown taxon focus {focus!r}; known: {sorted(TAXON_FOCUS)}")

    def wrap(column: Column) -> Column:
        return wrapped(column, HOVER_WIDTH) if wrap_text else column

    def short(column: Column) -> Column:
        return rounded(column, decimals)

    rules = [
        ColumnRule("Protein names", HOVER, "Protein name", "", wrap),
        ColumnRule("Gene Names (primary)", HOVER, "Gene name", "", wrap),
        ColumnRule("Organism", HOVER, "Organism", "", wrap),
        ColumnRule("LeidenCluster", CATEGORY, "Leiden cluster", MISSING_LABEL),
        ColumnRule(
            "Annotation",
            CATEGORY,
            "Annotation score",
            0,
            lambda c: c.cast("double").cast("int").cast("string"),
        ),
        ColumnRule(
            "Lineage", TAXON, "Broad taxon", [], taxa=tuple(TAXON_FOCUS[focus]), in_hover=False
        ),
        ColumnRule("Length", NUMBER, "Length", 0),
        ColumnRule("source.method", CATEGORY, "Source", MISSING_LABEL),
        ColumnRule("pdb_origin", CATEGORY, "PDB origin", MISSING_LABEL),
        ColumnRule(
            "pdb_confidence", NUMBER, "Mean pLDDT", MISSING_CONFIDENCE, short, low=0.0, high=100.0
        ),
    ]
    for key in keys:
        rules += [
            ColumnRule(
                f"TMscore_v_{key}", NUMBER, f"TMscore vs. {key}", MISSING_SCORE, short, 0.0, 1.0
            ),
            ColumnRule(
                f"fident_v_{key}",
                NUMBER,
                f"Fraction seq identity vs. {key}",
                MISSING_SCORE,
                short,
                0.0,
                1.0,
            ),
            ColumnRule(
                f"concordance_v_{key}",
                NUMBER,
                f"Concordance vs. {key}",
                MISSING_CONCORDANCE,
                short,
                -1.0,
                1.0,
            ),
            ColumnRule(
                f"{key}.hit",
                HOVER,
                f"Blast/Foldseek Hit to {key}",
                0,
                lambda c: c == 1,
            ),
        ]
    return rules


def _filled(rule: ColumnRule) -> Column:
    column = F.col(f"`{rule.column}`")
    if rule.kind == TAXON:
        return F.coalesce(column, F.array().cast("array<string>"))
    if rule.fill is None:
        return column
    if rule.kind == CATEGORY and isinstance(rule.fill, str):
        column = column.cast("string")
    return F.coalesce(column, F.lit(rule.fill))


def prepared(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Fill and transform every column that has a rule, in one projection."""
    by_name = {rule.column: rule for rule in rules}
    cells = []
    for name in df.columns:
        rule = by_name.get(name)
        if rule is None:
            cells.append(F.col(f"`{name}`"))
            continue
        value = _filled(rule)
        cells.append((rule.transform(value) if rule.transform else value).alias(name))
    return df.select(*cells)


def hover_template(columns: Sequence[str], rules: Sequence[ColumnRule]) -> str:
    """The hover template of the plotted columns; entry 0 is the protein id."""
    shown = [rule for rule in rules if rule.in_hover and rule.column in columns]
    lines = ["<b>%{customdata[0]}</b></br>" + HOVER_RULE]
    lines += [
        f"<b>{rule.label}</b>: %{{customdata[{place}]}}" for place, rule in enumerate(shown, 1)
    ]
    return "<br>".join(lines)


def with_hover(df: DataFrame, rules: Sequence[ColumnRule], key: str = "protid") -> DataFrame:
    """Add ``hover``: the template filled with the row's own values."""
    shown = [rule for rule in rules if rule.in_hover and rule.column in df.columns]
    lines = [F.concat(F.lit("<b>"), F.col(key).cast("string"), F.lit("</b></br>" + HOVER_RULE))]
    lines += [
        F.concat(
            F.lit(f"<b>{rule.label}</b>: "), F.coalesce(F.col(f"`{rule.column}`").cast("string"), F.lit(""))
        )
        for rule in shown
    ]
    return df.withColumn("hover", F.concat_ws("<br>", *lines))


def with_taxon(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Add ``<column>_taxonomic`` for every taxonomic rule."""
    for rule in rules:
        if rule.kind == TAXON and rule.column in df.columns:
            df = df.withColumn(
                f"{rule.column}_taxonomic", taxon_category(F.col(f"`{rule.column}`"), rule.taxa)
            )
    return df


def plot_points(
    df: DataFrame, rules: Sequence[ColumnRule], x: str, y: str, key: str = "protid"
) -> DataFrame:
    """Long plot table: one row per protein and coloured feature.

    ``category`` is set for categorical and taxonomic features, ``value`` for
    continuous ones.
    """
    ready = with_taxon(df, rules)
    entries = []
    for rule in rules:
        if rule.kind == HOVER or rule.column not in df.columns:
            continue
        source = f"{rule.column}_taxonomic" if rule.kind == TAXON else rule.column
        cell = F.col(f"`{source}`")
        number = rule.kind == NUMBER
        entries.append(
            F.struct(
                F.lit(rule.column).alias("feature"),
                F.lit(rule.kind).alias("kind"),
                (cell.cast("double") if number else F.lit(None).cast("double")).alias("value"),
                (F.lit(None).cast("string") if number else cell.cast("string")).alias("category"),
            )
        )
    return ready.select(
        F.col(key).alias("protid"),
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
        F.inline(F.array(*entries)),
    )


def category_table(df: DataFrame, column: str) -> DataFrame:
    """Sorted categories of a column with their size."""
    return (
        df.groupBy(F.col(f"`{column}`").cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("category")
    )


def _lightened(colour: Column, step: Column) -> Column:
    """A #RRGGBB colour moved towards white; step 0 leaves it as it is."""
    parts = []
    for start in (2, 4, 6):
        value = F.conv(F.substring(colour, start, 2), 16, 10).cast("int")
        lighter = F.round(value + (255 - value) * step / (step + 1)).cast("int")
        parts.append(F.lpad(F.hex(lighter), 2, "0"))
    return F.concat(F.lit("#"), *parts)


def category_colours(
    df: DataFrame,
    column: str,
    palette: Sequence[str] | None = None,
    fixed: Mapping[str, str] | None = None,
) -> DataFrame:
    """``category, colour`` of every category of a column.

    With ``fixed`` every category must have an entry.  With a palette colours go to
    the categories in sorted order; when they run out, lighter shades follow.
    """
    category = F.col(f"`{column}`").cast("string").alias("category")
    names = df.select(category).where(F.col("category").isNotNull())
    if fixed is not None:
        missing = names.where(~F.col("category").isin(list(fixed))).select("category").limit(1)
        for row in missing.collect():
            raise ValueError(f"no colour for category {row['category']!r} of {column}")
        table = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
        return names.distinct().select("category", table[F.col("category")].alias("colour"))
    if not palette:
        raise ValueError("a palette or fixed colours are needed")
    codes = dense_codes(names, "category")
    base = F.get(F.array(*[F.lit(c) for c in palette]), F.pmod("code", F.lit(len(palette))).cast("int"))
    shade = F.floor(F.col("code") / len(palette))
    return codes.select("category", _lightened(base, shade).alias("colour"))


def shows_legend(categories: DataFrame) -> bool:
    return len(categories.limit(LEGEND_LIMIT + 1).collect()) <= LEGEND_LIMIT


def axis_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Axis limits with a margin on both sides, one row per axis."""
    aggregates = []
    for name in columns:
        aggregates += [F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max")]
    limits = df.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(name).alias("axis"),
            (
                F.col(f"{name}_min") - (F.col(f"{name}_max") - F.col(f"{name}_min")) * AXIS_MARGIN
            ).alias("low"),
            (
                F.col(f"{name}_max") + (F.col(f"{name}_max") - F.col(f"{name}_min")) * AXIS_MARGIN
            ).alias("high"),
        )
        for name in columns
    ]
    return limits.select(F.inline(F.array(*rows)))


def color_limits(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Colour range of every continuous column: the rule's limits, else the data's.

    ``missing_until`` is where the band of missing values ends on the 0-1 scale
    that starts at the fill value; null when the fill is inside the range.
    """
    numbers = [r for r in rules if r.kind == NUMBER and r.column in df.columns]
    limits = df.agg(
        *[F.min(F.col(f"`{r.column}`").cast("double")).alias(f"low{i}") for i, r in enumerate(numbers)],
        *[F.max(F.col(f"`{r.column}`").cast("double")).alias(f"high{i}") for i, r in enumerate(numbers)],
    )
    rows = []
    for i, rule in enumerate(numbers):
        low = F.lit(float(rule.low)) if rule.low is not None else F.col(f"low{i}")
        high = F.lit(float(rule.high)) if rule.high is not None else F.col(f"high{i}")
        fill = F.lit(None).cast("double") if rule.fill is None else F.lit(float(rule.fill))
        banded = fill < low
        # The scale gains a piece of relative length (low - fill) / (high - fill) below 0.
        piece = F.try_divide(low - fill, high - fill)
        rows.append(
            F.struct(
                F.lit(rule.column).alias("feature"),
                F.when(banded, fill).otherwise(low).alias("low"),
                high.alias("high"),
                F.when(banded, piece / (piece + 1)).alias("missing_until"),
            )
        )
    return limits.select(F.inline(F.array(*rows)))


def key_points(df: DataFrame, keys: Sequence[str], key: str = "protid") -> DataFrame:
    """The rows of the key proteins, drawn on top."""
    return df.where(F.col(key).isin(list(keys)))


def custom_rules(
    rules: Sequence[ColumnRule], changes: dict[str, dict[str, object]]
) -> list[ColumnRule]:
    """Rules with some settings replaced, by column; the given rules stay as they are."""
    return [replace(rule, **changes.get(rule.column, {})) for rule in rules]
