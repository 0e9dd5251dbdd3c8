"""Structure files as one text scan: every line with its file and line number.

All facts about a structure come from conditional aggregates over this scan
(``operators.quality``), so each file is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.functions.identifiers import file_stem
from homologrid.schemas import ATOM_DOUBLES, ATOM_FIELDS, ATOM_INTEGERS


def read_structure_lines(spark: SparkSession, folder: str, glob: str = "*.pdb") -> DataFrame:
    """``protid, line_no, line`` of every structure in a folder.

    A structure is one small file; it is read whole so that lines keep their
    order, then split into rows straight away.
    """
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(
        file_stem(F.col("_metadata.file_name")).alias("protid"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"),
    )


def fixed_width(line: Column, start: int, stop: int) -> Column:
    """Trimmed characters ``start:stop`` (0-based, half-open), null when blank."""
    text = F.trim(F.substring(line, start + 1, stop - start))
    return F.when(text != "", text)


def is_atom(line: Column) -> Column:
    return F.substring(line, 1, 6).contains("ATOM")


def atoms(lines: DataFrame) -> DataFrame:
    """Typed ATOM records."""
    cells = []
    for name, (start, stop) in ATOM_FIELDS.items():
        cell = fixed_width(F.col("line"), start, stop)
        if name in ATOM_INTEGERS:
            cell = cell.try_cast("int")
        elif name in ATOM_DOUBLES:
            cell = cell.try_cast("double")
        cells.append(cell.alias(name))
    return lines.where(is_atom(F.col("line"))).select("protid", "line_no", *cells)


def database_references(lines: DataFrame) -> DataFrame:
    """The database named by each DBREF record (its sixth word)."""
    return lines.where(F.substring("line", 1, 6).contains("DBREF")).select(
        "protid",
        "line_no",
        F.get(F.split(F.trim("line"), r"\s+"), F.lit(5)).alias("database"),
    )


def _record_text(lines: DataFrame, tag: str, name: str) -> DataFrame:
    """Words of all lines that mention a record tag, without the tag, lines in order.

    The group is the header of one file, which is small whatever the file count.
    """
    words = F.filter(F.split(F.trim("line"), r"\s+"), lambda word: word != tag)
    return (
        lines.where(F.col("line").contains(tag))
        .select("protid", "line_no", F.array_join(words, " ").alias("text"))
        .groupBy("protid")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("records"))
        .select("protid", F.array_join(F.col("records.text"), " ").alias(name))
    )


def titles(lines: DataFrame) -> DataFrame:
    return _record_text(lines, "TITLE", "title")


def remarks(lines: DataFrame) -> DataFrame:
    return _record_text(lines, "REMARK", "remark")


def experiments(lines: DataFrame) -> DataFrame:
    """Experimental methods as a list (the record separates them with semicolons)."""
    return _record_text(lines, "EXPDTA", "methods").select(
        "protid", F.split("methods", ";").alias("methods")
    )
